"""Supply-chain evidence analytics expressed as Spark DataFrame jobs."""
