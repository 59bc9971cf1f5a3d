"""Raw document files: listing, hashing, true extension, text of CSV attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes (hexadecimal) of the known formats.
SIGNATURES = (
    ("25504446", ".pdf"),
    ("FFD8FF", ".jpg"),
    ("89504E470D0A1A0A", ".png"),
    ("49492A00", ".tif"),
    ("4D4D002A", ".tif"),
    ("424D", ".bmp"),
    ("504B0304", ".xlsx"),
    ("D0CF11E0", ".xls"),
)


def suffix(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def true_extension(head: Column, path: Column) -> Column:
    """Extension the content proves; unknown content keeps its own, else ``.bin``."""
    first = F.hex(F.substring(head, 1, 16))
    own = suffix(path)
    out = None
    for mark, ext in SIGNATURES:
        value = F.when(own.isin(".docx", ".zip"), own).otherwise(ext) if ext == ".xlsx" else F.lit(ext)
        hit = first.startswith(mark)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    text = F.lower(F.ltrim(F.regexp_replace(F.decode(F.substring(head, 1, 16), "ISO-8859-1"), r"^[\s]+", "")))
    return out.when(text.startswith("<?xml"), ".xml").otherwise(F.coalesce(F.nullif(own, F.lit("")), F.lit(".bin")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<slug>/`` with hash, size and true extension; content is read once per file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("slug"), F.col("path").alias("arquivo_origem"),
        F.substring_index("path", "/", -1).alias("nome"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("enviado_em"), F.sha2("content", 256).alias("hash_sha256"),
        true_extension(F.col("content"), F.col("path")).alias("extensao"),
    )


def source_record(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Record of a tabular source for its provenance: per file its bytes, SHA-256 and field list.

    Works on one file or a folder of them. A file whose first line is empty has no fields; one
    without any byte gives no row. Content is hashed where it is read, one file a row, so a file
    may have 2 GB at most.
    """
    raw = spark.read.format("binaryFile").load(path)
    first = F.regexp_extract(F.decode(F.substring("content", 1, 65536), "UTF-8"), r"^\ufeff?([^\r\n]*)", 1)
    names = F.transform(F.split(first, F.lit("\\Q" + sep + "\\E")), lambda c: F.trim(F.trim(c), F.lit('"')))
    return raw.select(
        F.substring_index("path", "/", -1).alias("arquivo"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
        F.when(first == "", F.array().cast("array<string>")).otherwise(names).alias("campos"),
    )


def csv_text(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """CSV attachments as text: header and all rows of each file, or the first ``rows`` of them."""
    whole = spark.read.text(path, wholetext=True).withColumn("arquivo_origem", F.input_file_name())
    lines = F.split("value", r"\r\n|\r|\n")
    kept = lines if rows is None else F.slice(lines, 1, rows + 1)
    return whole.select("arquivo_origem", F.concat(F.lit("csv\n"), F.trim(F.array_join(kept, "\n"))).alias("texto"))
