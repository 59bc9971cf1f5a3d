import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documento(spark):
    """Rows of the documento table with a text: (id, texto[, arquivo_origem])."""

    def make(rows, id_type=None, **more):
        schema = T.StructType([T.StructField("id", id_type or T.StringType()), T.StructField("texto", T.StringType())])
        for name, kind in more.items():
            schema.add(name, kind)
        return spark.createDataFrame(rows, schema)

    return make
