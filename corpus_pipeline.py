"""Training-data pipeline over the documents table: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotproof.llm import packing
from plotproof.llm import queries as Q
from plotproof.llm.decontamination import decontaminate
from plotproof.llm.line_dedup import dedup_lines
from plotproof.llm.quality_rules import quality_rules
from plotproof.llm.similar_texts import distinct_texts
from plotproof.session import scratch_path

_NAMES = {"doc_id": "id", "text": "texto", "lang": "idioma"}

#: Rows of a batch that a Python worker holds at once. Its workers outlive the stages and share an executor with its
#: heap, so what one of them ever held counts against all later stages; a batch holds rows, not bytes.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words a packing worker remembers: fewer than alone, beside the memory of the stages before.
REMEMBERED = packing.REMEMBERED // 4


def _as_documento(docs: DataFrame) -> DataFrame:
    """Names of the domain; all other columns travel in one, so that no name of theirs meets an operator's."""
    rest = [F.col(c) for c in docs.columns if c not in _NAMES]
    return docs.select(*[F.col(c).alias(n) for c, n in _NAMES.items()], F.struct(*rest).alias("_resto") if rest else F.lit(0).alias("_resto"))


def _as_documents(documento: DataFrame, like: DataFrame) -> DataFrame:
    """Back to the columns of the given table, the length following the text."""

    def column(name: str):
        if name == "n_chars":
            return F.length("texto").cast("long").alias(name)
        return F.col(_NAMES[name]).alias(name) if name in _NAMES else F.col("_resto")[name].alias(name)

    return documento.select(*map(column, like.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Texts are measured once and stay where they are read."""
    judged = quality_rules(_as_documento(docs), Q.rotulo(spark, sf_dir), com_texto=True)
    return _as_documents(judged.where("mantido"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line windows that occur earlier are taken out of the texts; every document stays."""
    return _as_documents(dedup_lines(_as_documento(docs)), docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    return _as_documents(distinct_texts(_as_documento(docs), palavras=5, similaridade=0.8), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    clean = decontaminate(_as_documento(docs), Q.avaliacao(spark, sf_dir)).where("not contaminado")
    return _as_documents(clean, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    return Q.packed(_as_documento(docs), REMEMBERED)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written and read again."""
    docs, given = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BATCH, given)
    return docs
