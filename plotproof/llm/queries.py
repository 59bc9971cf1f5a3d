"""Named queries of the training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotproof.llm.decontamination import decontaminate
from plotproof.llm.filter_audit import audit_filters
from plotproof.llm.history_trie import branch, history_trie
from plotproof.llm.language import identify_language, train_language
from plotproof.llm.language_model import score_texts
from plotproof.llm.license_scan import scan_licenses
from plotproof.llm.line_dedup import dedup_lines
from plotproof.llm.oracles import ORACLE  # noqa: F401
from plotproof.llm.packing import REMEMBERED, pack
from plotproof.llm.quality_classifier import classify_quality, train_quality
from plotproof.llm.quality_rules import quality_rules
from plotproof.llm.simhash import near_duplicates
from plotproof.llm.substring_dedup import dedup_substrings
from plotproof.llm.toxicity import score_toxicity, train_toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documento(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The given documents under the names of the domain."""
    return _table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("texto"), *more
    )


def rotulo(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("qualidade"), F.col("toxic").alias("toxico")
    )


def avaliacao(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("texto"))


def remainder(column: str, divisor: int):
    """Remainder of the CRC-32 of an id written as text, which tells learning rows from others."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_substrings(documento(spark, folder)).select(
        F.col("id").alias("doc_id"),
        F.col("n_palavras").alias("n_words"),
        F.col("n_removidas").alias("n_removed"),
        F.sha2("texto", 256).alias("kept_sha256"),
    )


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    learns = F.coalesce(remainder("id", 10) != 0, F.lit(False))
    return score_texts(documento(spark, folder).withColumn("treino", learns)).select(
        F.col("id").alias("doc_id"),
        (~F.col("treino")).alias("held_out"),
        F.col("n_palavras").alias("n_tokens"),
        F.col("n_conhecidas").alias("n_known"),
        F.col("total_treino").alias("train_tokens"),
        F.col("nota_base").alias("base_score"),
        F.col("nota").alias("score"),
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(documento(spark, folder), avaliacao(spark, folder))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n_palavras").alias("n_words"),
        F.col("n_atingidas").alias("n_hit"),
        F.col("n_itens").alias("n_items"),
        F.sha2(F.array_join("itens", ","), 256).alias("items_sha256"),
        F.col("contaminado").alias("contaminated"),
    )


# Tokenizer file, end token and sequence size of the contract.
TOKENIZER, END, SEQUENCE = "word_bpe_49k.json", 2, 4096


def packed(documentos: DataFrame, lembradas: int = REMEMBERED) -> DataFrame:
    """Packed pieces under the names of the contract."""
    import public_tokenizers

    return pack(documentos, public_tokenizers.path(TOKENIZER), END, SEQUENCE, lembradas=lembradas).select(
        F.col("id").alias("doc_id"),
        F.col("inicio").alias("start"),
        F.col("comprimento").alias("length"),
        F.col("crc32").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"),
        F.col("sequencia").alias("sequence_id"),
        F.col("posicao").alias("offset"),
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(documento(spark, folder))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    source = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    docs = documento(spark, folder, source.alias("arquivo_origem"))
    labels = rotulo(spark, folder).where(remainder("id", 3) != 1)
    found = classify_quality(docs, train_quality(docs, labels))
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("evidencia").alias("text_score"),
        F.col("hospedeiro").alias("host_share"),
        F.col("pasta").alias("path_share"),
        F.col("nota").alias("score"),
        F.col("mantido").alias("kept"),
    )


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules(documento(spark, folder, F.col("lang").alias("idioma")), rotulo(spark, folder))
    return judged.select(
        F.col("id").alias("doc_id"),
        F.col("n_palavras").alias("n_words"),
        F.col("n_caracteres").alias("word_chars"),
        F.col("n_simbolos").alias("n_symbols"),
        F.col("n_linhas_repetidas").alias("n_dup_lines"),
        F.col("n_palavras_repetidas").alias("n_repeat_words"),
        F.col("reprovado_base").alias("base_failed"),
        F.col("mantido").alias("kept"),
    )


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documento(spark, folder, F.col("lang").alias("idioma"))
    model = train_language(docs.where(remainder("id", 3) != 1).select("texto", "idioma"))
    return identify_language(docs.select("id", "texto"), model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("idioma").alias("lang_pred"),
        F.col("certeza").alias("score"),
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(documento(spark, folder)).select(
        F.col("id").alias("doc_id"),
        F.col("n_linhas").alias("n_lines"),
        F.col("n_removidas").alias("n_removed"),
        F.sha2("texto", 256).alias("kept_sha256"),
    )


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documento(spark, folder)).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("impressao"), 16, "0")).alias("fingerprint"),
        F.col("grupo").alias("component_id"),
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documento(spark, folder)
    model = train_toxicity(docs, rotulo(spark, folder).where(remainder("id", 3) != 1))
    return score_toxicity(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("toxicidade").alias("score"),
        F.col("toxico").alias("predicted"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select(
        F.col("conv_id").alias("entidade_id"), F.col("turn").alias("timestamp"), F.col("role").alias("ator"), F.col("text").alias("detalhe")
    )
    conv = F.col("entidade_id")
    taken = F.crc32(conv.cast("string").cast("binary")) % 9
    branches = turns.select(conv).where(conv.isNotNull()).distinct().select(conv, (conv - conv % 5).alias("origem_id"), taken.alias("herdados"))
    return history_trie(branch(turns, branches)).select(
        F.col("no").alias("conv_id"),
        F.col("nivel").alias("depth"),
        F.col("pai").alias("parent_conv_id"),
        F.col("n_historias").alias("n_convs"),
        F.col("n_filhos").alias("n_children"),
        F.col("n_folhas").alias("n_leaves"),
        F.col("poupados").alias("saved_tokens"),
        F.col("fins_sha256").alias("ends_sha256"),
    )


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documento(spark, folder)).select(
        F.col("id").alias("doc_id"),
        F.col("n_palavras").alias("n_words"),
        F.col("n_frases").alias("n_base"),
        F.col("primeira").alias("first_word"),
        F.col("ultima").alias("last_word"),
        F.array_join("rotulos_frases", ",").alias("base_labels"),
        F.array_join("rotulos", ",").alias("labels"),
        F.col("nota").alias("score"),
    )


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = audit_filters(documento(spark, folder, F.col("lang").alias("idioma")), rotulo(spark, folder))
    return audit.select(
        F.col("parte").alias("part"),
        F.col("ordem").alias("filter_order"),
        F.col("passo").alias("step"),
        F.col("mantidos").alias("kept"),
        F.col("removidos").alias("removed"),
        F.col("redundantes").alias("redundant"),
        F.col("falhas_unicas").alias("unique_fails"),
        F.col("bons_perdidos").alias("good_lost"),
        F.col("toxicos_perdidos").alias("toxic_lost"),
        F.col("shapley").alias("shapley"),
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
    "op13_filter_audit": op13_filter_audit,
}
