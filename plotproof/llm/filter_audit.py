"""Audit of filters applied one after another, in every order.

Each filter is a table of the keys of rows that fail it. What a filter removes
after others is the semi-join of the rows with its own table, then an anti-join
with the table of every filter before it; all prefixes of all orders go through
these joins together, told apart by a number.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.session import materialise, scratch_path

# Words, symbols and limits of the contract's filters.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10


def text_filters() -> dict[str, Column]:
    """Failure conditions of a row, by letter, over ``texto`` (never null) and ``palavras``, its words."""
    words, text = F.col("palavras"), F.col("texto")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * F.size(words).cast("long"),
        "C": 100 * capitals > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


COPIES = "E"


def _key(digest: Column) -> Column:
    """128 bits that tell apart rows of another id or another text."""
    named = F.concat(digest, F.when(F.col("id").isNull(), "?").otherwise(F.concat(F.lit("="), F.col("id").cast("string"))))
    return F.substring(F.unhex(F.sha2(named, 256)), 1, 16)


def failing_ids(documento: DataFrame, parte: str, filtros: dict[str, Column]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows (``chave``, ``id``, ``parte``, ``n``), alike ones counted, and per filter the table of failing ``chave``.

    Filter ``COPIES`` fails where a smaller ``id`` has the same text. Texts are read once.
    """
    text = F.coalesce(F.col("texto"), F.lit(""))
    split = documento.select("id", F.coalesce(F.col(parte).cast("string"), F.lit("")).alias("parte"), text.alias("texto"))
    split = split.withColumn("palavras", F.array_remove(F.split("texto", BLANK), "")).withColumn("resumo", F.sha2("texto", 256))
    measured = split.select(
        _key(F.col("resumo")).alias("chave"),
        "id",
        "parte",
        F.unhex("resumo").alias("resumo"),
        *[condition.alias(f"falha_{letter}") for letter, condition in filtros.items()],
    )
    measured = materialise(measured, "filtros-medidas")
    rows = materialise(measured.groupBy("chave", "id", "parte").agg(F.count("*").alias("n")), "filtros-linhas")
    failing = {letter: measured.where(f"falha_{letter}").select("chave") for letter in filtros}
    # A row is no copy when it has the smallest id of its text; keyed by text and id, so no group of copies is one key.
    first = measured.where("id is not null").groupBy("resumo").agg(F.min("id").alias("id"))
    failing[COPIES] = measured.where("id is not null").join(first, ["resumo", "id"], "left_anti").select("chave")
    spark, stored = documento.sparkSession, {}
    for letter, keys in failing.items():
        path = scratch_path(spark, f"filtro-{letter}")
        keys.distinct().write.parquet(path)
        stored[letter] = spark.read.schema(keys.schema).parquet(path)
    return rows, stored


def removals(rows: DataFrame, falhas: dict[str, DataFrame]) -> DataFrame:
    """Per ``parte``, ``filtro`` and ``antes`` (bits of the filters before it): removed documents.

    ``rows``: (``chave``, ``parte``, ``n``, ``bom``, ``toxico``). Columns ``removidos``,
    ``bons`` and ``toxicos``; only what removes something has a row.
    """
    letters, out = list(falhas), None
    for k, letter in enumerate(letters):
        others = [b for b in range(len(letters)) if b != k]
        prefixes = [sum(1 << b for i, b in enumerate(others) if m >> i & 1) for m in range(1 << len(others))]
        failing = rows.join(falhas[letter], "chave", "left_semi")
        left = failing.withColumn("antes", F.explode(F.array(*map(F.lit, prefixes))))
        for b in others:
            gone = falhas[letters[b]].select(F.col("chave").alias("_chave"))
            used = F.col("antes").bitwiseAND(F.lit(1 << b)) != 0
            left = left.join(gone, (F.col("chave") == F.col("_chave")) & used, "left_anti")
        counted = left.groupBy("parte", F.lit(letter).alias("filtro"), "antes").agg(
            F.sum("n").alias("removidos"), F.sum(F.col("n") * F.col("bom")).alias("bons"), F.sum(F.col("n") * F.col("toxico")).alias("toxicos")
        )
        out = counted if out is None else out.unionByName(counted)
    return out


def audit_filters(documento: DataFrame, rotulo: DataFrame, parte: str = "idioma", filtros: dict[str, Column] | None = None) -> DataFrame:
    """What every filter does at every place of every order, per value of the column named by ``parte``.

    ``documento``: ``id``, ``texto`` and the part column; ``rotulo``: ``id``, ``qualidade``
    and ``toxico``. ``filtros``: failure conditions as in :func:`text_filters` (its default);
    the filter on copies joins them. One row per part, ``ordem`` (the letters in the order
    applied) and ``passo`` from 1, with the counts of documents ``mantidos`` (after this
    step), ``removidos`` (here), ``redundantes`` (failing this filter, removed earlier),
    ``falhas_unicas`` (failing this filter alone), ``bons_perdidos`` and
    ``toxicos_perdidos`` (removed here with the label), and ``shapley`` (removed by this
    filter, over all orders).

    A null text is empty, a null part the empty string. Rows of a repeated id count each
    with its own text; a null id has no label and is neither copy nor original. A document
    is good or toxic when any of its label rows says so; other labels count nothing. An
    empty table gives no rows; further input columns are ignored, and the part column may
    have any name.

    Keys, not texts, are joined, and every key is one kind of row, so no group of copies
    meets in one task. All joins are on the key, so Spark deals each table once. Rows in
    the joins: 2 to the number of the other filters for every failing document.
    """
    filtros = text_filters() if filtros is None else filtros
    rows, falhas = failing_ids(documento, parte, filtros)
    letters = list(falhas)
    said = rotulo.where("id is not null").groupBy("id").agg(
        F.max((F.col("qualidade") == 1).cast("int")).alias("bom"), F.max((F.col("toxico") == 1).cast("int")).alias("toxico")
    )
    labelled = rows.join(said, "id", "left").select(
        "chave", "parte", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bom", "toxico")]
    )
    removed = materialise(removals(labelled, falhas), "filtros-removidos")
    # Bounded: a row per part, with at most filters x prefixes entries in its map.
    entry = F.struct(
        F.concat_ws("/", "filtro", "antes").alias("k"), F.struct("removidos", "bons", "toxicos").alias("v")
    )
    by_part = removed.groupBy("parte").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    totals = rows.groupBy("parte").agg(F.sum("n").alias("_total")).join(by_part, "parte", "left")

    steps, shares = [], {letter: {} for letter in letters}
    for order in permutations(range(len(letters))):
        before = 0
        for step, b in enumerate(order, 1):
            name, earlier = letters[b], [sum(1 << x for x in order[:i]) for i in range(step)]
            keys = [f"{letters[order[i]]}/{earlier[i]}" for i in range(step)]
            steps.append(("".join(letters[x] for x in order), step, name, keys))
            shares[name][before] = shares[name].get(before, 0) + 1
            before |= 1 << b

    def count(key: Column, what: str) -> Column:
        return F.coalesce(F.col("_m")[key][what], F.lit(0).cast("long"))

    everything = (1 << len(letters)) - 1
    per_filter = {
        letter: F.struct(
            count(F.lit(f"{letter}/0"), "removidos").alias("falham"),
            count(F.lit(f"{letter}/{everything & ~(1 << k)}"), "removidos").alias("unicas"),
            sum(count(F.lit(f"{letter}/{m}"), "removidos") * F.lit(w) for m, w in sorted(shares[letter].items())).alias("shapley"),
        ).alias(f"_f_{letter}")
        for k, letter in enumerate(letters)
    }
    plan = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(f).alias("f"), F.array(*map(F.lit, k)).alias("k")) for o, s, f, k in steps])
    wide = totals.select("parte", "_total", "_m", *per_filter.values()).withColumn("_p", F.explode(plan))
    own = F.element_at("_p.k", -1)
    of = F.coalesce(*[F.when(F.col("_p.f") == letter, F.col(f"_f_{letter}")) for letter in letters])
    gone = F.aggregate("_p.k", F.lit(0).cast("long"), lambda acc, k: acc + count(k, "removidos"))
    return wide.select(
        "parte",
        F.col("_p.o").alias("ordem"),
        F.col("_p.s").alias("passo"),
        (F.col("_total") - gone).alias("mantidos"),
        count(own, "removidos").alias("removidos"),
        (of["falham"] - count(own, "removidos")).alias("redundantes"),
        of["unicas"].alias("falhas_unicas"),
        count(own, "bons").alias("bons_perdidos"),
        count(own, "toxicos").alias("toxicos_perdidos"),
        of["shapley"].alias("shapley"),
    )
