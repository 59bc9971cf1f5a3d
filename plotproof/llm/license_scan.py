"""License scan by diagonal voting, in built-in functions only.

All rolling word k-grams of the texts meet, by hash, the places of the same k-grams
in the templates. A hit votes for a diagonal, its place in the text less that in
the template; neighbouring diagonals are one span with a few words put in or left
out, and a span counts by how much of the template's own words it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotproof.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII that is neither letter nor digit.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Public wordings of licenses and of the lines that name them.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)
PHRASE_GRAM, TEMPLATE_GRAM = 2, 3
#: Templates up to this many words are sent to every task; larger sets meet the texts in a shuffled join.
SENT_WORDS = 200_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null is empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _gram(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from ``at`` on; null where they run past the end."""
    parts = [F.get(words, at + k) for k in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def template_places(spark: SparkSession, modelos, frases) -> DataFrame:
    """Every k-gram of the templates: ``modelo`` (number), ``rotulo``, ``frase``, ``n`` (words), ``lugar``, ``h`` and its words."""
    given = [(i, label, text, i < len(frases)) for i, (label, text) in enumerate([*frases, *modelos])]
    rows = [F.struct(F.lit(i).alias("modelo"), F.lit(r).alias("rotulo"), F.lit(t).alias("texto"), F.lit(f).alias("frase")) for i, r, t, f in given]
    cut = spark.range(1).select(F.explode(F.array(*rows)).alias("m")).select("m.modelo", "m.rotulo", "m.frase", words_of(F.col("m.texto")).alias("palavras"))
    each = cut.select("*", F.posexplode("palavras").alias("lugar", "_w"))
    grams = []
    for flag, size in ((True, PHRASE_GRAM), (False, TEMPLATE_GRAM)):
        grams.append(
            each.where(F.col("frase") if flag else ~F.col("frase")).select(
                "modelo", "rotulo", "frase", F.size("palavras").alias("n"), "lugar",
                _gram(F.col("palavras"), F.col("lugar"), size).alias("h"), F.slice("palavras", F.col("lugar") + 1, size).alias("grama"),
            )
        )
    return grams[0].unionByName(grams[1]).where("h is not null")


def hits(documento: DataFrame, modelos, frases) -> DataFrame:
    """Written table: one row per input row (``pos`` -1: ``linha``, ``id``, ``n_palavras``), and one per k-gram found in a template.

    One pass over the texts. Hits are confirmed word by word. ``linha`` tells rows apart and is
    fixed by the write, as all rows of a text come from one task.
    """
    spark = documento.sparkSession
    places = template_places(spark, modelos, frases)
    if sum(len(text.split()) for _, text in [*frases, *modelos]) <= SENT_WORDS:
        places = F.broadcast(places)
    split = documento.select("id", words_of(F.col("texto")).alias("palavras")).withColumn("linha", F.monotonically_increasing_id())
    # The row of the text itself has place -1, so texts without words or hits have one too.
    at = split.select("*", F.explode(F.sequence(F.lit(-1), F.size("palavras") - 1)).alias("pos"))
    found = F.array(*[_gram(F.col("palavras"), F.col("pos"), k) for k in (PHRASE_GRAM, TEMPLATE_GRAM)])
    at = at.select("*", F.explode(F.when(F.col("pos") < 0, F.array(F.lit(None).cast("long"))).otherwise(found)).alias("_h"))
    same = (F.col("_h") == F.col("h")) & (F.slice("palavras", F.col("pos") + 1, F.size("grama")) == F.col("grama"))
    met = at.join(places, same, "left").where("modelo is not null or pos < 0")
    return materialise(
        met.select("linha", "id", F.size("palavras").cast("long").alias("n_palavras"), "pos", "modelo", "rotulo", "frase", "n", "lugar"), "licencas"
    )


def phrase_places(found: DataFrame) -> DataFrame:
    """Places (``linha``, ``rotulo``, ``pos``) where all k-grams of a phrase stand on one diagonal."""
    diagonal = found.where("frase").groupBy("linha", "modelo", "rotulo", "n", (F.col("pos") - F.col("lugar")).alias("pos")).count()
    return diagonal.where(F.col("count") == F.col("n") - (PHRASE_GRAM - 1)).select("linha", "rotulo", "pos")


def template_spans(found: DataFrame, faixa: int, minimo: float) -> DataFrame:
    """Verified spans (``linha``, ``rotulo``, ``cobertura``): neighbouring diagonals merged, then held against the template.

    Diagonals at most ``faixa`` words apart, each beginning less than a template's length
    after the one before, are one span; ``cobertura`` is the share of the template's words
    in it, at least ``minimo``.
    """
    diagonal = (
        found.where("not frase")
        .groupBy("linha", "modelo", "rotulo", "n", (F.col("pos") - F.col("lugar")).alias("diagonal"))
        # Bounded by the template's length.
        .agg(F.min("pos").alias("de"), F.collect_set("lugar").alias("lugares"))
    )
    order = Window.partitionBy("linha", "modelo").orderBy("de", "diagonal")
    apart = F.coalesce(
        (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > faixa) | (F.col("de") - F.lag("de").over(order) >= F.col("n")), F.lit(True)
    )
    spans = diagonal.withColumn("_novo", apart.cast("int")).withColumn("trecho", F.sum("_novo").over(order))
    spread = spans.select("linha", "modelo", "rotulo", "n", "trecho", F.explode("lugares").alias("lugar"))
    covered = spread.select("*", F.explode(F.sequence(F.col("lugar"), F.col("lugar") + (TEMPLATE_GRAM - 1))).alias("palavra"))
    held = covered.groupBy("linha", "modelo", "rotulo", "n", "trecho").agg(F.count_distinct("palavra").alias("k"))
    return held.select("linha", "rotulo", (F.col("k") / F.col("n")).alias("cobertura")).where(F.col("cobertura") >= minimo)


def scan_licenses(documento: DataFrame, modelos=TEMPLATES, frases=PHRASES, faixa: int = 3, minimo: float = 0.75) -> DataFrame:
    """License wordings in every ``documento`` row (``id``, ``texto``), whole texts.

    ``modelos`` and ``frases``: (label, wording) pairs of at least three and two words.
    A phrase counts where its words stand consecutively; a template where a span, with at
    most ``faixa`` words put in or left out between its parts, holds the share ``minimo`` of its words.

    Returns per input row ``id``, ``n_palavras``, ``n_frases`` (all places), ``primeira`` and
    ``ultima`` (their smallest and largest start, words from 0; null without one),
    ``rotulos_frases`` and ``rotulos`` (of phrases; of both; distinct, sorted) and ``nota``:
    the largest share of a wording found, 1 for a phrase, 0 for none.

    A null text is empty. Repeated rows, null ids too, are judged each for itself; an empty
    table gives no rows; further input columns are ignored. Wordings that overlap all count.

    Texts are read once and not shuffled; what is shuffled are hits, keyed by row, so a
    wording that every text holds is no hot key.
    """
    found = hits(documento, modelos, frases)
    phrases = phrase_places(found).groupBy("linha").agg(
        F.count("*").alias("n_frases"), F.min("pos").cast("long").alias("primeira"), F.max("pos").cast("long").alias("ultima"), F.collect_set("rotulo").alias("_f")
    )
    spans = template_spans(found, faixa, minimo).groupBy("linha").agg(F.collect_set("rotulo").alias("_t"), F.max("cobertura").alias("_c"))
    none = F.array().cast("array<string>")
    own, other = F.coalesce("_f", none), F.coalesce("_t", none)
    return (
        found.where("pos < 0")
        .select("linha", "id", "n_palavras")
        .join(phrases, "linha", "left")
        .join(spans, "linha", "left")
        .select(
            "id",
            "n_palavras",
            F.coalesce("n_frases", F.lit(0).cast("long")).alias("n_frases"),
            "primeira",
            "ultima",
            F.sort_array(own).alias("rotulos_frases"),
            F.sort_array(F.array_union(own, other)).alias("rotulos"),
            F.when(F.size(own) > 0, 1.0).otherwise(F.coalesce("_c", F.lit(0.0))).alias("nota"),
        )
    )
