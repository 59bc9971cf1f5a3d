"""Line dedup: three-line windows found earlier elsewhere are removed."""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotproof.llm import batches as B
from plotproof.session import materialise

_BLANK = b" \t\n\x0b\x0c\r"
ADDED = T.StructType([T.StructField("n_linhas", T.LongType()), T.StructField("n_removidas", T.LongType())])


def worded_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the places of those that hold a word."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(_BLANK)]


def window_places(text: bytes, size: int) -> dict[bytes, list[int]]:
    """By digest of ``size`` consecutive worded lines: the windows' numbers, ascending."""
    lines, worded = worded_lines(text)
    trimmed = [lines[i].strip(_BLANK) for i in worded]
    places: dict[bytes, list[int]] = {}
    for k in range(len(trimmed) - size + 1):
        digest = blake2b(b"\n".join(trimmed[k : k + size]), digest_size=16).digest()
        places.setdefault(digest, []).append(k)
    return places


def dedup_lines(documento: DataFrame, linhas: int = 3) -> DataFrame:
    """``documento`` rows with later occurrences of repeated line windows taken out of ``texto``.

    A window is ``linhas`` consecutive lines that hold a word, compared without the
    white space around them; blank lines are passed over. Of all occurrences of a
    window, over all rows, the first stays: smallest ``id``, then smallest place. The
    lines of every other occurrence are removed, overlapping ones together. All other
    lines stay as they are, blank ones too. Windows are judged on the input.

    Returns the input columns, ``texto`` without these lines, then ``n_linhas`` (worded
    lines before) and ``n_removidas``; input columns of these names are replaced. A null
    text stays null with no lines; fewer than ``linhas`` worded lines make no window.
    Null ids come last. Rows of a repeated id count as one place: each keeps its first
    occurrence. An empty table gives no rows.

    Windows, not texts, are grouped: per window the smallest id, by partial minima, is
    joined back to the windows, and the removed places to their rows. A window that
    stands in a large part of all rows gives a long join key, which adaptive execution splits.
    """
    if linhas < 1:
        raise ValueError("linhas must be 1 or more")
    kind = documento.schema["id"].dataType.simpleString()
    schema = f"id {kind}, chave long, janela binary, lugares array<int>"

    def windows(rows):
        for batch in rows:
            ids, keys, texts = batch.column("id"), batch.column("chave"), B.utf8(batch.column("texto"))
            owner, digests, places = [], [], []
            for i, text in enumerate(texts):
                for digest, at in window_places(text, linhas).items():
                    owner.append(i)
                    digests.append(digest)
                    places.append(at)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(owner, pa.int32())),
                    keys.take(pa.array(owner, pa.int32())),
                    pa.array(digests, pa.binary()),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                names=["id", "chave", "janela", "lugares"],
            )

    keyed = documento.select("id", F.xxhash64("texto").alias("chave"), "texto")
    found = materialise(keyed.mapInArrow(windows, schema), "janelas-de-linhas")
    first = (
        found.groupBy("janela")
        .agg(F.min("id").alias("primeiro"), F.sum(F.size("lugares")).alias("vezes"))
        .where("vezes > 1")
    )
    later = F.coalesce(F.col("id") > F.col("primeiro"), F.col("id").isNull() & F.col("primeiro").isNotNull())
    removed = (
        found.join(first, "janela")
        .select("id", "chave", F.when(later, F.col("lugares")).otherwise(F.slice("lugares", 2, 2**31 - 2)).alias("l"))
        .where("size(l) > 0")
        .groupBy("id", "chave")
        .agg(F.flatten(F.collect_list("l")).alias("_lugares"))
        .select(F.col("id").alias("_id"), F.col("chave").alias("_de"), "_lugares")
    )
    joined = documento.withColumn("_chave", F.xxhash64("texto")).join(
        removed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_chave") == F.col("_de")), "left"
    )
    wide = joined.select(*documento.columns, "_lugares")
    out = B.carried(documento.schema, ADDED)
    arrow = to_arrow_schema(out)

    def cut(rows):
        for batch in rows:
            texts = batch.column("texto").cast(pa.binary()).to_pylist()
            kept, totals, gone = [], [], []
            for text, places in zip(texts, batch.column("_lugares").to_pylist(), strict=True):
                lines, worded = worded_lines(text or b"")
                drop = {worded[k + d] for k in places or () for d in range(linhas)}
                if drop:
                    text = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                kept.append(text)
                totals.append(len(worded))
                gone.append(len(drop))
            texts = pa.array(kept, pa.binary()).cast(arrow.field("texto").type)
            yield B.attach(batch, arrow, {"texto": texts, "n_linhas": totals, "n_removidas": gone})

    return wide.mapInArrow(cut, out)
