"""Benchmark decontamination by multi-pattern search over words.

Wu-Manber on word hashes: every run of two words that ends a position has a
shift, the distance the search may jump because no test string can end sooner.
Shift zero selects a bucket by the hash of the last two words, and the bucket's
strings are compared directly. Many stretches of text advance side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotproof.llm import batches as B

LANE_WORDS = 512
_PAIR = np.uint64(0x9E3779B97F4A7C15)

ADDED = T.StructType(
    [
        T.StructField("n_palavras", T.LongType()),
        T.StructField("n_atingidas", T.LongType()),
        T.StructField("n_itens", T.LongType()),
        T.StructField("itens", T.ArrayType(T.StringType())),
        T.StructField(
            "trechos",
            T.ArrayType(T.StructType([T.StructField("inicio", T.LongType()), T.StructField("fim", T.LongType())])),
        ),
        T.StructField("contaminado", T.BooleanType()),
    ]
)


class Matcher:
    """Test strings of one length in words: shift table, suffix buckets, strings."""

    def __init__(self, strings: list[bytes], length: int):
        self.length, self.block = length, min(2, length)
        words = B.words_of(strings, B.ALNUM)
        hashes = words.hashes().reshape(len(strings), length)
        suffix = self._pair(hashes[:, -self.block], hashes[:, -1])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.words = suffix[order], hashes[order]
        self.strings = [strings[i] for i in order]
        self.bits = max(16, (16 * len(strings) * length).bit_length())
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int32)
        for last in range(self.block - 1, length):
            slot = self._slot(self._pair(hashes[:, last - self.block + 1], hashes[:, last]))
            np.minimum.at(self.shift, slot, length - 1 - last)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return B.mix(a * _PAIR + b)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: B.Words, hashes: np.ndarray):
        """(first word, index of the string) of every occurrence inside one text."""
        n, reach = len(hashes), self.block - 1
        at = np.arange(0, n, LANE_WORDS)
        stop = np.minimum(at + LANE_WORDS, n)
        at = np.maximum(at, self.length - 1)
        ends, pairs = [], []
        while len(at):
            inside = at < stop
            at, stop = at[inside], stop[inside]
            pair = self._pair(hashes[at - reach], hashes[at])
            jump = self.shift[self._slot(pair)]
            stays = jump == 0
            if stays.any():
                ends.append(at[stays])
                pairs.append(pair[stays])
            at = at + np.maximum(jump, 1)
        if not ends:
            return
        end, pair = np.concatenate(ends), np.concatenate(pairs)
        low, high = np.searchsorted(self.suffix, pair, "left"), np.searchsorted(self.suffix, pair, "right")
        same_text = words.owner[end] == words.owner[end - self.length + 1]
        while True:
            left = (low < high) & same_text
            if not left.any():
                return
            end, low, high, same_text = end[left], low[left], high[left], same_text[left]
            equal = np.ones(len(end), bool)
            for t in range(self.length):
                equal &= hashes[end - self.length + 1 + t] == self.words[low, t]
            for e, k in zip(end[equal].tolist(), low[equal].tolist(), strict=True):
                begin = e - self.length + 1
                if words.text(begin, e + 1) == self.strings[k]:
                    yield begin, k
            low = low + 1


def test_strings(items: list[tuple[str, bytes]], window: int) -> dict[int, dict[bytes, set[str]]]:
    """By length in words: each distinct window and the items it comes from."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        words = B.words_of([text], B.ALNUM)
        n = len(words.start)
        length = min(n, window)
        for i in range(n - length + 1 if length else 0):
            found.setdefault(length, {}).setdefault(words.text(i, i + length), set()).add(item)
    return found


def decontaminate(
    documento: DataFrame, avaliacao: DataFrame, janela: int = 10, max_caracteres: int = 64_000_000
) -> DataFrame:
    """Words of each ``documento`` row's ``texto`` that lie in a passage of a test item.

    ``documento``: any columns and ``texto``; ``avaliacao``: ``id`` and ``texto`` of the
    test items, of which the project keeps no records of its own, so any table will do.
    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A
    test string is a run of ``janela`` item words, or a shorter item as a whole.

    Returns every input row, with its columns but those of the same name as a result:
    ``n_palavras``, ``n_atingidas`` (words inside an occurrence), ``n_itens``, ``itens``
    (their ids as text, sorted), ``trechos`` (covered word ranges, end exclusive) and
    ``contaminado``. No shuffle; rows are independent, so repeated rows repeat their
    result. Null or empty ``texto`` has no words; without items nothing is hit; items
    with a null id, null or wordless text are never found.

    The items travel to every task. Their total length is measured first and must not
    exceed ``max_caracteres``; larger sets are to be passed in several calls.
    """
    if janela < 1:
        raise ValueError("janela must be 1 or more")
    items = avaliacao.select(F.col("id").cast("string").alias("id"), F.col("texto").alias("texto"))
    items = items.where("id is not null and texto is not null")
    size = items.agg(F.coalesce(F.sum(F.length("texto")), F.lit(0))).first()[0]
    if size > max_caracteres:
        raise ValueError(f"test items hold {size} characters, the bound is {max_caracteres}: pass them in parts")
    listed = [(r["id"], r["texto"].encode()) for r in items.toLocalIterator()]
    strings = test_strings(listed, janela)
    matchers = [Matcher(list(group), length) for length, group in sorted(strings.items())]
    shared = documento.sparkSession.sparkContext.broadcast((matchers, strings))
    schema = B.carried(documento.schema, ADDED)
    arrow = to_arrow_schema(schema)

    def search(rows):
        matchers, strings = shared.value
        for batch in rows:
            texts = B.utf8(batch.column("texto"))
            out = {f.name: [] for f in ADDED}
            for i, j in B.slices(texts):
                _hits(texts[i:j], matchers, strings, out)
            yield B.attach(batch, arrow, out)

    return documento.mapInArrow(search, schema)


def _hits(texts: list[bytes], matchers: list[Matcher], strings: dict, out: dict) -> None:
    words = B.words_of(texts, B.ALNUM)
    hashes = words.hashes()
    n = len(hashes)
    edges = np.zeros(n + 1, np.int64)
    items: dict[int, set[str]] = {}
    for m in matchers:
        if n < m.length:
            continue
        for begin, k in m.find(words, hashes):
            edges[begin] += 1
            edges[begin + m.length] -= 1
            items.setdefault(int(words.owner[begin]), set()).update(strings[m.length][m.strings[k]])
    covered = np.cumsum(edges)[:n] > 0
    totals = np.concatenate([[0], np.cumsum(covered)])
    first = words.first
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        hit = int(totals[b] - totals[a])
        turns = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].view(np.int8), [0]]))) if hit else []
        found = sorted(items.get(d, ()))
        out["n_palavras"].append(b - a)
        out["n_atingidas"].append(hit)
        out["n_itens"].append(len(found))
        out["itens"].append(found)
        out["trechos"].append(
            [{"inicio": int(x), "fim": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)]
        )
        out["contaminado"].append(hit > 0)
