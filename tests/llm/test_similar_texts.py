"""One text of each group of similar ones, against shingle sets in plain Python."""

import random

import pytest
from pyspark.sql import types as T

from plotproof.llm.similar_texts import distinct_texts, shingle_hashes


def shingles(text, size):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\x0b", " ").split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1 if w else 0))}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_kept(before, after, size, limit, missed=0):
    """Kept rows are given ones, at most ``missed`` pairs of them are similar, and every other row is similar to one of them."""
    left = list(before)
    for row in after:
        left.remove(row)
    kept = [shingles(t, size) for _, t in after]
    assert sum(similarity(a, b) >= limit for i, a in enumerate(kept) for b in kept[:i]) <= missed
    for _, t in left:
        assert any(similarity(shingles(t, size), a) >= limit for a in kept)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijkl", k=5)) for _ in range(n))


def edited(rng, text, share):
    return " ".join("trocada%d" % rng.randint(0, 9999) if rng.random() < share else w for w in text.split())


def run(documento, rows, size=5, limit=0.8, missed=0, **more):
    out = distinct_texts(documento(rows, T.LongType(), **more), size, limit).collect()
    check_kept([(i, t) for i, t, *_ in rows], [(r["id"], r["texto"]) for r in out], size, limit, missed)
    return out


def test_groups_match_brute_force(documento):
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([3, 5, 6, 40, 200])) for _ in range(60)]
    texts += [edited(rng, rng.choice(texts), rng.choice([0.005, 0.02, 0.04, 0.1])) for _ in range(160)]
    texts += [t.upper() + "  " for t in texts[:10]] + [None, "", " \n", "uma", "uma duas", "UMA"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3])]
    rng.shuffle(rows)
    run(documento, rows)
    run(documento, rows, 3, 0.5)


def test_chain_keeps_every_text_without_a_kept_neighbour(documento):
    rng = random.Random(2)
    chain = [prose(rng, 120)]
    for _ in range(40):  # each is similar to the next, few to the ones after
        w = chain[-1].split()
        at = rng.randrange(0, 100)
        chain.append(" ".join(w[:at] + prose(rng, 6).split() + w[at + 6 :]))
    out = run(documento, list(enumerate(chain)))
    assert 4 < len(out) < 30


def test_one_hot_group_and_its_copies(documento):
    rng = random.Random(5)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, 0.004)) for i in range(600)] + [(1000 + i, base) for i in range(600)]
    rows += [(5000 + i, prose(rng, 60)) for i in range(20)]
    out = run(documento, rows, missed=3)  # of thousands of pairs near the limit
    assert sum(r["id"] >= 5000 for r in out) == 20 and len(out) < 40


@pytest.mark.parametrize("share,least", [(0.019, 0.95), (0.010, 0.98), (0.005, 0.98)])
def test_recall_by_similarity(documento, share, least):
    """Pairs of similarity around 0.83, 0.9 and 0.95: one of two goes."""
    rng = random.Random(7)
    rows, pairs = [], 0
    for i in range(300):
        a = prose(rng, 200)
        b = edited(rng, a, share)
        if 0.8 <= similarity(shingles(a, 5), shingles(b, 5)) < 1:
            rows += [(2 * i, a), (2 * i + 1, b)]
            pairs += 1
    kept = distinct_texts(documento(rows, T.LongType())).count()
    assert pairs > 50 and 2 * pairs - kept >= least * pairs


def test_of_equal_words_the_smallest_id_stays(documento):
    rows = [(None, "a b c d e f"), (9, "a b c d e f"), (4, "A  b c\nd e f"), (7, "a b c d e f")]
    assert [r["id"] for r in run(documento, rows)] == [4]


def test_very_long_text_clashing_columns_and_empty_table(documento):
    rng = random.Random(1)
    long = prose(rng, 120_000)
    more = {c: T.StringType() for c in ("linha", "r1", "n", "faixas", "doc", "chefe", "ordem")}
    rows = [(1, long, *["x"] * 7), (2, long + " fim", *["y"] * 7), (3, None, *[None] * 7)]
    out = run(documento, rows, **more)
    assert len(out) == 2 and all(r["linha"] == r["ordem"] for r in out)
    assert distinct_texts(documento([], T.LongType())).count() == 0
    with pytest.raises(ValueError):
        distinct_texts(documento([], T.LongType()), similaridade=0)


def test_shingles_of_many_texts():
    texts = [b"", b"a b", b"a b c d e f", b"A B C D E", b"a b"]
    values, first = shingle_hashes(texts, 5)
    assert first.tolist() == [0, 0, 1, 3, 4, 5]
    assert values[0] == values[4] and values[1] == values[3] and values[1] != values[2]


def test_close_fingerprints_meet_without_a_common_band(spark):
    from plotproof.llm.similar_texts import BANDS, similar_lines, sketches

    rng = random.Random(4)
    texts = [prose(rng, 400) for _ in range(6)]
    texts += [t + " fim" for t in texts[:3]]
    prints, _ = sketches([t.encode() for t in texts], 5, 5)
    # No two texts share a band, as if their least hashes all differed.
    rows = [(i, rng.getrandbits(40), 400, int(p), [i * BANDS + b for b in range(BANDS)]) for i, p in enumerate(prints.view("int64"))]
    unlike = spark.createDataFrame(rows, "linha long, ordem long, n long, impressao long, faixas array<long>")
    given = spark.createDataFrame(list(enumerate(texts)), "linha long, texto string")
    gone = {r["linha"] for r in similar_lines(unlike, given, 5, 0.8).collect()}
    assert len(gone) == 3 and {i % 6 for i in gone} == {0, 1, 2}
