import random

import numpy as np
import pytest
from pyspark.sql import types as T

from plotproof.llm import language as L
from plotproof.llm import quality_classifier as Q
from plotproof.llm import toxicity as X

SYLLABLES = {
    "en": "the tion ing and er on th".split(),
    "de": "der sch ung ein heit ber ß".split(),
    "fr": "eau eux oi ment que é ç".split(),
    "es": "ción ado ez los mente ñ rr".split(),
    "xx": "qu zz kk ww yy vv jj".split(),
}


def sentence(rng, language, n):
    return " ".join("".join(rng.choices(SYLLABLES[language], k=rng.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(documento):
    rng = random.Random(1)
    rows = [(f"{k}{i}", sentence(rng, k, rng.randint(5, 60)), k) for k in SYLLABLES for i in range(60)]
    model = L.train_language(documento(rows, idioma=T.StringType()), max_por_idioma=40)
    assert set(model.families.names) == {"germanic", "romance", "xx"}
    tests = [(f"{k}-{i}", sentence(rng, k, 30)) for k in SYLLABLES for i in range(20)]
    got = L.identify_language(documento(tests), model).collect()
    assert sum(r["idioma"] == r["id"].split("-")[0] for r in got) >= 98
    assert all(0 <= r["certeza"] <= 1 for r in got)


def test_language_edge_cases(documento):
    rows = [("a", "um lote", "pt", 3.0), ("a", "um lote", "pt", 3.0), (None, None, None, None), ("b", "123 !?", "pt", 0.0)]
    docs = documento(rows, idioma=T.StringType(), certeza=T.DoubleType())
    none = L.train_language(docs.limit(0))
    assert {r["idioma"] for r in L.identify_language(docs, none).collect()} == {"und"}
    one = L.train_language(docs)
    got = sorted((r["id"] or "", r["idioma"]) for r in L.identify_language(docs, one).collect())
    assert got == [("", "und"), ("a", "pt"), ("a", "pt"), ("b", "und")]
    assert L.identify_language(docs.limit(0), one).count() == 0


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    alone = L.features(["ção de cacau"])
    among = L.features(["kg", "ção de cacau", ""])
    assert np.allclose(alone[0], among[1]) and not among[2].any()


def test_support_vector_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + x[:, 1] > 0.2, 1.0, -1.0)
    w = L.fit_svm(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


def quality_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        text = sentence(rng, "es", 40) if good else " ".join(w + "###" for w in sentence(rng, "es", 40).split())
        rows.append((str(i), text, int(good), f"sitio{i % 3}/pasta{i % 6}/{i}.txt"))
    return rows


def test_quality_learns_and_keeps_clean_documents(documento):
    rows = quality_rows(1, 300)
    docs = documento(rows, qualidade=T.IntegerType(), arquivo_origem=T.StringType())
    model = Q.train_quality(docs, docs.where("cast(id as int) < 200").select("id", "qualidade"))
    got = {r["id"]: r for r in Q.classify_quality(docs.drop("qualidade"), model).collect()}
    assert all(got[i]["mantido"] == bool(y) for i, _, y, _ in rows)


def test_posteriors_match_brute_force(documento):
    rows = quality_rows(2, 90)
    docs = documento(rows, qualidade=T.IntegerType(), arquivo_origem=T.StringType())
    got = {r["id"]: r for r in Q.classify_quality(docs.drop("qualidade"), Q.train_quality(docs, docs.select("id", "qualidade"))).collect()}
    p = {i: got[i]["evidencia"] for i, *_ in rows}
    host = {i: o.split("/")[0] for i, _, _, o in rows}
    folder = {i: o.rsplit("/", 1)[0] for i, _, _, o in rows}

    def moments(key):
        groups = {}
        for i, k in key.items():
            groups.setdefault(k, []).append(p[i])
        n = len(p)
        m = sum(p.values()) / n
        between = sum(sum(g) ** 2 / len(g) for g in groups.values()) / n - m * m - m * (1 - m) * len(groups) / n
        return groups, m, min(max(m * (1 - m) / max(between, m * (1 - m) * 1e-4) - 1, 1), 10_000)

    hosts, m, kh = moments(host)
    folders, _, kf = moments(folder)
    for i in p:
        h = (sum(hosts[host[i]]) - p[i] + kh * m) / (len(hosts[host[i]]) - 1 + kh)
        f = (sum(folders[folder[i]]) - p[i] + kf * h) / (len(folders[folder[i]]) - 1 + kf)
        odds = p[i] / (1 - p[i]) * (f / (1 - f)) / (m / (1 - m))
        assert got[i]["hospedeiro"] == pytest.approx(h) and got[i]["pasta"] == pytest.approx(f)
        assert got[i]["nota"] == pytest.approx(odds / (1 + odds), abs=1e-6)


def test_quality_edge_cases(documento):
    rows = [("a", None, None, None), ("a", None, None, None), (None, "x" * 100_000, 1, "s/p/1")]
    docs = documento(rows, qualidade=T.IntegerType(), arquivo_origem=T.StringType())
    model = Q.train_quality(docs, docs.select("id", "qualidade"))
    out = Q.classify_quality(docs, model).collect()
    assert len(out) == 3 and all(0 <= r["nota"] <= 1 for r in out)
    assert Q.classify_quality(docs.limit(0), Q.train_quality(docs.limit(0), docs.limit(0))).count() == 0


def toxic_texts(seed, n):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = sentence(rng, rng.choice(["en", "fr"]), rng.randint(5, 120)).split()
        bad = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["canalha", "imbecil", "verme", "Canalha!"]))
        texts.append(" ".join(words).encode())
        labels.append(float(bad))
    return texts, np.array(labels)


def test_gradients_match_finite_differences():
    model = X.ToxicityModel.fresh(1)
    x = X.prepare([t for t in toxic_texts(1, 4)[0]])
    model.weights["words"][x.slot] = np.random.default_rng(0).normal(0, 0.3, (len(x.slot), X.WIDTH))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    vectors = model.embed(x).astype(np.float64)
    place, length = model._places(x, np.arange(min(len(x.start), 5)))
    label = np.array([0.0, 1, 0, 1, 1])[: place.shape[1]]
    _, g, d_vectors = model.gradients(vectors, place, length, label)
    rng = np.random.default_rng(2)

    def loss(v):
        return model.gradients(v, place, length, label)[0]

    for name in ("inf", "recf", "recb", "biasb", "attend", "query", "out", "base"):
        w = model.weights[name]
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in w.shape)
            old = w[at]
            w[at] = old + 1e-3
            up = loss(vectors)
            w[at] = old - 1e-3
            down = loss(vectors)
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name
    for _ in range(5):
        at = (int(place[0, 0]), int(rng.integers(0, vectors.shape[1])))
        change = np.zeros_like(vectors)
        change[at] = 1e-3
        assert d_vectors[at] == pytest.approx((loss(vectors + change) - loss(vectors - change)) / 2e-3, rel=0.05, abs=2e-4)


def test_toxicity_finds_held_out_texts_and_leaves_clean_ones():
    texts, labels = toxic_texts(5, 500)
    model = X.fit(texts[:350], labels[:350], labels.mean())
    score = model.score(texts[350:])
    flagged = score >= 0.7
    assert flagged[labels[350:] == 1].mean() > 0.9 and flagged[labels[350:] == 0].mean() < 0.05


def test_windows_cover_every_word_and_overlap():
    x = X.prepare([b"", b"a b", b" ".join(b"w%d" % i for i in range(100))])
    assert np.diff(x.first_window).tolist() == [0, 1, 8]
    covered = set()
    for s, n in zip(x.start[1:].tolist(), x.length[1:].tolist()):
        covered |= set(range(s, s + n))
    assert covered == set(range(2, 102)) and (np.diff(x.start[1:]) <= X.STRIDE).all()


def test_toxicity_edge_cases(documento):
    texts, labels = toxic_texts(6, 120)
    rows = [(str(i), t.decode(), int(y)) for i, (t, y) in enumerate(zip(texts, labels))]
    learning = documento(rows, toxico=T.IntegerType())
    model = X.train_toxicity(learning, learning.select("id", "toxico"))
    edge = [("a", None, 9), ("a", None, 9), (None, "", 9), ("b", "!!", 9), ("c", "verme " * 20_000, 9)]
    docs = documento(edge, toxico=T.IntegerType())
    out = X.score_toxicity(docs, model).collect()
    assert len({round(r["toxicidade"], 9) for r in out if r["id"] != "c"}) == 1
    assert all(0 <= r["toxicidade"] <= 1 and r["toxico"] == int(r["toxicidade"] >= 0.7) for r in out)
    assert X.score_toxicity(docs.limit(0), X.train_toxicity(docs.limit(0), docs.limit(0))).count() == 0


def test_byte_runs_of_a_few_texts_at_a_time():
    import tracemalloc

    random = np.random.default_rng(3)
    texts = [" ".join(f"w{k:06d}" for k in random.integers(0, 40_000, 2_000)).encode() for _ in range(120)]
    labels = (np.arange(len(texts)) % 2).astype(np.float64)
    x = X.prepare(texts)
    pairs = np.unique(np.repeat(np.arange(len(texts)), 2_000) * len(x.slot) + x.stream)
    doc, word = pairs // len(x.slot), pairs % len(x.slot)
    tracemalloc.start()
    odds = X._gram_odds(x, doc, word, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    seen, bad = np.zeros(1 << X.GRAM_BITS), np.zeros(1 << X.GRAM_BITS)
    for t in range(len(texts)):
        own = np.unique(np.concatenate([x.gram[x.gram_first[w] : x.gram_first[w + 1]] for w in word[doc == t]]))
        seen[own] += 1
        bad[own] += labels[t]
    want = np.where(seen < 5, 0, np.log((bad + 2) / (seen - bad + 2)))
    assert np.allclose(odds, want)
