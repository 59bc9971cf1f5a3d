"""The pipeline on a small folder of tables against a plain Python version of every stage."""

import random
import re

import pyarrow as pa
import pytest
from test_decontamination import brute as brute_hits
from test_line_dedup import brute as brute_lines
from test_packing import PATH, check
from test_quality_rules import brute as brute_measures
from test_similar_texts import check_kept
from tokenizers import Tokenizer

import corpus_pipeline


def documents(rng):
    def prose(n):
        return "\n".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12)) for _ in range(n))

    texts = [prose(rng.randint(2, 9)) for _ in range(40)]
    texts += texts[:6]  # exact copies
    texts += [t.replace(t.split()[20], "trocada", 1) for t in texts[6:12]]  # near copies
    texts += [texts[12] + "\n" + prose(4), prose(3) + "\n" + texts[13]]  # shared lines
    texts += [None, "", "curto demais", "repete a mesma frase sempre " * 30]
    rows = [(i * 3 % 101, t, rng.choice(["pt", None]), "src", -1) for i, t in enumerate(texts)]
    return rows, [(1, " ".join(texts[15].split()[4:40])), (2, "nada disso aparece em lugar nenhum do conjunto de textos aqui")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows, items = documents(random.Random(8))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows, items


def stage_matches(name, before, after, items):
    """Rows (id, text) of a stage against plain Python over the rows it was given."""
    if name == "quality_rules":  # too few labels for any cutoff
        want = [(i, t) for i, t in before if not brute_measures(t)[-1]]
    elif name == "line_dedup":
        want = [(i, new) for (i, _), (new, _, _) in zip(before, brute_lines(before))]
    elif name == "decontamination":
        want = [row for row, (_, hit, _) in zip(before, brute_hits([t for _, t in before], items, 10)) if not hit]
    else:
        check_kept(before, after, 5, 0.8)
        return
    assert sorted(after) == sorted(want), name


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_every_stage_matches_brute_force(spark, folder, tmp_path):
    root, rows, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    sizes, before = [len(rows)], [(i, t) for i, t, *_ in rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, root).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = pairs(docs)
        stage_matches(name, before, after, items)
        assert all(r["n_chars"] == len(r["text"]) and r["source"] == "src" for r in docs.collect())
        before = after
        sizes.append(len(after))
    assert len(set(sizes)) == 4  # all stages but line dedup drop rows
    encode = Tokenizer.from_file(PATH).encode
    encoded = {i: encode(t, add_special_tokens=False).ids + [2] for i, t in before}
    pieces = [
        {"id": r["doc_id"], "inicio": r["start"], "comprimento": r["length"], "crc32": r["ids_crc32"],
         "n_tokens": r["doc_tokens"], "sequencia": r["sequence_id"], "posicao": r["offset"]}
        for r in corpus_pipeline.packing_stage(spark, docs, root).collect()
    ]
    check(pieces, encoded, 4096)


def test_run_gives_the_last_stage(spark, folder):
    root, rows, _ = folder
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows}


def test_python_workers_hold_few_rows_and_words_at_once(spark, folder, monkeypatch):
    root, name = folder[0], "spark.sql.execution.arrow.maxRecordsPerBatch"
    given, seen, sizes = spark.conf.get(name), [], []

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(name)))
        many = spark.range(0, 5000, 1, 1)
        return many.mapInArrow(lambda rows: (pa.record_batch({"n": [b.num_rows]}) for b in rows), "n long")

    def packed(docs, lembradas):
        sizes.append(lembradas)
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("lotes", stage)])
    assert max(r["n"] for r in corpus_pipeline.run(spark, root).collect()) <= corpus_pipeline.BATCH_ROWS
    assert seen == [corpus_pipeline.BATCH_ROWS] and spark.conf.get(name) == given
    monkeypatch.setattr(corpus_pipeline.Q, "packed", packed)
    corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    assert sizes[0] < corpus_pipeline.packing.REMEMBERED


def test_columns_that_clash_with_names_of_the_operators_come_through(spark, folder, tmp_path):
    root, _, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(12)
    clashing = ("id", "texto", "idioma", "mantido", "n_palavras", "contaminado", "linha", "n", "_resto", "n_removidas")
    for name in clashing:
        docs = docs.selectExpr("*", f"'{name}' as {name}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, root).write.parquet(str(tmp_path / f"clash-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"clash-{name}"))
        assert all(r[c] == c for r in docs.collect() for c in clashing), name


def test_empty_table_and_repeated_rows(spark, folder, tmp_path):
    root, rows, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    twice = docs.unionByName(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, twice, root).write.parquet(str(tmp_path / f"twice-{name}"))
        twice = spark.read.parquet(str(tmp_path / f"twice-{name}"))
    assert {r["doc_id"] for r in twice.select("doc_id").collect()} <= {r[0] for r in rows}
    assert twice.count() == corpus_pipeline.run(spark, root).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), root).count() == 0


def test_entry_registers_every_operator():
    import __spark_entry__ as entry

    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()
