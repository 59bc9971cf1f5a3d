import random

from pyspark.sql import types as T

from plotproof.llm.line_dedup import dedup_lines


def brute(rows, size=3):
    blank, first, windows = " \t\n\x0b\x0c\r", {}, []
    for id_, text in rows:
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(blank)]
        key = [lines[i].strip(blank) for i in worded]
        found = [(tuple(key[k : k + size]), k) for k in range(len(key) - size + 1)]
        windows.append((lines, worded, found))
        for w, k in found:
            first[w] = min(first.get(w, (id_, k)), (id_, k))
    out = []
    for (id_, _), (lines, worded, found) in zip(rows, windows, strict=True):
        gone = {worded[k + d] for w, k in found if (id_, k) != first[w] for d in range(size)}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(worded), len(gone)))
    return out


def test_matches_brute_force(documento):
    rng = random.Random(2)
    lines = ["Contrato de arrendamento", "  Talhão 7", "", "Nota fiscal 12", "CPF", " \t", "Assinado", "Talhão 7"]
    rows = [(f"d{i:03}", "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(60)]
    rows += [("d900", "a\n" * 3000), ("d901", "x\ny\nz"), ("d902", "x\n\ny\nz\nfim")]
    got = {r["id"]: r for r in dedup_lines(documento(rows)).collect()}
    for (id_, _), want in zip(rows, brute(rows), strict=True):
        assert (got[id_]["texto"], got[id_]["n_linhas"], got[id_]["n_removidas"]) == want


def test_order_of_numeric_ids_and_nulls(documento):
    text = "um\ndois\ntres"
    rows = [(10, text), (9, text), (None, text), (None, None)]
    out = dedup_lines(documento(rows, T.LongType())).collect()
    assert {(r["id"], r["texto"]) for r in out} == {(9, text), (10, ""), (None, ""), (None, None)}


def test_repeated_rows_and_clashing_columns(documento):
    text = "um\ndois\ntres"
    docs = documento([("a", text, 7), ("a", text, 8), ("a", "um\ndois\ntres\nmais", 9)], n_linhas=T.IntegerType())
    out = dedup_lines(docs).collect()
    assert [r["n_removidas"] for r in out] == [0, 0, 0]
    assert docs.columns[:2] == ["id", "texto"] and set(out[0].asDict()) == {"id", "texto", "n_linhas", "n_removidas"}
    assert dedup_lines(docs.limit(0)).count() == 0
