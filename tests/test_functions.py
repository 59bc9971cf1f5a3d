import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plotproof.functions import dates, extract, geometry as G, numbers, report, text
from plotproof.functions.predicates import measure


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [
    ("1.234,56", 1234.56), ("12,5", 12.5), ("12.5", 12.5), ("R$ 3", 3.0), ("1-2", None), ("abc", None), ("", None), (None, None),
])
def test_lenient_number(spark, raw, want):
    assert one(spark, raw, numbers.lenient_number) == want


@pytest.mark.parametrize("raw, want", [
    ("2020-01-05", dt.date(2020, 1, 5)), ("05/01/2020", dt.date(2020, 1, 5)), ("2020-01-05T10:11:12", dt.date(2020, 1, 5)),
    ("2020/01/05", dt.date(2020, 1, 5)), ("05-01-2020", dt.date(2020, 1, 5)), ("31/02/2020", None), ("x", None), (None, None),
])
def test_lenient_date(spark, raw, want):
    assert one(spark, raw, dates.lenient_date) == want


def test_fold(spark):
    assert one(spark, "AÇÃO ﬁm ½ Ｆｕｌｌ é", text.fold) == "acao fim 1⁄2 full e"
    assert one(spark, " José  da-Silva 3", text.fold_name) == "jose da silva"
    assert one(spark, "José da Silva!", text.slug) == "jose-da-silva"


def test_keyword_hit(spark):
    df = spark.createDataFrame([("cartorio do CAR nr-31 licença de operação",)], "t string").withColumn("n", text.fold(F.col("t")))
    df = df.withColumn("w", text.words(F.col("n")))
    hit = lambda k: df.select(text.keyword_hit(F.col("n"), F.col("w"), k)).first()[0]
    assert hit("CAR") and hit("NR-31") and hit("licenca de operacao")
    assert not hit("cart") and not hit("R-31") and not hit("")


def test_names_alike(spark):
    df = spark.createDataFrame([("Ana Maria Souza", "ANA SOUZA", "Bia Lima")], "a string, b string, c string")
    row = df.select(text.names_alike(F.col("a"), F.col("b")), text.names_alike(F.col("a"), F.col("c")), text.names_alike(F.col("a"), F.lit(""))).first()
    assert tuple(row) == (True, False, True)


def test_report_helpers(spark):
    assert one(spark, "Frase um. " + "palavra " * 60, lambda c: report.shorten(c, 40)) == "Frase um. palavra palavra palavra […]"
    assert one(spark, '{"a": 1, "b": "x"}', report.evidence_line) == "a = 1; b = x"
    assert one(spark, "nada", report.evidence_line) == "nada"
    assert one(spark, 1234567.5, numbers.format_br, "double") == "1.234.567,50"
    with pytest.raises(Exception, match="needs its date"):
        s = F.lit("x")
        spark.range(1).select(report.sentence(s, s, F.lit(None).cast("date"), s, s)).collect()


def test_wkt(spark):
    hole = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    assert one(spark, hole, lambda c: G.area(G.parse_wkt(c))) == 15.0
    assert one(spark, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", lambda c: G.area(G.parse_wkt(c))) == 1.0
    assert one(spark, "POINT (1.5 -2)", lambda c: G.to_wkt(G.parse_wkt(c))) == "POINT (1.5 -2.0)"
    for bad in ("POLYGON ((0 0, 1 1))", "POLYGON EMPTY", "POINT (a 1)", "", None):
        assert one(spark, bad, G.parse_wkt) is None
    assert one(spark, "POINT (-54.1234 -3.5)", G.min_decimals) == 1
    row = one(spark, hole, lambda c: G.centroid(G.parse_wkt(c)))
    assert (row["x"], row["y"]) == (2.0, 2.0)


def test_utm_known_points(spark):
    # On the central meridian easting is 500 km; one minute of latitude there is close to 1843 m times the scale factor.
    fn = lambda c: G.utm22s(F.lit(-51.0), c)
    a, b = one(spark, 0.0, fn, "double"), one(spark, -1 / 60, fn, "double")
    assert a["x"] == pytest.approx(500000) and a["y"] == pytest.approx(10000000)
    assert a["y"] - b["y"] == pytest.approx(1842.9 * 0.9996, abs=0.1)
    # The classic truncated series for the same ellipsoid, as an independent value.
    for lon, lat in ((-54.0, -3.0), (-50.0, -7.5), (-52.64, -3.07)):
        f = 1 / 298.257222101
        e2 = f * (2 - f)
        ep2, p, dl = e2 / (1 - e2), math.radians(lat), math.radians(lon + 51)
        n, t, c, q = 6378137 / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep2 * math.cos(p) ** 2, math.cos(p) * dl
        m = 6378137 * (
            (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p)
            + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
        x = 0.9996 * n * (q + (1 - t + c) * q**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * q**5 / 120) + 500000
        y = 1e7 + 0.9996 * (m + n * math.tan(p) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * q**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * q**6 / 720))
        got = spark.range(1).select(G.utm22s(F.lit(lon), F.lit(lat)).alias("r")).first()["r"]
        assert got["x"] == pytest.approx(x, abs=0.01) and got["y"] == pytest.approx(y, abs=0.01)


def square(x, y, s):
    return [x, x + s, x + s, x, x], [y, y, y + s, y + s, y], [5]


def test_measures():
    a = square(0, 0, 2)
    assert measure(*a, *square(1, 1, 2)) == (True, pytest.approx(1.0), 0.0)
    assert measure(*a, *square(0, 0, 2))[1] == pytest.approx(4.0)
    hit, area, dist = measure(*a, *square(5, 6, 1))
    assert not hit and area == 0 and dist == pytest.approx(5.0)
    assert measure(*a, *square(2, 0, 1))[0] is True
    ring = ([0, 9, 9, 0, 0, 3, 3, 6, 6, 3], [0, 0, 9, 9, 0, 3, 6, 6, 3, 3], [5, -5])
    assert measure(*ring, *square(4, 4, 1)) == (False, 0.0, pytest.approx(1.0))
    twice = (square(0, 0, 2)[0] + square(1, 0, 2)[0], square(0, 0, 2)[1] + square(1, 0, 2)[1], [5, 5])
    assert measure(*twice, *square(-1, -1, 9))[1] == pytest.approx(6.0)
    assert measure([1], [1], [1], *a) == (True, 0.0, 0.0)


def test_measure_properties():
    hyp = pytest.importorskip("hypothesis")
    from hypothesis import strategies as st

    num = st.integers(-20, 20)

    @hyp.settings(max_examples=60, deadline=None)
    @hyp.given(num, num, st.integers(1, 9), num, num, st.integers(1, 9))
    def check(x, y, s, u, v, r):
        a, b = square(x, y, s), square(u, v, r)
        ab, ba = measure(*a, *b), measure(*b, *a)
        assert ab[0] == ba[0] and math.isclose(ab[1], ba[1], abs_tol=1e-9) and math.isclose(ab[2], ba[2], abs_tol=1e-9)
        w, h = min(x + s, u + r) - max(x, u), min(y + s, v + r) - max(y, v)
        assert math.isclose(ab[1], max(w, 0) * max(h, 0), abs_tol=1e-9)
        assert ab[0] == (w >= 0 and h >= 0) and (ab[2] == 0) == ab[0]

    check()


KEY = "15" + "2405" + "000" + "12345678901" + "55" + "920" + "000000123" + "1" + "00000001" + "0"


def test_invoice(spark):
    def fields(t):
        return one(spark, t, lambda c: extract.invoice(c, extract.lines_of(c)))

    row = fields(f"Chave {KEY}\nCFOP: 6102")
    assert row["cpf_emitente"] == "123.456.789-01" and row["serie"] == "920" and row["numero_nf"] == "123"
    assert row["emitente_pessoa_fisica"] and row["serie_produtor_pf"] and row["elo"] == "intermediario"
    spaced = " ".join(KEY[i : i + 4] for i in range(0, 44, 4))
    assert fields("n " + spaced)["chave_acesso"] == KEY
    paper = fields("Modelo 4 Série 1\nnatureza cfop venda 5101")
    assert paper["chave_acesso_ausente"] and paper["nota_modelo_4"] and paper["serie"] == "001" and paper["elo"] == "produtor"


def test_labelled_fields(spark):
    t = "Titular:\nProprietário: Ana\nValidade: 01/02/2030\nVigência: 01/01/2020 a 31/12/2021\nÁrea de reserva legal: 3 ha\nÁrea total: 1.234,5 ha"
    lines = lambda c: extract.lines_of(c)
    assert one(spark, t, lambda c: extract.labelled(lines(c), ["Titular", "Proprietario"])) == "Ana"
    assert one(spark, t, lambda c: extract.labelled_date(lines(c), ["Validade"])) == dt.date(2030, 2, 1)
    assert one(spark, t, lambda c: extract.validity(lines(c))[1]) == dt.date(2021, 12, 31)
    assert one(spark, t, lambda c: extract.main_area(extract.areas(lines(c)))) == 1234.5
    assert one(spark, "Quantidade: 8388.0 kg", extract.kilograms) == 8388.0
    assert one(spark, "Quantidade: 8388.0 kg", lambda c: extract.kilograms(c, legacy=True)) == 83880.0
