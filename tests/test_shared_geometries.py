"""Parcels, polygons and parts that share one geometry: none is lost, none is multiplied on the way."""

import datetime as dt

import pytest

from plotproof.queries import load
from plotproof.streaming import watch as W


@pytest.fixture
def parts(spark, tmp_path):
    rows = [(p + k * 20000, f"n{p}", f"b{p}", "ECONOMY", 7, 1.0) for p in range(6) for k in (0, 1, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_circle_areas_of_parts_in_one_place(spark, parts):
    found = load().QUERIES["spatial_circle_areas"](spark, parts).collect()
    assert sorted(r["p"] for r in found) == sorted(p + k * 20000 for p in range(6) for k in (0, 1, 3))


def square(x):
    return f"POLYGON (({x} 0, {x + 0.001} 0, {x + 0.001} 0.001, {x} 0.001, {x} 0))"


def test_reaction_and_links_with_shared_geometries(spark):
    talhao = spark.createDataFrame([("1", "a", square(0)), ("2", "b", square(0)), ("3", "c", square(1)), ("4", "d", None)], "id string, nome string, geom_wkt string")
    change = spark.createDataFrame(
        [("k1", square(0.002), "novo"), ("k2", square(0.002), "novo"), ("k3", square(5), "sumido")], "chave string, geom_wkt string, mudanca string"
    )
    links = spark.createDataFrame([("k3", "3"), ("k9", "4")], "chave string, talhao_id string")
    parcels, fresh = W.react(talhao, change, links, "plane")
    assert sorted(r[0] for r in parcels.collect()) == ["1", "2", "3"]
    assert sorted(map(tuple, fresh.collect())) == [("k1", "1"), ("k1", "2"), ("k2", "1"), ("k2", "2")]


def test_recheck_finds_its_parcels_once(spark, monkeypatch):
    """The affected parcels are computed when they are written, not again by each check that reads them."""
    from plotproof.plans import checks
    from plotproof.plans.context import Context
    from plotproof.schemas import TABLES, conform

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    none = {n: spark.createDataFrame([], TABLES[n]) for n in ("produtor", "documento", "lote")}
    talhao = conform(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, nome string"), "talhao")
    ctx = Context(**none, talhao=talhao, lote_talhao=None, embargo=None, alerta=None, protegida=None, lista_suja=None, as_of=dt.date(2025, 1, 2))
    monkeypatch.setattr(checks, "verify", lambda c: c.talhao)
    parcels = spark.createDataFrame([("2",)], "talhao_id string").mapInArrow(counted, "talhao_id string")
    out = W.recheck_parcels(ctx, parcels)
    assert [r["id"] for r in out.collect()] == ["2"] and out.count() == 1
    assert runs.value == 1
