"""Composed steps of a build that fail closed, and a migration that is cut off at each phase."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import composed as C
from quernstone.operators.contracts import ContractError
from quernstone.sources.migration import PHASES, Migration
from quernstone.sources.snapshots import open_current, publish


def test_national_gate(spark):
    df = spark.createDataFrame([("01a", "A", 3), ("01b", "A", 4), ("02a", "B", 1), ("02b", "B", None), ("03a", None, 2)], "k string, st string, w long")
    own = F.create_map(F.lit("01"), F.lit("A"), F.lit("02"), F.lit("B"))[F.left("k", F.lit(2))]
    none = spark.createDataFrame([], "state string, blocks bigint, population bigint, keys_sha256 string")
    found = {r.state: r for r in C.national_gate(df, none, "k", "st", "w", own).collect()}
    assert {s: (r.blocks, r.population, r.status) for s, r in found.items()} == {"A": (2, 7, "unexpected"), "B": (2, 1, "unexpected"), None: (1, 2, "unexpected")}
    again = {r.state: r.keys_sha256 for r in C.national_gate(df.repartition(3).orderBy(F.desc("k")), none, "k", "st", "w", own).collect()}
    assert again == {s: r.keys_sha256 for s, r in found.items()}  # in any order
    want = spark.createDataFrame([("A", 2, 7, again["A"]), ("B", 2, 1, None), ("C", 1, 1, None)], none.schema)
    gate = C.national_gate(df, want, "k", "st", "w", own)
    assert {r.state: r.status for r in gate.collect()} == {"A": "complete", "B": "null_weight", "C": "missing", None: "unexpected"}
    with pytest.raises(ContractError):
        C.assert_national(gate)
    C.assert_national(gate.where("state = 'A'"))


def test_changed_codes_fail_closed(spark):
    frame = spark.createDataFrame([("09N001", "CT"), ("09N002", "CT"), ("10N001", "DE")], "k string, st string")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v double, status string, coverage double")
    good = rows(("09O001", 1.0, "complete", 1.0), ("09O002", 2.0, "partial", 0.9), ("10N001", 3.0, "complete", 1.0))
    empty = F.col("v").isNull()
    mapped = C.reconciled_release(frame, good, "k", "st", "CT", "09", 3, None, empty)
    assert {r.k: r.v for r in mapped.collect()} == {"09N001": 1.0, "09N002": 2.0, "10N001": 3.0}
    zero = rows(("09O003", None, "zero_population", 0.0))
    for bad, allowed in ((good.where("k <> '09O002'"), None), (good.unionByName(zero), None), (good.unionByName(rows(("09P001", 5.0, "x", 1.0))), None), (good, zero), (good.unionByName(rows(("09O003", 7.0, "x", 1.0))), zero)):
        with pytest.raises(ContractError):
            C.reconciled_release(frame, bad, "k", "st", "CT", "09", 3, allowed, empty)
    assert C.reconciled_release(frame.where("st = 'DE'"), good, "k", "st", "CT", "09", 3, None, empty) is good
    out = {r.k: (r.v, r.status, r.coverage) for r in C.attach_release(frame, mapped.where("k <> '10N001'"), "k", F.col("st") == "CT", {"v": "double"}, "status", "coverage").collect()}
    assert out == {"09N001": (1.0, "complete", 1.0), "09N002": (2.0, "partial", 0.9), "10N001": (None, "outside_scope", 0.0)}
    with pytest.raises(ContractError):
        C.attach_release(frame, good, "k", F.lit(True), {"v": "double"}, "status", "coverage")
    assert {r.status for r in C.attach_release(frame, None, "k", F.col("st") == "CT", {"v": "double"}, "status", "coverage").collect()} == {"unavailable", "outside_scope"}


def test_sidecar_fails_closed(spark):
    ids = spark.createDataFrame([("01001", "a", "AL"), ("09001", "c", "CT"), ("72001", "p", "PR")], "place_id string, name string, state string")
    bundle = spark.createDataFrame([("01001", 0.5, 0.4), ("09001", None, 0.2)], "county_fips string, u_rpp double, u_property_tax double")
    market = spark.createDataFrame([("01001", 9, 1.0, 2.0, 150.0), ("09001", 8, 1.0, 2.0, 150.0)], "county_fips string, housing_valid_months int, median_active_listings double, median_ppsf double, area double")
    knots = [(100.0, 0.0), (200.0, 1.0)]
    got = {r.place_id: (r.u_housing, r.u_affordability) for r in C.ranking_sidecar(ids, bundle, market, knots, ["01"]).collect()}
    assert got["01001"] == (0.5, pytest.approx(0.45 * 0.5 + 0.35 * 0.5 + 0.2 * 0.4)) and got["09001"] == (None, None) and set(got) == {"01001", "09001"}
    assert {r.u_housing for r in C.ranking_sidecar(ids, bundle, None, knots, ["01"]).collect()} == {None}
    for gone in ("09001", "01001"):
        with pytest.raises(ContractError):
            C.ranking_sidecar(ids, bundle.where(f"county_fips <> '{gone}'"), market, knots, ["01"])
    with pytest.raises(ContractError):
        C.ranking_sidecar(ids, bundle, market.unionAll(market), knots, ["01"])


def moved(spark, root, fail=None, wrong=False):
    def make(tables):
        if fail == "make":
            raise OSError("no space")
        return {"t": (tables["t"].withColumn("v", F.col("v") * 10 + int(wrong)), ["k"])}

    def check(old, new):
        if fail == "check":
            raise OSError("lost")
        if not new["t"].select("k", (F.col("v") / 10).cast("long").alias("v"), (F.col("v") % 10).alias("r")).where("r = 0").drop("r").exceptAll(old["t"]).isEmpty() or new["t"].where("v % 10 <> 0").count():
            raise ContractError("values differ")

    return Migration(spark, root, "tenfold", ["t"], make, check)


@pytest.mark.parametrize("phase", PHASES)
def test_migration_goes_on_behind_each_phase(spark, tmp_path, monkeypatch, phase):
    root = f"file://{tmp_path}/root"
    build = publish(spark, root, {"t": (spark.range(9).select(F.col("id").alias("k"), F.col("id").alias("v")), ["k"])}, {"v": "1"})
    values = lambda: sorted(r.v for r in open_current(spark, root, "t").collect())
    stop = moved(spark, root)
    enter = stop._enter

    def entered(name, entry):
        got = enter(name, entry)
        if name == phase:
            raise KeyboardInterrupt
        return got

    stop._enter = entered
    with pytest.raises(KeyboardInterrupt):
        stop.run()
    assert stop.journal()["phase"] == phase
    assert values() == [10 * k for k in range(9)] if phase == "switched" else values() == list(range(9))
    if phase == "written":  # what is left of the new build is checked against the journal
        for f in (tmp_path / "root").glob("migration-tenfold/*/t.parquet/part*"):
            keep = f.read_bytes()
            f.unlink()
            with pytest.raises(Exception):  # noqa: B017, PT011
                moved(spark, root).run()
            f.write_bytes(keep)
            break
        assert values() == list(range(9))
    to = moved(spark, root).run()
    assert values() == [10 * k for k in range(9)] and moved(spark, root).run() == to
    assert moved(spark, root).rollback() == build and values() == list(range(9)) and moved(spark, root).journal() is None
    assert not list((tmp_path / "root").glob("migration-*"))


def test_migration_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    publish(spark, root, {"t": (spark.range(9).select(F.col("id").alias("k"), F.col("id").alias("v")), ["k"])}, {"v": "1"})
    with pytest.raises(ContractError):
        moved(spark, root, wrong=True).run()
    assert moved(spark, root).journal()["phase"] == "written" and open_current(spark, root, "t").agg(F.max("v")).first()[0] == 8
    moved(spark, root).rollback()
    for fail in ("make", "check"):
        with pytest.raises(OSError):
            moved(spark, root, fail).run()
    publish(spark, root, {"t": (spark.range(3).select(F.col("id").alias("k"), F.col("id").alias("v")), ["k"])}, {"v": "2"})
    with pytest.raises(ContractError):  # another build was published meanwhile
        moved(spark, root).run()
    assert json.loads((tmp_path / "root" / "current.json").read_text())["build"]
