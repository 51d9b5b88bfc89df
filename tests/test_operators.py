import io
import json
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import scalars as S
from quernstone.operators import aggregates as A
from quernstone.operators import contracts as C
from quernstone.operators import enrich as E
from quernstone.operators import ranks as R
from quernstone.operators import raster as G
from quernstone.operators import scores as P
from quernstone.sources import readers, snapshots
from quernstone.sources.store import AmbiguousError, Page, Store


def test_rank_edges(spark):
    one = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    assert {r.k: r.p for r in R.average_tie_percentile(one, "v", "p").collect()} == {1: 0.0, 2: None}
    assert {r.k: r.p for r in R.ecdf(one, "v", "p").collect()} == {1: 1.0, 2: None}
    assert R.ecdf(one.where("k = 3"), "v", "p").collect() == []
    ties = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.0), (4, 2.0)], "k int, v double")
    assert [r.p for r in R.average_tie_percentile(ties, "v", "p", force_zero=True).orderBy("k").collect()] == [0, 0, pytest.approx(200 / 3), 100]
    assert [r.p for r in R.competition_rank(ties, "v", "p").orderBy("k").collect()] == [3, 3, 2, 1]
    w = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0), (3, 1.5, 0.0), (4, 9.0, None)], "k int, v double, w double")
    assert [r.p for r in R.weighted_lower_percentile(w, "v", "w", "p").orderBy("k").collect()] == [0.0, 50.0, 50.0, 100.0]


def test_running_sums_equal_sorted_sums(spark):
    rows = [(float((k * 7919) % 1009), k % 5 + 1) for k in range(1009)]
    got = R.running_sums(spark.createDataFrame(rows, "v double, n long"), "v", {"upto": "n"}, buckets=8).orderBy("v").collect()
    want = np.cumsum([n for _, n in sorted(rows)])
    assert [r.upto for r in got] == want.tolist() and got[0].upto_all == want[-1]


def test_pareto_brute(spark):
    rng = np.random.default_rng(1)
    pts = rng.integers(0, 6, (60, 3)).astype(float)
    got = R.pareto_flags(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "k int, a double, b double, c double"), "k", ["a", "b", "c"])
    for r in got.collect():
        p = pts[r.k]
        assert r.pareto == (not any((q >= p).all() and (q > p).any() for q in pts))


def test_contracts(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, s string")
    with pytest.raises(C.ContractError):
        C.assert_unique(df, ["s"])
    with pytest.raises(C.ContractError, match="negative"):
        C.assert_none(df, {"fine": F.col("k") > 9, "negative": F.col("s").isNull()})
    with pytest.raises(C.ContractError):
        C.join_preserving(df, df.withColumnRenamed("s", "x").union(df), ["k"])
    C.assert_schema(df, df.schema)
    C.assert_same_multiset(df, df.orderBy(F.desc("k")))
    with pytest.raises(C.ContractError):
        C.assert_same_multiset(df, df.union(df))
    assert C.logical_digest(df, ["k"]) == C.logical_digest(df.repartition(3), ["k"]) != C.logical_digest(df.where("k > 1"), ["k"])
    out, said = C.fail_open(df, {"x": (lambda b: (_ for _ in ()).throw(C.ContractError("no")), {"extra": "double"})})
    assert out.columns == ["k", "s", "extra"] and said == {"x": "no"}


def test_enrich(spark):
    a = spark.createDataFrame([("x0001",), ("y0002",)], "a string")
    b = spark.createDataFrame([("z0001",)], "b string")
    got, gone = E.reconcile_codes(a, b, F.right("a", F.lit(4)), F.right("b", F.lit(4)))
    assert [tuple(r) for r in got.collect()] == [("x0001", "z0001")] and [r.a for r in gone.collect()] == ["y0002"]
    with pytest.raises(C.ContractError):
        E.reconcile_codes(a, b, F.right("a", F.lit(4)), F.right("b", F.lit(4)), allowed_missing=["0009"])


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=1), st.integers(1, 999))
@settings(max_examples=8, deadline=None)
def test_half_even_quotient(spark, tops, below):
    from fractions import Fraction

    got = spark.createDataFrame([(tops[0], below)], "t long, b long").select(A.half_even_quotient(F.col("t"), F.col("b"))).first()[0]
    assert got == round(Fraction(tops[0], below))


def test_scalars(spark):
    assert S.window_cells(5000, 250) == 35 and S.window_cells(1, 250) == 1
    r = spark.range(1).select(S.zfill(F.lit("123456"), 5), S.zfill(F.lit("7"), 5), S.half_even(F.lit(1.015), 2), S.finite(F.lit(float("nan")))).first()
    assert tuple(r) == ("123456", "00007", 1.01, None)
    with pytest.raises(ValueError):
        P.evaluate(spark.range(1), "id", {"id": 0.5}, [], [], [])


def test_rasters_against_brute_force():
    rng = np.random.default_rng(3)
    a = rng.normal(0, 100, (17, 13))
    a[2, 3] = a[10, 4] = np.nan
    for size in (1, 3, 7):
        r = size // 2
        box, rel = G.box_sum(np.nan_to_num(a), size), G.relief(a, size)
        for i in range(17):
            for j in range(13):
                w = a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]
                assert box[i, j] == pytest.approx(np.nansum(w))
                assert np.isnan(w).all() or rel[i, j] == pytest.approx(np.nanmax(w) - np.nanmin(w))
    assert np.isfinite(G.fill_nearest(a)).all()


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;v;n\n01;(NA);é\n02; 3.5 ;b\n".encode("windows-1252"))
    got = readers.read_text_table(spark, str(tmp_path / "a.csv"), {"id": "string", "v": "double", "n": "string"}, nulls=("(NA)", ""), sep=";", encoding="windows-1252").collect()
    assert [tuple(r) for r in got] == [("01", None, "é"), ("02", 3.5, "b")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/data.csv", "a,b\n1,2\n")
        z.writestr("readme.txt", "no")
    assert [tuple(r) for r in readers.read_zip_csv(spark, str(tmp_path / "b.zip"), "data.csv", ["b", "a"]).collect()] == [("2", "1")]
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as tar:
        data = b"a,b\n1,2\n3,4\n"
        info = tarfile.TarInfo("s.csv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert readers.read_tar_csv(spark, str(tmp_path / "c.tar.gz"), ["a"]).count() == 2
    head = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 1, 32 + 32 + 1, 1 + 4) + b"CODE\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([4]) + b"\0" * 15 + b"\r"
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.dbf", head + b" 0042")
    assert [r.CODE for r in readers.read_dbf_zip(spark, str(tmp_path / "d.zip"), ["CODE"]).collect()] == ["0042"]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2"><v>8</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_xlsx(spark, str(tmp_path / "e.xlsx"), ["id", "v"]).collect()] == [("7", "8")]
    (tmp_path / "f.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    assert readers.read_json_rows(spark, str(tmp_path / "f.json"), "a: int").count() == 2
    (tmp_path / "g.json").write_text(json.dumps({"ori": "X", "s": {"03-2025": 4.0}}))
    assert tuple(readers.read_json_series(spark, str(tmp_path / "g.json"), "ori", "s").first()) == ("X", "2025-03", 4.0)
    np.save(tmp_path / "t1.npy", np.arange(6).reshape(2, 3))
    r = readers.read_npy_tiles(spark, str(tmp_path)).first()
    assert (r.tile, r.rows, r.cols, r["values"]) == ("t1", 2, 3, [0, 1, 2, 3, 4, 5])


def test_snapshots_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ada", 2.0), (2, "ada", None), (3, "Bo", 5.0)], "k int, name string, score double")
    root = f"file://{tmp_path}/snap"
    build = snapshots.publish(spark, root, {"places": (df, ["k"])}, {"src": "abc"})
    assert build == snapshots.publish(spark, root, {"places": (df, ["k"])}, {"src": "abc"})
    s = Store(snapshots.open_current(spark, root, "places"), "k", "name", {"score": "score"})
    assert [r.k for r in s.list(Page("score")).collect()] == [3, 1] and s.total(Page("score", include_unranked=True)) == 3
    assert s.resolve("bo") == 3 and s.resolve("none") is None and s.detail(3)["score"] == 5.0
    with pytest.raises(AmbiguousError):
        s.resolve("ADA")
    with pytest.raises(ValueError):
        s.list(Page("name"))
    with pytest.raises(ValueError):
        s.list(Page("score", bounds={"score": (2.0, 1.0)}))
    assert json.loads("".join(snapshots.json_array(df.orderBy("k"))))[1] == {"k": 2, "name": "ada", "score": None}
    assert "".join(snapshots.csv_chunks(df, 2)).count("\n") == 4
    for kind in ("parquet", "csv", "json"):
        snapshots.export(df, f"{tmp_path}/out-{kind}", kind, ["k"])
    both = snapshots.replace_by_key(df.select("k", "name"), spark.createDataFrame([(2, 9.0)], "k int, score double"), "k")
    assert both.count() == 3 and both.columns == ["k", "name", "score"]


def test_stream_equals_batch(spark, tmp_path):
    from quernstone.streaming.windows import windowed_counts

    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(f"{tmp_path}/in")
    q = windowed_counts(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "ts", "kind", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed_counts(e, "ts", "kind", "v").collect()))
