"""Sources, sinks and the store beyond plain reads."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quernstone.operators import contracts as C
from quernstone.operators import enrich as E
from quernstone.sources import readers, snapshots
from quernstone.sources.store import AmbiguousError, Page, Store


def test_extract_member(spark, tmp_path):
    data = b"a,b\n1,2\n" * 300_000
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m.csv", data)
    how = {"archive": str(archive), "member": "m.csv", "target": str(tmp_path / "out" / "m.csv"), "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "archive_sha256": "x"}
    path = readers.extract_member(**how)
    assert open(path, "rb").read() == data
    archive.unlink()
    assert readers.extract_member(**how) == path  # as it was left, without the archive
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(FileNotFoundError):  # changed, so it would be extracted again
        readers.extract_member(**how)
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("m.csv", data)
    assert readers.extract_member(**how) == path and open(path, "rb").read() == data
    for wrong in ({"size": len(data) - 1}, {"sha256": "0"}):
        with pytest.raises(ValueError):
            readers.extract_member(**(how | wrong | {"target": str(tmp_path / "other.csv")}))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.zip", "out"]


def test_charsets_leave_the_session_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;näme;v\n1;“Doña” €;(NA)\n".encode("windows-1252"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    got = readers.read_text_table(spark, str(tmp_path / "a.csv"), {"id": "int", "näme": "string", "v": "double"}, nulls=("(NA)",), sep=";", encoding="windows-1252").collect()
    assert [tuple(r) for r in got] == [(1, "“Doña” €", None)] and spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    with pytest.raises(ValueError, match="missing"):
        readers.read_text_table(spark, str(tmp_path / "a.csv"), {"none": "int"}, sep=";")


def test_members_come_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "CHUNK_ROWS", 7)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/d.csv", "a,b\n" + "".join(f"{k},{k * 2}\n" for k in range(40)))
        z.writestr("y/d.csv", "a,b\n")
    got = readers.read_zip_csv(spark, str(tmp_path / "a.zip"), "x/d.csv", ["b", "a"])
    assert sorted((int(r.a), int(r.b)) for r in got.collect()) == [(k, 2 * k) for k in range(40)]
    for suffix in ("/d.csv", "/none.csv"):
        with pytest.raises(Exception, match="members end with"):
            readers.read_zip_csv(spark, str(tmp_path / "a.zip"), suffix, ["a"]).collect()


def test_parquet_contracts(spark, tmp_path):
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).withColumn("v", F.lit("x")).write.parquet(f"{tmp_path}/{k}")
    assert readers.table_contract(spark, f"{tmp_path}/0") == {"columns": {"id": "bigint", "v": "string"}, "rows": 5}
    assert [r.id for r in readers.sorted_tables(spark, [f"{tmp_path}/1", f"{tmp_path}/0"], ["id"]).collect()] == list(range(10))


def test_publish_swaps_and_retires(spark, tmp_path):
    root, df = f"file://{tmp_path}/s", spark.range(3)
    first = snapshots.publish(spark, root, {"t": (df, ["id"])}, {"v": "1"})
    second = snapshots.publish(spark, root, {"t": (df.where("id > 0"), ["id"])}, {"v": "2"})
    assert snapshots.open_current(spark, root, "t").count() == 2
    assert snapshots.register_views(spark, root)["rows"] == {"t": 2} and spark.table("t").count() == 2
    (tmp_path / "s" / "own").mkdir()
    third = snapshots.publish(spark, root, {"t": (df, ["id"])}, {"v": "3"})
    assert snapshots.retire(spark, root, {second}) == [first]
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {second, third, "own"} and not [p for p in (tmp_path / "s").iterdir() if "tmp" in p.name]


def test_exports_keep_out_of_managed_data(spark, tmp_path):
    for path in (f"{tmp_path}/builds/x", f"file://{tmp_path}/builds", f"{tmp_path}/a/../builds/y"):
        with pytest.raises(ValueError, match="managed"):
            snapshots.export(spark.range(1), path, "csv", ["id"], managed=[f"{tmp_path}/builds"])
    snapshots.export(spark.range(1), f"{tmp_path}/builds2", "csv", ["id"], managed=[f"{tmp_path}/builds"])


def test_fit_table(spark):
    ev = spark.createDataFrame([("b", 0.5, True, None, 2, 2, False), ("a", 0.9, True, None, 1, 1, True), ("c", None, False, "population", None, None, None)], "place_id string, active_value double, eligible boolean, reason string, national_rank long, filtered_rank long, pareto_optimal boolean")
    ca = spark.createDataFrame([(k, k.upper(), "CO", 7) for k in "abc"], "place_id string, name string, state string, population int")
    got = snapshots.fit_table(ev, ca, "place_id", {"weights": {"b": 1, "a": 2}, "notices": ["n"]})
    assert got.columns[-3:] == ["population", "weights_json", "notices_json"] and [(r.place_id, r.weights_json) for r in got.collect()] == [("a", '{"a": 2, "b": 1}'), ("b", '{"a": 2, "b": 1}')]
    assert "".join(snapshots.csv_chunks(got)).count("\n") == 3


def test_store(spark):
    t = spark.createDataFrame([("01", "Lake", "CO", "Ada County", 1.0, 3.0), ("02", "Lake", "UT", "Bo County", 2.0, None), ("03", "Hill", "CO", None, None, 1.0)], "id string, name string, st string, county string, a double, b double")
    s = Store(t, "id", "name", {"a": ("a", True), "b": ("b", False)}, parent="county", state="st")
    assert s.resolve("lake , ut") == "02" and s.resolve("HILL") == "03" and s.resolve("01") == "01" and s.resolve("Lake, NM") is None
    with pytest.raises(AmbiguousError) as e:
        s.resolve("Lake")
    assert e.value.args[0] == [("01", "Lake", "CO"), ("02", "Lake", "UT")]
    ids = lambda p: [r.id for r in s.list(p).collect()]
    assert ids(Page("a")) == ["02", "01"] and ids(Page("b")) == ["03", "01"] and ids(Page("b", descending=True)) == ["01", "03"] and ids(Page("a", include_unranked=True)) == ["02", "01", "03"]
    assert ids(Page("a", query="county")) == ["02", "01"] and ids(Page("a", query="bo c")) == ["02"]
    got = s.detail("01", members=spark.createDataFrame([("x", "01"), ("y", "01"), ("z", "02")], "m string, of string"), member_of="of", records=[{"code": "q", "value": "a"}], notices=["n"])
    assert got["member_count"] == 2 and got["records"] == [{"code": "q", "value": 1.0}] and got["notices"] == ["n"] and s.detail("99") is None


def test_digest_and_fail_open(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, s string")
    assert C.logical_digest(df) == C.logical_digest(df.orderBy(F.desc("k")).repartition(5)) != C.logical_digest(df.distinct())
    assert C.logical_digest(df.where("false")) != C.logical_digest(df)
    base = spark.range(2)

    def broken(b):
        b.join(spark.read.parquet("/nowhere/at/all"), "id").count()

    out, said = C.fail_open(base, {"x": (broken, {"extra": "double"}), "y": (lambda b: b.withColumn("fine", F.lit(1)), {"fine": "int"})})
    assert out.columns == ["id", "extra", "fine"] and set(said) == {"x"} and out.count() == 2


def test_key_relations(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ([1, 2, 2, None], [1, 2, 3, None]))
    C.assert_keys(a, b, ["k"], "subset")
    C.assert_keys(a.where("k = 2"), b.where("k = 3"), ["k"], "disjoint")
    C.assert_keys(b, b.orderBy(F.desc("k")), ["k"], "equal")
    for relation in ("equal", "disjoint"):
        with pytest.raises(C.ContractError):
            C.assert_keys(a, b, ["k"], relation)


def test_reconciled_gaps_are_exact(spark):
    a, b = spark.createDataFrame([("x0001",), ("y0002",)], "a string"), spark.createDataFrame([("z0001",)], "b string")
    run = lambda allowed: E.reconcile_codes(a, b, F.right("a", F.lit(4)), F.right("b", F.lit(4)), allowed_missing=allowed)
    assert [r.a for r in run(["0002"])[1].collect()] == ["y0002"]
    for allowed in (["0009"], ["0002", "0009"]):
        with pytest.raises(C.ContractError):
            run(allowed)


def test_entry_without_the_llm_subpackage(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    here = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(here / "quernstone", tmp_path / "quernstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, json; print(json.dumps([len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op')]]))"
    said = json.loads(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout)
    assert said[0] > 50 and said[1] > 50 and said[2] == []
