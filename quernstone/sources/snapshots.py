"""Sinks: exports, and immutable snapshots addressed by their inputs and published through a pointer."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename(spark: SparkSession, old: str, new: str, overwrite: bool) -> None:
    """Rename in one step; without ``overwrite`` an existing target fails."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
    _, source = _fs(spark, old)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(source, _fs(spark, new)[1], options)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Readers find the old text or the new one, never none."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = _fs(spark, tmp)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    _rename(spark, tmp, path, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def publish(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, list[str]]], inputs: dict[str, str]) -> str:
    """Write tables (frame, sort keys) once under a build id made from ``inputs``, then point ``current.json`` at them.

    An existing build is reused. Tables appear under the final name only when all are written and counted. Each publisher
    writes to a folder of its own; of several at work on one build the first to finish wins. Frames should be read from tables:
    a range exchange samples what it deals out, so others are computed twice.
    """
    build = hashlib.sha256(canonical_json(inputs).encode()).hexdigest()[:16]
    fs, final = _fs(spark, f"{root}/{build}")
    if not fs.exists(final):
        tmp = f"{root}/_tmp-{build}-{uuid.uuid4().hex}"
        counts = {}
        for name, (df, keys) in tables.items():
            df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(f"{tmp}/{name}.parquet")
            counts[name] = spark.read.parquet(f"{tmp}/{name}.parquet").count()
        _write_text(spark, f"{tmp}/build.json", canonical_json({"build": build, "inputs": inputs, "rows": counts, "created": datetime.now(UTC).isoformat()}))
        try:
            _rename(spark, tmp, f"{root}/{build}", False)
        except Exception as e:  # another publisher was first: the same inputs, so the same tables
            fs.delete(_fs(spark, tmp)[1], True)
            if not fs.exists(final):
                raise OSError(f"can't publish {build}") from e
    _write_text(spark, f"{root}/current.json", canonical_json({"build": build}))
    return build


def register_views(spark: SparkSession, root: str) -> dict:
    """The current build's tables as temporary views under their names; returns what ``build.json`` says of them."""
    build = json.loads(read_text(spark, f"{root}/current.json"))["build"]
    meta = json.loads(read_text(spark, f"{root}/{build}/build.json"))
    for name in meta["rows"]:
        spark.read.parquet(f"{root}/{build}/{name}.parquet").createOrReplaceTempView(name)
    return meta


def retire(spark: SparkSession, root: str, keep: set[str]) -> list[str]:
    """Delete builds that are neither current nor in ``keep``; only folders with a ``build.json`` that names them."""
    keep = keep | {json.loads(read_text(spark, f"{root}/current.json"))["build"]}
    fs, p = _fs(spark, root)
    gone = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        mark = f"{root}/{name}/build.json"
        if status.isDirectory() and name not in keep and fs.exists(_fs(spark, mark)[1]) and json.loads(read_text(spark, mark))["build"] == name:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def open_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{json.loads(read_text(spark, f'{root}/current.json'))['build']}/{name}.parquet")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, then ``new``; missing columns are null."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def guarded(path: str, managed: Sequence[str]) -> str:
    """The path, unless it lies in (or is) a managed folder."""
    flat = lambda x: posixpath.normpath(x.removeprefix("file://"))
    if any(flat(path) == flat(m) or flat(path).startswith(flat(m).rstrip("/") + "/") for m in managed):
        raise ValueError(f"{path} lies in managed data")
    return path


def export(df: DataFrame, path: str, kind: str, keys: list[str], managed: Sequence[str] = ()) -> None:
    """Sorted export as ``parquet``, ``csv`` or ``json`` (lines), in parallel files in order; never into ``managed`` folders."""
    guarded(path, managed)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    w = ordered.write.mode("errorifexists")
    if kind == "parquet":
        w.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        w.option("header", True).csv(path)
    elif kind == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def fit_table(evaluated: DataFrame, candidates: DataFrame, key: str, details: dict[str, object]) -> DataFrame:
    """What the export of an evaluation holds: eligible rows by rank and key, the candidates' columns, ``details`` as JSON columns."""
    head = [key, "name", "state", "active_value", "eligible", "reason", "national_rank", "filtered_rank", "pareto_optimal"]
    rest = [c for c in candidates.columns if c not in head]
    rows = evaluated.where("eligible").join(candidates, key)
    return rows.select(*head, *rest, *[F.lit(json.dumps(v, sort_keys=True)).alias(f"{k}_json") for k, v in details.items()]).orderBy("filtered_rank", key)


def json_array(df: DataFrame) -> Iterator[str]:
    """A JSON array in chunks, streamed partition by partition."""
    yield "["
    for k, r in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
        yield ("," if k else "") + r.j
    yield "]"


def csv_chunks(df: DataFrame, size: int = 1000) -> Iterator[str]:
    """CSV text in chunks of ``size`` rows."""
    buf = io.StringIO()
    out = csv.writer(buf)
    out.writerow(df.columns)
    for k, r in enumerate(df.toLocalIterator(), 1):
        out.writerow(r)
        if k % size == 0:
            yield buf.getvalue()
            buf.seek(0)
            buf.truncate()
    yield buf.getvalue()
