"""Sources: typed text tables, archives, workbooks, dBase, JSON caches and per-entity documents, NumPy tiles."""

from __future__ import annotations

import io
import itertools
import json
import re
import struct
import tarfile
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.sources.snapshots import _rename, _write_text, read_text


def null_tokens(c: Column, tokens: Sequence[str]) -> Column:
    t = F.trim(c)
    return F.when(t.isin(*tokens), None).otherwise(t)


def read_text_table(spark: SparkSession, path: str | list[str], columns: dict[str, str], nulls: Sequence[str] = ("",), sep: str = ",", encoding: str = "UTF-8", strict: bool = True, project: Sequence[str] | None = None) -> DataFrame:
    """Delimited text with a header. Everything is read as text by name, null tokens become null, then types are cast.

    ``strict``: a value that doesn't fit its type fails; else it is null.
    """
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"):
        return _read_recoded(spark, path, columns, nulls, sep, encoding, strict, project)
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "FAILFAST").option("inferSchema", False).csv(path)
    return _typed(raw, columns, nulls, strict, project)


def _read_recoded(spark: SparkSession, path, columns, nulls, sep, encoding, strict, project) -> DataFrame:
    """Charsets that Spark's reader doesn't take, such as windows-1252: read as bytes (ISO-8859-1), values decoded again.

    No session setting changes. Such charsets must agree with ASCII, so that separators and quotes are the same bytes.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1").option("mode", "FAILFAST").option("inferSchema", False).csv(path)
    table = bytes(range(256)).decode("iso-8859-1")
    there = [bytes([b]).decode(encoding, "replace") for b in range(256)]
    odd = {a: b for a, b in zip(table, there, strict=True) if a != b}
    again = lambda c: F.translate(c, "".join(odd), "".join(odd.values())) if odd else c
    names = {c: c.translate(str.maketrans(odd)) for c in raw.columns}
    raw = raw.select(*[again(F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    return _typed(raw, columns, nulls, strict, project)


def _typed(raw: DataFrame, columns: dict[str, str], nulls: Sequence[str], strict: bool, project: Sequence[str] | None) -> DataFrame:
    if missing := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"columns missing: {missing}")
    cast = lambda c, t: c if t == "string" else c.cast(t) if strict else c.try_cast(t)
    return raw.select(*[cast(null_tokens(F.col(f"`{c}`"), nulls), t).alias(c) for c, t in columns.items() if project is None or c in project])


def _member(data: bytes, suffix: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.endswith(suffix)]
        if len(names) != 1:
            raise ValueError(f"{len(names)} members end with {suffix}")
        return z.read(names[0])


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


#: Rows that leave a file at a time.
CHUNK_ROWS = 10_000


def _by_file(files: DataFrame, schema: str, tables) -> DataFrame:
    """Apply ``tables(bytes) -> iterator of pandas frames`` to each file, one file at a time; a task holds a file and a chunk of its rows."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                for table in tables(bytes(data)):
                    yield table.reindex(columns=names)

    return files.select("content").mapInPandas(run, schema)


def _chunks(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    while held := list(itertools.islice(rows, CHUNK_ROWS)):
        yield pd.DataFrame(held)


def _csv_chunks(handle, columns: Sequence[str], encoding: str) -> Iterator[pd.DataFrame]:
    """A CSV stream in chunks; columns that it lacks come out null."""
    yield from (c.reindex(columns=list(columns)) for c in pd.read_csv(handle, dtype=str, keep_default_na=False, encoding=encoding, chunksize=CHUNK_ROWS))


def read_zip_csv(spark: SparkSession, path: str, suffix: str, columns: Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """The one member with this suffix of each ZIP, as text columns; none or several members, or a missing column, fail."""

    def tables(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n for n in z.namelist() if n.endswith(suffix)]
            if len(names) != 1:
                raise ValueError(f"{len(names)} members end with {suffix}")
            with z.open(names[0]) as member:
                for chunk in pd.read_csv(member, dtype=str, keep_default_na=False, encoding=encoding, chunksize=CHUNK_ROWS):
                    yield chunk[list(columns)]

    return _by_file(_files(spark, path), ", ".join(f"`{c}` string" for c in columns), tables)


def read_tar_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All CSV members of tar archives, as text columns with the member's name; members are streamed one by one."""

    def tables(data: bytes):
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(".csv"):
                    for chunk in _csv_chunks(tar.extractfile(m), columns, "utf-8"):
                        yield chunk.assign(member=m.name)

    return _by_file(_files(spark, path), "member string, " + ", ".join(f"`{c}` string" for c in columns), tables)


def extract_member(archive: str, member: str, target: str, size: int, sha256: str, archive_sha256: str) -> str:
    """A member of a ZIP as a file of locked size and digest; kept if it and its note are as expected, else written anew.

    Archives aren't splittable, their members are: a step before Spark reads. Bytes stream from file system to file system
    (paths as Spark reads them, so the target may lie in the shared folder, where executors find it) and take the target's name in
    one rename, when size and digest are right.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda path: jvm.org.apache.hadoop.fs.Path(path)
    of = lambda path: at(path).getFileSystem(conf)
    expected = {"archive_sha256": archive_sha256, "member": member, "bytes": size, "sha256": sha256}
    note = f"{target}.checkpoint.json"

    def copied(source, out) -> tuple[int, str]:
        """Bytes (one more than ``size`` at most) and digest of what was copied."""
        sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
        counted = jvm.org.apache.commons.io.output.CountingOutputStream(out)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.security.DigestInputStream(jvm.org.apache.commons.io.input.BoundedInputStream(source, size + 1), sha), counted, 1 << 16, False)
        counted.flush()
        return counted.getByteCount(), bytes(b & 0xFF for b in sha.digest()).hex()

    fs = of(target)
    if fs.exists(at(note)) and fs.exists(at(target)):
        kept = fs.open(at(target))
        try:
            if json.loads(read_text(spark, note)) == expected and copied(kept, jvm.java.io.OutputStream.nullOutputStream()) == (size, sha256):
                return target
        except (ValueError, Py4JJavaError):
            pass  # the note is torn, or the file can't be read as it was written
        finally:
            kept.close()
    if not of(archive).exists(at(archive)):
        raise FileNotFoundError(archive)
    part = f"{target}.{uuid.uuid4().hex}.part"
    packed = jvm.java.util.zip.ZipInputStream(of(archive).open(at(archive)))
    try:
        while (entry := packed.getNextEntry()) is not None and entry.getName() != member:
            pass
        if entry is None:
            raise ValueError(f"{archive} has no member {member}")
        out = fs.create(at(part), True)
        try:
            got = copied(packed, out)
        finally:
            out.close()
        if got[0] > size:
            raise ValueError(f"{member} is larger than its locked size")
        if got != (size, sha256):
            raise ValueError(f"{member} differs from its contract")
        _rename(spark, part, target, True)
    finally:
        packed.close()
        fs.delete(at(part), False)
    _write_text(spark, note, json.dumps(expected, sort_keys=True))
    return target


def table_contract(spark: SparkSession, path: str) -> dict:
    """Schema and rows of a Parquet table, from its footers only."""
    df = spark.read.parquet(path)
    return {"columns": dict(df.dtypes), "rows": df.count()}


def sorted_tables(spark: SparkSession, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Several Parquet tables as one, in order of ``keys``."""
    return spark.read.parquet(*paths).orderBy(*keys)


_XL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(data: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> Iterator[list[str | None]]:
    """Rows of a worksheet as text; gaps between cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_XL}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        for row in ET.fromstring(z.read(sheet)).iter(f"{_XL}row"):
            out: list[str | None] = []
            for c in row.iter(f"{_XL}c"):
                k = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    k = k * 26 + ord(ch) - 64
                out += [None] * (k - len(out))
                v = c.find(f"{_XL}v")
                kind = c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{_XL}t")) if kind == "inlineStr" else None if v is None else v.text
                out[k - 1] = shared[int(text)] if kind == "s" and text is not None else text
            yield out


def read_xlsx(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """First worksheets with a header row, as text columns: one task for each workbook."""

    def rows(data: bytes):
        it = xlsx_rows(data)
        head = next(it, [])
        for r in it:
            named = dict(zip(head, r, strict=False))
            yield {c: named.get(c) for c in columns}

    return _by_file(_files(spark, path), ", ".join(f"`{c}` string" for c in columns), lambda data: _chunks(rows(data)))


def dbf_rows(data: bytes) -> Iterator[dict[str, str]]:
    """Records of a dBase table as stripped text; deleted records are left out."""
    n, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    for k in range(n):
        rec = data[head + k * width : head + (k + 1) * width]
        if rec[:1] == b" ":
            out, p = {}, 1
            for name, size in fields:
                out[name] = rec[p : p + size].decode("latin-1").strip()
                p += size
            yield out


def read_dbf_zip(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return _by_file(_files(spark, path), ", ".join(f"`{c}` string" for c in columns), lambda data: _chunks({c: r.get(c) for c in columns} for r in dbf_rows(_member(data, ".dbf"))))


def read_json_rows(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Documents ``{"rows": [...]}``."""
    return spark.read.schema(f"rows array<struct<{row_schema}>>").option("multiLine", True).json(path).select(F.inline("rows"))


def read_json_series(spark: SparkSession, path: str, key: str, series: str) -> DataFrame:
    """One document per entity with a map of month (``MM-YYYY``) to value: ``key, month (yyyy-MM), value``."""
    docs = spark.read.schema(f"{key} string, {series} map<string,double>").option("multiLine", True).json(path)
    return docs.select(key, F.explode(series).alias("m", "value")).select(key, F.concat(F.substring("m", 4, 4), F.lit("-"), F.substring("m", 1, 2)).alias("month"), "value")


def read_npy_tiles(spark: SparkSession, path: str) -> DataFrame:
    """``tile`` (file name without suffix), ``rows, cols, values`` of two-dimensional arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
                yield pd.DataFrame({"tile": [name.rsplit("/", 1)[-1].removesuffix(".npy")], "rows": [a.shape[0]], "cols": [a.shape[1]], "values": [a.astype(float).ravel()]})

    return _files(spark, path, "*.npy").select("path", "content").mapInPandas(run, "tile string, rows int, cols int, values array<double>")
