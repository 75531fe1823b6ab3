"""Publication of several tables at once: staged folders, and a manifest whose version is compared and swapped.

    root/staged/<id>/<table>      what a writer has prepared; nobody reads it yet
    root/manifests/<version>.json the tables of a version

A version exists once its manifest does, so readers see all of its tables or none. Manifests are written aside and renamed to
their version's name, which the store lets one writer do only; whoever comes second, or began from an older version, is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_DIGITS = 12


class Refused(ValueError):
    """A publication that checks don't allow."""


class Stale(Refused):
    """A publication that began from a version that is no longer the newest."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending."""
    where, fs = _path(spark, f"{root}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """The manifest of a version: its tables' folders, rows and schemas."""
    where, fs = _path(spark, f"{root}/manifests/{version:0{VERSION_DIGITS}}.json")
    source = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)).decode())
    finally:
        source.close()


def current(spark: SparkSession, root: str) -> int:
    """The newest version, 0 if there is none."""
    return (versions(spark, root) or [0])[-1]


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the newest if none is named. Several reads of one state should name it."""
    entry = manifest(spark, root, current(spark, root) if version is None else version)["tables"][table]
    return spark.read.schema(entry["schema"]).parquet(f"{root}/{entry['folder']}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: int, checks: dict[str, tuple[str, Column]] | None = None) -> int:
    """Publishes tables together as the version after `expected`, and returns it. Tables that aren't named stay as they were.

    checks: a rule's name to a table and a condition that each of its rows must meet (null counts as not met). They are tried on
    what was staged, the very rows that readers would see. If one isn't met, or `expected` isn't the newest version,
    nothing is published, what was staged is deleted, and the error says why.
    """
    if current(spark, root) != expected:
        raise Stale(f"began from version {expected}, the newest is {current(spark, root)}")
    staged = f"staged/{uuid.uuid4().hex}"
    where, fs = _path(spark, f"{root}/{staged}")
    entries = dict(manifest(spark, root, expected)["tables"]) if expected else {}
    try:
        for name, frame in tables.items():
            frame.write.parquet(f"{root}/{staged}/{name}")
            written = spark.read.schema(frame.schema).parquet(f"{root}/{staged}/{name}")
            broken = {rule: F.count_if(~F.coalesce(met, F.lit(False))).alias(rule) for rule, (of, met) in (checks or {}).items() if of == name}
            row = written.agg(F.count("*").alias("__rows"), *broken.values()).first()
            failed = {rule: row[rule] for rule in broken if row[rule]}
            if failed:
                raise Refused(f"{name}: rows that break a rule: {failed}")
            entries[name] = {"folder": f"{staged}/{name}", "rows": row["__rows"], "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)}
        _swap(spark, root, expected + 1, {"version": expected + 1, "tables": entries})
    except Exception:
        fs.delete(where, True)
        raise
    return expected + 1


def _swap(spark: SparkSession, root: str, version: int, body: dict) -> None:
    """Puts a manifest in its place, if no other is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside, fs = _path(spark, f"{root}/manifests/.{version}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    place, _ = _path(spark, f"{root}/manifests/{version:0{VERSION_DIGITS}}.json")
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, place, options)  # fails if the place is taken
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(place):
            raise Stale(f"version {version} was published meanwhile") from e
        raise


def retire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Deletes all but the newest `keep` versions, and the folders that no version kept refers to; returns what went. No writer may be at work."""
    every = versions(spark, root)
    going, staying = every[:-keep], every[-keep:]
    used = {e["folder"] for v in staying for e in manifest(spark, root, v)["tables"].values()}
    for v in going:
        where, fs = _path(spark, f"{root}/manifests/{v:0{VERSION_DIGITS}}.json")
        folders = {e["folder"] for e in manifest(spark, root, v)["tables"].values()} - used
        fs.delete(where, False)
        for folder in folders:
            fs.delete(_path(spark, f"{root}/{folder}")[0], True)
    return going
