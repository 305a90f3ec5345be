"""Tables that are replaced as a whole, several at once, without a moment in which a reader finds nothing.

A version is a set of named outputs. They are written under a new name first, then listed in a manifest,
and the manifest is renamed to the next version number by a rename that fails if the number is taken. A
reader takes the last manifest and what it lists, so it sees all outputs of a version or none of them, and
a job that dies between two outputs leaves only files that nobody lists (``vacuum`` deletes them). Of two
writers that started from the same version one gets the number; the other is told so. On stores without
an atomic rename, run one writer at a time. Versions and output names are few; rows never come here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("parquet", "csv", "json")


class Taken(RuntimeError):
    """Another writer committed first."""


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(p), files


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, rising."""
    p, files = _path(spark, f"{root}/versions")
    if not files.exists(p):
        return []
    names = [s.getPath().getName() for s in files.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, dict[str, str]]:
    """Output name -> path and kind of a version, the last by default; empty before the first."""
    known = versions(spark, root)
    if version is None and not known:
        return {}
    number = known[-1] if version is None else version
    if number not in known:
        raise FileNotFoundError(f"{root} has no version {number}")
    return json.loads(spark.read.option("wholetext", True).text(f"{root}/versions/{number:010d}.json").first()[0])  # one small file


def read(spark: SparkSession, root: str, name: str, version: int | None = None, schema: str | None = None) -> DataFrame | None:
    """An output of a version, the last by default; ``None`` if it doesn't have it."""
    entry = manifest(spark, root, version).get(name)
    if entry is None:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return {"parquet": reader.parquet, "csv": reader.option("header", True).csv, "json": reader.json}[entry["kind"]](f"{root}/{entry['path']}")


def _write(df: DataFrame, kind: str, path: str) -> None:
    {"parquet": df.write.parquet, "csv": df.write.option("header", True).csv, "json": df.write.json}[kind](path)


def commit(spark: SparkSession, root: str, outputs: dict[str, tuple[DataFrame, str]], base: int | None = None, check: Callable[[str], None] | None = None) -> int:
    """Write ``outputs`` (name -> frame, kind) and make them the next version; outputs that aren't given are carried over from the last.

    With ``base`` the new version must directly follow that one (0: be the first), else ``Taken`` is raised
    and the last version stays. ``check`` is called with each output's name before it is written.
    """
    if unknown := {k for _, k in outputs.values()} - set(KINDS):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    folder = f"data/{uuid.uuid4().hex}"
    listed = {}
    for name, (df, kind) in outputs.items():
        if check is not None:
            check(name)
        _write(df, kind, f"{root}/{folder}/{name}")
        listed[name] = {"path": f"{folder}/{name}", "kind": kind}
    while True:
        last = (versions(spark, root) or [0])[-1]
        if base is not None and last != base:
            raise Taken(f"{root}: version {last} came after {base}")
        whole = (manifest(spark, root, last) if last else {}) | listed
        pending, files = _path(spark, f"{root}/pending-{uuid.uuid4().hex}.json")
        out = files.create(pending, False)
        out.write(bytearray(json.dumps(whole, sort_keys=True).encode()))
        out.close()
        target, _ = _path(spark, f"{root}/versions/{last + 1:010d}.json")
        files.mkdirs(target.getParent())
        if _renamed(spark, pending, target):
            return last + 1
        files.delete(pending, False)


def _renamed(spark: SparkSession, source, target) -> bool:  # noqa: ANN001
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf)
    keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, keep)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def merge(new: DataFrame, root: str, name: str, keys: list[str], order: list[str] | None = None, kind: str = "parquet", tries: int = 5) -> int:
    """S-IO24, S-IO25: the last version of a table with ``new`` rows in place of those with the same keys.

    Of several rows of a key among old and new the one that is largest by ``order`` stays (ties: the new
    one, then the largest by all columns); without ``order`` a new row wins. If another writer commits
    meanwhile, the merge is done again on what that one left.
    """
    spark = new.sparkSession
    for _ in range(tries):
        base = (versions(spark, root) or [0])[-1]
        old = read(spark, root, name, base, new.schema if kind != "csv" else None) if base else None
        rows = new.withColumn("_new", F.lit(1))
        if old is not None:
            rows = old.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        columns = [c for c in rows.columns if c != "_new"]
        rank = F.struct(*(order or []), "_new", *(c for c in columns if c not in (order or [])))
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_row")).select("_row.*")
        try:
            return commit(spark, root, {name: (best, kind)}, base)
        except Taken:
            continue
    raise Taken(f"{root}: {tries} merges were overtaken")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete what none of the last ``keep`` versions lists. Run it while nobody reads older versions or writes."""
    known = versions(spark, root)
    used = {e["path"].split("/")[1] for v in known[-keep:] for e in manifest(spark, root, v).values()}
    data, files = _path(spark, f"{root}/data")
    for s in files.listStatus(data) if files.exists(data) else []:
        if s.getPath().getName() not in used:
            files.delete(s.getPath(), True)
    for v in known[:-keep]:
        files.delete(_path(spark, f"{root}/versions/{v:010d}.json")[0], False)
