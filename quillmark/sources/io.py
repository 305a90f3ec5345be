"""Reading and writing of the tables, corrections and decisions. Paths are any that Spark can read."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.columns import canonical_id, clean_strings, trim_column_names
from quillmark.operators.corrections import apply_corrections, changed_rows, fold
from quillmark.sources import snapshots


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_first(spark: SparkSession, candidates: list[str]) -> tuple[DataFrame, str]:
    """S-IO1: the first path that is there; Parquet, CSV with a header, or JSON by its ending."""
    for path in candidates:
        if _exists(spark, path):
            kind = path.rsplit(".", 1)[-1].lower()
            read = {"csv": lambda p: spark.read.option("header", True).csv(p), "json": lambda p: spark.read.option("multiLine", True).json(p)}.get(kind, spark.read.parquet)
            return read(path), path
    raise FileNotFoundError(f"none of {candidates}")


def load_tables(spark: SparkSession, persons: list[str], occurrences: list[str], authority: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S-IO2: the three tables, cleaned, with canonical ids as text and a ``row_id`` that comes from the file."""
    p, o, a = (clean_strings(trim_column_names(read_first(spark, x)[0])) for x in (persons, occurrences, authority))
    if "row_id" not in o.columns:
        raise ValueError("occurrences need a stable row_id column")
    fix = lambda df, c: df.withColumn(c, F.when(F.col(c).isNotNull(), canonical_id(F.col(c))))
    return fix(p, "delegate_id"), fix(o, "delegate_id"), fix(a, "id_persoon")


def convert_to_parquet(spark: SparkSession, source: str, target: str) -> DataFrame:
    """S-IO3: columns whose name holds ``id`` become text."""
    df, _ = read_first(spark, [source])
    out = df.select(*(F.col(c).cast("string").alias(c) if re.search("id", c, re.IGNORECASE) else F.col(c) for c in df.columns))
    out.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_corrections(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """S-IO5, S-IO6, C-02: a JSON map of row -> id or struct; keys that aren't numbers are skipped."""
    entries = _text(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    s = F.from_json("v", "struct<to_id:string,from_id:string,name:string,updated_at:string,source:string,staged_at:string,approved_at:string>")
    is_struct = F.startswith(F.trim("v"), F.lit("{"))
    field = lambda n: F.when(is_struct, F.col(f"s.{n}"))
    out = entries.withColumn("s", F.when(is_struct, s)).select(
        F.col("k").try_cast("long").alias("row_id"), F.lit(tier).alias("tier"), canonical_id(F.when(is_struct, F.col("s.to_id")).otherwise(F.col("v"))).alias("to_id"),
        field("from_id").alias("from_id"), field("name").alias("name"), field("source").alias("source"), F.coalesce(field("updated_at"), field("staged_at"), field("approved_at")).alias("updated_at"),
    )
    return out.filter("row_id IS NOT NULL AND to_id <> ''")


def read_remappings(spark: SparkSession, path: str) -> DataFrame:
    """S-IO7."""
    return spark.read.option("multiLine", True).schema("from_id string, to_id string").json(path)


def read_remappings_csv(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """S-IO8: trimmed, blanks dropped, one rule for each ``from_id``, existing rules first."""
    from quillmark.operators.registry import first_per_key

    rules = trim_column_names(spark.read.option("header", True).csv(path)).select(F.trim("from_id").alias("from_id"), F.trim("to_id").alias("to_id")).filter("from_id <> '' AND to_id <> ''")
    rules = first_per_key(rules, ["from_id"])
    return rules if existing is None else existing.unionByName(rules.join(existing.select("from_id"), "from_id", "left_anti"))


def read_id_set(spark: SparkSession, path: str, key: str = "delegate_id") -> DataFrame:
    """S-IO9: a JSON list of ids or of records with ``id`` and ``reason``."""
    items = _text(spark, path).select(F.explode(F.from_json("value", "array<string>")).alias("x"))
    rec = F.from_json("x", f"struct<id:string,{key}:string,reason:string>")
    is_rec = F.startswith(F.trim("x"), F.lit("{"))
    return items.withColumn("r", F.when(is_rec, rec)).select(F.when(is_rec, F.coalesce("r.id", f"r.{key}")).otherwise(F.col("x")).alias(key), F.col("r.reason").alias("reason")).filter(F.col(key).isNotNull()).dropDuplicates([key])


def read_dismissals(spark: SparkSession, path: str) -> DataFrame:
    """S-IO10."""
    items = _text(spark, path).select(F.explode(F.from_json("value", "array<array<string>>")).alias("x")).filter(F.size("x") == 2)
    return items.select(F.element_at("x", 1).alias("pattern"), F.element_at("x", 2).alias("delegate_id")).distinct()


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """S-IO11."""
    return spark.read.option("multiLine", True).schema("delegate_id string, anchor string, patterns array<string>, freq_a long, freq_b long").json(path)


def read_validity(spark: SparkSession, path: str) -> DataFrame:
    """S-IO12: keys ``id|pattern|year``; a pattern may hold bars itself."""
    e = _text(spark, path).select(F.explode(F.from_json("value", "map<string,boolean>")).alias("k", "valid"))
    m = lambda i: F.regexp_extract("k", r"^([^|]*)\|(.*)\|([^|]*)$", i)
    return e.select(m(1).alias("delegate_id"), m(2).alias("pattern"), m(3).try_cast("double").try_cast("int").alias("year"), "valid").filter("delegate_id <> ''")


def read_new_persons(spark: SparkSession, path: str) -> DataFrame:
    """S-IO13: a JSON list of person records."""
    return spark.read.option("multiLine", True).json(path)


def read_person_edits(spark: SparkSession, path: str) -> DataFrame:
    """S-IO13: a JSON map id -> {column: value} as ``delegate_id, field, value``."""
    e = _text(spark, path).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("delegate_id", "m"))
    return e.select("delegate_id", F.explode("m").alias("field", "value"))


def wide_edits(edits: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each person with the given fields as columns."""
    return edits.groupBy("delegate_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def read_province_order(spark: SparkSession, path: str) -> DataFrame:
    """S-IO14."""
    return _text(spark, path).select(F.posexplode(F.from_json("value", "array<string>")).alias("prov_rank", "provincie"))


def read_supplement(spark: SparkSession, options: dict[str, str], ids: DataFrame, key: str = "delegate_id", deleted: str | None = "deleted_at", partitions: int = 16) -> DataFrame:
    """S-IO15: a JDBC table by ``options`` (url, dbtable, user, password and so on come from the caller), only live rows of the given ids.

    Where the key is a number in the database, only the range of the ids that are asked for is read, in
    ``partitions`` ranges by as many connections at most, and the database filters; two numbers come to
    the driver for that. Text keys are read by one connection.
    """
    rows = spark.read.format("jdbc").options(**options).load()
    if dict(rows.dtypes)[key].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "decimal"):
        number = canonical_id(F.col(key)).try_cast("long")
        low, high = ids.agg(F.min(number), F.max(number)).first()
        if low is None:
            return rows.withColumn(key, canonical_id(F.col(key))).filter(F.lit(False))
        parts = max(1, min(partitions, high - low + 1))
        ranges = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(parts)}
        rows = spark.read.format("jdbc").options(**options, **(ranges if parts > 1 else {})).load().filter(F.col(key).between(low, high))
    rows = rows if deleted is None else rows.filter(F.col(deleted).isNull())
    return rows.withColumn(key, canonical_id(F.col(key))).join(ids.select(canonical_id(F.col(key)).alias(key)).distinct(), key, "left_semi")


def latest_path(spark: SparkSession, glob: str) -> str:
    """S-IO16: the path whose name sorts last, as dated names do; the file system lists names, no row is read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise FileNotFoundError(glob)
    return max(found, key=lambda s: s.getPath().getName()).getPath().toString()


def read_latest(spark: SparkSession, glob: str) -> DataFrame:
    """S-IO16: the rows of the file or folder whose name sorts last."""
    return read_first(spark, [latest_path(spark, glob)])[0]


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-IO17: without a byte-order mark in the first column's name; all columns are text."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def write_table(df: DataFrame, path: str, kind: str = "parquet", keys: list[str] | None = None, order: list[Column | str] | None = None) -> None:
    """S-IO20 to S-IO23: one row for each key if keys are given; parquet, csv (with header) or json.

    The rows are written beside the path and take its place by renames when they are whole, so ``df`` may
    read the same path, and a failed job leaves what was there. Between two renames the path is missing
    for a moment: tables that are read meanwhile belong in ``snapshots``.
    """
    out = df.dropDuplicates(keys) if keys else df
    out = out.sortWithinPartitions(*order) if order else out
    spark, mark = df.sparkSession, uuid.uuid4().hex
    new, old, place = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new-{mark}", f"{path}.old-{mark}", path))
    w = out.write
    {"parquet": w.parquet, "csv": w.option("header", True).csv, "json": w.json}[kind](f"{path}.new-{mark}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        files.rename(place, old)
    if not files.rename(new, place):
        raise OSError(f"could not rename {new} to {path}")
    files.delete(old, True)


def write_corrected(occurrences: DataFrame, corrections: DataFrame, path: str) -> None:
    """S-IO18."""
    write_table(apply_corrections(occurrences, fold(corrections)), path)


def write_changed(occurrences: DataFrame, corrections: DataFrame, path: str) -> None:
    """S-IO19."""
    write_table(changed_rows(occurrences, fold(corrections)), path)


def reviewed_report(summary: DataFrame, reviewed: DataFrame, path: str) -> None:
    """S-IO21."""
    write_table(summary.join(reviewed.select("delegate_id"), "delegate_id", "left_semi"), path, "csv")


def write_staged(new: DataFrame, root: str) -> int:
    """S-IO24: staged corrections merged into the last version of ``root`` as JSON, the latest of each row; the version's number."""
    return snapshots.merge(new, root, "staged", ["row_id"], ["updated_at", "to_id"], "json")


def write_decisions(new: DataFrame, root: str, name: str, keys: list[str]) -> int:
    """S-IO25: a rule or decision table merged into the last version of ``root``: a new row takes the place of that with its keys."""
    return snapshots.merge(new, root, name, keys)


def write_unique_persons(persons: DataFrame, path: str) -> None:
    """S-IO23: Parquet and CSV; arrays are not written to CSV."""
    write_table(persons, f"{path}.parquet")
    write_table(persons, f"{path}.csv", "csv")
