"""D-13: the registry of persons who occur once all corrections are applied, published as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.steps import forget, written
from quillmark.operators import corrections as C
from quillmark.operators import registry as R
from quillmark.operators.signals import pattern_lists
from quillmark.sources import snapshots


def unique_persons(occurrences: DataFrame, corrections: DataFrame, persons: DataFrame, supplement: DataFrame, fields: list[str]) -> DataFrame:
    """S-J9, S-J25 to S-J27 and A-19: active persons, blanks filled and missing ones added from the supplement, with ``patterns``."""
    corrected = C.apply_corrections(occurrences, C.fold(corrections)).select("delegate_id", "pattern")
    active = written(R.drop_null_ids(R.drop_sentinels(corrected)).select("delegate_id").distinct())
    one = R.first_per_key(persons, ["delegate_id"])
    people = written(R.add_active_persons(R.fill_from_supplement(C.active_persons(one, active), supplement, fields), active, supplement))
    lists = pattern_lists(corrected, people).withColumnRenamed("delegate_id", "_id")
    return people.drop("patterns").join(lists, F.col("delegate_id") == F.col("_id"), "left").drop("_id")


def export_unique_persons(occurrences: DataFrame, corrections: DataFrame, persons: DataFrame, supplement: DataFrame, fields: list[str], root: str, check: Callable[[str], None] | None = None) -> int:
    """D-13, S-IO23: ``unique_persons`` as Parquet and CSV, both in one version of ``root`` or neither; the version's number."""
    made = written(unique_persons(occurrences, corrections, persons, supplement, fields))
    flat = made.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in made.dtypes))
    version = snapshots.commit(made.sparkSession, root, {"persons": (made, "parquet"), "persons_csv": (flat, "csv")}, check=check)
    forget(made)
    return version
