"""Corrections and person edits as one log of events: state as of a time, undo, and compaction.

An event sets one ``field`` of one ``key`` to a ``value`` (null: takes it back). For ``kind`` correction the
key is the row, the field its tier and the value the new person; for ``kind`` edit the key is the person,
the field a column. Events are never changed: undoing an action adds events. Events of the same key and
field are ordered by ``updated_at`` (ISO text or a timestamp's text), then ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.columns import is_blank, nullif_blank
from quillmark.operators.registry import PERSON_NAME, authority_lookup

SCHEMA = "kind string, key string, field string, value string, updated_at string, event_id string, action_id string, source string"
_PLACE = ["kind", "key", "field"]
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def _identified(df: DataFrame) -> DataFrame:
    """With an ``event_id`` that follows from what the event says, so a repeated write adds nothing new."""
    return df.withColumn("event_id", F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in [*_PLACE, "value", "updated_at", "action_id"])))).select(*_COLUMNS)


def correction_events(corrections: DataFrame) -> DataFrame:
    """C-01 to C-05 as events of ``corrections(row_id, tier, to_id, updated_at, source, action_id)``; missing columns are null."""
    col = lambda c: F.col(c).cast("string") if c in corrections.columns else F.lit(None).cast("string")
    rows = corrections.select(F.lit("correction").alias("kind"), col("row_id").alias("key"), col("tier").alias("field"), col("to_id").alias("value"), col("updated_at").alias("updated_at"), col("action_id").alias("action_id"), col("source").alias("source"))
    return _identified(rows)


def edit_events(edits: DataFrame, updated_at: Column, action_id: str, source: str = "manual") -> DataFrame:
    """Events of wide ``edits(delegate_id, ...)``: one for each value that is there."""
    columns = [c for c in edits.columns if c != "delegate_id"]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    rows = edits.select(F.lit("edit").alias("kind"), F.col("delegate_id").cast("string").alias("key"), cells.alias("x")).filter("x.value IS NOT NULL")
    return _identified(rows.select("kind", "key", "x.field", "x.value", updated_at.cast("string").alias("updated_at"), F.lit(action_id).alias("action_id"), F.lit(source).alias("source")))


def enrichment_events(persons: DataFrame, authority: DataFrame, fields: dict[str, str], updated_at: Column, action_id: str) -> DataFrame:
    """C-16: edits of the persons with a blank name, from the authority (S-J15); ``fields``: person column -> authority column.

    Only cells that are blank are filled, so applying the edits overwrites nothing.
    """
    name = next(n for n in PERSON_NAME if n in persons.columns)
    blank = persons.filter(is_blank(F.col(name)))
    found = authority_lookup(blank.select("delegate_id").distinct(), authority, list(dict.fromkeys(fields.values())))
    right = found.select(F.col("delegate_id").alias("_id"), *(F.col(a).cast("string").alias(f"_a_{p}") for p, a in fields.items()))
    both = blank.join(right, F.col("delegate_id") == F.col("_id"))
    fill = lambda p: F.when(is_blank(F.col(p)), nullif_blank(F.col(f"_a_{p}"))) if p in persons.columns else nullif_blank(F.col(f"_a_{p}"))
    return edit_events(both.select("delegate_id", *(fill(p).alias(p) for p in fields)), updated_at, action_id, "authority")


def as_of(log: DataFrame, time: str | None = None, action_id: str | None = None) -> DataFrame:
    """The last event of each place, up to a time (included) or to the last event of an action; without either, of all.

    Places that were taken back are left out. Aggregated, so no place's history is sorted.
    """
    rows = log.dropDuplicates(["event_id"])
    if action_id is not None:
        last = rows.filter(F.col("action_id") == action_id).agg(F.max(F.struct("updated_at", "event_id")).alias("_last"))  # one row
        rows = rows.join(last, F.struct("updated_at", "event_id") <= F.col("_last")).drop("_last")
    if time is not None:
        rows = rows.filter(F.col("updated_at") <= time)
    return _last_events(rows).filter("value IS NOT NULL")


def _last_events(rows: DataFrame) -> DataFrame:
    rest = [c for c in _COLUMNS if c not in _PLACE]
    best = F.max_by(F.struct(*rest), F.struct("updated_at", "event_id")).alias("_e")
    return rows.groupBy(*_PLACE).agg(best).select(*_PLACE, "_e.*").select(*_COLUMNS)


def undo_events(log: DataFrame, action_id: str, updated_at: Column, undo_id: str) -> DataFrame:
    """C-08 as events: each place that the action set last gets back the value that it had before; places changed since stay."""
    rows = log.dropDuplicates(["event_id"])
    mine = rows.filter(F.col("action_id") == action_id)
    still = _last_events(rows).filter(F.col("action_id") == action_id).select(*_PLACE)
    before = rows.join(mine.groupBy(*_PLACE).agg(F.min(F.struct("updated_at", "event_id")).alias("_first")), _PLACE).filter(F.struct("updated_at", "event_id") < F.col("_first")).drop("_first")
    old = _last_events(before).select(*_PLACE, "value")
    back = still.join(old, _PLACE, "left").select(*_PLACE, "value", updated_at.cast("string").alias("updated_at"), F.lit(undo_id).alias("action_id"), F.lit("undo").alias("source"))
    return _identified(back)


def compact(log: DataFrame, before: str) -> DataFrame:
    """The log with one event for each place up to ``before``; ``as_of`` that time or a later one gives the same."""
    rows = log.dropDuplicates(["event_id"])
    return _last_events(rows.filter(F.col("updated_at") <= before)).unionByName(rows.filter(F.coalesce(F.col("updated_at") > before, F.lit(False))).select(*_COLUMNS))


def corrections_of(state: DataFrame) -> DataFrame:
    """``row_id, tier, to_id, updated_at, source`` of a state, for ``corrections.fold``."""
    return state.filter("kind = 'correction'").select(F.col("key").try_cast("long").alias("row_id"), F.col("field").alias("tier"), F.col("value").alias("to_id"), "updated_at", "source")


def edits_of(state: DataFrame, fields: list[str]) -> DataFrame:
    """Wide edits of a state, for ``registry.apply_person_edits`` (S-J10)."""
    rows = state.filter(F.col("kind") == "edit")
    return rows.groupBy(F.col("key").alias("delegate_id")).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
