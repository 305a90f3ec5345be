"""Row-level corrections in tiers, folded and applied; decisions as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.registry import first_per_key, missing_persons
from quillmark.operators.sequence import timeline_gaps

# The tiers, weakest first.
TIERS = {"staged": 1, "approved": 2, "active": 3}
FIELDS = ["row_id", "tier", "to_id", "from_id", "name", "source", "updated_at"]


def tier_rank(c: Column | str = "tier") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))[c], F.lit(0))


def fold(corrections: DataFrame) -> DataFrame:
    """S-J9, U-05: the strongest tier of each row, then the latest, then the highest id. Aggregated, so a row's history isn't sorted."""
    latest = F.col("updated_at") if "updated_at" in corrections.columns else F.lit("")
    best = F.max_by(F.struct("tier", "to_id"), F.struct(tier_rank(), latest, F.col("to_id")))
    return corrections.filter("row_id IS NOT NULL").groupBy("row_id").agg(best.alias("c")).select("row_id", "c.tier", "c.to_id")


def apply_corrections(occurrences: DataFrame, folded: DataFrame) -> DataFrame:
    """S-J8: the row's new id where there is one; corrections of rows that are gone are passed over."""
    right = folded.select(F.col("row_id").alias("_r"), F.col("to_id").alias("_to"))
    both = occurrences.join(right, F.col("row_id") == F.col("_r"), "left")
    return both.select(*(F.coalesce("_to", "delegate_id").alias(c) if c == "delegate_id" else F.col(c) for c in occurrences.columns))


def changed_rows(occurrences: DataFrame, folded: DataFrame) -> DataFrame:
    """S-IO19: only the corrected rows, with ``new_delegate_id``."""
    return occurrences.join(folded.select("row_id", F.col("to_id").alias("new_delegate_id")), "row_id")


def with_context(corrections: DataFrame, occurrences: DataFrame, persons: DataFrame) -> DataFrame:
    """S-J23: corrections with the row's old id, pattern and year and the new person's name."""
    rows = occurrences.select("row_id", F.col("delegate_id").alias("old_id"), "pattern", "j")
    names = first_per_key(persons.select("delegate_id", "fullname"), ["delegate_id"]).select(F.col("delegate_id").alias("to_id"), F.col("fullname").alias("to_name"))
    return corrections.join(rows, "row_id", "left").join(names, "to_id", "left")


def hide_corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """S-J21."""
    return rows.join(corrections.select("row_id"), "row_id", "left_anti")


def hide_skipped(rows: DataFrame, skipped: DataFrame, flagged: DataFrame) -> DataFrame:
    """S-J22: without skipped rows and flagged patterns."""
    return rows.join(skipped.select("row_id"), "row_id", "left_anti").join(flagged.select("pattern"), "pattern", "left_anti")


def corrected_persons(occurrences: DataFrame, corrections: DataFrame) -> DataFrame:
    """S-J24."""
    return occurrences.join(corrections.select("row_id"), "row_id", "left_semi").select("delegate_id").distinct()


def active_persons(persons: DataFrame, corrected: DataFrame) -> DataFrame:
    """S-J25: persons who occur once all corrections are applied."""
    return persons.join(corrected.select("delegate_id"), "delegate_id", "left_semi")


def tier_statistics(corrections: DataFrame, occurrences: DataFrame) -> DataFrame:
    """A-15: for each tier: total, applied, stale, and distinct old and new ids."""
    both = corrections.join(occurrences.select("row_id", F.col("delegate_id").alias("old_id"), F.lit(True).alias("there")), "row_id", "left")
    return both.groupBy("tier").agg(F.count("*").alias("total"), F.count("there").alias("applied"), F.count_if(F.col("there").isNull()).alias("stale"), F.count_distinct("old_id").alias("n_from"), F.count_distinct("to_id").alias("n_to"))


def progress(corrections: DataFrame, occurrences: DataFrame) -> DataFrame:
    """A-14: rows of each tier in thousandths of all rows; the total is one number."""
    total = occurrences.count()
    return corrections.groupBy("tier").agg(F.count("*").alias("n")).withColumn("per_mille", F.floor(1000 * F.col("n") / F.lit(max(1, total))))


def from_to(folded: DataFrame, occurrences: DataFrame, top: int | None = None) -> DataFrame:
    """A-16: rows moved from one id to another, the most frequent first."""
    moved = occurrences.select("row_id", F.col("delegate_id").alias("from_id")).join(folded.select("row_id", "to_id"), "row_id")
    counts = moved.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), F.col("from_id").asc_nulls_first(), "to_id").limit(top)


def new_corrections(rows: DataFrame, to_id: Column, persons: DataFrame, tier: str = "active", source: str = "manual", updated_at: Column | None = None, action_id: str | None = None) -> DataFrame:
    """C-01: events for ``rows(row_id, delegate_id)``; the name is the new person's. A bulk action has an ``action_id`` that ``undo_last`` finds."""
    names = first_per_key(persons.select("delegate_id", "fullname"), ["delegate_id"]).select(F.col("delegate_id").alias("_id"), F.col("fullname").alias("name"))
    made = rows.select("row_id", F.col("delegate_id").alias("from_id"), to_id.cast("string").alias("to_id"))
    when = (updated_at if updated_at is not None else F.current_timestamp()).cast("string")
    events = made.join(names, F.col("to_id") == F.col("_id"), "left").select("row_id", F.lit(tier).alias("tier"), "to_id", "from_id", "name", F.lit(source).alias("source"), when.alias("updated_at"))
    return events if action_id is None else events.withColumn("action_id", F.lit(action_id))


def move_tier(corrections: DataFrame, source: str, target: str, replace: bool = False) -> DataFrame:
    """C-03 to C-05: the events of one tier become those of another; ``replace`` drops what the target held.

    Stage: active -> staged. Approve: staged or active -> approved. Load: staged -> active with
    ``replace``. Revert: approved -> active, merged with what is there (the later one wins when folded).
    """
    rest = corrections.filter(f"tier <> '{source}'" + (f" AND tier <> '{target}'" if replace else ""))
    return rest.unionByName(corrections.filter(F.col("tier") == source).withColumn("tier", F.lit(target)))


def clear(corrections: DataFrame, tier: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """C-06: without a tier, without chosen rows, or empty."""
    if rows is not None:
        gone = rows.select(F.col("row_id").alias("_r")).distinct()
        kept = corrections.join(gone, F.col("row_id") == F.col("_r"), "left")
        return kept.filter(F.col("_r").isNull() if tier is None else F.col("_r").isNull() | (F.col("tier") != tier)).drop("_r")
    return corrections.filter(F.lit(False)) if tier is None else corrections.filter(F.col("tier") != tier)


def revise(corrections: DataFrame, changes: DataFrame) -> DataFrame:
    """C-06: ``changes`` take the place of the same rows and tiers."""
    return corrections.join(changes.select("row_id", "tier"), ["row_id", "tier"], "left_anti").unionByName(changes, allowMissingColumns=True)


def select_rows(merged: DataFrame, selectors: DataFrame) -> DataFrame:
    """S-J32, C-07: the rows of chosen (pattern, id) pairs, with the ``to_id`` each pair gets."""
    return merged.join(selectors, ["pattern", "delegate_id"]).select("row_id", "delegate_id", "to_id")


def gap_boundary_rows(merged: DataFrame, longer: int, side: str = "both") -> DataFrame:
    """C-07: the rows at the ``start``, ``end`` or ``both`` sides of gaps."""
    ends = {"start": ["from_row"], "end": ["to_row"], "both": ["from_row", "to_row"]}[side]
    return timeline_gaps(merged, longer).select(F.explode(F.array(*ends)).alias("row_id"), "delegate_id").distinct()


def split_candidates(merged: DataFrame, longer: int, existing: DataFrame | None = None) -> DataFrame:
    """C-15: one row for each ``(delegate_id, from_year, to_year)``, added to those there are."""
    new = timeline_gaps(merged, longer).select("delegate_id", "from_year", "to_year")
    return (new if existing is None else existing.unionByName(new)).dropDuplicates(["delegate_id", "from_year", "to_year"])


def undo_last(corrections: DataFrame) -> DataFrame:
    """C-08: without the events of the action whose last event is the latest (ties: the larger id); single events stay. ``events.undo_events`` adds to a log instead."""
    if "action_id" not in corrections.columns:
        return corrections
    last = corrections.filter("action_id IS NOT NULL").agg(F.max(F.struct("updated_at", "action_id")).alias("_x")).select(F.col("_x.action_id").alias("_last"))
    return corrections.join(last, F.col("action_id") == F.col("_last"), "left_anti")


def accept_suggestions(rows: DataFrame, suggestions: DataFrame, persons: DataFrame, least: float, action_id: str | None = None) -> DataFrame:
    """C-09: staged events for rows whose first suggestion scores ``least`` or more."""
    top = suggestions.filter(F.col("score_1") >= least).select("row_id", F.col("person_1").alias("to"))
    return new_corrections(rows.join(top, "row_id"), F.col("to"), persons, "staged", "suggestion", action_id=action_id)


def add_decisions(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """C-10 to C-12: decisions (validity, flags, dismissals, synonyms, reviews, rules): the new one wins for its key."""
    rest = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def remove_decisions(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """C-11, C-12: without the given keys."""
    return existing.join(gone.select(*keys), keys, "left_anti")


def toggle(existing: DataFrame, ids: DataFrame, key: str = "delegate_id") -> DataFrame:
    """C-11: ids that are there go, the others come."""
    return existing.join(ids, key, "left_anti").unionByName(ids.join(existing.select(key), key, "left_anti").distinct(), allowMissingColumns=True)


def without_dismissed(candidates: DataFrame, dismissals: DataFrame) -> DataFrame:
    """S-J19."""
    return candidates.join(dismissals.select("pattern", "delegate_id"), ["pattern", "delegate_id"], "left_anti")


def without_known_fragments(fragments: DataFrame, dismissals: DataFrame, synonyms: DataFrame) -> DataFrame:
    """S-J20: without fragment pairs of which either is dismissed or that are known synonyms."""
    gone = dismissals.select("delegate_id", F.col("pattern").alias("_p"))
    for side in ("fragment_a", "fragment_b"):
        fragments = fragments.join(gone, (fragments["delegate_id"] == gone["delegate_id"]) & (F.col(side) == F.col("_p")), "left_anti")
    pairs = synonyms.select("delegate_id", F.sort_array("patterns").alias("pair"))
    keyed = fragments.withColumn("pair", F.sort_array(F.array("fragment_a", "fragment_b")))
    return keyed.join(pairs, ["delegate_id", "pair"], "left_anti").drop("pair")


def synonym_register(synonyms: DataFrame, persons: DataFrame) -> DataFrame:
    """A-37."""
    names = first_per_key(persons.select("delegate_id", "fullname"), ["delegate_id"])
    return synonyms.join(names, "delegate_id", "left").withColumn("pair", F.array_join("patterns", " / "))


def flag_members(summary: DataFrame, members: DataFrame, name: str = "sandboxed") -> DataFrame:
    """S-J33."""
    return summary.join(members.select(F.col("delegate_id").alias("_id")).distinct(), F.col("delegate_id") == F.col("_id"), "left").withColumn(name, F.col("_id").isNotNull()).drop("_id")


def confirmed_rows(occurrences: DataFrame, review: DataFrame) -> DataFrame:
    """S-J28: all rows of the confirmed (pattern, id) pairs."""
    return occurrences.join(review.filter("confirmed").select("pattern", "delegate_id", "to_id").distinct(), ["pattern", "delegate_id"])


def unmatched_review(occurrences: DataFrame, review: DataFrame) -> DataFrame:
    """S-J28: confirmed pairs without a row."""
    return review.filter("confirmed").join(occurrences.select("pattern", "delegate_id"), ["pattern", "delegate_id"], "left_anti")


def restore_labels(rows: DataFrame, labels: DataFrame, key: str = "pattern") -> DataFrame:
    """S-J30: earlier labels by key, else empty."""
    one = first_per_key(labels.select(key, "label"), [key])
    return rows.join(one, key, "left").withColumn("label", F.coalesce("label", F.lit("")))


def new_person(form: DataFrame, authority: DataFrame) -> DataFrame:
    """C-13, C-14, C-16: form rows with blanks filled from the authority by exact id."""
    from quillmark.operators.registry import enrich_persons

    return enrich_persons(form, authority)


def quick_add(ids: DataFrame, persons: DataFrame, authority: DataFrame) -> DataFrame:
    """C-14: ids that aren't known yet, filled from the authority."""
    return missing_persons(ids, persons, authority)
