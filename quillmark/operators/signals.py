"""Independent quality signals of occurrences and the summary of each person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import distance, nullif_blank, pattern_parts
from quillmark.functions.steps import written
from quillmark.operators.registry import first_per_key

# The bounds of a plausible age, and the gap in years that counts.
MIN_AGE, MAX_AGE, GAP = 25, 70, 10


def alive_flags(merged: DataFrame, min_age: int = MIN_AGE, max_age: int = MAX_AGE, first: int | None = None, last: int | None = None) -> DataFrame:
    """F-20, F-21: ``too_young, too_old, after_death, before_active, after_active, any_flag``; unknown years raise none."""
    rows = merged if first is None and last is None else merged.filter(F.col("j").between(first if first is not None else -(2**31), last if last is not None else 2**31 - 1))
    tests = {
        "too_young": F.col("age_at_event") < min_age,
        "too_old": F.col("age_at_event") > max_age,
        "after_death": F.col("j") > F.col("death_year"),
        "before_active": F.col("j") < F.col("min_year"),
        "after_active": F.col("j") > F.col("max_year"),
    }
    flagged = rows.withColumns({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})
    return flagged.withColumn("any_flag", reduce(lambda a, b: a | b, (F.col(n) for n in tests)))


def pattern_frequency(merged: DataFrame) -> DataFrame:
    """A-17."""
    return merged.filter("pattern IS NOT NULL").groupBy("delegate_id", "pattern").agg(F.count("*").alias("n"))


def filled_frequency(merged: DataFrame) -> DataFrame:
    """A-17 as the summary counts: a missing pattern is an empty one."""
    return merged.groupBy("delegate_id", F.coalesce("pattern", F.lit("")).alias("pattern")).agg(F.count("*").alias("n"))


def modal_of(frequency: DataFrame) -> DataFrame:
    """A-03: each person's most frequent pattern of ``(delegate_id, pattern, n)``, the smallest on ties."""
    return frequency.groupBy("delegate_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "pattern")).alias("x")).select("delegate_id", F.col("x.pattern").alias("modal"))


def modal_patterns(merged: DataFrame) -> DataFrame:
    """A-03 of the rows that have a pattern; the summary takes ``modal_of(filled_frequency(...))``."""
    return modal_of(pattern_frequency(merged))


def pattern_anomalies(merged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A-04: rows of each person whose pattern is further than ``threshold`` from the modal one; case counts, a missing pattern is an empty one."""
    return anomalies_of(filled_frequency(merged), threshold).select("delegate_id", "n_pattern_anomalies")


def anomalies_of(frequency: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``delegate_id, modal, n_pattern_anomalies``: the distance is worked out once for each person and pattern and weighted by its rows."""
    both = frequency.join(modal_of(frequency), "delegate_id")
    far = distance(F.col("pattern"), F.col("modal")) > threshold
    return both.groupBy("delegate_id").agg(F.first("modal").alias("modal"), F.sum(F.when(far, F.col("n")).otherwise(0)).alias("n_pattern_anomalies"))


def ghost_patterns(synonyms: DataFrame) -> DataFrame:
    """``delegate_id, ghost, canonical`` of ``synonyms(delegate_id, patterns[2], freq_a, freq_b)``; on a tie the second is the ghost."""
    first = F.col("freq_a") < F.col("freq_b")
    a, b = F.element_at("patterns", 1), F.element_at("patterns", 2)
    return synonyms.select("delegate_id", F.when(first, a).otherwise(b).alias("ghost"), F.when(first, b).otherwise(a).alias("canonical")).distinct()


def max_gaps(merged: DataFrame) -> DataFrame:
    """A-07: the longest step between years in which a person occurs; years are made distinct first."""
    years = merged.filter("j IS NOT NULL").select("delegate_id", "j").distinct()
    w = Window.partitionBy("delegate_id").orderBy("j")
    return years.withColumn("gap", F.col("j") - F.lag("j").over(w)).groupBy("delegate_id").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_years"))


def issue_score() -> Column:
    """A-08: twice the anomalies, twice the alive flags, and a tenth of the gap up to 50 years."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return z("n_pattern_anomalies") * 2 + z("n_alive_flags") * 2 + F.least(z("max_gap_years"), F.lit(50)) / 10


def person_summary(merged: DataFrame, persons: DataFrame, synonyms: DataFrame | None = None, min_age: int = MIN_AGE, max_age: int = MAX_AGE) -> DataFrame:
    """A-01 to A-09: one row for each person of the registry, with or without occurrences.

    ``merged`` is read once: its sums by person, pattern and year are written, and everything comes from them.
    """
    flags = alive_flags(merged, min_age, max_age)
    alive = F.col("too_young") | F.col("too_old") | F.col("after_death")
    small = written(
        flags.groupBy("delegate_id", "pattern", "j").agg(F.count("*").alias("n"), F.count_if(alive).alias("n_alive"), F.count_if("name_mismatch").alias("n_mismatch"))
    )
    sums = small.groupBy("delegate_id").agg(
        F.sum(F.when(F.col("j").isNotNull(), F.col("n")).otherwise(0)).alias("n_occurrences"), F.sum("n").alias("n_rows"), F.min("j").alias("first_year"), F.max("j").alias("last_year"),
        F.count_distinct("pattern").alias("n_patterns"), F.sum("n_alive").alias("n_alive_flags"), F.sum("n_mismatch").alias("n_name_mismatch"),
    )
    frequency = small.groupBy("delegate_id", F.coalesce("pattern", F.lit("")).alias("pattern")).agg(F.sum("n").alias("n"))
    for part in (anomalies_of(frequency), max_gaps(small)):
        sums = sums.join(part, "delegate_id", "left")
    if synonyms is not None:
        ghosts = ghost_patterns(synonyms).groupBy("delegate_id").agg(F.count_distinct("ghost").alias("_g"))
        sums = sums.join(ghosts, "delegate_id", "left").withColumn("n_patterns", F.greatest(F.col("n_patterns") - F.coalesce("_g", F.lit(0)), F.lit(1))).drop("_g")
    names = first_per_key(persons.select("delegate_id", "fullname"), ["delegate_id"])
    counts = ["n_occurrences", "n_rows", "n_patterns", "n_alive_flags", "n_name_mismatch", "n_pattern_anomalies", "max_gap_years"]
    full = names.join(sums, "delegate_id", "left").fillna(0, counts).fillna("", ["modal"])
    return full.withColumn("issue_score", issue_score()).select("delegate_id", "fullname", "n_occurrences", "n_rows", "first_year", "last_year", "n_patterns", "modal", "n_pattern_anomalies", "n_alive_flags", "n_name_mismatch", "max_gap_years", "issue_score")


def suspicious(summary: DataFrame, gap: int = GAP, reviewed: DataFrame | None = None) -> DataFrame:
    """F-15: any alive flag, a long gap, any anomaly, or reviewed."""
    test = (F.col("n_alive_flags") > 0) | (F.col("max_gap_years") >= gap) | (F.col("n_pattern_anomalies") > 0)
    if reviewed is None:
        return summary.filter(test)
    seen = reviewed.select(F.col("delegate_id").alias("_id")).distinct()
    return summary.join(seen, F.col("delegate_id") == F.col("_id"), "left").filter(test | F.col("_id").isNotNull()).drop("_id")


def with_status(summary: DataFrame, corrected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """T-02: ``status_rank``: 0 open, 1 corrected, 2 reviewed."""
    c, r = corrected.select(F.col("delegate_id").alias("_c")).distinct(), reviewed.select(F.col("delegate_id").alias("_r")).distinct()
    both = summary.join(c, F.col("delegate_id") == F.col("_c"), "left").join(r, F.col("delegate_id") == F.col("_r"), "left")
    return both.withColumn("status_rank", F.when(F.col("_r").isNotNull(), 2).when(F.col("_c").isNotNull(), 1).otherwise(0)).drop("_c", "_r")


#: T-01: named orders of the review queue.
SORTS = {
    "queue": ["-issue_score", "status_rank", "fullname"],
    "status": ["status_rank"],
    "id": ["delegate_id"],
    "name": ["fullname"],
    "reviewed": ["-status_rank"],
    "worst": ["-issue_score"],
}


def sort_keys(primary: str, secondary: str | None = None) -> list[Column]:
    """T-01: the second key is sorted last and stably, so it leads; ``queue`` has all its keys. Ties go by id."""
    names = SORTS[primary] if primary == "queue" or secondary is None else [*SORTS[secondary], *SORTS[primary]]
    return [F.col(n[1:]).desc() if n[0] == "-" else F.col(n).asc() for n in [*names, "delegate_id"]]


def page(df: DataFrame, keys: list[Column], number: int, size: int) -> DataFrame:
    """W-13: page ``number`` (from 1), with its places: the first pages are sorted out by a limit, not by all rows."""
    top = df.orderBy(*keys).limit(number * size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys))).filter(F.col("place") > (number - 1) * size)


def pattern_distances(rows: DataFrame) -> DataFrame:
    """D-11: ``row_id, delegate_id, year, part, modal, distance`` of each part of each row's pattern, to the person's modal pattern; case counts."""
    parts = pattern_parts(F.col("pattern"))
    several = F.when(F.size(parts) > 1, parts).otherwise(F.array("pattern"))
    flat = rows.filter("pattern IS NOT NULL").select("row_id", "delegate_id", F.col("j").alias("year"), F.explode(several).alias("part"))
    return flat.join(modal_patterns(rows), "delegate_id").withColumn("distance", F.bround(distance(F.col("part"), F.col("modal")), 3))


def unique_patterns(rows: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """A-10: each person's pattern parts with count, mean distance to the modal pattern, years, and how many rows are corrected."""
    far = pattern_distances(rows)
    done = F.lit(0)
    if corrected is not None:
        far = far.join(corrected.select(F.col("row_id").alias("_r")).distinct(), F.col("row_id") == F.col("_r"), "left")
        done = F.count("_r")
    return far.groupBy("delegate_id", "part").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_distance"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), done.alias("n_corrected"))


def top_rows(df: DataFrame, keys: list[Column | str], n: int) -> DataFrame:
    """T-03, T-04: the first ``n`` rows in an order that must be complete; tasks sort out the rest of theirs first."""
    return df.orderBy(*keys).limit(n)


def distance_histogram(patterns: DataFrame, bins: int = 40) -> DataFrame:
    """A-20: counts of ``mean_distance`` in equal bins of 0 to 1; 1 falls into the last."""
    place = F.least(F.floor(F.col("mean_distance") * bins), F.lit(bins - 1))
    return patterns.groupBy(place.alias("bin")).agg(F.sum("n").alias("n"))


def mismatch_breakdown(merged: DataFrame, top: int = 30) -> DataFrame:
    """A-11, F-22: persons with the most rows whose pattern lacks their surname."""
    return merged.filter("row_name_mismatch").groupBy("delegate_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "delegate_id").limit(top)


def occurrences_by(merged: DataFrame, column: str) -> DataFrame:
    """A-31."""
    return merged.groupBy(column).agg(F.count("*").alias("n"))


def pattern_lists(merged: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """A-19: each person's distinct patterns, sorted and joined by ``;``. With ``persons``: of each of them, the own ``pattern`` where there is none."""
    lists = merged.filter("pattern IS NOT NULL").groupBy("delegate_id").agg(F.array_join(F.sort_array(F.collect_set("pattern")), ";").alias("patterns"))
    if persons is None:
        return lists
    own = F.col("pattern") if "pattern" in persons.columns else F.lit(None).cast("string")
    people = persons.select("delegate_id", own.alias("_own"))
    return people.join(lists, "delegate_id", "left").select("delegate_id", F.coalesce(nullif_blank(F.col("patterns")), F.col("_own")).alias("patterns"))


def escape_audit(df: DataFrame, token: str = "_x000") -> DataFrame:
    """F-24: cells of each string column that hold a control-escape token."""
    strings = [c for c, kind in df.dtypes if kind == "string"]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in strings)))
    return df.select(cells.alias("x")).filter(F.contains("x.value", F.lit(token))).groupBy(F.col("x.column").alias("column")).agg(F.count("*").alias("n"))


def overview(persons: DataFrame, merged: DataFrame, placeholders: DataFrame, remapped: DataFrame, enriched: DataFrame | None = None) -> DataFrame:
    """A-35: ``what, n`` of persons, occurrences, placeholders, remapped rows and enriched persons (``enriched``: A-29's row)."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, df in (("persons", persons), ("occurrences", merged), ("placeholders", placeholders), ("remapped", remapped))]
    if enriched is not None:
        parts.append(enriched.select(F.lit("enriched").alias("what"), F.col("n_enriched").alias("n")))
    return reduce(DataFrame.union, parts)
