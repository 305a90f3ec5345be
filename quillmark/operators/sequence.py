"""Order within a day, neighbours, gaps and co-occurrence. Ranks of a day are counted in two levels, windows run over blocks of a day or by person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import province_rank
from quillmark.functions.steps import written


#: Ranks of a day that stand in one task of a sliding window.
BLOCK = 4096


def _order() -> list[Column]:
    """The order within a day: by offset, nulls last, then by row."""
    return [F.col("offset_").asc_nulls_last(), F.col("row_id").asc()]


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of (day, place in the day) and written, with the range as ``_chunk``: a crowded day spreads over many tasks."""
    return written(rows.repartitionByRange("date", *_order()).withColumn("_chunk", F.spark_partition_id()))


def _before(chunked: DataFrame, *keys: str) -> DataFrame:
    """``_ahead`` of each (keys, chunk): rows with the same keys in earlier chunks. There is one row for each, however many rows a chunk has."""
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_ahead"))


def _ranked(chunked: DataFrame, name: str, *keys: str) -> DataFrame:
    """The rank, from 1, of each row among those with its keys: the place in its chunk and what stands in chunks before it."""
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*_order()))
    ahead = _before(chunked, *keys).select(*(F.col(k).alias(f"_k_{k}") for k in (*keys, "_chunk")), "_ahead")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_chunk")]
    return chunked.withColumn("_local", local).join(ahead, same).withColumn(name, (F.col("_local") + F.col("_ahead")).cast("int")).drop("_local", "_ahead", *(f"_k_{k}" for k in (*keys, "_chunk")))


def day_positions(occurrences: DataFrame) -> DataFrame:
    """W-07: ``rank`` in the day from 0, by offset (nulls last) and row; rows without a date are left out. No day is ever sorted by one task."""
    chunked = _chunked(occurrences.filter("date IS NOT NULL"))
    return _ranked(chunked, "rank", "date").withColumn("rank", F.col("rank") - 1).drop("_chunk")


def day_order(occurrences: DataFrame, order: DataFrame, province: str = "namens") -> DataFrame:
    """W-01 to W-04: actual and expected position of each row in its day and their distance.

    The expected position is the rank within the row's province, in the actual order, after all rows of the
    day's provinces that stand before it.
    """
    chunked = _chunked(province_rank(occurrences.filter("date IS NOT NULL"), order, province))
    placed = _ranked(_ranked(chunked, "actual_pos", "date"), "_inside", "date", "prov_rank")
    sizes = chunked.groupBy(F.col("date").alias("_d"), F.col("prov_rank").alias("_p")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_d").orderBy(F.col("_p").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_d", "_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_skip"))
    both = placed.join(sizes, (F.col("date") == F.col("_d")) & F.col("prov_rank").eqNullSafe(F.col("_p")))
    expected = (F.col("_inside") + F.col("_skip")).cast("int")
    return both.withColumn("expected_pos", expected).withColumn("pos_diff", F.abs(F.col("actual_pos") - F.col("expected_pos"))).drop("_chunk", "_inside", "_d", "_p", "_skip")


def _blocks(positions: DataFrame, window: int) -> DataFrame:
    """Each row in its block of ``BLOCK`` ranks (``_own``), and beside the border of a block in the next one as well."""
    block = F.floor(F.col("rank") / F.lit(max(BLOCK, window)))
    inside = F.col("rank") % F.lit(max(BLOCK, window))
    near = F.array(F.when(inside < window, block - 1), block, F.when(inside >= max(BLOCK, window) - window, block + 1))
    return positions.withColumn("_block", F.explode(F.array_compact(near))).withColumn("_own", F.col("_block") == block)


def violations(ordered: DataFrame, least: int) -> DataFrame:
    """F-28."""
    return ordered.filter(F.col("pos_diff") >= least)


def violations_by_province(ordered: DataFrame, least: int, province: str = "namens") -> DataFrame:
    """A-12, with the exact sum beside the mean."""
    found = violations(ordered, least)
    return found.groupBy(province).agg(F.count("*").alias("n"), F.sum("pos_diff").alias("sum_diff"), F.avg("pos_diff").alias("mean_diff"))


def day_counts(ordered: DataFrame, least: int) -> DataFrame:
    """A-13: all days and days with a violation, one row."""
    return ordered.agg(F.count_distinct("date").alias("n_days"), F.count_distinct(F.when(F.col("pos_diff") >= least, F.col("date"))).alias("n_bad_days"))


def day_roster(ordered: DataFrame, rows: DataFrame) -> DataFrame:
    """W-05: all rows of the days that ``rows`` are on."""
    return ordered.join(rows.select("date").distinct(), "date", "left_semi")


def neighbours(positions: DataFrame, window: int = 2, in_scope: DataFrame | None = None) -> DataFrame:
    """S-J16: ``row_id, neighbour_id, neighbour_person, delta`` within ``window`` ranks of the same day.

    Ranks are of all rows; ``in_scope(row_id)`` limits which rows may be neighbours. A range of the day's
    window gives each row 2 * window others at most, so no day is ever paired with itself.
    """
    w = Window.partitionBy("date", "_block").orderBy("rank").rowsBetween(-window, window)
    packed = F.collect_list(F.struct("rank", F.col("row_id").alias("id"), F.col("delegate_id").alias("person"))).over(w)
    flat = _blocks(positions, window).select("row_id", "rank", "_own", packed.alias("near")).filter("_own").select("row_id", "rank", F.explode("near").alias("x"))
    out = flat.filter("x.id <> row_id").select("row_id", F.col("x.id").alias("neighbour_id"), F.col("x.person").alias("neighbour_person"), (F.col("x.rank") - F.col("rank")).alias("delta"))
    return out if in_scope is None else out.join(in_scope.select(F.col("row_id").alias("neighbour_id")), "neighbour_id", "left_semi")


def day_context(positions: DataFrame, rows: DataFrame, window: int = 5) -> DataFrame:
    """W-08: the rows within ``window`` ranks of the given rows, themselves included."""
    centre = rows.select("row_id").join(positions, "row_id").select(F.col("row_id").alias("centre_id"), F.col("date").alias("c_date"), F.explode(F.sequence(F.col("rank") - window, F.col("rank") + window)).alias("c_rank"))
    return centre.join(positions, (F.col("c_date") == F.col("date")) & (F.col("c_rank") == F.col("rank"))).drop("c_date", "c_rank")


def _following(positions: DataFrame, window: int, *columns: str) -> DataFrame:
    """``me, other``: each row with each of the ``window`` rows after it in its day, as structs of ``columns``. A pair of rows is there once."""
    w = Window.partitionBy("date", "_block").orderBy("rank")
    kept = _blocks(positions.select("date", "rank", F.struct(*columns).alias("me")), window)
    after = F.array_compact(F.array(*(F.lead("me", i).over(w) for i in range(1, window + 1)))).alias("after")
    return kept.select("me", "_own", after).filter("_own").select("me", F.explode("after").alias("other"))


def cooccurrence(positions: DataFrame, window: int = 5) -> DataFrame:
    """S-J17: how often person ``b`` stands within ``window`` ranks of person ``a``, not counting themselves.

    Both see each other equally often, so a pair is counted once, with the smaller id first, and given both ways at the end.
    """
    a, b = F.col("me.delegate_id"), F.col("other.delegate_id")
    pairs = _following(positions, window, "delegate_id").filter(a != b).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    counts = pairs.groupBy("lo", "hi").agg(F.count("*").alias("n"))
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return counts.select(F.explode(F.array(way("lo", "hi"), way("hi", "lo"))).alias("p"), "n").select("p.a", "p.b", "n")


def ever_near(positions: DataFrame, persons: DataFrame, window: int = 5) -> DataFrame:
    """``delegate_id, near``: who ever stood within ``window`` ranks of each of ``persons(delegate_id)``; pairs of others are never made."""
    asked = persons.select("delegate_id").distinct().withColumn("_asked", F.lit(True))
    pairs = _following(positions.select("date", "rank", "delegate_id").join(asked, "delegate_id", "left"), window, "delegate_id", "_asked")
    way = lambda x, y: F.when(F.col(f"{x}._asked"), F.struct(F.col(f"{x}.delegate_id").alias("delegate_id"), F.col(f"{y}.delegate_id").alias("near")))
    both = pairs.filter("me.delegate_id <> other.delegate_id").select(F.explode(F.array_compact(F.array(way("me", "other"), way("other", "me")))).alias("p"))
    return both.select("p.delegate_id", "p.near").distinct()


def timeline_gaps(merged: DataFrame, longer: int = 10) -> DataFrame:
    """W-06: gaps of more than ``longer`` years of a person, with both boundary rows."""
    w = Window.partitionBy("delegate_id").orderBy("j", "row_id")
    steps = merged.filter("j IS NOT NULL").select("delegate_id", F.lag("j").over(w).alias("from_year"), F.col("j").alias("to_year"), F.lag("row_id").over(w).alias("from_row"), F.col("row_id").alias("to_row"))
    return steps.withColumn("gap", F.col("to_year") - F.col("from_year")).filter(F.col("gap") > longer)


def persons_with_gaps(gaps: DataFrame) -> DataFrame:
    """A-36."""
    return gaps.agg(F.count_distinct("delegate_id").alias("n_persons"))
