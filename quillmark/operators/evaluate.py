"""Labels, threshold sweeps, descriptions and samples of scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import normalise


def majority_label(labels: DataFrame) -> DataFrame:
    """A-25: the label with most votes of each pattern, the smallest on ties."""
    votes = labels.groupBy("pattern", "label").agg(F.count("*").alias("n"))
    most = votes.groupBy("pattern").agg(F.max("n").alias("m")).withColumnRenamed("pattern", "_p")
    return votes.join(most, (F.col("pattern") == F.col("_p")) & (F.col("n") == F.col("m"))).groupBy("pattern").agg(F.min("label").alias("label"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """A-26: confusion counts of ``score <= threshold`` against ``label`` for each threshold.

    One aggregation with four counts a threshold; the rows are read once and never multiplied.
    """
    aggs = []
    for i, t in enumerate(thresholds):
        hit, true = F.col("score") <= t, F.col("label")
        aggs += [F.count_if(hit & true).alias(f"tp{i}"), F.count_if(hit & ~true).alias(f"fp{i}"), F.count_if(~hit & true).alias(f"fn{i}"), F.count_if(~hit & ~true).alias(f"tn{i}")]
    row = scored.agg(*aggs)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(thresholds))))
    return row.select(each.alias("s")).select("s.*")


def with_rates(sweep: DataFrame) -> DataFrame:
    """A-26: precision, recall and F1, null where undefined."""
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return sweep.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """A-26: the threshold with the highest F1, the lowest on ties."""
    return with_rates(sweep).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def candidates_by_threshold(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """A-28."""
    row = scored.agg(*(F.count_if(F.col("score") <= t).alias(f"n{i}") for i, t in enumerate(thresholds)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(thresholds)))).alias("s")).select("s.*")


#: Scores are told apart by so many parts of 1 where quantiles are taken.
PARTS = 10_000


def _part(score: Column) -> Column:
    return F.bround(score * PARTS).cast("long")


def describe_scores(scored: DataFrame, by: str = "label") -> DataFrame:
    """A-27. Quartiles come from counts of scores in steps of 1 / ``PARTS``, which merge, so they are off by half a step at most; the rest is exact."""
    sums = scored.groupBy(by, _part(F.col("score")).alias("_p")).agg(F.count("*").alias("_rows"), F.count("score").alias("_n"), F.sum("score").alias("_s"), F.min("score").alias("_low"), F.max("score").alias("_high"))
    q = lambda p: F.percentile("_p", F.lit(p), F.col("_n")) / PARTS
    return sums.groupBy(by).agg(F.sum("_rows").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"), F.min("_low").alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("_high").alias("max"))


def ambiguous_zone(scored: DataFrame, low: float, high: float) -> DataFrame:
    """F-29: one row for each pattern whose score lies between; the lowest id stands for it."""
    return scored.filter(F.col("score").between(low, high)).groupBy("pattern", "score").agg(F.min("delegate_id").alias("delegate_id"))


def stratified_sample(zone: DataFrame, size: int, labelled: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """W-12: about ``size`` rows of ``zone(pattern, score, ...)``, from each quartile of the score in proportion, a fifth of each for testing.

    A quartile gives ``max(1, round(size * its share))`` rows: those with the smallest hashes of seed and
    pattern, so the draw repeats exactly. Each task keeps its ``size`` smallest of a quartile and no more,
    which is all that can be drawn. Quartiles are taken as in ``describe_scores``; equal bounds merge
    quartiles. Patterns that are labelled already are left out, compared without case and extra spaces.
    ``split`` is ``test`` for the first fifth (rounded) of a quartile's draw, else ``train``.
    """
    rows = zone.filter("score IS NOT NULL").withColumn("_p", _part(F.col("score")))
    if labelled is not None:
        done = labelled.select(normalise(F.col("pattern")).alias("_k")).distinct()
        rows = rows.join(done, normalise(F.col("pattern")) == F.col("_k"), "left_anti")
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    found = counts.agg(F.percentile("_p", [0.25, 0.5, 0.75], F.col("_n")).alias("cuts"), F.sum("_n").alias("n")).first()  # four numbers
    quarter = sum(((F.col("_p") > c).cast("int") for c in found["cuts"] or []), F.lit(1))
    shares = counts.groupBy(quarter.alias("_q")).agg(F.greatest(F.lit(1), F.bround(size * F.sum("_n") / F.lit(found["n"] or 1)).cast("int")).alias("_take"))
    w = Window.partitionBy("quartile").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "pattern")), "pattern", "score")
    few = rows.withColumn("quartile", quarter).drop("_p").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(1, size))
    picked = few.join(shares, F.col("quartile") == F.col("_q")).filter(F.col("place") <= F.col("_take"))
    return picked.withColumn("split", F.when(F.col("place") <= F.bround(F.col("_take") * 0.2), "test").otherwise("train")).drop("_q", "_take")


def labelling_sample(scored: DataFrame, low: float, high: float, size: int, names: DataFrame, anchors: DataFrame, labelled: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """D-12: the training part of a sample of the ambiguous zone, with each person's name and anchor, and no label yet."""
    picked = stratified_sample(ambiguous_zone(scored, low, high), size, labelled, seed).filter("split = 'train'")
    named = picked.join(names.select("delegate_id", F.col("fullname").alias("delegate_name")), "delegate_id", "left").join(anchors.select("delegate_id", "anchor"), "delegate_id", "left")
    return named.select("pattern", "anchor", "delegate_id", "delegate_name", F.col("score").alias("compound_score"), "quartile", F.lit("").alias("label"))


def false_negatives(rejected: DataFrame, truth: DataFrame) -> DataFrame:
    """S-J29: rejected candidates with their true label by normalised pattern: ``outcome`` is false_negative, right or unlabelled."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(F.col(c))), r"\s+", " ")
    known = truth.groupBy(key("pattern").alias("_k")).agg(F.max("label").alias("_label"))
    both = rejected.withColumn("_key", key("pattern")).join(known, F.col("_key") == F.col("_k"), "left")
    return both.withColumn("outcome", F.when(F.col("_label").isNull(), "unlabelled").when(F.col("_label"), "false_negative").otherwise("right")).drop("_key", "_k", "_label")


def scorer_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U-03, D-08: keys that only one of two scorers accepts."""
    only = lambda x, y, side: x.select(*keys).distinct().join(y.select(*keys), keys, "left_anti").withColumn("only_in", F.lit(side))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def known_cases(spark: SparkSession) -> DataFrame:
    """D-08: fused names and the anchors they hold."""
    # Fixed values.
    rows = [
        ("vanden Bempden Van Hoorn", "vanden bempden", "van hoorn"),
        ("Changuion Geelvinck", "changuion", "geelvinck"),
        ("Ubingh Sminia", "ubingh", "sminia"),
        ("d'Ablaing van Giessenburgh", "d'ablaing", "van giessenburgh"),
    ]
    return spark.createDataFrame(rows, "pattern string, left_anchor string, right_anchor string")
