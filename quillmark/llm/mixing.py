"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are added up to cells of source, language and topic. The cells' token weights are raked to
the target shares of each of the three in turn, none above what its tokens allow at the budget; a
cell's documents are then drawn with the ratio of its raked weight to its tokens. So a value gets its
share of the budget, or, where it has too few tokens for that, what the other marginals leave of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import common

DIMENSIONS = ("source", "lang", "topic")
#: Production parameters: sweeps over the three marginals, and the share of all tokens to draw.
SWEEPS, BUDGET = 8, 0.75
#: Rounds of the refill's search: each settles the cells that are drawn whole.
CAP_ROUNDS = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shape_topic(text: Column, n_words: Column) -> Column:
    """A topic by the shape of a text: tables, shouting, then by length."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return F.when(10 * bars > n_words, "table").when(2 * capitals > F.length(text), "shouting").when(n_words < 100, "short").when(n_words < 1000, "article").otherwise("long")


def profiled(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens`` (words); null text is empty, null keys are the key ``''``."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"), words.alias("n_tokens"))
    kind = topic if topic is not None else shape_topic(F.col("text"), F.col("n_tokens"))
    return rows.select("doc_id", "source", "lang", F.coalesce(kind, F.lit("")).alias("topic"), "n_tokens")


def tempered(cells: DataFrame, dimension: str) -> DataFrame:
    """Default target weights: the square root of the tokens of each value, so that small ones gain."""
    return cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).select(dimension, F.sqrt(F.col("t").cast("double")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, budget: float | None = None) -> DataFrame:
    """``cells`` with ``weight`` raked to the targets: ``{dimension: (dimension, target)}`` weights, not shares.

    The weights add up to 1 where the targets can be met. With a ``budget`` no cell gets more weight
    than its tokens are of the budget's tokens; what a capped cell leaves is raked onto the others of
    its values in the next steps, so capped and open cells settle together.

    Targets without cells are passed over (the rest are scaled up), values without a target keep no
    weight. Each step adds the weights up by one dimension's value, map-side first, and joins the sums
    back, so a value that most cells share is no single task. A sweep is written before the next one
    begins; there are few cells for any number of documents.
    """
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, t in targets.items():
        present = t.join(cells.select(d).distinct(), d)
        total = present.agg(F.sum("target")).first()[0] or 0.0
        share = present.select(F.col(d).alias("k"), (F.col("target") / F.lit(total) if total else F.lit(0.0)).alias(f"share_{d}"))
        state = state.join(share, F.col(d) == F.col("k"), "left").drop("k")
    state = common.written(state, "targets")
    most = None if budget is None else budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    for _ in range(sweeps):
        before = state
        for d in targets:
            sums = state.groupBy(F.col(d).alias("k")).agg(F.sum("weight").alias("s"))
            factor = F.when(F.col("s") > 0, F.coalesce(f"share_{d}", F.lit(0.0)) / F.col("s")).otherwise(0.0)
            weight = F.col("weight") * factor
            capped = weight if not most else F.least(weight, F.col("tokens") / F.lit(float(most)))
            state = state.join(sums, F.col(d) == F.col("k")).withColumn("weight", capped).drop("k", "s")
        state = common.written(state, "raking")
        common.forget(before)
    return state.select(*DIMENSIONS, "docs", "tokens", "weight")


def calibrated(raked: DataFrame, budget: float = BUDGET, refill: bool = True) -> DataFrame:
    """Raked cells with ``probability``: the weight's tokens at ``budget`` of all tokens by the cell's own, 1 at most.

    What cells leave that are drawn whole goes to all others by one scale (``refill``), so the budget is
    met and the marginals are not; weights that were raked with the budget need no refill.
    """
    cells = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    want = float(budget * (cells.agg(F.sum("tokens")).first()[0] or 0))
    scale = 0.0 if refill else want
    for _ in range(CAP_ROUNDS if refill else 0):
        whole = (F.col("ratio") * F.lit(scale)) >= 1.0
        row = cells.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.when(whole, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if not row["w"]:
            break
        scale = max(scale, (want - row["t"]) / row["w"])
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)))


def shares_drawn(calibrated_cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``dimension, value, target, drawn, tokens``: the share wanted and the expected share drawn of each value, and its tokens."""
    out = None
    total = Window.partitionBy()  # over the values of a dimension, a row each
    for d, t in targets.items():
        sums = calibrated_cells.groupBy(d).agg(F.sum(F.col("probability") * F.col("tokens")).alias("x"), F.sum("tokens").alias("tokens"))
        both = sums.join(t, d, "left").select(F.lit(d).alias("dimension"), F.col(d).alias("value"), (F.coalesce("target", F.lit(0.0)) / F.sum("target").over(total)).alias("target"), (F.col("x") / F.sum("x").over(total)).alias("drawn"), "tokens")
        out = both if out is None else out.unionByName(both)
    return out


def chance(seed: int) -> Column:
    """A number in [0, 1) that depends on seed and document alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cell_probabilities(cells: DataFrame, targets: dict[str, DataFrame] | None, budget: float, sweeps: int) -> DataFrame:
    cells = common.written(cells, "cells")
    chosen = {d: (targets or {}).get(d) for d in DIMENSIONS}
    raked = rake(cells, {d: tempered(cells, d) if t is None else t for d, t in chosen.items()}, sweeps, budget)
    drawn = common.written(calibrated(raked, budget, refill=False).select(*(F.col(d).alias(f"c_{d}") for d in DIMENSIONS), "probability"), "drawn")
    common.forget(cells)
    return drawn


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def sample_documents(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, seed: int = 17) -> DataFrame:
    """The drawn rows of ``docs``, all columns; the same draw as ``mix``. Texts are not shuffled where the cells are few."""
    drawn = _cell_probabilities(_cells(profiled(docs)), targets, budget, sweeps)
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    keys = F.struct(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), shape_topic(text, words).alias("topic"))
    rows = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"), keys.alias("k"), chance(seed).alias("u"))
    on = [F.col(f"k.{d}") == F.col(f"c_{d}") for d in DIMENSIONS]
    return rows.join(drawn, on[0] & on[1] & on[2]).filter("u < probability").select("row.*")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, topic: Column | None = None, seed: int = 17) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability_ppm, sampled`` of each document.

    ``targets`` maps dimensions to ``(value, target)`` frames; those not given are ``tempered``. Null
    sources and languages are the value ``''``; null or empty text has no tokens and is drawn if its
    cell has weight. Rows with equal ids are drawn or left together; null ids have one chance in
    common. An empty table gives no rows. Other columns are not read.
    """
    rows = common.written(profiled(docs, topic), "profiled")
    drawn = _cell_probabilities(_cells(rows), targets, budget, sweeps)
    on = [F.col(d) == F.col(f"c_{d}") for d in DIMENSIONS]
    both = rows.join(drawn, on[0] & on[1] & on[2], "left").withColumn("p", F.coalesce("probability", F.lit(0.0)))
    return both.select("doc_id", *DIMENSIONS, "n_tokens", F.floor(F.col("p") * 1e6 + 0.5).cast("long").alias("probability_ppm"), (chance(seed) < F.col("p")).alias("sampled"))


def oracle_sql(budget: float = BUDGET, sweeps: int = SWEEPS, seed: int = 17) -> str:
    """DuckDB SQL of ``mix`` over ``documents`` with the production parameters."""
    parts = [
        f"""rows_ AS MATERIALIZED (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN 10 * bars > n_tokens THEN 'table' WHEN 2 * capitals > chars THEN 'shouting'
    WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, length(text) AS chars,
          length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(translate(text, '{_UPPER}', '')) AS capitals,
          len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens
        FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)))""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM rows_ GROUP BY ALL)",
        f"most AS MATERIALIZED (SELECT {budget} * sum(tokens) AS m FROM w0)",
    ]
    for d in DIMENSIONS:
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, sqrt(t) / sum(sqrt(t)) OVER () AS share FROM (SELECT {d}, sum(tokens)::DOUBLE AS t FROM w0 GROUP BY ALL))")
    n = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(CASE WHEN s > 0 THEN weight * (share / s) ELSE 0 END, tokens / m) AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {d}) AS s FROM w{n}) JOIN t_{d} USING ({d}), most)")
            n += 1
    parts.append(f"cells AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens * m ELSE 0 END AS ratio FROM w{n}, most)")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, source, lang, topic, n_tokens, floor(p * 1e6 + 0.5)::BIGINT AS probability_ppm,
  ('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT / {float(1 << 52)!r} < p AS sampled
FROM (SELECT r.*, least(1.0, ratio) AS p FROM rows_ r JOIN cells USING (source, lang, topic))
"""
