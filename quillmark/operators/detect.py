"""Names that were fused with a neighbour's or split in two, found by edit distance to known patterns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.columns import distance, length_ratio, normalise, pattern_parts, split_points, word_halves
from quillmark.functions.names import is_infix_only, is_session_header, strip_infix
from quillmark.functions.steps import written
from quillmark.operators.registry import first_per_key
from quillmark.operators.sequence import day_positions, ever_near, neighbours
from quillmark.operators.signals import ghost_patterns, modal_patterns, pattern_frequency

# Thresholds of the detectors.
T_CONCAT, T_FRAGMENT, T_COMPOUND = 0.35, 0.15, 0.25
MIN_LENGTH_RATIO, FRAGMENT_LENGTH, MIN_PATTERNS, WINDOW = 1.4, 0.75, 3, 2
#: Edits under which nearest anchors are looked for by index, rising.
EDITS = (0, 1)


class Anchors(NamedTuple):
    """D-01's frames, each by ``delegate_id``; ``positions`` by row."""

    anchors: DataFrame
    modals: DataFrame
    patterns: DataFrame
    positions: DataFrame


def is_president(df: DataFrame) -> Column:
    """F-14: by class, else by a negative offset."""
    if "class" in df.columns:
        return F.coalesce(F.lower("class") == "president", F.lit(False))
    return F.coalesce(F.col("offset_"), F.lit(0)) < 0


def clean_rows(merged: DataFrame) -> DataFrame:
    """Rows that name a person: no null pattern, session header or president."""
    return merged.filter(F.col("pattern").isNotNull() & ~is_session_header(F.col("pattern")) & ~is_president(merged))


def anchor_table(merged: DataFrame, synonyms: DataFrame | None = None) -> Anchors:
    """D-01. Ghost patterns count as their canonical ones; positions are of all rows. Persist the frames if several jobs use them."""
    rows = clean_rows(merged)
    if synonyms is not None:
        ghosts = first_per_key(ghost_patterns(synonyms), ["delegate_id", "ghost"]).select(F.col("delegate_id").alias("_id"), "ghost", "canonical")
        both = rows.join(ghosts, (F.col("delegate_id") == F.col("_id")) & (F.col("pattern") == F.col("ghost")), "left")
        rows = both.withColumn("pattern", F.coalesce("canonical", "pattern")).drop("_id", "ghost", "canonical")
    modals = modal_patterns(rows)
    anchors = modals.select("delegate_id", normalise(F.col("modal")).alias("anchor"))
    patterns = rows.select("delegate_id", normalise(F.col("pattern")).alias("pattern")).distinct()
    return Anchors(anchors, modals, patterns, day_positions(merged))


def in_scope(merged: DataFrame, province: str | None = None, first: int | None = None, last: int | None = None, column: str = "namens") -> DataFrame:
    """F-12: province without case, years between bounds; a null year is out of any bound."""
    out = merged if province is None else merged.filter(F.lower(column) == province.lower())
    return out if first is None and last is None else out.filter(F.col("j").between(first if first is not None else -(2**31), last if last is not None else 2**31 - 1))


def concat_prefilter(rows: DataFrame, anchors: DataFrame, ratio: float = MIN_LENGTH_RATIO) -> DataFrame:
    """F-25: clean rows whose pattern may hold two names: long for the anchor, or with more spaces and no shorter. A missing anchor has length 1."""
    both = clean_rows(rows).select("row_id", "delegate_id", F.col("pattern").alias("raw"), normalise(F.col("pattern")).alias("pattern")).join(anchors, "delegate_id", "left")
    n, a = F.length("pattern"), F.coalesce(F.length("anchor"), F.lit(1))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    extra = (spaces(F.col("pattern")) > F.coalesce(spaces(F.col("anchor")), F.lit(0))) & (n >= a)
    return both.filter(((n >= ratio * a) | extra) & (n >= 6))


def funnel(merged: DataFrame, anchors: DataFrame) -> DataFrame:
    """F-26: rows, clean rows, long enough rows and candidates, one row."""
    flagged = merged.select("row_id", "pattern", (F.col("pattern").isNotNull() & ~is_session_header(F.col("pattern")) & ~is_president(merged)).alias("clean"))
    found = concat_prefilter(merged, anchors).select(F.col("row_id").alias("_r"))
    both = flagged.join(found, F.col("row_id") == F.col("_r"), "left")
    return both.agg(F.count("*").alias("n_rows"), F.count_if("clean").alias("n_clean"), F.count_if(F.col("clean") & (F.length("pattern") >= 6)).alias("n_long"), F.count("_r").alias("n_candidates"))


def _least(a: Column, b: Column, strip: bool) -> Column:
    """Distance of two names, whole or (if ``strip``) without their infixes, whichever is less."""
    raw = distance(a, b)
    return F.least(raw, distance(strip_infix(a), strip_infix(b))) if strip else raw


def _forms(df: DataFrame, column: str, strip: bool) -> DataFrame:
    """``df`` with a row for each form of a name: ``kind`` (whole or bare), ``form`` and its ``len``; a name without a bare form has only one."""
    whole = F.struct(F.lit("whole").alias("kind"), F.col(column).alias("form"))
    bare = F.struct(F.lit("bare").alias("kind"), strip_infix(F.col(column)).alias("form"))
    flat = df.withColumn("f", F.explode(F.array(whole, bare) if strip else F.array(whole)))
    return flat.select(*df.columns, F.col("f.kind").alias("kind"), F.col("f.form").alias("form"), F.length("f.form").alias("len")).filter("kind = 'whole' OR len > 0")


def _near(asked: DataFrame, known: DataFrame, on: list[str], within: float) -> DataFrame:
    """``asked`` joined to ``known(on, kind, known, known_len)`` where the forms of a kind are ``within`` apart at most, with the distance ``s``.

    Forms whose lengths alone put them further apart aren't compared, and a comparison stops at the bound.
    """
    longest = F.greatest("len", "known_len")
    both = asked.join(known, [*on, "kind"]).filter(F.abs(F.col("len") - F.col("known_len")) <= within * longest)
    both = both.withColumn("most", F.floor(within * longest + 1e-9).cast("int"))
    return both.withColumn("d", F.expr("levenshtein(form, known, most)")).filter("d >= 0").withColumn("s", F.when(longest == 0, F.lit(0.0)).otherwise(F.col("d") / longest)).filter(F.col("s") <= within)


def _sides(df: DataFrame) -> DataFrame:
    """``df`` with the two halves of ``pattern`` at ``split``."""
    p = F.col("pattern")
    return df.withColumn("left", F.trim(F.substring(p, F.lit(1), F.col("split")))).withColumn("right", F.trim(F.substring(p, F.col("split") + 1, F.length(p))))


def _halves(df: DataFrame) -> DataFrame:
    """Each row with the splits of its ``pattern`` into two halves of three characters or more."""
    return _sides(df.withColumn("split", F.explode(split_points(F.col("pattern"))))).filter((F.length("left") >= 3) & (F.length("right") >= 3))


def _candidate_neighbours(candidates: DataFrame, positions: DataFrame, window: int, scope: DataFrame) -> DataFrame:
    """``row_id, person, delta``: other persons within ``window`` ranks of each candidate, each at the first place where it stands."""
    steps = F.explode(F.array(*(F.lit(d) for d in range(-window, window + 1) if d))).alias("delta")
    asked = candidates.select("row_id", F.col("delegate_id").alias("own")).join(positions.select("row_id", "date", "rank"), "row_id").select("row_id", "own", "date", "rank", steps)
    there = positions.join(scope.select("row_id"), "row_id", "left_semi").select("date", F.col("rank").alias("rank_near"), F.col("delegate_id").alias("person"))
    met = asked.withColumn("rank_near", F.col("rank") + F.col("delta")).join(there, ["date", "rank_near"]).filter("person IS NOT NULL AND person <> own")
    return met.groupBy("row_id", "person").agg(F.min("delta").alias("delta"))


def detect_concat(merged: DataFrame, table: Anchors, scope: DataFrame | None = None, t_concat: float = T_CONCAT, t_compound: float = T_COMPOUND, window: int = WINDOW, ratio: float = MIN_LENGTH_RATIO, strip: bool = True, compound_against: str = "anchor") -> tuple[DataFrame, DataFrame]:
    """D-02: (found, rejected), a row for each pattern and person (W-09).

    ``found``: the best split; ``rejected``: the reason of the pattern's first row that has one. Each
    half is scored against the known patterns of each neighbour, whole against whole and bare against
    bare, once for each pattern and neighbour and not for each row; only the best neighbour of a half
    counts (ties: the one that stands first). Case A: the best neighbours of the two halves differ;
    B: the left half is the person's own anchor; C: the right half is. Each half may be ``t_concat``
    away; the score is the mean. Ties: earliest split, then A before B before C, then the earlier row.
    """
    ready = _prepared(merged, table, merged if scope is None else scope, t_concat, t_compound, window, ratio, [strip], compound_against)
    return _judged(merged, ready, strip, t_concat)


class _Ready(NamedTuple):
    """What the scorers share: candidate rows without a neighbour and with one, who stands near the latter, and the halves of each (pattern, person) that are near, with both scores."""

    lonely: DataFrame
    rest: DataFrame
    near: DataFrame
    scores: DataFrame


def _reject(df: DataFrame, why: str) -> DataFrame:
    return df.select("row_id", "delegate_id", F.col("raw").alias("pattern"), F.coalesce("anchor", F.lit("")).alias("anchor"), F.lit(why).alias("reason"))


def _prepared(merged: DataFrame, table: Anchors, rows: DataFrame, t_concat: float, t_compound: float, window: int, ratio: float, strips: list[bool], compound_against: str) -> _Ready:
    """One pass over candidates, neighbours and halves for all ``strips``; ``rest`` has ``compound_whole`` and ``compound_any``, ``scores`` has ``s_whole`` and ``s_any``."""
    table = table._replace(anchors=written(table.anchors), patterns=written(table.patterns), positions=written(table.positions.select("row_id", "date", "rank", "delegate_id")))
    candidates = written(concat_prefilter(rows, table.anchors, ratio))
    known = table.patterns.filter("pattern <> ''").select(F.col("delegate_id").alias("person"), F.col("pattern").alias("name"))
    near = _candidate_neighbours(candidates, table.positions, window, rows).join(known.select("person").distinct(), "person", "left_semi")
    near = written(near)
    lonely = _reject(candidates.join(near.select("row_id"), "row_id", "left_anti"), "no_neighbors")
    rest = candidates.join(near.select("row_id").distinct(), "row_id", "left_semi")

    own = table.patterns.withColumnRenamed("pattern", "own_pattern")
    against = {"anchor": F.col("own_pattern") == F.col("anchor"), "other_patterns": F.col("own_pattern") != F.col("pattern"), "all": F.lit(True)}[compound_against]
    pairs = rest.select("delegate_id", "pattern", "anchor").distinct().join(own, "delegate_id").filter(against)
    within = lambda strip: F.max(_least(F.col("pattern"), F.col("own_pattern"), strip) <= t_compound)
    compound = pairs.groupBy("delegate_id", "pattern").agg(within(False).alias("compound_whole"), within(True).alias("compound_any"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("compound_whole", "compound_any")]
    rest = written(rest.join(compound, ["delegate_id", "pattern"], "left").select(*rest.columns, *flags))
    # What is compound by whole names is so by bare ones, too: the rows that are open to a scorer of whole names hold all others.
    open_ = rest.filter("NOT compound_any" if strips == [True] else "NOT compound_whole")
    met = written(open_.select("row_id", "pattern").join(near, "row_id"))
    return _Ready(lonely, rest, met, written(_near_halves(met, known, t_concat)))


def _near_halves(met: DataFrame, known: DataFrame, within: float) -> DataFrame:
    """``person, pattern, hits(split, side, s_whole, s_any)``: the halves of each pattern that are near a name of the person, whole or in any form.

    A pattern is cut once and meets a person once and by name; its halves part only then, inside the task,
    and what is too far apart goes no further. So halves without a hit are never shuffled.
    """
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("half")), F.struct(F.lit("r").alias("side"), F.col("right").alias("half")))).alias("x")
    cut = _halves(met.select("pattern").distinct()).select("pattern", "split", sides).select("pattern", F.struct("split", "x.side", "x.half", strip_infix(F.col("x.half")).alias("bare")).alias("h"))
    cut = written(cut.groupBy(F.col("pattern").alias("_p")).agg(F.collect_list("h").alias("halves")))
    names = known.select("person", "name", strip_infix(F.col("name")).alias("bare_name"))
    pairs = met.select("person", "pattern").distinct().join(names, "person")
    # Few bytes are much work here, so the pairs are dealt to all tasks, a crowded person's too.
    pairs = pairs.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "person", "pattern", "name")
    flat = pairs.join(cut, F.col("pattern") == F.col("_p")).select("person", "pattern", "name", "bare_name", F.explode("halves").alias("h")).select("person", "pattern", "name", "bare_name", "h.*")

    def edits(a: str, b: str) -> Column:
        """Edits between two texts, negative or null if that is too many; texts whose lengths alone make it so aren't compared."""
        longest = F.greatest(F.length(a), F.length(b))
        most = F.floor(within * longest + 1e-9).cast("int")
        return F.when(F.abs(F.length(a) - F.length(b)) <= within * longest, F.call_function("levenshtein", F.col(a), F.col(b), most))

    def share(d: str, a: str, b: str) -> Column:
        s = F.when(F.col(d) >= 0, F.col(d) / F.greatest(F.length(a), F.length(b)))
        return F.when(s <= within, s)

    # Where nothing was stripped, the bare texts are the whole ones and need no second comparison.
    stripped = (F.col("bare") != F.col("half")) | (F.col("bare_name") != F.col("name"))
    bare = F.when(stripped & (F.length("bare") > 0) & (F.length("bare_name") > 0), edits("bare", "bare_name"))
    near = flat.withColumn("d_whole", edits("half", "name")).withColumn("d_bare", bare).filter("d_whole >= 0 OR d_bare >= 0")
    scored = near.withColumn("s_whole", share("d_whole", "half", "name")).withColumn("s_any", F.least("s_whole", share("d_bare", "bare", "bare_name"))).filter("s_any IS NOT NULL")
    hits = scored.select("person", "pattern", "split", "side", "s_whole", "s_any").repartition("person", "pattern").groupBy("person", "pattern", "split", "side").agg(F.min("s_whole").alias("s_whole"), F.min("s_any").alias("s_any"))
    return hits.groupBy("person", "pattern").agg(F.collect_list(F.struct("split", "side", "s_whole", "s_any")).alias("hits"))


def _judged(merged: DataFrame, ready: _Ready, strip: bool, t_concat: float) -> tuple[DataFrame, DataFrame]:
    """(found, rejected) by one scorer."""
    form = "any" if strip else "whole"
    columns = [c for c in ready.rest.columns if not c.startswith("compound_")]
    spared = _reject(ready.rest.filter(f"compound_{form}"), "compound_name")
    open_ = written(ready.rest.filter(f"NOT compound_{form}").select(*columns))
    hits = ready.near.join(ready.scores, ["person", "pattern"]).select("row_id", "delta", "person", F.explode("hits").alias("h"))
    hits = hits.select("row_id", "h.split", "h.side", F.struct(F.col(f"h.s_{form}").alias("s"), "delta", "person").alias("n")).filter("n.s IS NOT NULL")
    one = lambda side: F.min(F.when(F.col("side") == side, F.col("n")))
    by_split = hits.repartition("row_id").groupBy("row_id", "split").agg(one("l").alias("l"), one("r").alias("r"))
    by_split = _sides(by_split.join(open_, "row_id"))
    # A split without any neighbour can't be a candidate: all three cases need one.
    own_score = lambda c: F.when(F.coalesce("anchor", F.lit("")) == "", F.lit(1.0)).otherwise(_least(F.col(c), F.col("anchor"), strip))
    flat = by_split.withColumn("own_l", own_score("left")).withColumn("own_r", own_score("right"))
    option = lambda case, ls, rs, lp, rp: F.struct(((ls + rs) / 2).alias("score"), F.col("split").alias("split"), F.lit(case).alias("case"), ls.alias("ls"), rs.alias("rs"), lp.alias("lp"), rp.alias("rp"), F.col("left").alias("left"), F.col("right").alias("right"))
    l, r, me = F.col("l"), F.col("r"), F.col("delegate_id")
    cases = F.array(
        F.when(l.isNotNull() & r.isNotNull() & (l["person"] != r["person"]), option("A", l["s"], r["s"], l["person"], r["person"])),
        F.when((F.col("own_l") <= t_concat) & r.isNotNull(), option("B", F.col("own_l"), r["s"], me, r["person"])),
        F.when((F.col("own_r") <= t_concat) & l.isNotNull(), option("C", l["s"], F.col("own_r"), l["person"], me)),
    )
    best = flat.withColumn("b", F.array_min(F.filter(cases, lambda x: x.isNotNull()))).filter("b IS NOT NULL").groupBy("row_id").agg(F.min("b").alias("b"))
    best = written(best)
    named = best.join(open_, "row_id")
    found = named.groupBy("delegate_id", F.col("raw").alias("pattern")).agg(F.min(F.struct(F.col("b.score").alias("score"), F.col("row_id"), F.col("b"), F.coalesce("anchor", F.lit("")).alias("anchor"))).alias("x"))
    counts = merged.filter("pattern IS NOT NULL").groupBy("delegate_id", "pattern").agg(F.count("*").alias("n_occurrences"))
    found = found.join(counts, ["delegate_id", "pattern"], "left").select(
        "pattern", "delegate_id", F.col("x.row_id").alias("row_id"), F.col("x.anchor").alias("anchor"), F.bround("x.score", 4).alias("score"), F.col("x.b.split").alias("split"), F.col("x.b.case").alias("case"),
        F.col("x.b.left").alias("split_left"), F.col("x.b.right").alias("split_right"), F.col("x.b.lp").alias("left_person"), F.col("x.b.rp").alias("right_person"),
        F.bround("x.b.ls", 4).alias("left_score"), F.bround("x.b.rs", 4).alias("right_score"), F.coalesce("n_occurrences", F.lit(1)).alias("n_occurrences"),
    )
    high = _reject(open_.join(best.select("row_id"), "row_id", "left_anti"), "score_too_high")
    every = ready.lonely.unionByName(spared).unionByName(high)
    first = every.groupBy("delegate_id", "pattern").agg(F.min(F.struct("row_id", "anchor", "reason")).alias("x"))
    return found, first.select("pattern", "delegate_id", "x.row_id", "x.anchor", "x.reason")


def with_anchors(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """S-J34: the anchors of the matched left and right persons."""
    for side in ("left", "right"):
        found = found.join(anchors.select(F.col("delegate_id").alias(f"{side}_person"), F.col("anchor").alias(f"{side}_anchor")), f"{side}_person", "left")
    return found


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """A-24."""
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


def detect_fragments(merged: DataFrame, table: Anchors, scope: DataFrame | None = None, t_fragment: float = T_FRAGMENT, length: float = FRAGMENT_LENGTH, min_patterns: int = MIN_PATTERNS) -> DataFrame:
    """D-03: pairs of short patterns, two characters at least, of a person that joined give the anchor.

    A joined text can only be near the anchor if its length is, so pairs meet by person and length: the
    lengths that a partner may have are few, and no person's patterns are all paired.
    """
    freq = pattern_frequency(clean_rows(merged if scope is None else scope)).groupBy("delegate_id", normalise(F.col("pattern")).alias("pattern")).agg(F.sum("n").alias("n"))
    many = freq.groupBy("delegate_id").agg(F.count("*").alias("k")).filter(F.col("k") >= min_patterns).select("delegate_id")
    a = F.length("anchor")
    short = freq.join(many, "delegate_id").join(table.anchors, "delegate_id").filter((F.length("pattern") < length * a) & (F.length("pattern") >= 2))
    low = F.greatest(F.lit(1), F.ceil(a * (1 - t_fragment)).cast("int") - F.length("pattern") - 1)
    high = F.floor(a / (1 - t_fragment)).cast("int") - F.length("pattern")
    left = short.filter(low <= high).select("delegate_id", "anchor", F.col("pattern").alias("fragment_a"), F.col("n").alias("freq_a"), F.explode(F.sequence(low, high)).alias("len_b"))
    right = short.select(F.col("delegate_id").alias("_id"), F.col("pattern").alias("fragment_b"), F.col("n").alias("freq_b"), F.length("pattern").alias("_len"))
    pairs = left.join(right, (F.col("delegate_id") == F.col("_id")) & (F.col("len_b") == F.col("_len")) & (F.col("fragment_a") < F.col("fragment_b")))
    x, y = F.col("fragment_a"), F.col("fragment_b")
    ways = [F.concat(x, y), F.concat(y, x), F.concat_ws(" ", x, y), F.concat_ws(" ", y, x)]
    best = F.array_min(F.array(*(F.struct(distance(w, F.col("anchor")).alias("score"), F.lit(i).alias("way"), w.alias("joined")) for i, w in enumerate(ways))))
    out = pairs.withColumn("b", best).filter(F.col("b.score") <= t_fragment)
    return out.select("delegate_id", "anchor", "fragment_a", "fragment_b", "freq_a", "freq_b", "b.joined", F.bround("b.score", 4).alias("score"))


def detect_all(merged: DataFrame, synonyms: DataFrame | None = None, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D-04: (concat found, concat rejected, fragments) over one anchor table."""
    table = anchor_table(merged, synonyms)
    return (*detect_concat(merged, table, scope), detect_fragments(merged, table, scope))


def edit_pairs(asked: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``asked(..., kind, form, len)`` joined to ``known(kind, known, known_len)`` where at most ``most`` edits lie between the forms, with ``d``.

    A known form is cut into ``most + 1`` segments. Edits can't touch all of them, so one stands unchanged in
    the asked form, at most ``most`` places from where it was: the join is by length, segment and its text,
    and candidates are verified. Known forms with fewer characters than segments are met by length.
    """
    cuts = most + 1
    start = lambda i: F.floor(F.col("known_len") * i / cuts).cast("int")
    piece = lambda i: F.struct(F.lit(i).alias("i"), F.substring("known", start(i) + 1, start(i + 1) - start(i)).alias("text"))
    parts = known.filter(F.col("known_len") >= cuts).withColumn("s", F.explode(F.array(*(piece(i) for i in range(cuts)))))
    parts = parts.select("kind", "known", "known_len", F.col("s.i").alias("i"), F.col("s.text").alias("text"))

    def places(i: int) -> Column:
        size = start(i + 1) - start(i)
        low, high = F.greatest(start(i) - most, F.lit(0)), F.least(start(i) + most, F.col("len") - size)
        at = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda p: F.struct(F.lit(i).alias("i"), F.substring(F.col("form"), p + 1, size).alias("text"))))

    lengths = asked.withColumn("known_len", F.explode(F.sequence(F.greatest(F.col("len") - most, F.lit(0)), F.col("len") + most)))
    grams = lengths.filter(F.col("known_len") >= cuts).withColumn("s", F.explode(F.flatten(F.array(*(places(i) for i in range(cuts))))))
    grams = grams.select(*asked.columns, "known_len", F.col("s.i").alias("i"), F.col("s.text").alias("text"))
    near = F.expr(f"levenshtein(form, known, {most}) >= 0")
    on = lambda x, y, keys: [*(x[c] == y[c] for c in keys), near]
    columns = [*asked.columns, "known", "known_len"]
    met = grams.join(parts.select("*"), on(grams, parts, ["kind", "known_len", "i", "text"])).select(*(grams[c] for c in asked.columns), parts["known"], parts["known_len"])
    small = known.filter(F.col("known_len") < cuts)
    few = lengths.filter(F.col("known_len") < cuts)
    met = met.unionByName(few.join(small, on(few, small, ["kind", "known_len"])).select(*(few[c] for c in asked.columns), small["known"], small["known_len"])).select(*columns).distinct()
    return met.withColumn("d", F.levenshtein("form", "known"))


def compound_scores(merged: DataFrame, anchors: DataFrame, within: float | None = None) -> DataFrame:
    """D-05: the least distance of each distinct pattern to any anchor, whole to whole or bare to bare.

    Patterns that are an anchor leave first, then those with an anchor a few edits away, found by
    ``edit_pairs``: whatever was not found is k + 1 edits away or more, which is (k + 1) / (length + k + 1)
    at least, so a pattern is settled once its best is no worse. The rest meets anchors of the lengths that
    a distance under a bound allows, under wider and wider bounds; the last allows all. With ``within`` the
    search ends there, and farther patterns have null.
    """
    patterns = written(clean_rows(merged).select(normalise(F.col("pattern")).alias("pattern")).distinct())
    known = written(_forms(anchors.select("anchor").distinct(), "anchor", True).select("kind", F.col("form").alias("known"), F.col("len").alias("known_len")).distinct())
    bounds = [T_COMPOUND, 0.5, 0.75, 1.0] if within is None else [within]
    best, left = None, patterns

    def settle(found: DataFrame) -> None:
        nonlocal best, left
        found = written(found)
        best = found if best is None else best.unionByName(found)
        left = written(left.join(found.select("pattern"), "pattern", "left_anti"))

    for most in EDITS:
        asked = _forms(left, "pattern", True)
        pairs = edit_pairs(asked, known, most) if most else asked.join(known, (asked["kind"] == known["kind"]) & (asked["form"] == known["known"])).select(asked["pattern"], asked["len"], known["known_len"], F.lit(0).alias("d"))
        longest = F.greatest("len", "known_len")
        scores = pairs.groupBy("pattern").agg(F.min(F.when(longest == 0, F.lit(0.0)).otherwise(F.col("d") / longest)).alias("compound_score"))
        other = asked.groupBy(F.col("pattern").alias("_p")).agg((F.lit(most + 1.0) / (F.max("len") + most + 1)).alias("_other"))
        settle(scores.join(other, F.col("pattern") == F.col("_p")).filter(F.col("compound_score") <= F.col("_other")).select("pattern", "compound_score"))
    for bound in bounds:
        asked = _forms(left, "pattern", True)
        if bound < 1:
            low, high = F.ceil(F.col("len") * (1 - bound)).cast("int"), F.floor(F.col("len") / (1 - bound) + 1e-9).cast("int")
            asked = asked.withColumn("known_len", F.explode(F.sequence(F.least(low, high), F.greatest(low, high))))
        else:
            asked = asked.withColumn("known_len", F.explode(F.sequence(F.lit(0), F.lit(known.agg(F.max("known_len")).first()[0] or 0))))
        settle(_near(asked, known, ["known_len"], bound).groupBy("pattern").agg(F.min("s").alias("compound_score")))
    near = best if within is None else best.filter(F.col("compound_score") <= within)
    return patterns.join(near, "pattern", "left")


def suspicious_lengths(merged: DataFrame, table: Anchors, least: float = 1.5, invalid: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """D-06: pattern parts much longer than the anchor, without invalid and ghost pairs."""
    parts = clean_rows(merged).select("delegate_id", F.explode(pattern_parts(F.col("pattern"))).alias("pattern")).groupBy("delegate_id", "pattern").agg(F.count("*").alias("n"))
    far = parts.join(table.anchors, "delegate_id").withColumn("ratio", length_ratio(normalise(F.col("pattern")), F.col("anchor"))).filter(F.col("ratio") >= least)
    if invalid is not None:
        far = far.join(invalid.select("delegate_id", "pattern"), ["delegate_id", "pattern"], "left_anti")
    if synonyms is not None:
        far = far.join(ghost_patterns(synonyms).select("delegate_id", F.col("ghost").alias("pattern")), ["delegate_id", "pattern"], "left_anti")
    return far


def neighbour_evidence(suspects: DataFrame, table: Anchors, window: int = 5) -> DataFrame:
    """D-07: the right half of each suspect against the anchors of persons ever seen near; every suspect stays.

    The score is the least distance, whole or (if the half has more than infixes) bare, to three digits;
    without an anchor nearer than 1 it is 1 and nobody is named. Ties: the smaller id. ``review_order``
    (T-05) sorts the result. ``n_near`` is how many persons were ever seen near, with or without an anchor.
    """
    edges = written(ever_near(table.positions, suspects, window))
    anchors = table.anchors.filter("anchor <> ''").select(F.col("delegate_id").alias("near"), F.col("anchor").alias("near_anchor"))
    h = word_halves(normalise(F.col("pattern")))
    halves = written(suspects.select("delegate_id", "pattern", "ratio", h.alias("h")).select("delegate_id", "pattern", "ratio", "h.left", "h.right"))
    # Of persons with equal anchors the one with the smallest id counts; infixes are stripped once for each text, not for each pair.
    known = edges.join(anchors, "near").repartition("delegate_id").groupBy("delegate_id", "near_anchor").agg(F.min("near").alias("near"))
    known = known.withColumn("bare_anchor", strip_infix(F.col("near_anchor")))
    asked = halves.filter(F.col("right") != "").select("delegate_id", "right").distinct().withColumn("bare", strip_infix(F.col("right")))
    whole, bare = distance(F.col("right"), F.col("near_anchor")), distance(F.col("bare"), F.col("bare_anchor"))
    once = (F.col("bare") == "") | ((F.col("bare") == F.col("right")) & (F.col("bare_anchor") == F.col("near_anchor")))
    scored = asked.join(known, "delegate_id").withColumn("s", F.when(once, whole).otherwise(F.least(whole, bare)))
    # The bound comes after the minimum: before it, each distance would be taken twice.
    best = scored.groupBy("delegate_id", "right").agg(F.min(F.struct("s", "near", "near_anchor")).alias("b")).filter("b.s < 1")
    counts = edges.groupBy("delegate_id").agg(F.count("*").alias("n_near"))
    full = halves.join(best, ["delegate_id", "right"], "left").join(counts, "delegate_id", "left")
    return full.select(
        "delegate_id", "pattern", "ratio", "left", "right", is_infix_only(F.col("left")).alias("left_is_infix"), F.coalesce(F.bround("b.s", 3), F.lit(1.0)).alias("score"), F.col("b.near").alias("near"),
        F.col("b.near_anchor").alias("near_anchor"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def review_order() -> list[Column]:
    """T-05."""
    return [F.col("left_is_infix").asc(), F.col("score").asc(), F.col("ratio").desc(), F.col("delegate_id").asc(), F.col("pattern").asc()]


def best_split_scores(merged: DataFrame, table: Anchors, window: int = WINDOW) -> DataFrame:
    """D-15: how near each candidate comes to any pair of neighbours' anchors, without a threshold."""
    candidates = concat_prefilter(merged, table.anchors)
    near = neighbours(table.positions, window).select("row_id", F.col("neighbour_person").alias("delegate_id")).filter("delegate_id IS NOT NULL").distinct()
    named = near.join(table.anchors, "delegate_id").select("row_id", F.col("anchor").alias("near"))
    flat = candidates.join(_halves(candidates.select("pattern").distinct()), "pattern").join(named, "row_id")
    by_split = flat.groupBy("row_id", "pattern", "split").agg(F.min(distance(F.col("left"), F.col("near"))).alias("l"), F.min(distance(F.col("right"), F.col("near"))).alias("r"))
    return by_split.groupBy("row_id", "pattern").agg(F.min((F.col("l") + F.col("r")) / 2).alias("best"))


def compare_scorers(merged: DataFrame, table: Anchors, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """D-08: found pairs with whole names alone and with infixes stripped, from one pass that scores each half both ways."""
    ready = _prepared(merged, table, merged if scope is None else scope, T_CONCAT, T_COMPOUND, WINDOW, MIN_LENGTH_RATIO, [False, True], "anchor")
    return _judged(merged, ready, False, T_CONCAT)[0], _judged(merged, ready, True, T_CONCAT)[0]


def pattern_counts(merged: DataFrame, table: Anchors, person: str) -> DataFrame:
    """A-38."""
    rows = pattern_frequency(merged.filter(F.col("delegate_id") == person))
    return rows.withColumn("normalised", normalise(F.col("pattern"))).join(table.anchors, "delegate_id", "left")
