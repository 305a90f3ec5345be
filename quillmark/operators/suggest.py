"""Persons proposed for unresolved rows: n-gram similarity by inverted indexes of blocks of persons, with year and province gates."""

from __future__ import annotations

import math
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import as_int, char_ngrams, word_ngrams
from quillmark.functions.steps import forget, written

# The provinces that the gate knows, and the weights of the two spaces.
PROVINCES = ("Gelderland", "Holland", "Zeeland", "Utrecht", "Friesland", "Overijssel", "Groningen")
WEIGHTS = {"char": 0.6, "word": 0.4}


#: Weights are whole numbers of so many parts, so a score is the same whatever order its products are added in.
SCALE = 1 << 28
#: Persons and patterns of one task of a search, about.
PERSONS, PATTERNS = 8192, 8192


class Store(NamedTuple):
    """D-09: ``persons(pid, delegate_id, first_year, last_year, provincie, tids, ws)``: each person's terms and their weights in parts of ``SCALE``; ``terms(tid, space, term, idf, df)`` (df: persons who have it) and ``meta`` by person, with ``pid``."""

    persons: DataFrame
    terms: DataFrame
    meta: DataFrame

    @property
    def index(self) -> DataFrame:
        """``tid, pid, w``."""
        return self.persons.select("pid", F.explode(F.arrays_zip("tids", "ws")).alias("x")).select("x.tids", "pid", F.col("x.ws").cast("long").alias("w")).withColumnRenamed("tids", "tid")


def terms_of(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """X-22: ``space, key, term, n``: term counts of ``df(key, pattern)``, each pattern counted ``weight`` times."""
    spaces = [("char", char_ngrams(F.col("pattern"))), ("word", word_ngrams(F.col("pattern")))]
    tagged = lambda s, terms: F.transform(terms, lambda x: F.struct(F.lit(s).alias("space"), x.alias("term")))
    each = F.explode(F.flatten(F.array(*(tagged(s, t) for s, t in spaces))))
    return df.select(F.col(key), weight.alias("k"), each.alias("t")).groupBy(F.col("t.space").alias("space"), key, F.col("t.term").alias("term")).agg(F.sum("k").alias("n"))


def build_store(merged: DataFrame, province: str = "namens", include_generated: bool = False) -> Store:
    """D-09, A-22, A-23: term weights of each person's patterns.

    tf is 1 + ln(count), idf is ln((1 + N) / (1 + df)) + 1, each person's weights have length 1 in each
    space, in parts of ``SCALE``. Word pairs are taken inside a pattern, not across two. Persons need a
    positive numeric id unless ``include_generated``.
    """
    labelled = merged.filter("pattern IS NOT NULL")
    if not include_generated:
        labelled = labelled.filter(F.col("delegate_id").try_cast("double") > 0)
    patterns = labelled.groupBy("delegate_id", "pattern").agg(F.count("*").alias("n"))
    years = labelled.groupBy("delegate_id").agg(F.min("j").alias("first_year"), F.max("j").alias("last_year"), F.mode(province, True).alias("provincie"))
    meta = written(years.withColumn("pid", F.monotonically_increasing_id()))
    # Many persons share patterns, so each is cut into terms once, and terms travel as numbers.
    cut = written(terms_of(patterns.select("pattern", F.col("pattern").alias("q")).distinct(), "q", F.lit(1)))
    ids = written(cut.select("space", "term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    packed = cut.join(ids, ["space", "term"]).groupBy("q").agg(F.collect_list(F.struct("tid", F.col("n").alias("c"))).alias("cut"))
    theirs = patterns.join(meta.select("delegate_id", "pid"), "delegate_id").join(packed, F.col("pattern") == F.col("q")).select("pid", "n", "cut")
    counts = theirs.repartition("pid").select("pid", "n", F.explode("cut").alias("x")).groupBy("pid", "x.tid").agg(F.sum(F.col("n") * F.col("x.c")).alias("n"))
    counts = written(counts)
    total = meta.count()  # one number
    df = counts.groupBy("tid").agg((F.ln(F.lit(1.0 + total) / (1 + F.count("*"))) + 1).alias("idf"), F.count("*").alias("df"))
    terms = written(ids.join(df, "tid"))
    raw = counts.join(terms.select("tid", "space", "idf"), "tid").select("pid", F.struct("tid", "space", ((1 + F.ln("n")) * F.col("idf")).alias("w")).alias("t"))
    norm = lambda s: F.sqrt(F.sum(F.when(F.col("t.space") == s, F.col("t.w") * F.col("t.w")))).alias(s)
    whole = raw.groupBy("pid").agg(F.collect_list("t").alias("t"), *(norm(s) for s in WEIGHTS))
    share = lambda x: F.round(x["w"] / F.when(x["space"] == "char", F.col("char")).otherwise(F.col("word")) * SCALE).cast("int")
    whole = whole.select("pid", F.transform("t", lambda x: x["tid"]).alias("tids"), F.transform("t", share).alias("ws"))
    persons = written(meta.join(whole, "pid").select("pid", "delegate_id", "first_year", "last_year", "provincie", "tids", "ws"))
    forget(cut, ids, counts)
    return Store(persons, terms, meta)


def _asked_terms(patterns: DataFrame, store: Store, weights: dict[str, float]) -> DataFrame:
    """``qid, tid, wq`` of ``patterns(qid, pattern)``; the weight of the space is part of ``wq``."""
    raw = terms_of(patterns, "qid", F.lit(1)).join(store.terms, ["space", "term"]).withColumn("w", (1 + F.ln("n")) * F.col("idf"))
    norms = raw.groupBy("space", "qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    share = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("space")]
    return raw.join(norms, ["space", "qid"]).select("qid", "tid", F.round(share * F.col("w") / F.col("norm") * SCALE).cast("long").alias("wq"))


def pattern_scores(patterns: DataFrame, store: Store, weights: dict[str, float] | None = None) -> DataFrame:
    """S-J31: ``pattern, delegate_id, score`` of distinct patterns with every person who shares a term; ``retrieve`` keeps only the best of them."""
    ids = written(patterns.select("pattern").distinct().withColumn("qid", F.monotonically_increasing_id()))
    sums = _asked_terms(ids, store, weights or WEIGHTS).join(store.index, "tid").groupBy("qid", "pid").agg(F.sum(F.col("wq") * F.col("w")).alias("s"))
    return sums.join(ids, "qid").join(store.meta.select("pid", "delegate_id"), "pid").select("pattern", "delegate_id", (F.col("s") / float(SCALE) ** 2).alias("score"))


def _best_in_block(k: int, bar: int, tolerance: int):
    """The ``k`` best persons of a block for each question of a block, both as tables; weights are whole numbers, so sums are exact."""

    def longs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)

    def run(persons: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, str, str, np.ndarray, np.ndarray]] = []
        if persons.num_rows and asked.num_rows:
            # By id, so that of equal scores the one that stands first counts.
            persons = persons.sort_by("delegate_id")
            names = persons["delegate_id"].to_pylist()
            first, last = (np.array([np.nan if x is None else x for x in persons[c].to_pylist()], float) for c in ("first_year", "last_year"))
            places = np.array(persons["provincie"].to_pylist(), object)
            tids, starts = longs(persons["tids"])
            owner = np.repeat(np.arange(len(names)), np.diff(starts))
            order = np.argsort(tids, kind="stable")
            owner, weight = owner[order], longs(persons["ws"])[0][order]
            terms, begin = np.unique(tids[order], return_index=True)
            end = np.append(begin[1:], len(order))
            masks: dict[tuple[str, str], bytes] = {}
            open_: dict[bytes, np.ndarray] = {}

            def mask_of(year: str, gate: str) -> bytes:
                if (year, gate) not in masks:
                    fits = np.ones(len(names), bool)
                    if year:
                        fits &= ~((int(year) < first - tolerance) | (int(year) > last + tolerance))
                    if gate:
                        fits &= places == gate
                    masks[year, gate] = key = fits.tobytes()
                    open_[key] = fits
                return masks[year, gate]

            words, bounds = longs(asked["tids"])
            shares = longs(asked["wqs"])[0]
            for i, (qid, questions) in enumerate(zip(asked["qid"].to_pylist(), asked["questions"].to_pylist(), strict=True)):
                mine = words[bounds[i] : bounds[i + 1]]
                at = np.minimum(np.searchsorted(terms, mine), len(terms) - 1) if len(terms) else mine[:0]
                sums = np.zeros(len(names), np.int64)
                for j in np.flatnonzero(terms[at] == mine) if len(terms) else ():
                    span = slice(begin[at[j]], end[at[j]])
                    sums[owner[span]] += weight[span] * shares[bounds[i] + j]
                some = np.flatnonzero(sums >= bar)
                done: dict[bytes, np.ndarray] = {}
                for q in questions:
                    key = mask_of(q["_year"], q["_gate"])
                    if key not in done:
                        fit = some[open_[key][some]]
                        if len(fit) > k:
                            s = sums[fit]
                            least = np.partition(s, len(s) - k)[len(s) - k]
                            above = fit[s > least]
                            fit = np.concatenate([above, fit[s == least][: k - len(above)]])
                        done[key] = fit
                    if len(done[key]):
                        found.append((qid, q["_year"], q["_gate"], done[key], sums[done[key]]))
        n = [len(x[3]) for x in found]
        who = np.concatenate([x[3] for x in found]) if found else np.zeros(0, np.int64)
        score = np.concatenate([x[4] for x in found]) if found else np.zeros(0, np.int64)
        spread = lambda c, kind: pa.array([x[c] for x in found], kind).take(pa.array(np.repeat(np.arange(len(found)), n)))
        ids = pa.array(names if found else [], pa.string()).take(pa.array(who))
        return pa.table({"qid": spread(0, pa.int64()), "_year": spread(1, pa.string()), "_gate": spread(2, pa.string()), "delegate_id": ids, "s": pa.array(score)})

    return run


def retrieve(questions: DataFrame, patterns: DataFrame, store: Store, k: int, least: float, tolerance: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The ``k`` persons with the highest scores, ``least`` or more, of each question ``(qid, _year, _gate)``, with ``s`` and ``place``: exact.

    Persons and patterns are dealt into blocks of bounded size; each block of persons meets each block of
    patterns in one task, which looks the terms up in an index of its persons, adds the products up and
    returns only the ``k`` best of each question. So scores of pairs are never shuffled or written; what is
    shuffled are the blocks and ``k`` rows of each question and block.
    """
    n_persons = max(1, math.ceil(store.meta.count() / PERSONS))  # two numbers
    n_patterns = max(1, math.ceil(patterns.count() / PATTERNS))
    bar = max(1, math.ceil(Fraction(str(least)) * SCALE**2))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    terms = _asked_terms(patterns, store, weights or WEIGHTS).groupBy("qid").agg(F.collect_list(F.struct("tid", "wq")).alias("t"))
    terms = terms.select("qid", F.col("t.tid").alias("tids"), F.col("t.wq").alias("wqs"))
    gates = questions.groupBy("qid").agg(F.collect_list(F.struct("_year", "_gate")).alias("questions"))
    asked = written(terms.join(gates, "qid"))
    left = store.persons.withColumn("pb", F.pmod(F.xxhash64("pid"), F.lit(n_persons)).cast("int")).withColumn("qb", every(n_patterns))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_patterns)).cast("int")).withColumn("pb", every(n_persons))
    blocks = left.groupBy("pb", "qb").cogroup(right.groupBy("pb", "qb"))
    found = blocks.applyInArrow(_best_in_block(k, bar, tolerance), "qid long, _year string, _gate string, delegate_id string, s long")
    w = Window.partitionBy("qid", "_year", "_gate").orderBy(F.col("s").desc(), "delegate_id")
    return written(found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k))


def suggest(rows: DataFrame, store: Store, k: int = 3, least: float = 0.1, tolerance: int = 5, province: str = "namens") -> DataFrame:
    """D-10, W-10: ``row_id, person_1, score_1 ... person_k, score_k``; rows without a candidate stay, with null and 0.

    A person is out when the row's year is beyond the person's years by more than ``tolerance`` (an
    unknown year on either side is no reason), or when the row names a known province that isn't the
    person's (presidents are exempt). Ties go to the smaller id.
    """
    president = F.coalesce(F.lower("class") == "president", F.lit(False)) if "class" in rows.columns else F.lit(False)
    where_ = F.when(~president & F.coalesce(F.col(province).isin(*PROVINCES), F.lit(False)), F.col(province)).otherwise(F.lit(""))
    # Rows ask alike that share pattern, year and gate; each such question is answered once.
    asked = rows.select("row_id", "pattern", F.coalesce(as_int(F.col("j")).cast("string"), F.lit("")).alias("_year"), where_.alias("_gate"))
    patterns = written(asked.filter("pattern IS NOT NULL").select("pattern").distinct().withColumn("qid", F.monotonically_increasing_id()))
    numbered = written(asked.join(patterns, "pattern", "left").select("row_id", "qid", "_year", "_gate"))
    best = retrieve(numbered.filter("qid IS NOT NULL").select("qid", "_year", "_gate").distinct(), patterns, store, k, least, tolerance)
    of = lambda i, c: F.max(F.when(F.col("place") == i, F.col(c)))
    cols = [x for i in range(1, k + 1) for x in (of(i, "delegate_id").alias(f"person_{i}"), F.bround(of(i, "s") / float(SCALE) ** 2, 3).alias(f"score_{i}"))]
    answers = numbered.join(best.groupBy("qid", "_year", "_gate").agg(*cols), ["qid", "_year", "_gate"], "left")
    return answers.select("row_id", *(x for i in range(1, k + 1) for x in (F.col(f"person_{i}"), F.coalesce(f"score_{i}", F.lit(0.0)).alias(f"score_{i}"))))


def banner(suggested: DataFrame, high: float = 0.8) -> DataFrame:
    """A-33: rows, rows with a suggestion, and rows with a good one."""
    return suggested.agg(F.count("*").alias("n"), F.count("person_1").alias("n_suggested"), F.count_if(F.col("score_1") >= high).alias("n_good"))
