"""Quality rules with thresholds that follow each language and source.

Every text is measured in one pass. For each language, source and measure, the values go into a
mergeable quantile sketch: counts of buckets that keep the top six binary digits of a whole number,
so a quantile is off by under 1/32 of itself. Sketches are added up by key and bucket, map-side
first; the fences that they give are joined to the measures and take the place of fixed cutoffs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import common

#: measure -> (numerator, denominator, scale): floor(scale * numerator / denominator), 0 without a denominator.
MEASURES = {
    "word_length": ("word_chars", "n_words", 100),
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "stutter": ("n_stutter", "n_words", 1000),
}
#: A value is an outlier beyond the quartiles by this many interquartile ranges ...
REACH = 3
#: ... and by this much at least, as most clean texts of a group have the same value (mostly 0).
LEAST_MARGIN = {"word_length": 150, "symbols": 30, "dup_lines": 300, "repeats": 150, "stutter": 150}
#: A group's quartiles are drawn towards its language's as if these many documents of it stood at the
#: language's quartiles, and a language's likewise towards those of all; so small groups lean on more.
PRIOR_DOCS = 100

_WORDS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_stutter long"


def _repeats(codes: np.ndarray, counts: np.ndarray, n: int = 5) -> np.ndarray:
    """Words of each text in n-word windows that are found twice or more in that text."""
    total = len(codes)
    ends = np.cumsum(counts)
    out = np.zeros(len(counts), np.int64)
    if total < n:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(total) + n <= ends[owner])
    if not len(at):
        return out
    key = owner[at].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = key[a] == key[b]
    a, b = at[a[same]], at[b[same]]
    equal = owner[a] == owner[b]
    for k in range(n):
        equal &= codes[a + k] == codes[b + k]
    marks = np.zeros(total + 1, np.int64)
    found = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(marks, found, 1)
    np.add.at(marks, found + n, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(counts)).astype(np.int64)


def _dup_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word that equal an earlier line of the text, lines with a word) of each text."""
    lists = pc.split_pattern(texts, "\n")
    coded = lists.flatten().dictionary_encode()
    wordy = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    keep = wordy[codes] if len(codes) else np.zeros(0, bool)
    owner, codes = owner[keep], codes[keep]
    lines = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    first = np.unique(owner.astype(np.int64) << 32 | codes)
    return lines - np.bincount(first >> 32, minlength=len(texts)), lines


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, one after the other, and the offsets of each (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POINTS = (((np.arange(256) & 0xC0) != 0x80) & ~_SPACES).astype(np.int64)
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    texts = pc.fill_null(texts, "")
    words, counts = common.words_of(texts)
    codes = words.dictionary_encode().indices.to_numpy()
    raw, offsets = text_bytes(texts)
    kinds = np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets)), weights=_POINTS[raw], minlength=len(texts))
    symbols = np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets)), weights=_SYMBOLS[raw], minlength=len(texts))
    dup, lines = _dup_lines(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])) + 1
    stutter = np.bincount(owner[again], minlength=len(counts)).astype(np.int64)
    return {"n_words": counts, "word_chars": kinds.astype(np.int64), "n_symbols": symbols.astype(np.int64), "n_dup_lines": dup.astype(np.int64), "n_repeat_words": _repeats(codes, counts), "n_lines": lines, "n_stutter": stutter}


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _WORDS.split(", ")]
    for batch in batches:
        texts = batch.column(3)
        for a, b in common.byte_slices(texts):
            got = measure(texts.slice(a, b - a))
            yield pa.record_batch([*(batch.column(k).slice(a, b - a) for k in range(3)), *(pa.array(got[n]) for n in names[3:])], names=names)


def measures(docs: DataFrame) -> DataFrame:
    """The base measures of each document, with its language and source."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_measurer, _WORDS)


def _value(name: str) -> Column:
    top, under, scale = MEASURES[name]
    return F.when(F.col(under) > 0, F.floor(F.lit(scale) * F.col(top) / F.col(under))).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket that holds ``value``: its top six binary digits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    unit = F.pow(F.lit(2.0), drop)
    return (F.floor(value / unit) * unit).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, measure, bucket, n)``; the sketches of two tables merge by adding up ``n``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(_value(m)).alias("bucket")) for m in MEASURES)))
    rows = measured.filter("NOT base_failed").select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*")
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, docs, q1, q3``; windows run over buckets (some hundreds a key), not documents."""
    sums = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    upto = sums.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("docs", F.sum("n").over(w))
    least = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bucket")))
    return upto.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), least(1).alias("q1"), least(3).alias("q3"))


def fences(sketch: DataFrame, prior_docs: int = PRIOR_DOCS, reach: int = REACH) -> DataFrame:
    """``lang, source, measure, low, high``: what lies outside is an outlier in its group."""
    own = _quartiles(sketch, ["lang", "source"])
    by_lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("docs").alias("l_docs"), F.col("q1").alias("l_q1"), F.col("q3").alias("l_q3"))
    of_all = _quartiles(sketch, []).select(F.col("measure").alias("a_measure"), F.col("q1").alias("a_q1"), F.col("q3").alias("a_q3"))
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(of_all, F.col("measure") == F.col("a_measure"))
    prior = F.lit(float(prior_docs))
    drawn = lambda n, q, r: (F.col(n) * F.col(q) + prior * r) / (F.col(n) + prior)
    pick = lambda q: drawn("docs", q, drawn("l_docs", f"l_{q}", F.col(f"a_{q}")))
    margin = F.greatest(F.lit(float(reach)) * (F.col("u3") - F.col("u1")), F.create_map(*(F.lit(x) for m, n in LEAST_MARGIN.items() for x in (m, float(n))))[F.col("measure")])
    picked = both.select("lang", "source", "measure", pick("q1").alias("u1"), pick("q3").alias("u3"))
    return picked.select("lang", "source", "measure", (F.col("u1") - margin).alias("low"), (F.col("u3") + margin).alias("high"))


def judge(docs: DataFrame, prior_docs: int = PRIOR_DOCS, reach: int = REACH) -> DataFrame:
    """Measures and verdict of each document: ``kept`` is false if the base rules fail or any measure is an outlier.

    Result: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.
    A null text counts as empty (no words, so it fails the base rules). Null languages and sources are
    groups of their own; the fewer documents a group has, the more its fences lean on those of its
    language and of all. A group without any document that passes the base rules keeps none. Ties and repeated rows are judged row
    by row. Empty tables give no rows; other columns are not read.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = common.written(measures(docs).withColumn("base_failed", failed), "measures")
    limits = fences(sketches(measured), prior_docs, reach)
    wide = limits.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")))
    wide = wide.withColumnRenamed("lang", "w_lang").withColumnRenamed("source", "w_source")
    rows = measured.join(wide, F.col("lang").eqNullSafe(F.col("w_lang")) & F.col("source").eqNullSafe(F.col("w_source")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(_value(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def oracle_sql() -> str:
    """DuckDB SQL of ``judge`` over ``documents``."""
    values = {m: f"CASE WHEN {under} > 0 THEN ({scale} * {top}) // {under} ELSE 0 END" for m, (top, under, scale) in MEASURES.items()}
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS v FROM base WHERE NOT base_failed" for m, v in values.items())
    margin = "CASE measure " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in LEAST_MARGIN.items()) + " END"
    inside = " AND ".join(f"coalesce(({v}) BETWEEN max(CASE WHEN measure = '{m}' THEN low END) AND max(CASE WHEN measure = '{m}' THEN high END), false)" for m, v in values.items())

    def quartiles(name: str, keys: str) -> str:
        part, k = (f"PARTITION BY {keys}, measure", f"{keys}, measure") if keys else ("PARTITION BY measure", "measure")
        return f"""{name} AS (
  SELECT {k}, max(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN bucket END) AS q1, min(CASE WHEN upto * 4 >= docs * 3 THEN bucket END) AS q3
  FROM (SELECT {k}, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS docs, bucket
        FROM (SELECT {k}, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {k})"""

    drawn = lambda t, q, r: f"({t}.docs::DOUBLE * {t}.{q} + {float(PRIOR_DOCS)}::DOUBLE * {r}) / ({t}.docs::DOUBLE + {float(PRIOR_DOCS)}::DOUBLE)"
    base = "doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_stutter"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM d),
grams AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len([i FOR i IN range(2, len(ws) + 1) IF ws[i] = ws[i - 1]]) AS n_stutter,
    len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
vals AS ({pairs}),
sketch AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n FROM vals GROUP BY ALL),
{quartiles("own", "lang, source")}, {quartiles("by_lang", "lang")}, {quartiles("of_all", "")},
picked AS (
  SELECT o.lang, o.source, o.measure,
    {drawn("o", "q1", drawn("l", "q1", "a.q1"))} AS u1, {drawn("o", "q3", drawn("l", "q3", "a.q3"))} AS u3
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN of_all a ON o.measure = a.measure),
limits AS (SELECT lang AS l_lang, source AS l_source, measure, u1 - greatest({REACH} * (u3 - u1), {margin}) AS low, u3 + greatest({REACH} * (u3 - u1), {margin}) AS high FROM picked)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM base LEFT JOIN limits ON lang IS NOT DISTINCT FROM l_lang AND source IS NOT DISTINCT FROM l_source
GROUP BY {base}
"""
