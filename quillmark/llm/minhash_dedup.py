"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find groups.

SuperMinHash (Ertl, 2017): each element of a set walks through a random permutation of the slots and
offers the slot of its j-th step the value j + r with r in [0, 1). Ranks of one element are
correlated through the permutation, so the estimate varies less than with independent minima, and a
document stops after the first step in which every slot has a value: later steps only offer more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import common

#: 24 bands of 5 slots: a pair at similarity 0.85 is missed with probability 8e-7, at 0.8 with 1e-4.
BANDS, ROWS = 24, 5
#: Ids that are sent to every task at most (8 MB).
MOST_SENT = 1_000_000
#: 64-bit words of the marks of a set: each shingle sets one bit. Where the marks of two sets differ, the sets do.
MARKS = 8
_G = 0x9E3779B97F4A7C15


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, sorted within each text; how many each text has).

    A-Z are lower-cased. A text with fewer words than ``size`` has its whole sequence as one shingle.
    """
    words, counts = common.words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    w = hashes[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(np.arange(len(w)) + size <= ends[owner]) if len(w) else np.zeros(0, np.int64)
    h = np.full(len(start), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = common.mix64(h * np.uint64(_G) + w[start + k])
        short = np.flatnonzero((counts > 0) & (counts < size))
        hs = counts[short].astype(np.uint64)
        for k in range(size - 1):
            on = counts[short] > k
            at = np.where(on, ends[short] - counts[short] + k, 0)
            hs = np.where(on, common.mix64(hs * np.uint64(_G) + w[at]), hs) if len(short) else hs
    who = np.concatenate([owner[start], short])
    h = np.concatenate([h, hs])
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (who[1:] != who[:-1]) | (h[1:] != h[:-1])
    return h[new], np.bincount(who[new], minlength=len(counts)).astype(np.int64)


def super_minhash(h: np.ndarray, counts: np.ndarray, slots: int, seed: int = 1) -> np.ndarray:
    """(texts, slots) signatures of the sets of hashes ``h``; texts without elements keep the highest value."""
    top = np.iinfo(np.uint64).max
    sig = np.full((len(counts), slots), top, np.uint64)
    flat = sig.reshape(-1)
    base = common.mix64(h + np.uint64(seed))
    owner = np.repeat(np.arange(len(counts)), counts)

    def draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Value of step j (j above 52 random bits) and the swap place in [j, slots)."""
        with np.errstate(over="ignore"):
            r = common.mix64(x + np.uint64((2 * j + 1) * _G % 2**64))
            k = common.mix64(x + np.uint64((2 * j + 2) * _G % 2**64))
        return (r >> np.uint64(12)) | np.uint64(j << 52), (j + (k >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int64)

    value, first = draw(base, 0)
    np.minimum.at(flat, owner * slots + first, value)
    todo = np.flatnonzero((sig == top).any(axis=1) & (counts > 0))
    starts = np.cumsum(counts) - counts
    for part in np.split(todo, np.flatnonzero(np.diff(np.cumsum(counts[todo]) // 200_000)) + 1) if len(todo) else []:
        n = counts[part]
        at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x, who, perm = base[at], owner[at], np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(at), 1))
        row = np.arange(len(at))
        perm[row, first[at]], perm[row, 0] = 0, first[at]
        for j in range(1, slots):
            open_ = (sig[part] == top).any(axis=1)
            if not open_.any():
                break
            part = part[open_]
            stay = np.isin(who, part)
            if not stay.all():
                x, who, perm = x[stay], who[stay], perm[stay]
                row = np.arange(len(x))
            value, k = draw(x, j)
            slot = perm[row, k]
            perm[row, k] = perm[:, j]
            perm[:, j] = slot
            np.minimum.at(flat, who * slots + slot, value)
    return sig


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        ends = np.cumsum(counts)
        return upto[ends] - upto[ends - counts]


def _signer(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in common.byte_slices(texts):
                h, n = shingle_sets(texts.slice(a, b - a), size)
                sig = super_minhash(h, n, bands * rows)
                keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(n), axis=0)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = common.mix64(keys * np.uint64(_G) + sig[:, r::rows])
                    k1, k2 = (_sum_by(common.mix64(h ^ np.uint64(c)), n) for c in (0xA5A5A5A5DEADBEEF, 0x1234567890ABCDEF))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array(n == 0))
                yield pa.record_batch([ids.slice(a, b - a), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists], names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return sign


def _setter(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in common.byte_slices(texts):
                h, n = shingle_sets(texts.slice(a, b - a), size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h.view(np.int64)))
                flags = np.zeros((len(n), 64 * MARKS), np.uint8)
                flags[np.repeat(np.arange(len(n)), n), (h >> np.uint64(17)) % np.uint64(64 * MARKS)] = 1
                words = np.packbits(flags, axis=1, bitorder="little").view("<i8").reshape(-1)
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * MARKS, pa.int32()), pa.array(words))
                yield pa.record_batch([ids.slice(a, b - a), lists, marks], names=["doc_id", "shingles", "marks"])

    return sets


def _similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rep, n, rep2, n2``: pairs of ``nodes(rep, n, c)`` of different ``c`` that share a rare shingle, exactly enough.

    With all shingles ordered by how many nodes have them, two sets of sizes n and m whose similarity
    is ``percent`` share at least o = percent * (n + m) / (100 + percent) of them, so among the first
    n - o + 1 of the one and m - o + 1 of the other is a common shingle. Shingles of one node come
    first and pair nothing, so they are dropped before the order is made and only counted. The sets of
    such a pair differ in n + m - 2 * o shingles at most, so their marks differ in no more bits: a family
    of looser copies that share rare shingles meets in the join, but its pairs don't leave it.
    """
    flat = nodes.select(F.col("rep").alias("doc_id")).join(sets.select("doc_id", "shingles"), "doc_id").select(F.col("doc_id").alias("rep"), F.explode("shingles").alias("shingle"))
    flat = common.written(flat, "flat")
    df = flat.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("rep")
    ranked = flat.join(df, "shingle").withColumn("place", F.row_number().over(own.orderBy("df", "shingle"))).withColumn("m", F.count("*").over(own))
    # The partner has percent / 100 of n at least, which bounds the prefix of n.
    marked = nodes.join(sets.select(F.col("doc_id").alias("rep"), "marks"), "rep")
    placed = ranked.join(marked, "rep").withColumn("place", F.col("n") - F.col("m") + F.col("place"))
    prefix = common.written(placed.filter(f"100 * (place - 1) <= (100 - {percent}) * n").select("rep", "n", "c", "shingle", "place", "marks"), "prefix")
    common.forget(flat)
    mixed = prefix.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("shingle")
    left = prefix.join(mixed, "shingle", "left_semi")
    right = left.select("shingle", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("place").alias("place2"), F.col("marks").alias("marks2"))
    need = f"{percent} * (n + n2)"
    near = f"(100 + {percent}) * (n - place + 1) >= {need} AND (100 + {percent}) * (n2 - place2 + 1) >= {need}"
    differ = " + ".join(f"bit_count(marks[{i}] ^ marks2[{i}])" for i in range(MARKS))
    few = f"(100 + {percent}) * ({differ}) <= (100 - {percent}) * (n + n2)"
    return left.join(right, "shingle").filter(f"c < c2 AND {near} AND {few}").select("rep", "n", "rep2", "n2")


def group_near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, bands: int = BANDS, rows: int = ROWS, leader_rounds: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of documents linked by shingle similarity.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets,
    confirmed on full sets. Steps: signatures and a 128-bit key of each set, without a shuffle; equal
    sets fold into one representative (the smallest id); representatives that share a band are
    candidates. In each of a few rounds every bucket pairs a leader with the members that are not yet
    in its component, so a bucket of any size gives one pair a member and not all pairs. Buckets that
    still hold several components then go through an exact prefix filter: two sets that are similar
    enough share one of their rarest shingles, so only such pairs of different components are
    compared. Hence no candidate is lost, and a large family of looser copies isn't paired out.

    A null or wordless text has no shingles and is alone. Rows with a null ``doc_id`` are linked with
    nothing and have a null component (they are kept). Rows that repeat an id are one node. An empty
    table gives no rows. Columns but ``doc_id`` and ``text`` are not read.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = common.written(texts.mapInArrow(_signer(size, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    filled = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["k1", "k2", "n_shingles"]
    classes = filled.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    banded = filled.join(classes, key).filter("doc_id = rep").dropDuplicates(["rep"]).select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1").select("band")
    members = common.written(banded.join(shared, "band"), "buckets")
    chosen = common.written(members.select(F.col("rep").alias("doc_id")).distinct(), "chosen")
    if chosen.count() <= MOST_SENT:  # else the texts are dealt by id
        chosen = F.broadcast(chosen)
    sets = common.written(texts.join(chosen, "doc_id", "left_semi").mapInArrow(_setter(size), "doc_id long, shingles array<long>, marks array<long>"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(left, "a").join(right, "b").filter(_similar(F.col("sa"), F.col("sb"), percent)).select("a", "b")

    spark = docs.sparkSession
    links: DataFrame | None = None
    tested: DataFrame | None = None
    # Made in the JVM: a list would start worker processes of another kind beside those of the operators.
    comps = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    for turn in range(leader_rounds + 1):
        placed = members.join(comps, F.col("rep") == F.col("node"), "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c"))
        lead = F.min_by(F.struct("rep", "n", "c"), F.struct(F.xxhash64("rep", F.lit(turn)), F.col("rep")))
        split = placed.groupBy("band").agg(lead.alias("lead"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
        if turn < leader_rounds:
            near = placed.join(split.select("band", "lead"), "band").filter("c <> lead.c").select("rep", "n", F.col("lead.rep").alias("rep2"), F.col("lead.n").alias("n2"))
        else:
            near = _rare_pairs(placed.join(split.select("band"), "band", "left_semi").select("rep", "n", "c").distinct(), sets, percent)
        near = near.filter(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
        pairs = near.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = common.written(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = common.written(verified(pairs), "links")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        before, comps = comps, common.written(common.connected_components(links), "comps")
        common.forget(before)
    common.forget(members, sets)
    reps = signed.join(classes.withColumnRenamed("n_shingles", "n_class").withColumnRenamed("k1", "c1").withColumnRenamed("k2", "c2"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") == F.col("n_class")), "left")
    named = reps.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")).join(comps, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
