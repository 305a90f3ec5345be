"""Removal of long repeated byte strings, exact over the corpus and across document lines.

Every string of ``least`` bytes has a minimiser: the leftmost smallest hash of its k-grams. Equal
strings have equal minimisers at equal offsets, so the strings that share a minimiser of one place form
a segment, and only segments whose minimiser occurs twice can hold repeats. Equal segments fold into one
with a count. The segments of a minimiser then meet in one Spark task, which builds a Burrows-Wheeler
transform of them and finds the repeated strings by breadth-first backward extension (Beller et al.,
2013): intervals of longer and longer strings set the common-prefix values of the suffix order in
increasing order, and the search stops at ``least``. What is unset then has ``least`` bytes in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.quality import text_bytes

_BASE = 0x9E3779B97F4A7C15


def minimiser_runs(raw: np.ndarray, offsets: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, fingerprint, first start, last start, place of the minimiser) of each run of strings with one minimiser; places count in ``raw``."""
    n, w = len(raw), least - k + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none.astype(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, _BASE, np.uint64))
        back = np.cumprod(np.full(n, pow(_BASE, -1, 2**64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        h = common.mix64((sums[k:] - sums[:-k]) * back[: n - k + 1])
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < w:
        step = min(span, w - span)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[:-step], low[step:])
        span += step
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.flatnonzero(np.arange(len(at)) + least <= offsets[text + 1])
    if not len(valid):
        return none, none.astype(np.uint64), none, none, none
    new = np.ones(len(valid), bool)
    new[1:] = (at[valid[1:]] != at[valid[:-1]]) | (np.diff(valid) != 1)
    first = valid[new]
    last = valid[np.append(np.flatnonzero(new)[1:] - 1, len(valid) - 1)]
    return text[first], h[at[first]], first, last, at[first].astype(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (its last value unique and smallest) in the order of their first ``depth`` values or more."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | np.roll(text, -j).astype(np.uint64)
    order = np.argsort(key)
    slots = np.arange(n)
    key, rank, h = key[order], np.empty(n, np.int64), 7
    moved = order
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[moved] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.append(new[1:], True)
        slots, moved = slots[~alone], moved[~alone]
        if h >= depth or not len(slots):
            return order
        after = moved + h
        after[after >= n] -= n
        if n <= 1 << 21:  # ranks and place fit one number, and sorting numbers beats sorting places
            key = rank[moved] << 42 | rank[after] << 21 | np.arange(len(moved))
            key.sort()
            moved, key = moved[key & (1 << 21) - 1], key >> 21
        else:
            key = rank[moved] << 32 | rank[after]
            by = np.argsort(key)
            moved, key = moved[by], key[by]
        order[slots] = moved
        h *= 2


def long_prefix_runs(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix order, the number of its run; neighbours in a run share ``least`` values or more.

    Breadth-first backward extension: the intervals of all strings of length l give those of length
    l + 1 through the last-to-first mapping. An interval whose right border is still open sets it to l
    and lives on; others only repeat what is known. Each border is set once, at its own value.
    """
    n = len(text)
    bwt = text[order - 1]
    stable = np.argsort(bwt, kind="stable")
    to_first = np.empty(n, np.int64)
    to_first[stable] = np.arange(n)
    head = bwt[stable]
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    left, right = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(least):
        size = right - left + 1
        ends = np.cumsum(size)
        whose = np.repeat(np.arange(len(size)), size)
        rows = np.arange(ends[-1]) - np.repeat(ends - size - left, size)
        f = to_first[rows]
        if len(f) * 16 > n:
            owner = np.full(n, -1, np.int64)
            owner[f] = whose
            f = np.flatnonzero(owner >= 0)
            whose = owner[f]
        else:
            by = np.argsort(f)
            f, whose = f[by], whose[by]
        sign = head[f]
        new = np.ones(len(f), bool)
        new[1:] = (np.diff(f) != 1) | (whose[1:] != whose[:-1]) | (sign[1:] != sign[:-1])
        at = np.flatnonzero(new)
        l, r = f[at], f[np.append(at[1:] - 1, len(f) - 1)]
        fresh = open_[r + 1]
        left, right = l[fresh], r[fresh]
        if not len(left):
            break
        open_[right + 1] = False
    return np.cumsum(~open_[:n])


def repeated_starts(segments: list[bytes], copies: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """For each segment, the ranges (first, last) of starts whose ``least`` bytes occur in two places or more."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    text = np.append(raw.astype(np.int16) + 1, np.int16(0))
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.cumsum(size) - size
    order = suffix_order(text, least)
    run = long_prefix_runs(text, order, least)
    weight = np.zeros(len(text), np.int64)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, begin, copies)
    np.add.at(edge, begin + size - least + 1, -copies)
    weight = np.cumsum(edge)[: len(text)]  # copies of the segment at its own starts, 0 at starts that run over its end
    total = np.bincount(run, weights=weight[order])
    twice = np.zeros(len(text) + 1, bool)
    twice[order] = total[run] >= 2
    twice &= np.append(weight > 0, False)
    change = np.diff(np.concatenate([[0], twice.astype(np.int8)]))
    up = np.flatnonzero((change == 1) | (np.isin(np.arange(len(change)), begin) & twice[: len(change)]))
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    owner = np.searchsorted(begin, up, "right") - 1
    stop = np.append(np.flatnonzero(~twice), len(twice))
    down = stop[np.searchsorted(stop, up)] - 1
    down = np.minimum(down, (begin + size - least)[owner])
    for s, a, b in zip(owner.tolist(), (up - begin[owner]).tolist(), (down - begin[owner]).tolist(), strict=True):
        out[s].append((a, b))
    return out


def _unseen(keys: list[bytes], seen: set[bytes], most: int = 1_000_000) -> list[int]:
    """Places of the keys that the task hasn't met yet; the memory of a task is bounded, so some may come twice."""
    out = []
    for i, key in enumerate(keys):
        if key not in seen:
            if len(seen) >= most:
                seen.clear()
            seen.add(key)
            out.append(i)
    return out


def _runs(least: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text: its runs (minimiser, first and last start, the minimiser's own place), then its distinct minimisers and how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.take(pa.array(_unseen(batch.column(0).to_pylist(), seen), pa.int64()))
            for a, b in common.byte_slices(batch.column(1)):
                raw, offsets = text_bytes(batch.column(1).slice(a, b - a))
                text, fp, first, last, at = minimiser_runs(raw, offsets, least, k)
                cuts = pa.array(np.searchsorted(text, np.arange(b - a + 1)), pa.int32())
                begin = offsets[text]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (fp.view(np.int64), *((c - begin).astype(np.int32) for c in (first, last, at)))]
                order = np.lexsort((fp, text))
                text, fp = text[order], fp[order]
                new = np.ones(len(fp), bool)
                new[1:] = (text[1:] != text[:-1]) | (fp[1:] != fp[:-1])
                here = np.flatnonzero(new)
                cuts = pa.array(np.searchsorted(text[here], np.arange(b - a + 1)), pa.int32())
                lists += [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (fp[here].view(np.int64), np.diff(np.append(here, len(fp))))]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *lists], names=["key", "fp", "first", "last", "at", "prints", "times"])

    return run


def _segments(least: int, most: int = 100_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The segments of the given runs; the bytes go with the first of equal ones in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        seen: set[bytes] = set()
        for batch in batches:
            fresh = _unseen(batch.column(0).to_pylist(), seen)
            names = ["key", "fp", "name", "starts", "n", "anchor", "size", "content"]
            cols: list[list] = [[] for _ in names]
            held = 0
            for i in fresh:
                key, whole = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes()
                fps, first, last, at, wanted = (batch.column(j)[i].values.to_numpy() for j in range(2, 7))
                keep = np.flatnonzero(np.isin(fps, wanted))
                fps, first, last, at = (x[keep].tolist() for x in (fps, first, last, at))
                found: dict[tuple[int, bytes], list[int]] = {}
                for j, (f, s, e) in enumerate(zip(fps, first, last, strict=True)):
                    found.setdefault((f, hashlib.blake2b(whole[s : e + least], digest_size=16).digest()), []).append(j)
                for (f, name), js in found.items():
                    s, size, content = first[js[0]], last[js[0]] + least - first[js[0]], None
                    if name not in sent:
                        if len(sent) >= most:
                            sent.clear()
                        sent.add(name)
                        content = whole[s : s + size]
                        held += size
                    for c, v in zip(cols, (key, f, name, [first[j] for j in js], len(js), at[js[0]] - s, size, content), strict=True):
                        c.append(v)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _SEGMENT, strict=True)], names=names)
                    cols, held = [[] for _ in names], 0
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _SEGMENT, strict=True)], names=names)

    return run


_SEGMENT = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_RANGES = pa.list_(pa.int32())


def _extender(least: int, batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Backward extension over the segments of whole minimisers, about ``batch_bytes`` at once."""

    def solve(fps: list[int], names: list[bytes], copies: list[int], contents: list[bytes]) -> pa.RecordBatch:
        got = repeated_starts(contents, np.array(copies, np.int64), least)
        return pa.record_batch([pa.array(fps, pa.int64()), pa.array(names, pa.binary()), pa.array([[x for ab in r for x in ab] for r in got], _RANGES)], names=["fp", "name", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        total = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total >= batch_bytes and row[0] != held[0][-1]:
                    yield solve(*held)
                    held, total = ([], [], [], []), 0
                for h, v in zip(held, row, strict=True):
                    h.append(v)
                total += len(row[3])
        if held[0]:
            yield solve(*held)

    return run


def _cutter(least: int, k: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each segment cut into ``parts`` shorter ones by how far its strings begin before the minimiser.

    Equal strings begin equally far before it, so they come to equal parts. The strings of a part have
    the bytes around the minimiser in common that all of them cover; these name the part.
    """
    steps = [(least - k + 1) * p // parts for p in range(parts + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "name", "shift", "part_fp", "part_name", "n", "anchor", "size", "content"]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for fp, name, n, anchor, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for p, (low, high) in enumerate(zip(steps[:-1], (x - 1 for x in steps[1:]), strict=True)):
                    first, last = max(0, anchor - high), min(len(content) - least, anchor - low)
                    if first > last or low > high:
                        continue
                    window, part = content[anchor - low : anchor - high + least], content[first : last + least]
                    part_fp = int.from_bytes(hashlib.blake2b(window, digest_size=8, key=p.to_bytes(4, "big")).digest(), "big", signed=True)
                    for c, v in zip(cols, (fp, name, first, part_fp, hashlib.blake2b(part, digest_size=16).digest(), n, anchor - first, len(part), part), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _repeated(kinds: DataFrame, contents: DataFrame, least: int, k: int, batch_bytes: int, most_segments: int, parts: int) -> DataFrame:
    """``fp, name, ranges`` of the segments ``kinds(fp, name, n, anchor, size)`` with repeated strings.

    ``contents(fp, name, content)`` has their bytes. Segments of one minimiser meet in one task and get
    one transform; those of a minimiser with more than ``most_segments`` are cut into ``parts`` parts
    with a longer common context, which are treated in the same way. In the end a part has one string,
    and all its segments are one, so the cutting comes to an end and nothing is left out.
    """
    groups = kinds.groupBy("fp").agg(F.count("*").alias("segments"))
    lone = kinds.filter("n > 1").join(groups.filter("segments = 1"), "fp", "left_semi").select("fp", "name", F.array(F.lit(0), (F.col("size") - least).cast("int")).alias("ranges"))
    mixed = kinds.join(groups.filter("segments > 1"), "fp").join(contents, ["fp", "name"]).select("fp", "name", "n", "anchor", "content", "segments")
    mixed = common.written(mixed, "mixed")
    volume, most = mixed.agg(F.sum(F.octet_length("content")), F.max("segments")).first()
    tasks = max(2 * kinds.sparkSession.sparkContext.defaultParallelism, -(-(volume or 0) // (4 * batch_bytes)))
    small = mixed.filter(F.col("segments") <= most_segments).select("fp", "name", "n", "content").repartition(int(tasks), "fp").sortWithinPartitions("fp", "name")
    ranged = small.mapInArrow(_extender(least, batch_bytes), "fp long, name binary, ranges array<int>").filter(F.size("ranges") > 0)
    solved = lone.unionByName(ranged)
    cut = None
    if (most or 0) > most_segments:
        schema = "fp long, name binary, shift int, part_fp long, part_name binary, n long, anchor int, size int, content binary"
        cut = mixed.filter(F.col("segments") > most_segments).select("fp", "name", "n", "anchor", "content").mapInArrow(_cutter(least, k, parts), schema)
        cut = common.written(cut, "cut")
        parted = cut.select(F.col("part_fp").alias("fp"), F.col("part_name").alias("name"), "n", "anchor", "size", "content")
        again = common.written(parted.groupBy("fp", "name").agg(F.sum("n").alias("n"), F.first("anchor").alias("anchor"), F.first("size").alias("size")), "parts")
        bytes_ = parted.groupBy("fp", "name").agg(F.first("content").alias("content"))
        found = _repeated(again, bytes_, least, k, batch_bytes, most_segments, min(8 * parts, least - k + 1))
        named = found.select(F.col("fp").alias("part_fp"), F.col("name").alias("part_name"), "ranges")
        back = cut.select("fp", "name", "shift", "part_fp", "part_name").join(named, ["part_fp", "part_name"])
        solved = solved.unionByName(back.groupBy("fp", "name").agg(F.flatten(F.collect_list(F.transform("ranges", lambda x: x + F.col("shift")))).alias("ranges")))
    out = common.written(solved, "ranges")
    common.forget(mixed, *([] if cut is None else [cut, again, found]))
    return out


def _remover(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, copied, found = batch.columns
            rows = []
            for text, whole, parts in zip(texts, copied.to_pylist(), found.to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                spans: list[tuple[int, int]] = []
                if whole and len(raw) >= least:
                    spans = [(0, len(raw))]
                else:
                    for a, b in sorted((s + r[k], s + r[k + 1] + least) for p in parts or [] for r in [p["ranges"]] for s in p["starts"] for k in range(0, len(r), 2)):
                        if spans and a <= spans[-1][1]:
                            spans[-1] = spans[-1][0], max(spans[-1][1], b)
                        else:
                            spans.append((a, b))
                ends = [0, *(b for _, b in spans)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)], strict=True)) if spans else raw
                rows.append((len(raw), [{"start": a, "end": b} for a, b in spans], kept))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.record_batch([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], _SPANS), pa.array(cols[2], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, least: int = 400, k: int = 200, batch_bytes: int = 1 << 20, most_segments: int = 8192, parts: int = 8) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the bytes of each document, the removed spans, and what is left.

    Each byte goes that is covered by a string of ``least`` bytes which also starts anywhere else, in
    the same text or another row. ``spans`` are the maximal removed runs ``(start, end)`` in bytes,
    ``kept`` the other bytes one after the other. Texts are keyed by their digest, so rows that repeat
    a text cost a count; a text that is there twice goes whole if it has ``least`` bytes. A longer ``k``
    mixes fewer different contexts under one minimiser and gives more minimisers. Nothing is capped or
    sampled: a minimiser with more than ``most_segments`` different segments is cut into ``parts``
    parts with a longer common context, each with its own transform.

    A null text is empty (0 bytes, nothing removed); null ids stay null; repeated rows are each other's
    repeats; an empty table gives no rows. Columns but ``doc_id`` and ``text`` are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    keyed = rows.select("key", "text").filter(F.octet_length("text") >= least)
    times = keyed.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key", F.lit(True).alias("copied"))
    runs = keyed.mapInArrow(_runs(least, k), "key binary, fp array<long>, first array<int>, last array<int>, at array<int>, prints array<long>, times array<long>")
    runs = common.written(runs.dropDuplicates(["key"]), "runs")
    prints = runs.select("key", F.explode(F.arrays_zip("prints", "times")).alias("p")).select("key", F.col("p.prints").alias("fp"), F.col("p.times").alias("n"))
    # Written first, so that the join below has plain shuffles on both sides and adaptive execution can split a hot minimiser.
    shared = common.written(prints.groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1").select("fp"), "shared")
    wanted = prints.select("key", "fp").join(shared, "fp", "left_semi").groupBy("key").agg(F.collect_list("fp").alias("wanted"))
    pieces = keyed.join(wanted, "key").join(runs.drop("prints", "times"), "key").select("key", "text", "fp", "first", "last", "at", "wanted")
    pieces = pieces.mapInArrow(_segments(least), "key binary, fp long, name binary, starts array<int>, n long, anchor int, size int, content binary")
    pieces = common.written(pieces, "segments")
    # A row for each text and segment: rows that repeat a text gave the same.
    places = pieces.groupBy("key", "fp", "name").agg(F.first("starts").alias("starts"), F.first("n").alias("n"), F.first("anchor").alias("anchor"), F.first("size").alias("size"))
    places = common.written(places, "places")
    kinds = common.written(places.groupBy("fp", "name").agg(F.sum("n").alias("n"), F.first("anchor").alias("anchor"), F.first("size").alias("size")), "kinds")
    contents = pieces.filter("content IS NOT NULL").groupBy("fp", "name").agg(F.first("content").alias("content"))
    solved = _repeated(kinds, contents, least, k, batch_bytes, most_segments, parts)
    found = places.join(solved, ["fp", "name"]).select("key", F.struct("starts", "ranges").alias("part")).groupBy("key").agg(F.collect_list("part").alias("parts"))
    marked = common.written(found.join(times, "key", "full_outer"), "marked")
    common.forget(runs, shared, pieces, places, kinds, solved)
    both = rows.join(marked, "key", "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "parts")
    return both.mapInArrow(_remover(least), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
