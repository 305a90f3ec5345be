"""Packing of documents into training sequences: first-fit decreasing over a tournament tree.

Documents are dealt by a keyed hash into random groups of about ``group_bytes`` of text, and each
group is packed on its own: no state is shared, so groups run wherever Spark puts them, and a group
that is run again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.tokens import WordEncoder, default_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a group begin at its number times this; a group has far fewer sequences.
STRIDE = 1 << 32


class TournamentTree:
    """Room left in each bin, with the most room of each subtree above, to find the first bin that fits."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * (2 * self.leaves)
        self.room[self.leaves : self.leaves + bins] = [capacity] * bins
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def put(self, size: int) -> int:
        """Put ``size`` into the first bin that has room and return the bin."""
        room, i = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        bin_ = i - self.leaves
        room[i] -= size
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return bin_


def pack_group(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length): whole items by first-fit decreasing, then gaps filled by cuts.

    Items over the capacity first give full bins of their own. After first-fit decreasing, the
    emptiest bins are taken apart and cut to fill the gaps of the fullest, so that one bin of a
    group at most has room left.
    """
    full, rest = [], []
    for i, n in enumerate(sizes):
        whole = n // capacity * capacity
        full += [[(i, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((n - whole, i, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = TournamentTree(max(1, len(rest)), capacity), [[] for _ in rest]
    for n, i, s in rest:
        bins[tree.put(n)].append((i, s, n))
    bins = [b for b in bins if b]
    room = {k: capacity - sum(x[2] for x in b) for k, b in enumerate(bins)}
    order = sorted(room, key=lambda k: (room[k], k))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, source = order[lo], bins[order[hi]]
        if not room[to]:
            lo += 1
            continue
        i, s, n = source.pop()
        take = min(n, room[to])
        bins[to].append((i, s, take))
        room[to] -= take
        if take < n:
            source.append((i, s + take, n - take))
        elif not source:
            hi -= 1
    return full + [bins[k] for k in order[: hi + 1]]


def _packer(tokenizer: str, capacity: int, end: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts, doc_ids = group.column("text").cast(pa.large_string()).combine_chunks(), group.column("doc_id").to_pylist()
        ids, sizes = [], []
        for a, b in common.byte_slices(texts, 8 << 20):
            got, n = WordEncoder.of(tokenizer).encode(texts.slice(a, b - a).cast(pa.string()), end)
            ids.append(got.astype("<u4"))
            sizes += n.tolist()
        flat = np.concatenate(ids)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1].tolist()
        rows = []
        for k, b in enumerate(pack_group(sizes, capacity)):
            at = 0
            for i, s, n in b:
                rows.append((doc_ids[i], s, n, zlib.crc32(flat[first[i] + s : first[i] + s + n]), sizes[i], key[0].as_py() * STRIDE + k, at))
                at += n
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return pack


def pack_documents(docs: DataFrame, capacity: int = 4096, group_bytes: int = 4 << 20, seed: int = 0, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document's ids (with ``end``) lie in its pieces exactly once. In each group of about
    ``group_bytes`` of text, all sequences but the last are full, so padding is under one sequence a
    group whatever the lengths are. Null or empty text: one piece of one id. Null ``doc_id``s are
    packed like others (dealt by their text). Repeated ids keep their own rows, in one group. An empty
    table gives no rows. Columns but ``doc_id`` and ``text`` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    groups = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    key = F.coalesce(F.xxhash64("doc_id", F.lit(seed)), F.xxhash64("text", F.lit(seed)))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(key)
    return rows.withColumn("bin_group", F.pmod(key, F.lit(groups))).groupBy("bin_group").applyInArrow(_packer(tokenizer or default_tokenizer(), capacity, end), SCHEMA)
