"""Near duplicates among embeddings by sorted projection passes.

In each pass every vector gets the concatenated signs of its projections on random directions. Spark
orders the vectors by these strings across the cluster; each is compared with a bounded window of the
next ones. A pair at cosine c shares a long prefix in some pass with a chance that grows with the
number of passes, and the union of the verified pairs of all passes gives the components. The links of
a vector are then counted by comparing it with all vectors of its component, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import common

#: Passes at least, neighbours compared with each vector in a pass, and signs in a string.
PASSES, WINDOW, BITS = 24, 32, 48
#: The chance that all passes miss an isolated pair that just links, at most (see ``passes_for``).
MISS = 1e-3
#: Vectors in a block of a large component; components up to this size are compared in one task.
BLOCK = 8192
#: Components up to this size are compared many at a time.
_FEW = 32


def passes_for(rows: int, least: float = 0.9, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes that miss a pair at cosine ``least`` among ``rows`` spread-out vectors with a chance of ``miss`` at most.

    Two vectors share a sign with probability 1 - angle / pi. Where log2(rows / window) leading signs
    leave no more vectors than a window, a pair that shares them meets.
    """
    share = 1 - math.acos(least) / math.pi
    met = share ** max(0.0, math.log2(max(rows, 1) / window))
    return max(PASSES, math.ceil(math.log(miss) / math.log1p(-met)) if met < 1 else 1)


def directions(dims: int, passes: int, bits: int, seed: int) -> np.ndarray:
    """(passes, bits, dims) random directions, the same in every task."""
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((passes, bits, dims))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(column: pa.Array) -> np.ndarray:
    x = _vectors(column)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _hasher(passes: int, bits: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))[:, None]
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dims))
                x = _unit(part.column(1))
                short = np.rint(x * (32767 / np.abs(x).max(axis=1))[:, None]).astype("<i2")
                packed = pa.array([v.tobytes() for v in short], pa.binary())
                for p, plane in enumerate(directions(dims, passes, bits, seed)):
                    key = ((plane @ x.T >= 0) * weights).sum(axis=0)
                    n = len(x)
                    yield pa.record_batch([pa.array([p] * n, pa.int32()), pa.array([dims] * n, pa.int32()), pa.array(key, pa.int64()), part.column(0), packed], names=["pass", "dims", "key", "rep", "short"])

    return run


def _windows(batches: Iterator[pa.RecordBatch], window: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(i, j, sure, rows): pairs of rows within a window of one pass whose cosine may be ``least`` or more.

    The vectors are rounded to 16 bits; a pair is sure if its cosine is above ``least`` by more than rounding explains.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        old = held.num_rows if held is not None else 0
        rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if old else batch
        group = rows.column(0).to_numpy().astype(np.int64) << 32 | rows.column(1).to_numpy()
        left, right, certain = [], [], []
        for g in np.unique(group).tolist():
            at = np.flatnonzero(group == g)
            x = np.frombuffer(b"".join(rows.column(4).take(pa.array(at)).to_pylist()), "<i2").astype(np.float64).reshape(len(at), -1)
            norm = np.linalg.norm(x, axis=1)
            x /= norm[:, None]
            off = 0.5 * math.sqrt(x.shape[1]) / norm  # the angle that rounding may turn a vector by
            for step in range(1, min(window, len(at) - 1) + 1):
                over = np.einsum("ij,ij->i", x[:-step], x[step:]) - least
                slack = off[:-step] + off[step:] + 1e-12
                near = np.flatnonzero(over >= -slack)
                near = near[at[near + step] >= old]  # both held: compared before
                certain.append((over > slack)[near])
                left.append(at[near])
                right.append(at[near + step])
        if left:
            yield np.concatenate(left), np.concatenate(right), np.concatenate(certain), rows
        held = rows.slice(max(0, rows.num_rows - window))


def _linker(window: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A spanning forest of the sure pairs that each run of rows holds, and the pairs that exact vectors must decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, sure, rows in _windows(batches, window, least):
            ids = rows.column(3).to_numpy()
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            for part in common._forest(iter([pa.record_batch([pa.array(a[sure]), pa.array(b[sure])], names=["a", "b"])])):
                yield part.append_column("sure", pa.array([True] * part.num_rows, pa.bool_()))
            yield pa.record_batch([pa.array(a[~sure]), pa.array(b[~sure]), pa.array([False] * int((~sure).sum()), pa.bool_())], names=["a", "b", "sure"])

    return run


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, where each tile begins) from rows sorted by tile, their first four columns; no tile is cut."""
    held: list[pa.RecordBatch] = []

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        keys = [rows.column(k).to_numpy() for k in range(4)]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] == batch.column(k)[-1] for k in range(4)):
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        at = starts(rows)
        if len(at) > 1:
            yield rows.slice(0, int(at[-1])), at[:-1]
        held = [rows.slice(int(at[-1]))]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield rows, starts(rows)


def _counter(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many vectors, copies counted, each row is linked with in its tile: one block, or one with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _whole_tiles(batches):
            dims, ti, tj, block, copies = (rows.column(k).to_numpy() for k in (1, 2, 3, 4, 6))
            n, got = copies.astype(np.float64), np.zeros(rows.num_rows)
            sizes = np.diff(np.append(at, rows.num_rows))
            tile = np.repeat(np.arange(len(at)), sizes)
            few = (sizes <= _FEW)[tile] & (ti == tj)
            for d in np.unique(dims[few]).tolist():
                rest = np.flatnonzero(few & (dims == d))
                x, t = _unit(rows.column(7).take(pa.array(rest))), tile[rest]
                for step in range(1, _FEW):
                    i = np.flatnonzero(t[:-step] == t[step:])
                    if not len(i):
                        break
                    i = i[np.einsum("ij,ij->i", x[i], x[i + step]) >= least]
                    got[rest[i]] += n[rest[i + step]]
                    got[rest[i + step]] += n[rest[i]]
            for a, size in zip(at.tolist(), sizes.tolist(), strict=True):
                if few[a]:
                    continue
                x = _unit(rows.column(7).slice(a, size))
                same = ti[a] == tj[a]
                left, right = (np.arange(size),) * 2 if same else (np.flatnonzero(block[a : a + size] == k) for k in (ti[a], tj[a]))
                y = x[right].T
                for k in range(0, len(left), 512):
                    part = left[k : k + 512]
                    near = (x[part] @ y >= least).astype(np.float64)
                    if same:
                        near[np.arange(len(part)), part] = 0.0
                    else:
                        got[a + right] += n[a + part] @ near
                    got[a + part] += near @ n[a + right]
            yield pa.record_batch([rows.column(5), pa.array(got.astype(np.int64))], names=["id", "k"])

    return run


def _cosine(a: str, b: str) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))


def _balls(members: DataFrame, least: float, rounds: int) -> DataFrame:
    """``members`` with ``ball``: round by round, the smallest id that has no ball yet leads in each component."""
    half = math.sqrt((1 + least) / 2) + 1e-9
    names = ["component", "dims", "rep", "n", "embedding"]
    open_, out = members, None
    for _ in range(rounds):
        lead = open_.groupBy("component", "dims").agg(F.min_by(F.struct(F.col("rep").alias("l_rep"), F.col("embedding").alias("lead")), F.col("rep")).alias("l")).select(F.col("component").alias("c"), F.col("dims").alias("d"), "l.*")
        near = common.written(open_.join(lead, (F.col("component") == F.col("c")) & (F.col("dims") == F.col("d"))).withColumn("inside", (F.col("embedding") == F.col("lead")) | (_cosine("embedding", "lead") >= half)).select(*names, F.col("l_rep").alias("ball"), "inside"), "balls")
        got = near.filter("inside").select(*names, "ball")
        out = got if out is None else out.unionByName(got)
        open_ = near.filter("NOT inside").select(*names)
    rest = open_.withColumn("ball", F.lit(None).cast("long"))
    return rest if out is None else out.unionByName(rest)


def _tiles(members: DataFrame, block: int) -> DataFrame:
    """The rows of each pair of blocks that must be compared: all of a component but those of one ball.

    A block has about ``block`` vectors of one ball, or of none, so no task gets more than two of them
    however large a component is.
    """
    kinds = members.groupBy("component", "dims", "ball").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"))
    w = Window.partitionBy("component", "dims")
    upto = F.sum("k").over(w.orderBy(F.col("ball").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    kinds = kinds.select(F.col("component").alias("c"), F.col("dims").alias("d"), F.col("ball").alias("kind"), "k", (upto - F.col("k")).cast("int").alias("first"), F.sum("k").over(w).cast("int").alias("blocks"))
    on = (F.col("component") == F.col("c")) & (F.col("dims") == F.col("d")) & F.col("ball").eqNullSafe(F.col("kind"))
    own = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("k"))).cast("int")
    rows = members.join(kinds, on).withColumn("block", own)
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("ball").isNull() | (j < F.col("first")) | (j >= F.col("first") + F.col("k")))
    return rows.withColumn("j", F.explode(other)).select("component", "dims", F.least("block", "j").alias("ti"), F.greatest("block", "j").alias("tj"), "block", "rep", "n", "embedding")


def link_embeddings(vectors: DataFrame, least: float = 0.9, passes: int | None = None, window: int = WINDOW, bits: int = BITS, seed: int = 3, ball_rounds: int = 4, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors(vec_id, embedding)``.

    Equal vectors fold into one with a count. The passes find components; their number follows from the
    number of different vectors (``passes_for``) unless it is given. All vectors of a component
    are then compared, so ``n_links`` is exact for the components found. In components of more than
    ``block`` vectors, those within half the linking angle of a leader are all linked with each other
    (angles add up), so such a ball is counted by its size. What no ball settles is compared block by
    block: a component of m vectors makes up to m * m / ``block`` rows, and m * m / 2 cosines.

    Vectors that are null or zero or hold null or non-finite components link with nothing; nor do
    vectors of different lengths, nor rows with a null ``vec_id`` (null component, kept). Equal ids are
    one node of their own vectors' links. Windows end at the border of a Spark partition; each pass has
    other borders. An empty table gives no rows; columns but the two named are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.filter(sound)
    folded = common.written(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "folded")
    passes = passes or passes_for(folded.count(), least, window)
    long = folded.select("rep", "embedding").mapInArrow(_hasher(passes, bits, seed), "pass int, dims int, key long, rep long, short binary")
    ordered = long.repartitionByRange("pass", "dims", "key", "rep").sortWithinPartitions("pass", "dims", "key", "rep")
    met = common.written(ordered.mapInArrow(_linker(window, least), "a long, b long, sure boolean"), "met")
    ends = [folded.select(F.col("rep").alias(k), F.col("embedding").alias(f"v{k}")) for k in "ab"]
    unsure = met.filter("NOT sure").select("a", "b").distinct().join(ends[0], "a").join(ends[1], "b")
    decided = unsure.filter(F.size("va") == F.size("vb")).filter(_cosine("va", "vb") >= least).select("a", "b")
    comps = common.written(common.connected_components(met.filter("sure").select("a", "b").union(decided)), "comps")

    members = comps.join(folded, F.col("node") == F.col("rep")).select("component", F.size("embedding").alias("dims"), "rep", "n", "embedding")
    sized = common.written(members.withColumn("large", F.count("*").over(Window.partitionBy("component", "dims")) > block), "members")
    names = ["component", "dims", "rep", "n", "embedding"]
    large = sized.filter("large").select(*names)
    small = sized.filter("NOT large").select(*names)
    in_balls = common.written(_balls(large, least, ball_rounds if large.head(1) else 0), "in_balls")
    sizes = in_balls.filter("ball IS NOT NULL").groupBy("component", "dims", "ball").agg(F.sum("n").alias("ball_n"))
    one = F.lit(0)
    tiles = small.select("component", "dims", one.alias("ti"), one.alias("tj"), one.alias("block"), "rep", "n", "embedding").unionByName(_tiles(in_balls, block))
    by_tile = tiles.repartition("component", "dims", "ti", "tj").sortWithinPartitions("component", "dims", "ti", "tj")
    across = by_tile.mapInArrow(_counter(least), "id long, k long").groupBy("id").agg(F.sum("k").alias("across"))
    all_members = in_balls.join(sizes, ["component", "dims", "ball"], "left").select("rep", "embedding", "component", F.coalesce("ball_n", "n").alias("own")).unionByName(small.select("rep", "embedding", "component", F.col("n").alias("own")))
    in_comps = all_members.join(across, F.col("rep") == F.col("id"), "left").select("embedding", (F.col("own") - 1 + F.coalesce("across", F.lit(0))).alias("links"), F.col("component").alias("comp"))
    single = folded.join(comps, F.col("rep") == F.col("node"), "left_anti").select("embedding", (F.col("n") - 1).alias("links"), F.col("rep").alias("comp"))
    by_rep = in_comps.unionByName(single)
    linked = valid.join(by_rep, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("comp").alias("component_id"))
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
