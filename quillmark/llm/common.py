"""What several corpus operators share: shared folders, written steps, words and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]"

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` of the session wins. Only a local session that names none, as in tests,
    gets a temporary folder, once; elsewhere executors would each write to their own disk, so it raises.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    This cuts the lineage: a lost executor makes Spark read the files again, not redo the steps.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillmark_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote; call it only when no lazy frame reads it any more."""
    for df in frames:
        if path := getattr(df, "quillmark_path", None):
            drop_folder(df.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Send rows to workers in Arrow batches of about 4 MB, unless the session sets a size itself.

    Spark's own bound is 64 MB, held outside the heap while a batch is filled and once more in the
    worker, for each task at once. Operators cut their batches to less anyway.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over all columns, which ``run`` returns in their order; names with dots are no hindrance."""
    small_batches(df.sparkSession)
    names = df.columns
    places = df.toDF(*(f"c{i}" for i in range(len(names))))
    again = lambda batches: (pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names) for b in run(batches))
    return places.mapInArrow(again, df.schema)


# --- words ------------------------------------------------------------------------------------


def byte_slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows with about ``most`` bytes of text each, one row at least.

    After the last one Arrow gives freed memory back, which idle workers would keep beside the busy ones.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            total, start = 0, i
        total += n
    if start < len(sizes):
        yield start, len(sizes)
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and how many each text has."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    keep = filled.to_numpy(zero_copy_only=False)
    counts = np.bincount(owner[keep], minlength=len(texts)).astype(np.int64)
    return flat.filter(filled), counts


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


# --- connected components ---------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: (node, root) for each node that isn't a root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; component: the smallest node reached.

    Union-find within each partition thins the edges to a forest; then large-star and small-star
    rounds (Kiveris et al., 2014) run on Spark until nothing changes. Every node keeps its edges to
    a minimum that is aggregated map-side, so a hub with a third of all nodes is a skewed join side
    that adaptive execution splits; no component is gathered anywhere. Null ends and self edges are
    ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    flat = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    flat = flat.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    state = written(flat.mapInArrow(_forest, "a long, b long").distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        big = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.filter("a <> b").distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = written(small.filter("a <> b").distinct(), "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.col("b") % 1_000_003)).first()
        forget(state)
        state = new
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
