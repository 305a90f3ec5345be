"""Token counts kept up to date by deltas: signed batches that add up by source, language and tokenizer.

A batch is a set of signed rows: +1 for an inserted document, -1 for a deleted one, both for a revised
count. It is added up before it is stored, and stored once: a batch id that is already committed is
left as it is, so a job that is run again after a failure changes nothing. ``compact`` folds committed
batches into a base, which keeps their ids, so readers open one table and the batches since.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import common

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
#: Tokenizers that a regular expression can express: name and version -> pattern of a token.
TOKENIZERS = {"words@1": r"[^\x20\x09-\x0D]+", "pieces@1": r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+"}


def inserts(counts: DataFrame) -> DataFrame:
    """``counts(doc_id, source, lang, tokenizer, n_tokens, n_chars)`` as additions."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_chars").cast("long").alias("n_chars"))


def deletes(counts: DataFrame) -> DataFrame:
    """The rows that were counted before, taken away."""
    return inserts(counts).select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts ``old`` replaced by ``new``: the key may change too (another tokenizer version)."""
    return deletes(old).unionByName(inserts(new))


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of the folders in ``folder``."""
    p, files = _path(spark, folder)
    if not files.exists(p):
        return []
    names = (x.getPath().getName() for x in files.listStatus(p))
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def _base(spark: SparkSession, folder: str) -> str | None:
    """The newest base, if there is one."""
    found = _names(spark, folder, "base=")
    return f"{folder}/base={found[-1]}" if found else None


def _folded(spark: SparkSession, base: str | None) -> set[str]:
    """Ids of the batches in a base: a short string for each commit there ever was, no rows of data."""
    return {r[0] for r in spark.read.schema("id string").parquet(f"{base}/ids").collect()} if base else set()


def is_committed(spark: SparkSession, folder: str, batch_id: str) -> bool:
    p, files = _path(spark, f"{folder}/batch={batch_id}")
    return files.exists(p) or batch_id in _folded(spark, _base(spark, folder))


def commit(signed: DataFrame, folder: str, batch_id: str) -> bool:
    """Add a batch to the rollup in ``folder``; False if that batch was there already.

    The sums are written beside the rollup and renamed into place by a rename that fails if the name is
    taken, so a reader sees a whole batch or none, and of two writers of the same batch one wins, even
    if both found it missing before. (On stores without an atomic rename, run one committer at a time.)
    Null keys are keys of their own; null counts add nothing.
    """
    spark = signed.sparkSession
    if is_committed(spark, folder, batch_id):
        return False
    sums = signed.groupBy(*KEYS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS))
    pending = common.new_folder(spark, "pending")
    sums.filter(" OR ".join(f"{c} <> 0" for c in SUMS)).write.parquet(pending)
    source, files = _path(spark, pending)
    target, _ = _path(spark, f"{folder}/batch={batch_id}")
    source, target = files.makeQualified(source), files.makeQualified(target)
    files.mkdirs(target.getParent())
    if _renamed(spark, source, target):
        return True
    common.drop_folder(spark, pending)
    return False


def _renamed(spark: SparkSession, source, target) -> bool:  # noqa: ANN001
    """Rename a folder unless the new name is taken; a plain rename would move it into a folder of that name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf)
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, no_overwrite)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def _sums(spark: SparkSession, folder: str, base: str | None, batches: list[str]) -> DataFrame:
    paths = [f"{base}/sums"] * (base is not None) + [f"{folder}/batch={x}" for x in batches]
    if not paths:
        return spark.range(0).select(*(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SCHEMA.split(", ")))
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)
    sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
    return sums.filter(" OR ".join(f"{c} <> 0" for c in SUMS))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of all committed batches; keys whose documents are all gone are left out.

    Read are the newest base and the batches that are not in it.
    """
    base = _base(spark, folder)
    folded = _folded(spark, base)
    return _sums(spark, folder, base, [x for x in _names(spark, folder, "batch=") if x not in folded])


def compact(spark: SparkSession, folder: str) -> bool:
    """Fold all committed batches into a new base; False if there was nothing to fold or another base came first.

    The base is written beside the rollup and takes the next number by a rename that fails if that is
    taken, so of two jobs that compact at once one wins and the other's work is dropped. Batches stay
    where they are until ``vacuum``; a batch whose id is in the base counts once, also if a slow writer
    commits it again later.
    """
    base = _base(spark, folder)
    folded = _folded(spark, base)
    new = [x for x in _names(spark, folder, "batch=") if x not in folded]
    if not new:
        return False
    pending = common.new_folder(spark, "pending")
    _sums(spark, folder, base, new).write.parquet(f"{pending}/sums")
    ids = spark.range(1).select(F.explode(F.split(F.lit("/".join(sorted(folded | set(new)))), "/")).alias("id"))  # no name holds a slash
    ids.coalesce(1).write.parquet(f"{pending}/ids")
    source, files = _path(spark, pending)
    number = int(base.rpartition("=")[2]) + 1 if base else 1
    target, _ = _path(spark, f"{folder}/base={number:012d}")
    if _renamed(spark, files.makeQualified(source), files.makeQualified(target)):
        return True
    common.drop_folder(spark, pending)
    return False


def vacuum(spark: SparkSession, folder: str) -> None:
    """Delete folded batches and all bases but the newest; run it when nobody reads an older base any more."""
    base = _base(spark, folder)
    for x in sorted(_folded(spark, base) & set(_names(spark, folder, "batch="))):
        common.drop_folder(spark, f"{folder}/batch={x}")
    for x in _names(spark, folder, "base=")[:-1]:
        common.drop_folder(spark, f"{folder}/base={x}")


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, text_key, n_chars`` and a count for each of ``TOKENIZERS``; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    counts = (F.regexp_count(text, F.lit(p)).cast("long").alias(t) for t, p in TOKENIZERS.items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.md5(text.cast("binary")).alias("text_key"), F.length(text).cast("long").alias("n_chars"), *counts)


def by_tokenizer(counts: DataFrame) -> DataFrame:
    """One row for each document and tokenizer."""
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("tokenizer"), F.col(f"`{t}`").alias("n_tokens")) for t in TOKENIZERS)))
    return counts.select("doc_id", "source", "lang", "text_key", "n_chars", pairs.alias("p")).select("doc_id", "source", "lang", "text_key", "n_chars", "p.*")


def maintain(docs: DataFrame, folder: str) -> DataFrame:
    """The life of a corpus in three batches, each committed twice, and the totals that remain. The
    first two are folded into a base before the third comes.

    ``load`` inserts every document with an estimate (a fourth of its characters, tokenizer
    ``estimate@1``); ``recount`` replaces the estimates by exact counts of both tokenizers; ``dedup``
    deletes all documents but the smallest id of each text. Result: ``source, lang, tokenizer, n_docs,
    n_tokens, n_chars``. Null sources and languages are keys; null text is empty text; rows with a null
    id are counted, and deleted if any row with an id has their text. Of rows that repeat id and text,
    all stay. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    counts = common.written(document_counts(docs), "counts")
    estimate = counts.select("source", "lang", F.lit("estimate@1").alias("tokenizer"), F.floor(F.col("n_chars") / 4).cast("long").alias("n_tokens"), "n_chars")
    exact = by_tokenizer(counts)
    first = counts.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("text_key", "first_id")
    copies = exact.join(first, "text_key").filter("first_id IS NOT NULL AND (doc_id IS NULL OR doc_id <> first_id)")
    for batch_id, signed in (("load", inserts(estimate)), ("recount", revisions(estimate, exact)), ("dedup", deletes(copies))):
        commit(signed, folder, batch_id)
        commit(signed, folder, batch_id)  # as after a retry: changes nothing
        if batch_id == "recount":
            compact(spark, folder)
    return totals(spark, folder)


def oracle_sql() -> str:
    """DuckDB SQL of ``maintain`` over ``documents``."""
    counts = " UNION ALL ".join(f"SELECT source, lang, '{t}' AS tokenizer, len(regexp_extract_all(text, '{p}')) AS n, text FROM kept" for t, p in TOKENIZERS.items())
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
kept AS (SELECT source, lang, text FROM (SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM d)
         WHERE first_id IS NULL OR doc_id = first_id)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, sum(length(text))::BIGINT AS n_chars
FROM ({counts}) GROUP BY ALL
"""
