"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import common, embedding_dedup, minhash_dedup, mixing, packing, pii, quality, secret_scan, spelling, suffix_dedup, token_output, token_rollup, toxicity, whitening


#: The key of the registered queries over made-up data, where the session names none. It is public: real data needs another.
TRIAL_KEY = "key for trials over made-up data"


def pii_key(spark: SparkSession) -> str:
    """The session's ``spark.quillmark.pii.key``, else the key for trials."""
    return spark.conf.get("spark.quillmark.pii.key", None) or TRIAL_KEY


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary token shards of all documents, read back."""
    manifest = token_output.write_tokens(common.table(spark, sf_dir, "documents"), common.new_folder(spark, "tokens"))
    return token_output.read_digest(manifest)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance and draw of each document under the default targets."""
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup.link_embeddings(common.table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with pseudonyms, and what was found in each."""
    return pii.pseudonymise_documents(common.table(spark, sf_dir, "documents"), pii_key(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash_dedup.group_near_duplicates(common.table(spark, sf_dir, "documents"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after a load, a recount and a deletion of copies."""
    return token_rollup.maintain(common.table(spark, sf_dir, "documents"), common.new_folder(spark, "rollup"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings of 400 bytes."""
    left = suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), digest, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(common.table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document."""
    return quality.judge(common.table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of each vector."""
    white = whitening.whiten(common.table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frequent word with the form that it is a variant of."""
    return spelling.spelling_variants(common.table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: the rules' counts and digest, and all spans."""
    found = secret_scan.find_secrets(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secret_scan.span_text(F.filter("spans", lambda x: x["kind"] != "learned")), 256)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base.alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_mixing, op3_embedding_dedup, op4_pii, op5_toxicity, op6_minhash_dedup, op7_token_rollup, op8_suffix_dedup, op9_packing, op10_quality, op11_whitening, op12_spelling_variants, op13_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle_sql(), "op7_token_rollup": token_rollup.oracle_sql(), "op10_quality": quality.oracle_sql()}
