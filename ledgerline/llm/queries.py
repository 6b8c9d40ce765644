"""The registered query of each operator, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import cover, language_model, mixing, quality, sentencepiece, simhash, topk, toxicity, urls, warc
from ledgerline.llm.labelled import fold
from ledgerline.sources.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests."""
    import public_tokenizers

    coded = sentencepiece.encode_decode(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text, learnt from all but one fold of seven."""
    return language_model.score(spark, _table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return cover.near_duplicates(spark, _table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best candidates of every vector whose id is divisible by 50."""
    return topk.search(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    scored = toxicity.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url, by rule or else by the trees."""
    return urls.judge(spark, _table(spark, sf_dir, "pages"), RULES)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes from every document."""
    return mixing.mix(spark, _table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back from the archive."""
    archive = warc.write_archive(spark, _table(spark, sf_dir, "pages"), Scratch(spark, "warc").path)
    return warc.read_index(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_language_model": op2_language_model,
        "op3_cover": op3_cover,
        "op4_topk": op4_topk,
        "op5_toxicity": op5_toxicity,
        "op6_urls": op6_urls,
        "op7_mixing": op7_mixing,
        "op8_simhash": op8_simhash,
        "op9_quality": op9_quality,
        "op10_warc": op10_warc,
    }


ORACLES = {
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS owner FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to
        FROM q""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES
