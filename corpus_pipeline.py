"""A training corpus from raw documents: filter, deduplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; ``run`` writes every stage's result as Parquet in the shared
scratch folder and reads it back as the next one's documents.  All stages but
the last return the columns of their input.

Defined results: null texts are empty ones and are judged as such; rows without
an id are never dropped as duplicates; rows that repeat a doc_id are one document
to the near copies and stay together there, but each is mixed as a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import mixing, quality, sentencepiece, similar, toxicity
from ledgerline.sources.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL: trained dictionaries, token scans and sub-word merges have no SQL form.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(spark, docs, labels)
    return docs.filter(quality.score_column(spark, model)("text") >= 0.3)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(spark, docs, labels)
    return docs.filter(toxicity.score_column(spark, model)("text") < 0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near copies: SimHash candidates, verified at similarity 0.8 of five-word shingles."""
    search, kept = Scratch(spark, "similar"), Scratch(spark, "dropped")
    groups = similar.near_duplicates(spark, docs, words=5, similarity=0.8, scratch=search)
    dropped = kept.save(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    search.clear()  # the tables of the search would lie there through all later stages
    return docs.join(dropped.alias("gone"), docs["doc_id"] == F.col("gone.__dropped"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    numbered = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("copy"), F.monotonically_increasing_id().alias("__row"))
    rows = Scratch(spark, "rows").save(numbered, "rows")
    taken = mixing.mix(spark, rows.select("copy.doc_id", "copy.text", "copy.source", "__row"), row="__row")
    taken = taken.filter("copies > 0").select(F.col("__row").alias("__taken"), F.col("copies").cast("int").alias("__copies"))
    repeated = rows.join(taken, F.col("__row") == F.col("__taken"))
    return repeated.select(F.explode(F.array_repeat("copy", F.col("__copies"))).alias("copy")).select("copy.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): token ids, and whether they decode to the text."""
    import public_tokenizers

    coded = sentencepiece.encode_decode(spark, docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = made
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
