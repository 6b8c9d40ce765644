"""File catalogs: a real folder, or the virtual one over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.functions import names, rules

#: The moment at which the virtual catalog's ages are taken (2024-01-31 UTC).
AS_OF = 1706659200
INTERNAL = (".ledgerline_logs", ".ledgerline_trash")
TRASH = "/.ledgerline_trash/"
_DIRS = ["", "Images", "Documents", "Code", "misc"]
_SUFFIXES = [".jpg", ".PNG", ".mp4", ".pdf", ".csv", ".zip", ".py", "", ".tmp", ".tif", ".md", ".xyz"]


def with_names(files: DataFrame) -> DataFrame:
    """Adds ext, category and is_excluded to (path, name, ...)."""
    return (
        files.withColumn("ext", names.extension(F.col("name")))
        .withColumn("category", rules.category(F.col("ext")))
        .withColumn("is_excluded", names.is_excluded(F.col("name"), rules.EXCLUDES))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, root, parent, name, size, mtime, content, ext, category, is_excluded) over ``documents``.

    A null text is a file whose size is unknown.
    """
    k = F.floor(F.col("doc_id") / 20).cast("long")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    root = F.concat(F.lit("/ws/"), F.coalesce("source", F.lit("unknown")))
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        root.alias("root"),
        pick(_DIRS, k % 5).alias("dir"),
        F.concat(F.lit("f_"), k.cast("string"), pick(_SUFFIXES, k % 12)).alias("name"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(AS_OF) - (F.col("doc_id") * 7 % 400) * 86400).cast("double").alias("mtime"),
        F.col("text").alias("content"),
    )
    folder = F.when(F.col("dir") == "", F.col("root")).otherwise(F.concat_ws("/", "root", "dir"))
    return with_names(base.withColumn("parent", folder).withColumn("path", F.concat_ws("/", "parent", "name")))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog without excluded files."""
    return files(spark, sf_dir).filter(~F.col("is_excluded"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, run_ts, seq, source, destination, is_undone, destination_exists, source_occupied) over ``events``."""
    day = F.date_format("ts", "yyyyMMdd")
    root = F.concat(F.lit("/ws/src"), (F.col("user_id") % 20).cast("string"))
    leaf = F.concat(F.lit("f_"), F.col("event_id").cast("string"), F.lit(".dat"))
    moved = F.when(F.col("event_type") == "error", F.concat(root, F.lit(TRASH), day, F.lit("/"), leaf)).otherwise(
        F.concat_ws("/", root, "event_type", leaf)
    )
    run = F.concat(F.lit("run_"), day, F.lit("_"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    in_run = Window.partitionBy("run_id").orderBy("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        run.alias("run_id"),
        day.alias("run_day"),
        "event_id",
        root.alias("root"),
        F.concat_ws("/", root, leaf).alias("source"),
        moved.alias("destination"),
        (F.col("user_id") % 7 == 0).alias("is_undone"),
        (F.col("event_id") % 10 != 0).alias("destination_exists"),
        (F.col("event_id") % 13 == 0).alias("source_occupied"),
    ).withColumn("seq", F.row_number().over(in_run))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, has_file) over ``pages``: each host and its first path segment; a third of pages hold a file."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")
    parts = F.split(bare, "/")
    leaf = F.concat_ws("/", F.lit("/ws"), parts[0], F.nullif(F.get(parts, F.lit(1)), F.lit("")))
    seen = pages.filter("url is not null").select(leaf.alias("path"), (F.col("page_id") % 3 == 0).alias("has_file"))
    hosts = pages.filter("url is not null").select(F.concat_ws("/", F.lit("/ws"), parts[0]).alias("path"), F.lit(False).alias("has_file"))
    return seen.unionByName(hosts).groupBy("path").agg(F.max("has_file").alias("has_file"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, b0..b3): four 16-bit bands of the signs of ``embeddings``; bit i of band b is element 16b + i >= 0."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    band = lambda b: F.aggregate(
        F.sequence(F.lit(0), F.lit(15)),
        F.lit(0),
        lambda acc, i: acc + F.when(F.get("embedding", F.lit(16 * b) + i) >= 0, F.pow(F.lit(2), i).cast("int")).otherwise(0),
    )
    return vectors.select(F.col("vec_id").alias("id"), *[band(b).alias(f"b{b}") for b in range(4)])
