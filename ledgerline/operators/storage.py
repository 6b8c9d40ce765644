"""Storage use by category, extension and folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions import names

BAR_WIDTH = 30


def _bytes() -> Column:
    return F.sum(F.coalesce("size", F.lit(0))).alias("bytes")


def by(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_files, bytes); a file of unknown size counts with no bytes."""
    return files.groupBy(*keys).agg(F.count("*").alias("n_files"), _bytes())


def by_category(files: DataFrame) -> DataFrame:
    """Use per category with its size label, whole-number share and bar.

    The windows run over one row per category, after the aggregation.
    """
    whole = Window.partitionBy()
    top = F.max("bytes").over(whole)
    share = F.coalesce(F.floor(F.try_divide(F.col("bytes"), F.sum("bytes").over(whole)) * 100), F.lit(0))
    bar = F.when(F.col("bytes") == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.try_divide(F.col("bytes"), top) * BAR_WIDTH)))
    return (
        by(files, "category")
        .withColumn("pct", share.cast("long"))
        .withColumn("bar", bar.cast("int"))
        .withColumn("size_label", names.size_label(F.col("bytes")))
    )


def telemetry(files: DataFrame) -> DataFrame:
    """One row: files, bytes, excluded and unreadable files; excluded ones count nowhere else."""
    kept = ~F.col("is_excluded")
    return files.agg(
        F.count_if(kept).alias("n_files"),
        F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if("is_excluded").alias("n_excluded"),
        F.count_if(kept & F.col("size").isNull()).alias("n_unreadable"),
    )


def rule_preview(files: DataFrame, as_of: float, size_mb: float | None, age_days: float | None) -> DataFrame:
    """One row: files at or over any given threshold, and their bytes."""
    tests = F.lit(False)
    if size_mb is not None:
        tests = tests | F.coalesce(names.size_mb(F.col("size")) >= size_mb, F.lit(False))
    if age_days is not None:
        tests = tests | F.coalesce(names.age_days(F.col("mtime"), as_of) >= age_days, F.lit(False))
    return files.filter(tests).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def ranked(use: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``use`` (key, bytes, ...) with its position by bytes, largest first, ties by key; the first ``most`` if asked.

    The window runs over one row per key.
    """
    cut = use if most is None else use.orderBy(F.desc("bytes"), key).limit(most)
    return cut.withColumn("position", F.row_number().over(Window.orderBy(F.desc("bytes"), key)))


def cumulative(use: DataFrame, key: str) -> DataFrame:
    """(key, bytes, start_ppm, end_ppm): each key's arc of the whole in millionths, largest first."""
    order = Window.orderBy(F.desc("bytes"), key)
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    share = lambda b: F.coalesce(F.floor(F.try_divide(b * 1000000.0, F.sum("bytes").over(Window.partitionBy()))), F.lit(0)).cast("long")
    return use.select(key, "bytes", share(upto - F.col("bytes")).alias("start_ppm"), share(upto).alias("end_ppm"))


def bar_chart(use: DataFrame) -> DataFrame:
    """(position, line): a line of text per category of ``by_category``, largest first; one line if there is nothing."""
    lines = ranked(use, "category").select(
        "position", F.concat(F.rpad("category", 16, " "), F.lit(" "), F.repeat(F.lit("█"), F.col("bar")), F.lit(" "), F.col("size_label")).alias("line"), "bytes"
    )
    nothing = lines.agg(F.coalesce(F.max("bytes"), F.lit(0)).alias("top")).filter("top = 0").select(F.lit(1).alias("position"), F.lit("(nothing to show)").alias("line"))
    return lines.filter("bytes > 0").select("position", "line").unionByName(nothing)


def with_totals(counts: DataFrame, key: str, part: str, n: str) -> DataFrame:
    """``counts`` (key, part, n) and a row per key with null part and the total; null parts of the input stay apart as ``?``."""
    named = counts.withColumn(part, F.coalesce(part, F.lit("?")))
    return named.unionByName(named.groupBy(key).agg(F.lit(None).cast("string").alias(part), F.sum(n).alias(n)))


def overview(files: DataFrame, duplicates: DataFrame, top: int = 5) -> DataFrame:
    """(section, position, label, n, bytes): the report's sections as rows.

    Extensions and categories by bytes, totals, duplicate groups by wasted
    bytes, and files that cannot be read.
    """
    kept = files.filter("not is_excluded")
    row = lambda section, label, n, size: [F.lit(section).alias("section"), "position", label.alias("label"), n.cast("long").alias("n"), size.cast("long").alias("bytes")]
    parts = [
        ranked(by(kept, key), key).select(*row(section, F.col(key), F.col("n_files"), F.col("bytes"))) for section, key in (("category", "category"), ("extension", "ext"))
    ]
    nothing = "cast(null as bigint)"
    stacked = f"stack(3, 1, 'files', n_files, bytes, 2, 'excluded', n_excluded, {nothing}, 3, 'unreadable', n_unreadable, {nothing}) as (position, label, n, size)"
    whole = telemetry(files).select(F.expr(stacked))
    parts.append(whole.select(*row("total", F.col("label"), F.col("n"), F.col("size"))))
    groups = duplicates.filter("not is_extra").select("group_path", "n_copies", ((F.col("n_copies") - 1) * F.col("size")).alias("bytes"))
    parts.append(ranked(groups, "group_path", top).select(*row("duplicates", F.col("group_path"), F.col("n_copies"), F.col("bytes"))))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
