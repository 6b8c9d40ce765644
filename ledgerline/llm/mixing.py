"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Among all document rates r the balanced ones are closest to one in relative
entropy, sum(r log r - r + 1), while each source's tokens meet its target and
no rate passes ``max_repeats``.  The convex dual has one multiplier per source,
and at its optimum r = min(max_repeats, exp(lambda * size / mean size)): an
exponential tilt.  Rates depend on source and size alone, so Newton works on
(source, size, count) classes, a table no larger than the number of distinct
lengths, and all sources take their step in the same distributed aggregation.

Rates become copies class by class.  Cumulative rounding along the sizes keeps
the copies of a source within half a copy of its rates at every length; what
the words still miss is then made up by its shortest documents, so the words
taken come within about one short document of the target.  Inside a class the
documents that get one copy more are those of lowest salt and hash, ranked in salted
groups whose offsets come from their counts.  The number of salts grows with the
documents, so a salted group of even the largest class has about ``salt_rows``
rows: no class is ever gathered.

Defined results: null texts count zero words; sources are ordered by code point
with null last; documents of no words take nothing; an empty table gives an
empty table.  Other columns of the input are never read.  Rows that repeat a
doc_id are mixed as separate documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerline.sources.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def source_targets(classes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, total, mean, target) by weighted shares that stop at ``max_repeats`` times a source.

    Resharing the excess until no target is above its limit is water filling:
    one level L with sum(min(weight * L, limit)) = all words.  With sources by
    limit / weight, L lies where the limits below and the weights above meet.
    """
    sums = classes.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs")
    )
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = (
        sums.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("weight", pick)
        .withColumn("limit", F.col("total") * float(max_repeats))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    rising = W.orderBy("ratio", "pos")
    upto = rising.rowsBetween(W.unboundedPreceding, -1)
    after = rising.rowsBetween(W.currentRow, W.unboundedFollowing)
    everywhere = W.partitionBy(F.lit(1))
    leveled = (
        ranked.withColumn("below", F.coalesce(F.sum("limit").over(upto), F.lit(0.0)))
        .withColumn("above", F.sum("weight").over(after))
        .withColumn("level", (F.sum("total").over(everywhere) - F.col("below")) / F.col("above"))
        # the first source whose own limit is not reached fixes the level
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "pos", "level")))
        .withColumn("level", F.coalesce(F.min("fits").over(everywhere)["level"], F.max("ratio").over(everywhere)))
    )
    return leveled.select(
        "source",
        "total",
        (F.col("total") / F.greatest(F.col("docs"), F.lit(1))).alias("mean"),
        F.least(F.col("weight") * F.col("level"), F.col("limit")).alias("target"),
    )


def _tilt(max_repeats: int, multiplier="lam"):
    """The rate of a class under its source's multiplier."""
    return F.exp(F.least(F.col(multiplier) * F.col("x"), F.lit(math.log(max_repeats))))


def balance(scratch: Scratch, classes: DataFrame, targets: DataFrame, max_repeats: int, tolerance: float, rounds: int) -> DataFrame:
    """(source, lam): guarded Newton steps on the dual, all sources at once.

    A step that leaves the bracket around the root is replaced by its middle.
    Ends when every source's tokens are within ``tolerance`` of the target, or
    after ``rounds`` steps, far more than the bracket needs.
    """
    top = math.log(max_repeats)
    state = scratch.save(
        targets.filter("total > 0").select(
            "source",
            "target",
            "mean",
            F.when(F.col("target") >= F.col("total") * (max_repeats * (1 - 1e-9)), F.col("mean") * top).otherwise(F.lit(0.0)).alias("lam"),
            (F.col("mean") * F.least(F.lit(0.0), F.log(F.col("target") / F.col("total")))).alias("lo"),
            (F.col("mean") * top).alias("hi"),
        ),
        "dual",
    )
    for _ in range(rounds):
        inner = state.withColumnRenamed("source", "s")
        fit = (
            classes.filter("size > 0")
            .join(inner, _same("source", "s"))
            .withColumn("x", F.col("size") / F.col("mean"))
            .withColumn("words", F.col("n") * F.col("size") * _tilt(max_repeats))
            .withColumn("slope", F.when(F.col("lam") * F.col("x") < top, F.col("words") * F.col("x")).otherwise(0.0))
            .groupBy("source", "target", "mean", "lam", "lo", "hi")
            .agg(F.sum("words").alias("words"), F.sum("slope").alias("slope"))
            .withColumn("gap", F.col("words") - F.col("target"))
            .withColumn("off", F.abs("gap") / F.col("target"))
            .withColumn("lo", F.when(F.col("gap") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("gap") > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
            .withColumn("step", F.col("lam") - F.try_divide(F.col("gap"), F.col("slope")))
            .withColumn(
                "lam",
                F.when(F.col("off") <= tolerance, F.col("lam"))
                .when(F.col("step").between(F.col("lo"), F.col("hi")), F.col("step"))
                .otherwise((F.col("lo") + F.col("hi")) / 2),
            )
            .select("source", "target", "mean", "lam", "lo", "hi", "off")
        )
        fit = scratch.save(fit, "dual")
        state = fit.drop("off")
        worst = fit.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.select("source", "mean", "lam")


def class_copies(classes: DataFrame, targets: DataFrame, multipliers: DataFrame, max_repeats: int) -> DataFrame:
    """(source, size, n, total, target, copies): whole copies of each class.

    The window runs over the classes of a source, at most as many rows as there
    are distinct document lengths.
    """
    t = targets.select(F.col("source").alias("s"), "total", "target")
    m = multipliers.select(F.col("source").alias("m"), "mean", "lam")
    rated = (
        classes.join(t, _same("source", "s"))
        .join(m, _same("source", "m"), "left")
        .withColumn("x", F.col("size") / F.col("mean"))
        .withColumn("wanted", F.when(F.col("size") > 0, F.col("n") * _tilt(max_repeats)).otherwise(0.0))
    )
    rising = W.partitionBy("source").orderBy("size")
    so_far = F.sum("wanted").over(rising.rowsBetween(W.unboundedPreceding, 0))
    most = F.col("n") * max_repeats
    rounded = rated.withColumn("cum", F.floor(so_far + 0.5)).withColumn(
        "copies", F.least(most, F.col("cum") - F.lag("cum", 1, 0).over(rising))
    )
    # what is missing or too much, made up by the shortest documents first
    whole = W.partitionBy("source")
    gap = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)
    room = F.when(F.col("gap") > 0, most - F.col("copies")).otherwise(F.col("copies")) * F.col("size")
    before = F.coalesce(F.sum("room").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    change = F.least(F.col("room"), F.greatest(F.lit(0.0), F.abs("gap") - F.col("before")))
    return (
        rounded.withColumn("gap", gap)
        .withColumn("room", room)
        .withColumn("before", before)
        .withColumn("change", F.when(F.col("size") > 0, F.floor(change / F.col("size"))).otherwise(0))
        .withColumn("copies", (F.col("copies") + F.signum("gap").cast("long") * F.col("change")).cast("long"))
        .select("source", "size", "n", "total", "target", "copies")
    )


def mix(
    spark: SparkSession,
    documents: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    tolerance: float = 1e-7,
    rounds: int = 100,
    row: str | None = None,
    salt_rows: int = 10_000,
) -> DataFrame:
    """``documents`` (doc_id, text, source) to (doc_id, source, size, source_size, target, copies, taken).

    ``row`` names a column that tells rows apart; it is returned too, and rows
    that share an id are then ranked by their texts as well.
    """
    scratch = Scratch(spark, "mixing")
    own, told = ([], ["doc_id"]) if row is None else ([row], ["doc_id", "text"])
    sized = scratch.save(
        documents.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(*told).alias("hash"), *own
        ),
        "sizes",
    )
    classes = scratch.save(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    targets = scratch.save(source_targets(classes, weights, max_repeats), "targets")
    multipliers = balance(scratch, classes, targets, max_repeats, tolerance, rounds)
    copies = scratch.save(class_copies(classes, targets, multipliers, max_repeats), "copies")

    # ranks of equal documents: first by salt, then by hash
    total = classes.agg(F.sum("n")).first()[0] or 0
    salts = max(256, -(-total // salt_rows))
    salted = sized.withColumn("salt", F.pmod(F.shiftright("hash", 8), F.lit(salts)))
    per_salt = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("k"))
    c = copies.select(F.col("source").alias("cs"), F.col("size").alias("cz"), "n", "total", "target", "copies")
    offsets = scratch.save(
        per_salt.join(c, _same("source", "cs") & (F.col("size") == F.col("cz")))
        .withColumn("first", F.sum("k").over(W.partitionBy("source", "size").orderBy("salt")) - F.col("k"))
        .select(F.col("source").alias("os"), F.col("size").alias("oz"), F.col("salt").alias("ot"), "n", "total", "target", "copies", "first"),
        "offsets",
    )
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("hash", "doc_id", *own)))
    placed = ranked.join(offsets, _same("source", "os") & (F.col("size") == F.col("oz")) & (F.col("salt") == F.col("ot")))
    share = F.floor(F.col("copies") / F.col("n"))
    extra = F.col("first") + F.col("rank") <= F.col("copies") - share * F.col("n")
    return placed.select(
        "doc_id",
        "source",
        "size",
        F.col("total").alias("source_size"),
        "target",
        (share + extra.cast("long")).alias("copies"),
        ((share + extra.cast("long")) * F.col("size")).cast("long").alias("taken"),
        *own,
    )
