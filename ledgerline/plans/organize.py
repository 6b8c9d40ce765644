"""Move plans: who goes where, with names that clash with nothing.

A plan is a lazy (label, source, destination, status), with (stage_ord, stage)
before them where it has stages; applying one is a separate step on the driver
(``ledgerline.plans.apply``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions import names
from ledgerline.operators.ranking import numbered
from ledgerline.sources.scratch import Scratch


def is_large(size_mb: float | None) -> Column:
    return F.lit(False) if size_mb is None else F.coalesce(names.size_mb(F.col("size")) >= size_mb, F.lit(False))


def is_old(age_days: float | None, as_of: float) -> Column:
    return F.lit(False) if age_days is None else F.coalesce(names.age_days(F.col("mtime"), as_of) >= age_days, F.lit(False))


def unique_names(moves: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds ``new_name`` to ``moves`` (folder, name, source): the first free of ``x.txt``, ``x (1).txt``, ...

    Arrivals of one name take free names in order of ``source``; ``taken`` is
    (folder, name).  A numbered name that itself arrives, or is taken, is passed
    over, so results are free of clashes whatever the names are.

    If u(1) < u(2) < ... are the numbers in use, the k-th free one is k plus how
    many j have u(j) - j < k.  That count is read off one numbering of arrivals
    and used numbers together, so a name that a third of all files bear is dealt
    over many tasks.
    """
    scratch, group = Scratch(moves.sparkSession, "names"), ["folder", "name"]
    bare = taken.select(*group).distinct().withColumn("__bare_taken", F.lit(True))
    arrivals = numbered(scratch, moves, group, ["source"], "__r").join(bare, group, "left")
    arrivals = scratch.save(arrivals.withColumn("__k", F.col("__r") - F.when(F.col("__bare_taken"), 0).otherwise(1)), "arrivals")

    # numbers in use, by the name without them; written once, so that the parts of a name are found once
    numbered_ones = taken.select(*group).unionByName(moves.select(*group)).filter(F.col("name").rlike(r" \(\d{1,9}\)")).distinct()
    parts = scratch.save(numbered_ones.select("folder", names.stem(F.col("name")).alias("__stem"), names.suffix(F.col("name")).alias("__suffix")), "parts")
    pattern = r"(?s)^(.*) \((\d{1,9})\)$"
    found = parts.filter(F.col("__stem").rlike(pattern)).select(
        "folder", "__suffix", F.regexp_extract("__stem", pattern, 1).alias("__base"), F.regexp_extract("__stem", pattern, 2).alias("__digits")
    )
    plain = F.col("__digits").try_cast("int")
    used = found.filter((plain > 0) & (plain.cast("string") == F.col("__digits")) & (F.col("__base") != "")).select(
        "folder", F.concat("__base", "__suffix").alias("name"), plain.cast("long").alias("__u")
    )
    met = used.join(moves.select(*group).distinct(), group, "left_semi")
    gaps = numbered(scratch, met, group, ["__u"], "__j").select(*group, (F.col("__u") - F.col("__j") + 1).alias("__at"), F.lit(0).alias("__arrives"), F.col("__u").alias("__tie"))
    crowded = arrivals.join(met.select(*group).distinct(), group, "left_semi")
    both = gaps.unionByName(crowded.select(*group, F.col("__k").alias("__at"), F.lit(1).alias("__arrives"), F.col("__r").alias("__tie")))
    placed = numbered(scratch, both, group, ["__at", "__arrives", "__tie"], "__place").filter("__arrives = 1")
    passed = placed.select(*group, F.col("__tie").alias("__r"), (F.col("__place") - F.col("__tie")).alias("__passed"))
    number = F.col("__k") + F.coalesce("__passed", F.lit(0))
    stem, suffix = names.stem(F.col("name")), names.suffix(F.col("name"))
    numbered_name = F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), suffix)
    return (
        arrivals.join(passed, [*group, "__r"], "left")
        .withColumn("new_name", F.when(F.col("__k") == 0, F.col("name")).otherwise(numbered_name))
        .select(*moves.columns, "new_name")
    )


def pre_plan(files: DataFrame, as_of: float, size_mb: float | None, age_days: float | None) -> DataFrame:
    """(label, path, folder): large files, then old ones; a file that is both is only large."""
    label = F.when(is_large(size_mb), "Large Files").when(is_old(age_days, as_of), "General Old")
    return files.withColumn("label", label).filter("label is not null").withColumn("folder", F.concat_ws("/", "root", "label"))


def available(files: DataFrame, known: list[str]) -> DataFrame:
    """(category, n_files) of the known categories, and the one for all others, that have files."""
    return files.filter(F.col("category").isin(known)).groupBy("category").agg(F.count("*").alias("n_files"))


def category_plan(
    files: DataFrame, folder: Column, chosen: list[str] | None = None, extensions: dict[str, list[str]] | None = None, present: DataFrame | None = None
) -> DataFrame:
    """Files with their category as label and ``folder``/category as folder; all categories, or the chosen ones.

    Where a category's folder exists, as ``present`` (folder) tells, only files
    with one of its ``extensions`` go, if it names any; into a new folder all go.
    """
    kept = files if chosen is None else files.filter(F.col("category").isin(chosen))
    placed = kept.withColumn("label", F.col("category")).withColumn("folder", F.concat_ws("/", folder, "category"))
    if not extensions or present is None:
        return placed
    there = present.select(F.col("folder").alias("__there")).distinct()
    wanted = F.lit(True)
    for name, listed in extensions.items():
        wanted = wanted & ((F.col("label") != name) | F.col("ext").isin(listed))
    return placed.join(there, F.col("folder") == F.col("__there"), "left").filter(F.col("__there").isNull() | wanted).drop("__there")


def preview(files: DataFrame, chosen: list[str] | None = None, most: int = 150) -> DataFrame:
    """(position, path, name, category, size_label) of the first files that would move, by path; ``N/A`` for unknown sizes."""
    kept = files if chosen is None else files.filter(F.col("category").isin(chosen))
    label = F.coalesce(names.size_label(F.col("size")), F.lit("N/A")).alias("size_label")
    shown = kept.orderBy("path").limit(most).select("path", "name", "category", label)
    return shown.withColumn("position", F.row_number().over(Window.orderBy("path")))


def post_plan(present: DataFrame, planned: DataFrame, as_of: float, size_mb: float | None, age_days: float | None) -> DataFrame:
    """Large and old files of each category folder, moved to subfolders of it.

    ``present`` and ``planned`` are (folder, category, name, size, mtime): files
    that lie there, and those that the category plan will have put there.
    """
    kind = F.when(is_large(size_mb), "Large").when(is_old(age_days, as_of), "Old")
    columns = ["folder", "category", "name", "size", "mtime"]
    both = present.select(*columns).unionByName(planned.select(*columns)).withColumn("kind", kind).filter("kind is not null")
    label = F.concat_ws(" ", "kind", "category")
    return both.select(
        label.alias("label"),
        F.concat_ws("/", "folder", "name").alias("source"),
        F.concat_ws("/", F.col("folder"), label, F.col("name")).alias("destination"),
    )


def resolve(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """(label, source, destination, status) of a plan's (label, path, folder, name, size, content).

    ``existing`` is (folder, name, size, content) at the destinations.  A file
    whose bytes equal those of the file that has its name there is ``skipped``
    with no destination; others move to a free name.  Digests are taken before
    the join, so bytes never move.
    """
    digest = F.sha2(F.col("content").cast("binary"), 256)
    at_home = existing.select("folder", "name", digest.alias("__there")).dropDuplicates(["folder", "name"])
    own = digest if "content" in plan.columns else F.lit(None).cast("string")
    arriving = plan.select("label", F.col("path").alias("source"), "folder", "name", own.alias("__own"))
    joined = arriving.join(at_home, ["folder", "name"], "left")
    flagged = joined.withColumn("__same", F.coalesce(F.col("__there") == F.col("__own"), F.lit(False))).drop("__own", "__there")
    moved = unique_names(flagged.filter("not __same"), existing.select("folder", "name"))
    moved = moved.select("label", "source", F.concat_ws("/", "folder", "new_name").alias("destination"), F.lit("move").alias("status"))
    skipped = flagged.filter("__same").select("label", "source", F.lit(None).cast("string").alias("destination"), F.lit("skipped").alias("status"))
    return moved.unionByName(skipped)


STAGES = ("pre", "category", "post")


def run_stages(files: DataFrame, existing: DataFrame, as_of: float, size_mb: float | None, age_days: float | None, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(stage_ord, stage, label, source, destination, status): the plans of the chosen stages, one after another.

    The pre stage takes large and old files out of each root; the category stage
    places what remains, or everything if there is no pre stage; the post stage
    takes large and old files out of where the category stage has put them.
    """
    plans = {}
    remaining = files
    if "pre" in stages:
        taken = pre_plan(files, as_of, size_mb, age_days)
        plans["pre"] = resolve(taken, existing)
        remaining = files.join(taken.select("path"), "path", "left_anti")
    placed = resolve(category_plan(remaining, F.col("root")), existing)
    if "category" in stages:
        plans["category"] = placed
    if "post" in stages:
        moved = placed.filter("status = 'move'").select(F.col("source").alias("path"), "destination")
        at = moved.join(remaining.select("path", "category", "size", "mtime"), "path").select(
            names.parent(F.col("destination")).alias("folder"), "category", names.base_name(F.col("destination")).alias("name"), "size", "mtime"
        )
        plans["post"] = post_plan(at.limit(0), at, as_of, size_mb, age_days).withColumn("status", F.lit("move"))
    found = None
    for order, stage in enumerate(STAGES, 1):
        if stage in plans:
            part = plans[stage].select(F.lit(order).alias("stage_ord"), F.lit(stage).alias("stage"), "label", "source", "destination", "status")
            found = part if found is None else found.unionByName(part)
    return found


def mismatches(files: DataFrame, known: list[str]) -> DataFrame:
    """(path, name, current, correct) of direct children of category folders that belong elsewhere."""
    current = names.base_name(F.col("parent"))
    inside = F.col("parent") == F.concat_ws("/", F.col("root"), current)
    return files.filter(inside & current.isin(known) & (current != F.col("category"))).select(
        "path", "name", "root", current.alias("current"), F.col("category").alias("correct")
    )


def mismatch_fix_plan(files: DataFrame, known: list[str]) -> DataFrame:
    """(label, source, destination, status): mismatched files moved to their root's right folder; what lies there counts."""
    wrong = mismatches(files, known).withColumnRenamed("root", "__root").join(files.select("path", "content"), "path")
    plan = wrong.select(F.col("correct").alias("label"), "path", F.concat_ws("/", "__root", "correct").alias("folder"), "name", "content")
    return resolve(plan, files.select(F.col("parent").alias("folder"), "name", "size", "content"))
