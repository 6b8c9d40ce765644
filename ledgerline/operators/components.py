"""Connected components of an undirected edge set, without collecting it.

Every round each vertex points at the smallest vertex among itself and its
neighbours, pointer jumping flattens those trees, and the edges are contracted
to the roots.  A component that still has an edge at least halves its vertices
per round, so rounds and jumps are logarithmic; every step is a partial
aggregation or an equi-join that adaptive execution can split, and each result
is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.sources.scratch import Scratch


def _flatten(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """(node, root) with every root its own parent; parents never exceed their node."""
    table = scratch.save(parents, "parents")
    while True:
        up = table.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        jumped = table.join(up, F.col("root") == F.col("__n"), "left").select(
            "node",
            F.coalesce("__r", "root").alias("root"),
            (F.coalesce("__r", "root") != F.col("root")).alias("__moved"),
        )
        following = scratch.save(jumped, "jump")
        scratch.drop(table)
        moved = following.filter("__moved").limit(1).count()
        table = following.select("node", "root")
        if not moved:
            return table


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long, any order, repeats and loops allowed) to (node, component).

    ``component`` is the smallest vertex reachable.  Vertices that appear in no
    edge but a loop are absent; null ends are ignored.
    """
    live = scratch.save(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while live.limit(1).count():
        both = live.union(live.select("b", "a"))
        stars = _flatten(scratch, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        up = stars.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        before, first = labels, labels is None
        if first:
            labels = stars
        else:
            labels = scratch.save(
                labels.join(up, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root")), "labels"
            )
            scratch.drop(before)
        ends = up.select(F.col("__n").alias("__m"), F.col("__r").alias("__s"))
        contracted = scratch.save(
            live.join(up, F.col("a") == F.col("__n"))
            .join(ends, F.col("b") == F.col("__m"))
            .select(F.least("__r", "__s").alias("a"), F.greatest("__r", "__s").alias("b"))
            .filter("a <> b")
            .distinct(),
            "live",
        )
        scratch.drop(live)
        live = contracted
        if not first:
            scratch.drop(stars)
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("root").alias("component"))
