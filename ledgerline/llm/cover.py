"""Embedding near-duplicates by cover trees walked in pairs; exact.

Vectors of length one lie within cosine c of each other exactly if their
distance is at most t = sqrt(2 - 2c).  Rows are dealt into blocks of bounded
size; each block gets a cover tree: nested levels whose radii halve, every node
of a level also its own child, with the true covering radius of every node.
Trees are compared in pairs, from the roots down: a pair of nodes whose centres
are farther apart than t plus both covering radii is pruned with all that lies
below, a pair that lies within t as a whole is taken as a whole, and only the
rest is opened.  The leaves that remain are compared by cosine in double
precision.

Pairs never leave a task: each pair of bundles of blocks yields the number of
links of its vectors and a spanning forest of the links, at most one edge per
vector, and connected components join the forests.  A hot group of copies is
spread over blocks like any other rows.

All pairs of bundles meet in rounds: in round r a bundle meets the one r places
on; a job takes half the pairs of a round, more if the table is small, so it
moves every bundle about once, and its shuffle files go before the next.  What the rounds have found is folded, sums by vector and one
edge per vector, whenever it outgrows the table.  So the disk in use stays in
proportion to the input, whatever the number of blocks.

The work on vectors without structure grows with the square of their number,
as the pruning bound does not separate random directions; bundles of bounded
size keep each task's share constant.

Defined results: null, zero, or non-finite vectors link with nothing; vectors of
different lengths never link; rows that repeat a vec_id are one vertex with the
links of all of them; rows without a vec_id link with nothing, have no component
and are not kept; a pair at the threshold itself, as far as double precision
tells, links; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.blocks import pack, unpack, usable
from ledgerline.operators.components import connected_components
from ledgerline.sources.scratch import Scratch

SLACK = 1e-7
ROUNDING = 1e-4
STRIP = 256
#: Numbers in the vectors of a bundle, at most; rows that a job may move for a small table, and that its findings may have.
BUNDLE = 1 << 22
MOVED = 1 << 20
FOUND = 1 << 22


@dataclass
class Level:
    """Nodes of one level: centre points, covering radii, ranges of points and of child nodes."""

    points: np.ndarray
    radii: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    count: np.ndarray


def _centres(x: np.ndarray, members: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net of some points: centres in order, and the nearest centre of every member.

    A strip of points is held against the centres so far at once; only those
    that none covers are then taken one after the other.
    """
    chosen: list[int] = []
    limit = 1 - radius * radius / 2
    for a in range(0, len(members), STRIP):
        part = members[a : a + STRIP]
        near = (x[part] @ x[np.array(chosen)].T).max(axis=1) >= limit if chosen else np.zeros(len(part), dtype=bool)
        left = part[~near]
        inner = x[left] @ x[left].T >= limit
        open_ = np.ones(len(left), dtype=bool)
        for i in range(len(left)):
            if open_[i]:
                chosen.append(int(left[i]))
                open_ &= ~inner[i]
    centres = np.array(chosen)
    own = np.empty(len(members), dtype=np.int64)
    for a in range(0, len(members), 1024):
        own[a : a + 1024] = (x[members[a : a + 1024]] @ x[centres].T).argmax(axis=1)
    own[np.searchsorted(members, centres)] = np.arange(len(centres))
    return centres, own


def cover_tree(x: np.ndarray, threshold: float) -> tuple[np.ndarray, list[Level]]:
    """(order, levels): points in depth-first order and the nodes of each level, root first.

    Radii start at two and halve; below half of ``threshold`` nothing would be
    pruned any more and the points themselves are the leaves.
    """
    n = len(x)
    group = np.zeros(n, dtype=np.int64)  # node of the level above, of every point
    centre = np.zeros(1, dtype=np.int64)
    nets = [(centre, group)]
    radius = 1.0
    while radius >= threshold / 4:
        centres, parts = [], np.empty(n, dtype=np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]), n]
        made = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            members = np.sort(order[a:b])
            if len(members) == 1:
                found, own = members, np.zeros(1, dtype=np.int64)
            else:
                lead = centre[group[members[0]]]  # nested: the node is its own child
                found, own = _nested(x, members, lead, radius)
            centres.append(found)
            parts[members] = made + own
            made += len(found)
        centre, group = np.concatenate(centres), parts
        nets.append((centre, group))
        if made == n:
            break
        radius /= 2
    if len(nets[-1][0]) < n:
        nets.append((np.arange(n), np.arange(n)))
    # depth-first: sort points by their nodes from the top; a node is then a range
    order = np.lexsort([g for _, g in reversed(nets)])
    levels, below = [], None
    for centre, group in reversed(nets):
        sorted_group = group[order]
        start = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
        name = sorted_group[start]
        points = centre[name]
        gaps = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x[order], x[centre[sorted_group]])))
        radii = np.maximum.reduceat(gaps, start)
        if below is None:
            first = count = np.zeros(len(start), dtype=np.int64)
        else:
            first = np.searchsorted(below, start)
            count = np.diff(np.r_[first, len(below)])
        levels.append(Level(points, radii, start, np.r_[start[1:], n], first, count))
        below = start
    return order, levels[::-1]


def _nested(x: np.ndarray, members: np.ndarray, lead: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of a node's members at the next radius, the node's own point first among them."""
    others = members[members != lead]
    limit = 1 - radius * radius / 2
    far = others[x[others] @ x[lead] < limit]
    if not len(far):
        return np.array([lead]), np.zeros(len(members), dtype=np.int64)
    centres, _ = _centres(x, far, radius)
    centres = np.r_[lead, centres]
    own = np.empty(len(members), dtype=np.int64)
    for a in range(0, len(members), 1024):
        own[a : a + 1024] = (x[members[a : a + 1024]] @ x[centres].T).argmax(axis=1)
    own[np.searchsorted(members, centres)] = np.arange(len(centres))
    return centres, own


class Links:
    """Counts and a spanning forest, as links arrive in bulk."""

    def __init__(self, n: int) -> None:
        self.counts = np.zeros(n, dtype=np.int64)
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join_all(self, left: np.ndarray, right: np.ndarray) -> None:
        """Adds the links that still connect something, one per pair of components and pass."""
        while len(left):
            root = self.parent
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            self.parent = root.copy()
            low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
            apart = low != high
            left, right = left[apart], right[apart]
            _, one = np.unique(low[apart] * len(root) + high[apart], return_index=True)
            for k in one.tolist():
                self.join(int(left[k]), int(right[k]))

    def join(self, i: int, j: int) -> None:
        a, b = self._find(i), self._find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def dual_links(x: np.ndarray, tx: tuple, y: np.ndarray, ty: tuple, cosine: float, same: bool) -> Links:
    """Links between two trees (or within one), vertices of y numbered after those of x."""
    threshold = float(np.sqrt(2 - 2 * cosine))
    (order_x, levels_x), (order_y, levels_y) = tx, ty
    links = Links(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    left, right = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    dense = True  # whether the open pairs are all pairs of two node sets
    x32, y32 = x.astype(np.float32), y.astype(np.float32)  # for bounds only, with slack for the rounding
    depth = max(len(levels_x), len(levels_y))
    for step in range(depth):
        lx, ly = levels_x[min(step, len(levels_x) - 1)], levels_y[min(step, len(levels_y) - 1)]
        leaf = step == depth - 1
        if dense:
            rows, columns = np.unique(left), np.unique(right)
            # dot + (t + rx + ry)^2 / 2 as one product: the bound's terms ride along as three more components
            reach, over = threshold + lx.radii[rows] + ROUNDING, ly.radii[columns]
            raised = np.c_[x32[lx.points[rows]], reach * reach / 2, reach, np.ones(len(rows))].astype(np.float32)
            facing = np.c_[y32[ly.points[columns]], np.ones(len(columns)), over, over * over / 2].astype(np.float32)
            found_l, found_r = [], []
            for a in range(0, len(rows), 512):
                i, j = np.divmod(np.flatnonzero(raised[a : a + 512] @ facing.T >= np.float32(1 - ROUNDING)), len(columns))
                found_l.append(rows[a + i])
                found_r.append(columns[j])
            left, right = np.concatenate(found_l), np.concatenate(found_r)
            dense = len(left) == len(rows) * len(columns) or len(left) > 1 << 21
        keep_l, keep_r = [], []
        for a in range(0, len(left), 1 << 15):
            i, j = left[a : a + (1 << 15)], right[a : a + (1 << 15)]
            if same:
                upper = i <= j
                i, j = i[upper], j[upper]
            p, q = lx.points[i], ly.points[j]
            dots = np.einsum("ij,ij->i", x[p], y[q])
            gaps = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
            near = gaps <= threshold + lx.radii[i] + ly.radii[j] + SLACK
            if leaf:
                hit = (dots >= cosine) & (p != q if same else True)
                pairs = np.c_[p[hit], q[hit] + shift]
                links.counts += np.bincount(pairs.ravel(), minlength=len(links.counts))
                links.join_all(pairs[:, 0], pairs[:, 1])
                continue
            whole = near & (gaps + lx.radii[i] + ly.radii[j] <= threshold - SLACK)
            if same:
                whole &= i != j
            for u, v in zip(i[whole].tolist(), j[whole].tolist()):
                own, other = order_x[lx.starts[u] : lx.ends[u]], order_y[ly.starts[v] : ly.ends[v]] + shift
                links.counts[own] += len(other)
                links.counts[other] += len(own)
                links.join_all(np.r_[own, np.repeat(own[:1], len(other))], np.r_[np.repeat(other[:1], len(own)), other])
            if whole.any():  # the product of what stays open would bring these pairs back
                dense = False
            near &= ~whole
            keep_l.append(i[near])
            keep_r.append(j[near])
        if leaf:
            break
        left = np.concatenate([np.empty(0, dtype=np.int64), *keep_l])
        right = np.concatenate([np.empty(0, dtype=np.int64), *keep_r])
        if not len(left):
            break
        left, right = _open(left, right, lx if step < len(levels_x) - 1 else None, ly if step < len(levels_y) - 1 else None, dense)
    return links


def _open(left: np.ndarray, right: np.ndarray, lx: Level | None, ly: Level | None, dense: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of pairs of nodes; a tree that has ended keeps its leaves."""
    if dense:
        return _children(np.unique(left), lx), _children(np.unique(right), ly)
    cl = lx.count[left] if lx is not None else np.ones(len(left), dtype=np.int64)
    cr = ly.count[right] if ly is not None else np.ones(len(right), dtype=np.int64)
    total = cl * cr
    pair = np.repeat(np.arange(len(left)), total)
    rank = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
    i, j = rank // cr[pair], rank % cr[pair]
    new_left = lx.first[left[pair]] + i if lx is not None else left[pair]
    new_right = ly.first[right[pair]] + j if ly is not None else right[pair]
    return new_left, new_right


def _children(nodes: np.ndarray, level: Level | None) -> np.ndarray:
    if level is None:
        return nodes
    counts = level.count[nodes]
    return np.repeat(level.first[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _small(order: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, list[Level]]:
    """A tree with numbers of half the length."""
    half = lambda a: a.astype(np.int32)
    return half(order), [Level(half(v.points), v.radii, half(v.starts), half(v.ends), half(v.first), half(v.count)) for v in levels]


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


RESULT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _result(ids: np.ndarray, links: Links) -> pa.Table:
    """Rows (id, null, links) of the linked vectors, and (id, id, null) of the forest."""
    linked = np.flatnonzero(links.counts)
    ends = np.array(links.edges, dtype=np.int64).reshape(-1, 2)
    nulls = lambda k: pa.nulls(k, pa.int64())
    counts = pa.Table.from_arrays([pa.array(ids[linked]), nulls(len(linked)), pa.array(links.counts[linked])], schema=RESULT)
    edges = pa.Table.from_arrays([pa.array(ids[ends[:, 0]]), pa.array(ids[ends[:, 1]]), nulls(len(ends))], schema=RESULT)
    return pa.concat_tables([counts, edges])


def compare_bundles(left: list[dict], right: list[dict] | None, cosine: float) -> pa.Table:
    """Links between the blocks of two bundles, or within one if there is no other."""
    places = np.cumsum([0, *(r["n"] for r in left), *(r["n"] for r in right or [])])
    ids = np.concatenate([np.frombuffer(r["ids"], dtype=np.int64) for r in [*left, *(right or [])]])
    links, edges = Links(int(places[-1])), []
    for p, row in enumerate(left):
        x, tree = _opened(row)
        for q in range(p, len(left)) if right is None else range(len(left), len(places) - 1):
            same = q == p
            y, other = (x, tree) if same else _opened(left[q] if right is None else right[q - len(left)])
            found = dual_links(x, tree, y, other, cosine, same)
            links.counts[places[p] : places[p + 1]] += found.counts[: len(x)]
            if not same:
                links.counts[places[q] : places[q + 1]] += found.counts[len(x) :]
            if found.edges:
                ends = np.array(found.edges, dtype=np.int64)
                edges.append(np.where(ends < len(x), ends + places[p], ends - len(x) + places[q]))
    if edges:
        ends = np.concatenate(edges)
        links.join_all(ends[:, 0], ends[:, 1])
    return _result(ids, links)


def _opened(row: dict) -> tuple[np.ndarray, tuple]:
    return _unit(unpack(row)[1]), pickle.loads(row["index"])


def _round(bundles: DataFrame, first: int, last: int, halves: int, half: int, cosine: float) -> DataFrame:
    """(a, b, n) of the rounds from ``first`` to ``last``, or of those of their pairs that are in one of the halves; see ``_result``."""
    own, count, r = F.col("bundle"), F.col("bundles"), F.col("r")
    # half way round, each two bundles face each other once
    once = (r * 2 < count) | ((r * 2 == count) & (F.col("i") * 2 < count))
    sides = F.array(F.struct(own.alias("i"), F.lit(True).alias("low")), F.struct(F.pmod(own - r, count).alias("i"), F.lit(False).alias("low")))
    met = (
        bundles.withColumn("r", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        .withColumn("side", F.explode(sides))
        .select("dims", "r", "side.i", "side.low", "bundles", "block", "n", "ids", "data", "kind", "index")
        .filter(once & (F.col("low") | (r > 0)) & (F.col("i") % halves == half))
        .drop("bundles")
    )

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["block"])
        left, right = [x for x in rows if x["low"]], [x for x in rows if not x["low"]]
        return compare_bundles(left, right if rows[0]["r"] else None, cosine)

    return met.groupBy("dims", "r", "i").applyInArrow(compare, "a long, b long, n long")


def _folded(scratch: Scratch, found: DataFrame) -> DataFrame:
    """The same links in at most two rows a vector: its count, and an edge to its component's smallest."""
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = connected_components(scratch, found.filter("n is null").select("a", "b"))
    no_one = F.lit(None).cast("long")
    both = counts.select("a", no_one.alias("b"), "n").union(groups.select(F.col("node").alias("a"), F.col("component").alias("b"), no_one.alias("n")))
    return scratch.save(both, "folded")


def near_duplicates(
    spark: SparkSession, embeddings: DataFrame, cosine: float = 0.95, block_rows: int = 2048, bundle: int = BUNDLE, moved: int = MOVED, most: int = FOUND
) -> DataFrame:
    """``embeddings`` (vec_id, embedding) to (vec_id, n_links, component_id, kept)."""
    scratch = Scratch(spark, "cover")
    every = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = every.filter(usable("v", nonzero=True) & F.col("id").isNotNull()).withColumn("dims", F.size("v"))
    blocks = F.ceil(F.col("n") / block_rows).cast("long")
    # as many bundles as keep every core at work, or as their size asks for, but none without a block
    least = F.greatest(F.lit(max(16, 2 * spark.sparkContext.defaultParallelism)), F.ceil(F.col("n") * F.col("dims") / bundle)).cast("long")
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n")).select(F.col("dims").alias("d"), "n", blocks.alias("blocks"), F.least(blocks, least).alias("bundles"))
    sizes = scratch.save(sizes, "sizes")
    dealt = rows.join(sizes.drop("n"), F.col("dims") == F.col("d")).withColumn("key", F.col("dims").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("blocks")))
    index = lambda data: pickle.dumps(_small(*cover_tree(_unit(data), float(np.sqrt(2 - 2 * cosine)))))
    packed = scratch.save(pack(dealt, "key", index=index), "blocks")
    bundles = packed.join(sizes.select("d", "bundles"), F.col("dims") == F.col("d")).withColumn("bundle", F.col("block") % (1 << 32) % F.col("bundles"))

    total, last = sizes.agg(F.sum("n"), F.max(F.floor(F.col("bundles") / 2))).first()
    step, halves = max(1, moved // (2 * (total or 1))), 2 if (total or 0) > moved else 1
    tables, held = [], 0
    for first, half in product(range(0, (last or 0) + 1, step), range(halves)):
        tables.append(scratch.save(_round(bundles, first, min(first + step - 1, last or 0), halves, half, cosine), "links"))
        held += tables[-1].count()
        if held > max(most, 2 * (total or 0)) and len(tables) > 1:
            folded = _folded(scratch, reduce(DataFrame.union, tables))
            for table in tables:
                scratch.drop(table)
            tables, held = [folded], 0
    linked = reduce(DataFrame.union, tables)
    counts = linked.filter("n is not null").groupBy(F.col("a").alias("ca")).agg(F.sum("n").alias("n"))
    groups = connected_components(scratch, linked.filter("n is null").select("a", "b"))
    return (
        every.select("id")
        .join(counts, F.col("id") == F.col("ca"), "left")
        .join(groups, F.col("id") == F.col("node"), "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
        )
    )
