"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists.

Candidates are dealt into blocks of bounded size, and each block keeps, for every
dimension, its vectors sorted by that component.  A query reads all lists in
parallel from their better end, as many entries deeper each round as it has read;
vectors seen for the first time are scored in full.  No unseen vector can score
more than the sum of the products at the current depth, so a query stops when
that bound falls below its kth result, and only then, or when every vector has
been seen.  Results of the blocks a task has done tighten the bound for its next
block: a block whose best conceivable score is below it has none of its lists
read.  ``Block.search`` tells how deep the lists were read.

How early the bound stops depends on the vectors.  Where few dimensions carry the
scores it stops soon; where directions are random, as in the test tables, almost
every vector has been seen in one of the lists by then, and the work grows with
queries times candidates.

Query rows and candidate blocks meet as pairs of packed blocks, k results leave
a pair per query, and a window keeps the k best of each.

Components are floor(scale * x) as integers; scores are exact: in double
precision where they are below 2**52, in 64-bit integers below 2**62, else in
integers of any length, of which those beyond the range of a long count as its
smallest or largest value and tie there.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; only vectors of one length are compared; a query's
candidates are all rows of other ids; ties go to the smaller id; of rows that
repeat a vec_id each is a candidate and each is a query; rows without a vec_id
take no part; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerline.llm.blocks import pack, unpack, usable
from ledgerline.sources.scratch import Scratch

RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FIRST_DEPTH = 16
LONGEST = 2**63 - 1


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """Row numbers by ascending component, one column per dimension."""
    return np.argsort(x, axis=0, kind="stable").astype(np.uint16 if len(x) <= 1 << 16 else np.int32)


def integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any length."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


class Block:
    """Candidates with their sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray) -> None:
        self.ids, self.lists, self.doubles = ids, lists, x
        self.largest = float(np.abs(x).max(initial=0))
        self.depths = [0]
        depth = FIRST_DEPTH
        while depth < len(ids):
            self.depths.append(depth)
            depth *= 2
        self.depths.append(len(ids))
        self.kinds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _as(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, smallest and largest components by depth) in a kind of number."""
        if kind not in self.kinds:
            x = {"double": lambda: self.doubles, "long": lambda: self.doubles.astype(np.int64), "any": lambda: integers(self.doubles)}[kind]()
            at, columns = np.array(self.depths[:-1]), np.arange(x.shape[1])
            self.kinds[kind] = x, x[self.lists[at], columns], x[self.lists[len(self.ids) - 1 - at], columns]
        return self.kinds[kind]

    def search(self, query: np.ndarray, own: int, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best of earlier results and this block, and how many entries of each list were read."""
        most = float(np.abs(query).max(initial=0)) * self.largest * len(query)
        kind = "double" if most < 2**52 else "long" if most < 2**62 and max(self.largest, np.abs(query).max()) < 2**62 else "any"
        x, low, high = self._as(kind)
        q = {"double": lambda: query, "long": lambda: query.astype(np.int64), "any": lambda: integers(query)}[kind]()
        up = query > 0
        bounds = np.where(up, high, low) @ q
        used = np.flatnonzero(query)
        seen = self.ids == own
        n = len(self.ids)
        for step, (a, b) in enumerate(zip(self.depths[:-1], self.depths[1:])):
            if len(scores) == k and bounds[step] < scores[-1]:
                return scores, ids, a
            fresh = np.zeros(n, dtype=bool)
            fresh[self.lists[n - b : n - a, used[up[used]]].ravel()] = True
            fresh[self.lists[a:b, used[~up[used]]].ravel()] = True
            if not len(used):  # every score is 0: one list in any order tells them all
                fresh[self.lists[a:b, 0]] = True
            fresh &= ~seen
            rows = np.flatnonzero(fresh)
            seen = seen | fresh
            if len(rows):
                found = x[rows] @ q
                found = np.array([min(max(v, -LONGEST - 1), LONGEST) for v in found.tolist()] if kind == "any" else found, dtype=np.int64)
                if len(scores) == k:
                    better = found >= scores[-1]
                    rows, found = rows[better], found[better]
                scores, ids = best(np.r_[scores, found], np.r_[ids, self.ids[rows]], k)
            if seen.all():
                return scores, ids, b
        return scores, ids, n


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > 64:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, ~scores))[:k]
    return scores[order], ids[order]


def search(
    spark: SparkSession, embeddings: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, block_rows: int = 4096, query_rows: int = 256, blocks_per_task: int = 4
) -> DataFrame:
    """``embeddings`` (vec_id, embedding) to (query_id, rank, vec_id, score) for the rows that ``queries`` selects."""
    scratch = Scratch(spark, "topk")
    every = embeddings.select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    rows = every.filter(usable("v", nonzero=False) & F.col("id").isNotNull()).withColumn("dims", F.size("v"))
    sizes = scratch.save(
        rows.groupBy("dims")
        .agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
        .select(F.col("dims").alias("d"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"), F.ceil(F.col("q") / query_rows).cast("long").alias("parts")),
        "sizes",
    )
    sized = rows.join(sizes, F.col("dims") == F.col("d"))
    head = F.col("dims").cast("long") * (1 << 32)
    floor = lambda v: np.floor(np.clip(v, -1e308 / scale, 1e308 / scale) * scale)
    lists = lambda data: sorted_lists(data).tobytes()
    candidates = scratch.save(pack(sized.withColumn("key", head + F.pmod(F.xxhash64("id"), F.col("blocks"))), "key", floor, lists), "candidates")
    asking = pack(sized.filter("asks").withColumn("key", head + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))), "key", floor)
    queries_packed = scratch.save(asking, "queries")
    own = F.col("block") % (1 << 32)
    groups = F.ceil(F.col("blocks") / blocks_per_task).cast("long")
    c = (
        candidates.join(sizes, F.col("dims") == F.col("d"))
        .filter("parts > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("dims", "part", (own % groups).alias("group"), F.lit(1).alias("role"), "block", "n", "ids", "data", "kind", "index")
    )
    q = (
        queries_packed.join(sizes, F.col("dims") == F.col("d"))
        .withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
        .select("dims", own.alias("part"), "group", F.lit(0).alias("role"), "block", "n", "ids", "data", "kind", "index")
    )

    def compare(table: pa.Table) -> pa.Table:
        members = sorted(table.to_pylist(), key=lambda r: (r["role"], r["block"]))
        if members[0]["role"] != 0:
            return RESULT.empty_table()
        asks, x = unpack(members[0])
        empty = np.empty(0, dtype=np.int64)
        results = [(empty, empty)] * len(asks)
        for r in members[1:]:
            ids, values = unpack(r)
            whole = np.frombuffer(r["index"], dtype=np.uint16 if r["n"] <= 1 << 16 else np.int32)
            block = Block(ids, values, whole.reshape(r["n"], -1))
            results = [block.search(x[i], int(asks[i]), k, *results[i])[:2] for i in range(len(asks))]
        who = np.repeat(asks, [len(s) for s, _ in results])
        return pa.Table.from_arrays([pa.array(who), *(pa.array(np.concatenate([r[part] for r in results])) for part in (1, 0))], schema=RESULT)

    found = q.unionByName(c).groupBy("dims", "part", "group").applyInArrow(compare, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
