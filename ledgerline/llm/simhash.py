"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits.  Cut into two segments, fingerprints within three
bits differ by at most one bit in some segment.  Every distinct fingerprint
therefore indexes, for each segment and each of its bits, the segment with that
bit deleted; an equality join on (segment, bit, rest) brings together all
fingerprints whose segments differ by at most that bit, and the whole
fingerprints are verified.  So that no pair is verified 32 times over, a pair
with equal segments counts at bit 0 alone and a pair that differs at a bit only
at that bit.

The join is carried out on co-partitioned, sorted keys in numpy, a slice of some
thousand rows of whole keys at a time, so a task's memory does not grow with its
rows.  What leaves a bucket is a spanning forest of its links, never its pairs:
at most one edge per member.  A key shared by more than ``block`` fingerprints is dealt out as pairs
of blocks, each pair a task's unit, so no group of any size meets in one task.

Defined results: a null or empty text has no words and fingerprint zero, which
links like any other; texts of fewer words than a shingle are one shingle;
documents of equal text share a fingerprint and so a component; rows that repeat
a doc_id have a row each; rows without one link nothing, and have the component
of their fingerprint's other documents, null if there are none; an empty table
gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.blocks import whole_groups
from ledgerline.llm.shingles import LOWER
from ledgerline.operators.components import connected_components
from ledgerline.sources.scratch import Scratch

SEGMENT = 32


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit majority of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().translate(LOWER).split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(tokens) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        spans = zip(starts[a:b].tolist(), ends[a + words - 1 : b + words - 1].tolist())
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(documents: DataFrame, words: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["id", "fp"])

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, fp long").withColumnRenamed("id", key)


def variant_keys(fps: DataFrame) -> DataFrame:
    """(key, fp, rep) for each segment and deleted bit; ``key`` packs segment, bit and rest."""
    variants = []
    for s in range(2):
        segment = F.shiftrightunsigned("fp", SEGMENT * s).bitwiseAND(F.lit((1 << SEGMENT) - 1))
        for bit in range(SEGMENT):
            head = F.lit((s * SEGMENT + bit) << SEGMENT)
            variants.append(segment.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit))).bitwiseOR(head))
    return fps.select(F.explode(F.array(*variants)).alias("key"), "fp", "rep")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _links(left: np.ndarray, right: np.ndarray, head: int, most: int) -> np.ndarray:
    """Matrix of verified links between two sets of one key (head: segment and bit)."""
    x = left[:, None] ^ right[None, :]
    part = (x >> np.uint64(SEGMENT * (head // SEGMENT))) & np.uint64((1 << SEGMENT) - 1)
    own = part == np.uint64(1 << (head % SEGMENT))
    if head % SEGMENT == 0:
        own |= part == 0
    return own & (_popcount(x) <= most)


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix, breadth first."""
    open_ = np.ones(len(adjacent), dtype=bool)
    edges = []
    for root in range(len(adjacent)):
        if not open_[root]:
            continue
        open_[root] = False
        front = [root]
        while front:
            node = front.pop()
            near = np.flatnonzero(adjacent[node] & open_)
            open_[near] = False
            edges.extend((node, k) for k in near.tolist())
            front.extend(near.tolist())
    return edges


def _between(left: np.ndarray, right: np.ndarray, head: int, most: int) -> list[tuple[int, int]]:
    """Forest edges among the members of two sets; the matrix is built in strips."""
    n = len(left)
    both = np.concatenate([left, right])
    adjacent = np.zeros((len(both), len(both)), dtype=bool)
    for a in range(0, n, 512):
        adjacent[a : a + 512, n:] = _links(left[a : a + 512], right, head, most)
    adjacent[n:, :n] = adjacent[:n, n:].T
    return _forest(adjacent)


def bucket_edges(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, rep) of every run of equal keys; runs of one length are verified together."""
    order = np.argsort(key, kind="stable")
    key, fp, rep = key[order], fp[order], rep[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    out_a, out_b = [], []
    for n in np.unique(size[size > 1]).tolist():
        runs = first[size == n]
        if n <= 8:
            i, j = np.triu_indices(n, 1)
            for a in range(0, len(runs), 1 << 16):
                base = runs[a : a + (1 << 16), None]
                left, right = (base + i).ravel(), (base + j).ravel()
                head = (key[left] >> SEGMENT).astype(np.uint64)
                x = fp[left] ^ fp[right]
                part = (x >> (head // np.uint64(SEGMENT) * np.uint64(SEGMENT))) & np.uint64((1 << SEGMENT) - 1)
                own = (part == np.uint64(1) << (head % np.uint64(SEGMENT))) | ((part == 0) & (head % np.uint64(SEGMENT) == 0))
                hit = own & (_popcount(x) <= most)
                out_a.append(rep[left[hit]])
                out_b.append(rep[right[hit]])
        else:
            for r in runs.tolist():
                own = fp[r : r + n]
                edges = _forest(_links(own, own, int(key[r]) >> SEGMENT, most))
                if edges:
                    ends = np.array(edges) + r
                    out_a.append(rep[ends[:, 0]])
                    out_b.append(rep[ends[:, 1]])
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _as_edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


def fingerprint_links(scratch: Scratch, fps: DataFrame, most: int = 3, block: int = 2048) -> DataFrame:
    """``fps`` (fp distinct, rep) to edges (a, b) between reps that connect exactly the linked fingerprints."""
    if most > 3:
        raise ValueError("two segments find fingerprints within three bits")
    keys = variant_keys(fps)
    busy = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(F.col("key").alias("__k"), "n"), "busy")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, rep in whole_groups(batches, ["key", "fp", "rep"], 1):
            yield _as_edges(*bucket_edges(key, fp.view(np.uint64), rep, most))

    meet = lambda rows: rows.repartition("key").sortWithinPartitions("key").mapInArrow(plain, "a long, b long")
    if not busy.limit(1).count():
        return meet(keys)

    edges = meet(keys.join(busy, F.col("key") == F.col("__k"), "left_anti"))
    # a crowded key: its members in blocks, one unit of work per pair of blocks
    crowded = (
        keys.join(busy, F.col("key") == F.col("__k"))
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") == F.least("own", "other")).alias("low"), "fp", "rep")
    )

    def pair(table: pa.Table) -> pa.Table:
        head = table.column("key")[0].as_py() >> SEGMENT
        fp, rep, low = (table.column(c).to_numpy() for c in ("fp", "rep", "low"))
        fp = fp.view(np.uint64)
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            ends = _forest(_links(fp, fp, head, most))
            names = rep
        else:
            ends = _between(fp[low], fp[~low], head, most)
            names = np.concatenate([rep[low], rep[~low]])
        ends = np.array(ends, dtype=np.int64).reshape(-1, 2)
        return pa.Table.from_batches([_as_edges(names[ends[:, 0]], names[ends[:, 1]])])

    return edges.union(crowded.groupBy("key", "i", "j").applyInArrow(pair, "a long, b long"))


def near_duplicates(spark: SparkSession, documents: DataFrame, words: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id reachable over links."""
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(documents, words, seed), "fingerprints")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    groups = connected_components(scratch, fingerprint_links(scratch, distinct.filter("rep is not null"), most))
    named = distinct.join(groups, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return marked.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")
