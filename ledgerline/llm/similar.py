"""Near copies of a stated similarity by SimHash: wide fingerprints, deletion variants, verified texts.

Sets of word shingles with Jaccard similarity s have fingerprints that differ at
about arccos(2s / (1 + s)) / pi of their bits, 15 in 100 for s = 0.8: too many
for one short fingerprint.  A text here has one of ``segments`` times ``width``
bits, and two texts meet if some segment differs by at most one bit, which at
the limit of 0.8 happens with probability 0.95 for the 16 segments of 20 bits
that are the default, and for more similar texts more often (0.99 at 0.85).

Every segment is cut into ``pieces``; with all pieces but one equal, the last is
indexed with each of its bits deleted in turn.  So a text is dealt to a key for
each segment and wild piece, and inside a key an equality join on the deletion
variants brings together exactly the texts whose segments differ by at most one
bit.  Pairs whose whole fingerprints differ by more than the limit's bits and
three standard deviations go no further; the shingle sets of the others are
compared, so that all links are exact: a missed link is possible, a wrong one
is not.  The README states the recall on the check tables.

Candidates are met in two rounds.  In the first, the texts of a variant meet the
one of smallest id alone, which joins large groups of copies by links in
proportion to their members.  In the second, all pairs of a variant meet that
are not yet of one component.  What leaves it are never the pairs: the texts that
have one, and as many edges as hold their components together.  The texts of
each group of components so joined are then compared by their whole sets, all
that are of different components, in units of at most two ``unit`` texts, and
again only a spanning forest of the links leaves.

A key of more than ``block`` texts is dealt out: in the first round in blocks, in
the second in pairs of blocks, each a unit of work of bounded size, so no group
of copies meets in one task.

Defined results: words and case as in ``simhash``; texts of fewer words than a
shingle are one shingle; texts without words are copies of each other; equal
texts are told by 64 bits of a SHA-256; rows without an id link with nothing;
rows that repeat an id are one vertex; an empty table gives an empty table;
other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.blocks import SLICE, whole_groups
from ledgerline.llm.cover import Links
from ledgerline.llm.shingles import shingle_set, similar
from ledgerline.operators.components import connected_components
from ledgerline.sources.scratch import Scratch

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Ids that may be broadcast (eight bytes each).
BROADCAST_IDS = 1_000_000


def wide_fingerprint(members: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` words of 64 bits: bit by bit the majority over the remixed hashes of a set."""
    if not len(members):
        return np.zeros(lanes, dtype=np.uint64)
    counts = np.zeros(64 * lanes, dtype=np.int64)
    for a in range(0, len(members), 1 << 15):
        x = members[a : a + (1 << 15), None] + ODD * np.arange(1, lanes + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = np.ascontiguousarray(x ^ (x >> np.uint64(31)))
        weight = 1
        while len(x) > 8:  # carry-save adders: three words of a weight become one of it and one of twice it
            carries = []
            while len(x) > 2:
                m = len(x) // 3
                p, q, r = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                half = p ^ q
                carries.append((p & q) | (half & r))
                x = np.concatenate([half ^ r, x[3 * m :]])
            counts += weight * _bits(x).sum(axis=0, dtype=np.int64)
            x, weight = np.concatenate(carries), weight * 2
        counts += weight * _bits(x).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(members), bitorder="little").view("<u8")


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def most_bits(similarity: float, bits: int) -> int:
    """Bits at which fingerprints of this similarity may differ: the mean and three standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


class Deal:
    """How fingerprints are dealt to keys, and what meets within a key."""

    def __init__(self, segments: int, width: int, pieces: int, most: int) -> None:
        if segments * width % 64 or width % pieces:
            raise ValueError("segments * width must be whole words, and pieces must divide width")
        self.segments, self.width, self.pieces, self.most = segments, width, pieces, most
        self.lanes, self.piece = segments * width // 64, width // pieces
        self.names = [f"f{k}" for k in range(self.lanes)]

    def segment_values(self, f: np.ndarray) -> np.ndarray:
        """(rows, segments): the segments as numbers."""
        bits = _bits(f).reshape(len(f), self.segments, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))

    def keys(self, f: np.ndarray) -> np.ndarray:
        """(rows, segments * pieces): segment, wild piece and the rest of the segment."""
        values = self.segment_values(f)
        out = []
        for s in range(self.segments):
            for h in range(self.pieces):
                wild = ((1 << self.piece) - 1) << (self.piece * h)
                out.append(((s * self.pieces + h) << self.width) | (values[:, s] & ~wild))
        return np.stack(out, axis=1)

    def variants(self, key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Deletion variants of rows: (code, row, bit) with equal codes for rows that meet."""
        head = key >> self.width
        bits = _bits(f).reshape(len(f), self.segments, self.width)
        own = bits[np.arange(len(f)), head // self.pieces] @ (1 << np.arange(self.width, dtype=np.int64))
        wild = (own >> (self.piece * (head % self.pieces))) & ((1 << self.piece) - 1)
        bit = np.arange(self.piece)
        _, group = np.unique(key, return_inverse=True)
        code = ((group[:, None] * self.piece + bit) << self.piece) | (wild[:, None] & ~(1 << bit))
        return code.ravel(), np.repeat(np.arange(len(f)), self.piece), np.tile(bit, len(f))

    def near(self, f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(i), dtype=bool)
        for a in range(0, len(i), 1 << 18):
            part = slice(a, a + (1 << 18))
            hit[part] = np.bitwise_count(f[i[part]] ^ f[j[part]]).sum(axis=1) <= self.most
        return hit


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, length) of runs of equal codes of two rows or more."""
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    n = np.diff(np.r_[first, len(code)])
    return order, first[n > 1], n[n > 1]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _route(deal: Deal, more: list[str]) -> Callable:
    """Rows (id, lanes, more) once for each key of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([batch.column(c).to_numpy() for c in deal.names], axis=1).view(np.uint64)
            key = deal.keys(f)
            again = pa.array(np.repeat(np.arange(batch.num_rows), key.shape[1]))
            rest = [batch.column(c).take(again) for c in ["id", *deal.names, *more]]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *rest], names=["key", "id", *deal.names, *more])

    return run


def _lead_round(deal: Deal) -> Callable:
    """Each text with the one of smallest id that some variant of a key and block holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, ids, *lanes in whole_groups(batches, ["key", "own", "id", *deal.names], 2):
            f = np.stack(lanes, axis=1).view(np.uint64)
            _, block = np.unique(np.c_[key, own], axis=0, return_inverse=True)
            order = np.lexsort((ids, block))
            code, row, _ = deal.variants(key[order], f[order])
            code = (block[order][row] << 40) ^ code
            place, first, n = _runs(code)
            lead, member = np.repeat(row[place[first]], n), row[place[np.repeat(first, n) + _steps(n)]]
            apart = lead != member
            i, j = order[lead[apart]], order[member[apart]]
            both = np.unique(i * len(ids) + j)
            i, j = np.divmod(both, len(ids))
            hit = deal.near(f, i, j)
            yield _pairs(ids[i[hit]], ids[j[hit]])

    return run


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _pair_round(deal: Deal) -> Callable:
    """What near pairs of different components there are between the two blocks of a unit.

    Rows (a, b, is_edge): edges that join components, or a text with such a pair and its component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x, y, low, ids, group, *lanes in whole_groups(batches, ["key", "x", "y", "low", "id", "component", *deal.names], 3):
            f = np.stack(lanes, axis=1).view(np.uint64)
            _, unit = np.unique(np.c_[key, x, y], axis=0, return_inverse=True)
            code, row, _ = deal.variants(key, f)
            place, first, n = _runs((unit[row] << 40) ^ code)
            if not len(first):
                continue
            row = row[place]
            inner = _steps(n) + np.repeat(first, n)
            starts = np.cumsum(n) - n
            sorted_group = group[row[inner]]
            mixed = np.minimum.reduceat(sorted_group, starts) != np.maximum.reduceat(sorted_group, starts)
            components, own = np.unique(group, return_inverse=True)
            joined, has_pair = Links(len(components)), np.zeros(len(ids), dtype=bool)
            for size in np.unique(n[mixed]).tolist():
                for i, j in _places(first[mixed & (n == size)], size):
                    p, q = row[i], row[j]
                    hit = (own[p] != own[q]) & ((x[p] == y[p]) | (low[p] != low[q]))
                    p, q = p[hit], q[hit]
                    near = deal.near(f, p, q)
                    p, q = p[near], q[near]
                    has_pair[p], has_pair[q] = True, True
                    joined.join_all(own[p], own[q])
            ends = np.array(joined.edges, dtype=np.int64).reshape(-1, 2)
            texts = np.unique(np.c_[ids[has_pair], group[has_pair]], axis=0)
            a = np.r_[components[ends[:, 0]], texts[:, 0]]
            b = np.r_[components[ends[:, 1]], texts[:, 1]]
            is_edge = np.arange(len(a)) < len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(is_edge)], names=["a", "b", "is_edge"])

    return run


def _places(starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in runs of one length, in parts of bounded size."""
    if size <= 64:
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 18) // len(i))
        for a in range(0, len(starts), step):
            base = starts[a : a + step, None]
            yield (base + i).ravel(), (base + j).ravel()
        return
    for start in starts.tolist():
        for k in range(size - 1):
            j = np.arange(start + k + 1, start + size)
            yield np.full(len(j), start + k), j


def _verified(pairs: DataFrame, texts: Callable[[], DataFrame], scratch: Scratch, words: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; only texts that some pair names are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) > 256:
                    held.clear()
                for i, text in ((a, s), (b, t)):
                    if i not in held:
                        held[i] = shingle_set(text, words)
                keep.append(similar(held[a], held[b], least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = scratch.save(pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct(), "needed")
    few = needed.count() <= BROADCAST_IDS
    some = texts().join(F.broadcast(needed) if few else needed, F.col("id") == F.col("n"), "left_semi").dropDuplicates(["id"])
    some = scratch.save(some, "texts")
    left = some.select(F.col("id").alias("__a"), F.col("text").alias("s"))
    right = some.select(F.col("id").alias("__b"), F.col("text").alias("t"))
    both = pairs.join(right, F.col("b") == F.col("__b")).join(left, F.col("a") == F.col("__a"))
    links = scratch.save(both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long"), "links")
    scratch.drop(some)
    scratch.release()
    return links


def _dealt(scratch: Scratch, marks: DataFrame, deal: Deal, block: int, more: list[str]) -> DataFrame:
    """``marks`` (id, lanes, more) once for each key, with the key's number of blocks and the row's own."""
    lanes = ", ".join(f"{c} long" for c in deal.names)
    routed = marks.select("id", *deal.names, *more).mapInArrow(_route(deal, more), f"key long, id long, {lanes}" + "".join(f", {c} long" for c in more))
    busy = routed.groupBy("key").count().filter(F.col("count") > block)
    busy = scratch.save(busy.select(F.col("key").alias("__k"), F.ceil(F.col("count") / block).cast("long").alias("blocks")), "busy")
    if not busy.limit(1).count():
        return routed.withColumn("blocks", F.lit(1).cast("long")).withColumn("own", F.lit(0).cast("long"))
    sized = routed.join(busy, F.col("key") == F.col("__k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return sized.withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))


def lead_pairs(scratch: Scratch, marks: DataFrame, deal: Deal, block: int) -> DataFrame:
    """(a, b): each text with the first of its variants."""
    dealt = _dealt(scratch, marks, deal, block, []).select("key", "own", "id", *deal.names).repartition("key", "own").sortWithinPartitions("key", "own")
    return dealt.mapInArrow(_lead_round(deal), "a long, b long").distinct()


def open_pairs(scratch: Scratch, marks: DataFrame, deal: Deal, block: int) -> DataFrame:
    """(a, b, is_edge) of ``marks`` (id, lanes, component): see ``_pair_round``."""
    units = _dealt(scratch, marks, deal, block, ["component"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    units = units.select("key", x.alias("x"), y.alias("y"), (F.col("own") == x).alias("low"), "id", "component", *deal.names)
    dealt = units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(_pair_round(deal), "a long, b long, is_edge boolean").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of some sets share; members of one set alone are left out first."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[member]
    owner, member = owner[keep], number[member[keep]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    total = np.zeros((n, n), dtype=np.int64)
    for a in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(member, (a, a + 2048))
        present = np.zeros((n, 2048), dtype=np.float32)
        present[owner[i:j], member[i:j] - a] = 1
        total += (present @ present.T).astype(np.int64)
    return total


def unit_links(ids: list[int], components: list[int], sides: list[bool] | None, texts: list[str], words: int, least: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links between texts of different components, and of different sides if there are two."""
    sets = [shingle_set(t, words) for t in texts]
    common, size = _common(sets), np.array([len(s) for s in sets])
    hit = common * least.denominator >= least.numerator * (size[:, None] + size - common)
    hit &= np.not_equal.outer(components, components)
    if sides is not None:
        hit &= np.not_equal.outer(sides, sides)
    links = Links(len(ids))
    links.join_all(*np.nonzero(np.triu(hit, 1)))
    return [(ids[i], ids[j]) for i, j in links.edges]


def _compare_units(words: int, least: Fraction) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (_, x, y), unit in groupby(rows, key=lambda r: (r["super"], r["x"], r["y"])):
            held = list(unit)
            sides = None if x == y else [r["low"] for r in held]
            found = unit_links([r["id"] for r in held], [r["component"] for r in held], sides, [r["text"] for r in held], words, least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], names=["a", "b"])

    return run


def verified_groups(scratch: Scratch, found: DataFrame, texts: Callable[[], DataFrame], words: int, least: Fraction, unit: int) -> DataFrame:
    """(a, b): links between texts of different components, from what ``open_pairs`` has found."""
    supers = connected_components(scratch, found.filter("is_edge").select("a", "b")).select(F.col("node").alias("__c"), F.col("component").alias("super"))
    members = found.filter("not is_edge").select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()
    members = scratch.save(members.join(supers, F.col("component") == F.col("__c")).drop("__c"), "members")
    sizes = members.groupBy("super").agg(F.count("*").alias("n")).select(F.col("super").alias("__s"), F.ceil(F.col("n") / unit).cast("long").alias("blocks"))
    parts = members.groupBy("super", "component").agg(F.count("*").alias("n")).select(
        F.col("super").alias("__p"), F.col("component").alias("__c"), F.ceil(F.col("n") / unit).cast("long").alias("parts")
    )
    placed = members.join(sizes, F.col("super") == F.col("__s")).join(parts, (F.col("super") == F.col("__p")) & (F.col("component") == F.col("__c")))
    # a component's texts lie side by side, so that few blocks hold several components
    own = F.pmod(F.xxhash64("component") + F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")), F.col("blocks"))
    placed = scratch.save(placed.select("id", "component", "super", own.alias("own")), "placed")
    blocks = placed.groupBy("super", "own").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    left = blocks.select("super", F.col("own").alias("x"), F.col("least").alias("l"), F.col("most").alias("m"))
    right = blocks.select(F.col("super").alias("__s"), F.col("own").alias("y"), "least", "most")
    units = left.join(right, (F.col("super") == F.col("__s")) & (F.col("x") <= F.col("y"))).filter((F.least("l", "least") != F.greatest("m", "most")))
    units = scratch.save(units.select(F.col("super").alias("__u"), "x", "y"), "units")
    few = placed.count() <= BROADCAST_IDS
    needed = placed.select(F.col("id").alias("n"))
    some = texts().join(F.broadcast(needed) if few else needed, F.col("id") == F.col("n"), "left_semi").dropDuplicates(["id"])
    some = scratch.save(some.select(F.col("id").alias("__i"), "text"), "texts")
    rows = placed.join(some, F.col("id") == F.col("__i")).drop("__i")
    both = rows.join(units, (F.col("super") == F.col("__u")) & ((F.col("own") == F.col("x")) | (F.col("own") == F.col("y"))))
    both = both.select("super", "x", "y", "id", "component", (F.col("own") == F.col("x")).alias("low"), "text")
    dealt = both.repartition("super", "x", "y").sortWithinPartitions("super", "x", "y")
    links = scratch.save(dealt.mapInArrow(_compare_units(words, least), "a long, b long"), "links")
    scratch.drop(some)
    scratch.release()
    return links


def near_duplicates(
    spark: SparkSession, documents: DataFrame, words: int = 5, similarity: float = 0.8, segments: int = 16, width: int = 20, block: int = 1 << 17, unit: int = 512,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``documents`` (doc_id, text) to (doc_id, component_id): the smallest doc_id reachable over similar texts.

    A caller that gives its own ``scratch`` may clear it when it has read the result.
    """
    scratch, least = scratch or Scratch(spark, "similar"), Fraction(str(similarity))
    bare = F.trim(F.lower("text"), F.lit(" \t\n\r\x0b\x0c")) == ""
    own = F.xxhash64(F.when(bare, F.lit("")).otherwise(F.sha2("text", 256)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).filter("doc is not null")
    rows = rows.withColumn("id", own)
    lanes = segments * width // 64
    names = [f"f{k}" for k in range(lanes)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            f = np.array([wide_fingerprint(s, lanes) for s in sets], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array([len(s) > 0 for s in sets], pa.bool_()), *(pa.array(f[:, k]) for k in range(lanes))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "id", "some", *names])

    marked = rows.select("doc", "id", "text").mapInArrow(mark, "doc long, id long, some boolean, " + ", ".join(f"{c} long" for c in names))
    marks = scratch.save(marked, "marks")
    firsts = scratch.save(marks.groupBy("id").agg(F.min("doc").alias("first"), F.max("some").alias("some"), *[F.max(c).alias(c) for c in names]), "distinct")
    some = firsts.filter("some")
    # more pieces deal the rows finer, for the same pairs
    pieces = 2 if some.count() <= SLICE << (width // 2) else 4
    deal = Deal(segments, width, pieces, most_bits(similarity, segments * width))
    texts = lambda: rows.select("id", "text")
    links = _verified(scratch.save(lead_pairs(scratch, some, deal, block), "leads"), texts, scratch, words, least)
    groups = connected_components(scratch, links)
    grouped = some.join(groups, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    more = verified_groups(scratch, scratch.save(open_pairs(scratch, grouped, deal, block), "open"), texts, words, least, unit)

    first = firsts.select(F.col("id").alias("__i"), "first")
    ends = (
        links.union(more)
        .join(first.select(F.col("__i").alias("__x"), F.col("first").alias("x")), F.col("a") == F.col("__x"))
        .join(first.select(F.col("__i").alias("__y"), F.col("first").alias("y")), F.col("b") == F.col("__y"))
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    same = marks.join(first, F.col("id") == F.col("__i")).select(F.col("doc").alias("a"), F.col("first").alias("b"))
    found = connected_components(scratch, ends.union(same))
    every = marks.select(F.col("doc").alias("doc_id")).distinct()
    return every.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
