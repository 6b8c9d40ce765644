"""Scores of a hierarchical Pitman-Yor language model of word pairs.

Every word that precedes another is a restaurant whose customers are the words
that follow it; all restaurants share one parent, whose customers are their
tables, and the parent's own parent is uniform over the vocabulary.  A text's
words are followed by one end, which is also what precedes the first word.

Seating is sampled by Gibbs sweeps.  A dish's customers in one restaurant are
reseated together, given the restaurant's other tables and the dish's parent
probability.  For up to ``SMALL`` customers the number of tables is drawn from
its conditional itself (generalised Stirling numbers).  For more, a seating is
drawn table by table, through the waiting time to the next new one, from a
process close to the Chinese restaurant's for customers of one dish, and accepted
by Metropolis-Hastings against the present seating, which its random numbers
draw again; so both leave the conditional as it is, and cost grows with tables,
not with customers.  The parent's dishes are reseated
likewise.  All dishes of a sweep meet the totals of the sweep before.  The first
``burn_in`` sweeps are discarded and the predictive probabilities of the next
``samples`` are averaged.  Discounts are estimated from the numbers of pairs,
and of words' tables, seen once and twice; ``theta`` is given.

Nothing is collected.  The work is a set of nodes with a state each that send
each other packed arrays: documents become chunks of some millions of tokens;
word nodes hold the words of a range of hashes with their totals; pair nodes
hold the dishes of a share of all word pairs.  Each distinct pair of the corpus
is seated once per sweep, at one node.  Pairs are dealt by both words, so a
frequent word's restaurant or dish is spread over all pair nodes, which send its
word node one partial sum each.  A message with nothing in it is not sent, so
there are never more messages than distinct pairs of chunks.  The number of
nodes grows with the tokens and each node's share stays the same.

Words are told apart by 64-bit hashes; pairs by both of their words.

Defined results: a null or empty text is its end alone; tokens without training
count have parent probability from the uniform share; documents that repeat a
doc_id, or have none, are scored, and learnt from, as often as they appear; an
empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, functions as F

from ledgerline.sources.scratch import Scratch

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A node's state or a message to it: what it is, the node, whom it is from, packed arrays, numbers for all.
ENVELOPE = "kind string, node long, origin long, parts array<binary>, stats array<double>"
SCHEMA = pa.schema([("kind", pa.string()), ("node", pa.int64()), ("origin", pa.int64()), ("parts", pa.list_(pa.binary())), ("stats", pa.list_(pa.float64()))])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Dishes of up to so many customers are drawn from their conditional, others by Metropolis-Hastings.
SMALL = 512
#: Up to so many customers the conditional is worked out in plain products, then in logarithms.
DIRECT = 16
ODD = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64(2**32 - 1)


# packed arrays


def squeeze(a: np.ndarray, dtype: str = "<u8") -> bytes:
    """An array as compressed byte planes."""
    import zstandard

    a = np.ascontiguousarray(a, dtype=dtype)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def expand(raw: bytes, dtype: str = "<u8") -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def squeeze_sorted(a: np.ndarray) -> bytes:
    a = a.astype(np.uint64)
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def expand_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw), dtype=np.uint64)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """(kind, node, origin, parts, stats) rows as Arrow."""
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _joined(rows: list[dict], part: int, read: Callable[[bytes], np.ndarray] = expand) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=np.uint64), *(read(r["parts"][part]) for r in rows)])


def _of(rows: list[dict], kind: str) -> list[dict]:
    """The rows of a kind by origin."""
    return sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["origin"])


def _spread(arrived: DataFrame, nodes: int) -> GroupedData:
    """Nodes in partitions of a stated number: few bytes are much work here, so they are not to be put together."""
    partitions = int(arrived.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrived.repartition(max(partitions, nodes), "node").groupBy("node")


def at_nodes(arrived: DataFrame, nodes: int, work: Callable[[list[dict]], Iterable[tuple]]) -> DataFrame:
    """Runs ``work`` at every node on the state and messages that it has."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(list(work(table.to_pylist())))])

    return _spread(arrived, nodes).applyInArrow(run, ENVELOPE)


# random numbers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and salt alone."""
    salted = mix(key + np.atleast_1d(salt).astype(np.uint64) * ODD)
    return ((salted >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _uniform_one(key: int, salt: int) -> float:
    """``uniform`` of single numbers."""
    x = (key + salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2**53


# seating


def stirling_steps(d: float, most: int) -> np.ndarray:
    """log(S(c, k + 1) / S(c, k)) of the generalised Stirling numbers at [c, k], k < c."""
    log_s = np.full((most + 1, most + 2), -np.inf)
    log_s[1, 1] = 0.0
    k = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            log_s[c + 1, 1 : most + 1] = np.logaddexp(log_s[c, :most], np.log(np.maximum(c - d * k, 0.0)) + log_s[c, 1 : most + 1])
        return log_s[:, 1:] - log_s[:, :-1]


_steps: dict[float, np.ndarray] = {}


def draw_small(c: np.ndarray, strength: np.ndarray, parent: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of 1 to ``SMALL`` customers, from their conditional; ``u`` are the random numbers.

    ``strength`` is theta + d * the restaurant's other tables.
    """
    t = np.ones(len(c))
    if d not in _steps:
        _steps.clear()
        _steps[d] = stirling_steps(d, SMALL)
    steps = _steps[d]
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(SMALL + 2))
    for size in np.flatnonzero(np.diff(bounds)).tolist():
        if size < 2:
            continue
        own = order[bounds[size] : bounds[size + 1]]
        k = np.arange(1, size)
        width = max(1, (1 << 18) // size)
        for a in range(0, len(own), width):
            at = own[a : a + width]
            if size <= DIRECT:  # one row per number of tables; products of so few factors stay in range
                ratio = (strength[at] + d * k[:, None]) * (parent[at] * np.exp(steps[size, 1:size])[:, None])
                weight = np.empty((size, len(at)))
                weight[0], weight[1:] = 1.0, np.cumprod(ratio, axis=0)
            else:
                logs = np.log(strength[at] + d * k[:, None]) + (np.log(parent[at]) + steps[size, 1:size, None])
                logs = np.concatenate([np.zeros((1, len(at))), np.cumsum(logs, axis=0)])
                weight = np.exp(logs - logs.max(axis=0))
            weight = np.cumsum(weight, axis=0)
            t[at] = 1 + (weight < u[at] * weight[-1]).sum(axis=0)
    return t


def seat(c: float, drawn: tuple[float, float], now: tuple[float, float], d: float, key: int, salt: int) -> tuple[float, float]:
    """Tables of a seating of one dish's customers, and its log weight: what it is worth over how likely it was to be drawn.

    Both settings are (strength, parent probability).  Under the Chinese
    restaurant process a customer after n opens a table with odds that fall as
    1 / n; but a table also lessens what later customers of this dish are worth,
    about as (n / c) ** d.  The seating is drawn with both: the wait for the next
    table then has the survival exp(-a / d * ((m / c) ** d - (n / c) ** d)), so
    each table costs one random number.  It is drawn under ``drawn`` and weighed
    under ``now``.
    """
    log_gamma, log, odd = math.lgamma, math.log, 1 / d
    t, n, start, weight = 1, 1, c**-d, 0.0
    base = salt * 1_000_003
    while n < c:
        gone = d * t
        reached = start - d * log(_uniform_one(key, base + t)) / ((drawn[0] + gone) * drawn[1])
        b = (now[0] + gone) * now[1] * odd
        if reached >= 1:
            return t, weight + log_gamma(c - gone) - log_gamma(n - gone) + b * (1 - start)
        seated = min(c, max(n + 1, math.ceil(c * reached**odd)))
        before, after = ((seated - 1) / c) ** d, (seated / c) ** d
        weight += log_gamma(seated - 1 - gone) - log_gamma(n - gone) + log(b * d) + b * (before - start)
        weight -= log(max(-math.expm1(-b * (after - before)), 1e-300))
        t, n, start = t + 1, seated, after
    return t, weight


class Memory:
    """How the present seating of each dish of many customers was drawn: settings and sweep, 0 if never."""

    def __init__(self, strength: np.ndarray, parent: np.ndarray, salt: np.ndarray) -> None:
        self.strength, self.parent, self.salt = strength.copy(), parent.copy(), salt.copy()

    @staticmethod
    def empty(n: int) -> Memory:
        return Memory(np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.uint64))

    def parts(self) -> list[bytes]:
        return [squeeze(self.strength, "<f8"), squeeze(self.parent, "<f8"), squeeze(self.salt)]

    @staticmethod
    def read(parts: list[bytes]) -> Memory:
        return Memory(expand(parts[0], "<f8"), expand(parts[1], "<f8"), expand(parts[2]))


def reseat(c: np.ndarray, strength: np.ndarray, parent: np.ndarray, d: float, key: np.ndarray, salt: int, memory: Memory) -> np.ndarray:
    """Tables of every dish after a sweep; ``memory`` is brought up to date."""
    t = np.minimum(c, 1).astype(np.float64)
    few = np.flatnonzero((c > 1) & (c <= SMALL))
    t[few] = draw_small(c[few].astype(np.int64), strength[few], parent[few], d, uniform(key[few], salt))
    for i in np.flatnonzero(c > SMALL).tolist():
        size, now, own = float(c[i]), (float(strength[i]), float(parent[i])), int(key[i])
        tables, weight = seat(size, now, now, d, own, salt)
        if memory.salt[i]:
            present, before = seat(size, (float(memory.strength[i]), float(memory.parent[i])), now, d, own, int(memory.salt[i]))
            if math.log(_uniform_one(own ^ 0xFFFFFFFFFFFFFFFF, salt)) >= weight - before:
                t[i] = present
                continue
        t[i] = tables
        memory.strength[i], memory.parent[i], memory.salt[i] = *now, salt
    few = c <= SMALL
    memory.strength[few], memory.parent[few], memory.salt[few] = 0.0, 0.0, 0
    return t


# chunks


def chunks(documents: DataFrame, held: Column, key: str, text: str, most: int) -> DataFrame:
    """Documents as nodes of about ``most`` tokens: ids, missing ids, held, lengths, tokens, hashes; [tokens, the end's number]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        part, number = TaskContext.get().partitionId(), 0
        voc: defaultdict = defaultdict()
        voc.default_factory = voc.__len__
        rows: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxh64_intdigest, voc, repeat(7)), dtype=np.uint64, count=len(voc))
            order = np.argsort(hashes)
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            tokens = rank[np.concatenate([r[2] for r in rows])]
            parts = [
                squeeze(np.array([r[0] or 0 for r in rows], dtype=np.int64), "<i8"),
                squeeze(np.array([r[0] is None for r in rows]), "u1"),
                squeeze(np.array([r[1] for r in rows]), "u1"),
                squeeze(np.array([len(r[2]) for r in rows])),
                squeeze(tokens, "<u4"),
                squeeze_sorted(hashes[order]),
            ]
            return _packed([("chunk", (part << 24) + number, -1, parts, [float(len(tokens)), float(rank[voc[b""]])])])

        for batch in batches:
            for id_, out, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (value.as_py() or "").encode().translate(LOWER).split()
                words.append(b"")
                rows.append((id_, out, np.fromiter(map(voc.__getitem__, words), dtype=np.uint32, count=len(words))))
                total += len(words)
                if total >= most:
                    yield flush()
                    number, total = number + 1, 0
                    rows.clear()
                    voc.clear()
        if rows:
            yield flush()

    return documents.select(F.col(key).cast("long"), F.coalesce(held, F.lit(False)), F.col(text)).mapInArrow(run, ENVELOPE)


class Chunk:
    """A chunk's tokens and their distinct pairs, sorted."""

    def __init__(self, row: dict) -> None:
        self.parts, self.last = row["parts"], int(row["stats"][1])
        self.held, self.lens = expand(self.parts[2], "u1"), expand(self.parts[3]).astype(np.int64)
        self.tokens, self.words = expand(self.parts[4], "<u4").astype(np.int64), expand_sorted(self.parts[5])
        self.code = np.r_[np.int64(self.last), self.tokens[:-1]] * len(self.words) + self.tokens

    def train_counts(self) -> np.ndarray:
        train = np.repeat(self.held == 0, self.lens)
        return np.bincount(self.tokens[train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, training count) of each distinct pair, and the pair of every token."""
        found, where = np.unique(self.code, return_inverse=True)
        train = np.repeat(self.held == 0, self.lens)
        return found, np.bincount(where[train], minlength=len(found)), where


def dealt(u: np.ndarray, w: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in the order of their pair nodes, and where each node's begin."""
    node = (mix(u * ODD + mix(w)) % np.uint64(nodes)).astype(np.int32)
    order = np.argsort(node, kind="stable")
    return order, np.searchsorted(node[order], np.arange(nodes + 1))


def _by_word_node(ids: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The word nodes of sorted ids, and their ranges."""
    node = (ids >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, dtype=np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(node)]):
        yield int(node[a]), slice(a, b)


def send_words(nodes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([(b << 64) // nodes for b in range(1, nodes)], dtype=np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk = Chunk(row)
                counts = chunk.train_counts()
                ends = np.r_[0, np.searchsorted(chunk.words, cuts), len(chunk.words)].tolist()
                yield _packed(
                    [
                        ("words", b, row["node"], [squeeze_sorted(chunk.words[i:j]), squeeze(counts[i:j])], None)
                        for b, (i, j) in enumerate(zip(ends, ends[1:]))
                        if j > i
                    ]
                )

    return run


def name_words(rows: list[dict]) -> Iterator[tuple]:
    """A word node gives its words their places and answers every chunk with places and totals."""
    sent = _of(rows, "words")
    hashes = [expand_sorted(r["parts"][0]) for r in sent]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(place, weights=_joined(sent, 1)).astype(np.uint64)
    node, a = sent[0]["node"], 0
    for r, own in zip(sent, hashes):
        at = place[a : a + len(own)]
        yield "named", r["origin"], node, [squeeze_sorted(at), squeeze(totals[at])], None
        a += len(own)
    yield "word", node, -1, [squeeze(totals)], [float(totals.sum()), float((totals > 0).sum())]


def name_chunk(nodes: int) -> Callable:
    """A chunk learns its words' ids and totals and sends its pairs to their nodes."""

    def work(rows: list[dict]) -> Iterator[tuple]:
        row, replies = _of(rows, "chunk")[0], _of(rows, "named")
        chunk = Chunk(row)
        ids = np.concatenate([expand_sorted(r["parts"][0]) + (np.uint64(r["origin"]) << np.uint64(32)) for r in replies])
        yield "chunk", row["node"], -1, [*row["parts"][:5], squeeze_sorted(ids), squeeze(_joined(replies, 1))], row["stats"]
        found, counts, _ = chunk.pairs()
        u, w = (ids[x] for x in np.divmod(found, len(ids)))
        order, ends = dealt(u, w, nodes)
        for b in range(nodes):
            own = order[ends[b] : ends[b + 1]]
            if len(own):
                yield "pairs", b, row["node"], [squeeze_sorted(u[own]), squeeze(w[own]), squeeze(counts[own])], None

    return work


# pair nodes


def gather_pairs(rows: list[dict]) -> Iterator[tuple]:
    """A pair node adds up its pairs, tells words their first tables, and asks for what its dishes will need."""
    sent = _of(rows, "pairs")
    node = sent[0]["node"]
    u, w = _joined(sent, 0, expand_sorted), _joined(sent, 1)
    lens = [len(expand(r["parts"][1])) for r in sent]
    u_ids, u = np.unique(u, return_inverse=True)
    w_ids, w = np.unique(w, return_inverse=True)
    distinct, place = np.unique(u * len(w_ids) + w, return_inverse=True)
    counts = np.bincount(place, weights=_joined(sent, 2)).astype(np.uint64)
    a = 0
    for r, n in zip(sent, lens):
        yield "place", node, r["origin"], [squeeze_sorted(place[a : a + n])], None
        a += n
    yield "counts", node, -1, [squeeze(counts)], [float((counts == 1).sum()), float((counts == 2).sum())]
    u, w = np.divmod(distinct, len(w_ids))
    trained, active = counts > 0, counts > 1
    tables = np.bincount(u[trained], minlength=len(u_ids))
    customers = np.bincount(w[trained], minlength=len(w_ids))
    asks_u, asks_w = np.zeros(len(u_ids), dtype=bool), np.zeros(len(w_ids), dtype=bool)
    asks_u[u[active]], asks_w[w[active]] = True, True
    parts = {b: [squeeze(np.empty(0))] * 6 for b, _ in [*_by_word_node(u_ids), *_by_word_node(w_ids)]}
    for first, ids, values, asks in ((0, u_ids, tables, asks_u), (2, w_ids, customers, asks_w)):
        for b, own in _by_word_node(ids):
            places, some = ids[own] & PLACE, values[own] > 0
            told = [squeeze_sorted(places[some]), squeeze(values[own][some])]
            parts[b] = [*parts[b][:first], *told, *parts[b][first + 2 :]]
            parts[b][4 + first // 2] = squeeze_sorted(places[asks[own]])
    for b, told in parts.items():
        yield "first", b, node, told, None
    u, w, c = np.searchsorted(np.flatnonzero(asks_u), u[active]), np.searchsorted(np.flatnonzero(asks_w), w[active]), counts[active]
    state = [squeeze_sorted(u_ids[asks_u]), squeeze_sorted(w_ids[asks_w]), squeeze(u, "<u4"), squeeze(w, "<u4"), squeeze(c), squeeze(np.minimum(c, 1)), squeeze(c * 0)]
    yield "dish", node, -1, [*state, *Memory.empty(len(c)).parts()], None


def parent_probability(customers: np.ndarray, seats: np.ndarray, root: tuple[float, float], model: dict) -> np.ndarray:
    """Probability of words in the parent; ``root`` is all its (tables, customers)."""
    theta, d = model["theta"], model["parent_discount"]
    return (customers - d * seats + (theta + d * root[0]) / (model["vocabulary"] + 1)) / (theta + root[1])


def seat_pairs(model: dict, root: tuple[float, float], sweep: int, keep: bool) -> Callable:
    """A pair node reseats its dishes and sends what they have beyond one table each."""

    def work(rows: list[dict]) -> Iterator[tuple]:
        state, totals = _of(rows, "dish")[0], _of(rows, "totals")
        parts = state["parts"]
        u_ids, w_ids = expand_sorted(parts[0]), expand_sorted(parts[1])
        u, w = expand(parts[2], "<u4"), expand(parts[3], "<u4")
        c, t, kept = (expand(p).astype(np.float64) for p in parts[4:7])
        memory = Memory.read(parts[7:10])
        tables, customers, seats = (_joined(totals, k).astype(np.float64) for k in range(3))
        theta, d = model["theta"], model["discount"]
        strength = theta + d * np.maximum(tables[u] - t, 0)
        parent = parent_probability(customers, seats, root, model)[w]
        key = mix(u_ids[u] * ODD + mix(w_ids[w]))
        t = reseat(c, strength, parent, d, key, sweep, memory)
        yield "dish", state["node"], -1, [*parts[:5], squeeze(t), squeeze(kept + t * keep), *memory.parts()], None
        more: dict[int, list[bytes]] = defaultdict(lambda: [squeeze(np.empty(0))] * 4)
        for first, ids, at in ((0, u_ids, u), (2, w_ids, w)):
            beyond = np.bincount(at, weights=t - 1, minlength=len(ids))
            some = np.flatnonzero(beyond)
            for b, own in _by_word_node(ids[some]):
                told = [squeeze_sorted(ids[some][own] & PLACE), squeeze(beyond[some][own])]
                more[b] = [*more[b][:first], *told, *more[b][first + 2 :]]
        for b, told in more.items():
            yield "more", b, state["node"], told, None

    return work


def answer_chunks(samples: int) -> Callable:
    """A pair node tells every chunk the counts, and tables added up over the samples, of the pairs it sent."""

    def work(rows: list[dict]) -> Iterator[tuple]:
        counts = expand(_of(rows, "counts")[0]["parts"][0])
        tables = np.minimum(counts, 1) * np.uint64(samples)
        tables[counts > 1] = expand(_of(rows, "dish")[0]["parts"][6])
        for r in _of(rows, "place"):
            at = expand_sorted(r["parts"][0]).astype(np.int64)
            yield "seen", r["origin"], r["node"], [squeeze(counts[at]), squeeze(tables[at])], None

    return work


# word nodes


def _added(total: np.ndarray, rows: list[dict], places: int, values: int) -> np.ndarray:
    at, more = _joined(rows, places, expand_sorted).astype(np.int64), _joined(rows, values)
    return total + np.bincount(at, weights=more, minlength=len(total))


def _told(asks: list[dict], tables: np.ndarray, customers: np.ndarray, seats: np.ndarray) -> Iterator[tuple]:
    for r in asks:
        u, w = (expand_sorted(p).astype(np.int64) for p in r["parts"])
        yield "totals", r["origin"], r["node"], [squeeze(tables[u]), squeeze(customers[w]), squeeze(seats[w])], None


def first_totals(rows: list[dict]) -> Iterator[tuple]:
    """A word node adds up its words' first tables, as contexts and as dishes of the parent, and answers."""
    word, sent = _of(rows, "word")[0], _of(rows, "first")
    node = word["node"]
    none = np.zeros(len(expand(word["parts"][0])))
    tables, customers = _added(none, sent, 0, 1), _added(none, sent, 2, 3)
    seats = np.minimum(customers, 1)
    asks = [{"node": node, "origin": r["origin"], "parts": r["parts"][4:6]} for r in sent]
    stats = [float(seats.sum()), float(customers.sum()), float((customers == 1).sum()), float((customers == 2).sum())]
    yield "word", node, -1, [squeeze(tables), squeeze(customers), squeeze(seats), *Memory.empty(len(none)).parts()], stats
    for r in asks:
        yield "ask", node, r["origin"], r["parts"], None
    yield from _told(asks, tables, customers, seats)


def seat_words(model: dict, root: tuple[float, float], sweep: int, keep: bool) -> Callable:
    """A word node adds up its words' tables, reseats them in the parent and answers; samples are kept."""

    def work(rows: list[dict]) -> Iterator[tuple]:
        state, asks, sent = _of(rows, "word")[0], _of(rows, "ask"), _of(rows, "more")
        parts, node = state["parts"], state["node"]
        first_tables, first_customers, seats = (expand(p).astype(np.float64) for p in parts[:3])
        memory = Memory.read(parts[3:6])
        tables, customers = _added(first_tables, sent, 0, 1), _added(first_customers, sent, 2, 3)
        theta, d = model["theta"], model["parent_discount"]
        key = mix((np.uint64(node) << np.uint64(32)) + np.arange(len(seats), dtype=np.uint64))
        strength = theta + d * np.maximum(root[0] - seats, 0)
        seats = reseat(customers, strength, np.full(len(seats), 1 / (model["vocabulary"] + 1)), d, key, sweep, memory)
        sample = [squeeze(tables), squeeze(customers), squeeze(seats)] if keep else []
        yield "word", node, -1, [*parts[:2], squeeze(seats), *memory.parts(), *parts[6:], *sample], [float(seats.sum()), float(customers.sum())]
        yield from _told(asks, tables, customers, seats)

    return work


def send_samples(rows: list[dict]) -> Iterator[tuple]:
    """A word node sends every chunk the sampled totals of its words."""
    word = _of(rows, "word")[0]
    samples = [expand(p) for p in word["parts"][6:]]
    for r in _of(rows, "named"):
        at = expand_sorted(r["parts"][0]).astype(np.int64)
        yield "samples", r["origin"], word["node"], [squeeze(s[at]) for s in samples], None


# the whole


def _scores(model: dict, roots: list[tuple[float, float]], nodes: int) -> Callable:
    """Scores of a chunk's documents, from its pairs' and words' sampled totals."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row, seen, told = _of(rows, "chunk")[0], _of(rows, "seen"), _of(rows, "samples")
        chunk = Chunk(row)
        ids, words = expand_sorted(row["parts"][5]), expand(row["parts"][6]).astype(np.float64)
        found, _, where = chunk.pairs()
        u, w = np.divmod(found, len(ids))
        order, _ = dealt(ids[u], ids[w], nodes)
        counts, tables = np.empty(len(found)), np.empty(len(found))
        counts[order], tables[order] = _joined(seen, 0), _joined(seen, 1)
        theta, d = model["theta"], model["discount"]
        probability = counts * len(roots) - d * tables
        for k, root in enumerate(roots):
            all_tables, customers, seats = (_joined(told, 3 * k + j).astype(np.float64) for j in range(3))
            probability += (theta + d * all_tables[u]) * parent_probability(customers, seats, root, model)[w]
        logs = np.log10(probability / (len(roots) * (theta + words[u])))[where]
        known = words[chunk.tokens]
        base = np.log10((known + 1) / (model["tokens"] + model["vocabulary"] + 1))
        start = np.cumsum(chunk.lens) - chunk.lens
        add = lambda values: pa.array(np.add.reduceat(values, start))
        docs = pa.array(expand(chunk.parts[0], "<i8"), mask=expand(chunk.parts[1], "u1") > 0)
        columns = [docs, pa.array(chunk.held > 0), pa.array(chunk.lens), add((known > 0).astype(np.int64)), add(base), add(logs)]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def discount(once: float, twice: float) -> float:
    """The usual estimate from what is seen once and twice, kept inside (0, 1)."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def _sums(rows: DataFrame, n: int) -> list[float]:
    return list(rows.agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0.0)) for k in range(n)]).first())


def score(
    spark: SparkSession,
    documents: DataFrame,
    held: Column,
    burn_in: int = 1,
    samples: int = 3,
    theta: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    chunk_tokens: int = 2_000_000,
    node_tokens: int = 2_000_000,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity); learns where ``held`` is false."""
    scratch = Scratch(spark, "lm")
    kind = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    save = lambda df, name: scratch.save(df, name, ["kind"])
    cut = save(chunks(documents, held, key, text, chunk_tokens), "chunks")
    tokens = _sums(cut, 1)[0]
    nodes = int(max(1, -(-tokens // node_tokens), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // 100_000))))

    named = save(at_nodes(cut.mapInArrow(send_words(nodes), ENVELOPE), nodes, name_words), "words")
    model = {"theta": theta} | dict(zip(("tokens", "vocabulary"), _sums(kind(named, "word"), 2)))
    told = save(at_nodes(cut.union(kind(named, "named")), nodes, name_chunk(nodes)), "named")
    scratch.drop(cut)
    scratch.release()
    pairs = save(at_nodes(kind(told, "pairs"), nodes, gather_pairs), "pairs")
    scratch.drop(told, "kind=pairs")
    scratch.release()
    model["discount"] = discount(*_sums(kind(pairs, "counts"), 2))
    words = save(at_nodes(kind(named, "word").union(kind(pairs, "first")), nodes, first_totals), "words")
    *root, once, twice = _sums(kind(words, "word"), 4)
    model["parent_discount"] = discount(once, twice)
    asks, dishes = kind(words, "ask"), kind(pairs, "dish")

    roots = []
    for sweep in range(1, burn_in + samples + 1):
        keep = sweep > burn_in
        seated = save(at_nodes(dishes.union(kind(words, "totals")), nodes, seat_pairs(dict(model), tuple(root), sweep, keep)), "dishes")
        after = save(at_nodes(kind(words, "word").union(asks).union(kind(seated, "more")), nodes, seat_words(dict(model), tuple(root), sweep, keep)), "words")
        root = _sums(kind(after, "word"), 2)
        roots += [tuple(root)] * keep
        scratch.drop(dishes, "kind=dish")
        scratch.drop(seated, "kind=more")
        scratch.drop(words, "kind=word", "kind=totals")
        scratch.release()
        dishes, words = kind(seated, "dish"), after

    seen = at_nodes(dishes.union(kind(pairs, "place", "counts")), nodes, answer_chunks(samples))
    asked = kind(named, "named").select("kind", F.col("origin").alias("node"), F.col("node").alias("origin"), "parts", "stats")
    told_words = at_nodes(kind(words, "word").union(asked), nodes, send_samples)
    last = kind(told, "chunk").union(seen).union(told_words)
    scored = _spread(last, nodes).applyInArrow(_scores(dict(model), roots, nodes), SCORES)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["tokens"])).cast("long").alias("train_tokens"), "base_score", "score", perplexity
    )
