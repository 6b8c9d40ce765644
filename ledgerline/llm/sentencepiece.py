"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words: runs of the space symbol with what follows, and line ends
apart.  No piece of the vocabulary crosses such a border (checked when the model is loaded),
so every word is encoded on its own and a word met before is looked up.  New
words of a batch are encoded together in flat numpy symbol arrays.  Each round
finds, segment by segment, the smallest pair rank of every word, merges that
pair wherever it occurs from the left without overlap, and compacts the arrays,
until no word has a pair left.  Taking all occurrences at once equals the
one-at-a-time order only if no piece outranks or ties a part of it; for the few
parts where one does, a round merges the leftmost occurrence alone.

A word of more than ``LONG`` characters has no border that would end its rounds
soon, as in a run of blanks or a text without spaces, where each round would go
over the whole word again.  Such a word is merged with a heap of its pairs, by
the same ranks, in time that grows with its length; both ways give the same ids.

Symbols that are no piece fall back to byte pieces, or to the unknown id.
Identity-normalised BPE models are supported; others raise ValueError.

Defined results: a null text is an empty one; an empty text has no ids and
decodes to an empty text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SPACE = "▁"
_WORDS = re.compile(f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
NEVER = np.int32(2**31 - 1)
LONG = 512


@dataclass
class Vocabulary:
    """What a model file says: pieces, scores and kinds by id; small and fixed in size."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte, control or unknown
    dummy_prefix: bool
    unk_surface: str


def load_vocabulary(model_path: str) -> Vocabulary:
    """Reads a model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or any(p.type not in kinds for p in model.pieces):
        raise ValueError("only BPE models without user-defined or unused pieces are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only identity-normalised models that keep white space are supported")
    return Vocabulary(
        [p.piece for p in model.pieces],
        [p.score for p in model.pieces],
        [kinds[p.type] for p in model.pieces],
        norm.add_dummy_prefix,
        model.trainer_spec.unk_surface,
    )


class Codec:
    """Merge tables built from a vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = 300_000) -> None:
        v = vocabulary
        self.vocabulary, self.cache_words = v, cache_words
        self.cache: dict[str, bytes] = {}
        self.by_pair: dict[int, tuple[int, int]] | None = None
        normal = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == "normal"}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("a piece crosses a word border")
        n = self.count = len(v.pieces)
        # symbols: pieces by id, then any other character by its code point
        symbol = lambda part: normal.get(part, n + ord(part) if len(part) == 1 else None)
        self.width = n + 0x110000
        self.by_char = np.arange(n, self.width, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.by_char[ord(p)] = i
        by_score = sorted({v.scores[i] for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(by_score)}
        rank = {p: rank_of[v.scores[i]] for p, i in normal.items()}
        rows = []
        # ranks to be merged one at a time: those that several pieces share, and
        # those of a part that some larger piece outranks or ties
        self.alone = np.bincount(list(rank.values()), minlength=len(by_score)) > 1
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is None or right is None:
                    continue
                rows.append((left * self.width + right, rank[p], i))
                for part in (p[:k], p[k:]):
                    if len(part) > 1 and rank[p] <= rank[part]:
                        self.alone[rank[part]] = True
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.bytes = {int(v.pieces[i][3:5], 16): i for i in range(n) if v.kinds[i] == "byte"}
        self.unknown = v.kinds.index("unknown") if "unknown" in v.kinds else 0
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else v.unk_surface.encode() if k == "unknown" else p.replace(SPACE, " ").encode()
            for p, k in zip(v.pieces, v.kinds)
        ]
        self.is_control = np.array([k == "control" for k in v.kinds], dtype=bool)

    # encoding

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> None:
        """Sets rank and product of the symbols at ``at`` with their right neighbours."""
        at = at[(at >= 0) & (at < len(symbols))]
        rank[at] = NEVER
        at = at[at < len(symbols) - 1]
        at = at[word[at] == word[at + 1]]
        key = symbols[at].astype(np.int64) * self.width + symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[found] == key
        rank[at[hit]] = self.ranks[found[hit]]
        made[at[hit]] = self.made[found[hit]]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word (non-empty, in space symbols) as int32 bytes, all words at once."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if long:
            out = [b""] * len(words)
            short = [k for k, w in enumerate(words) if len(w) <= LONG]
            for k, ids in zip(short, self.merge([words[k] for k in short])):
                out[k] = ids
            for k in long:
                out[k] = self._merge_long(words[k])
            return out
        if not words:
            return []
        symbols = self.by_char[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.empty_like(symbols), np.zeros_like(symbols)
        self._pairs(symbols, word, rank, made, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            per = np.repeat(best, np.diff(np.r_[first, len(word)]))
            if best.max() == NEVER:  # words without a pair are finished
                live = per < NEVER
                done.append((word[~live], symbols[~live]))
                symbols, word, rank, made, per = (a[live] for a in (symbols, word, rank, made, per))
                if not len(symbols):
                    break
            where = np.flatnonzero(rank == per)
            # pairs that overlap (a run of one symbol): every other one from the left
            begin = np.r_[True, np.diff(where) != 1]
            if not begin.all():
                run = np.cumsum(begin) - 1
                where = where[(where - where[begin][run]) % 2 == 0]
            only = self.alone[rank[where]]
            if only.any():
                leftmost = np.r_[True, word[where][1:] != word[where][:-1]]
                where = where[~only | leftmost]
            symbols[where] = made[where]
            keep = np.ones(len(symbols), dtype=bool)
            keep[where + 1] = False
            place = where - np.arange(len(where))
            symbols, word, rank, made = (a[keep] for a in (symbols, word, rank, made))
            self._pairs(symbols, word, rank, made, np.r_[place - 1, place])
        word, symbols = (np.concatenate(a) for a in zip(*done))
        order = np.argsort(word, kind="stable")
        word, symbols = word[order], symbols[order]
        bounds = np.r_[0, 4 * np.searchsorted(word, np.arange(len(words)), side="right")].tolist()
        raw = symbols.tobytes()
        out = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        for w in np.unique(word[symbols >= self.count]).tolist():
            own = symbols[bounds[w] // 4 : bounds[w + 1] // 4].tolist()
            out[w] = np.array([i for s in own for i in ([s] if s < self.count else self._fallback(s))], dtype=np.int32).tobytes()
        return out

    def _merge_long(self, word: str) -> bytes:
        """``merge`` of one word: pairs leave a heap by rank, then from the left; a pair that has changed since is passed over."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        by_pair, width = self.by_pair, self.width
        symbols = self.by_char[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)].tolist()
        n = len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = by_pair.get(symbols[i] * width + symbols[i + 1])
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = following[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = by_pair[left * width + right][1], -1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                found = by_pair.get(symbols[i] * width + symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                found = by_pair.get(symbols[h] * width + symbols[i])
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], symbols[i]))
        ids = [x for s in symbols if s >= 0 for x in ([s] if s < self.count else self._fallback(s))]
        return np.array(ids, dtype=np.int32).tobytes()

    def _fallback(self, symbol: int) -> list[int]:
        raw = chr(symbol - self.count).encode()
        return [self.bytes[x] for x in raw] if all(x in self.bytes for x in raw) else [self.unknown]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as int32; unknown symbols side by side stay one id each."""
        prefix = SPACE if self.vocabulary.dummy_prefix else ""
        split = [_WORDS.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        cache = self.cache
        new = list({w for words in split for w in words if w not in cache})
        once: dict[str, bytes] = {}  # long words are not kept
        for a, b in _slices(new, 1 << 18):
            for w, ids in zip(new[a:b], self.merge(new[a:b])):
                (once if len(w) > LONG else cache)[w] = ids
        known = lambda w: once[w] if w in once else cache[w]
        return [np.frombuffer(b"".join(map(known if once else cache.__getitem__, words)), dtype=np.int32) for words in split]

    # decoding

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: bytes are read as UTF-8 with a replacement for each bad one."""
        ids = np.asarray(ids, dtype=np.int32)
        cut = np.flatnonzero(self.is_control[ids])  # control ids end a run of bytes
        parts = [p.tolist() for p in np.split(ids, cut)] if len(cut) else [ids.tolist()]
        surface = self.surface
        raws = [b"".join([surface[i] for i in p]) for p in parts]
        if self.vocabulary.dummy_prefix:
            # the first piece with a surface gives up one leading space symbol
            for k, part in enumerate(parts):
                lead = next((i for i in part if surface[i]), None)
                if lead is not None:
                    if self.vocabulary.kinds[lead] == "normal" and self.vocabulary.pieces[lead].startswith(SPACE):
                        raws[k] = raws[k][1:]
                    break
        return "".join(map(_decode, raws))


def _decode(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _decode_each(raw)


def _slices(words: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of words with about ``most`` characters, so that the arrays stay small."""
    a = total = 0
    for b, w in enumerate(words):
        total += len(w)
        if total >= most:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(words):
        yield a, len(words)


def _decode_each(raw: bytes) -> str:
    """UTF-8 with one replacement character for every byte that starts no whole character."""
    out, i = [], 0
    while i < len(raw):
        lead = raw[i]
        n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            out.append(raw[i : i + n].decode() if n else "�")
            i += max(n, 1)
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


_codec: tuple[int, Codec] | None = None


def _worker_codec(shared) -> Codec:
    """One codec per Python worker and model."""
    global _codec
    if _codec is None or _codec[0] != shared.value[0]:
        _codec = (shared.value[0], Codec(shared.value[1]))
    return _codec[1]


def _pieces_of(batch: pa.RecordBatch, name: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, long texts alone."""
    at = batch.schema.get_field_index(name)
    column = batch.column(at)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


def encode_decode(spark: SparkSession, documents: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(key, ids array<int>, decoded string) of every row, with the text if asked; map-only, nothing is shuffled."""
    vocabulary = load_vocabulary(model_path)
    shared = spark.sparkContext.broadcast((hash((model_path, len(vocabulary.pieces))), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(shared)
        for whole in batches:
            for batch in _pieces_of(whole, "__text"):
                ids = codec.encode(batch.column(1).to_pylist())
                lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
                flat = np.concatenate([np.empty(0, dtype=np.int32), *ids])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))
                decoded = pa.array([codec.decode(x) for x in ids], type=pa.string())
                kept = [pc.fill_null(batch.column(1), "")] if keep_text else []
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded, *kept], names=schema.names)

    rows = documents.select(F.col(key), F.col(text).alias("__text"))
    fields = [rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields + [T.StructField("text", T.StringType())] * keep_text)
    return rows.mapInArrow(run, schema)
