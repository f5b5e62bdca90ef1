"""Byte-level BPE by a segment tree.

A piece (one match of the splitting pattern) starts as its bytes. The leaves of a segment tree
stand for byte positions; the leaf of a live part holds the rank of the pair it forms with the next
live part, and every inner node the smaller of its two children. The root is the next merge, and going down by
equal values, left first, finds its leftmost place. A merge changes three leaves (the part, the
one it swallows, and its predecessor), each with a logarithmic walk up.

Pieces of up to 64 bytes are merged many at a time, one tree per row of a matrix; longer ones one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prumo.llm.common import once_per_worker

NONE = np.int32(2**30)  # rank of a pair that is not in the vocabulary
WIDEST = 64  # bytes of the longest piece merged in a matrix
ROWS = 8_192  # pieces per matrix
REMEMBERED = 400_000  # pieces whose ids a worker keeps


class Vocabulary:
    """Ranks by bytes; the id of a token is its rank, so the rank of a pair is the id of the merge."""

    def __init__(self, blob: bytes):
        pairs = [line.split() for line in blob.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        merges = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = rank
        self.pair_rank = merges
        self.keys = np.array(sorted(merges), dtype=np.int64)
        self.values = np.array([merges[int(k)] for k in self.keys], dtype=np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        if not len(self.keys):
            return np.full(wanted.shape, NONE)
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.values[place], NONE)


def merge_one(vocabulary: Vocabulary, piece: bytes) -> tuple[int, ...]:
    """The ids of one piece of any length."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    ids = vocabulary.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, rank = int(NONE), vocabulary.pair_rank.get
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = rank(ids[i] << 32 | ids[i + 1], none)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < none:
        node = 1
        while node < width:
            node = 2 * node if tree[2 * node] == tree[node] else 2 * node + 1
        i = node - width
        gone = after[i]
        ids[i], ids[gone], after[i] = tree[1], -1, after[gone]
        put(gone, none)
        if after[i] < n:
            before[after[i]] = i
            put(i, rank(ids[i] << 32 | ids[after[i]], none))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], rank(ids[before[i]] << 32 | ids[i], none))
    return tuple(x for x in ids if x >= 0)


def merge_many(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
    """The ids of many pieces of at most `width` (a power of two) bytes, one tree per row."""
    count = len(pieces)
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
    at = np.arange(width)
    live = at < length[:, None]
    ids = np.zeros((count, width), dtype=np.int64)
    ids[live] = vocabulary.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.broadcast_to(at + 1, (count, width)).astype(np.int32)
    before = np.broadcast_to(at - 1, (count, width)).astype(np.int32)
    tree = np.full((count, 2 * width), NONE, dtype=np.int32)
    tree[:, width : 2 * width - 1] = np.where(live[:, 1:], vocabulary.rank_of(ids[:, :-1], ids[:, 1:]), NONE)
    half = width
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = width + leaf
        tree[rows, node] = value
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return vocabulary.rank_of(ids[rows, left], ids[rows, right])

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        node = np.ones(len(rows), dtype=np.int64)
        least = tree[rows, 1]
        while node[0] < width:  # all rows are at one depth
            node = 2 * node + (tree[rows, 2 * node] != least)
        i = node - width
        gone = after[rows, i].astype(np.int64)
        then = after[rows, gone].astype(np.int64)
        ids[rows, i], after[rows, i], live[rows, gone] = least, then, False
        put(rows, gone, NONE)
        has_next = then < length[rows]
        before[rows[has_next], then[has_next]] = i[has_next]
        put(rows, i, np.where(has_next, pair(rows, i, np.minimum(then, width - 1)), NONE))
        prior = before[rows, i].astype(np.int64)
        has_prior = prior >= 0
        some, prior, i = rows[has_prior], prior[has_prior], i[has_prior]
        put(some, prior, pair(some, prior, i))
        rows = rows[tree[rows, 1] < NONE]
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts, remembering the ids of pieces seen: `known` numbers the pieces, whose ids lie in `flat`."""

    def __init__(self, blob: bytes, pattern: str):
        self.vocabulary = Vocabulary(blob)
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.flat = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32))

    def ids_of(self, pieces: list[str]) -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        """Pieces with their ids, in groups of one width."""
        whole: tuple[list, list] = [], []
        widths: dict[int, tuple[list, list]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.vocabulary.ranks.get(raw)
            if rank is not None:  # a piece that is a token stays whole
                names, ids = whole
                ids.append((rank,))
            elif len(raw) > WIDEST:
                names, ids = whole
                ids.append(merge_one(self.vocabulary, raw))
            else:
                names, ids = widths.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), ([], []))
                ids.append(raw)
            names.append(piece)
        yield whole
        for width, (names, raws) in widths.items():
            for at in range(0, len(names), ROWS):
                yield names[at : at + ROWS], merge_many(self.vocabulary, raws[at : at + ROWS], width)

    def learn(self, pieces: list[str]) -> None:
        sizes, flat = [self.size], [self.flat]
        for names, ids in self.ids_of(pieces):
            self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
            sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.int32))
        self.size, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str | None]) -> pa.Array:
        found = [self.split(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn([p for p in set(chain.from_iterable(found)) if p not in self.known])
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        pieces = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        size = self.size[pieces]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[pieces] - ends[:-1], size) + np.arange(ends[-1])]
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    def decode(self, lists: pa.Array) -> pa.Array:
        token = self.vocabulary.tokens.__getitem__
        ids, ends = lists.values.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
        return pa.array([b"".join(map(token, ids[a:b])) for a, b in zip(ends, ends[1:])], pa.binary())


class ByteBPE:
    """Column functions that encode and decode by the rank file at `path` (base64 token and rank per line).

    The file is read on the driver and sent to the tasks: a vocabulary, bounded by its file. Each match
    of `pattern` is merged on its own; there are no special tokens.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.shared = spark.sparkContext.broadcast(file.read())
        self.pattern, self.tag = pattern, uuid4().hex

    def encode(self, text: Column) -> Column:
        """array<int> of ids. A null or empty text gives an empty array; equal texts give equal ids; a text
        without a match of the pattern gives none. A text is held whole by one task, whatever its length."""
        shared, pattern, tag = self.shared, self.pattern, self.tag

        @F.arrow_udf("array<int>")
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = once_per_worker(tag, lambda: Encoder(shared.value, pattern))
            for texts in batches:
                yield encoder.encode(texts.to_pylist())

        return encoded(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids. Null or empty ids give no bytes; an id outside the vocabulary is an error."""
        shared, pattern, tag = self.shared, self.pattern, self.tag

        @F.arrow_udf("binary")
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = once_per_worker(tag, lambda: Encoder(shared.value, pattern))
            for lists in batches:
                yield encoder.decode(lists)

        return decoded(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids: array<int>, bytes: binary>: the ids of a text as `encode` gives them, and what `decode` makes of those ids.

        Both in one worker, which holds the vocabulary once.
        """
        shared, pattern, tag = self.shared, self.pattern, self.tag

        @F.arrow_udf("struct<ids: array<int>, bytes: binary>")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = once_per_worker(tag, lambda: Encoder(shared.value, pattern))
            for texts in batches:
                ids = encoder.encode(texts.to_pylist())
                yield pa.StructArray.from_arrays([ids, encoder.decode(ids)], ["ids", "bytes"])

        # Not to be worked out once for each of its fields.
        return both.asNondeterministic()(text)
