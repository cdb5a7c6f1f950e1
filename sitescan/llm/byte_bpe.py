"""Byte-level BPE in two tiers, and its decoding.

The first tier resolves whole pre-tokens that are in the vocabulary: a minimal perfect hash gives each vocabulary
entry a slot of its own in tables without gaps, and a pre-token is known if the bytes of its slot are its own.
All pre-tokens of a run of text are hashed, looked up and compared together, as arrays. The second tier merges
the bytes of the others: a heap of adjacent pairs by rank over linked bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sitescan.llm.common import map_column

#: Pre-tokens of at most so many bytes that a task remembers in each of two generations.
REMEMBERED, REMEMBERED_BYTES = 131_072, 64
#: Pre-tokens looked up together, and characters after which a long text is cut at the next sure boundary.
RUN, CUT = 65_536, 1 << 17
_START = (1 << 40) - 1
_BASE, _ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def piece_hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece of ``data``; ``inside`` is the place of a byte in its piece."""
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(inside, len(powers) - 1)]
    return mixed(np.add.reduceat(terms, starts))


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each of the consecutive pieces with these sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each hash): every slot 0..n-1 is taken once.

    Buckets are placed from the fullest on; each tries displacements until all its keys fall on free slots of
    their own. Buckets of one key take the slots that are left, written as -1 - slot.
    """
    n = len(hashes)
    bucket = bucket_of(hashes, n // 3 + 1)
    moves, taken = np.zeros(n // 3 + 1, np.int64), np.zeros(n, bool)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    groups.sort(key=len, reverse=True)
    for group in groups:
        if len(group) == 1:
            break
        first = 1
        while True:
            tries = np.arange(first, first + 256)
            slots = np.sort(slot_of(hashes[group][None, :], tries[:, None], n), axis=1)
            good = ~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
            if good.any():
                break
            first += 256
        won = int(np.argmax(good))
        moves[bucket[group[0]]] = tries[won]
        taken[slots[won]] = True
    alone = np.array([g[0] for g in groups if len(g) == 1], dtype=np.int64)
    moves[bucket[alone]] = -1 - np.flatnonzero(~taken)[: len(alone)]
    return moves, find_slots(hashes, moves, n)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def slot_of(hashes: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    return (mixed(hashes ^ (move.astype(np.uint64) * _ODD)) % np.uint64(n)).astype(np.int64)


def find_slots(hashes: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    move = moves[bucket_of(hashes, len(moves))]
    return np.where(move < 0, -1 - move, slot_of(hashes, move, n))


@dataclass
class Vocabulary:
    """Tables of a rank file. Entry ``i`` of the slot tables belongs to the vocabulary entry hashed there."""

    ranks: dict[bytes, int]
    moves: np.ndarray
    slot_hash: np.ndarray
    slot_id: np.ndarray
    #: Bytes of all tokens, and for each id where its bytes start and how many there are.
    bytes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    powers: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads lines of a token in base 64 and its rank, the id; ids need not be dense."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        if any(bytes([b]) not in ranks for b in range(256)) or len(set(ranks.values())) < len(ranks):
            raise ValueError("a rank file names every byte, and each rank once")
        tokens, ids = list(ranks), np.array(list(ranks.values()))
        size = np.array([len(t) for t in tokens])
        data = np.frombuffer(b"".join(tokens), np.uint8)
        at = np.cumsum(size) - size
        powers = np.cumprod(np.full(int(size.max()), _BASE))
        hashes = piece_hashes(data, at, places(size), powers)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two tokens with the same hash")
        moves, slot = perfect_hash(hashes)
        starts, sizes = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(int(ids.max()) + 1, np.int64)
        starts[ids], sizes[ids] = at, size
        slot_hash, slot_id = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int32)
        slot_hash[slot], slot_id[slot] = hashes, ids
        return cls(ranks, moves, slot_hash, slot_id, data, starts, sizes, powers)

    def whole(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """First tier: the id of each piece that is an entry, -1 for the others."""
        starts, inside = np.cumsum(sizes) - sizes, places(sizes)
        hashes = piece_hashes(data, starts, inside, self.powers)
        slot = find_slots(hashes, self.moves, len(self.slot_id))
        ids = self.slot_id[slot]
        near = (self.slot_hash[slot] == hashes) & (self.sizes[ids] == sizes)
        # Equal hashes are not enough: the bytes decide.
        at = np.minimum(np.repeat(self.starts[ids], sizes) + inside, len(self.bytes) - 1)
        wrong = np.add.reduceat((self.bytes[at] != data).astype(np.int32), starts)
        return np.where(near & (wrong == 0), ids, -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens; ids that the file doesn't have are skipped."""
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        return self.bytes[np.repeat(self.starts[ids], sizes) + places(sizes)]


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """Rank of each pair of bytes, at 256 * first + second; -1 where there is none."""
    return [ranks.get(bytes(divmod(i, 256)), -1) for i in range(1 << 16)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Second tier: the pair of lowest rank is merged, the leftmost of equal ones, until no pair is an entry.

    Parts are linked by where the next and the previous one start. A heap entry holds the rank and the start of a
    pair; it is stale unless it is still the entry of the pair that starts there.
    """
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [r << 40 | i if (r := pairs[a << 8 | b]) >= 0 else -1 for i, (a, b) in enumerate(zip(piece, piece[1:]))]
    heap = [entry for entry in pair if entry >= 0]
    pair.append(-1)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & _START
        if pair[i] != entry:
            continue
        gone = after[i]
        follow = after[gone]
        after[i], pair[gone], pair[i] = follow, -1, -1
        if follow < n:
            before[follow] = i
            rank = get(piece[i:after[follow]])
            if rank is not None:
                pair[i] = entry = rank << 40 | i
                heappush(heap, entry)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:follow])
            pair[left] = -1
            if rank is not None:
                pair[left] = entry = rank << 40 | left
                heappush(heap, entry)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


def ascii_only(pattern: str) -> str | None:
    """The pattern for ASCII text without property names; None if one has no plain ASCII form here."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            letters = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r\x20"}[part]
            out.append(letters if inside else f"[{letters}]")
        elif part == r"\S":
            if inside:
                return None
            out.append(r"[^\t-\r\x20]")
        elif part.startswith((r"\p", r"\P", r"\w", r"\W", r"\d", r"\D", r"\b", r"\B", r"\X", r"\h")):
            return None
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


class Encoder:
    """Texts to ids. One instance a task; it remembers the merged pre-tokens met lately."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, run: int = RUN, cut: int = CUT):
        self.vocabulary, self.run, self.cut, self.pairs = vocabulary, run, cut, byte_pairs(vocabulary.ranks)
        wide = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(wide, regex.V0).findall
        plain = ascii_only(pattern)
        self.ascii_pieces = re.compile(plain).findall if plain else self.pieces
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cuts(self, text: str) -> Iterator[str]:
        """The text in parts: a part ends after a letter or digit before a blank, where no pre-token goes on."""
        start = 0
        while len(text) - start > self.cut:
            found = _BORDER.search(text, start + self.cut)
            if not found:
                break
            yield text[start:found.start() + 1]
            start = found.start() + 1
        yield text[start:] if start else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids end, after a 0)."""
        made, counts, ends, total, held = [], [], [0], 0, []
        for text in texts:
            for part in self.cuts(text or ""):
                held += (self.ascii_pieces if part.isascii() else self.pieces)(part)
                if len(held) >= self.run:
                    total += len(held)
                    self.flush(held, made, counts)
                    held = []
            ends.append(total + len(held))
        self.flush(held, made, counts)
        passed = np.concatenate([[0], *counts]).cumsum()
        return np.concatenate([np.zeros(0, np.int32), *made]), passed[ends]

    def flush(self, pieces: list[str], made: list, counts: list) -> None:
        if not pieces:
            return
        data = "".join(pieces).encode()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if len(data) > sizes.sum():
            sizes = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        ids = self.vocabulary.whole(np.frombuffer(data, np.uint8), sizes)
        missed = np.flatnonzero(ids < 0)
        count = np.ones(len(pieces), np.int64)
        if len(missed):
            others = [pieces[i] for i in missed.tolist()]
            rows = [found or self.merged(p) for p, found in zip(others, map(self.young.get, others))]
            count[missed] = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            out = np.empty(int(count.sum()), np.int32)
            at = count.cumsum() - count
            whole = ids >= 0
            out[at[whole]] = ids[whole]
            out[np.repeat(at[missed], count[missed]) + places(count[missed])] = np.frombuffer(b"".join(rows), np.int32)
            ids = out
        made.append(ids.astype(np.int32))
        counts.append(count)

    def merged(self, piece: str) -> bytes:
        """Packed ids of a pre-token that is no entry."""
        found = self.young.get(piece) or self.old.get(piece)
        if found is None:
            data = piece.encode()
            found = array("i", merge_bytes(data, self.vocabulary.ranks, self.pairs)).tobytes()
            if len(data) > REMEMBERED_BYTES:
                return found
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found


_BORDER = re.compile(r"[A-Za-z0-9](?=[ \n])")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: row i lies between the ends i and i + 1."""
    if int(ends[-1]) >= 1 << 31:
        raise ValueError("more than 2 GB in one row")
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    )


def _decoded(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    known = (ids >= 0) & (ids < len(vocabulary.sizes))
    sizes = np.where(known, vocabulary.sizes[np.where(known, ids, 0)], 0)
    passed = np.concatenate([[0], sizes.cumsum()])[ends]
    parts = [vocabulary.decode(ids[a:a + (1 << 18)]) for a in range(0, len(ids), 1 << 18)]
    return _binary(np.concatenate([np.zeros(0, np.uint8), *parts]), passed)


def _shared(df: DataFrame, path: str) -> Callable[[], Vocabulary]:
    # Plain values: tasks need no module of this package to read them.
    sent = df.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(path)))
    return lambda: Vocabulary(**sent.value)


def encode_bytes(
    docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, packed: bool = False,
    decode: bool = True,
) -> DataFrame:
    """The ``keep`` columns of every row (all by default) with ``ids``, ``n_tokens`` and ``decoded`` added.

    ``path`` is a file of tokens in base 64 and ranks, read on the driver and sent to the tasks (its size is the
    vocabulary's); ``pattern`` splits a text into pre-tokens, each encoded by itself. ``ids`` is ``array<int>``,
    or with ``packed`` a binary of little-endian unsigned 32-bit integers. ``decoded``, the bytes that the ids
    stand for, is made from the ids and equals the text in UTF-8 wherever the pattern covers it.

    A missing text counts as empty: no ids, no bytes. Texts are encoded whole, very long ones in runs cut where
    no pre-token goes on. Repeated rows are encoded alike, an empty table keeps its columns, and names that
    clash with kept columns get a trailing underscore.
    """
    load = _shared(docs, path)

    def kernel():
        vocabulary = load()
        encoder = Encoder(vocabulary, pattern)

        def work(texts: pa.Array) -> dict:
            ids, ends = encoder.encode(texts.to_pylist())
            made = {"n_tokens": np.diff(ends)}
            if packed:
                made["ids"] = _binary(ids.astype("<u4").view(np.uint8), ends * 4)
            else:
                made["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            if decode:
                made["decoded"] = _decoded(vocabulary, ids, ends)
            return made

        return work

    schema = f"ids {'binary' if packed else 'array<int>'}, n_tokens bigint" + (", decoded binary" if decode else "")
    return map_column(docs, text, kernel, schema, keep)


def decode_bytes(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row (all by default) with ``decoded``: the bytes of its packed ``ids``.

    Missing ids count as none; ids that the file doesn't have are skipped.
    """
    load = _shared(df, path)

    def kernel():
        vocabulary = load()

        def work(rows: pa.Array) -> dict:
            rows = [np.frombuffer(r or b"", "<u4").astype(np.int64) for r in rows.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)
            return {"decoded": _decoded(vocabulary, np.concatenate([np.zeros(0, np.int64), *rows]), ends)}

        return work

    return map_column(df, ids, kernel, "decoded binary", keep)
