"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge can only be undone from the right by a chain of merges of rising rank, each taking away what the one
before it stood on. The merge list bounds the length of such a chain: that is the lookahead. A piece is read
symbol by symbol into a buffer; tokens that end at least the lookahead before the buffer's end are stable and
leave it, so the memory for a piece doesn't grow with its length.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sitescan.llm.common import map_column

#: Pieces that a task remembers in each of two generations.
REMEMBERED = 250_000
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


@dataclass
class Merges:
    """A vocabulary with its merge list, as tokenizer files hold it."""

    vocab: dict[str, int]
    ranks: dict[tuple[str, str], int]
    suffix: str
    specials: dict[str, int]
    pattern: str
    normalizers: list[str]
    lookahead: int

    @classmethod
    def load(cls, path: str) -> Merges:
        """Reads a tokenizer file whose pieces come from one pattern; other layouts are refused."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = {"NFC", "Lowercase", "Replace"}
        if (
            model["type"] != "BPE" or {s["type"] for s in steps} - known or level["type"] != "ByteLevel"
            or level["add_prefix_space"] or level["use_regex"] or not split["invert"] or spec["decoder"]
            or any(s["type"] == "Replace" and (s["pattern"], s["content"]) != ({"Regex": r"\s+"}, " ") for s in steps)
            or any(s["normalized"] or s["lstrip"] or s["rstrip"] or s["single_word"] for s in spec["added_tokens"])
            or model["unk_token"] or model["continuing_subword_prefix"] or model["ignore_merges"]
        ):
            raise ValueError("a tokenizer file of another kind")
        ranks, suffix = {tuple(m): i for i, m in enumerate(model["merges"])}, model["end_of_word_suffix"] or ""
        return cls(
            model["vocab"], ranks, suffix, {t["content"]: t["id"] for t in spec["added_tokens"]},
            split["pattern"]["Regex"], [s["type"] for s in steps], sufficient_lookahead(ranks, suffix),
        )


def sufficient_lookahead(ranks: dict[tuple[str, str], int], suffix: str = "") -> int:
    """Symbols behind a token after which nothing that follows can change it.

    Beyond the end of what is known anything may follow. A rule (x, y) moves the border of the certain part
    left by x if a y can begin at the border; after a rule (x', y') has moved it, that needs x' at the left
    edge of y and a later rank. The longest such chain, in symbols, is the answer.
    """
    parts: dict[str, tuple[str, str]] = {}
    size = lambda s: len(s) - len(suffix) if suffix and s.endswith(suffix) else len(s)
    chain: dict[str, int] = {}
    longest = 0
    for (x, y), _ in sorted(ranks.items(), key=lambda item: item[1]):
        if x + y in parts:
            raise ValueError(f"two rules make {x + y!r}")
        if any(size(s) > 1 and s not in parts for s in (x, y)):
            raise ValueError(f"the rule of {x + y!r} precedes those of its parts")
        parts[x + y] = (x, y)
        before, edge = 0, y
        while True:
            before = max(before, chain.get(edge, 0))
            if edge not in parts:
                break
            edge = parts[edge][0]
        chain[x] = max(chain.get(x, 0), size(x) + before)
        longest = max(longest, chain[x])
    return longest


class Encoder:
    """Text to ids. One instance a task; it remembers the pieces met lately."""

    def __init__(self, merges: Merges, remembered: int = REMEMBERED):
        self.merges, self.remembered = merges, remembered
        self.letters = byte_letters()
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        pattern = merges.pattern
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")).findall
        ascii_pattern = pattern.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]")
        ascii_pattern = ascii_pattern.replace(r"\p{L}\p{N}", "A-Za-z0-9").replace(r"\s", r"\t-\r\x20")
        self.ascii_pieces = re.compile(ascii_pattern).findall
        self.spaces = regex.compile(r"\p{White_Space}+")
        special = "|".join(map(re.escape, sorted(merges.specials, key=len, reverse=True)))
        self.specials = re.compile(f"({special})") if special else None

    def normalized(self, text: str) -> str:
        """Steps of the file in their order; lower case goes letter by letter, whatever stands beside it."""
        for step in self.merges.normalizers:
            if step == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()
            elif not text.isascii():
                text = self.spaces.sub(" ", text)
        return text

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        parts = [text]
        if self.specials and any(s in text for s in self.merges.specials):
            parts = self.specials.split(text)
        for part in parts:
            if part in self.merges.specials:
                ids.append(self.merges.specials[part])
                continue
            plain = self.normalized(part)
            young, extend = self.young, ids.extend
            for piece in (self.ascii_pieces if plain.isascii() else self.pieces)(plain):
                made = young.get(piece)
                if made is None:
                    made = self.fresh(piece)
                    young = self.young
                extend(made)
        return ids

    def fresh(self, piece: str) -> tuple[int, ...]:
        made = self.old.get(piece)
        if made is None:
            if len(piece) > 64:
                return tuple(self.stream(piece))
            # Shorter than the lookahead: the buffer would hold the whole piece.
            parts = [self.letters[b] for b in piece.encode()]
            parts[-1] += self.merges.suffix
            vocab = self.merges.vocab
            made = tuple([vocab[p] for p in self.merge(parts) if p in vocab])
        if len(self.young) >= self.remembered:
            self.old, self.young = self.young, {}
        self.young[piece] = made
        return made

    def symbols(self, piece: str) -> Iterator[str]:
        """Byte letters of a piece, the last with the suffix: known once the next byte, or the end, is seen."""
        held = None
        for byte in piece.encode():
            if held is not None:
                yield held
            held = self.letters[byte]
        if held is not None:
            yield held + self.merges.suffix

    def stream(self, piece: str) -> Iterator[int]:
        """Ids of a piece, given out as soon as nothing that follows can change them."""
        vocab, ahead = self.merges.vocab, self.merges.lookahead
        window, buffer = 2 * ahead + 64, []
        for symbol in self.symbols(piece):
            buffer.append(symbol)
            if len(buffer) > window:
                tokens, at, sure = self.merge(buffer), 0, 0
                for token in tokens:
                    end = at + self.length(token)
                    if end > len(buffer) - ahead:
                        break
                    at, sure = end, sure + 1
                    if token in vocab:
                        yield vocab[token]
                buffer = buffer[at:]
                if not sure:
                    window *= 2
        for token in self.merge(buffer):
            if token in vocab:
                yield vocab[token]

    def length(self, token: str) -> int:
        suffix = self.merges.suffix
        return len(token) - len(suffix) if suffix and token.endswith(suffix) else len(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges in rank order, the leftmost first, until no rule fits."""
        if len(symbols) > 48:
            return self.merge_long(symbols)
        parts, get = list(symbols), self.merges.ranks.get
        pairs = [get(p, _NONE) for p in zip(parts, parts[1:])]
        while pairs:
            rank = min(pairs)
            if rank == _NONE:
                break
            i = pairs.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((parts[i - 1], parts[i]), _NONE)
            if i < len(pairs):
                pairs[i] = get((parts[i], parts[i + 1]), _NONE)
        return parts

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over a linked list, for long windows."""
        ranks, parts = self.merges.ranks, list(symbols)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := ranks.get(p)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heappush(heap, (r, a))
        return [p for p in parts if p]


class Decoder:
    """Ids to text, a few at a time.

    ``tokens`` writes the vocabulary's own strings with one space between them, which is what the file's
    library does with a file that names no decoder. ``text`` turns byte letters back into bytes and bytes into
    characters; a character cut off by the end, or a byte out of place, becomes U+FFFD, and the end of a word a
    space. Ids outside the vocabulary are skipped.
    """

    def __init__(self, merges: Merges, mode: str = "tokens"):
        if mode not in ("tokens", "text"):
            raise ValueError(f"unknown mode {mode}")
        self.mode, self.suffix = mode, merges.suffix
        self.names = {i: t for t, i in merges.vocab.items()} | {i: t for t, i in merges.specials.items()}
        self.special = set(merges.specials.values())
        self.bytes = {letter: b for b, letter in enumerate(byte_letters())}
        self.reset()

    def reset(self) -> None:
        self.begun, self.pending = False, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.mode == "tokens":
            out = " ".join(map(self.names.__getitem__, (i for i in ids if i in self.names)))
            out = " " + out if self.begun and out else out
            self.begun = self.begun or bool(out)
            return out
        out = []
        for i in ids:
            name = self.names.get(i)
            if name is None:
                continue
            if i in self.special:
                out.append(self.pending.decode(b"", True) + name)
                self.pending.reset()
                continue
            ends = bool(self.suffix) and name.endswith(self.suffix)
            out.append(self.pending.decode(bytes(self.bytes[c] for c in (name[:-len(self.suffix)] if ends else name))))
            if ends:
                out.append(self.pending.decode(b"", True) + " ")
                self.pending.reset()
        return "".join(out)

    def end(self) -> str:
        """What is left when no more ids come; the machine is then as new."""
        out = self.pending.decode(b"", True) if self.mode == "text" else ""
        self.reset()
        return out


def encode_texts(
    docs: DataFrame, path: str, text: str = "text", mode: str | None = "tokens", remembered: int = REMEMBERED,
) -> DataFrame:
    """Every row of ``docs`` with ``ids`` and, unless ``mode`` is None, ``decoded`` added.

    The file is read on the driver and sent to the tasks. A missing text counts as empty: no ids, empty
    decoded text. Texts are encoded whole. Rows that repeat are encoded alike; names that clash with columns
    of ``docs`` get a trailing underscore.
    """
    # Plain values: tasks need no module of this package to read them.
    shared = docs.sparkSession.sparkContext.broadcast(vars(Merges.load(path)))

    def kernel():
        merges = Merges(**shared.value)
        encoder = Encoder(merges, remembered)
        decoder = Decoder(merges, mode) if mode else None

        def work(texts: pa.Array) -> dict:
            rows = [encoder.encode(t) if t else [] for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.fromiter((i for row in rows for i in row), np.int32, int(ends[-1]))
            made: dict = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
            if decoder:
                made["decoded"] = [decoder.feed(row) + decoder.end() for row in rows]
            return made

        return work

    return map_column(docs, text, kernel, "ids array<int>" + (", decoded string" if mode else ""))
