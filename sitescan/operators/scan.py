"""Word and motif scans over a chunk table.

Every chunk is scanned once, however many sites cover it; the hits are then matched to the sites with
``hits_in_slices``. A window's score does not depend on the site around it, so the hits inside a site are
exactly the contig's hits that lie wholly inside its slice.

Arrow batches go to numpy: one vector operation covers all bases of a batch, and all words of one length are
looked up at once by the number their bases make. The native path explodes windows in the JVM; it is the
cross-check.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.defaults import SCORE_MULT
from sitescan.functions import reverse_complement
from sitescan.operators.motifs import BASES, PANEL_CELLS, Motif, make_motif, motif_rows
from sitescan.operators.sequences import check_window, chunk_layout, kmers

HIT_SCHEMA = (
    "chr_n string, start bigint, hit_len int, seq string, source string, strand string, "
    "hit_ord int, tf_name string, score_pssm double"
)
_ARROW = pa.schema([
    ("chr_n", pa.string()), ("start", pa.int64()), ("hit_len", pa.int32()), ("seq", pa.string()),
    ("source", pa.string()), ("strand", pa.string()), ("hit_ord", pa.int32()), ("tf_name", pa.string()),
    ("score_pssm", pa.float64()),
])

_SLICE_BYTES = 1 << 20
_SEEDS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16)  # letters a word is looked up by
_BITS = 20
_PACK = 6  # bases per lookup table: 4**6 doubles stay in the first-level cache

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a"):ord("z") + 1] -= 32


class _Bases:
    """The bases of a few chunks laid end to end, with what a window needs to know about its chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, owned: np.ndarray):
        self.data, self.offsets, self.owned = data, offsets, owned
        self.codes = _CODE[data]
        self.packed: dict = {}

    def padded_packs(self, k: int) -> np.ndarray:
        """Base-4 number of the k bases from each position; other letters, and all past the end, count as A here."""
        if k not in self.packed:
            digits = np.append(np.where(self.codes > 3, 0, self.codes), np.zeros(k - 1)).astype(np.int16)
            n = len(self.codes)
            number = digits[:n].copy()
            for j in range(1, k):
                number *= 4
                number += digits[j:j + n]
            self.packed[k] = number
        return self.packed[k]

    def letters(self, k: int) -> np.ndarray:
        """The k (at most 8) upper-case letters from each position as one number, whatever letters they are."""
        if ("letters", k) not in self.packed:
            made = _UPPER[self.data].astype(np.uint64)
            n = len(made) - k + 1
            if k > 1:
                half = k // 2
                left, right = self.letters(k - half), self.letters(half)
                made = (left[:n] << np.uint64(8 * half)) | right[k - half:k - half + n]
            self.packed["letters", k] = made
        return self.packed["letters", k]

    def seeds(self, k: int) -> np.ndarray:
        """A number of the k letters from each position: the letters themselves up to 8, a mix of them beyond."""
        if k <= 8:
            return self.letters(k)
        n = len(self.data) - k + 1
        return _mix(self.letters(8)[:n], self.letters(8)[k - 8:k - 8 + n])

    def inside(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which windows start in a chunk's own part and end within its bases, and the chunks of those."""
        row = np.searchsorted(self.offsets, at, side="right") - 1
        ok = (at - self.offsets[row] < self.owned[row]) & (at + length <= self.offsets[row + 1])
        return ok, row[ok]

    def text(self, at: np.ndarray, length: int, upper: bool) -> pa.Array:
        letters = self.data[at[:, None] + np.arange(length)]
        if upper:
            letters = _UPPER[letters]
        ends = np.arange(len(at) + 1, dtype=np.int32) * length
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters)))


def _pack_scores(weights: np.ndarray) -> np.ndarray:
    """Score of every run of ``_PACK`` bases under up to as many positions; bases beyond them count nothing."""
    rows = [*weights, *np.zeros((_PACK - len(weights), 4))]
    return reduce(lambda acc, w: (acc[:, None] + w[None, :]).ravel(), rows[1:], rows[0])


def _slack(cutoff: float, single: bool) -> float:
    """What sums in another order, or of single precision, may lack of the cutoff."""
    return (1e-4 if single else 1e-9) * max(1.0, abs(cutoff))


class Lanes:
    """The windows of up to 64 motifs and strands, proposed together.

    A window can only reach a cutoff if each of its packs of bases, with the best that all other positions can
    give, reaches it. For every pack of bases a number says by its bits for which lanes that holds; the numbers
    of a window's packs are ANDed, and what is left proposes it to the lanes of its bits. Sums may differ from
    the exact score in the last bit and other letters count as A, so a proposed window is scored again.
    """

    def __init__(self, lanes: list[tuple[np.ndarray, float]], single: bool):
        packs = max(-(-len(w) // _PACK) for w, _ in lanes)
        self.masks = np.zeros((packs, 4 ** _PACK), np.uint64)
        for bit, (weights, cutoff) in enumerate(lanes):
            best = weights.max(axis=1)
            limit = cutoff - _slack(cutoff, single)
            for k in range(packs):
                part = weights[k * _PACK:(k + 1) * _PACK]
                others = best[:k * _PACK].sum() + best[(k + 1) * _PACK:].sum()
                good = _pack_scores(part) + others >= limit if len(part) else np.ones(4 ** _PACK, bool)
                self.masks[k] |= good.astype(np.uint64) << np.uint64(bit)

    def propose(self, bases: _Bases) -> tuple[np.ndarray, np.ndarray]:
        """(positions, lanes) of the windows left, by lane and position."""
        codes = bases.padded_packs(_PACK)
        left = self.masks[0][codes]
        at = np.flatnonzero(left)
        left = left[at]
        for k in range(1, len(self.masks)):
            # Beyond the end any code does: such windows don't lie inside a chunk.
            left &= self.masks[k][codes[np.minimum(at + k * _PACK, len(codes) - 1)]]
            some = left != 0
            at, left = at[some], left[some]
        bits = np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lane, place = np.nonzero(bits.T)
        return at[place], lane


def _scored(bases: _Bases, at: np.ndarray, motif_weights: np.ndarray, cutoff: float, single: bool) -> tuple[np.ndarray, ...]:
    """Positions, chunks and exact scores of the proposed windows at or over the cutoff."""
    length = len(motif_weights)
    ok, row = bases.inside(at, length)
    at = at[ok]
    padded = np.column_stack([motif_weights, np.full(length, np.nan)])  # any other letter: no score
    score = np.zeros(len(at))
    for j in range(length):
        score += padded[j, bases.codes[at + j]]
    if single:
        score = score.astype(np.float32).astype(np.float64)
    ok = score >= cutoff
    return at[ok], row[ok], score[ok]


class Panel:
    """Motifs on both strands, in lanes of 64."""

    def __init__(self, motifs: list[Motif], single: bool):
        self.single = single
        self.stranded = [(m, w, s) for m in motifs for w, s in ((m.weights, "+"), (m.weights[::-1, ::-1], "-"))]
        # Motifs of like length share a group, so that short ones are not carried through all packs.
        self.order = sorted(range(len(self.stranded)), key=lambda i: len(self.stranded[i][1]))
        groups = [self.order[i:i + 64] for i in range(0, len(self.order), 64)]
        self.groups = [(g, Lanes([(self.stranded[i][1], self.stranded[i][0].cutoff) for i in g], single)) for g in groups]

    def find(self, bases: _Bases) -> Iterator[tuple]:
        """(motif, strand, positions, chunks, scores) of the motifs with hits, in their order."""
        found = {}
        for group, lanes in self.groups:
            at, lane = lanes.propose(bases)
            cuts = np.searchsorted(lane, np.arange(len(group) + 1))
            for i, low, high in zip(group, cuts, cuts[1:]):
                if low < high:
                    motif, weights, strand = self.stranded[i]
                    hits = _scored(bases, at[low:high], weights, motif.cutoff, self.single)
                    if len(hits[0]):
                        found[i] = (motif, strand, *hits)
        for i in sorted(found):
            yield found[i]


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint64(0x9E3779B97F4A7C15)) ^ ((right * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(7))


class WordIndex:
    """All forms (word or reverse complement) of all lengths in one table.

    A form is filed under the number of its first letters, as many as the largest of ``_SEEDS`` that it is long
    enough for; any letters make a number, so words with other letters than ACGT are no special case. All bases of
    a slice look up their numbers together, once a seed length: first in a table of bits that drops nearly all
    others, then by binary search, and the remaining letters of what is left are compared.
    A form that several words share stands once, with all its words.
    """

    def __init__(self, words: list[str]):
        by_form: dict[str, list[tuple[str, int]]] = {}
        for order, word in enumerate(words):
            other = reverse_complement(word)
            by_form.setdefault(word, []).append(("+", order))
            if other != word:
                by_form.setdefault(other, []).append(("-", order))
        forms = sorted(by_form)
        sizes = np.array([len(by_form[f]) for f in forms], np.int64)
        owners = [o for f in forms for o in by_form[f]]
        self.lengths = np.array([len(f.encode()) for f in forms], np.int64)
        self.sizes, self.owner_starts = sizes, np.cumsum(sizes) - sizes
        self.forward = np.array([o[0] == "+" for o in owners], bool)
        self.orders = np.array([o[1] for o in owners], np.int32)
        self.letters = np.frombuffer("".join(forms).encode(), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        seed = np.array(_SEEDS)[np.searchsorted(_SEEDS, self.lengths, side="right") - 1]
        self.tables = []
        own = _Bases(self.letters, np.zeros(1, np.int64), np.zeros(1, np.int64))
        for k in sorted(set(seed.tolist())):
            chosen = np.flatnonzero(seed == k)
            numbers = own.seeds(k)[self.starts[chosen]]
            by = np.argsort(numbers, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[_slot(numbers)] = True
            keys, first, many = np.unique(numbers[by], return_index=True, return_counts=True)
            self.tables.append((k, bits, keys, first, many, chosen[by]))

    @classmethod
    def of(cls, values: dict) -> WordIndex:
        made = cls.__new__(cls)
        vars(made).update(values)
        return made

    def find(self, bases: _Bases) -> tuple[np.ndarray, np.ndarray]:
        """(positions, forms) of every match, whatever chunk it ends in."""
        folded, total = _UPPER[bases.data], len(bases.data)
        found = []
        for k, bits, keys, first, many, forms in self.tables:
            if total < k:
                continue
            numbers = bases.seeds(k)
            at = np.flatnonzero(bits[_slot(numbers)])
            place = np.searchsorted(keys, numbers[at])
            place[place == len(keys)] = 0
            same = keys[place] == numbers[at]
            at, place = at[same], place[same]
            form = forms[np.repeat(first[place], many[place]) + _within(many[place])]
            at = np.repeat(at, many[place])
            fits = at + self.lengths[form] <= total
            at, form = at[fits], form[fits]
            # Numbers of up to 8 letters are the letters; a mix has to be compared from the start.
            done, j = [], k if k <= 8 else 0
            while len(at):
                over = self.lengths[form] == j
                done.append((at[over], form[over]))
                at, form = at[~over], form[~over]
                same = folded[at + j] == self.letters[self.starts[form] + j]
                at, form, j = at[same], form[same], j + 1
            found += done
        none = np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)


def _slot(numbers: np.ndarray) -> np.ndarray:
    return (numbers * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _scan_slice(chr_n: pa.Array, start: np.ndarray, bases: _Bases, words: WordIndex | None, panel: Panel | None):
    def batch(at, row, length, source, strand, order, name, score):
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [
                chr_n.take(pa.array(row)),
                pa.array(start[row] + at - bases.offsets[row]),
                pa.array(np.full(n, length, dtype=np.int32)),
                bases.text(at, length, upper=source == "list"),
                pa.repeat(source, n),
                strand if isinstance(strand, pa.Array) else pa.repeat(strand, n),
                order if isinstance(order, pa.Array) else pa.array(np.full(n, order, dtype=np.int32)),
                pa.repeat(name, n) if name is not None else pa.nulls(n, pa.string()),
                pa.array(score) if score is not None else pa.nulls(n, pa.float64()),
            ],
            schema=_ARROW,
        )

    if words is not None:
        at, form = words.find(bases)
        lengths = words.lengths[form]
        for length in np.unique(lengths).tolist():
            own = lengths == length
            ok, row = bases.inside(at[own], length)
            here, kind = at[own][ok], form[own][ok]
            if len(here):
                many = words.sizes[kind]
                owner = np.repeat(words.owner_starts[kind], many) + _within(many)
                strand = pa.array(["-", "+"]).take(pa.array(words.forward[owner].astype(np.int8)))
                yield batch(
                    np.repeat(here, many), np.repeat(row, many), length, "list", strand, pa.array(words.orders[owner]), None, None,
                )
    if panel is not None:
        for motif, strand, at, row, score in panel.find(bases):
            yield batch(at, row, len(motif.weights), "pssm", strand, motif.order, motif.name, score)


def _slices(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, _Bases]]:
    """The batch in slices of about ``_SLICE_BYTES``, with the bases of each end to end."""
    rows = max(1, int(whole.num_rows * _SLICE_BYTES / max(whole.nbytes, 1)))
    for first in range(0, whole.num_rows, rows):
        part = whole.slice(first, rows)
        column = part.column("bases")
        if isinstance(column, pa.LargeBinaryArray):
            column = column.cast(pa.binary())
        _, off_buf, data_buf = column.buffers()
        if data_buf is None:
            continue
        off = np.frombuffer(off_buf, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(data_buf, dtype=np.uint8)[off[0]:off[-1]]
        if len(data):
            yield part, _Bases(data, (off - off[0]).astype(np.int64), part.column("chunk_len").to_numpy())


def _scan_batch(whole: pa.RecordBatch, words: WordIndex | None, panel: Panel | None) -> Iterator[pa.RecordBatch]:
    for part, bases in _slices(whole):
        yield from _scan_slice(part.column("chr_n"), part.column("chunk_start").to_numpy(), bases, words, panel)


def _ship() -> None:
    """The scan travels with its tasks, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules["sitescan"])


def _clean_words(words: Sequence[str]) -> list[str]:
    out = [w.upper() for w in words]
    if any(not w for w in out):
        raise ValueError("an empty word would match everywhere")
    return out


def scan(
    chunks: DataFrame,
    words: Sequence[str] = (),
    motifs: DataFrame | None = None,
    score_mult: float = SCORE_MULT,
    cutoffs: dict[str, float] | float | None = None,
    float32: bool = False,
    max_cells: int = PANEL_CELLS,
) -> DataFrame:
    """Hits of the words and motifs on both strands, in contig coordinates (``start`` is 0-based).

    Words: exact, case-insensitive, overlapping, upper-case ``seq``; a palindrome hits once per position and
    a word given twice hits twice. Motifs: ``score >= cutoff`` (``score_mult`` of the best score unless
    ``cutoffs`` names them or is one for all); ``seq`` keeps its case; letters other than ACGT give no hit. ``float32``
    rounds the scores to single precision before the test.

    The chunks are read where they lie and never shuffled. All words go to every task as one table; motifs do in
    panels of at most ``max_cells`` weights, each scanned in a pass of its own.
    """
    words = _clean_words(words)
    overlap = chunk_layout(chunks)[1]
    for length in {len(w) for w in words}:
        check_window(length, overlap)
    spark, source = chunks.sparkSession, chunks.select("chr_n", "chunk_start", "chunk_len", "bases")
    panels = _panels(motifs, score_mult, cutoffs, max_cells, overlap) if motifs is not None else iter(())
    _ship()
    parts = []
    while True:
        panel = next(panels, None)
        if panel is None and (parts or not words):
            break
        # Plain values: the index is made once on the driver, the motifs' tables once in each task.
        index = vars(WordIndex(words)) if words and not parts else None
        shared = spark.sparkContext.broadcast((index, [tuple(m) for m in panel or ()]))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            given, motifs_ = shared.value
            own = WordIndex.of(given) if given else None
            panel = Panel([Motif(*m) for m in motifs_], float32) if motifs_ else None
            for whole in batches:
                yield from _scan_batch(whole, own, panel)

        parts.append(source.mapInArrow(run, HIT_SCHEMA))
    if not parts:
        return spark.createDataFrame([], HIT_SCHEMA)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _panels(
    motifs: DataFrame, score_mult: float, cutoffs: dict[str, float] | float | None, max_cells: int, overlap: int,
) -> Iterator[list[Motif]]:
    """The motifs in their order, in panels of at most ``max_cells`` weights; the driver holds one at a time."""
    rows = motif_rows(motifs, score_mult, cutoffs).orderBy("motif_ord", "motif")
    panel, cells = [], 0
    for order, r in enumerate(rows.toLocalIterator()):
        made = make_motif(r["motif"], order, r["cells"], r["cutoff"])
        check_window(len(made.weights), overlap)
        if panel and cells + made.weights.size > max_cells:
            yield panel
            panel, cells = [], 0
        panel.append(made)
        cells += made.weights.size
    if panel:
        yield panel


def scan_words(chunks: DataFrame, words: Sequence[str], method: str = "arrow") -> DataFrame:
    """Exact words on both strands; ``method='native'`` joins windows with the word table in the JVM."""
    if method == "arrow":
        return scan(chunks, words=words)
    if method == "native":
        return _scan_words_native(chunks, _clean_words(words))
    raise ValueError(f"unknown method {method!r}")


def scan_motifs(
    chunks: DataFrame, motifs: DataFrame, score_mult: float = SCORE_MULT,
    cutoffs: dict[str, float] | float | None = None, float32: bool = False, method: str = "arrow",
) -> DataFrame:
    """Weighted motifs on both strands; ``method='native'`` sums column expressions over JVM windows."""
    if method == "arrow":
        return scan(chunks, motifs=motifs, score_mult=score_mult, cutoffs=cutoffs, float32=float32)
    if method == "native":
        return _scan_motifs_native(chunks, motifs, score_mult, cutoffs, float32)
    raise ValueError(f"unknown method {method!r}")


def _scan_words_native(chunks: DataFrame, words: list[str]) -> DataFrame:
    spark = chunks.sparkSession
    forms = []
    for order, word in enumerate(words):
        forms.append((word, "+", order))
        if reverse_complement(word) != word:
            forms.append((reverse_complement(word), "-", order))
    parts = []
    for k in sorted({len(w) for w in words}):
        table = spark.createDataFrame(
            [f for f in forms if len(f[0]) == k], "seq string, strand string, hit_ord int"
        )
        windows = kmers(chunks, k).withColumn("seq", F.upper("kmer")).drop("kmer")
        parts.append(windows.join(table, "seq").select(
            "chr_n", "start", F.lit(k).alias("hit_len"), "seq", F.lit("list").alias("source"), "strand",
            "hit_ord", F.lit(None).cast("string").alias("tf_name"),
            F.lit(None).cast("double").alias("score_pssm"),
        ))
    if not parts:
        return spark.createDataFrame([], HIT_SCHEMA)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _scan_motifs_native(chunks, motifs, score_mult, cutoffs, single) -> DataFrame:
    spark = chunks.sparkSession
    parts = []
    rows = sorted(motif_rows(motifs, score_mult, cutoffs).collect(), key=lambda r: (r["motif_ord"], r["motif"]))
    for m in [make_motif(r["motif"], i, r["cells"], r["cutoff"]) for i, r in enumerate(rows)]:
        k = len(m.weights)
        windows = kmers(chunks, k)
        for weights, strand in ((m.weights, "+"), (m.weights[::-1, ::-1], "-")):
            score = F.lit(0.0)
            for j, row in enumerate(weights):
                letter = F.upper(F.substring("kmer", j + 1, 1))
                pick = F.when(letter == BASES[0], F.lit(float(row[0])))
                for b in range(1, 4):
                    pick = pick.when(letter == BASES[b], F.lit(float(row[b])))
                score = score + pick
            if single:
                score = score.cast("float").cast("double")
            parts.append(
                windows.select("*", score.alias("score_pssm"))
                .where(F.col("score_pssm") >= m.cutoff)
                .select(
                    "chr_n", "start", F.lit(k).alias("hit_len"), F.col("kmer").alias("seq"),
                    F.lit("pssm").alias("source"), F.lit(strand).alias("strand"),
                    F.lit(m.order).alias("hit_ord"), F.lit(m.name).alias("tf_name"), "score_pssm",
                )
            )
    if not parts:
        return spark.createDataFrame([], HIT_SCHEMA)
    return reduce(lambda a, b: a.unionByName(b), parts)
