"""Counts of long windows, of which nearly all are different.

Windows that lie next to each other share most of their bases, and mostly their minimizer too: of the words of
``m`` bases in a window the one with the least hash. Neighbours with one minimizer travel as one stretch of
bases, so bases cross the shuffle and not windows; equal windows have equal minimizers, so each window is counted
in one part. Equal stretches are folded before they leave a task, which takes the weight out of repeats and runs of N,
and the stretches of a part travel compressed.

There are as many parts as there are blocks of bases, so a part does not grow with the table. A part that a frequent
minimizer makes heavy all the same is not counted in one task: its windows are grouped by Spark, which can spill.

A task never makes a row or a key of each window: it sorts the windows of a part by a hash of 8 bytes, and compares
the letters of those whose hashes agree.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.operators.sequences import check_window, chunk_layout
from sitescan.session import cut_lineage

#: Windows of a part, on the average.
BLOCK = 1 << 20
#: Bases that are hashed at once (they stay in the processor's cache), and those that are folded at once.
_SLICE = 1 << 17
_FOLD = 1 << 23
#: Windows of a part up to which one task counts them, and the least number of parts (it bounds a row's length).
HEAVY = 1 << 21
PARTS = 256
#: Bytes of windows in an Arrow batch that a task returns, and of the batches it gets unless the session names a size.
_OUT = 1 << 21
_IN = 8 << 20
_IN_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_PACKED = "part int, stretches int, size bigint, packed binary"
_COUNTED = "kmer string, n bigint, sum_start bigint"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(out: np.ndarray) -> np.ndarray:
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


_LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)


def word_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A hash of the ``m`` letters from each position, in steps that double."""
    if len(data) < m:
        return np.zeros(0, np.uint64)
    out, done = _LETTERS[data], 1
    while done < m:
        step = min(done, m - done)
        left = out[:-step] * _MIX
        left ^= out[step:]
        out, done = left, done + step
    return _mixed(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each position, in steps that double."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def stretches(data: np.ndarray, offsets: np.ndarray, owned: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, minimizer, row) of the stretches of the sequences that lie end to end in ``data``.

    ``offsets`` delimit the sequences; of each, the windows that begin in its first ``owned`` bases count.
    """
    windows = np.maximum(np.minimum(owned, np.diff(offsets) - k + 1), 0)
    rows = np.flatnonzero(windows)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    least = sliding_least(word_hashes(data, m), k - m + 1)
    new = np.append(True, least[1:] != least[:-1])
    new[offsets[rows]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(offsets, first, side="right") - 1
    end = np.minimum(np.append(first[1:], len(least)), offsets[row] + windows[row])
    held = end > first
    first, row = first[held], row[held]
    return first, end[held] - first, least[first], row


def _pieces(data: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bases of some stretches of ``data``, end to end."""
    ends = np.cumsum(lens)
    return data[np.repeat(at - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


def _counted(bases: np.ndarray, lens: np.ndarray, times: np.ndarray, sums: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """``kmer, n, sum_start`` of the windows of some stretches that lie end to end in ``bases``."""
    many, starts = lens - k + 1, np.cumsum(lens) - lens
    # The places of the windows: the numbers of a window take most of the memory, so these are short and made in place.
    at = np.arange(many.sum(), dtype=np.int32 if len(bases) < 1 << 31 else np.int64)
    if not len(at):
        return
    at += np.repeat((starts - np.cumsum(many) + many).astype(at.dtype), many)
    n = np.repeat(times, many)
    total = np.repeat(sums - starts * times, many)
    total += at * n
    # The hash in the high bits and the number of the window in the low ones: plain numbers sort fastest.
    low = np.uint64((1 << int(len(at)).bit_length()) - 1)
    keys = np.arange(len(at), dtype=np.uint64)
    for a in range(0, len(at), _SLICE):
        here = at[a:a + _SLICE]
        keys[a:a + _SLICE] |= word_hashes(bases[here[0]:here[-1] + k], k)[here - here[0]] & ~low
    keys.sort()
    again = np.flatnonzero(keys[1:] ^ keys[:-1] <= low) + 1
    letters = np.lib.stride_tricks.sliding_window_view(bases, k)
    kept = np.ones(len(at), bool)
    clashes = None
    if len(again):
        # Runs of one hash: their rows in the order of the keys, and where each run begins.
        member = np.zeros(len(at), bool)
        member[again] = member[again - 1] = True
        run = np.flatnonzero(member)
        follows = np.zeros(len(at), bool)
        follows[again] = True
        follows = follows[run]
        window = (keys[run] & low).astype(np.int64)
        heads = np.flatnonzero(~follows)
        clash = _clashes(letters, at[window], follows)
        if clash.any():
            of = np.cumsum(~follows) - 1
            lost = np.isin(of, of[clash])
            clashes = _grouped(letters[at[window[lost]]], n[window[lost]], total[window[lost]])
            kept[window[lost]] = False
        kept[window[follows]] = False
        n[window[heads]], total[window[heads]] = np.add.reduceat(n[window], heads), np.add.reduceat(total[window], heads)
    del keys
    kept = np.flatnonzero(kept)
    step = max(1, _OUT // k)
    for a in range(0, len(kept), step):
        rows = kept[a:a + step]
        yield _batch(letters[at[rows]], n[rows], total[rows])
    if clashes is not None:
        for a in range(0, len(clashes[0]), step):
            yield _batch(*(c[a:a + step] for c in clashes))


def _clashes(letters: np.ndarray, at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which windows follow one of the same hash, and have other letters."""
    out = np.zeros(len(at), bool)
    for a in range(1, len(at), _SLICE):
        b = min(a + _SLICE, len(at))
        out[a:b] = (letters[at[a:b]] != letters[at[a - 1:b - 1]]).any(axis=1) & follows[a:b]
    return out


def _grouped(letters: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    kmers, of = np.unique(letters, axis=0, return_inverse=True)
    added = [np.zeros(len(kmers), np.int64) for _ in range(2)]
    for out, values in zip(added, (n, total)):
        np.add.at(out, of.ravel(), values)
    return kmers, *added


def _batch(letters: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    rows, k = letters.shape
    ends = pa.py_buffer(np.arange(0, (rows + 1) * k, k, dtype=np.int32))
    kmers = pa.StringArray.from_buffers(rows, ends, pa.py_buffer(np.ascontiguousarray(letters)))
    return pa.RecordBatch.from_arrays([kmers, pa.array(n), pa.array(total)], names=["kmer", "n", "sum_start"])


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over small batches; a worker lives on, so a task gives back what it held when it ends."""
    cloudpickle.register_pickle_by_value(sys.modules["sitescan"])
    spark = df.sparkSession
    if spark.conf.get(_IN_SETTING, None) is None:
        spark.conf.set(_IN_SETTING, _IN)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return df.mapInArrow(bounded, schema)


def count_kmers(chunks: DataFrame, k: int, m: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """``kmer, n, sum_start``: every different window of ``k`` bases, how often and the sum of its 0-based starts.

    The same as grouping ``kmers(chunks, k)``; letters count as they stand. ``m`` is the length of a minimizer, by
    default 13 or less for short windows (shorter ones are frequent in some texts, longer ones make short stretches);
    a part of more than ``heavy`` windows is grouped by Spark.
    """
    check_window(k, chunk_layout(chunks)[1])
    m = min(13, max(1, k // 2)) if m is None else m
    if not 1 <= m <= k:
        raise ValueError(f"a minimizer has 1 to {k} bases, not {m}")
    spark = chunks.sparkSession
    total = chunks.agg(F.sum("chunk_len")).first()[0] or 0
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, total // BLOCK)

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each part, of equal stretches one; a hash of its ends tells a stretch here."""
        windows, held, waiting = np.zeros(parts, np.int64), [], 0

        def added() -> None:
            least, many, ends = _joined(held)
            _, first = np.unique(ends, return_index=True)
            np.add.at(windows, (least[first] % np.uint64(parts)).astype(np.int64), many[first])

        for data, off, owned, _ in _sequences(batches):
            at, many, least, _ = stretches(data, off, owned, k, m)
            whole = word_hashes(data, k)
            ends = _mixed(whole[at] * _MIX ^ whole[at + many - 1] ^ many.astype(np.uint64))
            held.append((least, many, ends))
            waiting += int((many + k - 1).sum())
            if waiting >= _FOLD:
                added()
                held, waiting = [], 0
        if held:
            added()
        some = np.flatnonzero(windows)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(windows[some])], names=["part", "windows"])

    source = chunks.select("chunk_start", "chunk_len", "bases")
    sized = _mapped(source, size, "part int, windows bigint").groupBy("part")
    sizes = cut_lineage(sized.agg(F.sum("windows").alias("windows")))
    # Counted before anything is sent, and the only rows stored. At most one number for each ``heavy`` windows.
    over = [r.part for r in sizes.where(F.col("windows") > heavy).collect()]
    is_over = np.zeros(parts, bool)
    is_over[over] = True

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _stretches(batches, k, m, parts, ~is_over, _FOLD):
            yield from _packed(*held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, codec = None, [], pa.Codec("zstd")
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != now:
                    yield from _counted(*_joined(held), k)
                    held = []
                now = part
                held.append(_unpacked(*row, codec))
        if held:
            yield from _counted(*_joined(held), k)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of the windows of heavy parts, which are still to be added up."""
        for _, starts, lens, bases in _stretches(batches, k, m, parts, is_over, BLOCK):
            yield from _counted(bases, lens, np.ones(len(lens), np.int64), starts, k)

    sent = _mapped(source, cut, _PACKED).repartition("part").sortWithinPartitions("part")
    counted = _mapped(sent, count, _COUNTED)
    if not over:
        return counted
    pieces = _mapped(source, single, _COUNTED)
    return counted.unionByName(pieces.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("sum_start").alias("sum_start")))


def _joined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*held))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(bases, offsets, owned bases, first positions) of the chunks, as many at once as are hashed together."""
    for batch in batches:
        column = batch.column("bases")
        column = column.cast(pa.binary()) if isinstance(column, pa.LargeBinaryArray) else column
        _, off_buf, data_buf = column.buffers()
        if data_buf is None:
            continue
        off = np.frombuffer(off_buf, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data_buf, np.uint8)
        owned, start = batch.column("chunk_len").to_numpy(), batch.column("chunk_start").to_numpy()
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(off, off[first] + _SLICE, side="right")) - 1)
            yield data[off[first]:off[last]], off[first:last + 1] - off[first], owned[first:last], start[first:last]
            first = last


def _stretches(
    batches: Iterator[pa.RecordBatch], k: int, m: int, parts: int, wanted: np.ndarray, most: int,
) -> Iterator[tuple[np.ndarray, ...]]:
    """(part, first position, length, bases) of the stretches of the wanted parts, some ``most`` bases at once."""
    held, waiting = [], 0
    for data, off, owned, start in _sequences(batches):
        at, many, least, row = stretches(data, off, owned, k, m)
        part = (least % np.uint64(parts)).astype(np.int32)
        if not wanted.all():
            keep = wanted[part]
            at, many, part, row = at[keep], many[keep], part[keep], row[keep]
        if not len(at):
            continue
        lens = many + k - 1
        held.append((part, start[row] + at - off[row], lens, _pieces(data, at, lens)))
        waiting += len(held[-1][-1])
        if waiting >= most:
            yield _joined(held)
            held, waiting = [], 0
    if held:
        yield _joined(held)


def _packed(part: np.ndarray, start: np.ndarray, lens: np.ndarray, bases: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part, with its different stretches: lengths, times, sums of positions and bases, compressed."""
    ends = np.append(0, np.cumsum(lens)).astype(np.int32)
    text = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(bases)])
    # Equal stretches have equal minimizers, and so one part.
    folded = pa.table({"bases": text, "part": part, "times": np.ones(len(lens), np.int64), "start": start})
    folded = folded.group_by("bases").aggregate([("part", "min"), ("times", "sum"), ("start", "sum")]).sort_by("part_min").combine_chunks()
    part, times, sums = (folded.column(c).to_numpy() for c in ("part_min", "times_sum", "start_sum"))
    text = folded.column("bases").chunk(0)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    bases, lens, codec = np.frombuffer(text.buffers()[2], np.uint8), np.diff(ends), pa.Codec("zstd", compression_level=1)
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    rows = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        # Byte by byte: the high bytes of most numbers are 0.
        numbers = np.concatenate([lens[a:b], times[a:b], sums[a:b]]).view(np.uint8).reshape(-1, 8).T
        raw = numbers.tobytes() + bases[ends[a]:ends[b]].tobytes()
        rows.append((b - a, len(raw), codec.compress(raw, asbytes=True)))
    counts, sizes, packed = zip(*rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part[cuts[:-1]], pa.int32()), pa.array(counts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
        names=["part", "stretches", "size", "packed"],
    )


def _unpacked(many: int, size: int, packed: bytes, codec: pa.Codec) -> tuple[np.ndarray, ...]:
    """(bases, lengths, times, sums) of a row of :func:`_packed`."""
    raw = np.frombuffer(codec.decompress(packed, decompressed_size=size), np.uint8)
    numbers = np.ascontiguousarray(raw[:24 * many].reshape(8, -1).T).view(np.int64).ravel()
    return raw[24 * many:], *numbers.reshape(3, many)
