"""Class-based bigram language model with classes found by exchange clustering.

P(word | previous) = weight * P(class | previous class) * P(word | class) + (1 - weight) * P(word).

All words of the training part are counted and clustered while the likelihood of the class bigrams grows. The
core, the most frequent words up to a fixed number, is exchanged one word after the other within a task. Then every
other word, however rare, leaves the class of its ending for the best of all classes: the held words, whose counts
and classes every task has, in a few rounds, and the rest, dealt out by word, in one, with their classes in a table.
Only a word never seen has the class of its ending without a choice. Word counts, class bigrams and emission totals
cover the whole training part; what grows with the corpus stays in Spark tables, and only tables whose size is fixed
by a parameter reach the driver or all tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import free_name, map_batches, map_column, runs, slices, stored, text_of

#: Words that are exchanged one by one, and words whose counts and classes every task holds.
CORE = 8192
HELD = 200_000
CLUSTERS = 64
ENDINGS = 32
ROUNDS = 6
#: Rounds over the held words outside the core.
PASSES = 3
WEIGHT = 0.9
#: Weight of the class frequencies in the transition probabilities.
PRIOR = 10.0

#: Words of a bucket, in which other words meet their neighbours.
MID_BUCKET, RARE_BUCKET = 2048, 16384
#: Different pairs of a bucket, at most.
PAIR_BUCKET = 1 << 16
#: Entries (or sixteens of bytes) that a task holds of a kind before it sends them, and entries of a stored row: Parquet
#: looks at the size of a page every hundred rows only, and a reader takes 4,096 rows at once.
FLUSH = 1 << 20
ENTRIES = 2048
#: What the text pass returns: counted pairs, held words and other words with their neighbours, others in a row.
PAIRS, MID, RARE, LINKS = range(4)
TEXT_SCHEMA = "kind int, bucket int, codes array<bigint>, n array<bigint>, words array<binary>, others array<binary>"


def ending(word: bytes, endings: int = ENDINGS) -> int:
    """Class, from 0, of a word outside the core."""
    return zlib.crc32(word[-3:]) % endings


def ending_of(word: Column, endings: int = ENDINGS) -> Column:
    return F.crc32(F.substring(word.cast("binary"), -3, 3)) % endings


def bytes_of(words: pa.Array) -> list[bytes]:
    """``to_pylist`` of words without nulls, from one copy of their bytes."""
    if not len(words):
        return []
    offsets, data = words.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    held = memoryview(data or b"")[at[0] : at[-1]].tobytes()
    cuts = (at - at[0]).tolist()
    return [held[a:b] for a, b in zip(cuts, cuts[1:])]


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words of the lower-cased texts, as bytes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat, lengths = lists.flatten().view(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    # Spaces at the edges leave empty words.
    blank = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[~full], minlength=len(lengths))
    return lengths.astype(np.int64) - blank, flat if full.all() else flat.filter(pa.array(full))


def endings_of(words: pa.Array, endings: int) -> np.ndarray:
    """:func:`ending` of each word."""
    coded = pc.dictionary_encode(pc.binary_slice(words, -3))
    kinds = np.array([ending(w, endings) for w in bytes_of(coded.dictionary)], dtype=np.int64)
    return kinds[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else kinds


def between_ends(lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' symbols in one row, an end before and behind each, and the place of each symbol in it."""
    row = np.zeros(len(symbols) + len(lengths) + 1, dtype=np.int64)
    at = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths) + 1
    row[at] = symbols
    return row, at


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, c``: each token of the documents, the end as an empty word, with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        room = ends = 0

        def flush() -> Iterator[pa.RecordBatch]:
            coded = pc.dictionary_encode(pa.concat_arrays([words for words, _ in held]))
            n = np.concatenate([n for _, n in held])
            held.clear()
            words = coded.dictionary
            c = np.bincount(coded.indices.to_numpy(), weights=n, minlength=len(words)).astype(np.int64)
            for low in range(0, len(words), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([words[part], pa.array(c[part])], names=["w", "c"])

        for batch in batches:
            for piece in slices(batch):
                lengths, flat = words_of(piece.column(0))
                ends += len(lengths)
                counted = pc.value_counts(flat)
                words = counted.field("values")
                held.append((words, counted.field("counts").to_numpy()))
                room += max(len(words), words.nbytes >> 4)
                if room > FLUSH:
                    yield from flush()
                    room = 0
        if held:
            yield from flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([ends])], names=["w", "c"])

    made = map_batches(docs.select(text_of(text).cast("binary").alias("_text")), count, "w binary, c bigint")
    return made.groupBy(F.col("w").cast("string").alias("word")).agg(F.sum("c").alias("c"))


def cut_for(histogram: list[tuple[int, int]], most: int) -> int:
    """Smallest count such that at most ``most`` words have it or more; (lower bound, words) by bucket."""
    total, cut = 0, 1 << 62
    for low, words in sorted(histogram, reverse=True):
        total += words
        if total > most:
            break
        cut = low
    return cut


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what doesn't depend on the classes."""
    return float(entropy(counts).sum() - entropy(counts.sum(0)).sum() - entropy(counts.sum(1)).sum())


def best_class(
    counts: np.ndarray, rows: np.ndarray, cols: np.ndarray, before: np.ndarray, after: np.ndarray, self_count: float,
    own: int, first: int,
) -> int:
    """The class from ``first`` on in which a word makes the likelihood greatest; updates the tables to it.

    ``before`` and ``after`` count the classes next to the word, its pairs with itself under ``own``.
    """
    n_before, n_after = before.sum(), after.sum()
    counts[:, own] -= before
    counts[own, :] -= after
    counts[own, own] += self_count
    rows[own] -= n_after
    cols[own] -= n_before
    before[own] -= self_count
    after[own] -= self_count
    b, a = np.flatnonzero(before), np.flatnonzero(after)
    x, y = counts[b, first:], counts[first:, a]
    gain = (entropy(x + before[b, None]) - entropy(x)).sum(0) + (entropy(y + after[a]) - entropy(y)).sum(1)
    at = np.arange(first, len(rows))
    diagonal = counts[at, at]
    gain += entropy(diagonal + before[at] + after[at] + self_count) - entropy(diagonal + before[at])
    gain -= entropy(diagonal + after[at]) - entropy(diagonal)
    gain -= entropy(rows[first:] + n_after) - entropy(rows[first:])
    gain -= entropy(cols[first:] + n_before) - entropy(cols[first:])
    # A word stays unless another class is really better.
    gain[own - first] += 1e-6
    new = first + int(np.argmax(gain))
    counts[:, new] += before
    counts[new, :] += after
    counts[new, new] += self_count
    rows[new] += n_after
    cols[new] += n_before
    return new


def gathered(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their ``n``."""
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
    return codes[cuts], np.add.reduceat(n, cuts)


def best_classes(counts: np.ndarray, own: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class other than the end's in which each word alone makes the likelihood greatest, by :func:`best_class`.

    ``own`` has the words' classes. ``word``, ``context`` and ``n`` say how often a word has a neighbour of a class:
    in front of it (``context`` is the class) or behind it (the class and the number of classes); in order, each once.
    A word beside itself counts as beside its class.
    """
    size, words = len(counts), len(own)
    best = np.array(own)
    both = np.concatenate([counts, counts.T])
    rows, cols, now = counts.sum(1)[1:], counts.sum(0)[1:], entropy(both)
    n = n.astype(float)
    starts = np.searchsorted(word, np.arange(words + 1))
    low = 0
    while low < words:
        # Some words at once: their gains are a row of all classes for each entry.
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + 16384, side="right")) - 1)
        part = slice(starts[low], starts[high])
        w, c, k, mine = word[part] - low, context[part], n[part], own[low:high]
        some, lines = high - low, np.arange(high - low)
        most = int(k.max(initial=0)) + 1
        pairs, inverse = np.unique(c * most + k.astype(np.int64), return_inverse=True)
        at = pairs // most
        added = (entropy(both[at] + (pairs % most)[:, None]) - now[at])[:, 1:]
        # The first entry of each word, then the second, and so on: words with many entries come first.
        many = np.diff(starts[low : high + 1])
        order, inverse = np.argsort(-many, kind="stable"), inverse.ravel()
        heads, sums = (starts[low:high] - starts[low])[order], np.zeros((some, size - 1))
        for i in range(int(many.max(initial=0))):
            filled = int(np.searchsorted(-many[order], -i))
            sums[:filled] += added[inverse[heads[:filled] + i]]
        gain = np.empty_like(sums)
        gain[order] = sums
        sides = np.zeros((some, 2 * size))
        sides[w, c] = k
        before, after = sides[:, :size], sides[:, size:]
        # A class on both sides of a word: its pairs fall into one cell.
        i, j = np.nonzero((before > 0) & (after > 0))
        d, x, y = counts[j, j], before[i, j], after[i, j]
        kept = j > 0
        gain[i[kept], j[kept] - 1] += (entropy(d + x + y) - entropy(d + x) - entropy(d + y) + entropy(d))[kept]
        # Neighbours in the word's own class, which the word has left.
        for side, other, table in ((before, after, counts), (after, before, counts.T)):
            near = np.flatnonzero(side[lines, mine] > 0)
            x, y, m = table[mine[near]][:, 1:], other[near][:, 1:], side[near, mine[near]][:, None]
            gain[near] += entropy(x - y + m) - entropy(x - y) - entropy(x + m) + entropy(x)
        for total, side in ((rows, after), (cols, before)):
            sums, inverse = np.unique(side.sum(1), return_inverse=True)
            gain -= (entropy(total + sums[:, None]) - entropy(total))[inverse.ravel()]
        # The own class: what it loses without the word.
        o = mine[w]
        loss = np.bincount(w, now[c, o] - entropy(both[c, o] - k), minlength=some)
        d, x, y = counts[mine, mine], before[lines, mine], after[lines, mine]
        loss += entropy(d - x) + entropy(d - y) - entropy(d) - entropy(d - x - y)
        for total, side in ((rows, after), (cols, before)):
            loss -= entropy(total[mine - 1]) - entropy(total[mine - 1] - side.sum(1))
        # A word stays unless another class is really better.
        gain[lines, mine - 1] = loss + 1e-6
        best[low:high] = 1 + np.argmax(gain, axis=1)
        low = high
    return best


@dataclass
class ClassModel:
    """What scoring needs: plain values of fixed size, and the tables of all word counts and of the other words' classes."""

    total: int
    distinct: int
    end_count: int
    words: list[bytes]
    counts: list[int]
    classes: list[int]
    log_step: np.ndarray
    endings: int
    clusters: int
    weight: float
    vocabulary: DataFrame
    held_from: int
    #: ``word, c, k``: count and class of every word of the training part that is not in ``words``.
    rest: DataFrame
    #: Likelihood after the core, after each round of the held words, and after the other words.
    likelihoods: list[float]


def fit(
    train: DataFrame, text: str = "text", core: int = CORE, held: int = HELD, clusters: int = CLUSTERS,
    endings: int = ENDINGS, rounds: int = ROUNDS, weight: float = WEIGHT, passes: int = PASSES,
) -> ClassModel:
    """Counts all of ``train`` and clusters all its words."""
    if held > 2_000_000:
        raise ValueError("held words are numbered up to 2,000,000")
    vocabulary = stored(word_counts(train, text))
    # Eight buckets an octave bound the histogram; a bucket's lower end is an exact count.
    bucket = F.floor(F.log2("c") * 8)
    sizes = vocabulary.where("word <> ''").groupBy(bucket.alias("b")).agg(
        F.min("c").alias("low"), F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")
    ).collect()
    end_count = (vocabulary.where("word = ''").agg(F.sum("c")).first()[0]) or 0
    total = sum(r.s for r in sizes) + end_count
    distinct = sum(r.n for r in sizes) + (1 if end_count else 0)
    histogram = [(r.low, r.n) for r in sizes]
    core_from, held_from = cut_for(histogram, core), cut_for(histogram, held)
    known = sorted(
        ((bytes(r.w), r.c) for r in vocabulary.where((F.col("c") >= held_from) & (F.col("word") != "")).select(
            F.col("word").cast("binary").alias("w"), "c").collect()), key=lambda x: (-x[1], x[0]),
    )
    words, counts = [w for w, _ in known], [c for _, c in known]
    n_core, others = sum(c >= core_from for c in counts), sum(r.n for r in sizes) - len(words)
    first, size = 1 + endings, 1 + endings + clusters
    # Symbols: 0 the end, then the endings for words that are not held, then the held words by falling count. For the
    # exchange of the core, a held word outside it is one of as many endings behind the core.
    mid = first + n_core
    outside = [ending(w, endings) for w in words[n_core:]]
    small = np.concatenate([np.arange(mid), mid + np.array(outside, dtype=np.int64)])
    met = stored(text_pass(train, text, words, small, first, mid, others))
    width = mid + endings
    pairs = stored(summed_pairs(met.where(F.col("kind") == PAIRS), width))
    classes = np.concatenate([np.arange(first), first + np.arange(n_core) % clusters, 1 + np.arange(endings)])
    classes, table = exchange(pairs, classes.astype(np.int64), first, mid, clusters, rounds)
    likelihoods = [likelihood(table)]
    now = classes[small]
    seen, tables = pairs.where((F.col("a") < mid) & (F.col("b") < mid)), None
    if len(words) > n_core:
        base = class_bigrams(seen, classes, size, first)
        around = met.where(F.col("kind") == MID)
        for turn in range(passes):
            moves = settle(around, now, table, len(small)).collect()
            # Where words that move at once spoil each other's choice, a part of them moves.
            for share in (1, 2, 4, 8):
                tried = np.array(now)
                for symbol, k in moves:
                    if symbol % share == turn % share:
                        tried[symbol] = k
                made = base + mid_bigrams(around, tried, size, first, mid)
                value = likelihood(made.sum(0))
                if value > likelihood(table):
                    break
            else:
                break
            now, table, tables = tried, made.sum(0), made
            likelihoods.append(value)
        if tables is None:
            tables = base + mid_bigrams(around, now, size, first, mid)
    rest = vocabulary.where((F.col("c") < held_from) & (F.col("word") != ""))
    rest = rest.select("word", "c", (1 + ending_of(F.col("word"), endings)).cast("int").alias("k"))
    if others:
        if tables is None:
            tables = class_bigrams(seen, classes, size, first)
        placed = stored(place(met.where(F.col("kind") == RARE), now, table, len(small), first, endings))
        made = placed.where("word IS NOT NULL").select(F.col("word").cast("string").alias("word"), "c", "k")
        whole = np.array(tables[0])
        cells = placed.where("word IS NULL").groupBy("k").agg(F.sum("c")).collect()
        np.add.at(whole.reshape(-1), [k for k, _ in cells], [n for _, n in cells])
        # Two such words in a row: both classes come from the table.
        links = met.where(F.col("kind") == LINKS).select(F.inline(F.arrays_zip("words", "others")))
        links = links.select(F.col("words").cast("string").alias("word"), F.col("others").cast("string").alias("other"))
        links = links.join(made.select("word", F.col("k").alias("a")), "word").join(
            made.select(F.col("word").alias("other"), F.col("k").alias("b")), "other")
        for a, b, n in links.groupBy("a", "b").count().collect():
            whole[a, b] += n
        likelihoods.append(likelihood(whole))
        if likelihoods[-1] > likelihood(table):
            rest, table = made, whole
    # Emission totals: (c + 1) of a class's words, and 1 for the words never seen with an ending.
    mass = np.zeros(size)
    mass[0] = end_count + 1
    for k, m in rest.groupBy("k").agg(F.sum(F.col("c") + 1)).collect():
        mass[k] += m
    mass[1:first] += 1
    np.add.at(mass, now[first:], np.array(counts, dtype=float) + 1)
    share = (table.sum(0) + 1) / (table.sum() + size)
    step = (table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR)
    log_step = np.log10(weight * step / np.maximum(mass, 1) + (1 - weight) / (total + distinct + endings))
    return ClassModel(
        total, distinct, end_count, words, counts, now[first:].tolist(), log_step, endings, clusters, weight,
        vocabulary, held_from, rest, likelihoods,
    )


def text_pass(
    train: DataFrame, text: str, words: list[bytes], small: np.ndarray, first: int, mid: int, others: int,
) -> DataFrame:
    """Rows of ``TEXT_SCHEMA``: each document between two ends, as counted pairs of the symbols ``small``, and the
    words outside the core with the symbols on their sides, by buckets of words.
    """
    shared = train.sparkSession.sparkContext.broadcast((words, small))
    endings, width, full = first - 1, mid + first - 1, len(small)
    buckets, code = 1 + others // RARE_BUCKET, np.int32 if width * width < 1 << 31 else np.int64
    lists = pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())

    def dealt(kind: int, bucket: np.ndarray, values: list) -> Iterator[pa.RecordBatch]:
        """Rows of at most ``ENTRIES`` entries of a bucket, a batch for some of them; the entries lie by bucket."""
        heads = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
        place = np.arange(len(bucket)) - np.repeat(heads, np.diff(np.append(heads, len(bucket))))
        cuts = np.append(np.flatnonzero(place % ENTRIES == 0), len(bucket))
        for i in range(0, len(cuts) - 1, 64):
            some = cuts[i : i + 65]
            part, at = slice(some[0], some[-1]), pa.array((some - some[0]).astype(np.int32))
            columns = [
                pa.nulls(len(some) - 1, t) if v is None
                else pa.ListArray.from_arrays(at, v[part] if isinstance(v, pa.Array) else pa.array(v[part])).cast(t)
                for v, t in zip(values, lists)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some) - 1, kind, dtype=np.int32)), pa.array(bucket[some[:-1]].astype(np.int32)), *columns],
                names=["kind", "bucket", "codes", "n", "words", "others"],
            )

    def sent(kind: int, parts: list) -> Iterator[pa.RecordBatch]:
        """What a task has held of a kind; empties ``parts``."""
        columns = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*parts)]
        parts.clear()
        if kind == PAIRS:
            codes, n = gathered(*columns)
            bucket = codes % (1 + width * width // PAIR_BUCKET)
            order = np.argsort(bucket, kind="stable")
            yield from dealt(kind, bucket[order], [codes[order], n[order], None, None])
        elif kind == MID:
            bucket = columns[0] // full % full // MID_BUCKET
            order = np.argsort(bucket, kind="stable")
            yield from dealt(kind, bucket[order], [columns[0][order], None, None, None])
        elif kind == RARE:
            codes, rare = columns
            some = (bytes_of(rare[low : low + (1 << 16)]) for low in range(0, len(rare), 1 << 16))
            bucket = np.fromiter((zlib.crc32(w) % buckets for part in some for w in part), np.int64, len(rare))
            order = np.argsort(bucket, kind="stable")
            yield from dealt(kind, bucket[order], [codes[order], None, rare.take(pa.array(order)), None])
        else:
            yield from dealt(kind, np.zeros(len(columns[0])), [None, None, *columns])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, small = shared.value
        known = pa.array(words, pa.binary())
        held: dict = {kind: [] for kind in (PAIRS, MID, RARE, LINKS)}
        room = dict.fromkeys(held, 0)

        def met(lengths: np.ndarray, flat: pa.Array, symbols: np.ndarray) -> dict:
            unheld = symbols < first
            others = flat.filter(pa.array(unheld))
            symbols[unheld] = 1 + endings_of(others, endings)
            row, places = between_ends(lengths, symbols)
            seen = small[row]
            mid_at, at = np.flatnonzero(row >= mid), places[unheld]
            beside = np.flatnonzero(np.diff(at) == 1)
            codes, n = np.unique((seen[:-1] * width + seen[1:]).astype(code), return_counts=True)
            return {
                PAIRS: (codes, n.astype(np.int32)),
                MID: ((row[mid_at - 1] * full + row[mid_at]) * full + row[mid_at + 1],),
                RARE: (row[at - 1] * full + row[at + 1], others),
                LINKS: (others.take(pa.array(beside)), others.take(pa.array(beside + 1))),
            }

        for batch in batches:
            pieces = [words_of(piece.column(0)) for piece in slices(batch, 2 << 20)]
            # All words of a batch are looked up at once: a call makes an index of the held words.
            flats = pa.chunked_array([flat for _, flat in pieces], pa.binary())
            found = pc.fill_null(pc.index_in(flats, value_set=known), -1).to_numpy() + np.int64(first)
            ends = np.cumsum([len(flat) for _, flat in pieces])
            for (lengths, flat), end in zip(pieces, ends):
                for kind, columns in met(lengths, flat, found[end - len(flat) : end]).items():
                    held[kind].append(columns)
                    room[kind] += max(len(columns[0]), sum(c.nbytes for c in columns) >> 4)
                    if room[kind] > FLUSH:
                        yield from sent(kind, held[kind])
                        room[kind] = 0
        for kind, parts in held.items():
            if parts:
                yield from sent(kind, parts)

    return map_batches(train.select(text_of(text).cast("binary").alias("_text")), count, TEXT_SCHEMA)


def cells_of(table: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(float))], names=["k", "n"])


def summed(made: DataFrame, size: int) -> np.ndarray:
    """Two tables of class bigrams from rows ``k, n``: of held words and ends, and with a word that is not held."""
    table = np.zeros(2 * size * size)
    for k, n in made.groupBy("k").agg(F.sum("n")).collect():
        table[k] = n
    return table.reshape(2, size, size)


def class_bigrams(pairs: DataFrame, classes: np.ndarray, size: int, first: int) -> np.ndarray:
    """Class bigrams of the pairs, those with a word that is not held apart."""
    shared = pairs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * size * size)
        for batch in batches:
            a, b, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            apart = ((a > 0) & (a < first)) | ((b > 0) & (b < first))
            cell = apart * size * size + shared.value[a] * size + shared.value[b]
            table += np.bincount(cell, weights=n, minlength=len(table))
        yield cells_of(table)

    return summed(map_batches(pairs, run, "k bigint, n double"), size)


def mid_bigrams(around: DataFrame, classes: np.ndarray, size: int, first: int, mid: int) -> np.ndarray:
    """The same of the pairs with a held word outside the core."""
    shared, full = around.sparkSession.sparkContext.broadcast(classes), len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = shared.value, np.zeros(2 * size * size)
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            left, word, right = codes // full // full, codes // full % full, codes % full
            # Of two such words in a row, the second one counts the pair.
            once = right < mid
            for a, b, x in ((left, word, left), (word[once], right[once], right[once])):
                apart = (x > 0) & (x < first)
                table += np.bincount(apart * size * size + now[a] * size + now[b], minlength=len(table))
        yield cells_of(table)

    return summed(map_batches(around.select("codes"), run, "k bigint, n double"), size)


def by_bucket(around: DataFrame, *columns: str) -> DataFrame:
    return around.select("bucket", *columns).repartition("bucket").sortWithinPartitions("bucket")


def summed_pairs(around: DataFrame, width: int) -> DataFrame:
    """``a, b, n``: each pair of symbols with its count, added up by buckets of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, room = None, [], 0

        def gather() -> tuple[np.ndarray, np.ndarray]:
            return gathered(*(np.concatenate(x) for x in zip(*held)))

        def done() -> pa.RecordBatch:
            codes, n = gather()
            return pa.RecordBatch.from_arrays(
                [pa.array(codes // width, pa.int32()), pa.array(codes % width, pa.int32()), pa.array(n)], names=["a", "b", "n"]
            )

        for batch in batches:
            for b, codes, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != bucket and bucket is not None:
                    yield done()
                    held, room = [], 0
                bucket = b
                held.append((codes.values.to_numpy(), n.values.to_numpy()))
                room += len(codes.values)
                if room > 1 << 20:
                    held, room = [gather()], 0
        if bucket is not None:
            yield done()

    return map_batches(by_bucket(around, "codes", "n"), run, "a int, b int, n bigint")


class Neighbours:
    """Sums of the codes of a bucket's words, of a size that the number of words and classes bounds."""

    def __init__(self) -> None:
        self.codes, self.n, self.held, self.room = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.held.append(codes)
        self.room += len(codes)
        if self.room > 1 << 20:
            self.gather()

    def gather(self) -> None:
        codes = np.concatenate([self.codes, *self.held])
        n = np.concatenate([self.n, np.ones(self.room, np.int64)])
        self.codes, self.n = gathered(codes, n)
        self.held, self.room = [], 0


def settle(around: DataFrame, classes: np.ndarray, table: np.ndarray, full: int) -> DataFrame:
    """``symbol, k``: the best class of each held word outside the core, all other words where they are."""
    shared, size = around.sparkSession.sparkContext.broadcast((classes, table)), len(table)
    code, kind = (pa.int32(), "int") if MID_BUCKET * size * size < 1 << 31 else (pa.int64(), "bigint")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word's place in its bucket and the classes on its sides as one number."""
        now = shared.value[0]
        for batch in batches:
            cuts, codes = batch.column(1).offsets, batch.column(1).values.to_numpy(zero_copy_only=False)
            codes = (codes // full % full % MID_BUCKET * size + now[codes // full // full]) * size + now[codes % full]
            for low, high in zip(cuts.to_pylist(), cuts.to_pylist()[1:]):
                codes[low:high].sort()
            made = pa.ListArray.from_arrays(cuts, pa.array(codes, code))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["bucket", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = shared.value
        bucket, met = None, Neighbours()

        def done() -> pa.RecordBatch:
            met.gather()
            places, word = np.unique(met.codes // (2 * size), return_inverse=True)
            symbols = bucket * MID_BUCKET + places
            k = best_classes(table, now[symbols], word.ravel(), met.codes % (2 * size), met.n)
            return pa.RecordBatch.from_arrays([pa.array(symbols, pa.int32()), pa.array(k, pa.int32())], names=["symbol", "k"])

        for batch in batches:
            for b, codes in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket and bucket is not None:
                    yield done()
                    met = Neighbours()
                bucket = b
                codes = codes.values.to_numpy(zero_copy_only=False).astype(np.int64)
                word = codes // (size * size) * (2 * size)
                met.add(word + codes // size % size)
                met.add(word + size + codes % size)
        if bucket is not None:
            yield done()

    small = map_batches(around.select("bucket", "codes"), packed, f"bucket int, codes array<{kind}>")
    return map_batches(by_bucket(small, "codes"), run, "symbol int, k int")


def place(around: DataFrame, classes: np.ndarray, table: np.ndarray, full: int, first: int, endings: int) -> DataFrame:
    """``word, k, c``: the best class and the count of each word that is not held.

    Rows without a word count the class bigrams of these words with held words and ends: cell and count.
    """
    shared, size = around.sparkSession.sparkContext.broadcast((classes, table)), len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = shared.value
        bucket, index, met = None, {}, Neighbours()
        cells = np.zeros(size * size, dtype=np.int64)

        def done() -> pa.RecordBatch:
            met.gather()
            words = pa.array(list(index), pa.binary())
            own = 1 + endings_of(words, endings)
            # Neighbours that are not held are apart until here: their classes are not final.
            word, context = met.codes // (4 * size), met.codes % (4 * size)
            codes, n = gathered(word * (2 * size) + context % (2 * size), met.n)
            k = best_classes(table, own, codes // (2 * size), codes % (2 * size), n)
            sure = context < 2 * size
            word, context, n_sure, before = word[sure], context[sure], met.n[sure], context[sure] < size
            np.add.at(cells, (context * size + k[word])[before], n_sure[before])
            np.add.at(cells, (k[word] * size + context - size)[~before], n_sure[~before])
            front = codes % (2 * size) < size
            c = np.bincount(codes[front] // (2 * size), weights=n[front], minlength=len(own)).astype(np.int64)
            return pa.RecordBatch.from_arrays([words, pa.array(k, pa.int32()), pa.array(c)], names=["word", "k", "c"])

        for batch in batches:
            for b, words, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != bucket and bucket is not None:
                    yield done()
                    index, met = {}, Neighbours()
                bucket = b
                coded = pc.dictionary_encode(words.values)
                own = np.array([index.setdefault(w, len(index)) for w in bytes_of(coded.dictionary)], dtype=np.int64)
                word = own[coded.indices.to_numpy(zero_copy_only=False)] * (4 * size)
                codes = codes.values.to_numpy(zero_copy_only=False)
                for symbol, side in ((codes // full, 0), (codes % full, size)):
                    apart = (symbol > 0) & (symbol < first)
                    met.add(word + apart * (2 * size) + side + now[symbol])
        if bucket is not None:
            yield done()
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(cells[at])], names=["word", "k", "c"]
        )

    return map_batches(by_bucket(around, "words", "codes"), run, "word binary, k int, c bigint")


def exchange(
    pairs: DataFrame, classes: np.ndarray, first: int, last: int, clusters: int, rounds: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the symbols and the class bigram counts after the exchange of the symbols from ``first`` to ``last``.

    In a round each task runs the exchange over its own core words against the counts at the round's start,
    updating its copy as words move; every second word is free to move, in turn. The best round counts.
    """
    size = first + clusters
    left = pairs.where((F.col("b") >= first) & (F.col("b") < last)).select(F.col("b").alias("w"), F.lit(0).alias("side"), F.col("a").alias("v"), "n")
    right = pairs.where((F.col("a") >= first) & (F.col("a") < last)).select(F.col("a").alias("w"), F.lit(1).alias("side"), F.col("b").alias("v"), "n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, (side, v, n) in runs(batches):
            lists = [(side, pa.int32()), (v, pa.int32()), (n, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([word], pa.int32()), *(pa.array([x], pa.list_(kind)) for x, kind in lists)],
                names=["w", "side", "v", "n"],
            )

    # One row a core word; its length is bounded by the number of symbols.
    together = left.union(right).repartitionByRange("w").sortWithinPartitions("w")
    core = stored(map_batches(together, pack, "w int, side array<int>, v array<int>, n array<bigint>"))
    context = pairs.sparkSession.sparkContext

    def bigrams(now: np.ndarray) -> np.ndarray:
        return class_bigrams(pairs, now, size, first).sum(0)

    def moves(now: np.ndarray, table: np.ndarray, turn: int) -> list:
        shared = context.broadcast((now, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, counts = shared.value
            counts = counts.copy()
            rows, cols = counts.sum(1), counts.sum(0)
            moved: list = []

            for batch in batches:
                for i, word in enumerate(batch.column(0).to_pylist()):
                    if word % 2 != turn % 2:
                        continue
                    side, v, n = (batch.column(k)[i].values.to_numpy() for k in (1, 2, 3))
                    both = [np.bincount(now[v[side == s]], weights=n[side == s], minlength=size) for s in (0, 1)]
                    own = float(n[(side == 0) & (v == word)].sum())
                    new = best_class(counts, rows, cols, *both, own, int(now[word]), first)
                    if new != now[word]:
                        moved.append((word, new))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in moved], pa.int32()), pa.array([m[1] for m in moved], pa.int32())], names=["w", "c"]
            )

        made = map_batches(core, run, "w int, c int").collect()
        shared.destroy()
        return made

    table = bigrams(classes)
    best = likelihood(table), classes, table
    for turn in range(rounds):
        moved = moves(classes, table, turn)
        if not moved and turn:
            break
        classes = classes.copy()
        for word, new in moved:
            classes[word] = new
        table = bigrams(classes)
        best = max(best, (likelihood(table), classes, table), key=lambda x: x[0])
    return best[1], best[2]


def score(docs: DataFrame, model: ClassModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` added.

    ``keep`` names the columns to return (all by default); others, a text above all, are then not stored.

    Scores are sums of log10 probabilities; a missing or empty text is the end alone. Rows that repeat score
    alike, an empty training part gives every token the same chance. Clashing names get an underscore.
    """
    plain = (model.words, model.counts, model.classes, model.log_step, model.endings, model.end_count)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def kernel():
        words, counts, classes, log_step, endings, end_count = shared.value
        known = pa.array(words, pa.binary())
        # The last entries are those of a word that is not held: nothing yet.
        logs = np.append(np.log10(np.array(counts, dtype=float) + 1), 0.0)
        kinds = np.append(np.array(classes, dtype=np.int64), -1)
        size, end_log = len(log_step), math.log10(end_count + 1)
        steps = np.zeros((size + 1, size + 1))
        steps[:size, :size] = log_step

        def work(texts: pa.Array) -> dict:
            lengths, flat = words_of(texts)
            at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
            unheld = at < 0
            path, places = between_ends(lengths, kinds[at])
            # Pairs of a document: one for each word and one for the end.
            heads = np.cumsum(lengths + 1) - lengths - 1
            value = np.full(len(path), end_log)
            value[places] = logs[at]
            doc = np.repeat(np.arange(len(lengths)), lengths)[unheld]
            tail = np.bincount(doc, minlength=len(lengths))
            ends = pa.array(np.concatenate([[0], np.cumsum(tail)]).astype(np.int32))
            beside = places[unheld]
            lists = {
                "tail": flat.filter(pa.array(unheld)), "at": pa.array((beside - heads[doc]).astype(np.int32)),
                "front": pa.array(path[beside - 1].astype(np.int32)), "back": pa.array(path[beside + 1].astype(np.int32)),
            }
            return {
                "n": pa.array(lengths + 1), "known": pa.array(lengths - tail + (end_count > 0)),
                "logs": pa.array(np.add.reduceat(value[1:], heads)),
                "steps": pa.array(np.add.reduceat(steps[path[:-1], path[1:]], heads)),
                **{name: pa.ListArray.from_arrays(ends, values) for name, values in lists.items()},
            }

        return work

    kept = docs.columns if keep is None else keep
    own = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    schema = "n bigint, known bigint, logs double, steps double, tail array<binary>, at array<int>, front array<int>, back array<int>"
    source = docs.select(own, text_of(text).cast("binary").alias("_text"))
    facts = stored(map_column(source, "_text", kernel, schema, ["_row"], 4 << 20).withColumn(
        "_id", F.monotonically_increasing_id()
    ))
    rare = facts.select("_id", F.inline(F.arrays_zip("tail", "at", "front", "back")))
    rare = rare.withColumn("word", F.col("tail").cast("string")).drop("tail")
    met = rare.join(model.rest, "word", "left").select(
        "_id", "at", "front", "back", F.coalesce("k", 1 + ending_of(F.col("word"), model.endings)).cast("int").alias("k"),
        F.coalesce(F.log10(F.col("c") + 1.0), F.lit(0.0)).alias("more"), F.col("c").isNotNull().cast("int").alias("seen"),
    )
    found = tail_sums(met, model.log_step).groupBy(F.col("_id").alias("_at")).agg(
        *[F.sum(c).alias(c) for c in ("more", "seen", "tail_steps")]
    )
    joined = facts.join(found, F.col("_id") == F.col("_at"), "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    names = {c: free_name(docs, c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")}
    base = logs - F.col("n") * math.log10(model.total + model.distinct + 1)
    full = logs + F.col("steps") + F.coalesce("tail_steps", F.lit(0.0))
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("n").alias(names["n_tokens"]),
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias(names["n_known"]),
        F.lit(model.total).cast("long").alias(names["train_tokens"]), base.alias(names["base_score"]),
        full.alias(names["score"]), F.pow(F.lit(10.0), -full / F.col("n")).alias(names["perplexity"]),
    )


def tail_sums(met: DataFrame, log_step: np.ndarray) -> DataFrame:
    """Sums over the words of a document that are not held: counts, how many were seen, and steps to and from them.

    A document may have some rows. ``front`` and ``back`` are the classes beside a word, -1 for another such word.
    """
    shared = met.sparkSession.sparkContext.broadcast(log_step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, _, front, back, k, more, seen = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # The word in front of one, in the row before: the last batch may have it.
            previous = np.concatenate([[last], k[:-1]])
            step = shared.value[np.where(front < 0, previous, front), k]
            step = step + np.where(back < 0, 0.0, shared.value[k, back])
            last = int(k[-1])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
            sums = [pa.array(np.add.reduceat(x, cuts)) for x in (more, seen.astype(np.int64), step)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cuts]), *sums], names=["_id", "more", "seen", "tail_steps"])

    together = met.repartition("_id").sortWithinPartitions("_id", "at")
    return map_batches(together, run, "_id bigint, more double, seen bigint, tail_steps double")
