import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescan.operators import (
    chunk_layout, chunk_sequences, contig_lengths, extract_sequences, kmers, locate_sites, prune_chunks,
)

SEQ = "chr_n string, seq string"
SITE = "site_id bigint, chr_n string, pos_ini bigint, pos_end bigint"


def random_sequences(seed=3):
    r = random.Random(seed)
    return {
        f"chr{i}": "".join(r.choice("ACGTNacgt") for _ in range(n))
        for i, n in enumerate([1, 2, 9, 50, 333, 1000])
    }


def random_sites(seqs, seed=4, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        name = r.choice([*seqs, "chrZ"])
        size = len(seqs.get(name, "x" * 40))
        ini = r.randint(-size - 5, size + 20)
        out.append((i, name, ini, ini + r.choice([-3, 0, 3, 60, 500])))
    return out


@pytest.mark.parametrize("size,overlap", [(1, 0), (7, 3), (50, 10), (4096, 63)])
def test_extraction_is_a_slice(spark, rows, size, overlap):
    seqs = random_sequences()
    sites = random_sites(seqs)
    chunks = chunk_sequences(spark.createDataFrame(list(seqs.items()), SEQ), size, overlap)
    located = locate_sites(spark.createDataFrame(sites, SITE), contig_lengths(chunks))
    got = dict(rows(extract_sequences(located, chunks, size), "site_id", "seq"))
    want = {i: seqs[c][a - 1:b] for i, c, a, b in sites if c in seqs}
    assert got == want


def test_clamped_extraction(spark, rows):
    chunks = chunk_sequences(spark.createDataFrame([("c", "ACGTACGTAC")], SEQ), 4, 2)
    sites = [(0, "c", 3, 5), (1, "c", 8, 20), (2, "c", 0, 4), (3, "c", -5, -1), (4, "c", 30, 40)]
    df = spark.createDataFrame(sites, SITE)
    plain = extract_sequences(locate_sites(df, contig_lengths(chunks)), chunks, 4)
    assert dict(rows(plain, "site_id", "seq")) == {0: "GTA", 1: "TAC", 2: "", 3: "ACGTA", 4: ""}
    clamped = extract_sequences(locate_sites(df, contig_lengths(chunks), clamp=True), chunks, 4)
    assert dict(rows(clamped, "site_id", "seq")) == {0: "GTA", 1: "TAC", 2: "ACGT", 3: "", 4: ""}


def test_chunk_table(spark, rows):
    chunks = chunk_sequences(spark.createDataFrame([("c", "ACGTA"), ("e", "")], SEQ), 2, 1)
    assert rows(chunks.selectExpr("chunk_id", "chunk_start", "chunk_len", "cast(bases as string)")) == [
        (0, 0, 0, ""), (0, 0, 2, "ACG"), (1, 2, 2, "GTA"), (2, 4, 1, "A")
    ]
    assert rows(contig_lengths(chunks)) == [("c", 5), ("e", 0)]


def test_pruning_keeps_touched_chunks_once(spark, rows):
    chunks = chunk_sequences(spark.createDataFrame([("c", "ACGTACGTAC"), ("d", "ACGT")], SEQ), 2, 1)
    sites = spark.createDataFrame([(0, "c", 3, 5), (1, "c", 3, 5), (2, "c", 100, 120)], SITE)
    located = locate_sites(sites, contig_lengths(chunks))
    assert rows(prune_chunks(chunks, located, 2), "chr_n", "chunk_id") == [("c", 1), ("c", 2)]


@pytest.mark.parametrize("size,overlap", [(1, 4), (7, 5), (4096, 63)])
def test_kmers(spark, rows, size, overlap):
    seqs = random_sequences()
    chunks = chunk_sequences(spark.createDataFrame(list(seqs.items()), SEQ), size, overlap)
    want = [(c, i, s[i:i + 5]) for c, s in seqs.items() for i in range(len(s) - 4)]
    assert rows(kmers(chunks, 5)) == sorted(want, key=lambda t: [str(x) for x in t])


def test_window_longer_than_the_overlap_is_refused(spark):
    chunks = chunk_sequences(spark.createDataFrame([("c", "ACGTA")], SEQ), 2, 1)
    with pytest.raises(ValueError, match="overlap"):
        kmers(chunks, 3)
    with pytest.raises(ValueError, match="empty"):
        kmers(chunks, 0)


def test_chunks_tell_their_size(spark, rows, tmp_path):
    chunks = chunk_sequences(spark.createDataFrame([("c", "ACGTACGTAC" * 30), ("e", "")], SEQ), 100, 7)
    chunks.write.parquet(str(tmp_path / "chunks"))
    again = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunk_layout(chunks) == chunk_layout(again) == (100, 7)
    sites = spark.createDataFrame([(0, "c", 1, 250), (1, "c", 95, 104), (2, "e", 1, 9)], SITE)
    located = locate_sites(sites, contig_lengths(again))
    assert dict(rows(extract_sequences(located, again), "site_id", "seq")) == {
        0: ("ACGTACGTAC" * 25), 1: ("ACGTACGTAC" * 12)[94:104], 2: ""
    }
    for use in (lambda: extract_sequences(located, again, 4096), lambda: prune_chunks(again, located, 50)):
        with pytest.raises(ValueError, match="100 bases long"):
            use()
    bare = spark.createDataFrame(again.collect(), "chr_n string, chunk_id long, chunk_start long, chunk_len long, bases binary")
    with pytest.raises(ValueError, match="size"):
        prune_chunks(bare, located)


@pytest.mark.parametrize("k, m", [(1, None), (6, 2), (31, None), (31, 31)])
def test_kmer_counts_equal_grouped_windows(spark, rows, monkeypatch, k, m):
    import random

    from sitescan.operators import kmer_counts

    monkeypatch.setattr(kmer_counts, "BLOCK", 300)
    draw = random.Random(k)
    repeat = "".join(draw.choice("ACGT") for _ in range(90))
    seqs = [("a", "".join(draw.choice("ACGTacgtN") for _ in range(700))), ("b", repeat * 9), ("c", "N" * 400), ("d", "AC"), ("e", "")]
    chunks = chunk_sequences(spark.createDataFrame(seqs, "chr_n string, seq string"), 100, 40)
    want = kmers(chunks, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))
    assert rows(kmer_counts.count_kmers(chunks, k, m)) == rows(want) != []


def test_stretches_shuffle_bases_not_windows(spark):
    import random

    from sitescan.operators import kmer_counts

    draw = random.Random(4)
    seq = "".join(draw.choice("ACGT") for _ in range(300_000))
    data = np.frombuffer(seq.encode(), np.uint8)
    at, many, least, _ = kmer_counts.stretches(data, np.array([0, len(data)]), np.array([len(data)]), 31, 9)
    assert many.sum() == len(seq) - 30 and (np.diff(at) == many[:-1]).all()
    # A stretch takes its bases and 20 bytes; a window as a row of its own at least its bases and 16.
    assert (many + 30 + 20).sum() < many.sum() * (31 + 16) / 5


def test_parts_of_long_windows_do_not_grow_with_the_table(spark, rows, monkeypatch):
    """More bases make more parts, and a part of many windows is grouped by Spark and not in one task."""
    from sitescan.operators import kmer_counts

    monkeypatch.setattr(kmer_counts, "BLOCK", 500)
    r = random.Random(4)
    seqs = [("a", "".join(r.choices("ACGT", k=150_000))), ("b", "ACGTTGCA" * 300 + "N" * 400), ("c", "ACG")]
    chunks = chunk_sequences(spark.createDataFrame(seqs, "chr_n string, seq string"), 1000, 30)
    want = kmers(chunks, 31).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))
    seen = []
    monkeypatch.setattr(kmer_counts, "cut_lineage", lambda df: seen.append(df) or df)
    got = rows(kmer_counts.count_kmers(chunks, 31, heavy=700))
    assert got == rows(want) == rows(kmer_counts.count_kmers(chunks, 31, heavy=0))
    sizes = [r.n for r in seen[0].groupBy("part").agg(F.sum("windows").alias("n")).collect()]
    assert len(sizes) > 256 and max(sizes) > 700 > sorted(sizes)[len(sizes) // 2]


def _cut_windows(seq, k, size):
    """(bases, lengths, times, sums) of stretches of ``size`` windows."""
    pieces = [seq[i:i + size + k - 1] for i in range(0, len(seq) - k + 1, size)]
    lens = np.array([len(p) for p in pieces])
    return np.frombuffer("".join(pieces).encode(), np.uint8), lens, np.ones(len(lens), np.int64), np.arange(len(lens)) * size


def test_counting_long_windows_holds_no_row_for_each():
    """What a task holds while it counts a part: some numbers for each window, and not its letters. A process of its own."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import numpy as np
from sitescan.operators import kmer_counts

def most():
    return 1024 * next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("VmHWM"))

seq = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(5).integers(0, 4, 1_000_000, np.uint8)]
bases = np.lib.stride_tricks.sliding_window_view(seq, 42)[::12].reshape(-1)
lens = np.full(len(bases) // 42, 42)
ones, at = np.ones(len(lens), np.int64), np.arange(len(lens)) * 12
for _ in kmer_counts._counted(bases[:420], lens[:10], ones[:10], at[:10], 31):
    pass
before = most()
for _ in kmer_counts._counted(bases, lens, ones, at, 31):
    pass
print((most() - before) / (len(lens) * 12))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert 0 < float(done.stdout) < 120


@pytest.mark.parametrize("hash_bits", [64, 2, 0])
def test_long_windows_of_one_hash_are_told_apart(monkeypatch, hash_bits):
    from sitescan.operators import kmer_counts

    true_hash, mask = kmer_counts.word_hashes, np.uint64(((1 << hash_bits) - 1) << (64 - hash_bits))
    monkeypatch.setattr(kmer_counts, "word_hashes", lambda data, m: true_hash(data, m) & mask)
    monkeypatch.setattr(kmer_counts, "_SLICE", 100)
    monkeypatch.setattr(kmer_counts, "_OUT", 31 * 50)
    r = random.Random(6)
    seq = "".join(r.choices("ACGT", k=200)) * 2 + "N" * 90 + "".join(r.choices("acgt", k=150))
    bases, lens, times, sums = _cut_windows(seq, 31, 7)
    times, sums = times * 3, sums * 3
    want = {}
    for at in range(len(seq) - 30):
        n, total = want.get(seq[at:at + 31], (0, 0))
        want[seq[at:at + 31]] = n + 3, total + 3 * at
    got = [x for b in kmer_counts._counted(bases, lens, times, sums, 31) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert len(got) == len(want) and {w: (n, total) for w, n, total in got} == want


def test_stretches_travel_compressed():
    """The stretches of a part come back from their row as they were, equal ones folded, in two bytes a window at most."""
    import pyarrow as pa

    from sitescan.operators import kmer_counts

    seq = "".join(random.Random(7).choices("acgt", k=100_000)) + "acgtn" * 40
    bases, lens, times, sums = _cut_windows(seq, 31, 10)
    part = np.array([sum(seq[i * 10:i * 10 + n].encode()) % 5 for i, n in enumerate(lens)], np.int32)
    want = {}
    for p, at, n in zip(part.tolist(), sums.tolist(), lens.tolist()):
        many, total = want.get((p, seq[at:at + n]), (0, 0))
        want[p, seq[at:at + n]] = many + 1, total + at
    got, held = {}, 0
    for batch in kmer_counts._packed(part, sums, lens, bases):
        held += batch.nbytes
        for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
            letters, sizes, many, total = kmer_counts._unpacked(*row, pa.Codec("zstd"))
            ends = np.cumsum(sizes)
            for a, b, n, t in zip((ends - sizes).tolist(), ends.tolist(), many.tolist(), total.tolist()):
                assert (p, letters[a:b].tobytes().decode()) not in got
                got[p, letters[a:b].tobytes().decode()] = n, t
    assert got == want and held < 2 * len(seq) and max(n for n, _ in got.values()) > 1


def test_runs_of_one_letter_are_counted_in_blocks(spark, rows, monkeypatch):
    """A heavy part is made of texts without a single known letter: few stretches of many windows each."""
    from sitescan.operators import kmer_counts

    monkeypatch.setattr(kmer_counts, "BLOCK", 500)
    seqs = [(f"n{i}", "N" * (40 + 37 * i)) for i in range(60)] + [("a", "ACGTTGCANN" * 30), ("e", "")]
    chunks = chunk_sequences(spark.createDataFrame(seqs, "chr_n string, seq string"), 1000, 30)
    want = kmers(chunks, 31).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"))
    assert rows(kmer_counts.count_kmers(chunks, 31, heavy=700)) == rows(kmer_counts.count_kmers(chunks, 31)) == rows(want)
    run = np.frombuffer(("N" * 1030).encode(), np.uint8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"chunk_start": [0] * 40, "chunk_len": [1000] * 40, "bases": [run.tobytes()] * 40})
    monkeypatch.setattr(kmer_counts, "_SLICE", 2000)
    blocks = list(kmer_counts._stretches([batch], 31, 13, 256, np.ones(256, bool), 5000))
    assert sum(len(b[0]) for b in blocks) == 40 and max(len(b[3]) for b in blocks) < 5000 + 2000
