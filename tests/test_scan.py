import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitescan.functions import reverse_complement
from sitescan.operators import (
    chunk_sequences, contig_lengths, locate_sites, motif_cutoffs, motif_log_odds, scan, scan_motifs, scan_words,
    site_hits,
)
from sitescan.operators.motifs import motif_rows
from sitescan.operators.scan import Lanes, WordIndex, _Bases, _scored
from sitescan.plans.generate import window_overlap

SEQ = "chr_n string, seq string"
SITE = "peak_id bigint, chr_n string, pos_ini bigint, pos_end bigint"


def chunks_of(spark, seqs, size=4096, overlap=63):
    return chunk_sequences(spark.createDataFrame(list(seqs.items()), SEQ), size, overlap)


def pair_motif(spark):
    counts = [("m", 0, "A", 8.0), ("m", 1, "C", 8.0)]
    return motif_log_odds(spark.createDataFrame(counts, "motif string, pos int, base string, count double"))


def random_motifs(spark, seed=5):
    r = random.Random(seed)
    cells = [
        (name, k, p, b, float(r.choice([0, 1, 2, 30])))
        for k, (name, length) in enumerate([("m5", 5), ("m7", 7), ("m13", 13)])
        for p in range(length) for b in "ACGT"
    ]
    return motif_log_odds(
        spark.createDataFrame(cells, "motif string, motif_ord int, pos int, base string, count double")
    )


def words_in_peak(spark, seq, words, start):
    """Hits of a peak that covers a whole sequence lying at ``start`` of its contig."""
    chunks = chunks_of(spark, {"c": "N" * (start - 1) + seq})
    peak = spark.createDataFrame([(0, "c", start, start + len(seq) - 1)], SITE)
    located = locate_sites(peak, contig_lengths(chunks))
    found = site_hits(located, scan_words(chunks, words))
    return sorted((r["hit_pos_ini"], r["hit_pos_end"], r["hit_seq"]) for r in found.collect())


def test_word_scan_known_values(spark):
    assert words_in_peak(spark, "AAGCAAGTGAAcacttgc", ["GCAAGTG"], 101) == [
        (103, 109, "GCAAGTG"), (112, 118, "CACTTGC")
    ]
    assert words_in_peak(spark, "TACGTA", ["ACGT"], 1) == [(2, 5, "ACGT")]
    assert words_in_peak(spark, "AAAA", ["AAA"], 1) == [(1, 3, "AAA"), (2, 4, "AAA")]
    assert len(words_in_peak(spark, "AAAA", ["AAA", "TTT"], 1)) == 4
    assert words_in_peak(spark, "AA", ["AAA"], 1) == []
    assert words_in_peak(spark, "ANTG", ["NTG"], 1) == [(2, 4, "NTG")]
    with pytest.raises(ValueError):
        words_in_peak(spark, "AAAA", [""], 1)


def motifs_in_peak(spark, seq, start, **kwargs):
    chunks = chunks_of(spark, {"c": "N" * (start - 1) + seq})
    peak = spark.createDataFrame([(0, "c", start, start + len(seq) - 1)], SITE)
    hits = scan_motifs(chunks, pair_motif(spark))
    found = site_hits(locate_sites(peak, contig_lengths(chunks)), hits, **kwargs).collect()
    return sorted((r["hit_pos_ini"], r["hit_pos_end"], r["hit_seq"], round(r["hit_score"], 6)) for r in found)


def test_motif_scan_known_values(spark):
    assert motifs_in_peak(spark, "TACGTT", 11) == [(11, 12, "AC", 3.531069), (13, 14, "GT", 3.531069)]
    assert motifs_in_peak(spark, "TACGTT", 11, one_based=True)[0][0] == 12
    # The reverse hit in the last window keeps its bases.
    assert motifs_in_peak(spark, "TTGT", 11) == [(12, 13, "GT", 3.531069)]
    # A sequence of exactly the motif's length is scanned like any other; case is kept.
    assert motifs_in_peak(spark, "ac", 11) == [(10, 11, "ac", 3.531069)]
    assert motifs_in_peak(spark, "A", 11) == []


def test_palindromic_motif_hits_on_both_strands(spark, rows):
    cells = [("p", 0, "A", 8.0), ("p", 1, "T", 8.0)]
    motif = motif_log_odds(spark.createDataFrame(cells, "motif string, pos int, base string, count double"))
    got = scan_motifs(chunks_of(spark, {"c": "GATC"}), motif)
    assert rows(got, "start", "strand") == [(1, "+"), (1, "-")]


def test_cutoffs(spark):
    (row,) = motif_cutoffs(pair_motif(spark), 0.9).collect()
    assert (round(row["max_score"], 6), round(row["cutoff"], 6)) == (3.531069, 3.177963)


def brute_motifs(seqs, motifs, mult):
    tables = {}
    for r in motifs.collect():
        tables.setdefault(r["motif"], {})[(r["pos"], r["base"])] = r["log_odds"]
    out = []
    for name, t in tables.items():
        length = 1 + max(p for p, _ in t)
        cut = mult * sum(max(t[p, b] for b in "ACGT") for p in range(length))
        for c, s in seqs.items():
            for i in range(len(s) - length + 1):
                w = s[i:i + length].upper()
                for strand, v in (("+", w), ("-", reverse_complement(w))):
                    if set(v) <= set("ACGT") and sum(t[p, b] for p, b in enumerate(v)) >= cut:
                        out.append((c, i, s[i:i + length], strand, name))
    return sorted(out, key=lambda t: [str(x) for x in t])


def random_dna(seed=6):
    r = random.Random(seed)
    return {f"c{n}": "".join(r.choices("ACGTacgtN", [9, 9, 9, 9, 3, 3, 3, 3, 1], k=n)) for n in (3, 12, 13, 400, 3000)}


@pytest.mark.parametrize("size,overlap", [(5, 12), (100, 40), (4096, 63)])
def test_motif_scan_equals_brute_force(spark, rows, size, overlap):
    seqs, motifs = random_dna(), random_motifs(spark)
    want = brute_motifs(seqs, motifs, 0.6)
    cols = ["chr_n", "start", "seq", "strand", "tf_name"]
    for method in ("arrow", "native"):
        got = scan_motifs(chunks_of(spark, seqs, size, overlap), motifs, 0.6, method=method)
        assert want and rows(got, *cols) == want


def test_scores_agree_to_the_last_bit(spark, rows):
    seqs, motifs = random_dna(), random_motifs(spark)
    chunks = chunks_of(spark, seqs)
    cols = ["chr_n", "start", "strand", "tf_name", "hit_ord", "hit_len", "score_pssm"]
    for single in (False, True):
        a = rows(scan_motifs(chunks, motifs, 0.6, float32=single), *cols)
        assert a == rows(scan_motifs(chunks, motifs, 0.6, float32=single, method="native"), *cols)
        assert all(float(np.float32(r[-1])) == r[-1] for r in a) == single


@pytest.mark.parametrize("size,overlap", [(3, 6), (64, 10), (4096, 63)])
def test_word_scan_equals_brute_force(spark, rows, size, overlap):
    seqs = random_dna()
    words = ["ACGTA", "acg", "TACGTA", "GATC", "ACG", "NA"]
    want = sorted(
        (
            (c, i, s[i:i + len(w)].upper(), k)
            for k, w in enumerate(words) for c, s in seqs.items() for i in range(len(s) - len(w) + 1)
            if s[i:i + len(w)].upper() in (w.upper(), reverse_complement(w))
        ),
        key=lambda t: [str(x) for x in t],
    )
    for method in ("arrow", "native"):
        got = scan_words(chunks_of(spark, seqs, size, overlap), words, method)
        assert rows(got, "chr_n", "start", "seq", "hit_ord") == want


@pytest.mark.parametrize("length", [5, 40])
def test_word_lists_of_any_length_take_one_pass(spark, rows, length):
    r = random.Random(8)
    dna = random_dna()
    dna["c3000"] = dna["c3000"].replace("N", "A")
    words = ["".join(r.choices("ACGT", k=length)) for _ in range(1500)] + ["ACGTN" * (length // 5), "NACGT" * (length // 5)]
    words += [dna["c3000"][i:i + length].upper() for i in range(0, 2000, 97)] * 2
    # Words that agree in all that a 64-bit number holds.
    words += [words[-1][:-1] + b for b in "ACGT"]
    chunks = chunks_of(spark, dna, 500)
    got = scan(chunks, words=words)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The one Generate cuts the sequences into chunks.
    assert plan.count("MapInArrow") == 1 and plan.count("Generate") == 1 and "Join" not in plan
    cols = ["chr_n", "start", "seq", "hit_ord", "strand"]
    assert rows(got, *cols) == rows(scan_words(chunks, words, "native"), *cols) != []


def test_windows_longer_than_the_usual_overlap(spark, rows):
    seqs = random_dna()
    word = seqs["c3000"][1000:1080].upper().replace("N", "A")
    seqs["x"] = "T" * 3 + word.lower() + "G" + reverse_complement(word)
    chunks = chunks_of(spark, seqs, 50, window_overlap([word]))
    got = rows(scan_words(chunks, [word]).where("chr_n = 'x'"), "start", "strand")
    assert got == [(3, "+"), (84, "-")]
    r = random.Random(9)
    cells = [("long", p, b, float(r.choice([1, 2, 3]))) for p in range(70) for b in "ACGT"]
    motif = motif_log_odds(spark.createDataFrame(cells, "motif string, pos int, base string, count double"))
    want = brute_motifs(seqs, motif, 0.25)
    found = scan_motifs(chunks_of(spark, seqs, 50, window_overlap(motifs=motif)), motif, 0.25)
    assert want and rows(found, "chr_n", "start", "seq", "strand", "tf_name") == want
    with pytest.raises(ValueError, match="overlap of 69"):
        scan_motifs(chunks_of(spark, seqs), motif)


def test_no_pseudocount(spark, rows):
    counts = [("m", 0, "A", 8.0), ("m", 1, "C", 4.0), ("m", 1, "G", 4.0)]
    frame = spark.createDataFrame(counts, "motif string, pos int, base string, count double")
    odds = motif_log_odds(frame, pseudocount=0.0)
    assert rows(odds.where("base in ('A', 'T')"), "pos", "base", "log_odds") == [
        (0, "A", 2.0), (0, "T", float("-inf")), (1, "A", float("-inf")), (1, "T", float("-inf")),
    ]
    assert rows(scan_motifs(chunks_of(spark, {"c": "ACAGATTT"}), odds), "start", "strand", "score_pssm") == [
        (0, "+", 3.0), (2, "+", 3.0),
    ]


def test_word_hits_equal_those_of_the_reverse_complement(spark, rows):
    chunks = chunks_of(spark, random_dna())
    for w in ("GCA", "ACGT"):
        a = rows(scan_words(chunks, [w]), "chr_n", "start", "seq")
        assert a == rows(scan_words(chunks, [reverse_complement(w)]), "chr_n", "start", "seq")


def test_motifs_too_many_for_a_task_give_the_same_hits(spark, rows):
    chunks, motifs = chunks_of(spark, random_dna(), 100), random_motifs(spark)
    whole, parts = scan(chunks, motifs=motifs, score_mult=0.6), scan(chunks, motifs=motifs, score_mult=0.6, max_cells=30)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 1 and "Exchange" not in plan and "Generate" not in plan.split("MapInArrow")[0]
    assert rows(whole) == rows(parts) != []
    unnamed = motifs.drop("motif_ord")
    assert rows(scan(chunks, motifs=unnamed)) == rows(scan(chunks, motifs=unnamed, max_cells=30))


def test_cutoffs_reported_and_applied_are_the_same(spark):
    motifs = random_motifs(spark)
    told = {r["motif"]: r["cutoff"] for r in motif_cutoffs(motifs, 0.6).collect()}
    assert {r["motif"]: r["cutoff"] for r in motif_rows(motifs, 0.6).collect()} == told


def test_words_and_motifs_in_one_pass(spark, rows):
    chunks, motifs = chunks_of(spark, random_dna()), random_motifs(spark)
    both = scan(chunks, ["ACG"], motifs, 0.6)
    apart = scan_words(chunks, ["ACG"]).unionByName(scan_motifs(chunks, motifs, 0.6))
    assert rows(both) == rows(apart)
    assert scan(chunks).count() == 0


def test_a_motif_without_all_weights_is_refused(spark):
    motifs = pair_motif(spark).where("base <> 'G'")
    with pytest.raises(ValueError, match="lacks a weight"):
        scan_motifs(chunks_of(spark, {"c": "ACGT"}), motifs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTNacgt", max_size=25), min_size=1, max_size=6), st.integers(1, 9), st.floats(-8, 12))
def test_windows_never_cross_a_chunk(seqs, length, cutoff):
    weights = np.random.default_rng(length).normal(size=(length, 4))
    data = np.frombuffer("".join(seqs).encode(), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(s) for s in seqs])
    bases = _Bases(data, offsets, np.array([max(len(s) - 2, 0) for s in seqs]))
    at, row, score = _scored(bases, Lanes([(weights, cutoff)], False).propose(bases)[0], weights, cutoff, False)
    want = []
    for k, s in enumerate(seqs):
        for i in range(min(len(s) - length + 1, max(len(s) - 2, 0))):
            w = s[i:i + length].upper()
            if "N" not in w:
                total = 0.0
                for j, b in enumerate(w):
                    total += weights[j, "ACGT".index(b)]
                if total >= cutoff:
                    want.append((offsets[k] + i, k, total))
    assert list(zip(at, row, score)) == want


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.text("ACGTNacgt", max_size=40), min_size=1, max_size=6),
    st.lists(st.text("ACGTN", min_size=1, max_size=20), min_size=1, max_size=30),
)
def test_word_index_equals_a_letter_by_letter_search(seqs, words):
    data = np.frombuffer("".join(seqs).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    index, text = WordIndex(words), "".join(seqs).upper()
    at, form = index.find(_Bases(data, offsets, np.array([len(s) for s in seqs])))
    forms = sorted({f for w in words for f in (w, reverse_complement(w))})
    want = sorted((i, k) for k, f in enumerate(forms) for i in range(len(text)) if text.startswith(f, i))
    assert sorted(zip(at.tolist(), form.tolist())) == want


def test_words_of_mixed_lengths_and_letters(spark):
    draw = random.Random(9)
    seq = "".join(draw.choice("ACGTacgtN") for _ in range(9000))
    words = [seq[a:a + k].upper() for k in (1, 3, 8, 9, 11, 12, 13, 15, 16, 17, 40) for a in (5, 777, 4090)] + ["NNN", "ANT"]
    got = sorted((r.start, r.seq, r.strand, r.hit_ord) for r in scan_words(chunks_of(spark, {"c": seq}, 4096), words).collect())
    text = seq.upper()
    want = []
    for order, word in enumerate(words):
        other = reverse_complement(word)
        for form, strand in [(word, "+")] + ([(other, "-")] if other != word else []):
            want += [(i, form, strand, order) for i in range(len(text)) if text.startswith(form, i)]
    assert got == sorted(want)


def test_index_of_many_words_takes_linear_time():
    draw = np.random.default_rng(1)
    letters = np.array(list("ACGTN"))
    words = ["".join(letters[draw.integers(0, 5 if i % 20 == 0 else 4, 8 + i % 23)]) for i in range(65_000)]
    import time

    start = time.perf_counter()
    index = WordIndex(words)
    assert time.perf_counter() - start < 20 and len(index.tables) == 3
    seq = "".join(words[::650])
    data = np.frombuffer(seq.encode(), np.uint8)
    at, form = index.find(_Bases(data, np.array([0, len(seq)]), np.array([len(seq)])))
    starts = np.cumsum([0] + [len(w) for w in words[::650]])
    forms = sorted({f for w in words for f in (w, reverse_complement(w))})
    assert {(int(a), w) for a, w in zip(starts, words[::650])} <= {(int(a), forms[f]) for a, f in zip(at, form)}


def test_panel_of_many_motifs_equals_one_by_one(spark, rows):
    r = random.Random(11)
    cells = [
        (f"m{k}", k, p, b, float(r.choice([0, 1, 2, 30]))) for k in range(90) for p in range(3 + k % 17) for b in "ACGT"
    ]
    motifs = motif_log_odds(spark.createDataFrame(cells, "motif string, motif_ord int, pos int, base string, count double"))
    seq = "".join(r.choice("ACGTacgtN") for _ in range(3000))
    chunks = chunks_of(spark, {"c": seq, "d": seq[:5]}, 700).cache()
    assert rows(scan(chunks, motifs=motifs, score_mult=0.6)) == rows(scan(chunks, motifs=motifs, score_mult=0.6, max_cells=1))
    one = sorted(tuple(x) for x in scan_motifs(chunks, motifs.where("motif_ord < 8"), 0.6, method="native").collect())
    assert one == sorted(tuple(x) for x in scan(chunks, motifs=motifs, score_mult=0.6).where("hit_ord < 8").collect())
    chunks.unpersist()
