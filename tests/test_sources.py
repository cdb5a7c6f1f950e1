import pytest
from pyspark.sql import functions as F

from sitescan import sources as io
from sitescan.operators import (
    contig_lengths, expression_conflicts, extract_sequences, locate_sites, rule_filter, with_ordinal,
)


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_bed(spark, rows, tmp_path):
    path = put(tmp_path, "a.bed", "# made\ntrack name=x\nchr2\t5\t9\tp1\t7\nchr1\t0\t4\tp\"2\t8\n")
    assert rows(io.read_bed(spark, path)) == [("chr1", 0, 4), ("chr2", 5, 9)]
    df = io.read_bed(spark, path, n_cols=4, row_order=True)
    got = with_ordinal(df, "row_ord").orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [("chr2", 5, 9, "p1", 0), ("chr1", 0, 4, 'p"2', 1)]
    with pytest.raises(ValueError):
        io.read_bed(spark, path, n_cols=2)


@pytest.mark.parametrize("line", ["chr1\t7.0\t9", "chr1\tabc\t9", "chr1\t5", "chr1"])
def test_malformed_bed_rows_fail(spark, tmp_path, line):
    path = put(tmp_path, "a.bed", f"browser position\nchr2\t5\t9\n{line}\n")
    with pytest.raises(Exception, match="BED row without whole start and end: chr1"):
        io.read_bed(spark, path).collect()


def test_missing_cells_are_null(spark, rows, tmp_path):
    path = put(tmp_path, "s.csv", "chr_n;pos_ini;score\nchr1;5;NA\nNA;;1.5\nchr2;7;nan\n")
    df = io.read_table(spark, path)
    assert df.dtypes == [("chr_n", "string"), ("pos_ini", "bigint"), ("score", "double")]
    assert rows(df) == [(None, None, 1.5), ("chr1", 5, None), ("chr2", 7, None)]
    assert rows(rule_filter(df, [("score", 1.5)], False), "score") == [(1.5,)]


def test_file_order_over_many_splits(spark, tmp_path):
    """Order by file name and position, although the scan takes large files first and cuts them up."""
    lines = [f"chr{i}\t{i}\t{i + 1}\n" for i in range(4000)]
    put(tmp_path, "part-0.bed", "".join(lines[:100]))
    put(tmp_path, "part-1.bed", "".join(lines[100:3500]))
    put(tmp_path, "part-2.bed", "".join(lines[3500:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = with_ordinal(io.read_bed(spark, str(tmp_path), row_order=True), "row_ord")
        got = df.orderBy("ordinal").select("ordinal", "pos_ini").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == [(i, i) for i in range(4000)]


def test_table_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame(
        [("chr1", 1, None, 'a"b;c'), ("chr2", 2, 0.5, None)], "chr_n string, pos_ini bigint, score_pssm double, t string"
    )
    path = str(tmp_path / "deep" / "out")
    io.write_table(df, path)
    io.write_table(df, path, order_by=["pos_ini"])
    back = io.read_table(spark, path)
    assert back.columns == df.columns and rows(back) == rows(df)
    typed = io.read_table(spark, path, schema="chr_n string, pos_ini string, score_pssm double, t string")
    assert dict(typed.dtypes)["pos_ini"] == "string"
    text = sorted(r["value"] for r in spark.read.text(path).collect() if r["value"].startswith("chr2"))
    assert text == ["chr2;2;0.5;"]


def test_expression_file(spark, rows, tmp_path):
    path = put(tmp_path, "e.csv", "id;a;name;fc\ng1|g2;x;n1;1\ng1;x;n1;2\ng4;x;n2;bad\n g5 ;x;n2;\n;x;n2;0\n")
    got = dict(rows(io.read_expression(spark, path, 0, 3)))
    assert got.pop("g5") != 0 and got == {"g1": 2.0, "g2": 2.0, "nan": 0.0}
    assert rows(expression_conflicts(io.read_expression_rows(spark, path, 0, 3))) == [("g1", 2.0, 1)]
    ann = spark.createDataFrame([("e1", "n1"), ("e2", "n1")], "gene_id string, gene_name string")
    assert rows(io.read_expression(spark, path, 0, 3, 2, ann)) == [("e1", 2.0), ("e2", 2.0)]
    with pytest.raises(ValueError):
        io.read_expression(spark, path, 0, 3, 2)


FASTA = ">c1 x>y\r\nACGTACGTAC\nGGGTTT\n\nAC\n>c2\n\nTTTTAAAA CCCC\nGGGGTTTT\n>c3\nA\n"
RECORDS = [("c1", "ACGTACGTACGGGTTTAC"), ("c2", "TTTTAAAACCCCGGGGTTTT"), ("c3", "A")]


@pytest.mark.parametrize("split", ["7", "16", "128MB"])
def test_fasta_over_splits(spark, rows, tmp_path, split):
    path = put(tmp_path, "a.fa", FASTA)
    put(tmp_path, "b.fa", ">d1\nCC\nAA\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert rows(io.read_fasta(spark, path)) == RECORDS
        both = rows(io.read_fasta(spark, str(tmp_path)))
        chunks = io.read_fasta_chunks(spark, str(tmp_path), size=4, overlap=3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert both == RECORDS + [("d1", "CCAA")]
    for name, seq in both:
        mine = sorted((r for r in chunks if r["chr_n"] == name), key=lambda r: r["chunk_id"])
        assert [r["chunk_start"] for r in mine] == list(range(0, len(seq), 4))
        assert all(bytes(r["bases"]).decode() == seq[r["chunk_start"]:r["chunk_start"] + 7] for r in mine)
        assert sum(r["chunk_len"] for r in mine) == len(seq)


def test_fasta_named_by_file(spark, rows, tmp_path):
    put(tmp_path, "hg19_chr1.fasta", ">whatever\nACGT\n")
    put(tmp_path, "hg19_chr2.fasta", ">a\nACGT\n>b\nAC\n")  # two records: not a chromosome file
    put(tmp_path, "mm9_chr3.fasta", ">a\nACGT\n")
    assert rows(io.read_fasta(spark, str(tmp_path), genome="hg19")) == [("chr1", "ACGT")]


def test_fasta_edges(spark, rows, tmp_path):
    path = put(tmp_path, "a.fa", ">c1\nACGT\n>empty\n>c2\nGG\n>last\n")
    chunks = io.read_fasta_chunks(spark, path, size=4, overlap=3)
    assert rows(contig_lengths(chunks)) == [("c1", 4), ("c2", 2), ("empty", 0), ("last", 0)]
    assert rows(io.read_fasta(spark, path)) == [("c1", "ACGT"), ("c2", "GG"), ("empty", ""), ("last", "")]
    twice = put(tmp_path, "b.fa", ">c1\nAAAA\nCC\n>c1\nGGGGGG\n")
    for use in (lambda: io.read_fasta_chunks(spark, twice), lambda: contig_lengths(io.read_fasta_chunks(spark, twice)),
                lambda: io.read_fasta(spark, twice)):
        with pytest.raises(Exception, match="more than one FASTA record is called c1"):
            use().collect()


def test_fasta_writer_keeps_the_order(spark, rows, tmp_path):
    chunks = io.read_fasta_chunks(spark, put(tmp_path, "a.fa", FASTA), size=4, overlap=3)
    sites = spark.range(60).selectExpr("id + 1 as ordinal", "'c2' as chr_n", "1 + id % 5 as pos_ini", "8L as pos_end")
    seqs = extract_sequences(locate_sites(sites, contig_lengths(chunks)), chunks, 4)
    out = str(tmp_path / "out")
    io.write_fasta(seqs.select("ordinal", F.concat(F.lit("r"), "ordinal").alias("id"), "seq").repartition(7), out)
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0::2] == [f">r{i}" for i in range(1, 61)]
    assert lines[1::2] == [RECORDS[1][1][i % 5:8] for i in range(60)]


def test_motif_files(spark, rows, tmp_path):
    put(tmp_path, "A.pcm", "> A\n8\t0\t0\t0\n0 8 0 0\n")
    put(tmp_path, "B.pcm", "# made\n1 8 0 0 1.5\n2 0 0 0 8\n\n>B2\n1 1 1 1\n")
    counts = io.read_motif_counts(spark, str(tmp_path))
    assert rows(counts.where("count > 0"), "motif", "motif_ord", "pos", "base", "count") == [
        ("A.pcm", 0, 0, "A", 8.0), ("A.pcm", 0, 1, "C", 8.0),
        ("B.pcm", 1, 0, "A", 8.0), ("B.pcm", 1, 0, "T", 1.5), ("B.pcm", 1, 1, "T", 8.0),
    ]
    every = io.read_motif_counts(spark, str(tmp_path), first_only=False)
    assert rows(every.select("motif", "motif_ord").distinct()) == [("A.pcm", 0), ("B.pcm", 1), ("B.pcm:B2", 2)]
    named = io.read_motifs(spark, str(tmp_path), names={"B.pcm": "TB", "A.pcm": "TA"})
    assert rows(named.select("motif", "motif_ord").distinct()) == [("TA", 1), ("TB", 0)]
    (best,) = named.where("motif = 'TA' and pos = 0 and base = 'A'").collect()
    assert round(best["log_odds"], 6) == 1.765535
    put(tmp_path, "C.pcm", "no numbers here\n")
    with pytest.raises(ValueError, match="C.pcm"):
        io.read_motifs(spark, str(tmp_path))


def test_annotation(spark, rows, tmp_path):
    gtf = (
        "#!made\n"
        '1\tsrc\tgene\t100\t200\t.\t+\t.\tgene_id "E1"; gene_name "N1"; gene_biotype "protein_coding";\n'
        '1\tsrc\texon\t90\t250\t.\t+\t.\tgene_id "E1"; gene_name "N1"; gene_biotype "other";\n'
        'chr2\tprotein_coding\texon\t10\t20\t.\t-\t.\tgene_id "E2"; transcript_id "T"; gene_name "N2";\n'
        'chr2\tnonsense\texon\t5\t12\t.\t-\t.\tgene_id "E2"; transcript_id "T"; gene_name "N2";\n'
    )
    assert rows(io.read_annotation(spark, put(tmp_path, "a.gtf", gtf))) == [
        ("E1", "N1", "1", 100, 200, "+", "protein_coding"), ("E2", "N2", "2", 5, 20, "-", "protein_coding"),
    ]


@pytest.mark.parametrize("piece", [1, 7, 60, 1 << 16])
def test_fasta_pieces(piece):
    from sitescan.sources.fasta import _pieces_of

    lines = [
        (1, 0, b"lost", None), (1, 0, b">a one", None), (1, 0, b"ACG T", None), (1, 0, b"", None), (1, 0, b"AAAA\t", None),
        (1, 0, b">b", None), (1, 0, b">", None), (1, 0, b"CC" * 40, None), (1, 90, b"GG", None), (1, 90, b">c", None),
        (2, 0, b"TT", "own"), (2, 0, b">x", "own"), (2, 0, b"A", "own"),
    ]
    records: dict = {}
    last = {}
    for file, block, row, title, name, head, cum, n, bases in _pieces_of(iter(lines), piece):
        assert row == last.get((file, block), 0) + 1 and n == len(bases or b"") and n <= piece
        last[file, block] = row
        assert (bases is None) == (title is not None)
        records.setdefault((file, block, name), []).append(bases or b"")
    assert {k: b"".join(v) for k, v in records.items()} == {
        (1, 0, None): b"lost", (1, 0, "a"): b"ACGTAAAA", (1, 0, "b"): b"", (1, 0, ""): b"CC" * 40, (1, 90, None): b"GG",
        (1, 90, "c"): b"", (2, 0, None): b"TT", (2, 0, "own"): b"A",
    }


def test_a_contig_over_many_splits_crosses_one_shuffle(spark, tmp_path):
    import random

    draw = random.Random(2)
    seqs = {name: "".join(draw.choice("ACGTN") for _ in range(n)) for name, n in (("big", 60_000), ("small", 90), ("none", 0))}
    path = tmp_path / "g.fa"
    path.write_text("".join(f">{k} text\n" + "\n".join(s[i:i + 61] for i in range(0, len(s), 61)) + "\n" for k, s in seqs.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        chunks = io.read_fasta_chunks(spark, str(path), size=500, overlap=20)
        plan = chunks._jdf.queryExecution().executedPlan().toString()
        got = {(r.chr_n, r.chunk_id): bytes(r.bases).decode() for r in chunks.collect()}
        shuffled = [line for line in plan.splitlines() if "Exchange" in line and "_piece" in line]
        assert len(shuffled) <= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(k, c): s[c * 500:c * 500 + 520] for k, s in seqs.items() for c in range(max(1, -(-len(s) // 500)))}
