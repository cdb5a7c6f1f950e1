"""The three jobs over files, one feeding the next, against small hand-made expectations."""

import pytest

from sitescan import plans
from sitescan import sources as io
from sitescan.operators import chunk_sequences
from sitescan.session import scratch


@pytest.fixture
def inputs(tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    chr1 = "TTTT" + "TACGTT" + "N" * 90 + "AAGCAAGTGAAcacttgc" + "T" * 50
    chr2 = "G" * 30
    return {
        "bed": put("p.bed", "chr1\t5\t10\nchrZ\t1\t9\nchr1\t101\t118\nchr2\t3\t20\n"),
        "expr": put("e.csv", "id;a;b;fc\nE1;;;1\nE2;;;-1\nE3;;;0\n"),
        "gtf": put("a.gtf", "".join(
            f'{c}\ts\tgene\t{a}\t{b}\t.\t{s}\t.\tgene_id "{g}"; gene_name "{g}"; gene_biotype "{t}";\n'
            for c, a, b, s, g, t in [
                ("1", 20, 30, "+", "E1", "protein_coding"), ("1", 40, 60, "-", "E2", "protein_coding"),
                ("1", 10, 12, "+", "E3", "protein_coding"), ("1", 10, 12, "+", "E4", "lincRNA"),
                ("1", 90, 95, "+", "E5", "protein_coding"),
            ]
        )),
        "fasta": put("g.fa", f">chr1\n{chr1[:60]}\n{chr1[60:]}\n>chr2\n{chr2}\n"),
        "motif": put("m/ac.pcm", ">m\n8 0 0 0\n0 8 0 0\n"),
        "out": str(tmp_path / "out"),
        "chr1": chr1,
    }


def lines(path):
    from pathlib import Path

    parts = [p.read_text().splitlines() for p in sorted(Path(path).glob("part-*"))]
    body = [line for p in parts for line in p[1:]]
    return next(p[0] for p in parts if p), body


def generate(spark, inputs, **kwargs):
    return plans.run_generate(
        spark, inputs["bed"], inputs["expr"], inputs["gtf"], inputs["fasta"], inputs["out"] + "/x",
        motif_path=inputs["motif"], words=["GCAAGTG"], dist=40, **kwargs,
    )


def test_generate(spark, inputs):
    tables = generate(spark, inputs)
    # One of the four peaks lies on a chromosome without a sequence.
    assert tables.counts == {"n_sites": 4, "n_skipped": 1, "n_rows": 3, "n_ids": 3, "n_genes": 3}
    head, body = lines(inputs["out"] + "/x_peaks")
    assert head == "chr_n;pos_ini;pos_end;n_genes;n_su;n_su_list;n_su_pssm;n_updown_total;n_upreg;n_downreg"
    # chrZ has no sequence and leaves all tables; E3 counts as changed although it is 0; E4 is not coding.
    assert body == ["chr1;5;10;3;2;0;2;3;1;1", "chr1;101;118;1;5;2;3;0;0;0", "chr2;3;20;0;0;0;0;0;0;0"]
    head, body = lines(inputs["out"] + "/x_binding_sites")
    assert head == "chr_n;pos_ini;pos_end;seq;source;score_pssm;n_genes_near;n_updown_total;n_upreg;n_downreg"
    cut = [b.split(";") for b in body]
    assert [(c[1], c[2], c[3], c[4], c[5][:8]) for c in cut] == [
        # The reverse hit comes first, and motif hits lie one lower than word hits.
        ("7", "8", "GT", "pssm", "3.531069"), ("5", "6", "AC", "pssm", "3.531069"),
        ("103", "109", "GCAAGTG", "list", ""), ("112", "118", "CACTTGC", "list", ""),
        ("106", "107", "GT", "pssm", "3.531069"), ("110", "111", "Ac", "pssm", "3.531069"),
        ("112", "113", "ac", "pssm", "3.531069"),
    ]
    assert [c[6:] for c in cut] == [["3", "3", "1", "1"]] * 2 + [["1", "0", "0", "0"]] * 5
    _, body = lines(inputs["out"] + "/x_genes")
    assert body == [
        # By the first peak near them, then by their start.
        "E3;chr1;10;protein_coding;0.0", "E1;chr1;20;protein_coding;2.0", "E2;chr1;60;protein_coding;-2.0",
        "E5;chr1;90;protein_coding;",
    ]


def test_generate_options(spark, inputs):
    one = generate(spark, inputs, test_mode=1, seed=3)
    assert one.peaks.count() <= 1
    strict = generate(spark, inputs, score_cutoff=99.0)
    assert strict.sites.where("source = 'pssm'").count() == 0
    assert strict.peaks.count() == 3


def test_fasta_export(spark, inputs, tmp_path):
    from pathlib import Path

    (tmp_path / "s.csv").write_text("c;a;b;keep\nchr1;5;10;y\nchr1;1;2;n\nchrZ;1;9;y\nchr1;101;109;y\n")
    out = inputs["out"] + "/fa"
    kept = plans.run_fasta_export(
        spark, str(tmp_path / "s.csv"), inputs["fasta"], out, rules=[(3, "n")], length=0
    )
    text = "".join(p.read_text() for p in sorted(Path(out).glob("part-*")))
    # The ordinal counts the site without a sequence.
    assert text == ">1_chr1_5_10\nTACGTT\n>3_chr1_101_109\nAAGCAAGTG\n"
    assert sorted(r["ordinal"] for r in kept.collect()) == [1, 2, 3]
    included = plans.run_fasta_export(
        spark, str(tmp_path / "s.csv"), inputs["fasta"], out, rules=[("keep", "n")], default_pass=False, length=9
    )
    assert [tuple(r)[:3] for r in included.collect()] == [("chr1", -3, 6)]


def test_cooccupancy(spark, inputs):
    generate(spark, inputs)
    out = inputs["out"]
    tables = plans.run_cooccupancy(
        spark, out + "/x_binding_sites", out + "/x_genes", inputs["fasta"], inputs["motif"], out + "/y",
        names={"ac.pcm": "AC"}, dist_sites=3, dist_genes=30, score_report=True,
    )
    head, body = lines(out + "/y_sites_genes")
    assert head.endswith(";n_downreg;str_genes_rnaseq_near;AC")
    first, third = body[0].split(";"), body[2].split(";")
    # Labels are inherited inverted; origin 20 is inside (7 - 30, 8 + 30), 60 is not.
    assert first[-2:] == ["E3_downreg,E1_downreg", "1"]
    assert third[-2:] == ["E5_downreg", "1"]
    head, body = lines(out + "/y_other_tf")
    names = head.split(";")
    row = dict(zip(names, body[0].split(";")))
    # The site's own values win over the hit's, which stay under hit_ names.
    assert (row["pos_ini"], row["seq"], row["source"], row["tf_name"]) == ("7", "GT", "pssm", "AC")
    assert (row["hit_pos_ini"], row["hit_seq"]) == ("7", "GT")
    assert tables.sites.count() == 7
    assert tables.skipped.collect()[0].n_skipped == 0


def test_genes_keep_the_order_of_the_peaks(spark, inputs, tmp_path):
    (tmp_path / "p.bed").write_text("chr1\t101\t118\nchr1\t5\t10\n")
    generate(spark, inputs)
    assert [b.split(";")[0] for b in lines(inputs["out"] + "/x_genes")[1]] == ["E5", "E3", "E1", "E2"]


def test_sites_without_a_sequence_are_counted(spark, inputs, tmp_path):
    (tmp_path / "s.csv").write_text("chr_n;pos_ini;pos_end\nchr1;5;10\nchrZ;1;9\n;1;9\n")
    (tmp_path / "g.csv").write_text("gene_id;chr_n;pos0;biotype;fold_change\n")
    tables = plans.run_cooccupancy(
        spark, str(tmp_path / "s.csv"), str(tmp_path / "g.csv"), inputs["fasta"], inputs["motif"], inputs["out"] + "/z"
    )
    assert (tables.skipped.first().n_skipped, tables.sites.count()) == (2, 1)


def test_empty_sequences_keep_their_peaks(spark, inputs):
    with open(inputs["fasta"], "a") as f:
        f.write(">chrZ\n")
    generate(spark, inputs)
    assert "chrZ;1;9;0;0;0;0;0;0;0" in lines(inputs["out"] + "/x_peaks")[1]


def test_words_of_any_length(spark, inputs):
    word = inputs["chr1"][100:190].replace("N", "A")
    tables = plans.run_generate(
        spark, inputs["bed"], inputs["expr"], inputs["gtf"], inputs["fasta"], inputs["out"] + "/w", words=[word, "GCAAGTG"],
    )
    assert tables.sites.count() == 2


def test_a_job_releases_its_folder(spark, inputs):
    from pathlib import Path

    with scratch(spark) as folder:
        generate(spark, inputs)
        assert list(Path(folder).glob("stage-*"))
    assert not Path(folder).exists() and lines(inputs["out"] + "/x_peaks")[1]


def test_cooccupancy_refuses_clashing_names(spark):
    sites = spark.createDataFrame([(0, "c", 1, 2, 5)], "site_id bigint, chr_n string, pos_ini bigint, pos_end bigint, AC int")
    chunks = chunk_sequences(spark.createDataFrame([("c", "ACGT")], "chr_n string, seq string"))
    with pytest.raises(ValueError, match="AC"):
        plans.cooccupancy(sites, None, chunks, None, ["AC"])


def test_site_columns_by_ordinal(spark, inputs):
    sites = spark.createDataFrame([(0, "chr1", 5, 10)], "site_id bigint, where_chr string, a int, b int")
    genes = spark.createDataFrame([("g", "chr1", 9, "x", 1.0)], io.tables.GENES_SCHEMA)
    chunks = chunk_sequences(spark.createDataFrame([("chr1", inputs["chr1"])], "chr_n string, seq string"))
    motifs = io.read_motifs(spark, inputs["motif"])
    got = plans.cooccupancy(sites, genes, chunks, motifs, ["ac.pcm"], 0, 10)
    assert [tuple(r) for r in got.sites.collect()] == [(0, "chr1", 5, 10, "g_downreg", 1)]
    hit = got.other_tf.orderBy("hit_pos_ini").first()
    assert (hit["chr_n"], hit["pos_ini"], hit["where_chr"], hit["a"]) == ("chr1", 5, "chr1", 5)
