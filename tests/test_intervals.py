import random

import pytest
from pyspark.sql import functions as F

from sitescan.operators import annotate_expression, distinct_genes, first_peaks, gene_string, genes_around, nearby_genes, peak_gene_stats

PEAK = "peak_id bigint, chr_n string, pos_ini bigint, pos_end bigint"
GENE = "gene_id string, gene_name string, contig string, g_start bigint, g_end bigint, strand string, biotype string"


def make(spark, seed=1, n=300, m=120, span=60_000):
    r = random.Random(seed)
    peaks = []
    for i in range(n):
        ini = r.randint(-500, span)
        width = r.choice([0, 200, 200, 9000, 40_000, -300])
        peaks.append((i, f"chr{r.randint(1, 3)}", ini, ini + width))
    genes = []
    for j in range(m):
        a = r.randint(1, span)
        genes.append((
            f"g{j}", f"n{j % 50}", str(r.randint(1, 4)), a, a + r.choice([10, 3000, 50_000]), r.choice("+-"),
            r.choice(["protein_coding", "protein_coding", "lincRNA"]),
        ))
    return peaks, genes


@pytest.mark.parametrize("dist,bits", [(0, None), (500, None), (500, 8), (20_000, None), (20_000, 20)])
def test_binned_join_equals_plain_join(spark, rows, dist, bits):
    peaks, genes = make(spark)
    got = rows(
        nearby_genes(spark.createDataFrame(peaks, PEAK), spark.createDataFrame(genes, GENE), dist, bits=bits),
        "peak_id", "gene_id", "pos0",
    )
    want = [
        (p[0], g[0], g[3] if g[5] == "+" else g[4])
        for p in peaks for g in genes
        if g[2] == p[1][3:] and g[6] == "protein_coding" and g[3] <= p[3] + dist and g[4] >= p[2] - dist
    ]
    assert want and got == sorted(want, key=lambda t: [str(x) for x in t])


@pytest.mark.parametrize("dist,bits", [(0, None), (700, 9), (20_000, None)])
def test_point_join_is_strict(spark, rows, dist, bits):
    peaks, genes = make(spark, seed=2)
    table = [(g[0], f"chr{g[2]}", g[3], g[6], None, j) for j, g in enumerate(genes)]
    # Points right on the border must stay out.
    table += [("lo", p[1], p[2] - dist, "x", 1.0, 900 + p[0]) for p in peaks[:5]]
    got = rows(
        genes_around(
            spark.createDataFrame(peaks, PEAK),
            spark.createDataFrame(table, "gene_id string, chr_n string, pos0 bigint, biotype string, fold_change double, gene_ord int"),
            dist, bits=bits,
        ), "peak_id", "gene_id", "gene_ord",
    )
    want = [(p[0], t[0], t[5]) for p in peaks for t in table if t[1] == p[1] and p[2] - dist < t[2] < p[3] + dist]
    assert want and got == sorted(want, key=lambda t: [str(x) for x in t])


def test_overlap_keeps_what_the_strict_join_drops(spark):
    peaks = spark.createDataFrame([(0, "chr1", 2500, 2600)], PEAK)
    genes = spark.createDataFrame([("g", "n", "1", 1000, 2000, "-", "protein_coding")], GENE)
    near = nearby_genes(peaks, genes, 500)
    assert [tuple(r) for r in near.select("gene_id", "pos0").collect()] == [("g", 2000)]
    table = near.select("gene_id", "chr_n", "pos0", "biotype", F.lit(1.0).alias("fold_change"))
    assert genes_around(peaks, table, 500).count() == 0


def test_peak_stats(spark):
    peaks = spark.createDataFrame([(0, "chr1", 100, 200), (1, "chr9", 1, 2)], PEAK)
    genes = spark.createDataFrame([(f"g{i}", "n", "1", 100, 150, "+", "protein_coding") for i in range(5)], GENE)
    expr = spark.createDataFrame(
        [("g0", 2.0), ("g1", -2.0), ("g2", 0.0), ("g3", float("nan"))], "gene_id string, fold_change double"
    )
    stats = peak_gene_stats(peaks, annotate_expression(genes, expr), 10).orderBy("peak_id")
    got = [tuple(r) for r in stats.select("n_genes", "n_updown_total", "n_upreg", "n_downreg").collect()]
    assert got == [(5, 4, 1, 1), (0, 0, 0, 0)]


def test_equal_peaks_are_counted_apart(spark):
    peaks = spark.createDataFrame([(i, "chr1", 100, 200) for i in range(7)], PEAK)
    genes = spark.createDataFrame([("g", "n", "1", 100, 150, "+", "protein_coding")], GENE)
    expr = spark.createDataFrame([("g", 2.0)], "gene_id string, fold_change double")
    assert peak_gene_stats(peaks, annotate_expression(genes, expr), 10).where("n_upreg = 1").count() == 7


def test_first_peak_names_the_gene(spark):
    peaks = spark.createDataFrame([(5, "1", 100, 200), (3, "chr1", 100, 200)], PEAK)
    genes = spark.createDataFrame([("g", "n", "1", 100, 150, "+", "protein_coding")], GENE)
    expr = spark.createDataFrame([("h", 2.0)], "gene_id string, fold_change double")
    pairs = nearby_genes(peaks, annotate_expression(genes, expr), 10)
    assert [tuple(r) for r in distinct_genes(pairs, "peak_id").collect()] == [("g", "chr1", 100, "protein_coding", None)]


def test_gene_string(spark):
    sites = spark.createDataFrame([(0, "chr1", 100, 200), (1, "chr2", 1, 2)], PEAK)
    genes = spark.createDataFrame(
        [("g3", "chr1", 110, "x", None, 3), ("g1", "chr1", 130, "x", -2.0, 1), ("g2", "chr1", 120, "x", 2.0, 2)],
        "gene_id string, chr_n string, pos0 bigint, biotype string, fold_change double, gene_ord int",
    )
    got = gene_string(sites, genes, 50).orderBy("peak_id").select("str_genes_rnaseq_near").collect()
    assert [r[0] for r in got] == ["g1_upreg,g2_downreg,g3_downreg", ""]
    signed = gene_string(sites, genes, 50, "signed").orderBy("peak_id").first()
    assert signed["str_genes_rnaseq_near"] == "g1_downreg,g2_upreg"


def test_hot_bin_is_split(spark):
    """A third of all peaks in one place: the join is split by AQE and the counts stay whole."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 120_000
        peaks = spark.range(0, n, 1, 8).selectExpr(
            "id as peak_id", "case when id % 3 = 0 then 'chr0' else concat('chr', id % 499) end as chr_n",
            "case when id % 3 = 0 then 1000 else id * 37 end as pos_ini",
            "case when id % 3 = 0 then 1200 else id * 37 + 200 end as pos_end",
        )
        genes = spark.range(0, 499).selectExpr(
            "concat('g', id) as gene_id", "'n' as gene_name", "cast(id as string) as contig", "1100L as g_start",
            "1150L as g_end", "'+' as strand", "'protein_coding' as biotype", "1.0D as fold_change",
        )
        stats = peak_gene_stats(peaks, genes, 100)
        assert stats.where("n_upreg > 0").count() >= n // 3
        total = stats.agg(F.count(F.lit(1)), F.sum(F.when(F.col("chr_n") == "chr0", F.col("n_upreg")))).first()
        assert total[0] == n and total[1] >= n // 3
        stats.collect()
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("dist,ordered", [(0, False), (500, False), (20_000, False), (500, True)])
def test_counts_equal_those_of_the_pairs(spark, dist, ordered):
    """Peaks and genes that end before they start among them, unless the caller says that there are none."""
    peaks, genes = make(spark, seed=4)
    if ordered:
        peaks = [p for p in peaks if p[2] <= p[3]]
    else:
        genes += [(f"x{j}", "n", "1", 9000 + j, 4000, "+", "protein_coding") for j in range(5)]
        peaks += [(900, None, 1, 2), (901, "chr1", None, 5), (902, "chr1", 5, None), (903, "chrNone", 1, 9**9)]
    draw = random.Random(8)
    fold = {g[0]: draw.choice([None, 2.0, -2.0, 0.0, float("nan")]) for g in genes}
    table = spark.createDataFrame([(*g, fold[g[0]]) for g in genes], GENE + ", fold_change double")
    got = {r.peak_id: tuple(r)[4:] for r in peak_gene_stats(spark.createDataFrame(peaks, PEAK), table, dist, ordered=ordered).collect()}
    for p in peaks:
        near = [
            fold[g[0]] for g in genes
            if None not in p and g[2] == p[1][3:] and g[6] == "protein_coding" and g[3] <= p[3] + dist and g[4] >= p[2] - dist
        ]
        known = [f for f in near if f is not None]
        assert got.pop(p[0]) == (len(near), len(known), sum(f > 0 for f in known), sum(f < 0 for f in known))
    assert not got


def test_counts_make_no_pairs(spark):
    """All genes around all peaks: the plan has no join of peaks with genes, and no row more than there are peaks."""
    peaks = spark.range(500).selectExpr("id as peak_id", "'chr1' as chr_n", "id * 3 as pos_ini", "id * 3 + 50 as pos_end")
    genes = spark.range(400).selectExpr(
        "concat('g', id) as gene_id", "'n' as gene_name", "'1' as contig", "id * 4 as g_start", "id * 4 + 9 as g_end",
        "'+' as strand", "'protein_coding' as biotype", "1.0D as fold_change",
    )
    stats = peak_gene_stats(peaks, genes, 100_000, ordered=True)
    assert stats.where("n_genes = 400 and n_upreg = 400").count() == 500
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "g_start" not in plan and "Generate" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("bits", [2, 12])
def test_boundary_bins_have_no_gaps(spark, bits):
    from sitescan.operators.counting import boundary_bins, sums_up_to

    at = [-70_000, -3, -3, 0, 1, 7, 8, 4095, 4096, 90_000]
    points = spark.createDataFrame([((0, "k"), x, i) for i, x in enumerate(at)], "_side struct<kind:int,key:string>, _pos bigint, w bigint")
    bins = boundary_bins(points, ["w"], bits).cache()
    asked = sorted({x + d for x in at for d in (-1, 0, 1)} | {-10**9, 10**9})
    rows = spark.createDataFrame([("k", x) for x in asked], "_k string, x bigint")
    got = {r.x: r.out.w for r in sums_up_to(rows, "x", bins, 0, ["w"], "out", bits).collect()}
    assert got == {x: sum(i for i, p in enumerate(at) if p <= x) for x in asked}
    bins.unpersist()


def mixed(seed, n, contigs):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randint(-1000, 9_000_000)
        out.append((i, r.choice(contigs), a, a + r.choice([0, 10, 300, 5000, 90_000, 2_000_000, -400])))
    return out


@pytest.mark.parametrize("bits", [3, 12])
def test_nested_bins_equal_a_plain_join(spark, rows, bits):
    peaks = mixed(1, 250, ["chr1", "chr2", None])
    genes = [(f"g{j}", "n", c and c[3:], a, b, "+", "protein_coding") for j, c, a, b in mixed(2, 200, ["chr1", "chr3"])]
    left, right = spark.createDataFrame(peaks, PEAK), spark.createDataFrame(genes, GENE)
    got = rows(nearby_genes(left, right, 50, bits=max(bits, 12), nested=True), "peak_id", "gene_id")
    want = [(p[0], g[0]) for p in peaks for g in genes if p[1] and p[1][3:] == g[2] and g[3] <= p[3] + 50 and g[4] >= p[2] - 50]
    assert want and got == sorted(want, key=lambda t: [str(x) for x in t])
    table = right.selectExpr("gene_id", "concat('chr', contig) as chr_n", "g_start as pos0", "biotype", "1.0D as fold_change")
    points = rows(genes_around(left, table, 700, nested=True), "peak_id", "gene_id")
    want = [(p[0], g[0]) for p in peaks for g in genes if p[1] and p[1][3:] == g[2] and p[2] - 700 < g[3] < p[3] + 700]
    assert want and points == sorted(want, key=lambda t: [str(x) for x in t])
    with pytest.raises(ValueError):
        nearby_genes(left, right, 0, how="left", nested=True)


def test_nested_bins_put_an_interval_into_few_rows(spark):
    from sitescan.operators.intervals import _level, _levels, _spread

    peaks = spark.createDataFrame([p for p in mixed(5, 3000, ["chr1"])], PEAK)
    span = F.col("pos_ini"), F.col("pos_end")
    placed = peaks.withColumn("_level", _level(*span, 12))
    levels = _levels(placed)
    assert len(levels) == 3
    assert _spread(placed, True, levels, *span, "l", False).count() < 4 * 3000


@pytest.mark.parametrize("dist", [0, 10, 40, 3000])
def test_first_peaks_equal_the_least_of_all_pairs(spark, rows, dist):
    r = random.Random(dist)
    peaks = [(i, r.choice(["chr1", "1", "chr2", None]), a, a + r.choice([0, 30, 200, 9000])) for i, a in enumerate(r.sample(range(-300, 40_000), 300))]
    r.shuffle(peaks)
    genes = [
        (f"g{j}", "n", r.choice("123"), a, a + r.choice([0, 5, 60, 3000, 30_000]), r.choice("+-"), r.choice(["protein_coding", "x"]), None)
        for j, a in enumerate(r.sample(range(1, 40_000), 120))
    ]
    left = spark.createDataFrame(peaks, PEAK)
    right = spark.createDataFrame(genes, GENE + ", fold_change double")
    got = first_peaks(left, right, "peak_id", dist)
    assert dist < 32 or got.select("gene_id").distinct().count() == got.count()
    pairs = nearby_genes(left, right, dist)
    want = rows(distinct_genes(pairs, "peak_id"))
    assert want and rows(distinct_genes(got, "peak_id")) == want
    ordered = first_peaks(left, right, "peak_id", dist, keep_start=True)
    assert rows(distinct_genes(ordered, "peak_id", keep_order=True)) == rows(distinct_genes(
        nearby_genes(left, right, dist, keep_start=True), "peak_id", keep_order=True
    ))


def test_first_peaks_make_no_pairs(spark):
    """Every peak is near every gene; a gene comes back once, and no join row is wider than its bins."""
    peaks = spark.range(3000).selectExpr("3000 - id as peak_id", "'chr1' as chr_n", "id * 3 as pos_ini", "id * 3 + 50 as pos_end")
    genes = spark.range(50).selectExpr(
        "concat('g', id) as gene_id", "'n' as gene_name", "'1' as contig", "id * 4 as g_start", "id * 4 + 9 as g_end",
        "'+' as strand", "'protein_coding' as biotype", "1.0D as fold_change",
    )
    first = first_peaks(peaks, genes, "peak_id", 50_000)
    assert [tuple(r) for r in first.select("peak_id").distinct().collect()] == [(1,)] and first.count() == 50


@pytest.mark.parametrize("longest", [9, 40])
def test_hit_counts_equal_those_of_the_pairs(spark, rows, longest):
    from sitescan.operators import peak_site_stats

    r = random.Random(6)
    peaks = [(i, r.choice(["c", "d"]), 1, 2, a, a + r.choice([0, 3, 8, 9, 50, 400]), 0) for i, a in enumerate(r.sample(range(9000), 200))]
    peaks += [(900 + i, "c", 1, 2, 4000, 4200, 0) for i in range(50)]
    hits = [(r.choice(["c", "d", "e"]), a, r.choice([5, 7, 9]), r.choice(["list", "pssm"])) for a in (r.randrange(9400) for _ in range(3000))]
    located = spark.createDataFrame(peaks, PEAK + ", slice_ini bigint, slice_end bigint, slice_shift bigint")
    found = spark.createDataFrame(hits, "chr_n string, start bigint, hit_len int, source string")
    want = rows(peak_site_stats(located, found))
    assert rows(peak_site_stats(located, found, longest=longest)) == want and any(x[-3] for x in want)


def test_flags_equal_those_of_the_pairs(spark, rows):
    from sitescan.operators import cooccupancy_flags

    r = random.Random(16)
    sites = [(i, r.choice(["c", "d"]), 1, 2, a, a + r.choice([0, 3, 8, 9, 50, 400]), 0) for i, a in enumerate(r.sample(range(9000), 150))]
    hits = [(r.choice(["c", "e"]), a, r.choice([5, 7, 9]), r.choice(["m 1", "m`2", "other", None])) for a in (r.randrange(9400) for _ in range(900))]
    located = spark.createDataFrame(sites, PEAK + ", slice_ini bigint, slice_end bigint, slice_shift bigint")
    found = spark.createDataFrame(hits, "chr_n string, start bigint, hit_len int, tf_name string")
    names = ["m 1", "other", "never"]
    want = rows(cooccupancy_flags(located, found, names, key="peak_id"))
    assert rows(cooccupancy_flags(located, found, names, key="peak_id", longest=9)) == want and sum(x[-2] for x in want) > 5


def test_sums_over_the_peaks_of_a_gene_make_no_pairs(spark, rows, monkeypatch):
    """Lengths of 10 to 2,000,000 bases, gaps of many bins, contigs of one side only; the pairs are left alone."""
    from sitescan.operators import gene_peak_sums, stats

    peaks = spark.range(400).selectExpr(
        "id as peak_id", "concat('chr', id % 3) as chr_n", "id * 79190 % 5000000 as pos_ini",
        "id * 79190 % 5000000 + if(id % 20 = 3, 1999990, 9 + id % 300) as pos_end",
    )
    genes = spark.range(90).selectExpr(
        "concat('G', id % 80) as gene_id", "cast(id % 4 as string) as contig", "id * 131071 % 6000000 as g_start",
        "id * 131071 % 6000000 + if(id % 9 = 5, 700000, 20 + id) as g_end", "'+' as strand", "'protein_coding' as biotype",
    )
    pairs = nearby_genes(peaks, genes, 1000, None, bits=12, nested=True).groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("peak_id").alias("s")
    )
    want = rows(pairs)
    monkeypatch.setattr(stats, "nearby_genes", lambda *a, **k: pytest.fail("pairs"))
    assert rows(gene_peak_sums(peaks, genes, {"s": F.col("peak_id")}, 1000, None)) == want != []


def test_first_peaks_fold_numbers_in_hash_tables(spark, rows, monkeypatch):
    """Both spellings of a chromosome, and no struct of the peaks is folded: those made every task sort its peaks."""
    from sitescan.operators import counting

    peaks = spark.createDataFrame(
        [(5, "1", 10, 90), (3, "chr1", 400, 500), (4, "1", 420, 430), (1, "chrchr1", 10, 90), (2, "chr1", 9000, 9100)],
        "peak_id bigint, chr_n string, pos_ini bigint, pos_end bigint",
    )
    genes = spark.createDataFrame(
        [("a", "1", 50, 60), ("b", "1", 300, 450), ("c", "chr1", 20, 30), ("d", None, 20, 30), ("e", "1", 5000, 5001)],
        "gene_id string, contig string, g_start bigint, g_end bigint",
    ).selectExpr("*", "'+' as strand", "'protein_coding' as biotype")
    folded, plain = [], counting.cut_lineage
    monkeypatch.setattr(counting, "cut_lineage", lambda df: folded.append(df) or plain(df))
    got = rows(first_peaks(peaks, genes, "peak_id", 100).select("gene_id", "peak_id", "chr_n"))
    assert got == [("a", 5, "1"), ("b", 3, "chr1"), ("c", 1, "chrchr1")]
    plan = folded[0]._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
