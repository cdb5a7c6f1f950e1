import pytest
from pyspark.sql import functions as F

from sitescan.operators import project_sites, rule_filter, sample_peaks, skipped_count, split_by_sequence, with_ordinal


def test_rule_filter(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, n int")
    assert rows(rule_filter(df, [("c", "a")], True), "n") == [(2,), (3,)]
    assert rows(rule_filter(df, [(0, "a")], False), "n") == [(1,)]
    assert rows(rule_filter(df, [("c", "a"), ("n", 3)], False), "n") == [(1,), (3,)]
    assert rule_filter(df, [], True).count() == 3 and rule_filter(df, None, False).count() == 0
    # Text never equals a number.
    assert rule_filter(df, [("n", "1")], True).count() == 3
    assert rule_filter(df, [("c", 1)], False).count() == 0
    with pytest.raises(ValueError):
        rule_filter(df, [(9, "a")])


def test_project_sites(spark, rows):
    df = spark.createDataFrame(
        [(1, "chr1", 5, 9), (2, "", 5, 9), (3, None, 5, 9)], "id int, c string, a bigint, b bigint"
    )
    assert rows(project_sites(df, [1, "a", 3], keep=["id"])) == [(None, 5, 9, 3), ("chr1", 5, 9, 1)]


def test_split_by_sequence(spark, rows):
    df = spark.createDataFrame([("chr1", 1), ("chrZ", 2), (None, 3)], "chr_n string, n int")
    seqs = spark.createDataFrame([("chr1", "ACGT"), ("chr2", "A")], "chr_n string, seq string")
    kept, skipped = split_by_sequence(df, seqs)
    assert rows(kept) == [("chr1", 1)] and skipped.count() == 2
    assert skipped_count(df, seqs).first()[0] == 2


def test_sample(spark, rows):
    df = spark.range(1000).selectExpr("id", "concat('c', id % 7) as c")
    a, b = rows(sample_peaks(df, 50, 1)), rows(sample_peaks(df.repartition(7), 50, 1))
    assert a == b and len(set(a)) == 50
    assert rows(sample_peaks(df, 50, 2)) != a
    assert sample_peaks(df, 0).count() == 1000 and sample_peaks(df, 5000).count() == 1000


def test_ordinal_of_a_sparse_order(spark):
    df = spark.range(0, 5000).selectExpr("id * 7919 * 1000003 as k").repartition(5)
    got = [r["ordinal"] for r in with_ordinal(df, "k").orderBy("k").collect()]
    assert got == list(range(5000))
    empty = with_ordinal(df.where("k < 0"), "k")
    assert empty.count() == 0


def test_sample_is_the_smallest_hashes_whatever_the_rounds(spark):
    from sitescan.operators import filters

    df = spark.range(3000).selectExpr("id % 1500 as a", "'x' as b").repartition(7)
    want = sorted(df.selectExpr("a", "md5(concat_ws('|', '3', a, b)) as h").orderBy("h").limit(40).toPandas().a)
    assert sorted(sample_peaks(df, 40, seed=3).toPandas().a) == want
    drawn = df.selectExpr("a", "md5(concat_ws('|', '3', a, b)) as _draw")
    for digits in (1, 3):
        limit = filters._hash_limit(drawn, 40, digits)
        assert drawn.where(F.col("_draw") < limit).count() >= 40
    tight = filters._hash_limit(drawn, 40, 1, 0.0)  # no slack: down to a group of some rows
    assert 40 <= drawn.where(F.col("_draw") < tight).count()
    assert sample_peaks(df, 3000).count() == sample_peaks(df, 5000).count() == 3000
    same = spark.range(500).selectExpr("1 as a")
    assert sample_peaks(same, 20).count() == 20 and sample_peaks(same.limit(0), 5).count() == 0


def test_sample_leaves_the_other_rows_where_they_are(spark):
    """Of many rows only the counts and the drawn ones are shuffled."""
    df = spark.range(200_000).selectExpr("id as a")
    plan = sample_peaks(df, 100)._jdf.queryExecution().executedPlan().toString()
    stored = plan.split("parquet")[0]
    assert "Range (0" not in stored and sample_peaks(df, 100).count() == 100
