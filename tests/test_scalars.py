import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitescan import functions as fn
from sitescan.operators import expand_sites, resize_sites


def one(spark, schema, values, *cols):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*cols).collect()]


def test_resize_known_values(spark):
    df = spark.createDataFrame([(100, 200)], "pos_ini bigint, pos_end bigint")
    got = [tuple(resize_sites(df, n).first()) for n in (105, 95, 100, 0)]
    assert got == [(97, 202), (102, 197), (100, 200), (100, 200)]


def test_resize_may_start_below_one(spark):
    df = spark.createDataFrame([(1, 2)], "pos_ini bigint, pos_end bigint")
    assert tuple(resize_sites(df, 10).first()) == (-4, 6)


def test_resize_reaches_the_length_evenly(spark):
    values = [(i, i + w) for i in (1, 50) for w in range(0, 40)]
    df = spark.createDataFrame(values, "a bigint, b bigint").select("a", "b", "a", "b").toDF("a", "b", "pos_ini", "pos_end")
    for length in (1, 7, 20, 33):
        for a, b, ini, end in resize_sites(df, length).collect():
            assert end - ini == length
            left, right = a - ini, end - b
            grow = length - (b - a)
            assert left - right == (grow % 2 if grow > 0 else abs(grow) % 2)


def test_expand(spark):
    df = spark.createDataFrame([(10, 20)], "pos_ini bigint, pos_end bigint")
    assert tuple(expand_sites(df, 5).first())[2:] == (5, 25)
    assert tuple(expand_sites(df, -5).first())[2:] == (10, 20)


def test_fold_change_and_numbers(spark):
    cells = ["1.5", "-1.5", "0", "bad", "NA", "", None, " 2 ", "1e1", "inf", "1.5d", "0x10", "nan", "1_0"]
    got = one(spark, "v string", [(c,) for c in cells], fn.signed_fold_change(fn.parse_number("v")))
    got = [g[0] for g in got]
    assert [round(x, 6) for x in got[:3]] == [2.828427, -2.828427, 0.0]
    assert got[3] is None and got[10] is None and got[11] is None and got[13] is None
    assert all(math.isnan(got[i]) for i in (4, 5, 6, 12))
    assert got[7] == 4.0 and got[8] == 1024.0 and got[9] == math.inf


def test_reverse_complement(spark):
    assert one(spark, "s string", [("AcgTNR",)], fn.revcomp("s")) == [("YNACGT",)]
    assert fn.reverse_complement("AcgTNR") == "YNACGT"


@settings(max_examples=50, deadline=None)
@given(st.text("ACGTN", max_size=30))
def test_reverse_complement_twice(seq):
    assert fn.reverse_complement(fn.reverse_complement(seq)) == seq


def test_contig_and_origin(spark):
    got = one(spark, "c string", [("chr1",), ("chrX",), ("chrM",), ("7",), ("xchr1",)], fn.contig("c"))
    assert [g[0] for g in got] == ["1", "X", "M", "7", "xchr1"]
    got = one(spark, "s string, a int, b int", [("-", 1000, 2000), ("+", 1000, 2000)], fn.gene_origin("s", "a", "b"))
    assert got == [(2000,), (1000,)]


def test_split_ids(spark):
    got = one(spark, "s string", [("a| b||c ",), ("|",), (None,)], fn.split_ids("s"))
    assert [g[0] for g in got] == [["a", "b", "c"], [], ["nan"]]


def test_direction_labels(spark):
    values = [(-2.0,), (2.0,), (None,), (float("nan"),), (0.0,)]
    got = one(spark, "f double", values, fn.direction_label("f"), fn.direction_label("f", "signed"))
    assert got == [
        ("upreg", "downreg"), ("downreg", "upreg"), ("downreg", None), ("downreg", None), ("downreg", None)
    ]
    with pytest.raises(ValueError):
        fn.direction_label("f", "other")


def test_fasta_id(spark):
    assert one(spark, "c string", [("chr1",)], fn.fasta_id(F.lit(3), "c", F.lit(-4), F.lit(9))) == [("3_chr1_-4_9",)]
