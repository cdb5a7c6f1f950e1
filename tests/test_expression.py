from sitescan.operators import (
    expression_conflicts, expression_rows, expression_summary, first_fold_change, first_translated, translate_names,
)

RAW = "row_ord bigint, raw_id string, raw_value string, gene_name string"


def test_first_row_wins_and_conflicts(spark, rows):
    raw = spark.createDataFrame(
        [(0, "g1|g2", "1", "n1"), (1, "g1", "2", "n1"), (2, "g2", "1", "n2"), (3, "g3", "bad", "n3"), (4, "|", "1", "n4")],
        RAW,
    )
    r = expression_rows(raw)
    assert rows(first_fold_change(r)) == [("g1", 2.0), ("g2", 2.0)]
    assert rows(expression_conflicts(r)) == [("g1", 2.0, 1)]
    assert tuple(expression_summary(raw).first()) == (4, 4, 2)


def test_missing_values_differ_from_each_other(spark):
    raw = spark.createDataFrame(
        [(0, "g1", "NA", "n"), (1, "g1", "2", "n"), (2, "g1", "NA", "n"), (3, "g2", "1", "n"), (4, "g2", "NA", "n"), (5, "g2", "1", "n")], RAW
    )
    got = {r["gene_id"]: r["n_conflicts"] for r in expression_conflicts(expression_rows(raw)).collect()}
    assert got == {"g1": 2, "g2": 1}


def test_missing_value_is_kept_as_nan(spark):
    raw = spark.createDataFrame([(0, "g1", "NA", "n"), (1, "g1", "2", "n")], RAW)
    (row,) = first_fold_change(expression_rows(raw)).collect()
    assert row["fold_change"] != row["fold_change"]


def test_translation_is_many_to_many(spark, rows):
    raw = spark.createDataFrame(
        [(0, "x|y", "1", "n1"), (1, "x", "2", "n2"), (2, "x", "3", "n1"), (3, "", "1", "n3"), (4, "x", "1", "absent"),
         (5, "x", "0", "n2")],
        RAW,
    )
    ann = spark.createDataFrame(
        [("e1", "n1"), ("e2", "n1"), ("e2", "n2"), ("e3", "n3")], "gene_id string, gene_name string"
    )
    r = expression_rows(raw)
    # A row without identifier text is a missing cell, which still counts as one identifier.
    want = {"e1": 2.0, "e2": 2.0}
    got = dict(rows(first_translated(r, ann)))
    assert got.pop("e3", None) is None and got == want
    assert dict(rows(first_fold_change(translate_names(r, ann)))) == want
    assert rows(expression_conflicts(translate_names(r, ann))) == [("e1", 2.0, 1), ("e2", 2.0, 3)]
    assert tuple(expression_summary(raw, ann).first()) == (6, 8, 2)
