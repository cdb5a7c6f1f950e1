import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those the operators add."""
    clashing = [
        "n_words", "n_hit", "digest", "ids", "decoded", "findings", "fp", "score", "predicted", "fingerprint", "row",
        "component_id", "n_tokens", "kept", "ratio", "host",
    ]

    def make(pairs, clash=True):
        df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in pairs], DOCS)
        return df.selectExpr("*", *[f"'x' as {c}" for c in clashing]) if clash else df

    return make

