"""The registered queries of this package against their SQL, and the pipeline against plain versions of its stages."""

import os
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from conftest_llm import odd_texts
from sitescan.llm import queries
from test_decontamination import brute
from test_edited_copies import brute as brute_copies
from test_models import plain_spans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_has_a_row_for_each_document(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(
        r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()
    )


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    before = docs.collect()
    clean = stages["decontamination"](spark, docs, SF_DIR)
    assert clean.columns == docs.columns
    dirty = {d for d, _, hit, _ in brute([(r.doc_id, r.text) for r in before], items) if hit}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in before if r.doc_id not in dirty)
    texts = {r.doc_id: r.text for r in before}
    for r in stages["personal_data"](spark, docs, SF_DIR).collect():
        spans, out, at = plain_spans(texts[r.doc_id]), "", 0
        for start, k, end in spans:
            if start >= at:
                out += texts[r.doc_id][at:start] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k]
            at = max(at, end)
        assert r.text == out + texts[r.doc_id][at:] and r.n_chars == len(r.text)
    one = stages["near_duplicates"](spark, docs, SF_DIR).collect()
    assert sorted(str(r.doc_id) for r in one) == brute_copies([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in one}.items() <= texts.items()
    encoded = stages["bpe"](spark, docs, SF_DIR)
    library = Tokenizer.from_file(queries.TOKENIZER)
    for r in encoded.collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ids that repeat, clashing columns."""
    texts = [t for _, t in odd_texts()] + ["the same words " * 9] * 4
    rows = [(None if i % 6 == 5 else i // 2, t, None if i % 2 else "en", None if i % 3 else "s", None if i % 4 else 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.selectExpr("*", *[f"'x' as {c}" for c in ("ids", "score", "fp", "row", "n", "doc", "digest", "n_tokens", "_row", "found")])


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_documents_and_none(spark, stage):
    docs, function = odd_documents(spark), dict(corpus_pipeline.STAGES)[stage]
    made = function(spark, docs, SF_DIR)
    rows = made.collect()
    assert made.columns[:len(docs.columns)] == docs.columns
    if stage == "near_duplicates":
        assert 0 < len(rows) < docs.count() and len({(r.text or "").lower() for r in rows}) == len(rows)
    elif stage != "toxicity":  # whose model these few rows decide
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    if stage in ("toxicity", "near_duplicates", "decontamination"):
        assert {str(tuple(r)) for r in rows} <= {str(tuple(r)) for r in docs.collect()}
    assert function(spark, docs.limit(0), SF_DIR).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert 0 < len(rows) == len({r.doc_id for r in rows}) and all(r.n_tokens == len(r.ids) for r in rows)
