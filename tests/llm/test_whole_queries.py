"""Registered queries without SQL against plain versions of the whole of them, over the smallest tables."""

import math
import os
import re
from collections import Counter
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import pytest
import zstandard
from tokenizers import Tokenizer

from sitescan.llm import class_lm, queries
from sitescan.llm.common import remainder
from sitescan.llm.compression import BAD_CHUNKS, BAD_RUN, CHUNK_BYTES, LEVEL, band_of
from test_personal_contexts import brute as personal
from test_text_operators import plain_rules

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) + [None]


def test_class_model(spark, texts):
    out = lambda i: crc32(str(i).encode()) % 7 == 2
    seen = Counter(w for i, t in texts.items() if not out(i) for w in tokens(t))
    total, distinct = sum(seen.values()), len(seen)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    model = class_lm.fit(docs.where(remainder("doc_id", 7) != 2))
    kind = dict(zip(model.words, model.classes))
    rows = queries.op2_brown_class_lm(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(words), sum(w in seen for w in words), total)
        logs = sum(math.log10(seen[w] + 1) for w in words)
        assert r.base_score == pytest.approx(logs - len(words) * math.log10(total + distinct + 1), rel=1e-9)
        raw = [w.encode() if w is not None else None for w in words]
        path = [0] + [0 if w is None else kind[w] if w in kind else 1 + class_lm.ending(w, model.endings) for w in raw]
        assert r.score == pytest.approx(logs + sum(model.log_step[a, b] for a, b in zip(path, path[1:])), rel=1e-9)


def test_bpe(spark, texts):
    library = Tokenizer.from_file(queries.TOKENIZER)
    rows = queries.op4_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_personal_data(spark, texts):
    spans = personal(list(texts.items()))
    names = ("email", "ip", "card", "phone", "context")
    rows = queries.op8_personal_data(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = [(names[k], a, b) for a, k, b in spans[texts[r.doc_id]]]
        listed = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
        base = [s for s in found if s[0] != "context"]
        assert r.spans == listed(found) and r.base_sha256 == sha256(listed(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in names[:4])


def test_quality_rules(spark, texts):
    press = zstandard.ZstdCompressor(level=LEVEL)

    def outside(piece):
        low, high = band_of(len(piece))
        return not low <= len(press.compress(piece)) / len(piece) <= high

    rows = queries.op10_quality_rules(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *counts, failed = plain_rules(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == [*counts, failed]
        body = texts[r.doc_id].encode()
        bad = [outside(body[i:i + CHUNK_BYTES]) for i in range(0, len(body), CHUNK_BYTES)]
        longest = max((len(list(g)) for b, g in groupby(bad) if b), default=0)
        assert r.kept == (not failed and not outside(body) and sum(bad) <= BAD_CHUNKS * len(bad) and longest < BAD_RUN)
