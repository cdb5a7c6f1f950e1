"""Two-tier byte-pair encoding against the public library, and its tables."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import odd_texts
from pyspark.sql import functions as F

from sitescan.llm import byte_bpe
from sitescan.llm.byte_bpe import Encoder, Vocabulary, decode_bytes, encode_bytes, find_slots, merge_bytes, perfect_hash
from sitescan.llm.queries import BYTE_RANKS, op11_byte_bpe

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(BYTE_RANKS)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}).encode_ordinary


def encoded(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_011])
def test_every_slot_is_taken_once(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    moves, slots = perfect_hash(hashes)
    assert sorted(slots) == list(range(len(hashes)))
    assert (find_slots(hashes, moves, len(hashes)) == slots).all()


def test_first_tier_knows_its_entries_only(vocabulary):
    known = list(vocabulary.ranks)
    others = [t + b"\x01" for t in known if t + b"\x01" not in vocabulary.ranks]
    for tokens, ids in ((known, list(vocabulary.ranks.values())), (others, [-1] * len(others))):
        sizes = np.array([len(t) for t in tokens])
        assert vocabulary.whole(np.frombuffer(b"".join(tokens), np.uint8), sizes).tolist() == ids


def test_equal_hashes_do_not_make_an_entry(vocabulary):
    word = b" the"
    broken = Vocabulary(**vars(vocabulary))
    broken.bytes = vocabulary.bytes.copy()
    broken.bytes[vocabulary.starts[vocabulary.ranks[word]]] = ord("_")
    assert broken.whole(np.frombuffer(word, np.uint8), np.array([len(word)])).tolist() == [-1]


def plain_merge(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not pairs or min(pairs)[0] == 1 << 60:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_second_tier(vocabulary):
    pairs, draw = byte_bpe.byte_pairs(vocabulary.ranks), random.Random(5)
    for _ in range(600):
        piece = bytes(draw.choice(b"aetion \xc3\xa9h1!") for _ in range(draw.randint(1, 40)))
        assert merge_bytes(piece, vocabulary.ranks, pairs) == plain_merge(piece, vocabulary.ranks)


def test_library_on_random_texts(vocabulary, library):
    draw = random.Random(1)
    parts = ["a", "e", "th", "é", "漢", "😀", " ", "  ", "\n", "'s", "'", "1", "23", "!", "\t", "\x1c", " ", "\r\n", "İ", "_"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    small = Encoder(vocabulary, PATTERN, run=7, cut=9)
    whole = [library(t) for t in texts]
    assert encoded(Encoder(vocabulary, PATTERN), texts) == encoded(small, texts) == whole


def test_library_on_every_plane(vocabulary, library):
    points = [c for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["|".join((f"a{c}b {c} 1{c}2", f" {c}{c}", f"{c} \n{c}")) for c in map(chr, points)]
    assert encoded(Encoder(vocabulary, PATTERN), texts) == [library(t) for t in texts]


def test_cache_generations(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    texts = ["qzx vkj wqp zzk qzx mvb vkj lwq zxq qzx"] * 3
    assert encoded(Encoder(vocabulary, PATTERN, run=4), texts) == [library(t) for t in texts]


def test_rank_files_are_checked(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(255)))
    with pytest.raises(ValueError):
        Vocabulary.load(str(path))


def test_odd_rows(spark, frame, library):
    docs = frame(odd_texts())
    made = encode_bytes(docs, BYTE_RANKS, PATTERN)
    assert made.columns == [*docs.columns, "ids_", "n_tokens_", "decoded_"]
    rows = made.select("doc_id", "text", "ids_", "n_tokens_", "decoded_").collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        assert r.ids_ == library(r.text or "") and r.n_tokens_ == len(r.ids_) and bytes(r.decoded_) == (r.text or "").encode()
    empty = encode_bytes(docs.limit(0), BYTE_RANKS, PATTERN, keep=["doc_id"])
    assert empty.columns == ["doc_id", "ids", "n_tokens", "decoded"] and empty.count() == 0


def test_decoding_stored_ids(spark, frame):
    docs = frame(odd_texts(), clash=False)
    packed = encode_bytes(docs, BYTE_RANKS, PATTERN, packed=True, decode=False)
    back = decode_bytes(packed, BYTE_RANKS, keep=["text"]).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == len(odd_texts())
    wild = spark.createDataFrame([(bytearray(np.array([0, 60_000, 1], "<u4").tobytes()),), (None,)], "ids binary")
    assert sorted(bytes(r.decoded) for r in decode_bytes(wild, BYTE_RANKS).collect()) == [b"", b'!"']


def test_whole_query(spark, library):
    from hashlib import sha256

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op11_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
    assert spark.createDataFrame(rows).select(F.min("n_tokens")).first()[0] >= 0
