import base64
import os
import random

import pytest

from sitescan.llm.compression import BANDS, band_of, quality_rules

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SIZES = (600, 900, 1200, 1700, 2600, 3600, 6000, 12_000, 40_000, 100_000)
#: From which size on noise lies above all clean prose; below, the ratios overlap and the method can't tell.
ALPHABETS = {"lower": ("abcdefghijklmnopqrstuvwxyz", 6, 1200), "hex": ("0123456789abcdef", 8, 3600), "digit": ("0123456789", 8, 12_000)}


def noise(kind, size):
    rng = random.Random(f"{kind} {size}")
    if kind == "base64":
        return " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(size // 9 + 1))[:size]
    letters, length, _ = ALPHABETS[kind]
    return " ".join("".join(rng.choice(letters) for _ in range(length)) for _ in range(size // (length + 1) + 1))[:size]


def test_noise_goes(frame):
    docs = [(size, noise("base64", size)) for size in SIZES]
    docs += [(size + 1 + i, noise(k, size)) for i, k in enumerate(ALPHABETS) for size in SIZES if size >= ALPHABETS[k][2]]
    got = quality_rules(frame(docs, clash=False)).collect()
    assert len(got) == len(docs) and not [(r.doc_id, r.ratio) for r in got if r.base_failed or r.kept]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_clean_prose_stays(spark):
    got = [r for r in quality_rules(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect() if not r.base_failed]
    assert {r.lang for r in got if r.kept} >= {"de", "en", "es", "fr"}
    assert sum(r.kept for r in got) >= 0.97 * len(got)


def test_classes():
    assert [b[0] for b in BANDS] == sorted({b[0] for b in BANDS}) and sum(256 <= b[0] < 4096 for b in BANDS) >= 8
    assert band_of(1023) == BANDS[4][1:] and band_of(1024) == BANDS[5][1:]


def test_junk_inside_long_clean_text_goes(frame):
    rng = random.Random(8)
    # So many words that chunks and whole text are as compressible as prose.
    known = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(1200)]
    clean = lambda size: " ".join(rng.choice(known) for _ in range(size // 3))[:size]
    advert = "buy the best watches here today\n" * 3000
    head, tail = clean(120_000), clean(120_000)
    docs = [(1, head + tail)]
    for i, size in enumerate((16_384, 40_000)):
        docs += [(10 + i, head + advert[:size] + tail), (20 + i, head + noise("base64", size) + tail)]
    docs += [(30, head[:8192] + noise("base64", 4096)), (31, head + noise("base64", 110_000)), (32, head[:65_536] + advert[:65_536])]
    got = {r.doc_id: r for r in quality_rules(frame(docs, clash=False)).collect()}
    assert got[1].kept, got[1].ratio
    assert not [i for i, r in got.items() if i > 1 and r.kept]
