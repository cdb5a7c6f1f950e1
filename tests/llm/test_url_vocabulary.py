"""Vocabulary tables with weights, and boundaries in long URLs."""

import random
import re

import pytest

from sitescan.llm.url_filter import automaton, count_terms, judge_urls, vocabulary_of


def test_weights_of_different_terms_add_up(spark):
    table = spark.createDataFrame(
        [("Casino", "strict", None), ("win", "soft", 0.5), ("free", "soft", 1.0), ("win", "soft", 0.75), ("über-deal", "soft", None), ("", "soft", 9.0), (None, "soft", 9.0)],
        "term string, class string, weight double",
    )
    cases = [
        ("http://a.b/casino", "block", 0.0), ("http://a.b/win/win-win", "allow", 0.75), ("http://a.b/win/free", "block", 1.75),
        ("http://a.b/FREE", "allow", 1.0), ("http://a.b/über-deal?win", "block", 1.75), ("http://a.b/casinos/freewin", "allow", 0.0), (None, "allow", 0.0),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id int, url string")
    got = judge_urls(pages, vocabulary=table, soft_limit=1.5).orderBy("page_id").collect()
    assert [(r.url, r.verdict, r.soft_weight) for r in got] == cases
    assert judge_urls(pages, vocabulary=table.limit(0)).where("verdict = 'block'").count() == 0
    with pytest.raises(ValueError):
        vocabulary_of(spark.createDataFrame([("a", "hard", 1.0)], "term string, class string, weight double"))


def test_boundaries_in_long_urls():
    rng = random.Random(3)
    vocabulary = [("ab", False, 1.0), ("abc", True, 1.0), ("b", False, 0.5), ("c-a", False, 2.0), ("1a", False, 1.0)]
    terms = automaton(vocabulary)
    for size in (0, 5, 60, 20_000):
        for _ in range(20):
            url = "".join(rng.choice("abc1-/.é_") for _ in range(size))
            alone = {t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", url, re.ASCII) is not None for t, _, _ in vocabulary}
            strict, soft, weight = count_terms(url, terms)
            assert strict == [t for t, s, _ in vocabulary if s and alone[t]]
            assert soft == sorted(t for t, s, _ in vocabulary if not s and alone[t])
            assert weight == sum(w for t, s, w in vocabulary if not s and alone[t])
