"""URL filter: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts where neither neighbour in the lower-cased URL is an ASCII letter or digit. One strict term blocks
the URL, and so do different soft terms whose weights add up to ``soft_limit``. The vocabulary is a table of terms,
classes and weights; the one below is the default.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import LOWER, UPPER, columns_of, free_name, lower_az, map_texts

#: Rules as (verdict, rule); the rule is a host, a slash and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Terms that block alone.
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "jackpot", "spam", "warez", "betting", "bets", "hentai")
#: Terms of which several different ones block.
SOFT = (
    "ads", "track", "adult", "cheap", "pills", "free", "win", "bonus", "deal", "loan", "poker", "pharma",
    "sex", "click", "offer", "promo", "sale", "dating", "x", "farm",
)
SOFT_LIMIT = 2
#: Terms that a vocabulary may have: the automaton goes to every task.
MOST_TERMS = 1_000_000

_INNER = frozenset(LOWER + UPPER + "0123456789")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_az(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    return F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does.

    A rule fits its host and every subdomain when the path starts with the rule's. Of rules equally long the
    first listed counts.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        cut = text.index("/")
        own, start = text[:cut].translate(str.maketrans(UPPER, LOWER)), text[cut:]
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def vocabulary_of(table: DataFrame | None = None) -> list[tuple[str, bool, float]]:
    """(term, strict?, weight) of a table ``term, class, weight``, where class is ``strict`` or ``soft``.

    Without a table the default terms, each of weight 1. Terms are lower-cased; empty or missing ones are left out,
    a term that repeats is strict if any of its rows is, and has the greatest of its weights (missing: 1).
    """
    if table is None:
        return [(t, True, 1.0) for t in STRICT] + [(t, False, 1.0) for t in SOFT if t not in STRICT]
    term, strict = lower_az(F.col("term")), F.col("class") == "strict"
    wrong = table.where(~F.col("class").isin("strict", "soft") | F.col("class").isNull()).select("class").limit(1).collect()
    if wrong:
        raise ValueError(f"a term of class {wrong[0][0]!r}")
    rows = table.where(F.length("term") > 0).groupBy(term.alias("t")).agg(
        F.max(strict).alias("s"), F.max(F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).alias("w")
    ).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return sorted((r["t"], r["s"], r["w"]) for r in rows)


def automaton(vocabulary: Sequence[tuple[str, bool, float]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term, strict, weight in vocabulary:
        made.add_word(term, (term, strict, weight))
    if len(made):
        made.make_automaton()
    return made


def count_terms(text: str, terms: ahocorasick.Automaton) -> tuple[list[str], list[str], float]:
    """Different strict and soft terms that stand alone in a lower-cased text, sorted, and the weight of the soft ones."""
    strict_terms: set[str] = set()
    soft_terms: dict[str, float] = {}
    if len(terms):
        for last, (term, strict, weight) in terms.iter(text):
            first = last - len(term) + 1
            if (first == 0 or text[first - 1] not in _INNER) and (last + 1 == len(text) or text[last + 1] not in _INNER):
                if strict:
                    strict_terms.add(term)
                else:
                    soft_terms[term] = weight
    return sorted(strict_terms), sorted(soft_terms), sum(soft_terms.values())


def judge_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, vocabulary: DataFrame | None = None,
    soft_limit: float = SOFT_LIMIT,
) -> DataFrame:
    """Every row of ``pages`` with ``host, path, rule, verdict, strict_terms, soft_terms, soft_weight`` added.

    ``vocabulary`` is a table ``term, class, weight``, see :func:`vocabulary_of`. The whole URL is searched, so terms in a path or query count too. A missing URL and one without ``://``
    have empty host and path; the terms of the latter still count, the former is allowed. Names that clash
    with columns of ``pages`` get a trailing underscore. Rows that repeat are judged alike.
    """

    shared = pages.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))

    def kernel():
        terms, lower = automaton(shared.value), str.maketrans(UPPER, LOWER)

        def work(texts: list) -> dict:
            found = [count_terms((t or "").translate(lower), terms) for t in texts]
            return dict(zip(("strict_terms", "soft_terms", "soft_weight"), map(list, zip(*found))))

        return work

    names = {c: free_name(pages, c) for c in ("host", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight")}
    own = F.struct(*columns_of(pages)).alias("_row")
    counted = map_texts(pages, [own], F.col(f"`{url}`"), kernel, "strict_terms array<string>, soft_terms array<string>, soft_weight double")
    address = F.col(f"_row.`{url}`")
    host, path = host_of(address), path_of(address)
    parts = counted.select("*", host.alias("_host"), path.alias("_path"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    bad = (F.size("strict_terms") > 0) | (F.col("soft_weight") >= soft_limit)
    return parts.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in pages.columns],
        F.col("_host").alias(names["host"]), F.col("_path").alias(names["path"]), rule.alias(names["rule"]),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias(names["verdict"]),
        F.col("strict_terms").alias(names["strict_terms"]), F.col("soft_terms").alias(names["soft_terms"]),
        F.col("soft_weight").alias(names["soft_weight"]),
    )
