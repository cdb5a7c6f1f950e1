"""Contextual extraction: seeds of every format, further hops, long texts, and a plain version of it all."""

import random
import re
import time

import pytest

from conftest_llm import odd_texts
from sitescan.llm import personal_data as P
from test_models import plain_spans

TOK = "A-Za-z0-9._@:/+#()-"
VALUE = re.compile(rf"(?<![{TOK}])(?=[{TOK}]*[0-9])[{TOK}]+(?:(?<=[0-9)])\x20(?=[0-9(])[{TOK}]+){{0,4}}")
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]+"


def plain_patterns(before, after):
    out = []
    ahead = " " + before if len(before) <= P.REACH else before[-P.REACH - 1:]
    behind = after + " " if len(after) <= P.REACH else after[:P.REACH + 1]

    def last(n):
        m = re.search(r"[\x20\x09-\x0D]((?:%s){%d})\Z" % (WORD, n), ahead)
        return re.sub(r"[\x20\x09-\x0D]+", " ", m[1]).rstrip(" ").lower() if m else ""

    follows = re.match(r"[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]", behind)
    if last(2):
        out.append("2 " + last(2))
    if last(1) and follows:
        out.append(f"1 {last(1)} _ {follows[1].lower()}")
    return out


def plain_facts(t):
    t = t or ""
    spans = plain_spans(t)
    seeds = []
    for k in range(4):
        # A match that fails the test still parts the text.
        raw = [m.span() for m in re.finditer(RAW[k], t)]
        for (a, b), low, high in zip(raw, [0] + [r[1] for r in raw], [r[0] for r in raw[1:]] + [len(t)]):
            if (a, k, b) in spans:
                seeds.append((t[a:b], plain_patterns(t[low:a], t[b:high])))
    values, raw = [], [m.span() for m in VALUE.finditer(t)]
    for (a, b), low, high in zip(raw, [0] + [r[1] for r in raw], [r[0] for r in raw[1:]] + [len(t)]):
        if any(x < b and a < y for x, _, y in spans):
            continue
        v = t[a:b]
        left = v.lstrip("._@:/)-" if ")" in v else "._@:/)-(")
        core = left.rstrip("._@:/+#(-" if "(" in v else "._@:/+#(-)")
        start = a + len(v) - len(left)
        values.append((start, start + len(core), core, plain_patterns(t[low:a] if left == v else "", t[b:high] if core == left else "")))
    return spans, seeds, values


RAW = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9]){13,}",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(docs):
    """Spans (start, k, end) of each text."""
    facts = {t: plain_facts(t) for _, t in docs}
    edges = {}
    for _, seeds, values in facts.values():
        for v, patterns in seeds:
            for p in patterns:
                edges[p, v] = True
        for _, _, v, patterns in values:
            for p in patterns:
                edges.setdefault((p, v), False)
    weights, before = {}, -1
    while True:
        trusted = {}
        for p in {p for p, _ in edges}:
            own = [1.0 if seed else weights.get(v, 0.0) for (q, v), seed in edges.items() if q == p]
            score = sum(own) / (len(own) + 1)
            if sum(w >= 0.6 for w in own) >= 3 and score >= 0.6:
                trusted[p] = score
        if len(trusted) <= before or not trusted:
            break
        before, weights = len(trusted), {}
        for (p, v), seed in edges.items():
            if not seed and p in trusted:
                weights[v] = 1 - (1 - weights.get(v, 0.0)) * (1 - min(trusted[p], 0.999))
    out = {}
    for t, (spans, _, values) in facts.items():
        more = {(a, 4, b) for a, b, v, ps in values if len(v) >= 6 and len(re.sub("[^0-9]", "", v)) >= 4 and trusted.keys() & set(ps)}
        out[t] = sorted(set(spans) | more)
    return out


def found(frame, docs):
    return {r.text: [(s.start, s.k, s.end) for s in r.findings_] for r in P.find_personal_data(frame(docs)).collect()}


def texts_of(pairs):
    return [(i, t) for i, t in enumerate(pairs)]


def test_spaced_phones_and_plain_emails_are_seeds(frame):
    phones = [f"call me at +1 (017) 555-{1000 + i} after noon" for i in range(12)]
    emails = [f"write to box {w}@mail.example for more" for w in ("anna", "ben", "cleo", "dora", "emil")]
    others = ["please call me at QX-99-1234-77 after noon", "now write to box (017) 555-7713 for more", "no call at 12-3456-789 then"]
    got = found(frame, texts_of(phones + emails + others))
    values = [[t[a:b] for a, k, b in got[t] if k == 4] for t in others]
    assert values == [["QX-99-1234-77"], ["(017) 555-7713"], []]
    assert got == brute(texts_of(phones + emails + others))


def test_second_and_third_hops(frame):
    first = [f"my mail is user{i}@mail.example right now" for i in range(10)]
    # Account numbers met in the contexts of mails, another one in theirs, then a card number beside all of these.
    hop1 = [f"my mail is AC-10{i}-7781{i} right now" for i in range(5)]
    hop2 = [f"the account number {v} was closed" for v in [f"AC-10{i}-7781{i}" for i in range(5)] + ["ZX/55/9412"]]
    hop3 = [f"member card {v} expired" for v in ["ZX/55/9412", "MM.4242.17"] + [f"AC-10{i}-7781{i}" for i in range(5)]]
    docs = texts_of(first + hop1 + hop2 + hop3 + ["the number 12345678 stands alone"])
    got = found(frame, docs)
    assert got == brute(docs)
    assert all(any(k == 4 for _, k, _ in got[t]) for t in hop1 + hop2 + hop3)
    assert got["the number 12345678 stands alone"] == []


def test_equal_to_the_plain_version(frame):
    rng = random.Random(4)
    words = ["call", "at", "my", "mail", "is", "number", "now", "Please", "x" * 130, "é", "(see", "box,"]
    made = ["+1 (017) 555-%04d", "a%d@b.example", "QX-%04d-77", "10.0.0.%d", "(%d)", "%d", "4111 1111 1111 1111", "n.%d.", "%d 12 (3) 4"]
    docs = odd_texts()
    for i in range(300):
        parts = [rng.choice(words[:7]) if rng.random() < 0.8 else rng.choice(words) for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(0, 3)):
            m = rng.choice(made)
            parts.insert(rng.randint(0, len(parts)), m % rng.randint(0, 9999) if "%" in m else m)
        docs.append((100 + i, rng.choice([" ", "  ", "\n"]).join(parts)))
    assert found(frame, docs) == brute(docs)


@pytest.mark.parametrize("text", ["a." * 250_000, "abc" * 200_000 + "@", "1" * 500_000, "a-b." * 100_000 + "@x.y", "1.2.3.4 " * 4000, "(" * 300_000 + "1"])
def test_long_texts_take_time_in_proportion(frame, spark, text):
    small = frame([(1, text[: len(text) // 50])])
    P.find_personal_data(small).collect()
    start = time.perf_counter()
    rows = P.find_personal_data(frame([(1, text)])).collect()
    assert len(rows) == 1 and time.perf_counter() - start < 60


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame(
        [(i, f"mail u{i}@x.example now", "a", "b") for i in range(4)] + [(9, None, None, "b")],
        "id int, body string, _digest string, own string",
    ).selectExpr("*", *[f"'x' as {c}" for c in ("digest", "base", "values", "seeds", "context", "at", "text", "spans", "c0", "f0", "findings", "_at")])
    made = P.find_personal_data(docs, text="body")
    assert made.columns == [*docs.columns, "findings_"] and [len(r.findings_) for r in made.orderBy("id").collect()] == [1, 1, 1, 1, 0]
    masked = P.redact(docs, text="body")
    assert masked.columns == docs.columns
    assert [r.body for r in masked.orderBy("id").collect()] == ["mail [EMAIL] now"] * 4 + [None]
