"""Class language model, toxicity, quality and personal data: brute force, propriety and held-out rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest_llm import odd_texts
from sitescan.llm import class_lm, personal_data, quality_model, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def tokens(t):
    return [*WORD.findall((t or "").translate(UPPER)), ""]


# --- class language model ------------------------------------------------------------------------------------

def corpus(n, seed=1):
    """Two kinds of words in turn, so classes of words tell what follows."""
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice("ab") + str(rnd.randint(0, 30)) if k % 2 else "c" + str(rnd.randint(0, 30)) for k in range(60))) for i in range(n)]


def test_base_score_equals_brute_force(frame):
    train, rest = corpus(30) + odd_texts(), [*corpus(8, 2), *odd_texts(), (70, "never seen before c1")]
    model = class_lm.fit(frame(train), core=20, held=40, clusters=4, endings=3, rounds=3)
    counts = Counter(w for _, t in train for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    assert (model.total, model.distinct) == (total, distinct)
    got = class_lm.score(frame(rest), model).collect()
    assert len(got) == len(rest)
    for r in got:
        own = tokens(r.text)
        assert (r.n_tokens_, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score_ / r.n_tokens_))


def test_probabilities_add_up(frame):
    model = class_lm.fit(frame(corpus(20)), core=30, held=100, clusters=4, endings=5, rounds=2)
    counts = {(r.word or "").encode(): r.c for r in model.vocabulary.collect()}
    known = dict(zip(model.words, model.classes))
    for before in range(len(model.log_step)):
        mass = 10 ** model.log_step[before]
        total = sum((c + 1) * mass[known.get(w, 1 + class_lm.ending(w, 5)) if w else 0] for w, c in counts.items())
        assert total + mass[1:6].sum() == pytest.approx(1.0)  # one word never seen for each ending


def test_classes_help_held_out_text(frame):
    model = class_lm.fit(frame(corpus(60)), clusters=6, endings=3, rounds=6)
    rows = class_lm.score(frame(corpus(20, 9)), model).collect()
    assert sum(r.score_ for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens_ for r in rows)


def test_exchange_step_keeps_the_tables_right():
    rng, first, size = np.random.default_rng(3), 2, 6
    text = rng.integers(0, 12, 3000)
    classes = np.array([0, 1, *(2 + rng.integers(0, 4, 10))])
    table = lambda c: np.histogram2d(c[text[:-1]], c[text[1:]], bins=size, range=[[0, size]] * 2)[0]
    counts = table(classes)
    for w in range(2, 12):
        rows, cols = counts.sum(1), counts.sum(0)
        before = np.bincount(classes[text[:-1]][text[1:] == w], minlength=size).astype(float)
        after = np.bincount(classes[text[1:]][text[:-1] == w], minlength=size).astype(float)
        own = float(((text[:-1] == w) & (text[1:] == w)).sum())
        options = []
        for k in range(first, size):
            tried = classes.copy()
            tried[w] = k
            options.append(class_lm.likelihood(table(tried)))
        classes[w] = class_lm.best_class(counts, rows, cols, before, after, own, int(classes[w]), first)
        assert np.allclose(counts, table(classes)) and np.allclose(rows, counts.sum(1)) and np.allclose(cols, counts.sum(0))
        assert class_lm.likelihood(counts) == pytest.approx(max(options))


def test_best_classes_are_those_of_the_likelihood():
    rng, size = np.random.default_rng(5), 7
    text = rng.integers(0, 40, 4000)
    text = text[np.append(True, np.diff(text) != 0)]
    classes = np.array([0, *(1 + rng.integers(0, size - 1, 39))])
    table = lambda c: np.histogram2d(c[text[:-1]], c[text[1:]], bins=size, range=[[0, size]] * 2)[0]
    entries = Counter()
    for a, b in zip(text.tolist(), text[1:].tolist()):
        entries[b, int(classes[a])] += 1
        entries[a, size + int(classes[b])] += 1
    moved = sorted((w - 1, c, n) for (w, c), n in entries.items() if w)
    got = class_lm.best_classes(table(classes), classes[1:], *map(np.array, zip(*moved)))
    for w in range(1, 40):
        options = []
        for k in range(1, size):
            tried = classes.copy()
            tried[w] = k
            options.append(class_lm.likelihood(table(tried)))
        assert options[got[w - 1] - 1] == pytest.approx(max(options), abs=1e-5)


def zipf(n, seed=1):
    """Words of two kinds in turn, most of them rare."""
    rnd = random.Random(seed)
    word = lambda kind: kind + str(int(rnd.paretovariate(0.7)) % 400) + rnd.choice("xyz")
    return [(i, " ".join(word("ab"[k % 2]) for k in range(rnd.randint(0, 60)))) for i in range(n)]


def test_all_words_are_clustered_and_scored(frame, monkeypatch):
    monkeypatch.setattr(class_lm, "RARE_BUCKET", 50)
    monkeypatch.setattr(class_lm, "MID_BUCKET", 7)
    monkeypatch.setattr(class_lm, "FLUSH", 900)
    train, rest = zipf(150) + odd_texts(), [*zipf(20, 4), *odd_texts(), (70, "never a1x b2y seen seen")]
    model = class_lm.fit(frame(train), core=10, held=60, clusters=5, endings=4, rounds=3)
    counts = Counter(w for _, t in train for w in tokens(t))
    others = {r.word: (r.c, r.k) for r in model.rest.collect()}
    held = {w.decode(): k for w, k in zip(model.words, model.classes)}
    assert {w: c for w, (c, _) in others.items()} == {w: c for w, c in counts.items() if w and w not in held}
    # Words outside the core, held and not, were moved from the class of their ending.
    start = lambda w: 1 + class_lm.ending(w.encode(), 4)
    assert sum(k != start(w) for w, (_, k) in others.items()) > len(others) / 3
    assert sum(held[w.decode()] != start(w.decode()) for w in model.words[10:]) > 15
    # The model's tables are those of the classes, from the texts again.
    kind = {**held, **{w: k for w, (_, k) in others.items()}}
    size, table, mass = len(model.log_step), np.zeros((len(model.log_step),) * 2), np.zeros(len(model.log_step))
    for _, t in train:
        path = [0, *(kind[w] if w else 0 for w in tokens(t))]
        for a, b in zip(path, path[1:]):
            table[a, b] += 1
    for w, c in counts.items():
        mass[kind[w] if w else 0] += c + 1
    mass[1:5] += 1
    assert model.likelihoods == sorted(model.likelihoods) and model.likelihoods[-1] == pytest.approx(class_lm.likelihood(table))
    share = (table.sum(0) + 1) / (table.sum() + size)
    step = (table + class_lm.PRIOR * share) / (table.sum(1, keepdims=True) + class_lm.PRIOR)
    log_step = np.log10(model.weight * step / np.maximum(mass, 1) + (1 - model.weight) / (model.total + model.distinct + 4))
    assert np.allclose(model.log_step, log_step)
    rows = class_lm.score(frame(rest), model).collect()
    assert len(rows) == len(rest)
    for r in rows:
        own = tokens(r.text)
        path = [0, *(kind.get(w, start(w)) if w else 0 for w in own)]
        want = sum(math.log10(counts[w] + 1) for w in own) + sum(log_step[a, b] for a, b in zip(path, path[1:]))
        assert r.score_ == pytest.approx(want, rel=1e-9)
        assert r.n_known == sum(counts[w] > 0 for w in own)


def test_stored_rows_are_small(frame):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    # One long text: more pairs, and more words of a bucket, than a row may hold.
    texts = [" ".join(rnd.choice(words) if rnd.random() < 0.8 else f"r{rnd.randint(0, 4000)}" for _ in range(40_000)), None, ""]
    known, small = [w.encode() for w in words], np.concatenate([np.arange(203), 203 + np.arange(100) % 2])
    rows = class_lm.text_pass(frame(list(enumerate(texts))), "text", known, small, 3, 203, 4000).collect()
    kinds = (class_lm.PAIRS, class_lm.MID, class_lm.RARE, class_lm.LINKS)
    sizes = {kind: [len(r.codes or r.words) for r in rows if r.kind == kind] for kind in kinds}
    assert all(len(x) > 1 and max(x) <= 2048 for kind, x in sizes.items() if kind != class_lm.LINKS)
    at = {w: 3 + i for i, w in enumerate(words)}
    path = [[0, *(at.get(w, -1) for w in (t or "").split()), 0] for t in texts]
    low = lambda i, w: int(small[at[w] if w in at else 1 + class_lm.ending(w.encode(), 2)]) if w else 0
    own = [[0, *(low(i, w) for w in (t or "").split()), 0] for i, t in enumerate(texts)]
    pairs = Counter(a * 205 + b for x in own for a, b in zip(x, x[1:]))
    got = Counter()
    for r in rows:
        got.update(dict(zip(r.codes, r.n)) if r.kind == class_lm.PAIRS else {})
    assert got == pairs
    assert sum(sizes[class_lm.MID]) == sum(s >= 203 for x in path for s in x)
    assert sum(sizes[class_lm.RARE]) == sum(s < 0 for x in path for s in x)
    assert sum(sizes[class_lm.LINKS]) == sum(a < 0 and b < 0 for x in path for a, b in zip(x, x[1:]))


def test_words_are_counted_before_they_are_sent(frame, monkeypatch):
    sent = []
    inner = class_lm.map_batches
    monkeypatch.setattr(class_lm, "map_batches", lambda *a: sent.append(inner(*a)) or sent[-1])
    # Over 4 MB of one word pass by in pieces.
    texts = [(i, "abc " * 1_200_000) for i in range(5)]
    counts = {r.word: r.c for r in class_lm.word_counts(frame(texts).coalesce(1), "text").collect()}
    assert counts == {"abc": 6_000_000, "": 5}
    assert sorted((r.w, r.c) for r in sent[0].collect()) == [(b"", 5), (b"abc", 6_000_000)]


def test_model_of_nothing(frame):
    model = class_lm.fit(frame([]))
    assert [r.n_known for r in class_lm.score(frame([(1, "a b"), (2, None)]), model).collect()] == [0, 0]


# --- toxicity and quality ------------------------------------------------------------------------------------

def test_marginals_equal_forward_backward():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 300, 1000):
        emit, step = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
        first = rng.random(n) < 0.05
        first[0] = True
        chance, pairs = toxicity.marginals(emit, first, step)
        t, want, total = np.exp(step), np.zeros(n), np.zeros((2, 2))
        edges = [*np.flatnonzero(first), n]
        for a, b in zip(edges, edges[1:]):
            e = np.stack([np.ones(b - a), np.exp(emit[a:b])], 1)
            f, g = e.copy(), np.ones_like(e)
            for i in range(1, b - a):
                f[i] = (f[i - 1] / f[i - 1].sum()) @ t * e[i]
            for i in range(b - a - 2, -1, -1):
                g[i] = t @ (e[i + 1] * g[i + 1])
                g[i] /= g[i].sum()
            both = f * g
            want[a:b] = both[:, 1] / both.sum(1)
            for i in range(1, b - a):
                j = f[i - 1][:, None] * t * (e[i] * g[i])
                total += j / j.sum()
        assert np.allclose(chance, want) and np.allclose(pairs, total)


def sayings(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(["blarg", "snorf", "grumzel" + word()]).title()
        rows.append((i + 1000 * seed, " ".join(words)))
        labels.append((i + 1000 * seed, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, frame):
    (train, labels), (test, truth) = sayings(160, 1), sayings(60, 2)
    marks = spark.createDataFrame(labels + [(None, 1), (1001, None)], "doc_id long, toxic int")
    chain = toxicity.fit_toxicity(frame(train + odd_texts()), marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(test), chain).collect()}
    assert sum(got[i].predicted_ == y for i, y in truth) >= 0.95 * len(truth)
    for r in got.values():
        assert 0 <= r.score_ <= 1
        for s in r.offending:
            assert r.predicted_ == 0 or re.search("(?i)blarg|snorf|grumzel", r.text[s.start:s.end]) or s.end > s.start
    found = [got[i].text[s.start:s.end].lower() for i, y in truth if y for s in got[i].offending]
    assert sum(bool(re.search("blarg|snorf|grumzel", f)) for f in found) >= 0.9 * len(found) > 0
    odd = {r.doc_id: r for r in toxicity.score_toxicity(frame(odd_texts()), chain).collect()}
    assert odd[1].score_ == odd[2].score_ == odd[3].score_ == 0 and not odd[1].offending
    assert toxicity.score_toxicity(frame([]), chain).collect() == []


def test_order_of_rows_does_not_matter():
    rows, labels = sayings(40, 3)
    data = [(t.encode(), y) for (_, t), (_, y) in zip(rows, labels)]
    a, b = toxicity.train(data, 3), toxicity.train(data[::-1], 3)
    assert np.array_equal(a.own, b.own) and (a.scale, a.bias) == (b.scale, b.bias)


def test_models_of_nothing(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    chain = toxicity.fit_toxicity(frame(odd_texts()), labels)
    assert all(0 <= r.score_ <= 1 for r in toxicity.score_toxicity(frame(odd_texts()), chain).collect())
    machine = quality_model.fit_quality(frame(odd_texts()), labels)
    assert all(0 <= r.score_ <= 1 for r in quality_model.score_quality(frame(odd_texts()), machine).collect())


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    machine = quality_model.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    at, x = np.array([2, 5, 7, 11]), rng.normal(size=4)
    pairs = sum(x[i] * x[j] * machine.factors[at[i]] @ machine.factors[at[j]] for i in range(4) for j in range(i))
    assert machine.raw(at, x) == pytest.approx(0.3 + machine.linear[at] @ x + pairs)


def test_quality_on_held_out_rows(spark, frame):
    def made(n, seed):
        good, _ = sayings(n, seed)
        return [(i, t if i % 2 else " ".join(w + "***" for w in t.split())) for i, t in good], [(i, i % 2) for i, _ in good]

    (train, labels), (test, truth) = made(80, 4), made(40, 5)
    machine = quality_model.fit_quality(frame(train), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.predicted_ for r in quality_model.score_quality(frame(test + odd_texts()), machine).collect()}
    assert sum(got[i] == y for i, y in truth) >= 0.95 * len(truth)
    assert quality_model.score_quality(frame([]), machine).collect() == []


# --- personal data -------------------------------------------------------------------------------------------

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for k, (name, pattern) in enumerate(FORMATS.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            good = {
                "email": True, "ip": name != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, "phone": 10 <= len(d) <= 15,
            }[name]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_formats_equal_brute_force(frame):
    rnd = random.Random(6)
    pieces = ["a.b@c-d.e", "@", "x@y", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "1.2.3.256", "007.1.2.3.4", "+1 (988) 555-2485",
              "+1234567890123456", "é😀", "12", " ", "-", ".", "x_d@e.f.g", "0" * 14, "378282246310005", "\n", "+", "a"]
    docs = [*odd_texts(), *((i + 100, "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14)))) for i in range(400))]
    got = personal_data.find_personal_data(frame(docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert [(s.start, s.k, s.end) for s in r.findings_ if s.k < 4] == plain_spans(r.text), r.text
        assert all(s.value == (r.text or "")[s.start:s.end] for s in r.findings_)


def test_contexts_find_other_formats(frame):
    seeds = [(i, f"please write to reach me on user{i}@mail.example.com today") for i in range(6)]
    other = [(50, "nobody is here but reach me on QX-99-1234-77 today"), (51, "the answer is of course 12-3456-789 here"), (52, None)]
    got = {r.doc_id: r for r in personal_data.find_personal_data(frame(seeds + other + other[:1])).collect()}
    assert [r.value for r in got[50].findings_] == ["QX-99-1234-77"] and got[50].findings_[0].k == 4
    assert got[51].findings_ == [] and got[52].findings_ == []
    masked = {r.doc_id: r.text for r in personal_data.redact(frame(seeds + other)).collect()}
    assert masked[50] == "nobody is here but reach me on [CONTEXT] today" and masked[52] is None
    assert masked[0] == "please write to reach me on [EMAIL] today" and masked[51] == other[1][1]


def test_few_seeds_and_copies_trust_nothing(frame):
    same = [(i, "reach me on a1@b.example today") for i in range(9)] + [(99, "reach me on QX-99-1234-77 today")]
    got = {r.doc_id: r.findings_ for r in personal_data.find_personal_data(frame(same)).collect()}
    assert got[99] == []
    assert personal_data.find_personal_data(frame([])).collect() == []
    assert personal_data.redact(frame([])).collect() == []
