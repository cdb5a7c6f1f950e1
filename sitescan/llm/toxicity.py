"""Toxicity by a linear-chain conditional random field over words.

Two tags, clean and toxic. The labels are of documents; a training token is toxic where its document is and
where the word, or its beginning, is found in toxic documents significantly more often than in clean ones. Features of a
word are hashed: the word, its beginnings and endings, its neighbours and its shape. Forward-backward gives the
marginal of each token; the marginals give the document's score and the offending offsets.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, free_name, map_column, stored

#: Most labelled rows that the model is fitted to, and the bytes of text of all of them together.
TRAIN_ROWS = 4_000
TRAIN_BYTES = 8_000_000
SLOTS = 1 << 18
STEPS = 20
#: Tokens walked at once.
PORTION = 100_000
#: G statistic a word or beginning must reach, and how many times likelier it must be in toxic documents.
SIGNIFICANT = 24.0
RATIO = 8.0
REMEMBERED = 200_000
#: A token is offending from this marginal on.
OFFENDING = 0.5

_STRIP = b"\"'.,;:!?()[]{}<>*#$%&|"


def features(word: bytes) -> list[int]:
    """Slots of a lower-cased word: itself without marks, beginnings, endings and shape."""
    core = word.strip(_STRIP)
    names = [b"w" + core, b"p4" + core[:4], b"p5" + core[:5], b"p6" + core[:6], b"s3" + core[-3:], b"s4" + core[-4:]]
    shape = b"z%d%d%d" % (min(len(core), 12), core.isalpha(), any(48 <= c <= 57 for c in core))
    return [zlib.crc32(n) % SLOTS for n in (*names, shape)]


N_FEATURES = 7


@dataclass
class Chain:
    """Weights for the toxic tag against the clean one: own features, neighbours' features, transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray  # step[previous, next]
    scale: float = 1.0
    bias: float = 0.0


def marginals(
    emit: np.ndarray, first: np.ndarray, step: np.ndarray, with_pairs: bool = True, width: int = 256
) -> tuple[np.ndarray, np.ndarray | None]:
    """Chance of the toxic tag for each token of a batch of chains laid end to end, and expected transitions.

    ``emit`` is the log-odds of the toxic tag, ``first`` marks the tokens that begin a chain. The batch is cut
    into equal stretches that are walked side by side, so a chain may be of any length: pass one finds what a
    stretch does to either incoming tag, a scan over the stretches links them, pass two has the messages.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    width = max(16, min(width, math.isqrt(n) or 1))
    rows = -(-n // width)
    pad = rows * width - n
    e = np.exp(np.clip(np.append(emit, np.zeros(pad)), -30, 30)).reshape(rows, width)
    s = np.append(first, np.ones(pad, bool)).reshape(rows, width)
    t = np.exp(step)

    def link(state: np.ndarray, at: int) -> np.ndarray:
        """Normed forward messages after token ``at``; state has the two tags in its last axis."""
        clean = state[..., 0] * t[0, 0] + state[..., 1] * t[1, 0]
        toxic = state[..., 0] * t[0, 1] + state[..., 1] * t[1, 1]
        fresh = s[:, at] if state.ndim == 2 else s[:, at, None]
        odds = e[:, at] if state.ndim == 2 else e[:, at, None]
        clean, toxic = np.where(fresh, 1.0, clean), np.where(fresh, 1.0, toxic) * odds
        total = clean + toxic
        return np.stack([clean / total, toxic / total], -1), total

    def unlink(state: np.ndarray, at: int) -> np.ndarray:
        """Backward messages before token ``at`` from those after it; a chain's beginning cuts them off."""
        odds = e[:, at] if state.ndim == 2 else e[:, at, None]
        fresh = s[:, at] if state.ndim == 2 else s[:, at, None]
        a, b = state[..., 0], state[..., 1] * odds
        clean, toxic = t[0, 0] * a + t[0, 1] * b, t[1, 0] * a + t[1, 1] * b
        clean, toxic = np.where(fresh, 1.0, clean), np.where(fresh, 1.0, toxic)
        total = clean + toxic
        return np.stack([clean / total, toxic / total], -1), total

    def scan(go, order) -> np.ndarray:
        """Messages at the border of each stretch, from the two basis messages carried through it."""
        basis = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
        size = np.zeros((rows, 2))
        for at in (range(width) if order > 0 else range(width - 1, -1, -1)):
            basis, total = go(basis, at)
            size += np.log(total)
        edge = np.empty((rows, 2))
        now = np.array([0.5, 0.5])
        gain = np.exp(size - size.max(1, keepdims=True))
        for r in (range(rows) if order > 0 else range(rows - 1, -1, -1)):
            edge[r] = now
            now = (now * gain[r]) @ basis[r]
            now = now / now.sum()
        return edge

    ahead = np.empty((width, rows, 2))
    state = scan(link, 1)
    incoming = state
    for at in range(width):
        state, _ = link(state, at)
        ahead[at] = state
    behind = np.empty((width, rows, 2))
    state = scan(unlink, -1)
    for at in range(width - 1, -1, -1):
        behind[at] = state
        state, _ = unlink(state, at)
    both = ahead * behind
    chance = (both[..., 1] / both.sum(-1)).T.reshape(-1)[:n]
    if not with_pairs:
        return chance, None
    # Expected transitions into each token that does not begin a chain.
    previous = np.concatenate([incoming[None], ahead[:-1]])
    odds = np.stack([np.ones_like(e.T), e.T], -1)
    joint = previous[..., :, None] * t * (odds * behind)[..., None, :]
    joint /= joint.sum((-2, -1), keepdims=True)
    pairs = joint[~s.T].sum(0)
    return chance, pairs


def names_of(word: bytes) -> set[bytes]:
    """What may mark a word: itself (``w``) and, of longer words, their beginnings (``p``)."""
    core = word.strip(_STRIP)
    names = {b"w" + core} if core else set()
    return names | {b"p" + core[:k] for k in (4, 5, 6) if len(core) > k}


def suspicious(words: list[bytes], counts: np.ndarray) -> set[bytes]:
    """Words and beginnings met in toxic documents so much more often than chance has it (G statistic).

    ``counts`` has, for each word and label, how many different words were met before it: copies of a document
    add nothing.
    """
    seen: dict[bytes, np.ndarray] = {}
    for word, met in zip(words, counts):
        for name in names_of(word):
            held = seen.get(name)
            seen[name] = met if held is None else held + met
    sizes, found = counts.sum(0), set()
    share = sizes[1] / max(sizes.sum(), 1)
    for name, (other, n) in seen.items():
        if not n or share >= 1:
            continue
        gain = n * math.log(n / ((n + other) * share))
        gain += other * math.log(other / ((n + other) * (1 - share))) if other else 0.0
        if 2 * gain >= SIGNIFICANT and n * sizes[0] > RATIO * other * sizes[1]:
            found.add(name)
    return found


def contexts(ids: np.ndarray, first: np.ndarray, labels: np.ndarray, words: int) -> np.ndarray:
    """For each word and label the number of different words before it; a text's beginning counts as one."""
    before = np.append(0, ids[:-1] + 1)
    before[first] = 0
    pairs = [np.unique((ids * (words + 1) + before)[labels == y]) // (words + 1) for y in (0, 1)]
    return np.stack([np.bincount(p, minlength=words) for p in pairs], 1)


def document_evidence(chance: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-odds of each document's most toxic token; its length alone does not raise it."""
    odds = np.log(np.clip(chance, 1e-12, 1 - 1e-12))
    odds -= np.log1p(-np.clip(chance, 1e-12, 1 - 1e-12))
    top = np.maximum.reduceat(np.append(odds, -30.0), ends[:-1]) if len(ends) > 1 else np.zeros(0)
    return np.where(np.diff(ends) > 0, top, -30.0)


def train(rows: list[tuple[bytes, int]], steps: int = STEPS) -> Chain:
    """Fits the chain by AdaGrad over all rows, then the document score to the labels.

    Rows are sorted first, so the result does not depend on the order in which they came. A step walks the
    rows portion by portion, which bounds the memory.
    """
    chain = Chain(np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(SLOTS), np.array([[1.0, -1.0], [0.0, 0.0]]))
    index: dict[bytes, int] = {}
    parts, label = [], []
    for text, y in sorted(rows):
        found = [index.setdefault(w, len(index)) for w in text.lower().split()]
        if found:
            parts.append(np.array(found, dtype=np.int64))
            label.append(y)
    if not parts:
        return chain
    ends, label = np.cumsum([0, *map(len, parts)]), np.array(label)
    ids, words = np.concatenate(parts), list(index)
    first = np.zeros(len(ids), bool)
    first[ends[:-1]] = True
    of_token = np.repeat(label, np.diff(ends))
    marked = suspicious(words, contexts(ids, first, of_token, len(words)))
    kinds = np.array([features(w) for w in words], dtype=np.int64)
    flags = np.array([not marked.isdisjoint(names_of(w)) for w in words])
    truth = flags[ids] & (of_token == 1)
    # Rare tags weigh more, or the clean ones would drown them.
    heavy = min(20.0, max(1.0, (~truth).sum() / max(truth.sum(), 1) / 10))
    told = np.zeros((2, 2))
    np.add.at(told, (truth[:-1][~first[1:]].astype(int), truth[1:][~first[1:]].astype(int)), 1)
    cuts = [0]
    for k in range(1, len(ends)):
        if k == len(ends) - 1 or ends[k] - ends[cuts[-1]] > PORTION:
            cuts.append(k)

    def portions():
        of_word = [w[kinds].sum(1) for w in (chain.own, chain.before, chain.after)]
        for a, b in zip(cuts, cuts[1:]):
            at = slice(ends[a], ends[b])
            own, start = ids[at], first[at]
            emit = emissions(*(w[own] for w in of_word), start)
            yield a, b, at, own, start, marginals(emit, start, chain.step)

    squares = [np.full(SLOTS, 1e-8) for _ in range(3)] + [np.full((2, 2), 1e-8)]
    for _ in range(steps):
        sums, met = np.zeros((3, len(words))), np.zeros((2, 2))
        for _, _, at, own, start, (chance, pairs) in portions():
            wrong = (truth[at] - chance) * np.where(truth[at], heavy, 1.0) / len(ids) * 1000
            sums[0] += np.bincount(own, wrong, len(words))
            sums[1] += np.bincount(own[:-1], np.where(start[1:], 0, wrong[1:]), len(words))
            sums[2] += np.bincount(own[1:], np.where(start[1:], 0, wrong[:-1]), len(words))
            met += pairs
        slopes = [
            np.bincount(kinds.ravel(), np.repeat(g, N_FEATURES), SLOTS) - 1e-5 * w
            for g, w in zip(sums, (chain.own, chain.before, chain.after))
        ] + [(told - met) / len(ids)]
        for value, slope, square, rate in zip(
            (chain.own, chain.before, chain.after, chain.step), slopes, squares, (0.5, 0.05, 0.05, 0.1)
        ):
            square += slope * slope
            value += rate * slope / np.sqrt(square)
    evidence = [document_evidence(chance, ends[a:b + 1] - ends[a]) for a, b, _, _, _, (chance, _) in portions()]
    chain.scale, chain.bias = calibrate(np.concatenate(evidence), label)
    return chain


def emissions(own: np.ndarray, before: np.ndarray, after: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds of each token: its own, and what its neighbours in the same text say."""
    emit = own.copy()
    emit[1:] += np.where(first[1:], 0, before[:-1])
    emit[:-1] += np.where(first[1:], 0, after[1:])
    return emit


def calibrate(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and bias that put 0.5 in the middle of the cut that parts the labels best, both weighing the same."""
    if label.min() == label.max():
        return 1.0, 0.0
    order = np.argsort(evidence, kind="stable")
    x, y = evidence[order], label[order]
    right = np.append(0, np.cumsum((y == 0) / (y == 0).sum())) + np.append((np.cumsum((y == 1)[::-1] / (y == 1).sum()))[::-1], 0)
    gaps = np.concatenate([[0.0], np.diff(x), [0.0]])
    best = np.flatnonzero((right >= right.max() - 1e-12) & (gaps > 0))
    at = int(best[np.argmax(gaps[best])]) if len(best) else len(x) // 2
    return 1.5, -1.5 * float(x[at - 1] + x[min(at, len(x) - 1)]) / 2


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, most: int, size: int) -> list[tuple[bytes, int]]:
    """At most ``most`` labelled texts and ``size`` bytes, half of them of each label where there are enough.

    Drawn by a hash of the id, so the same rows give the same sample in any order. Rows without text or label
    are left out; of an id labelled both ways the label 1 counts, and of the rows that share an id the greatest
    text. Texts stay where they are: ids and lengths are joined with the labels, and the drawn ids, whose number
    is bounded, fetch their texts.
    """
    marks = labels.groupBy(F.col(f"`{doc_id}`").alias("_at")).agg(F.max(f"`{label}`").alias("_label"))
    own, body = F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`")
    narrow = docs.where(body.isNotNull()).groupBy(own).agg(F.max(F.octet_length(body)).alias("_size"))
    pairs = stored(narrow.join(marks.where("_label is not null"), F.col("_id") == F.col("_at")).select(
        "_id", "_label", "_size", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30)).alias("_draw")
    ))
    share = {}
    for r in pairs.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect():
        part = min(1.0, most / 2 / r.n, size / 2 / max(r.b, 1))
        share[r["_label"]] = int(part * (1 << 30)) + (part == 1.0)
    limit = F.when(F.col("_label") == 1, share.get(1, 0)).otherwise(share.get(0, 0))
    drawn = pairs.where(F.col("_draw") < limit).select("_id", "_label").distinct()
    texts = docs.where(body.isNotNull()).select(own, body.cast("binary").alias("_text"))
    once = texts.join(F.broadcast(drawn), "_id").groupBy("_id", "_label").agg(F.max("_text").alias("_text"))
    return [(bytes(r["_text"]), r["_label"]) for r in once.collect()]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    most: int = TRAIN_ROWS, size: int = TRAIN_BYTES,
) -> Chain:
    return train(sample_rows(docs, labels, label, doc_id, text, most, size))


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1), ``predicted`` and ``offending`` added.

    ``offending`` lists (start, end) in code points of the runs of toxic tokens. Whole texts are tagged. A
    missing or empty text has no tokens: score 0 and nothing offending, also with a model that was fitted to
    no rows. Rows that repeat score alike; names that clash get a trailing underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(chain))

    def kernel():
        model = Chain(**shared.value)
        index: dict[bytes, int] = {}
        weights = np.zeros((3, 0))

        def work(column: pa.Array) -> dict:
            nonlocal weights
            texts = column.cast(pa.binary()).to_pylist()
            if len(index) > remembered:
                index.clear()
                weights = np.zeros((3, 0))
            split = [(t or b"").lower().split() for t in texts]
            ends = np.cumsum([0, *map(len, split)])
            n, place = int(ends[-1]), index.setdefault
            ids = np.fromiter((place(w, len(index)) for words in split for w in words), np.int64, n)
            if len(index) > weights.shape[1]:
                at = np.array([features(w) for w in islice(index, weights.shape[1], None)], dtype=np.int64)
                fresh = np.stack([w[at].sum(1) for w in (model.own, model.before, model.after)])
                weights = np.concatenate([weights, fresh], 1)
            first = np.zeros(n, bool)
            first[ends[:-1][ends[:-1] < ends[1:]]] = True
            chance, _ = marginals(emissions(*weights[:, ids], first), first, model.step, with_pairs=False)
            evidence = document_evidence(chance, ends)
            score = np.where(np.diff(ends) > 0, 1 / (1 + np.exp(-np.clip(model.scale * evidence + model.bias, -500, 500))), 0.0)
            bad = chance >= OFFENDING
            some = np.add.reduceat(np.append(bad, False), ends[:-1]) if len(texts) else np.zeros(0)
            some = np.where(np.diff(ends) > 0, some, 0)
            spans = [runs_of(t, bad[a:b]) if k else [] for t, a, b, k in zip(texts, ends, ends[1:], some)]
            return {"_score": score.tolist(), "_spans": spans}

        return work

    made = map_column(docs, text, kernel, "_score double, _spans array<struct<start:int,end:int>>")
    names = {c: free_name(docs, c) for c in ("score", "predicted", "offending")}
    score, spans = (F.col(f"`{c}`") for c in made.columns[-2:])
    return made.select(
        *columns_of(docs), score.alias(names["score"]), (score >= 0.5).cast("int").alias(names["predicted"]),
        spans.alias(names["offending"]),
    )


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def runs_of(text: bytes, bad: np.ndarray) -> list[dict]:
    """Adjacent bad words as one span of code points."""
    spans: list[list[int]] = []
    for at, m in enumerate(_WORD.finditer(text)):
        if bad[at]:
            if at and bad[at - 1]:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
    if text.isascii():
        return [{"start": a, "end": b} for a, b in spans]
    count = lambda end: len(text[:end].decode(errors="replace"))
    return [{"start": count(a), "end": count(b)} for a, b in spans]
