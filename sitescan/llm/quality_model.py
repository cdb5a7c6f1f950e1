"""Quality classifier: a factorisation machine over hashed words, text structure and size.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise part in linear time as
half of (sum v x)^2 - sum (v x)^2 in each dimension.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, free_name, map_texts
from sitescan.llm.toxicity import sample_rows

#: Most labelled rows that the model is fitted to, and the bytes of text of all of them together.
TRAIN_ROWS = 4_000
TRAIN_BYTES = 8_000_000
SLOTS = 1 << 17
RANK = 6
EPOCHS = 12
REMEMBERED = 200_000

#: Structure statistics, each a share or a bounded logarithm, then cut into steps of its own slots.
STATISTICS = (
    "log_words", "distinct", "repeat_next", "capitals", "digits", "symbols", "marks", "word_length",
    "line_length", "other_bytes", "repeat_second", "bars", "repeat_pairs",
)
STEPS = 10
_SYMBOLS, _MARKS = b"#*$%&|<>", b".,;:!?\"'()"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def only(text: bytes, wanted: bytes) -> int:
    return len(text) - len(text.translate(None, wanted))


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Values from 0 to 1 of :data:`STATISTICS`; all 0 for a text without words."""
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds, pairs = set(words), set(zip(words, words[1:]))
    same = sum(a == b for a, b in zip(words, words[1:]))
    other = size - len(text.translate(None, bytes(range(128, 256))))
    half = sum(w == v for w, v in zip(words, words[2:]))
    return [
        min(np.log1p(n) / 12, 1.0), len(kinds) / n, same / n, only(text, _UPPER) / size, only(text, _DIGITS) / size,
        only(text, _SYMBOLS) / size, only(text, _MARKS) / size, min(sum(map(len, words)) / n / 20, 1.0),
        min(np.log1p(size / (text.count(b"\n") + 1)) / 12, 1.0), other / size, half / n, text.count(b"|") / n,
        1 - len(pairs) / max(n - 1, 1),
    ]


def word_slot(word: bytes) -> int:
    return zlib.crc32(word) % SLOTS


def statistic_slots(values: list[float]) -> list[int]:
    """A slot for the step each statistic falls on; shares are drawn apart near 0 by a square root."""
    return [SLOTS + i * (STEPS + 1) + int(min(np.sqrt(max(v, 0.0)), 1.0) * STEPS) for i, v in enumerate(values)]


SIZE = SLOTS + (STEPS + 1) * len(STATISTICS)


def inputs(text: bytes, slot=word_slot) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: words with the square root of their share, steps with 1."""
    words = text.split()
    steps = statistic_slots(statistics(text, words))
    if not words:
        return np.array(steps), np.ones(len(steps))
    at, n = np.unique(np.array([slot(w) for w in words]), return_counts=True)
    return np.concatenate([at, steps]), np.concatenate([np.sqrt(n / len(words)), np.ones(len(steps))])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # SIZE x RANK

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        return self.bias + float(self.linear[at] @ x) + 0.5 * float((vx.sum(0) ** 2 - (vx * vx).sum(0)).sum())


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, rank: int = RANK) -> Machine:
    """AdaGrad, row by row in an order that does not depend on how the rows came; classes weigh the same."""
    rng = np.random.default_rng(7)
    machine = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, rank)))
    data = [(*inputs(text), label) for text, label in sorted(rows)]
    ones = sum(y for *_, y in data)
    if not data:
        return machine
    weights = (len(data) / max(2 * (len(data) - ones), 1), len(data) / max(2 * ones, 1))
    g_bias, g_linear, g_factors = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, y = data[i]
            v = machine.factors[at]
            vx = v * x[:, None]
            total = vx.sum(0)
            raw = machine.bias + machine.linear[at] @ x + 0.5 * (total @ total - (vx * vx).sum())
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * weights[y]
            if abs(off) < 1e-4:
                continue
            slope = off * x + 1e-5 * machine.linear[at]
            g_linear[at] += slope * slope
            machine.linear[at] -= 0.1 * slope / np.sqrt(g_linear[at])
            slope = off * (x[:, None] * total - v * (x * x)[:, None]) + 1e-5 * v
            g_factors[at] += slope * slope
            machine.factors[at] -= 0.03 * slope / np.sqrt(g_factors[at])
            g_bias += off * off
            machine.bias -= 0.1 * off / np.sqrt(g_bias)
    return machine


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    most: int = TRAIN_ROWS, size: int = TRAIN_BYTES,
) -> Machine:
    return train(sample_rows(docs, labels, label, doc_id, text, most, size))


def score_quality(docs: DataFrame, machine: Machine, text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` added.

    Whole texts are read. A missing text counts as empty and gets the score that the statistics of no words
    have. Rows that repeat score alike; names that clash get a trailing underscore.
    """
    plain = (machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def kernel():
        model = Machine(*shared.value)
        cache: dict[bytes, int] = {}

        def slot(word: bytes) -> int:
            made = cache.get(word)
            if made is None:
                if len(cache) >= remembered:
                    cache.clear()
                made = cache[word] = word_slot(word)
            return made

        def work(texts: list) -> dict:
            raw = np.array([model.raw(*inputs(t or b"", slot)) for t in texts], dtype=float)
            return {"_score": (1 / (1 + np.exp(-np.clip(raw, -500, 500)))).tolist()}

        return work

    names = {c: free_name(docs, c) for c in ("score", "predicted")}
    own = F.struct(*columns_of(docs)).alias("_row")
    made = map_texts(docs, [own], F.col(f"`{text}`").cast("binary"), kernel, "_score double")
    return made.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], F.col("_score").alias(names["score"]),
        (F.col("_score") >= 0.5).cast("int").alias(names["predicted"]),
    )
