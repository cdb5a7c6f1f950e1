"""Quality rules with compression bands: zstandard ratios of whole texts and of fixed chunks.

A repetitive text compresses far better than prose of its length, and noise hardly at all. Short texts
compress worse in any case, so each length class has limits of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import groupby

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, free_name, map_texts

LEVEL = 3
CHUNK_BYTES = 4096
#: (fewest bytes, lowest ratio, highest ratio) of compressed to plain bytes for a text or chunk of that many
#: bytes. A whole text outside its band is rejected. From all 8,884 documents of sf0.1 that pass the base rule
#: (four languages): quantile 0.001 less 0.05 and quantile 0.999 plus 0.02. Only 7 of them have more than 32 kB,
#: so they are judged by the last class with more. Texts below 256 bytes are not judged by their ratio.
BANDS = (
    (0, 0.0, 9.0), (256, 0.519, 0.762), (384, 0.494, 0.726), (512, 0.432, 0.703), (768, 0.421, 0.653),
    (1024, 0.395, 0.600), (1536, 0.370, 0.560), (2048, 0.357, 0.540), (3072, 0.346, 0.517), (4096, 0.333, 0.493),
    (8192, 0.313, 0.472), (16384, 0.298, 0.449),
)
#: A text is also rejected when more than this share of its chunks lies outside the band of their length, or
#: so many of them in a row: two are more than one full chunk.
BAD_CHUNKS, BAD_RUN = 0.05, 2

SYMBOLS = b"#*$%&|<>"
_DROP = bytes(b for b in range(256) if b not in SYMBOLS)
_SPACE = b" \t\n\x0b\x0c\r"
SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "ratio double, worst_low double, worst_high double, n_chunks bigint, n_bad_chunks bigint"
)


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words inside repeated three-word windows."""
    words = text.split()
    inner = text.translate(None, _SPACE)
    # Bytes that continue a code point are not counted.
    chars = len(inner) if inner.isascii() else len(inner.decode())
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, reach = Counter(windows), 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(reach, at)
                reach = at + 3
    return len(words), chars, len(text.translate(None, _DROP)), len(lines) - len(set(lines)), repeated


def band_of(size: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> tuple[float, float]:
    """Limits for so many bytes: those of the last class that begins at or below."""
    return next(((low, high) for least, low, high in reversed(bands) if size >= least), (0.0, float("inf")))


def longest_run(marks: list[bool]) -> int:
    return max((sum(1 for _ in run) for bad, run in groupby(marks) if bad), default=0)


def ratios(text: bytes, press: zstandard.ZstdCompressor, chunk: int) -> tuple[float, list[tuple[int, float]]]:
    """Compressed to plain size of the whole text (1 if empty) and (size, ratio) of each chunk."""
    if not text:
        return 1.0, []
    pieces = [text[i:i + chunk] for i in range(0, len(text), chunk)]
    whole = len(press.compress(text)) / len(text)
    if len(pieces) == 1:
        return whole, [(len(text), whole)]
    return whole, [(len(p), len(press.compress(p)) / len(p)) for p in pieces]


def quality_rules(
    docs: DataFrame, text: str = "text", level: int = LEVEL, chunk: int = CHUNK_BYTES,
    bands: Sequence[tuple[int, float, float]] = BANDS, bad_chunks: float = BAD_CHUNKS,
    least_words: int = 50, most_repeat: int = 50, bad_run: int = BAD_RUN,
) -> DataFrame:
    """Every row of ``docs`` with the counts, ``ratio``, chunk figures, ``base_failed`` and ``kept`` added.

    A missing text counts as empty: no words, ratio 1, no chunks; it fails the base rule. Long texts are
    compressed whole, chunks are cut by bytes from the start and the last one is judged by its own length.
    Rows that repeat are judged alike; names that clash with columns of ``docs`` get a trailing underscore.
    """

    schema = f"{SCHEMA}, _bad_run bigint"

    def kernel():
        press = zstandard.ZstdCompressor(level=level)

        def work(texts: list) -> dict:
            made: dict = {name.split()[0]: [] for name in schema.split(", ")}
            for text in texts:
                body = text or b""
                whole, parts = ratios(body, press, chunk)
                bad = [not (b := band_of(size, bands))[0] <= ratio <= b[1] for size, ratio in parts]
                values = [r for _, r in parts] or [1.0]
                row = (*rule_counts(body), whole, min(values), max(values), len(parts), sum(bad), longest_run(bad))
                for column, value in zip(made.values(), row):
                    column.append(value)
            return made

        return work

    added = [name.split()[0] for name in SCHEMA.split(", ")]
    names = {c: free_name(docs, c) for c in (*added, "base_failed", "kept")}
    own = F.struct(*columns_of(docs)).alias("_row")
    size = F.length(F.col(f"`{text}`").cast("binary"))
    judged = map_texts(docs, [own, size.alias("_size")], F.col(f"`{text}`").cast("binary"), kernel, schema)
    n_words, repeat, ratio = F.col("n_words"), F.col("n_repeat_words"), F.col("ratio")
    failed = (n_words < least_words) | (100 * repeat > most_repeat * n_words)
    low, high = F.lit(0.0), F.lit(float("inf"))
    for least, band_low, band_high in sorted(bands):
        fits = F.coalesce(F.col("_size"), F.lit(0)) >= least
        low, high = F.when(fits, band_low).otherwise(low), F.when(fits, band_high).otherwise(high)
    inside = ratio.between(low, high) & (F.col("n_bad_chunks") <= bad_chunks * F.col("n_chunks"))
    inside = inside & (F.col("_bad_run") < bad_run)
    return judged.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], *[F.col(c).alias(names[c]) for c in added],
        failed.alias(names["base_failed"]), (~failed & inside).alias(names["kept"]),
    )
