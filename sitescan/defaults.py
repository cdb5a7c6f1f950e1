"""Default parameters of the public API."""

# Defaults a user of the original command line gets without naming them.
DIST_GENES = 100_000
DIST_SITES = 250
PSEUDOCOUNT = 0.5
SCORE_MULT = 0.9
BACKGROUND = 0.25
BIOTYPE = "protein_coding"
CORE_WORDS = [
    "GCAAGTG", "GGAAGTG", "GAAAGTG", "ATAAGTG", "GTAAGTG",
    "CTAAGTG", "TCAAGTG", "TGAAGTG", "TAAAGTG", "TTAAGTG",
]

# Cells of a numeric column that the CSV readers take for "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Our own layout choices (they change speed, never results).
CHUNK_SIZE = 4096
CHUNK_OVERLAP = 63
HIT_BIN_BITS = 12
