"""Benchmark decontamination: windows of test items looked up in every token window of the documents.

Only DataFrame functions. The distinct window hashes are the broadcast set; what it lets through is verified
word by word against the items. Everything an item window decides depends on the text alone, so hits are
gathered per text digest and joined back to the rows: thousands of copies of one text cost one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, digest, free_name, lower_az, stored, text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most distinct window hashes (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of the lower-cased text; no text has no words."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, len, key, gram``: the distinct windows of each item.

    An item with fewer than ``n`` words is one window, an item without words none. Copies of an item are
    one row.
    """
    words = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), words_of(F.col(f"`{text}`")).alias("words"))
    size = F.size("words")
    length = F.least(size, F.lit(n))
    sized = words.where(size > 0).select("*", length.alias("len"), hashes_of(F.col("words")).alias("hashes"))
    at = sized.select("*", F.explode(F.sequence(F.lit(1), size - length + 1)).alias("at"))
    return at.select(
        "item_id", "len", F.xxhash64(F.slice("hashes", F.col("at"), F.col("len"))).alias("key"),
        F.slice("words", F.col("at"), F.col("len")).alias("gram"),
    ).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """``digest, at, len, item_id``: each occurrence of an item's window in a distinct text, ``at`` from 1.

    Document windows are made for the lengths that the items have (at most ``n`` of them), in one scan. The join with the
    hash set is a broadcast up to :data:`BROADCAST_WINDOWS` distinct hashes, which sees the words at hand. Beyond,
    it is a shuffled join of places and hashes alone; those that meet a hash fetch their words by a second join.
    """
    keys = windows.select("key").distinct()
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    near = keys.count() <= BROADCAST_WINDOWS
    whole = text_of(text)
    words = docs.select(digest(whole).alias("digest"), words_of(whole).alias("words"))
    hashed = words.where(F.size("words") >= (lengths[0] if lengths else 1)).select(
        "*", hashes_of(F.col("words")).alias("hashes")
    )
    probes = hashed.select("*", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"))
    if len(lengths) > 1:
        probes = probes.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("len"))
    else:
        probes = probes.withColumn("len", F.lit(lengths[0] if lengths else 1))
    probes = probes.where(F.col("at") + F.col("len") <= F.size("words") + 1).select(
        "digest", *(["words"] if near else []), "at", "len", F.xxhash64(F.slice("hashes", F.col("at"), F.col("len"))).alias("key")
    )
    if near:
        found = probes.join(F.broadcast(keys), "key", "left_semi")
    else:
        places = probes.distinct().join(keys, "key", "left_semi").groupBy("digest").agg(F.collect_list(F.struct("at", "len", "key")).alias("places"))
        once = words.join(places.select(F.col("digest").alias("_digest")), F.col("digest") == F.col("_digest"), "left_semi").groupBy("digest").agg(
            F.first("words").alias("words")
        )
        found = once.join(places, "digest").select("digest", "words", F.explode("places").alias("p")).select("digest", "words", "p.*")
    found = found.select("digest", "at", "key", "len", F.slice("words", F.col("at"), F.col("len")).alias("gram"))
    # Copies of a text repeat its hits: they are folded before the items are looked up.
    once = found.distinct()
    return once.join(windows, ["key", "len", "gram"]).select("digest", "at", "len", "item_id")


def gather_hits(hits: DataFrame) -> DataFrame:
    """``digest, spans, n_hit, item_ids``: per text the hit windows (merged), words inside and items, sorted."""
    spans = hits.groupBy("digest", "at").agg(F.max(F.col("at") + F.col("len")).alias("end"))
    merged = spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("found")).select(
        "digest",
        F.expr(
            "aggregate(found, cast(array() as array<struct<at:int,end:int>>), (acc, x) -> "
            "case when size(acc) > 0 and element_at(acc, -1).end >= x.at then "
            "concat(slice(acc, 1, size(acc) - 1), array(named_struct('at', element_at(acc, -1).at, "
            "'end', greatest(element_at(acc, -1).end, x.end)))) "
            "else concat(acc, array(named_struct('at', x.at, 'end', x.end))) end)"
        ).alias("spans"),
    )
    items = hits.where("item_id is not null").select("digest", F.col("item_id").cast("string").alias("item")).distinct()
    named = items.groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    return merged.join(named, "digest", "left").select(
        "digest", "spans",
        F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.at)").alias("n_hit"),
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_hit, item_ids, spans, contaminated`` added.

    ``spans`` are merged word ranges ``[at, end)`` counted from 1. A missing or empty text has no words and no
    hits; an empty benchmark marks nothing; rows that repeat are all kept; an item without an id marks words
    but is not listed. Names that clash with columns of ``docs`` get a trailing underscore.
    """
    windows = stored(item_windows(benchmark, n, item_id, item_text))
    hits = stored(window_hits(docs, windows, text))
    # Stored, so that both sides of the join below are shuffled for it and a hot digest can be split.
    found = stored(gather_hits(hits))
    key = free_name(docs, "digest")
    names = {c: free_name(docs, c) for c in ("n_words", "n_hit", "item_ids", "spans", "contaminated")}
    whole = text_of(text)
    keyed = docs.withColumns({
        key: digest(whole), names["n_words"]: F.size(words_of(whole)).cast("long"),
    })
    right = found.select(*[F.col(c).alias(f"_found_{c}") for c in found.columns])
    joined = keyed.join(right, F.col(f"`{key}`") == F.col("_found_digest"), "left")
    hit = F.coalesce("_found_n_hit", F.lit(0))
    return joined.select(
        *columns_of(docs), F.col(f"`{names['n_words']}`"), hit.cast("long").alias(names["n_hit"]),
        F.coalesce("_found_item_ids", F.expr("cast(array() as array<string>)")).alias(names["item_ids"]),
        F.coalesce("_found_spans", F.expr("cast(array() as array<struct<at:int,end:int>>)")).alias(names["spans"]),
        (hit > 0).alias(names["contaminated"]),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 10, text: str = "text", **names: str,
) -> DataFrame:
    """``docs`` without the contaminated rows (``documents``) or with the hit words cut out (``spans``).

    Cutting keeps what stands between and around the words. The columns stay those of ``docs``.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    marked = find_contamination(docs, benchmark, n, text, **names)
    spans, flag = marked.columns[-2], marked.columns[-1]
    if mode == "documents":
        return marked.where(~F.col(f"`{flag}`")).select(*columns_of(docs))
    whole = text_of(text)
    raw = F.array_remove(F.split(whole, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    between = F.split(whole, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    kept = F.transform(
        raw, lambda w, i: F.when(F.exists(F.col(f"`{spans}`"), lambda s: (s["at"] <= i + 1) & (i + 1 < s["end"])), "")
        .otherwise(w)
    )
    pieces = F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(kept, i), F.lit(""))))
    glued = F.array_join(pieces, "")
    cut = F.when(F.col(f"`{flag}`"), glued).otherwise(F.col(f"`{text}`"))
    return marked.withColumn(text, cut).select(*columns_of(docs))
