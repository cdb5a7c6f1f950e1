"""Personal data: fixed formats first, then contextual extraction bootstrapped from them.

Only DataFrame functions. What the formats find are the seeds, whole. The words beside a seed are a lexical
pattern; patterns and the values met in them form a graph. In turns a pattern is scored by the share of known
values among its different values, and a value by the patterns it is met in; a value found so is known to the
next turn, until no further pattern is trusted. Trusted patterns report values of other formats too. Different
values count, not occurrences, so copies add nothing.

What is found depends on the text alone: it is gathered per text digest and joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, digest, free_name, stored, text_of

KINDS = ("email", "ip", "card", "phone", "context")
#: The formats. Repetitions that nothing follows are possessive, and a run of letters or digits is
#: only tried from its beginning, or from the end of the match before: neither changes a match, and the time
#: stays in proportion to the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # runs of fewer digits would be dropped
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: A value a pattern may report: letters, digits, marks and brackets with a digit, and up to four more such groups
#: after single spaces between digits or brackets. Marks at its ends are cut off.
VALUE = (
    r"(?<![A-Za-z0-9._@:/+#()-])(?=[A-Za-z._@:/+#()-]*+[0-9])[A-Za-z0-9._@:/+#()-]++"
    r"(?:(?<=[0-9)])\x20(?=[0-9(])[A-Za-z0-9._@:/+#()-]++){0,4}+"
)
LEAST_LENGTH, LEAST_DIGITS = 6, 4
#: Longest stretch beside a value in which its neighbour words are looked for; longer words make no pattern.
REACH = 120
#: Different known values a pattern needs, its least score, and what damps the score of patterns with few values.
LEAST_SEEDS, LEAST_SCORE, DAMPING = 3, 0.6, 1.0

_FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_SPANS = "array<struct<start:int,k:int,end:int,value:string>>"
_SEEDS = "array<struct<start:int,k:int,end:int,value:string,patterns:array<string>>>"
_VALUES = "array<struct<start:int,end:int,value:string,patterns:array<string>>>"
_BLOCK = 64


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def matches(text: Column, pattern: str) -> Column:
    """Matches from left to right with start, end (code points) and the text before and after, up to the next.

    The text is split at the matches; the lengths of the pieces give the offsets. They are added up block by
    block, so that no long array is copied once a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern)
    rows = F.arrays_zip(pieces.alias("p"), found.alias("f"), F.slice(pieces, 2, F.size(found)).alias("n"))
    named = rows.cast("array<struct<p:string,f:string,n:string>>")
    blocks = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(_BLOCK)), lambda i: F.slice(named, i, _BLOCK))
    begin = lambda at, kind: F.struct(at.alias("at"), none(kind).alias("out"))

    def step(held: Column, row: Column) -> Column:
        first = held["at"] + F.length(row["p"])
        last = first + F.coalesce(F.length(row["f"]), F.lit(0))
        one = F.struct(
            first.alias("start"), last.alias("end"), row["f"].alias("value"), row["p"].alias("before"), row["n"].alias("after")
        )
        out = F.when(row["f"].isNull(), held["out"]).otherwise(F.concat(held["out"], F.array(one)))
        return F.struct(last.alias("at"), out.alias("out"))

    def block(held: Column, part: Column) -> Column:
        made = F.aggregate(part, begin(held["at"], _FOUND), step)
        return F.struct(made["at"].alias("at"), F.concat(held["out"], F.array(made["out"])).alias("out"))

    return F.aggregate(blocks, begin(F.lit(0), f"array<{_FOUND}>"), block, lambda held: F.flatten(held["out"]))


def patterns_of(before: Column, after: Column) -> Column:
    """The two words before a value, and the words on either side, as far as they are there whole."""
    ahead = F.when(F.length(before) <= REACH, F.concat(F.lit(" "), before)).otherwise(
        F.substring(before, F.length(before) - REACH, F.lit(REACH + 1))
    )
    behind = F.when(F.length(after) <= REACH, F.concat(after, F.lit(" "))).otherwise(F.substring(after, 1, REACH + 1))
    word = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]++"

    def last(n: int) -> Column:
        met = F.regexp_extract(ahead, r"[\x20\x09-\x0D]((?:%s){%d})$" % (word, n), 1)
        return F.lower(F.rtrim(F.regexp_replace(met, r"[\x20\x09-\x0D]++", " ")))

    two, one = last(2), last(1)
    follows = F.lower(F.regexp_extract(behind, r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)[\x20\x09-\x0D]", 1))
    return F.array_compact(F.array(
        F.when(two != "", F.concat(F.lit("2 "), two)),
        F.when((one != "") & (follows != ""), F.concat(F.lit("1 "), one, F.lit(" _ "), follows)),
    ))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(
        F.split(value, r"\."), lambda p: (F.length(bare(p)) < 4) & F.coalesce(bare(p).try_cast("int") <= 255, F.lit(False))
    )


def format_spans(text: Column) -> list[Column]:
    """For each format its spans in order, as (start, k, end, value, patterns); k is the kind's place in :data:`KINDS`.

    A cheap test of the text goes first: most texts have none of what a format needs.
    """
    def of(k: int, pattern: str, needed: Column, valid) -> Column:
        good = F.filter(matches(text, pattern), lambda m: valid(m["value"]))
        spans = F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), m["value"].alias("value"),
            patterns_of(m["before"], m["after"]).alias("patterns"),
        ))
        return F.when(needed, spans).otherwise(none(_SEEDS))

    size = lambda v: F.length(digits_of(v))
    return [
        of(0, EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        of(1, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]")), _octets),
        of(2, CARD, F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
           lambda v: size(v).between(14, 19) & luhn(digits_of(v))),
        of(3, PHONE, F.rlike(text, F.lit(r"\+[0-9]")), lambda v: size(v).between(10, 15)),
    ]


def spans_of(seeds: Column) -> Column:
    return F.transform(seeds, lambda s: F.struct(s["start"], s["k"], s["end"], s["value"])).cast(_SPANS)


def candidates(text: Column, formats: list[Column]) -> Column:
    """Candidate values outside the formats' spans as (start, end, value, patterns).

    The spans of one format don't overlap, so the last one that begins before a value ends tells whether it
    reaches into it.
    """
    def reaches(spans: Column, m: Column) -> Column:
        top = F.length(F.bin(F.size(spans))) - 1
        steps = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))
        many = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= F.size(spans)) & (F.get(spans, at + step - 1)["start"] < m["end"]), at + step
        ).otherwise(at))
        return F.coalesce(F.get(spans, many - 1)["end"] > m["start"], F.lit(False))

    def value(m: Column) -> Column:
        left = F.ltrim(m["value"], F.when(F.contains(m["value"], F.lit(")")), "._@:/)-").otherwise("._@:/)-("))
        core = F.rtrim(left, F.when(F.contains(m["value"], F.lit("(")), "._@:/+#(-").otherwise("._@:/+#(-)"))
        start = m["start"] + F.length(m["value"]) - F.length(left)
        # What was cut off stands between the value and its neighbour.
        before = F.when(start == m["start"], m["before"]).otherwise("")
        after = F.when(F.length(left) == F.length(core), m["after"]).otherwise("")
        return F.struct(
            start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), patterns_of(before, after).alias("patterns"),
        )

    def outside(m: Column) -> Column:
        inside = F.lit(False)
        for spans in formats:
            inside = inside | reaches(spans, m)
        return ~inside

    found = F.transform(F.filter(matches(text, VALUE), outside), value)
    return F.when(F.rlike(text, F.lit("[0-9]")), found).otherwise(none(_VALUES))


def facts_of(docs: DataFrame, own: list[Column], text: Column) -> DataFrame:
    """``own, digest, base, edges, values``: the columns ``own`` as one struct, what the formats find, the seeds with
    their patterns, and the candidate values with theirs."""
    whole = docs.select(F.struct(*own).alias("own"), F.coalesce(text, F.lit("")).alias("text"))
    formats = whole.select("own", "text", *[c.alias(f"f{k}") for k, c in enumerate(format_spans(F.col("text")))])
    found = [F.col(f"f{k}") for k in range(len(KINDS) - 1)]
    every = F.sort_array(F.concat(*[spans_of(f) for f in found]))
    return formats.select(
        "own", digest(F.col("text")).alias("digest"), every.alias("base"), F.concat(*found).alias("seeds"),
        candidates(F.col("text"), found).alias("values"),
    )


def score_patterns(edges: DataFrame, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """``pattern, score`` of the patterns that end up trusted.

    ``edges`` has ``pattern, value, seed``, one row each pair. Known values weigh 1, the others what the trusted
    patterns they are met in make of them: 1 - prod(1 - score). A pattern is trusted if enough of its values, known
    or made so, are at least as sure as a trusted pattern, and it scores enough. Weights only grow, and so do the
    trusted patterns: the rounds end when a round trusts no other than the one before.
    """
    weights, before = None, -1
    while True:
        if weights is None:
            now = edges.withColumn("weight", F.col("seed").cast("double"))
        else:
            now = edges.join(weights, "value", "left").select(
                "pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("w", F.lit(0.0))).alias("weight")
            )
        scored = stored(now.groupBy("pattern").agg(
            F.sum("weight").alias("known"), F.count(F.lit(1)).alias("values"), F.count_if(F.col("weight") >= least_score).alias("sure"),
        ).select("pattern", (F.col("known") / (F.col("values") + DAMPING)).alias("score"), "sure").where(
            (F.col("sure") >= least_seeds) & (F.col("score") >= least_score)
        ).select("pattern", "score"))
        trusted = scored.count()
        if trusted <= before or not trusted:
            return scored
        before = trusted
        weights = stored(edges.where("not seed").join(scored, "pattern").groupBy("value").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("w")
        ))


def context_spans(facts: DataFrame, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """``at, context``: per text digest the spans that trusted patterns report outside the formats' spans."""
    def met(column: str, seed: bool) -> DataFrame:
        listed = facts.select(F.explode(column).alias("v")).select(F.explode("v.patterns").alias("pattern"), F.col("v.value").alias("value"))
        return listed.withColumn("seed", F.lit(seed))

    edges = stored(met("seeds", True).unionByName(met("values", False)).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    trusted = score_patterns(edges, least_seeds, least_score)
    open_values = facts.select("digest", F.explode("values").alias("v")).select("digest", "v.*").where(
        (F.length("value") >= LEAST_LENGTH) & (F.length(digits_of(F.col("value"))) >= LEAST_DIGITS)
    ).select("digest", "start", "end", "value", F.explode("patterns").alias("pattern"))
    reported = open_values.join(trusted.select("pattern"), "pattern").select("digest", "start", "end", "value").distinct()
    span = F.struct("start", F.lit(4).alias("k"), "end", "value")
    return reported.groupBy("digest").agg(F.sort_array(F.collect_list(span)).alias("context")).withColumnRenamed("digest", "at")


def _all_spans(facts: DataFrame, **options: float) -> DataFrame:
    """``own, spans`` of every row of the stored ``facts``."""
    context = stored(context_spans(facts, **options))
    joined = facts.select("own", "digest", "base").join(context, F.col("digest") == F.col("at"), "left")
    return joined.select("own", F.sort_array(F.concat("base", F.coalesce("context", none(_SPANS)))).alias("spans"))


def find_personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **options: float) -> DataFrame:
    """Every row of ``docs`` with ``findings`` added: (start, k, end, value) by start and kind, see :data:`KINDS`.

    ``keep`` names the columns to return (all by default); others, a text above all, are then not stored. A
    missing text counts as empty and has no findings. Texts are searched whole; rows that repeat are searched
    alike; an empty table gives no rows; columns may have any name, and a clashing one gives the findings a
    trailing underscore.
    """
    kept = docs.columns if keep is None else keep
    facts = stored(facts_of(docs, [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`")))
    found = _all_spans(facts, **options)
    return found.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(kept)], F.col("spans").alias(free_name(docs, "findings")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        added = F.when(s["start"] < held["at"], held["out"]).otherwise(F.concat(
            held["out"], F.substring(text, held["at"] + 1, s["start"] - held["at"]), F.get(names, s["k"])
        ))
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), added.alias("out"))

    return F.aggregate(
        spans, start, step, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.length(text)))
    )


def redact(docs: DataFrame, text: str = "text", **options: float) -> DataFrame:
    """``docs`` with personal data masked in the text; the columns stay.

    A text without a digit and an at sign can have no findings and is passed on; only the others are searched,
    and of these only rows with findings are made anew. Missing texts stay missing.
    """
    possible = F.rlike(text_of(text), F.lit("[0-9@]"))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    at = docs.columns.index(text)
    facts = stored(facts_of(docs.where(possible), own, F.col(f"`{text}`")))
    body = F.col(f"own.c{at}")
    new = F.when(F.size("spans") > 0, masked(body, F.col("spans"))).otherwise(body)
    made = _all_spans(facts, **options).select(
        *[(new if i == at else F.col(f"own.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    )
    return made.union(docs.where(~possible).select(*columns_of(docs)))
