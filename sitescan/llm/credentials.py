"""Secret scan with multipart credential linking.

Strong findings stand alone. Weak ones (a short assigned secret, a random-looking string, an account name, an
address) are reported only where a complementary part lies in the same scope, however far apart the two are. A
scope is a block between blank lines; blank lines inside braces part nothing, so an object is in one scope. A
text without either is running text: there the parts' intervals, widened by a distance, have to meet. Both joins
are sweeps over sorted intervals.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, free_name, map_texts

#: The base kinds in their order and their patterns.
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run as long as it goes: [0-9a-f]+ of 16 or more
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

#: Weak parts.
IDENTIFIER = re.compile(
    r"\b(?:user(?:name)?|login|account|client_?id|(?:access_?)?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}",
    re.ASCII | re.IGNORECASE,
)
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+", re.ASCII)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WEAK_ASSIGN_LENGTH = 6
#: Code points between two parts of one credential in running text.
REACH = 200
BREAK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Strong findings, and assignments too short for one but long enough for a weak part."""
    strong, weak = [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= ASSIGN_LENGTH:
                strong.append(("assign", *m.span()))
            elif size >= WEAK_ASSIGN_LENGTH:
                weak.append(("secret", *m.span()))
    strong += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    strong += [("hex", *m.span()) for m in HEX.finditer(text)]
    return strong, weak


def random_looking(part: str) -> bool:
    """Digits among capital and small letters, and many different characters."""
    kinds = any(c.isdigit() for c in part) + any(c.isupper() for c in part) + any(c.islower() for c in part)
    return kinds == 3 and len(set(part)) * 2 >= min(len(part), 32)


def objects(text: str) -> list[tuple[int, int]]:
    """The outermost pairs of braces, by start; a brace without its partner is none."""
    opened, found = [], []
    for m in re.finditer("[{}]", text):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            first = opened.pop()
            while found and found[-1][0] > first:
                found.pop()
            found.append((first, m.end()))
    return found


def scope_borders(text: str) -> list[int] | None:
    """Where one scope ends and the next begins; None in running text."""
    inside = objects(text) if "{" in text else []
    starts = [a for a, _ in inside]
    breaks = [m.start() for m in BREAK.finditer(text)]
    if not breaks and not inside:
        return None
    out = []
    for at in breaks:
        k = bisect_left(starts, at)
        if not k or inside[k - 1][1] <= at:
            out.append(at)
    return out


class Near:
    """Whether one of many spans lies in the scope of another, or within reach of it in running text."""

    def __init__(self, spans: list[Span], borders: list[int] | None, reach: int):
        self.borders, self.reach = borders, reach
        if borders is not None:
            self.scopes = {bisect_left(borders, a + 1) for _, a, _ in spans}
            return
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        # The furthest end so far: one long span makes no look back over the others.
        self.ends = list(accumulate((b for _, b in ordered), max))

    def __call__(self, span: Span) -> bool:
        _, first, last = span
        if self.borders is not None:
            return bisect_left(self.borders, first + 1) in self.scopes
        at = bisect_right(self.starts, last + self.reach)
        return at > 0 and self.ends[at - 1] >= first - self.reach


def find_credentials(text: str, reach: int = REACH) -> list[Span]:
    """All spans by start and then by kind: the strong ones and the weak ones that complement each other.

    A weak secret needs an identifier, an access id or an endpoint in its scope; an identifier needs a secret; an
    endpoint needs a secret and so is reported with it. Parts inside a strong span are not reported again.
    """
    strong, weak = base_spans(text)
    identifiers = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    endpoints = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    names = [s for s in strong if s[0] == "access"] + identifiers + endpoints
    if not names:
        return sorted(strong, key=_order)
    inside, named = _Cover(strong), _Cover(endpoints + identifiers)
    weak += [("secret", *m.span()) for m in RANDOM.finditer(text) if random_looking(m.group())]
    weak = [s for s in weak if not inside(s) and not named(s)]
    secrets = [s for s in strong if s[0] != "access"] + weak
    if not secrets:
        return sorted(strong, key=_order)
    borders = scope_borders(text)
    found = list(filter(Near(names, borders, reach), weak))
    found += filter(Near(secrets, borders, reach), [s for s in identifiers + endpoints if not inside(s)])
    return sorted({*strong, *found}, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


class _Cover:
    """Whether a span overlaps one of many: starts sorted, each with the furthest end up to it."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def __call__(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]


def scan_credentials(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """Every row of ``docs`` with ``findings`` added: an array of (kind, start, end) in code points.

    The kinds of :data:`KINDS`: the first three are the strong findings, the others the linked weak parts. A
    missing text counts as empty and has none. Texts are searched whole; rows that repeat are searched alike;
    a clashing name gets a trailing underscore.
    """

    def kernel():
        def work(texts: list) -> dict:
            return {"findings": [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_credentials(t, reach)] if t else [] for t in texts
            ]}

        return work

    own = F.struct(*columns_of(docs)).alias("_row")
    made = map_texts(
        docs, [own], F.col(f"`{text}`"), kernel, "findings array<struct<kind:string,start:int,end:int>>"
    )
    return made.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], F.col("findings").alias(free_name(docs, "findings"))
    )
