"""Secret scan with multipart credential linking.

Base findings follow fixed patterns. Beside them there are weak candidates, too common to report alone: access
identifiers, secret-like strings and endpoints. Within a scope, an interval of the text around a candidate, candidates are joined by
interval overlap; weak ones are reported only where complementary parts co-occur: an identifier and a secret, or a
secret and an endpoint.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import small_batches

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex")

#: Weak candidates. An identifier: 16 to 32 upper-case letters and digits, both present. A secret: 24 or more
#: mixed characters of high entropy. An endpoint: a URL, or a host or endpoint setting.
WEAK_ID = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Z0-9]{16,32}(?![A-Za-z0-9+/_=-])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|\b(?:host|endpoint|server|region|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9][A-Za-z0-9.:/_-]{3,}", re.ASCII | re.IGNORECASE)
#: Code points that a scope reaches from its candidate to either side.
SCOPE = 200
#: Bits per character from which a string may be a secret.
LEAST_ENTROPY = 3.5
#: Which other parts make a weak candidate worth reporting.
COMPLEMENTS = {"weak_id": ("secret",), "weak_secret": ("id", "endpoint"), "endpoint": ("secret",)}
PART = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
ORDER = {k: i for i, k in enumerate((*KINDS, "weak_id", "weak_secret", "endpoint"))}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The findings of the base patterns (whole matches, code points, end exclusive), leftmost and non-overlapping for each kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], ORDER[span[0]], span[2]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def weak_candidates(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that overlap no base finding."""
    ends = sorted((a, b) for _, a, b in base)
    starts, reach, far = [a for a, _ in ends], [], 0
    for _, b in ends:
        far = max(far, b)
        reach.append(far)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or reach[i - 1] <= a

    found: list[Span] = []
    for m in WEAK_ID.finditer(text):
        value = m[0]
        if not value.isdigit() and not value.isalpha() and free(*m.span()):
            found.append(("weak_id", *m.span()))
    taken = {(a, b) for _, a, b in found}
    for m in WEAK_SECRET.finditer(text):
        value = m[0]
        mixed = any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)
        if mixed and m.span() not in taken and free(*m.span()) and entropy(value) >= LEAST_ENTROPY:
            found.append(("weak_secret", *m.span()))
    found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text) if free(*m.span())]
    return sorted(found, key=_place)


def linked(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak candidates whose scope holds a complementary part, base or weak.

    An interval join of scopes with parts: for each kind of part its starts are sorted, with the largest end so far; a scope
    [a - scope, b + scope) meets a part iff one starts before its end and reaches past its start.
    """
    parts: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in [*base, *weak]:
        parts.setdefault(PART[kind], []).append((a, b))
    sides = {}
    for part, spans in parts.items():
        spans.sort()
        ends, far = [], -1
        for _, b in spans:
            far = max(far, b)
            ends.append(far)
        sides[part] = ([a for a, _ in spans], ends)

    def meets(part: str, low: int, high: int) -> bool:
        if part not in sides:
            return False
        starts, ends = sides[part]
        i = bisect_right(starts, high - 1)
        return i > 0 and ends[i - 1] > low

    return [s for s in weak if any(meets(p, s[1] - scope, s[2] + scope) for p in COMPLEMENTS[s[0]])]


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base findings; base and linked weak findings, in order."""
    if not text:
        return [], []
    base = base_spans(text)
    weak = weak_candidates(text, base)
    kept = linked(base, weak) if weak else []
    return base, sorted([*base, *kept], key=_place)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        base, every = [], []
        for text in batch.column("text").to_pylist():
            b, s = scan(text)
            base.append([dict(zip(("kind", "start", "end"), x)) for x in b])
            every.append([dict(zip(("kind", "start", "end"), x)) for x in s])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(base, type=pa.list_(span)), pa.array(every, type=pa.list_(span))], names=["doc_id", "base", "spans"]
        )


def find(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, base, spans``: arrays of (kind, start, end), a row for each row, nothing shuffled.

    Null and empty texts have empty arrays. Positions are code points, ends exclusive. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan_batches, f"doc_id long, base {kind}, spans {kind}"
    )


def digest(found: DataFrame) -> DataFrame:
    """``find`` -> doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
