"""Scalar functions over text, paths, URLs, tokens and scores."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential names, secret patterns in the order they are applied, and their replacements.
CREDENTIAL_NAME = (
    r"(?:password|passwd|secret|token|api[_-]?key|private[_-]?key|client[_-]?secret|access[_-]?key|credential)"
)
REDACTIONS = (
    (r"(?is)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "<redacted-private-key>"),
    (rf"(?im)(\b[\w.-]*{CREDENTIAL_NAME}[\w.-]*\b\s*[:=]\s*)([^\r\n]+)", "$1<redacted-credential>"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "<redacted-jwt>"),
    (
        r"(?i)\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{15,}|"
        r"sk_(?:live|test)_[A-Za-z0-9]{12,}|AIza[A-Za-z0-9_-]{30,})\b",
        "<redacted-provider-token>",
    ),
    (r"(?i)mongodb(?:\+srv)?://[^\s\"'`]+", "<redacted-mongodb-uri>"),
    (r"\b(?:sk|rk)-[A-Za-z0-9_-]{10,}\b", "<redacted-api-key>"),
    (r"\bAKIA[0-9A-Z]{16}\b", "<redacted-aws-access-key>"),
    (r"\bBearer\s+[A-Za-z0-9._-]{16,}\b", "<redacted-bearer-token>"),
)
# Words that name a family of weaknesses and not one root cause; suffixes that stemming removes.
FAMILY_WORDS = (
    "a all allow allows an and any app application are can directly for from into is lead leading leads may not that used uses using was "
    "when where authentication authorization access control bypass check checks claim failure improper injection insufficient issue "
    "missing of on or security the to unverified untrusted user via vulnerability weakness with without"
).split()
PLAIN_WORDS = (
    "a an and are as at by can code data for from in into is it of on or security the to via with issue vulnerability weakness input "
    "output function request user access control missing improper allow allows use uses using not without change changed"
).split()
SUFFIXES = ("ing", "es", "s", "ed")
# Severities from worst to mildest, base scores, depth bonuses, the highest score.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_BASE = {"info": 10, "low": 25, "medium": 50, "high": 75, "critical": 95}
DEPTH_BONUS = {"fast": 0, "standard": 2, "deep": 5}
MAXIMUM_SCORE = 100


def redact(text: Column) -> Column:
    """Secrets replaced by their kind, pattern after pattern."""
    return reduce(lambda c, p: F.regexp_replace(c, F.lit(p[0]), F.lit(p[1])), REDACTIONS, text)


def identity_text(value: Column) -> Column:
    """Trimmed, lower case, slashes forward, whole numbers as #, white space collapsed (letters and digits of any script)."""
    out = F.replace(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\b\d+\b", "#"), r"(?U)\s+", " ")


def plain_text(value: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def path_text(path: Column) -> Column:
    """Forward slashes, trimmed, any leading run of dots and slashes removed (.env becomes env)."""
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"^[./]+", "")


def is_safe_path(path: Column) -> Column:
    """Relative, without drive, parent step or NUL."""
    return F.coalesce(~path.rlike(r"^/|^[A-Za-z]:|\x00|\\") & ~path.rlike(r"(^|/)\.\.(/|$)") & (path != ""), F.lit(False))


def slug(value: Column, separator: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", separator), f"^{separator}+|{separator}+$", "")


def words(text: Column, dropped: list[str], least: int = 3) -> Column:
    """Distinct alphanumeric words of the lower-cased text, in order, without short and dropped ones."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*dropped)))


def stem(word: Column) -> Column:
    """The first of the suffixes that fits is removed, if three characters stay."""
    out = word
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        fits = word.endswith(suffix) & (F.length(word) >= n + 3)
        out = F.when(fits, F.substring(word, F.lit(1), F.length(word) - n)).otherwise(out)
    return out


def stemmed_words(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text, FAMILY_WORDS), stem))


def cwe_numbers(text: Column) -> Column:
    """Distinct CWE numbers in a text, as numbers, ascending."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bcwe[\s_:-]*(\d{1,5})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def canonical_class(vulnerability_class: Column, title: Column) -> Column:
    """The smallest CWE, else the sorted words joined by hyphens, else the plain text."""
    numbers = cwe_numbers(F.concat_ws(" ", vulnerability_class, title))
    tokens = F.array_join(F.array_sort(words(vulnerability_class, PLAIN_WORDS)), "-")
    return F.when(F.size(numbers) > 0, F.concat(F.lit("cwe-"), F.array_min(numbers).cast("string"))).otherwise(
        F.when(tokens != "", tokens).otherwise(plain_text(vulnerability_class))
    )


def source_hash(code: Column) -> Column:
    """SHA-256 of the text with white space collapsed; null if nothing is left."""
    text = F.trim(F.regexp_replace(code, r"\s+", " "))
    return F.when(text != "", F.sha2(text, 256))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if either is empty or null."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union), F.lit(0.0))


def url_text(url: Column) -> Column:
    """An http(s) URL with lower-case host, without default port, query, fragment and trailing slashes; other text without those slashes."""
    raw = F.trim(url)
    scheme, host = F.lower(F.try_parse_url(raw, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(raw, F.lit("HOST")))
    port = F.regexp_extract(F.coalesce(F.try_parse_url(raw, F.lit("AUTHORITY")), F.lit("")), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(raw, F.lit("PATH")), F.lit("")), "/+$", "")
    good = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path))
    return F.when(scheme.isin("http", "https") & host.isNotNull(), good).otherwise(F.regexp_replace(raw, "/+$", ""))


def trailing_space_text(code: Column) -> Column:
    return F.trim(F.regexp_replace(code, r"(?m)[ \t\r]+$", ""))


def model_lines(text: Column) -> Column:
    """Line ends as models write them (</n>, <br>, CRLF) turned into newlines, and split."""
    return F.split(F.regexp_replace(text, r"(?i)</n>|<br\s*/?>|\r\n?", "\n"), "\n")


def consecutive(values: Column) -> Column:
    """Pairs of neighbours of an array: the edges of a path."""
    n = F.size(values)
    pairs = F.arrays_zip(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.when(n > 1, F.transform(pairs, lambda p: F.struct(p["a"].alias("source"), p["b"].alias("target")))).otherwise(
        F.transform(F.slice(values, 1, 0), lambda v: F.struct(v.alias("source"), v.alias("target")))
    )


def quoted_in(quote: Column, lines: Column) -> Column:
    """The quote occurs in the lines, white space collapsed on both sides."""
    q, t = (F.trim(F.regexp_replace(c, r"\s+", " ")) for c in (quote, lines))
    return F.coalesce((q != "") & (F.instr(t, q) > 0), F.lit(False))


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small map as a literal."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key), F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 for the worst; unknown severities come last."""
    return lookup(F.lower(severity), {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def priority_score(severity: Column, confidence: Column, depth: Column) -> Column:
    """min(highest, round half to even(base(severity) * confidence + bonus(depth)))."""
    raw = lookup(severity, SEVERITY_BASE, 0) * confidence + lookup(depth, DEPTH_BONUS, 0)
    return F.least(F.lit(MAXIMUM_SCORE), F.bround(raw).cast("int"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def query_budget(files: Column, tasks: Column, per_task: int = 30, small_files: int = 25, small_per_task: int = 8, small_total: int = 60) -> Column:
    """Search queries allowed: so many per task; fewer, and at most a total, for a small repository; one at least."""
    small = F.least(tasks * small_per_task, F.lit(small_total))
    return F.greatest(F.lit(1), F.when((files > 0) & (files <= small_files), small).otherwise(tasks * per_task)).cast("int")
