"""Redactions that need a look at the value itself: Arrow-batched, for scripts, code and nested payloads."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from provenant.functions.text import CREDENTIAL_NAME, REDACTIONS

# How a credential is assigned, what stands for a value without being one, templates, the least length of a literal.
ASSIGNED = rf"\b[\w.-]*{CREDENTIAL_NAME}[\w.-]*\b[\"']?\s*[:=]\s*"
STAND_IN = r"\$\{?[A-Za-z_][A-Za-z0-9_]*(?::[^}]*)?\}?|<[^<>]{1,80}>|\{\{[^{}]{1,80}\}\}|[A-Z][A-Z0-9_]{2,}"
BARE_STAND_IN = re.sub(r"\[\^([^]]+)\]", r"[^\1\\s\"'&;|)]", STAND_IN)
TEMPLATE = r"[\w.-]*(?:\$\{[^}]*\}|%s|\{\})[\w./-]*"
LEAST_LITERAL = 6
BARE_END = r"[\s\"'&;|)]"
PLAIN = [(re.compile(p), r.replace("$1", r"\1")) for p, r in REDACTIONS]


def plain(text: str) -> str:
    for pattern, to in PLAIN:
        text = pattern.sub(to, text)
    return text


def _quoted(quote: str, code: bool) -> tuple[str, str]:
    """Pattern and replacement for a quoted value that is none of the exceptions."""
    inside, solid = f"[^{quote}\\n]", f"[^\\s{quote}]"
    spared = rf"(?!\s*(?-i:{STAND_IN})\s*{quote})"
    if code:
        spared += rf"(?!(?-i:{TEMPLATE}){quote})(?=\s*{solid}{inside}{{{LEAST_LITERAL - 2},}}{solid}\s*{quote})"
    return rf"(?i)({ASSIGNED}){quote}{spared}{inside}+{quote}", f"$1{quote}<redacted-credential>{quote}"


def _values(code: bool) -> list[tuple[str, str]]:
    """What replaces values: quoted ones of either kind and, in a script, bare ones."""
    bare = (rf"(?i)({ASSIGNED})(?!(?-i:{BARE_STAND_IN})(?:{BARE_END}|$))[^\s\"'&;|)]+", "$1<redacted-credential>")
    return [_quoted('"', code), _quoted("'", code), *([] if code else [bare])]


def _guarded(column, code: bool):
    """The known formats of secrets wherever they occur; of assignments only the value, so that the line stays whole."""
    key, rest = REDACTIONS[0], [(p, "Bearer " + to if "bearer" in to else to) for p, to in REDACTIONS[1:] if "$1" not in to]
    return reduce(lambda c, p: F.regexp_replace(c, F.lit(p[0]), F.lit(p[1])), [key, *_values(code), *rest], F.col(column) if isinstance(column, str) else column)


def leaves(value):
    """Every text in a nested value redacted; keys stay."""
    if isinstance(value, str):
        return plain(value)
    if isinstance(value, dict):
        return {k: leaves(v) for k, v in value.items()}
    return [leaves(v) for v in value] if isinstance(value, list) else value


def _mapped(fn):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return run


def redact_script(column):
    """Any assigned value but a placeholder goes; placeholders that the script reads from its surroundings stay."""
    return _guarded(column, False)


def redact_code(column):
    """Only quoted literals of at least six characters go, and none that is a placeholder or a template; expressions stay."""
    return _guarded(column, True)


def redact_json(column):
    """Every leaf of a JSON text, written back with sorted keys; text that is no JSON is redacted as a whole."""

    def one(t: str) -> str:
        try:
            return json.dumps(leaves(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return plain(t)

    return _mapped(one)(column)


def repaired_json(column):
    """The JSON object in a text: as it is, in a fence, or the widest braces; doubly encoded text is unwrapped; null if there is none."""

    def one(t: str) -> str | None:
        fence = re.search(r"```(?:json)?\s*(.*?)```", t, re.DOTALL)
        for part in (t, fence[1] if fence else "", t[t.find("{") : t.rfind("}") + 1]):
            try:
                got = json.loads(part)
                got = json.loads(got) if isinstance(got, str) else got
            except ValueError:
                continue
            if isinstance(got, dict):
                return json.dumps(got, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return None

    return _mapped(one)(column)


def structured(df: DataFrame, column: str, schema: StructType, required: list[str]) -> DataFrame:
    """Adds ``value`` (a struct of ``schema``, null if the text has no JSON object or lacks a required field) and ``reasons``: why it isn't wholly good.

    Reasons: no_json, missing:<field> for required fields, type:<field> for fields whose value is of another type (they are null in ``value``). The object is
    found as by ``repaired_json`` and read by a permissive typed parse, which keeps the fields that fit.
    """
    fields = [f.name for f in schema.fields]
    row = df.withColumn("_j", repaired_json(F.col(column)))
    typed = row.withColumn("_t", F.from_json("_j", StructType([*schema.fields, StructField("_corrupt", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))

    def has(name: str):
        return F.get_json_object("_j", f"$['{name}']").isNotNull()

    wrong = [F.when(has(f) & F.col("_t").getField(f).isNull(), F.lit(f"type:{f}")) for f in fields]
    missing = [F.when(~has(f), F.lit(f"missing:{f}")) for f in required]
    reasons = F.when(F.col("_j").isNull(), F.array(F.lit("no_json"))).otherwise(F.array_compact(F.array(*missing, *wrong)))
    good = F.col("_j").isNotNull()
    for f in required:
        good = good & F.col("_t").getField(f).isNotNull()
    value = F.when(good, F.struct(*[F.col("_t").getField(f).alias(f) for f in fields]))
    return typed.withColumn("value", value).withColumn("reasons", reasons).drop("_j", "_t")


def field_characters(column, names: list[str]):
    """Characters of all texts under fields of the given names, at any depth of a JSON text."""

    def size(x, inside: bool) -> int:
        if isinstance(x, str):
            return len(x) if inside else 0
        if isinstance(x, dict):
            return sum(size(v, inside or k in names) for k, v in x.items())
        return sum(size(v, inside) for v in x) if isinstance(x, list) else 0

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        def one(t) -> int:
            try:
                return size(json.loads(t), False) if t else 0
            except ValueError:
                return 0

        return texts.map(one)

    return run(column)


def unescaped_lines(column):
    """Escaped newlines outside quotes become line ends."""

    def one(t: str) -> str:
        out, quote, i = [], "", 0
        while i < len(t):
            c = t[i]
            if not quote and t.startswith("\\n", i):
                out.append("\n")
                i += 2
                continue
            if c in "\"'`" and (not quote or quote == c):
                quote = "" if quote else c
            out.append(c)
            i += 1
        return "".join(out)

    return _mapped(one)(column)
