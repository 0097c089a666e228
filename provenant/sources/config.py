"""Policy and guidance of one run: small files, read once on the driver through Spark's readers."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

DEFAULTS = {"block_severities": ["critical", "high"], "warn_severities": ["medium"], "minimum_confidence": 0.7, "exclude": []}


def _text(spark: SparkSession, path: str) -> str | None:
    """The file's text; null if there is none. The file is a person's: one row."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return row[0] if row else None


def parse_policy(text: str) -> dict:
    """JSON, or the flat part of YAML: ``key: value`` lines, and lists as indented ``- value`` lines or in brackets."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- "):
            if key is None or not isinstance(out[key], list):
                raise ValueError(f"a list item without a list: {raw!r}")
            out[key].append(_scalar(line.lstrip()[2:]))
            continue
        key, colon, value = line.strip().partition(":")
        if not colon or line[0] in " \t":
            raise ValueError(f"not a policy line: {raw!r}")
        value = value.strip()
        out[key] = [] if not value else [_scalar(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else _scalar(value)
    return out


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False, "null": None, "~": None}.get(text.lower(), text)


def read_config(spark: SparkSession, folder: str) -> dict:
    """``policy.yml`` over the defaults, ``context.md`` and ``guidelines.md`` (empty where absent)."""
    policy = _text(spark, f"{folder}/policy.yml")
    return DEFAULTS | (parse_policy(policy) if policy else {}) | {k: _text(spark, f"{folder}/{k}.md") or "" for k in ("context", "guidelines")}
