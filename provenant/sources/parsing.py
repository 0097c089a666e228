"""Source text -> symbols, calls, references and imports, by lines and nesting. Approximate: by text, not by a grammar.

A file's lines lose their strings and comments; what is left tells nesting. In languages with braces the depth is a prefix sum over a file's
braces, and braces of one depth alternate, so an opening one is closed by the next of its depth. In languages with indentation a block ends
before the next line that is indented no deeper. All is one pass over a file, which sources bound in size, where the file lies: no line travels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from provenant.operators.graphs import stored
from provenant.sources import readers as Z

# Languages by extension and how they nest.
BRACES = ("js", "jsx", "ts", "tsx", "mjs", "go", "java", "rs", "c", "h", "cpp", "cs", "php", "kt", "scala")
INDENTED = ("py",)
WITH_END = ("rb",)
# Words that look like calls or names and are none.
KEYWORDS = (
    "and", "as", "assert", "async", "await", "break", "case", "catch", "class", "const", "continue", "def", "default", "defer", "del", "do", "elif", "else", "end", "enum", "except", "export", "extends",
    "false", "final", "finally", "fn", "for", "foreach", "from", "fun", "func", "function", "if", "impl", "implements", "import", "in", "instanceof", "interface", "is", "lambda", "let", "module", "mut",
    "new", "nil", "None", "not", "null", "or", "package", "pass", "private", "protected", "pub", "public", "raise", "return", "self", "sizeof", "static", "struct", "super", "switch",
    "this", "throw", "trait", "true", "try", "typeof", "undefined", "unless", "use", "using", "var", "void", "while", "with", "yield", "True", "False",
)
NAME = r"[A-Za-z_$][\w$]*"
#: Definitions in order: kind, languages, pattern with the name as its group.
DEFINITIONS = (
    ("class", INDENTED + WITH_END, rf"^\s*(?:class|module)\s+({NAME})"),
    ("function", INDENTED, rf"^\s*(?:async\s+)?def\s+({NAME})"),
    ("function", WITH_END, rf"^\s*def\s+(?:self\.)?({NAME}[?!]?)"),
    ("class", BRACES, rf"^\s*(?:[\w@]+(?:\([^)]*\))?\s+)*?(?:class|interface|enum|struct|trait|object|record|impl)\s+({NAME})"),
    ("type", ("go",), rf"^\s*type\s+({NAME})\s+(?:struct|interface)\b"),
    ("function", BRACES, rf"^\s*(?:\w+(?:\([^)]*\))?\s+)*?(?:function\s*\*?|fn|fun|func(?:\s*\([^)]*\))?)\s+({NAME})"),
    ("function", ("js", "jsx", "ts", "tsx", "mjs"), rf"^\s*(?:export\s+)?(?:const|let|var)\s+({NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*(?::[^=]+)?=>"),
    ("method", BRACES, rf"^\s*(?:[\w<>\[\],.*&?:]+\s+)*?[*&]*(?!(?:if|for|while|switch|catch|return|else|do|with|new|throw|case|foreach|using|lock|synchronized)\b)({NAME})\s*\([^;]*\)[^;=]*\{{\s*$"),
)
IMPORTS = (
    (INDENTED, r"^\s*((?:import\s+\S|from\s+\S+\s+import\s).*)$"),
    (WITH_END, r"^\s*(require(?:_relative)?\s.*)$"),
    (BRACES, r"^\s*((?:import|use|using|#\s*include)\b.*)$"),
)
STRINGS = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"
MOST_REFERENCES = 5_000


@dataclass
class Parsed:
    """``symbols(symbol_id, path, name, qualified, kind, line, end_line, signature, content_hash)``, ``calls(path, caller, callee, line)``,
    ``references(path, source, target, line, kind)``, ``imports(path, text, line)``, ``routes(path, line_no, route)``."""

    symbols: DataFrame
    calls: DataFrame
    references: DataFrame
    imports: DataFrame
    routes: DataFrame


def language(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


#: What a file is parsed to; ``owner``: the qualified name of the innermost definition around a line, null: none, so the file.
FOUND = {
    "symbols": "line int, end_line int, name string, kind string, signature string, qualified string, content_hash string",
    "calls": "owner string, callee string, line int",
    "references": "owner string, target string, line int",
    "imports": "text string, line int",
    "routes": "line_no int, route string",
}
#: Found items after which a batch leaves, so that what a worker holds is bounded by this and a file.
BATCH_ITEMS = 50_000


def _compiled(pattern: str) -> re.Pattern:
    """As Spark's functions read it: ASCII classes; a dot stops at every line end, ``$`` stands before a last one, too."""
    ends, out = "\\r\\u0085\\u2028\\u2029", []
    for token in re.findall(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|[^\\\[]", pattern, re.S):
        out.append({".": f"[^\\n{ends}]", "$": f"(?=(?:\\r\\n|[\\n{ends}])?\\Z)", r"\b": r"(?u:\b)"}.get(token, token))
    return re.compile("".join(out), re.ASCII)


_DEFINITIONS = [(kind, langs, _compiled(pattern)) for kind, langs, pattern in DEFINITIONS]
#: Of each language: what may define and what imports.
_RULES = {x: [(kind, p) for kind, langs, p in _DEFINITIONS if x in langs] for x in (*BRACES, *INDENTED, *WITH_END)}
_IMPORTS = {x: _compiled(p) for langs, p in IMPORTS for x in langs}
_ROUTE = _compiled(Z.ROUTE)
_STRINGS, _TRIPLES, _TRIPLE = _compiled(STRINGS), _compiled(r"(\"{3}|'{3}).*?\1"), re.compile(r"\"{3}|'{3}")
_REMARK, _SLASHES, _HASH, _OPENS, _CLOSES = (_compiled(p) for p in (r"/\*.*?\*/", r"//.*$", r"#.*$", r"/\*.*$", r"^.*\*/"))
_MARK = "\x01"
_MARK_OPENS, _MARK_CLOSES = _compiled(f"{_MARK}.*$"), _compiled(f"^.*{_MARK}")
#: A definition has a word, a blank and a word, or ends in an opening bracket.
_LIKELY = _compiled(r"\w[\s*]+\S|\{\s*$")
_BRACE, _BODILESS, _BLANKS = re.compile("[{}]"), _compiled(r";\s*$"), _compiled(r"\s+")
_BODY, _COLON = _compiled(r"\{.*$"), _compiled(r":\s*(pass)?\s*$")
_CALL, _WORD = _compiled(rf"(?<![\w$.])({NAME}(?:\s*\.\s*{NAME})*)\s*\("), _compiled(rf"(?<![\w$])({NAME})")
_KEYWORDS = frozenset(KEYWORDS)


def _code(lines: list[str], braces: bool) -> Iterator[str]:
    """Lines without strings and comments, also those that run over lines."""
    so_far = 0
    for text in lines:
        quotes = '"' in text or "'" in text
        if braces:
            bare = _STRINGS.sub('""', text) if quotes or "`" in text else text
            if "/" in bare:
                bare = _SLASHES.sub("", _REMARK.sub(" ", bare))
            turns = bare.count("/*") - bare.count("*/")
            inside = so_far > 0
        else:
            # each unpaired triple quote changes between text and code
            bare = _TRIPLE.sub(_MARK, _TRIPLES.sub('""', text)) if quotes else text
            bare = _STRINGS.sub('""', bare) if quotes or "`" in bare else bare
            bare = _HASH.sub("", bare) if "#" in bare else bare
            turns = bare.count(_MARK)
            inside = so_far % 2 == 1
        so_far += turns
        if inside:
            yield (_CLOSES if braces else _MARK_CLOSES).sub("", bare) if turns else ""
        else:
            yield (_OPENS if braces else _MARK_OPENS).sub("", bare) if turns else bare


def _braced(code: list[str], marked: dict[int, tuple[str, str]]) -> list[int]:
    """The last lines of the marked definitions' blocks. A line's events in order: its definition (as if a level deeper), then its braces, each at the level that it opens or closes."""
    depth, last, levels, starts = 0, 0, {}, []
    for n, c in enumerate(code, 1):
        own = n in marked
        if own:
            at = levels.setdefault(depth + 1, [])
            starts.append((n, at, len(at)))
            at.append(("d", n))
            last = n
        if "{" in c or "}" in c:
            last = n
            for e in _BRACE.findall(c):
                if e == "{":
                    depth += 1
                    levels.setdefault(depth, []).append((e, n))
                else:
                    levels.setdefault(depth, []).append((e, n))
                    depth -= 1
    ends = []
    for n, at, i in starts:
        # a definition is followed, among the events of its level, by its opening and its closing brace
        if i + 1 >= len(at) or at[i + 1][0] != "{" or _BODILESS.search(code[n - 1]):
            ends.append(n)
        else:
            ends.append(at[i + 2][1] if i + 2 < len(at) and at[i + 2][0] == "}" else last)
    return ends


def _indented(code: list[str], full: list[int], marked: dict[int, tuple[str, str]], with_end: bool) -> list[int]:
    """The last lines of the marked definitions' blocks: a line closes the blocks of all indentations from its own on."""
    ends, opened, before = {}, [], 0
    for n in full:
        c = code[n - 1].replace("\t", "        ")
        indent = len(c) - len(c.lstrip(" "))
        while opened and opened[-1][0] >= indent:
            level, start = opened.pop()
            ends[start] = n if with_end and level == indent and code[n - 1].strip(" ") == "end" else before
        if n in marked:
            opened.append((indent, n))
        before = n
    return [ends.get(n, before) for n in marked]


def _parsed(content: str, lang: str, most_references: int, hashes: bool, wanted: frozenset[str] = frozenset(FOUND)) -> dict[str, list[tuple]]:
    """A file's items, as ``FOUND`` has them, of the kinds that are wanted."""
    found = {what: [] for what in FOUND}
    lines, braces = content.split("\n"), lang in BRACES
    code = list(_code(lines, braces))
    full = [n for n, c in enumerate(code, 1) if c.strip(" ")]
    rules, marked = _RULES[lang], {}
    for n in full:
        c = code[n - 1]
        if _LIKELY.search(c):
            for kind, rule in rules:
                hit = rule.match(c)
                if hit:
                    marked[n] = (kind, hit[1])
                    break
    ends = _braced(code, marked) if braces else _indented(code, full, marked, lang in WITH_END)

    # definitions are gone through in order with those that are open, so each costs its depth; an end comes before a beginning on the same line
    events = sorted([(n, 1, end) for n, end in zip(marked, ends)] + [(end + 1, 0, 0) for end in ends])
    steps, still = [], []
    for at, begins, end in events:
        still = [x for x in still if x[2] >= at]
        if begins:
            kind, name = marked[at]
            qualified = ".".join([x[3] for x in still if x[2] >= end] + [name])
            still.append((max(1, end - at), at, end, name, qualified))
            if "symbols" in wanted:
                head = _BLANKS.sub(" ", _COLON.sub("", _BODY.sub("", code[at - 1]))).strip(" ")
                digest = hashlib.sha256("\n".join(lines[at - 1:end]).encode()).hexdigest() if hashes else None
                found["symbols"].append((at, end, name, kind, head, qualified, digest))
        steps.append((at, min(still)[4] if still else None))

    owner, step, n_references = None, 0, 0 if "references" in wanted else most_references
    for n in full if "calls" in wanted or "references" in wanted else ():
        while step < len(steps) and steps[step][0] <= n:
            owner, step = steps[step][1], step + 1
        c, own = code[n - 1], marked[n][1] if n in marked else ""
        if "(" in c and "calls" in wanted:
            for x in _CALL.findall(c):
                callee = _BLANKS.sub("", x)
                if callee not in _KEYWORDS and callee != own:
                    found["calls"].append((owner, callee, n))
        if n_references < most_references:
            words = [x for x in _WORD.findall(c) if x not in _KEYWORDS and x != own][:most_references - n_references]
            n_references += len(words)
            found["references"] += [(owner, x, n) for x in dict.fromkeys(words)]
    rule, first = _IMPORTS[lang], {}
    for n in full if "imports" in wanted else ():
        hit = rule.match(lines[n - 1])
        if hit:
            first.setdefault(hit[1].strip(" "), n)
    found["imports"] += first.items()
    if "routes" in wanted and _ROUTE.search(content):
        for n, text in enumerate(lines, 1):
            hit = _ROUTE.search(text)
            if hit:
                found["routes"].append((n, f"{hit[1].upper()} {hit[2]}"))
    return found


def _parsed_batches(batches: Iterator[pa.RecordBatch], most_references: int, hashes: bool, wanted: frozenset[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Files (path, lang, content) -> a row each: path and lists of what it holds. Files of other languages (lang null) are one symbol of kind ``file`` each."""
    kinds = {what: schema.field(what).type for what in FOUND}

    def batch(paths: pa.Array, rows: list[dict[str, list[tuple]]]) -> pa.RecordBatch:
        columns = [paths]
        for what, kind in kinds.items():
            fields, offsets, total = list(kind.value_type), [0], 0
            for r in rows:
                total += len(r[what])
                offsets.append(total)
            values = [*zip(*(x for r in rows for x in r[what]))] or [()] * len(fields)
            items = pa.StructArray.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, fields)], fields=fields)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), items, type=kind))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for b in batches:
        paths, langs, contents = b.column(0), b.column(1).to_pylist(), b.column(2)
        start, rows, items = 0, [], 0
        for i, lang in enumerate(langs):
            raw = contents[i].as_py()
            if lang is None:
                n = raw.decode("utf-8", "replace").removesuffix("\n").count("\n") + 1
                found = {what: [] for what in FOUND}
                if "symbols" in wanted:
                    found["symbols"].append((1, n, None, "file", "", None, hashlib.sha256(raw).hexdigest() if hashes else None))
            else:
                found = _parsed(raw.decode("utf-8", "replace"), lang, most_references, hashes, wanted)
            rows.append(found)
            items += sum(map(len, found.values()))
            if items >= BATCH_ITEMS:
                yield batch(paths.slice(start, len(rows)), rows)
                start, rows, items = i + 1, [], 0
        if rows:
            yield batch(paths.slice(start, len(rows)), rows)


def parse(files: DataFrame, most_references: int = MOST_REFERENCES, hashes: bool = True, wanted: Iterable[str] = tuple(FOUND)) -> Parsed:
    """``files(path, content)``, one row a path -> ``Parsed``. A name is qualified by the definitions around it; a call or reference belongs to the
    innermost definition around its line, or else to the file. References are the first ``most_references`` names of a file, each line's once.
    Without ``hashes`` symbols have no ``content_hash``, and their texts are not cut out of the files. Frames that are not ``wanted`` (by name) are left empty.
    What files hold is written to the shared folder, a row for each file with a list for each kind, so whoever reads one kind reads only that."""
    known = F.when(language(F.col("path")).isin(*BRACES, *INDENTED, *WITH_END), language(F.col("path")))
    texts = files.select(F.col("path").cast("binary").alias("path"), known.alias("lang"), F.coalesce("content", F.lit("")).cast("binary").alias("content"))
    only = frozenset(wanted)
    schema = "path binary, " + ", ".join(f"`{what}` array<struct<{fields}>>" for what, fields in FOUND.items())
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    every = stored(texts.mapInArrow(lambda batches: _parsed_batches(batches, most_references, hashes, only, kinds), schema))

    def items(what: str) -> DataFrame:
        return every.where(F.size(what) > 0).select(F.col("path").cast("string").alias("path"), F.explode(what).alias("x")).select("path", "x.*")

    owner = F.coalesce("owner", "path")
    symbols = items("symbols").withColumn("name", F.coalesce("name", "path")).withColumn("qualified", F.coalesce("qualified", "path")).withColumn("symbol_id", F.xxhash64("path", "line", "name"))
    columns = ["symbol_id", "path", "name", "qualified", "kind", "line", "end_line", "signature", *(["content_hash"] if hashes else [])]
    references = items("references").select("path", owner.alias("source"), "target", "line", F.lit("identifier").alias("kind"))
    return Parsed(symbols.select(*columns), items("calls").select("path", owner.alias("caller"), "callee", "line"), references, items("imports"), items("routes"))
