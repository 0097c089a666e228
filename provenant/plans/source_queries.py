"""Queries that parse source text: a file for each order, a class for the order and a method for each of its lines, in three languages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from provenant.functions import redaction as D
from provenant.functions import text as T
from provenant.operators import graphs as G
from provenant.operators import intervals as I
from provenant.operators import joins as J
from provenant.operators import ledger as N
from provenant.operators import policy as Q
from provenant.plans.events_queries import table
from provenant.sources import parsing as P
from provenant.sources import readers as Z

#: A line of an order as a method of four lines; the strings and comments hold brackets and calls that are none.
JS_METHOD = "  async {own}(x) {{ // }}\n    const s = \"}}{{ g(\" + '}}';  /* {{ h( */\n    p.{other}(x, \"k(\");\n  }}"
PY_METHOD = "    def {own}(self):\n        \"\"\" note: g(\n    def h( \"\"\"\n        self.{other}(1)  # k("


def _filled(pattern: str, **columns):
    import re

    parts = re.split(r"\{(\w+)\}", pattern.replace("{{", "\x01").replace("}}", "\x02"))
    return F.concat(*[columns[x] if i % 2 else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for i, x in enumerate(parts)])


def files(spark, d):
    """``path, content``; an order's lines are few, so one row holds its text."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("f"), "l_partkey", F.lit("_"), "l_suppkey").alias("own"))
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "own")
    called = li.withColumn("other", F.coalesce(F.lead("own").over(along), F.col("own")))
    k = F.col("l_orderkey")
    lang = F.element_at(F.array(F.lit("js"), F.lit("py"), F.lit("sql")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    method = F.when(lang == "js", _filled(JS_METHOD, own=F.col("own"), other=F.col("other"))).otherwise(_filled(PY_METHOD, own=F.col("own"), other=F.col("other")))
    bodies = called.select("l_orderkey", "l_linenumber", method.alias("m")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "m"))), lambda x: x["m"]), "\n").alias("body"))
    head = F.when(lang == "js", _filled('import {{ p }} from "lib/{k}";\nexport class O{k} extends Base {{  // {{\n', k=k)).when(lang == "py", _filled("from lib import p{k}\nclass O{k}(Base):\n", k=k)).otherwise("select 1;\n")
    return bodies.select(F.concat(F.lit("src/o"), k, F.lit("."), lang).alias("path"), F.concat(head, F.when(lang == "sql", "select 2;\n").otherwise(F.col("body")), F.when(lang == "js", "\n}\n").when(lang == "py", "\n").otherwise("")).alias("content"))


ITEMS = """with i as (select l_orderkey as o, 'f' || l_partkey || '_' || l_suppkey as own, row_number() over w as j, lead('f' || l_partkey || '_' || l_suppkey) over w as nxt from lineitem window w as (partition by l_orderkey order by l_linenumber, 'f' || l_partkey || '_' || l_suppkey)),
m as (select o, own, coalesce(nxt, own) as other, 3 + 4 * (j - 1) as line, o % 3 = 0 as js, 'src/o' || o || case when o % 3 = 0 then '.js' else '.py' end as path from i where o % 3 < 2)"""


def parsed_symbols(spark, d):
    found = P.parse(files(spark, d), hashes=False, wanted=["symbols"]).symbols
    return found.select("path", "name", "qualified", "kind", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "signature")


SYMBOLS = ITEMS + """ select path, own as name, 'O' || o || '.' || own as qualified, case when js then 'method' else 'function' end as kind, line, line + 3 as end_line, case when js then 'async ' || own || '(x)' else 'def ' || own || '(self)' end as signature from m
union all select path, 'O' || o, 'O' || o, 'class', 2, max(line) + case when js then 4 else 3 end, case when js then 'export class O' || o || ' extends Base' else 'class O' || o || '(Base)' end from m group by path, o, js
union all select 'src/o' || o || '.sql', 'src/o' || o || '.sql', 'src/o' || o || '.sql', 'file', 1, 2, '' from (select distinct o from i where o % 3 = 2)"""


def parsed_calls(spark, d):
    p = P.parse(files(spark, d), hashes=False, wanted=["calls", "imports"])
    calls = p.calls.select("path", F.lit("call").alias("what"), F.col("caller").alias("source"), F.col("callee").alias("target"), F.col("line").cast("long").alias("line"))
    imports = p.imports.select("path", F.lit("import").alias("what"), F.col("path").alias("source"), F.col("text").alias("target"), F.col("line").cast("long").alias("line"))
    return calls.unionByName(imports)


CALLS = ITEMS + """ select path, 'call' as what, 'O' || o || '.' || own as source, case when js then 'p.' else 'self.' end || other as target, line + case when js then 2 else 3 end as line from m
union all select distinct path, 'import', path, case when js then 'import { p } from "lib/' || o || '";' else 'from lib import p' || o end, 1 from m"""


def parsed_references(spark, d):
    refs = P.parse(files(spark, d), hashes=False, wanted=["references"]).references
    return refs.groupBy("path", "source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first"), F.max(F.col("line").cast("long")).alias("last_line"))


REFERENCES = ITEMS + """, r as (select path, 'O' || o || '.' || own as source, unnest(case when js then ['x', 's', 'p', other, 'x'] else [other] end) as target, unnest(case when js then [line, line + 1, line + 2, line + 2, line + 2] else [line + 3] end) as line from m
 union all select distinct path, 'O' || o, 'Base', 2 from m union all select distinct path, path, unnest(case when js then ['p'] else ['lib', 'p' || o] end), 1 from m)
select path, source, count(*) as n, min(target) as first, max(line) as last_line from (select distinct * from r) group by 1, 2"""


def parsed_edges(spark, d):
    """From files to the graph: calls are resolved to the symbols of their names."""
    p = P.parse(files(spark, d), hashes=False, wanted=["symbols", "calls"])
    edges = J.resolve_edges(p.calls, p.symbols.select("symbol_id", "path", F.col("qualified").alias("name")))
    return edges.join(p.symbols.select("symbol_id", "path"), F.col("source_id") == F.col("symbol_id")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


EDGES = ITEMS + """, s as (select m.*, row_number() over () as id from m), c as (select distinct path, own, other from m)
select s.path, count(distinct (s.id, t.id)) as n from c join s on s.path = c.path and s.own = c.own join s t on t.own = c.other and t.id <> s.id group by 1"""


def many_terms(spark, d):
    """Every longer word that occurs once in the documents as a term, looked for in every line."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"[^\w]+")).alias("term")).where("length(term) between 9 and 40").groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    words = G.stored(words.select("term"))
    hits = Z.terms_in(Z.text_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), words, "text")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("n_terms"), F.max("line_no").cast("long").alias("last_line"))


def _trace_steps(spark, d):
    """An order's lines as the steps of a trace: a line gives its part's brand and takes that of the one three parts on, or its supplier."""
    li = table(spark, d, "lineitem")
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    role = F.element_at(F.array(*[F.lit(r) for r in ("ROOT", "TRUST", "ORIGIN", "EFFECT")]), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))
    word = lambda prefix, column, by, n: F.concat(F.lit(prefix), F.pmod(F.col(column) + n, F.lit(by)))
    return li.select(F.col("l_orderkey").alias("trace"), F.row_number().over(along).cast("long").alias("pos"), role.alias("role"), F.array(word("p", "l_partkey", 3, 0), word("s", "l_suppkey", 2, 0)).alias("gives"),
                     F.array(word("p", "l_partkey", 3, 1), word("s", "l_suppkey", 2, 0)).alias("takes"))


STEPS = """with recursive t as (select l_orderkey as trace, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as pos,
 ['ROOT', 'TRUST', 'ORIGIN', 'EFFECT'][l_partkey % 4 + 1] as role, ['p' || l_partkey % 3, 's' || l_suppkey % 2] as gives, ['p' || (l_partkey + 1) % 3, 's' || l_suppkey % 2] as takes from lineitem),
c as (select b.trace, b.pos, a.pos as source, list_min(list_intersect(a.gives, b.takes)) as via from t b join t a on a.trace = b.trace and a.pos < b.pos and len(list_intersect(a.gives, b.takes)) > 0),
n as (select trace, pos, max(source) as source, arg_max(via, source) as via from c group by 1, 2)"""


def class_support(spark, d):
    steps = _trace_steps(spark, d)
    return J.nearest_by_class(steps, "trace")


SUPPORT = STEPS + " select t.trace, t.pos, source as support, via from t left join n on n.trace = t.trace and n.pos = t.pos"


def assembled_traces(spark, d):
    steps = _trace_steps(spark, d)
    gaps = table(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(5)) == 0).select(F.col("o_orderkey").alias("trace"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, " ").otherwise("no route").alias("gap"))
    return G.assembled_traces(steps, J.nearest_by_class(steps, "trace"), gaps, "ROOT", ["TRUST", "EFFECT"])


TRACES = STEPS + """, w(trace, pos, up, far) as (select t.trace, t.pos, coalesce(n.source, t.pos), case when n.source is null then 0 else 1 end from t left join n on n.trace = t.trace and n.pos = t.pos
 union all select w.trace, w.pos, n.source, w.far + 1 from w join n on n.trace = w.trace and n.pos = w.up and w.far > 0),
b as (select trace, pos, min(up) as branch, max(far) as depth from w group by 1, 2), g as (select o_orderkey as trace from orders where o_orderkey % 5 = 0 and o_orderkey % 2 <> 0),
h as (select t.trace, count(*) filter (n.source is null) - 1 + count(distinct g.trace) as n_gaps, bool_or(role = 'ROOT') and bool_or(role in ('TRUST', 'EFFECT')) as roles from t left join n on n.trace = t.trace and n.pos = t.pos left join g on g.trace = t.trace group by 1)
select t.trace, t.pos, role, n.source, via, branch, depth, n.source is null as is_entry, not exists (select 1 from n m where m.trace = t.trace and m.source = t.pos) as is_terminal, n_gaps = 0 and roles as complete, n_gaps
from t left join n on n.trace = t.trace and n.pos = t.pos join b on b.trace = t.trace and b.pos = t.pos join h on h.trace = t.trace"""


def request_flows(spark, d):
    """For every customer the links of the part tree around one part, three steps far, each with the way to it."""
    tree = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("edge_id"), F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).alias("target"), (-F.col("p_partkey")).alias("ord"))
    asks = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.pmod(F.col("c_custkey") * 7, F.lit(150)).alias("node"))
    found = G.flows(asks, tree, 3, 12)
    return found.select("id", "edge_id", F.col("depth").cast("long").alias("depth"), F.col("rank").cast("long").alias("rank"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


FLOWS = """with recursive e as (select p_partkey as edge, p_partkey as a, p_partkey // 2 as b from part where p_partkey > 0), x as (select edge, a as f, b as t from e union all select edge, b, a from e),
r(id, node, depth, way) as (select c_custkey, c_custkey * 7 % 150, 0::bigint, []::bigint[] from customer union all select r.id, x.t, r.depth + 1, list_append(r.way, x.edge) from r join x on x.f = r.node and not list_contains(r.way, x.edge) where r.depth < 3),
k as (select id, way[-1] as edge_id, depth, way, row_number() over (partition by id order by depth, -way[-1]) as rank from r where depth > 0)
select id, edge_id, depth, rank, array_to_string(way, '>') as path from k where rank <= 12"""


def context_requests(spark, d):
    """Over parsed files: what stands around the methods of every part and supplier, in the kinds flow, callers, definition and siblings."""
    p = P.parse(files(spark, d), hashes=False, wanted=["symbols", "calls", "imports"])
    names = table(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_partkey", F.lit("_"), "l_suppkey").alias("target"), F.col("l_partkey").alias("k"), F.concat(F.lit("src/o"), "l_orderkey", F.lit(".js")).alias("changed_path"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("flow", "callers", "definition", "sibling_handlers")]), (F.pmod("k", F.lit(4)) + 1).cast("int"))
    asks = names.groupBy("target", "k").agg(F.min("changed_path").alias("changed_path")).select(F.col("target").alias("id"), kind.alias("kind"), "target", "changed_path")
    found = Q.expand_requests(asks, p.symbols.withColumnRenamed("line", "start_line"), p.calls, p.imports.select("path", F.col("text").alias("module")), 4)
    return found.select("id", "kind", F.col("rank").cast("long").alias("rank"), "fact", "truncated")


CONTEXTS = ITEMS + """, c as (select own, other, path, 'O' || o || '.' || own as caller, case when js then 'p.' else 'self.' end || other as callee, line, js, o from m),
a as (select 'f' || l_partkey || '_' || l_suppkey as id, l_partkey % 4 as k, min('src/o' || l_orderkey || '.js') as path from lineitem group by 1, 2),
f as (select distinct id, 'flow' as kind, caller || ' -> ' || callee as fact from a join c on id in (own, other) where k = 0 union select distinct id, 'callers', caller from a join c on id = other where k = 1
 union select distinct id, 'definition', c.path || ':' || line from a join c on id = own where k = 2
 union select distinct id, 'sibling_handlers', x.fact from a join (select path, own || ':' || line as fact from m where js union all select distinct path, 'O' || o || ':2' from m where js) x on x.path = a.path where k = 3),
r as (select *, row_number() over (partition by id, kind order by fact) as rank, count(*) over (partition by id, kind) > 4 as truncated from f) select id, kind, rank, fact, truncated from r where rank <= 4"""


def source_windows(spark, d):
    """Documents as files: some are unknown to the snapshot, some have changed since, some requests lie behind the end."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    k = F.col("doc_id")
    known = F.when(F.pmod(k, F.lit(7)) == 0, None).when(F.pmod(k, F.lit(5)) == 0, F.sha2(F.lit("before"), 256)).otherwise(F.sha2("content", 256))
    asks = docs.select(k.alias("id"), "path", F.pmod(k, F.lit(9)).alias("line"), known.alias("hash"))
    found = I.source_windows(asks, docs.select("path", "content"), 2, 1, 2000)
    return found.select("id", "state", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("content", 256).alias("content"))


def _redacted_sql(column: str) -> str:
    out = column
    for pattern, to in T.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return out


WINDOWS = f"""with f as (select doc_id, doc_id % 9 as line, text, string_split(text, chr(10)) as l from documents), n as (select *, greatest(1, len(l) - case when text like '%' || chr(10) then 1 else 0 end) as n from f),
w as (select *, greatest(1, line - 2) as a, least(n, line + 1) as b from n), t as (select *, array_to_string(l[a:b], chr(10)) || case when b < len(l) then chr(10) else '' end as t from w), r as (select *, {_redacted_sql('t')} as x from t),
s as (select *, case when doc_id % 7 = 0 then 'unknown_path' when text is null then 'unreadable' when doc_id % 5 = 0 then 'stale_source' when line < 1 or b < a then 'invalid_range' when length(x) > 2000 then 'over_budget' else 'ok' end as state from r)
select doc_id as id, state, case when state = 'ok' then a end::bigint as start_line, case when state = 'ok' then b end::bigint as end_line, case when state = 'ok' then sha256(x) end as content from s"""


def uncovered_registrations(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    start = F.pmod("o_orderkey", F.lit(500))
    registrations = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + F.pmod("o_orderkey", F.lit(40))).alias("end"))
    at = F.pmod("l_partkey", F.lit(500))
    regions = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("path"), at.alias("start"), (at + F.col("l_linenumber") * 3).alias("end"), F.when(F.col("l_linenumber") == 1, "route").otherwise("symbol").alias("anchor_type"))
    return I.add_uncovered(registrations, regions)


UNCOVERED = """with g as (select o_custkey as path, o_orderkey as id, o_orderkey % 500 as a, o_orderkey % 500 + o_orderkey % 40 as b from orders), c as (select distinct o_custkey as path, l_partkey % 500 as s, l_partkey % 500 + l_linenumber * 3 as e from lineitem join orders on l_orderkey = o_orderkey where l_linenumber <> 1),
p as (select path, id, unnest(range(a, b + 1)) as n from g), u as (select path, id, n, n - row_number() over (partition by path, id order by n) as i from p where not exists (select 1 from c where c.path = p.path and p.n between c.s and c.e))
select path, id, min(n) as start, max(n) as "end" from u group by path, id, i"""


def structured_answers(spark, d):
    """Each part as an answer in one of six forms, good and bad."""
    k = F.col("p_partkey")
    good = F.concat(F.lit('{"name": "'), "p_brand", F.lit('", "size": '), "p_size", F.lit(', "tags": ["a", "b"]}'))
    forms = F.array(
        good, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```")), F.concat(F.lit('{"name": "'), "p_brand", F.lit('", "size": "large"}')), F.lit('{"size": 3, "tags": 5}'), F.lit("no answer"),
        F.concat(F.lit('{"name": "'), "p_brand", F.lit('", "size": null}')))
    said = table(spark, d, "part").select("p_partkey", F.element_at(forms, (F.pmod(k, F.lit(6)) + 1).cast("int")).alias("text"))
    found = D.structured(said, "text", StructType.fromDDL("name string, size int, tags array<string>"), ["name", "size"])
    return found.select("p_partkey", "value.name", F.col("value.size").cast("long").alias("size"), F.size("value.tags").cast("long").alias("n_tags"), F.array_join("reasons", ",").alias("reasons"))


STRUCTURED = """select p_partkey, case when p_partkey % 6 < 2 then p_brand end as name, case when p_partkey % 6 < 2 then p_size end::bigint as size, case when p_partkey % 6 < 2 then 2 end::bigint as n_tags,
['', '', 'type:size', 'missing:name,type:tags', 'no_json', 'missing:size'][p_partkey % 6 + 1] as reasons from part"""


def edge_factors(spark, d):
    """The edges between the callers of common names and all symbols that have them, in factors: every line's call, to names that a fifth of all symbols share."""
    word = F.concat(F.lit("f"), F.pmod("p_size", F.lit(5)))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.concat_ws(".", F.replace("p_type", F.lit(" "), F.lit("_")), word).alias("name"))
    calls = table(spark, d, "lineitem").join(s.select(F.col("symbol_id").alias("l_partkey"), "path", "name"), "l_partkey").select("path", F.col("name").alias("caller"), F.concat(F.lit("m.f"), F.pmod("l_suppkey", F.lit(7))).alias("callee"))
    sources, targets = J.resolved_names(calls, s)
    return sources.select(F.lit("source").alias("side"), F.col("source_id").alias("symbol_id"), "name").unionByName(targets.select(F.lit("target").alias("side"), F.col("target_id").alias("symbol_id"), "name"))


FACTORS = """with s as (select p_partkey as id, p_brand as path, replace(p_type, ' ', '_') || '.f' || (p_size % 5) as name, 'f' || (p_size % 5) as last from part),
c as (select distinct path, name as caller, 'f' || (l_suppkey % 7) as callee from lineitem join s on id = l_partkey), x as (select distinct a.id, c.callee from c join s a on a.path = c.path and a.name = c.caller where c.callee in (select last from s))
select 'source' as side, id as symbol_id, callee as name from x union all select 'target', id, last from s where last in (select callee from x)"""


def components_by_edge(spark, d):
    """Customers share a node by threes; nodes are joined to the next where a customer is of one nation."""
    c = table(spark, d, "customer")
    node = F.floor(F.col("c_custkey") / 3)
    return G.target_groups(c.select(F.col("c_custkey").alias("target"), node.alias("node")), c.where("c_nationkey = 3").select(node.alias("source"), (node + 1).alias("target")))


BY_EDGE = """with recursive n as (select distinct c_custkey // 3 as n from customer), e as (select distinct c_custkey // 3 as a, c_custkey // 3 + 1 as b from customer where c_nationkey = 3 and c_custkey // 3 + 1 in (select n from n)),
r(x, y) as (select n, n from n union select r.x, e.a from r join e on e.b = r.y), g as (select x, min(y) as low from r group by 1), h as (select c_custkey // 3 as n, min(c_custkey) as first from customer group by 1)
select c_custkey as target, first as component from customer join g on x = c_custkey // 3 join h on h.n = low"""


def path_kinds(spark, d):
    """Every part's name as a path of one of eight shapes: which are sensitive, which generated."""
    shapes = F.array(*[F.lit(x) for x in ("src/#.py", ".env.#", "keys/#.PEM", "dist/#.js", "a/#.min.css", "b/#_pb2.py", "id_rsa", "deep/build/#.go")])
    k = F.col("p_partkey")
    paths = table(spark, d, "part").select("p_partkey", F.replace(F.element_at(shapes, (F.pmod(k, F.lit(8)) + 1).cast("int")), F.lit("#"), F.concat(F.lit("n"), k)).alias("path"))
    return paths.select("p_partkey", Z.is_sensitive(F.col("path")).alias("sensitive"), Z.is_generated(F.col("path")).alias("generated"))


KINDS = "select p_partkey, p_partkey % 8 in (1, 2, 6) as sensitive, p_partkey % 8 in (3, 4, 5, 7) as generated from part"


def first_paths(spark, d):
    """The first hundred paths of a listing."""
    return Z.listing(table(spark, d, "orders").select(F.concat(F.lit("src/o"), "o_orderkey", F.lit(".py")).alias("path")), 100)


LISTING = "select 'src/o' || o_orderkey || '.py' as path from orders order by 1 limit 100"


def cache_lookups(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(3)).cast("int").alias("version"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("payload"))
    return N.cached(o, 2).select("o_orderkey", "payload")


CACHED = "select o_orderkey, o_orderstatus as payload from orders where o_custkey % 3 = 2 and o_orderstatus <> 'P'"


def surface_obligations(spark, d):
    return N.surface_obligations(table(spark, d, "lineitem").select(F.concat(F.lit("w"), F.col("l_partkey")).alias("workset_id")))


OBLIGATIONS = "select distinct 'w' || l_partkey as workset_id, sha256('surface' || chr(29) || 'w' || l_partkey) as canonical_id, 'REQUIRED' as importance from lineitem"


QUERIES = {
    "parsed_symbols": parsed_symbols, "parsed_calls": parsed_calls, "parsed_references": parsed_references, "parsed_edges": parsed_edges, "many_terms": many_terms, "class_support": class_support,
    "assembled_traces": assembled_traces, "request_flows": request_flows, "context_requests": context_requests,
    "source_windows": source_windows, "uncovered_registrations": uncovered_registrations, "structured_answers": structured_answers, "edge_factors": edge_factors, "components_by_edge": components_by_edge,
    "path_kinds": path_kinds, "first_paths": first_paths, "cache_lookups": cache_lookups, "surface_obligations": surface_obligations,
}
#: Thousands of terms in every line are beyond SQL; a test holds ``many_terms`` to a brute force.
ORACLES = {"parsed_symbols": SYMBOLS, "parsed_calls": CALLS, "parsed_references": REFERENCES, "parsed_edges": EDGES, "class_support": SUPPORT, "assembled_traces": TRACES, "request_flows": FLOWS, "context_requests": CONTEXTS, "source_windows": WINDOWS,
    "uncovered_registrations": UNCOVERED, "structured_answers": STRUCTURED, "edge_factors": FACTORS, "components_by_edge": BY_EDGE,
    "path_kinds": KINDS, "first_paths": LISTING, "cache_lookups": CACHED, "surface_obligations": OBLIGATIONS,
}
