"""Queries over documents and pages: search, samples, pages, text functions, dedupe, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.operators import aggregates as A
from provenant.operators import intervals as I
from provenant.operators import ranking as R
from provenant.operators import resolution as E
from provenant.plans.events_queries import table
from provenant.sources import readers as S


def balanced_sample(spark, d):
    return R.balanced_sample(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 50)


SAMPLE = """with r as (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents), c as (select * from r order by rn, source limit 50), k as (select source, count(*) as n from c group by 1), a as (select source, count(*) as n from documents group by 1)
select c.source, doc_id, a.n > k.n as truncated from c join k using (source) join a using (source)"""


def knowledge_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    terms = R.search_terms("secret token password trash", ["this"])
    return R.ranked_search(docs, terms, ["text", "source"], [F.desc("n_chars"), F.col("doc_id")], 40).select("doc_id", "score", "n_chars")


SEARCH = """with s as (select doc_id, n_chars, (select count(*) from (values ('secret'), ('token'), ('password'), ('trash'), ('secret token password trash')) t(w) where text ilike '%' || w || '%' or source ilike '%' || w || '%') as score from documents)
select doc_id, score, n_chars from s where score > 0 order by score desc, n_chars desc, doc_id limit 40"""


def page(spark, d):
    return R.page(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 20, 20)


PAGE = "select doc_id, source, (select count(*) from documents) as total, greatest(0, least(20, (select count(*) from documents) - 20))::bigint as returned, (select count(*) from documents) > 40 as truncated from documents order by doc_id limit 20 offset 20"


def redact(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted"))


def _sql_redact() -> str:
    out = "text"
    for pattern, to in T.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return f"select doc_id, sha256({out}) as redacted from documents"


TERMS = {"q1": ["password", "token"], "q2": ["All rights reserved"], "q3": ["AKIA"]}


def _lines(spark, d):
    return S.text_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def literal_hits(spark, d):
    queries = spark.createDataFrame([*TERMS.items(), ("bad", ["a\nb"])], "query_id string, terms array<string>")
    return S.search(_lines(spark, d), queries, "doc_id", 500)[0].select("query_id", "doc_id", F.col("line_no").cast("long").alias("line_no"), "truncated")


HITS = """with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents), q(query_id, w) as (values ('q1', 'password'), ('q1', 'token'), ('q2', 'All rights reserved'), ('q3', 'AKIA')),
h as (select distinct query_id, doc_id, line_no from l join q on contains(t, w)), r as (select *, row_number() over (partition by query_id order by doc_id, line_no) as rn, count(*) over (partition by query_id) as n from h)
select query_id, doc_id, line_no::bigint as line_no, n > 500 as truncated from r where rn <= 500"""


def hit_regions(spark, d):
    hits = literal_hits(spark, d).select(F.col("doc_id").alias("path"), F.col("line_no").alias("line"), "query_id")
    return A.tagged_hits(hits).select(F.col("path").alias("doc_id"), "line", F.array_join("query_ids", ",").alias("queries"))


REGIONS = f"select doc_id, line_no as line, string_agg(query_id, ',' order by query_id) as queries from ({HITS}) group by 1, 2"


def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_text(F.col("url")).alias("url"))


URLS = r"""with p as (select page_id, trim(url) as u from pages), x as (select page_id, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(u, '^[A-Za-z]+://([^/:?#]+)', 1)) as h, regexp_extract(u, '^[A-Za-z]+://[^/:?#]+:([0-9]+)', 1) as p, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path from p)
select page_id, case when s in ('http', 'https') and h <> '' then s || '://' || h || case when p = '' or (s = 'http' and p = '80') or (s = 'https' and p = '443') then '' else ':' || p end || case when path = '' then '/' else path end else regexp_replace(u, '/+$', '') end as url from x"""


def tokens_stemmed(spark, d):
    words = T.stemmed_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(words), " ")).alias("h"))


STEMS = f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents), f as (select doc_id, w from w where length(w) >= 3 and w not in ({", ".join(f"'{w}'" for w in T.FAMILY_WORDS)})),
s as (select distinct doc_id, case when w like '%ing' and length(w) >= 6 then w[:-4] when w like '%es' and length(w) >= 5 then w[:-3] when w like '%s' and length(w) >= 4 then w[:-2] when w like '%ed' and length(w) >= 5 then w[:-3] else w end as w from f)
select d.doc_id, count(s.w) as n, md5(coalesce(string_agg(s.w, ' ' order by s.w), '')) as h from documents d left join s using (doc_id) group by 1"""


def exact_dedupe(spark, d):
    docs = table(spark, d, "documents").select(T.plain_text(F.col("text")).alias("_t"), F.col("n_chars").cast("double").alias("confidence"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("evidence"))
    out = E.exact_dedupe(docs.withColumn("fp", E.candidate_fingerprint([F.lit("repo"), F.col("_t")])).drop("_t"), "fp", "confidence", "ord", "evidence")
    return out.select("fp", F.col("ord").alias("doc_id"), "n", F.size("support").cast("long").alias("n_support"))


DEDUPE = r"""with t as (select doc_id, n_chars, lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) as t from documents), f as (select doc_id, n_chars, left(sha256('repo' || chr(31) || regexp_replace(replace(t, chr(92), '/'), '\b[0-9]+\b', '#', 'g')), 24) as fp from t)
select fp, arg_max(doc_id, (n_chars, -doc_id)) as doc_id, count(*) as n, least(20, count(*) - 1)::bigint as n_support from f group by 1"""


def jaccard_pairs(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", words.alias("tokens"))
    return E.similar_pairs(docs, ["source"], "tokens", 0.6).select("a", "b", "shared")


JACCARD = """with t as (select distinct doc_id as id, source, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w from documents), n as (select id, count(*) as n from t group by 1),
p as (select x.id as a, y.id as b, count(*) as shared from t x join t y on x.w = y.w and x.source = y.source and x.id < y.id group by 1, 2) select a, b, shared from p join n u on u.id = a join n v on v.id = b where shared >= (u.n + v.n - shared) * 0.6"""


def greedy_cluster(spark, d):
    words = F.coalesce(T.stemmed_words(F.col("text")), F.array().cast("array<string>"))
    docs = table(spark, d, "documents").select(
        F.coalesce("source", F.lit("")).alias("path"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), (F.pmod("doc_id", F.lit(10)) / 10).alias("confidence"), F.lit("").alias("structural_key"), F.lit("").alias("semantic_key"),
        F.array().cast("array<string>").alias("classes"), words.alias("words"), F.pmod("n_chars", F.lit(400)).alias("start_line"), (F.pmod("n_chars", F.lit(400)) + 9).alias("end_line"))
    return E.cluster_candidates(docs)


def chunk_lines(spark, d):
    spans = table(spark, d, "documents").select("doc_id", F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    return I.chunk_lines(spans, 4).select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


CHUNK = """with n as (select doc_id, len(string_split(text, chr(10))) as n from documents), s as (select doc_id, n, unnest(range(1, n + 1, 4)) as a from n) select doc_id, a as start_line, least(n, a + 3)::bigint as end_line from s"""


def chunk_chars(spark, d):
    return I.chunk_chars(_lines(spark, d), "doc_id", 1600)


CHARS = """with recursive l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, length(unnest(string_split(text, chr(10)))) + 1 as n from documents),
f as (select doc_id, i, i as s, n as c from l where i = 1 union all select l.doc_id, l.i, case when f.c + l.n <= 1600 then f.s else l.i end, case when f.c + l.n <= 1600 then f.c + l.n else l.n end from f join l on l.doc_id = f.doc_id and l.i = f.i + 1)
select doc_id, s::integer as start_line, max(i)::integer as end_line, max(c)::integer as chars from f group by doc_id, s"""


def canonical_queries(spark, d):
    q = table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), F.split("p_type", " ").alias("terms"), F.array(F.lit("**"), F.concat(F.pmod("p_size", F.lit(3)).cast("string"), F.lit("/*"))).alias("globs"), F.array("p_brand").alias("task_ids"))
    return A.canonical_queries(q).select(F.array_join("terms", " ").alias("terms"), F.array_join("globs", " ").alias("globs"), "query_id", "n", F.array_join("task_ids", ",").alias("tasks"))


CANONICAL = """with q as (select p_partkey, list_sort(list_distinct(string_split(lower(p_type), ' '))) as t, list_sort(['**', (p_size % 3) || '/*']) as g, p_brand from part)
select array_to_string(t, ' ') as terms, array_to_string(g, ' ') as globs, 'q' || min(p_partkey) as query_id, count(*) as n, string_agg(distinct p_brand, ',' order by p_brand) as tasks from q group by t, g"""


def change_relevance(spark, d):
    u = F.lower("url")
    tag = lambda when, name: F.when(when, F.lit(name))
    tags = F.array_compact(F.array(tag(u.contains("/en/"), "docs"), tag(u.contains("#"), "test"), tag(u.contains("?"), "config"), tag(u.contains("https"), "source"), tag(u.contains("/de/"), "generated"), tag(u.contains("blog"), "security_path")))
    files = table(spark, d, "pages").select(F.pmod("page_id", F.lit(60)).alias("review"), tags.alias("tags"), (F.pmod("page_id", F.lit(97)) == 0).alias("sensitive"))
    return A.review_depth(files, "review")


RELEVANCE = """with f as (select page_id % 60 as review, contains(lower(url), '/en/') as docs, contains(url, '#') as test, contains(url, '?') as conf, contains(lower(url), 'https') as src, contains(lower(url), '/de/') as gen, contains(lower(url), 'blog') as sec, page_id % 97 = 0 as sens from pages),
g as (select review, bool_and(docs) as docs_only, bool_and(gen) as generated_only, bool_and(test) as test_only, bool_or(conf) as config_changed, false as dependency_changed, bool_or(src and not test) as runtime_changed, bool_or(sec) as security_changed, bool_or(sens) as sensitive_changed from f group by 1)
select *, case when security_changed or sensitive_changed then 'DEEP' when docs_only or generated_only or (test_only and not (config_changed or dependency_changed or runtime_changed)) then 'FAST' when config_changed or dependency_changed or runtime_changed then 'STANDARD' else 'FAST' end as depth from g"""

QUERIES = {
    "balanced_sample": balanced_sample, "knowledge_search": knowledge_search, "page": page, "redact": redact, "literal_hits": literal_hits, "hit_regions": hit_regions, "url_normalise": url_normalise,
    "tokens_stemmed": tokens_stemmed, "exact_dedupe": exact_dedupe, "jaccard_pairs": jaccard_pairs, "greedy_cluster": greedy_cluster, "chunk_lines": chunk_lines, "chunk_chars": chunk_chars,
    "canonical_queries": canonical_queries, "change_relevance": change_relevance,
}
ORACLES = {
    "balanced_sample": SAMPLE, "knowledge_search": SEARCH, "page": PAGE, "redact": _sql_redact(), "literal_hits": HITS, "hit_regions": REGIONS, "url_normalise": URLS, "tokens_stemmed": STEMS, "exact_dedupe": DEDUPE,
    "jaccard_pairs": JACCARD, "chunk_lines": CHUNK, "chunk_chars": CHARS, "canonical_queries": CANONICAL, "change_relevance": RELEVANCE,
}
