"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import collocations, cws, embeddings, langid, lines, mixing, packing, secrets, simhash, substring, vectorfit, warc, whitening
from provenant.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.deduplicate(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.page_report(records).drop("record_id")


def op2_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.default_tokenizer())


def op4_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edit_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size"))
    sized, _ = stored(docs, "sizes")
    mixed = mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "position", "positions")
    return mixing.schedule(mixed)


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorfit.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vectorfit.default_tokenizer())


def op13_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_rotation_codes": op2_rotation_codes,
    "op3_nnls_packing": op3_nnls_packing,
    "op4_bit_sliced_simhash": op4_bit_sliced_simhash,
    "op5_weighted_sampling": op5_weighted_sampling,
    "op6_curriculum_mix": op6_curriculum_mix,
    "op7_rank_order_language": op7_rank_order_language,
    "op8_suffix_automata": op8_suffix_automata,
    "op9_line_chunks": op9_line_chunks,
    "op10_linked_credentials": op10_linked_credentials,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_vector_best_fit": op12_vector_best_fit,
    "op13_compensated_whitening": op13_compensated_whitening,
}

# The other queries rest on XXH64, gamma variates, a tokenizer, rolling hashes or match positions, which DuckDB lacks; tests hold
# them against brute force.
OP1 = """with p as (select page_id, coalesce(html, '') as t, sha256(coalesce(html, '')) as d from pages), r as (select page_id, strlen(t) as n, d, strlen(t) >= 100 and row_number() over (partition by d order by page_id) > 1 as again, min(page_id) over (partition by d) as first_page from p)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first_page end as refers_to from r"""
OP2 = """with recursive e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), g as (select * from e where label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
l as (select a.vec_id as x, b.vec_id as y from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93),
r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from r join l on l.x = r.y), c as (select x, min(y) as m from r group by 1), n as (select x, count(*) as k from l group by 1)
select vec_id, coalesce(k, 0)::bigint as n_links, m as component_id, vec_id = m as kept from embeddings join c on c.x = vec_id left join n on n.x = vec_id"""
OP8 = r"""with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents), n as (select doc_id, w, len(w) as n from d),
p as (select doc_id, n, unnest(w) as word, generate_subscripts(w, 1) as i, w from n), k as (select doc_id, n, word, i, case when i + 49 <= n then md5(array_to_string(w[i:i + 49], ' ')) end as h from p),
m as (select h, min(doc_id) as low from k where h is not null group by 1), f as (select k.doc_id, word, i, coalesce(m.low < k.doc_id, false) as hit from k left join m on m.h = k.h),
c as (select doc_id, word, i, bool_or(hit) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from f),
o as (select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from c group by 1)
select n.doc_id, n.n::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from n left join o using (doc_id)"""
OP11 = r"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p), m as (select lang, w, count(*) as m from w where len(w) > 0 group by all), n as (select lang, sum(m * len(w)) as n from m group by 1),
g as (select lang, size, m, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase from m, range(1, 6) s(size) where len(w) >= size),
f as (select lang, phrase, size, sum(m) as f from g group by all having sum(m) >= 100), c as (select lang, phrase, f as a, size, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from f where size > 1),
s as (select c.lang, c.phrase, a, x.f as l, y.f as r, n, (1000 * a::hugeint * n::hugeint) // (x.f::hugeint * y.f::hugeint) as score, k from c join n on n.lang = c.lang
 join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, unnest([array_to_string(w[1:size - 1], ' '), array_to_string(w[2:], ' ')]) as inside, a from c where size > 2), h as (select lang, inside, max(a) as longer from o group by all),
k as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank from b left join h on h.lang = b.lang and h.inside = b.phrase where longer is null or longer < a)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from k where rank <= 2000"""

ORACLES: dict[str, str] = {"op1_warc_revisits": OP1, "op2_rotation_codes": OP2, "op8_suffix_automata": OP8, "op11_phrase_collocations": OP11}
