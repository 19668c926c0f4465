"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.tables import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as two batches of about the same size; the first is the snapshot of the second."""
    from tidemark.llm.exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return exact_dedup(docs.where(~first | F.col("doc_id").isNull()), docs.where(first))


OP1_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size,
       first_value(doc_id) over w = doc_id as kept, h as text_sha256
from t window w as (partition by h order by n_cp desc, doc_id)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that ``labels`` calls good and not toxic."""
    from tidemark.llm.quality_rules import judge

    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return judge(table(spark, sf_dir, "documents"), good)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


#: (host, path, verdict) of the registered url query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP5_SQL = r"""
with u as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages
), r as (
  select page_id, host, path, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from u
)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from r
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import decoded, digests, encoded

    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(decoded(encoded(table(spark, sf_dir, "documents"), vocabulary, pattern), vocabulary, pattern))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a passage: doc_id's words start to end are in the earlier source_doc_id too."""
    from tidemark.llm.substring_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    words = F.col("end") - F.col("start")
    likeness = F.col("matches") / F.greatest(words, F.col("source_end") - F.col("source_start"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("source").alias("source_doc_id"),
        F.col("source_start").alias("source_start_word"), F.col("source_end").alias("source_end_word"), words.alias("n_words"), "matches", likeness.alias("similarity"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import held_out, identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    prototypes = learn(docs.where("not held_out and doc_id is not null"))
    return identify(docs, prototypes, ["doc_id", "held_out"])


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts consist of control strings."""
    from tidemark.llm.chat_template import formatted, read_back

    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(formatted(turns.unionByName(extra)))


OP10_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text,
    '</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/?TURN\]|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>')) as guarded from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(guarded + case role when 'user' then 13 when 'assistant' then 4 when 'system' then 15 else 26 + length(role) end))::bigint as formatted_chars
from e group by conv_id
"""


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    from tidemark.llm.top_k import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP11_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 5
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt so that families share their first turns."""
    from tidemark.llm.prefix_trie import forked, prefix_trie, turn_keys

    return prefix_trie(forked(turn_keys(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role_, sha256(length(role_)::varchar || ':' || role_ || text_)) as pos
  from (select *, coalesce(role, '') as role_, coalesce(text, '') as text_ from conversations where conv_id is not null)
), c as (
  select conv_id, conv_id - conv_id % 20 as base, (4294967295 - list_reduce([ascii(ch)::bigint for ch in string_split(conv_id::varchar, '')],
      lambda s, b: list_reduce(range(8)::bigint[], lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(s, b)), 4294967295::bigint)) % 4 as h
  from (select distinct conv_id from t)
), r as (
  select c.conv_id, 0 as kind, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.h
  union all select c.conv_id, 1, t.pos, t.role, t.text from c join t using (conv_id) where t.pos > c.h
), p as (
  select c.conv_id, coalesce(list(struct_pack(role := r.role, text := r.text) order by kind, pos) filter (pos is not null), []) as path from c left join r using (conv_id) group by c.conv_id
), g as (
  select path[1:depth] as k, depth, min(conv_id) as conv_id, count(*) as n, string_agg(conv_id::varchar, ',' order by conv_id) filter (len(path) = depth) as ends
  from p, unnest(range(0, len(path) + 1)) as d(depth) group by all
), x as (
  select g.*, u.conv_id as parent_conv_id, (n - 1) * case depth when 0 then 0 else len(regexp_extract_all(k[depth].text, '[^\x20\x09-\x0D]+')) end as saved,
    (select count(*) from g as b where b.depth = g.depth + 1 and b.k[1:g.depth] = g.k) as n_children
  from g left join (select k as k_, conv_id from g) as u on g.depth > 0 and u.k_ = g.k[1:g.depth - 1]
), s as (
  select k[1:up] as k, sum(saved)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from x, unnest(range(0, depth + 1)) as a(up) group by all
)
select conv_id, depth, parent_conv_id, n as n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) as ends_sha256 from x join s using (k)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over whole documents, by language."""
    from tidemark.llm.filter_audit import audit, failures

    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, min(doc_id) over (partition by coalesce(text, '')) as least from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d
), m as (
  select part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
      100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails,
    doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) as good, doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) as toxic
  from w
), k as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, fails
), o as (
  select '' as filter_order
  union all select filter_order || l from o, unnest(['A', 'B', 'C', 'D', 'E']) as t(l) where not contains(filter_order, l)
), s as (
  select filter_order, step::int as step, [instr('ABCDE', substr(filter_order, i, 1))::int for i in range(1, step + 1)] as letters from o, range(1, 6) as r(step) where length(filter_order) = 5
), x as (
  select part, filter_order, step, fails[letters[step]] as here, len([i for i in letters[1:step - 1] if fails[i]]) > 0 as earlier, len([f for f in fails if f]) as failed, n, good, toxic, letters[step] as filter from k, s
), g as (
  select part, filter_order, step, filter, coalesce(sum(n) filter (not here and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (here and not earlier), 0)::bigint as removed,
    coalesce(sum(n) filter (here and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (here and failed = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (here and not earlier), 0)::bigint as good_lost, coalesce(sum(toxic) filter (here and not earlier), 0)::bigint as toxic_lost
  from x group by part, filter_order, step, filter
)
select * exclude (filter), (sum(removed) over (partition by part, filter))::bigint as shapley from g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_exact_dedup, op2_packing, op3_quality_rules, op4_near_dedup, op5_url_filter, op6_bpe, op7_substring_dedup, op8_language_id, op9_html_extract, op10_chat_format, op11_top_k, op12_prefix_trie, op13_filter_audit]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_url_filter": OP5_SQL, "op10_chat_format": OP10_SQL, "op11_top_k": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
