"""Registered queries of the training-data operators, and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from beatwise.llm import (chat_format, conversation_trie, decontamination, html_content, jaccard_join, language_id, line_dedup, near_dedup, packing, quality,
                          topk, url_reputation, whitening)
from beatwise.llm.tables import remainder, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "line_count", "lines_deleted")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = remainder("doc_id", 4)
    model = language_id.train(docs.filter(rest != 2).select("text", "lang"))
    return language_id.predict(docs, model, rest == 2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = remainder("doc_id", 5) != 0
    model = quality.train(docs.filter(learn), table(spark, sf_dir, "labels").filter(learn))
    return quality.score(docs, model, remainder("doc_id", 5) == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat_format.as_transcripts(table(spark, sf_dir, "conversations"))
    return chat_format.canonical_turns(lines, chat_format.train(lines))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return url_reputation.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("key"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract has a long; in ANSI mode a sum that doesn't fit one is an error.
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_top_k, op3_language_id, op4_decontamination, op5_html_extraction, op6_quality, op7_jaccard_join,
                                   op8_chat_formatting, op9_best_fit_packing, op10_url_reputation, op11_conversation_trie, op12_whitening,
                                   op13_near_dedup)} | {"pipeline": corpus_pipeline.run}

UPPER, LOWER = decontamination.UPPER, decontamination.LOWER
_ITEM_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL: dict[str, str] = {
    "op2_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
                   where vec_id is not null and embedding is not null and len(embedding) > 0
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) as bigint) as score
                   from v as q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0),
             r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op4_decontamination": f"""
        with d as (select doc_id, {_ITEM_WORDS} as w from documents),
             i as (select item_id, {_ITEM_WORDS} as w from benchmark),
             win as (select distinct item_id, n, list_slice(w, p, p + n - 1) as g from (
                       select item_id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as p from i where len(w) > 0)),
             sizes as (select distinct n from win),
             dw as (select doc_id, p, n, list_slice(w, p, p + n - 1) as g from (
                       select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
             f as (select doc_id, item_id, p, dw.n as n from dw join win on dw.n = win.n and dw.g = win.g),
             h as (select doc_id, count(distinct t) as n_hit from (select doc_id, unnest(range(p, p + n)) as t from f) group by doc_id),
             k as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from f group by doc_id)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
        from d left join h using (doc_id) left join k using (doc_id)""",
    "op11_conversation_trie": """
        with crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
             own as (select conv_id, chr(1) || md5(coalesce(role, '') || chr(0) || coalesce(text, '')) as turn_key, length(coalesce(text, '')) as chars,
                            row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null),
             l as (select conv_id, list(turn_key order by pos) as turns, list(chars order by pos) as chars from own group by conv_id),
             h as (select l.*, xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
                                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 6 as h from l, crc),
             r as (select a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) as turns,
                          list_concat(coalesce(list_slice(b.chars, 1, a.h), []), list_slice(a.chars, a.h + 1, len(a.chars))) as chars
                   from h as a left join l as b on b.conv_id = a.conv_id - a.conv_id % 100),
             p as (select conv_id, d as depth, array_to_string(list_slice(turns, 1, d), '') as node, array_to_string(list_slice(turns, 1, d - 1), '') as above,
                          case when d > 0 then chars[d] else 0 end as chars, d = len(turns) as ends
                   from (select *, unnest(range(0, len(turns) + 1)) as d from r)),
             n as (select node, depth, min(above) as above, min(conv_id) as conv_id, count(*) as n_convs, min(chars) as chars,
                          sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256 from p group by node, depth),
             k as (select above, depth, count(*) as n_children from n where depth > 0 group by above, depth),
             t as (select n.*, coalesce(n_children, 0) as n_children from n left join k on k.above = n.node and k.depth = n.depth + 1),
             s as (select q.node, q.depth, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * t.chars) as saved_tokens
                   from t join p as q on q.conv_id = t.conv_id and q.depth <= t.depth group by q.node, q.depth)
        select t.conv_id, t.depth, u.conv_id as parent_conv_id, t.n_convs, t.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, t.ends_sha256
        from t join s on s.node = t.node and s.depth = t.depth left join t as u on t.depth > 0 and u.node = t.above and u.depth = t.depth - 1""",
}
