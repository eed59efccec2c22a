"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import bpe, cotrain, decontam, langid, lines, loglik, mixing, passages, search, simhash, tools, toxicity, trie
from skirmish.llm.base import in_fold, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# Every window of twelve tokens in line, by brute force: equal tokens of all pairs of places, summed along diagonals.  Items are taken as unique.
OP1_SQL = r"""
with d as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) - 1 as p, len(w) as n
           from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents)),
b as (select item_id, unnest(w) as t, generate_subscripts(w, 1) - 1 as q, len(w) as m
      from (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark)),
same as (select distinct doc_id, item_id, p, q, n, m, p - q as diagonal from d join b using (t)),
runs as (select *, count(*) over (partition by doc_id, item_id, diagonal order by p range between current row and 11 following) as ahead from same),
-- A window may start at a token that differs, up to two places before an equal one.
starts as (select doc_id, item_id, diagonal, n, m, p - unnest(range(0, 3)) as start from same),
kept as (select distinct * from starts where start >= 0 and start - diagonal >= 0 and start + 12 <= n and start - diagonal + 12 <= m),
counted as (select k.doc_id, k.item_id, k.start, count(*) as same
            from kept k join same s on s.doc_id = k.doc_id and s.item_id = k.item_id and s.diagonal = k.diagonal and s.p between k.start and k.start + 11
            group by k.doc_id, k.item_id, k.diagonal, k.start having count(*) >= 10),
-- Items under twelve tokens, of twelve letters and digits or more, count where they stand whole.
short_items as (select doc_id, item_id, diagonal as start, m from same where m < 12 and item_id in
            (select item_id from benchmark group by item_id having max(length(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ''))) >= 12)
          group by all having count(*) = m),
found as (select doc_id, item_id, start, start + 11 as final, same from counted union all select doc_id, item_id, start, start + m - 1, m from short_items)
select doc_id, item_id, cast(min(start) as integer) as first_word, cast(max(final) as integer) as last_word, cast(max(same) as integer) as best
from found group by doc_id, item_id
"""


@query(OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read(spark, sf_dir, "documents")).taken().select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
with split as (select doc_id, rowid_ as r, unnest(l) as line, generate_subscripts(l, 1) as n
               from (select doc_id, row_number() over () as rowid_, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split),
repeated as (select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select a.*, b.k is not null and a.doc_id is distinct from b.keeper as gone from keyed a left join repeated b using (k))
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from marked group by doc_id, r
"""


@query(OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", in_fold(F.col("doc_id"), 5, 0))
    return langid.label_languages(docs, docs.filter("not held_out")).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = cotrain.score_quality(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "page_score", "score", "kept")


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = loglik.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return judged.select("doc_id", *loglik.COUNTS, "base_failed", "kept", "score")


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", in_fold(F.col("doc_id"), 4, 2))
    labels = read(spark, sf_dir, "labels").filter(~in_fold(F.col("doc_id"), 4, 2))
    return toxicity.score_toxicity(docs, docs.filter("not held_out"), labels).select("doc_id", "held_out", "score", "predicted")


OP7_SQL = r"""
with u as (select conv_id, turn, text, len(string_split(coalesce(text, ''), ' ')) as n from conversations where role = 'user'),
w as (select *, n % 5 = 0 as waits, 'call_' || turn as call_id from u),
linked as (select a.*, b.turn is not null as has_next from w a left join w b on b.conv_id = a.conv_id and b.turn = a.turn + 2),
ends as (select a.conv_id, a.turn, min(s.turn) as last
         from linked a join linked s on s.conv_id = a.conv_id and s.turn >= a.turn and (s.turn - a.turn) % 2 = 0 and not (s.waits and s.has_next) group by all),
r as (select conv_id, turn - 1 as turn, min(text) as result, count(*) as n_results from conversations where role = 'assistant' group by all)
select l.conv_id as conv, l.turn, l.call_id, e.last as rank_turn, cast((e.last - l.turn) / 2 as integer) as rank_hops,
       array_to_string(list_sort(list_filter([case when coalesce(r.n_results, 0) = 0 then 'result: missing' when r.n_results > 1 then 'result: repeated' end,
                                   case when l.waits and not l.has_next then 'uses call_' || (l.turn + 2) || ': missing' end], lambda x: x is not null)), '; ') as problems,
       coalesce(r.n_results, 0) = 1 and not (l.waits and not l.has_next) as valid,
       '{"arguments":{"query":' || to_json(l.text)::varchar || ',"words":' || l.n || '},"call_id":"' || l.call_id || '","result":' || coalesce(to_json(r.result)::varchar, 'null')
         || ',"tool":"' || case when l.n > 30 then 'summarise' else 'lookup' end || '"}' as json
from linked l join ends e using (conv_id, turn) left join r using (conv_id, turn)
"""


@query(OP7_SQL)
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = tools.format_calls(*tools.calls_of(read(spark, sf_dir, "conversations")), tools.SCHEMAS)
    return calls.withColumn("problems", F.array_join("problems", "; "))


@query()
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.whole_passages(read(spark, sf_dir, "documents")).drop("removed")


# Prefixes as lists of turns, sums over a subtree by way of every node's ancestors; crc32 bit by bit.
OP11_SQL = r"""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, turn from conversations where conv_id is not null),
lists as (select c, list({'r': r, 'x': x} order by turn nulls first, r, x) as turns from t group by c),
heads as (select c, turns, c - c % 5 as base,
                 xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda ch: ascii(ch)::bigint)),
                   lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y // 2, (y % 2) * 3988292384)))) % 9 as h from lists),
built as (select a.c, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] as turns from heads a left join lists b on b.c = a.base),
prefix as (select c, len(turns) as n, turns, unnest(range(0, len(turns) + 1)) as d from built),
node as (select turns[1:d] as k, d, min(c) as conv_id, count(*) as n_convs,
                sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where n = d), '')) as ends_sha256,
                coalesce(strlen(any_value(turns[d].x)), 0) as bytes from prefix group by turns[1:d], d),
kids as (select k[1:d - 1] as k, count(*) as n from node where d > 0 group by 1),
full_node as (select a.*, coalesce(b.n, 0) as n_children from node a left join kids b using (k)),
up as (select n_children, (n_convs - 1) * bytes as saved, k, unnest(range(0, d + 1)) as e from full_node),
sums as (select k[1:e] as k, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved_tokens from up group by 1)
select a.conv_id, a.d as depth, p.conv_id as parent_conv_id, a.n_convs, a.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, a.ends_sha256
from full_node a join sums s using (k) left join node p on a.d > 0 and p.k = a.k[1:a.d - 1]
"""


@query(OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.regraft(trie.turn_lists(read(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
b as (select row_number() over () as item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
q as (select item, item_id, t, count(*) as times from b group by all),
s as (select count(*) as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
tf as (select row, doc_id, n, t, count(*) as tf from (select row, doc_id, len(w)::bigint as n, unnest(w) as t from d) group by all),
w as (select t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, s group by t),
scored as (select q.item, q.item_id, tf.row, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * s.n_docs) // s.n_terms))))::bigint as score
           from q join tf using (t) join w using (t), s group by all)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
from scored where score > 0 qualify rank <= 20
"""


@query(OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


@query()
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    docs = bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), spec)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
