"""Registered queries of the operators, each over its whole intended table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetrix.llm import bpe, conversation_repair, line_dedup, periodic_runs, quality, suffix_dedup, suffix_tree_lm, token_counts, toxicity
from telemetrix.llm.common import crc_fold
from telemetrix.llm.decontamination import decontaminate
from telemetrix.llm.preferences import preferences
from telemetrix.llm.simhash import near_duplicates
from telemetrix.llm.topk import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as w
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, b.vec_id,
         cast(list_sum(list_transform(list_zip(q.w, b.w), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v b on q.vec_id <> b.vec_id
  where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from s
)
select query_id, cast(rn as integer) as rank, vec_id, score from r where rn <= 5
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("id"), 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null
), spans as (select distinct least(10, len(w)) as m from b where len(w) > 0
), bw as (
  select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as g
  from (select item, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
        from b where len(w) > 0)
), dw as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, spans where len(w) >= m)
), hit as (select doc_id, i, m, item from dw join bw using (m, g)
), words as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s
  from (select distinct doc_id, item from hit) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join named using (doc_id)
"""

def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree_lm.scores(table(spark, sf_dir, "documents"), crc_fold(F.col("id"), 5) != 1, depth=None)
    return found.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_rows(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("id"), 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


OP9_SQL = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents
), parts as (  -- the long texts in pieces, so that substrings stay cheap
  select doc_id, k * 1000 as base, substr(h, 2000 * k + 1, 2200) as piece, length(h) // 2 as n
  from (select doc_id, h, unnest(range(0, length(h) // 2000 + 1)) as k from d)
), w as (
  select doc_id, base + i as pos, substr(piece, 2 * i + 1, 200) as s
  from (select *, unnest(range(0, 1000)) as i from parts) where base + i + 100 <= n
), later as (
  select doc_id, pos from (select doc_id, pos, row_number() over (partition by s order by doc_id, pos) as r from w) where r > 1
), bytes as (
  select doc_id, base + i as pos, substr(piece, 2 * i + 1, 2) as b
  from (select *, unnest(range(0, 1000)) as i from parts) where base + i < n
), marked as (
  select b.doc_id, b.pos, b.b, coalesce(max(l.pos) over (partition by b.doc_id order by b.pos) > b.pos - 100, false) as gone
  from bytes b left join later l on l.doc_id = b.doc_id and l.pos = b.pos
), runs as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as opens from marked
), out as (
  select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans,
         coalesce(string_agg(b, '' order by pos) filter (where not gone), '') as kept
  from runs group by doc_id
)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join out using (doc_id)
"""


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs: each conversation is chosen; rejected is the same with its last assistant turn's text replaced by that of its
    neighbour's (ids 2m and 2m + 1; nothing, if there is none), so all turns before it are the prompt."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("said"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("said").alias("other"))
    replaced = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    spoilt = turns.join(last.drop("said"), "conv_id", "left").join(other, "conv_id", "left").select(
        (-F.col("conv_id") - 1).alias("conv_id"), "turn", "role", replaced.alias("text"))
    pairs = turns.select(F.col("conv_id").alias("pair_id")).distinct().select(
        "pair_id", F.col("pair_id").alias("chosen"), (-F.col("pair_id") - 1).alias("rejected"))
    turns = turns.unionByName(spoilt)
    text = {side: F.concat_ws(",", F.transform(f"{side}_spans", lambda s: F.concat_ws(":", s["start"], s["size"])))
            for side in ("chosen", "rejected")}
    return preferences(turns, pairs).select(
        "pair_id", "n_common", "prompt", "chosen", text["chosen"].alias("chosen_mask"),
        "rejected", text["rejected"].alias("rejected_mask"))


OP10_SQL = """
with l as (
  select conv_id, max(turn) as last, max_by(text, turn) as said from conversations where role = 'assistant' and conv_id is not null group by conv_id
), u as (
  select conv_id, turn, role, text from conversations where conv_id is not null
  union all
  select -1 - c.conv_id, c.turn, c.role, case when c.role = 'assistant' and c.turn = l.last then coalesce(n.said, '') else c.text end
  from conversations c left join l on l.conv_id = c.conv_id left join l n on n.conv_id = xor(c.conv_id, 1) where c.conv_id is not null
), t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k from u
), p as (select distinct conv_id as pair_id from conversations where conv_id is not null
), both_ as (
  select p.pair_id, a.k, a.role = b.role and a.text = b.text as same
  from p join t a on a.conv_id = p.pair_id join t b on b.conv_id = -1 - p.pair_id and a.k = b.k
), n as (
  select pair_id, coalesce(min(case when not same then k end) - 1, max(k)) as n_common from both_ group by pair_id
), c as (select pair_id, coalesce(n_common, 0) as n_common from p left join n using (pair_id)
), r as (
  select c.pair_id, case when t.conv_id < 0 then 1 else 0 end as side, t.k, t.role, t.text, c.n_common,
         coalesce(sum(length(role) + length(text) + 13) over (
           partition by c.pair_id, t.conv_id, t.k > c.n_common order by t.k rows between unbounded preceding and 1 preceding), 0) as pos
  from c join t on t.conv_id in (c.pair_id, -1 - c.pair_id)
), s as (
  select pair_id, side,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by k) filter (where k <= n_common) as prompt,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by k) filter (where k > n_common), '') as body,
    coalesce(string_agg((pos + length(role) + 5)::bigint::varchar || ':' || (length(text) + 8)::varchar, ',' order by k)
      filter (where k > n_common and role = 'assistant'), '') as mask
  from r group by pair_id, side
)
select c.pair_id, cast(c.n_common as integer) as n_common, coalesce(a.prompt, '') as prompt, a.body as chosen,
       coalesce(a.mask, '') as chosen_mask, b.body as rejected, coalesce(b.mask, '') as rejected_mask
from c left join s a on a.pair_id = c.pair_id and a.side = 0 left join s b on b.pair_id = c.pair_id and b.side = 1
"""

def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
with l as (
  select doc_id, line, k, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents)
), f as (select key, min(doc_id) as first from l where length(key) >= 10 group by key having count(distinct doc_id) > 1
), m as (select l.*, coalesce(first < doc_id, false) as gone from l left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


def looped(docs: DataFrame) -> DataFrame:
    """``documents`` whose texts of every tenth id hash go round in a loop from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(w):
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    damaged = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, loop(w)).otherwise(""))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, damaged).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col("row._c0").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start",
        (-F.col("best.less")).alias("length"), "best.period",
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults by the hash of id and turn; a dropped row stays as one that is not ``present``."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    m = F.crc32(named.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select(
        "conv_id", "turn", F.when(m == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(m == 1, F.lit("")).when(m == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (m != 0).alias("present"), F.when(m == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), present="present")
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select(F.col("conv").alias("conv_id"), *conversation_repair.NAMES[:7],
                        F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))


def _op13_sql() -> str:
    """A recursion over the turns: least cost and letters by state as one text each, the cost in front."""
    def more(x: str, cost: str, letter: str) -> str:
        return f"(lpad(cast(cast(substr({x}, 1, 9) as int) + {cost} as varchar), 9, '0') || substr({x}, 10) || '{letter}')"

    def inserted(source: str, keep: str) -> str:  # c0, c1 as they are, c2 and c3 with turns inserted first
        insert = [more(x, "5", "I") for x in ("c0", "c1", "c3", "d2")]
        return (f"select {keep}, c0, c1, d2 as c2, least(c3, {insert[3]}) as c3 "
                f"from (select *, least(c2, {insert[0]}, {insert[1]}, {insert[2]}) as d2 from ({source}))")

    def kept(x: str, initial: str) -> str:
        return f"case when not must and i = '{initial}' then {more(x, 'extra', 'K')} end"

    def named(x: str) -> str:
        return f"case when not must then {more(x, '1 + extra', 'R')} end"

    asked = ", ".join(f"{kept(c, 'u')}, {named(c)}" for c in ("c0", "c1", "c3"))
    step = f"""
      select conv_id, k, {more('c0', '2', 'D')} as c0, least({more('c1', '2', 'D')}, {kept('c0', 's')}) as c1,
             least({more('c2', '2', 'D')}, {asked}) as c2,
             least({more('c3', '2', 'D')}, {kept('c2', 'a')}, {named('c2')}) as c3
      from (select s.conv_id, r.k, must, i, extra, c0, c1, c2, c3 from ({inserted('select * from steps', 'conv_id, k')}) s
            join rows_ r on r.conv_id = s.conv_id and r.k = s.k + 1)"""
    return rf"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations
), hashed as (
  select *, xor(list_reduce(list_transform(string_split(name, ''), lambda c: cast(ascii(c) as bigint)),
      lambda acc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end,
                                 xor(acc, b)), 4294967295), 4294967295) % 20 as m from named
), dealt as (
  select conv_id, turn, case when m = 4 then 'user' else role end as role,
         case m when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case m when 0 then 0 when 3 then 2 else 1 end)) as copy from hashed
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k from dealt
), judged as (
  select *, not regexp_matches(text, '[^ 	-
]') as blank,
         row_number() over (partition by conv_id, role, text order by k) > 1 as again,
         regexp_matches(text, '[^ 	-
.!?][ 	-
]*\z') as cut,
         substr(role, 1, 1) as i, lag(substr(role, 1, 1)) over (partition by conv_id order by k) as i0 from numbered
), rows_ as (
  select conv_id, k, turn, role, text, i, i0, blank, not blank and again as duplicate, not blank and not again and cut as truncated,
         blank or again as must, case when not blank and not again and cut then 5 else 0 end as extra from judged
), counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
         count(*) filter (where truncated) as truncated,
         count(*) filter (where k > 1 and i0 || i not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id
), steps as (
  select conv_id, cast(0 as bigint) as k, '000000000' as c0, cast(null as varchar) as c1, cast(null as varchar) as c2,
         cast(null as varchar) as c3 from counts
  union all {step}
), best as (
  select conv_id, least(c0, c3) as b from ({inserted("select * from steps", "conv_id, k")}) join counts using (conv_id) where k = n
), letters as (
  select conv_id, j, substr(b, 9 + j, 1) as letter
  from (select conv_id, b, unnest(range(1, length(b) - 8)) as j from best)
), placed as (
  select *, count(*) filter (where letter <> 'I') over w as k, count(*) filter (where letter <> 'D') over w as e
  from letters window w as (partition by conv_id order by j rows between unbounded preceding and current row)
), met as (
  select p.conv_id, j, letter, e, r.role, case when letter = 'I' then '' else r.text end as text,
         max(case when e = 1 and letter = 'K' and r.i = 's' then 1 else 0 end) over (partition by p.conv_id) as s
  from placed p left join rows_ r on r.conv_id = p.conv_id and r.k = p.k where letter <> 'D'
), texts as (
  select conv_id, string_agg(case when letter = 'K' then role when (e - s) % 2 = 1 then 'user' else 'assistant' end || ':' || text,
                             chr(10) order by j) as t from met group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(substr(b, 1, 9), '0') as bigint) as cost,
       coalesce(substr(b, 10), '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts using (conv_id) left join best using (conv_id)
  left join texts using (conv_id)
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_topk": op2_topk,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_lm_score": op5_lm_score,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_preferences": op10_preferences,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op2_topk": OP2_SQL,
    "op4_decontaminate": OP4_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_preferences": OP10_SQL,
    "op11_line_dedup": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
