"""Queries of block layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blocks, token_id, word_blocks
from ..operators import layout as L
from ..operators import streams as S
from ..schemas import SPECIALS
from ._base import BLOCKS, CAP, capped, documents, positions_sql, roles, stored, tid, token_positions, word_documents

_CHECK = ["count(*) as n", "sum(row_pos * (thread + 1)) as a", "sum((row_pos + 1) * (local_step + 1)) as b", "sum(token % 1009 * (row_pos % 97 + 1)) as c"]


def _big(e: str, name: str):
    return F.expr(f"cast({e} as bigint)").alias(name)


def d01_split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = documents(spark, sf_dir).select("doc_id", F.posexplode(blocks(F.col("text"))).alias("block", "content"))
    return b.select("doc_id", "block", "content", F.length("content").alias("chars"))


def d01_split_blocks_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", F.flatten(word_blocks(F.col("text"))).alias("w"))
    made = L.split_blocks_by_class(F.transform("w", token_id), F.transform("w", lambda x: F.when(x.rlike(r"^[\n\r]+$"), "PURE").when(x.rlike(r"[\n\r]$"), "TRAIL").otherwise("NO")))
    return words.select("doc_id", made.alias("b")).select("doc_id", F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: F.size(x)), ",").alias("lens"))


def d02_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_documents(spark, sf_dir).select("doc_id", "n_blocks", "n_warm", "n_middle", "has_tail")


def d02_roles_no_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_documents(spark, sf_dir, 0).select("doc_id", "n_blocks", "n_warm", "n_middle", "has_tail")


def d03_row_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fits(word_documents(spark, sf_dir), 512).select("doc_id", L.row_length().alias("n"))


def d04_start_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.slice("lens", F.col("n_warm") + 1, F.col("n_middle"))
    return word_documents(spark, sf_dir).where("n_middle > 0").select("doc_id", F.posexplode(L.starts(middle, None)).alias("thread", "start"))


def d04_start_steps_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.slice("lens", F.col("n_warm") + 1, F.col("n_middle"))
    return word_documents(spark, sf_dir).where("n_middle > 0").select("doc_id", F.posexplode(L.starts(middle, CAP)).alias("thread", "start"))


def d05_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_positions(spark, sf_dir).groupBy("doc_id").agg(*[_big(*x.split(" as ")) for x in _CHECK])


def d05_row_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.rows(word_documents(spark, sf_dir, ids=True), "doc_id")
    return rows.select("doc_id", F.size("token").alias("n"), F.md5(F.array_join(F.col("token").cast("array<string>"), ",").cast("binary")).alias("tokens"))


def d05_row_order_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_positions(spark, sf_dir, CAP).groupBy("doc_id").agg(*[_big(*x.split(" as ")) for x in _CHECK])


def d06_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_positions(spark, sf_dir).where("local_step = 0 or (local_step = 1 and token = 5)")
    return p.select("doc_id", "thread", "local_step", "token", "row_pos")


def d07_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_positions(spark, sf_dir).groupBy("doc_id", "stage").agg(_big("count(*)", "n"), _big("sum(rope)", "rope"), F.max("local_step").alias("deepest"))


def d08_next_in_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_positions(spark, sf_dir, more=("next_pos",))
    return p.groupBy("doc_id").agg(_big("sum(next_pos - row_pos)", "jump"), _big("count(next_pos)", "linked"), F.max(F.col("next_pos") - F.col("row_pos")).alias("furthest"))


def d09_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_positions(spark, sf_dir).select("doc_id", "row_pos", "token", "target")


def d10_doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_documents(spark, sf_dir).select("doc_id", F.lit(0).alias("doc_idx"), L.row_length().alias("positions"))


def d11_step_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.step_groups(token_positions(spark, sf_dir), "doc_id").groupBy("doc_id").agg(_big("count(*)", "steps"), F.max("size").alias("widest"), _big("sum(size * size)", "squares"))


def d12_flat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_documents(spark, sf_dir).select("doc_id", L.flat_step_count(None).alias("flat"), L.flat_step_count(CAP).alias("flat_capped"))


def d13_yield_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.yield_summary(word_documents(spark, sf_dir)).drop("lens", "lang", "source")


def d14_token_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.token_yield(L.yield_summary(word_documents(spark, sf_dir)), "lang")


def d14_token_yield_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.token_yield(L.yield_summary(word_documents(spark, sf_dir), CAP), "lang")


def d15_generation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_positions(spark, sf_dir, more=("gen_step",))
    return p.groupBy("doc_id").agg(F.max("gen_step").alias("steps"), _big("sum(gen_step)", "total"))


def d16_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(F.flatten(word_blocks(F.col("text")))).alias("text"))
    vocab = stored(words.groupBy(token_id(F.col("text")).alias("id")).agg(F.min("text").alias("text")), "vocabulary")
    p = L.trace(token_positions(spark, sf_dir), vocab)
    return p.groupBy("doc_id", "tag").agg(_big("count(*)", "n"), _big("sum(length(text))", "chars"))


def d17_row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.rows(word_documents(spark, sf_dir, ids=True), "doc_id", more=("segment",), only=("row_pos", "thread", "stage", "local_step", "segment"))
    return L.segments_of_rows(rows).drop("segment")


def d18_logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines_of_rows(L.rows(word_documents(spark, sf_dir, ids=True), "doc_id", only=("row_pos", "thread")))


def d19_row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_positions(spark, sf_dir)
    spans = p.where("local_step = 2 and phase = 2").select("doc_id", F.col("row_pos").alias("start"), (F.col("row_pos") + 3).alias("end"))
    w = L.row_windows(p.select("doc_id", "row_pos", "token"), spans)
    return w.groupBy("doc_id", "window").agg(_big("count(*)", "n"), F.min("row_pos").alias("first_pos"), F.max("row_pos").alias("last_pos"))


def d20_slice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_positions(spark, sf_dir, more=L.LABELS)
    return p.groupBy("doc_id", "line_role", "depth_in_line", "line_start", "is_anchor_target").agg(_big("count(*)", "n"), _big("sum(wave_width)", "width"))


def d21_position_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_positions(spark, sf_dir, more=("source_index", "target_row"))
    return p.groupBy("doc_id").agg(_big("sum(source_index * (row_pos % 97 + 1))", "a"), _big("sum(target_row * (row_pos % 89 + 1))", "b"), _big("count_if(source_index >= 0)", "n"))


def _stream(spark: SparkSession, sf_dir: str, *columns: str, arrays: bool = False) -> DataFrame:
    """Plain streams: bos and the words of a document, each predicting the next; the last predicts an anchor."""
    return S.word_stream(documents(spark, sf_dir), "doc_id", *columns, arrays=arrays)


#: Ids of the special tokens, and K of those that open a wave of K lines.
MARKS = {name.strip("<|>"): i for i, name in enumerate(SPECIALS)}
WAVES = {i: int(name[4:]) for name, i in MARKS.items() if name.startswith("bot_")}


def _wave_stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Streams in which every line follows the opener of a wave as wide as the line has words, 16 at most."""
    return S.word_stream(documents(spark, sf_dir), "doc_id", *columns, bos=MARKS["bos"], openers=WAVES)


def d22_plain_slice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _stream(spark, sf_dir, "pos", "depth_in_line", "line_start", "is_anchor_target")
    return p.groupBy("doc_id", "depth_in_line", "line_start", "is_anchor_target").agg(_big("count(*)", "n"), _big("sum(pos)", "pos_sum"))


def d23_carry_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wave_stream(spark, sf_dir, "wave").groupBy("doc_id", "wave").agg(_big("count(*)", "n"))


QUERIES = {f.__name__: f for f in (
    d01_split_blocks, d01_split_blocks_by_class, d02_roles, d02_roles_no_warmup, d03_row_length, d04_start_steps, d04_start_steps_capped, d05_row_order, d05_row_arrays,
    d05_row_order_capped, d06_anchors, d07_positions, d08_next_in_thread, d09_targets, d10_doc_index, d11_step_groups, d12_flat_groups, d13_yield_summary, d14_token_yield,
    d14_token_yield_capped, d15_generation_steps, d16_trace, d17_row_segments, d18_logical_lines, d19_row_windows, d20_slice_labels, d21_position_labels, d22_plain_slice_labels, d23_carry_wave)}

_POS, _ROLES = "with " + positions_sql(), "with " + roles()
_SUM = ", ".join(f"cast({x.split(' as ')[0]} as bigint) as {x.split(' as ')[1]}" for x in _CHECK)
_STEPS = """,
 per as (select d.doc_id, any_value(d.lang) as lang, any_value(d.n_blocks) as n_blocks, any_value(d.n_warm) as n_warm, any_value(d.n_middle) as n_middle, any_value(d.has_tail) as has_tail,
   any_value(content) + any_value(d.n_blocks) + cast(any_value(d.has_tail) as integer) as tokens_incl, any_value(content) as tokens_excl,
   cast(coalesce(sum(len) filter (where thread < d.n_warm), 0) as integer) as warm_tokens, cast(coalesce(sum(len) filter (where thread >= d.n_warm and not is_tail), 0) as integer) as middle_tokens,
   cast(coalesce(sum(len) filter (where is_tail), 0) as integer) as tail_tokens,
   greatest(coalesce(max(thread - d.n_warm + len) filter (where thread >= d.n_warm and not is_tail), -1), case when any_value(d.has_tail) then any_value(d.n_middle) else -1 end) + 1 as ramp,
   coalesce(max(len + 1) filter (where thread >= d.n_warm and not is_tail), 0) as flat_ramp
   from thr t join doc d using (doc_id) group by d.doc_id),
 summary as (select doc_id, lang, n_blocks, has_tail, n_warm, n_middle, tokens_incl, tokens_excl,
   cast(warm_tokens + n_warm + ramp + case when has_tail then tail_tokens + 1 else 0 end as integer) as steps,
   cast(warm_tokens + n_warm + flat_ramp + case when has_tail then tail_tokens + 2 else 0 end as integer) as flat_steps, warm_tokens, middle_tokens, tail_tokens from per)"""
_YIELD = """ select lang, count(*) as docs, cast(sum(tokens_incl) as bigint) as tokens_incl, cast(sum(tokens_excl) as bigint) as tokens_excl, cast(sum(steps) as bigint) as steps, cast(sum(flat_steps) as bigint) as flat_steps,
        sum(tokens_incl) / sum(steps) as incl_per_step, sum(tokens_excl) / sum(steps) as excl_per_step, sum(tokens_incl) / sum(flat_steps) as incl_per_flat_step, sum(tokens_excl) / sum(flat_steps) as excl_per_flat_step,
        cast(sum(n_warm) as bigint) as warm_lines, cast(sum(n_middle) as bigint) as middle_lines, cast(sum(cast(has_tail as integer)) as bigint) as tail_lines, cast(sum(warm_tokens) as bigint) as warm_tokens, cast(sum(middle_tokens) as bigint) as middle_tokens, cast(sum(tail_tokens) as bigint) as tail_tokens from summary group by lang"""
_CAPPED_STEPS = f""",
 ends as (select doc_id, greatest(coalesce(max(s + lens[t + 1]) filter (where t < n_middle), -1), coalesce(max(s) filter (where t = n_middle), -1)) as last, coalesce(max(s + lens[t + 1]) filter (where t < n_middle), -1) as alone from sched group by doc_id),
 batches as (select doc_id, cast(sum(m) as integer) as ramp from (select doc_id, max(len + 1) as m from thr where thread >= n_warm and not is_tail group by doc_id, (thread - n_warm) // {CAP}) group by doc_id),
 summary as (select u.* replace (cast(u.warm_tokens + u.n_warm + case when u.has_tail then e.last else e.alone end + 1 + case when u.has_tail then u.tail_tokens + 1 else 0 end as integer) as steps,
   cast(u.warm_tokens + u.n_warm + coalesce(b.ramp, 0) + case when u.has_tail then u.tail_tokens + 2 else 0 end as integer) as flat_steps) from uncapped u join ends e using (doc_id) left join batches b using (doc_id))"""
_STREAM = "with " + BLOCKS + f""",
 w as (select doc_id, row_number() over (partition by doc_id order by b, i) as pos, words[i] || case when i = len and b < nb - 1 then chr(10) else '' end as w, i = len and b < nb - 1 as is_newline
   from (select *, unnest(range(1, len + 1)) as i from blk)),
 s0 as (select doc_id, pos, {tid('w')} as token, is_newline, w from w union all select distinct doc_id, 0, 1, false, '' from w),
 s1 as (select *, coalesce(lead(token) over (partition by doc_id order by pos), 1) as target, coalesce(lead(strlen(w)) over (partition by doc_id order by pos), 0) as target_bytes from s0)"""
_BUCKET = "case when {d} < 1 then -1 when {d} = 1 then 0 when {d} = 2 then 1 when {d} <= 4 then 2 when {d} <= 8 then 3 when {d} <= 16 then 4 else 5 end"

WAVE_STREAM = "with " + BLOCKS + f""",
 w as (select doc_id, row_number() over (partition by doc_id order by b, i) as pos, case when i = 0 then {MARKS["bot_1"]} - 1 + least(len, {len(WAVES)}) else {tid("words[i] || case when i = len and b < nb - 1 then chr(10) else '' end")} end as token,
   case when i = 0 then 0 else strlen(words[i]) + cast(i = len and b < nb - 1 as integer) end as size, case when i = 0 then least(len, {len(WAVES)}) end as k from (select *, unnest(range(0, len + 1)) as i from blk)),
 s0 as (select doc_id, pos, token, size, k from w union all select distinct doc_id, 0, {MARKS["bos"]}, 0, 1 from w),
 waves as (select doc_id, pos, token, coalesce(lead(token) over o, {MARKS["bos"]}) as target, coalesce(lead(size) over o, 0) as target_bytes, coalesce(last_value(k ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row), 1) as wave from s0 window o as (partition by doc_id order by pos))"""

ORACLE_SQL = {
    "d01_split_blocks": "with " + BLOCKS + " select doc_id, cast(b as integer) as block, line || case when b < nb - 1 then chr(10) else '' end as content, cast(length(line) + case when b < nb - 1 then 1 else 0 end as integer) as chars from blk",
    "d01_split_blocks_by_class": "with " + BLOCKS + " select doc_id, cast(count(*) as integer) as n_blocks, string_agg(cast(len as varchar), ',' order by b) as lens from blk group by doc_id",
    "d02_roles": _ROLES + " select doc_id, n_blocks, n_warm, n_middle, has_tail from doc",
    "d02_roles_no_warmup": "with " + roles(0) + " select doc_id, n_blocks, n_warm, n_middle, has_tail from doc",
    "d03_row_length": _ROLES + " select doc_id, content + n_blocks + cast(has_tail as integer) as n from doc where content + n_blocks + cast(has_tail as integer) <= 512",
    "d04_start_steps": _ROLES + " select doc_id, cast(t as integer) as thread, cast(t as integer) as start from (select doc_id, unnest(range(0, n_middle + 1)) as t from doc where n_middle > 0)",
    "d04_start_steps_capped": "with recursive " + roles() + capped(CAP) + " select doc_id, cast(t as integer) as thread, cast(s as integer) as start from sched where n_middle > 0",
    "d05_row_order_capped": "with recursive " + positions_sql(cap=CAP) + f" select doc_id, {_SUM} from pos group by doc_id",
    "d05_row_order": _POS + f" select doc_id, {_SUM} from pos group by doc_id",
    "d05_row_arrays": _POS + " select doc_id, cast(count(*) as integer) as n, md5(string_agg(cast(token as varchar), ',' order by row_pos)) as tokens from pos group by doc_id",
    "d06_anchors": _POS + " select doc_id, thread, local_step, token, row_pos from pos where local_step = 0 or (local_step = 1 and token = 5)",
    "d07_positions": _POS + " select doc_id, stage, count(*) as n, cast(sum(rope) as bigint) as rope, max(local_step) as deepest from pos group by doc_id, stage",
    "d08_next_in_thread": _POS + ", nx as (select *, lead(row_pos) over (partition by doc_id, thread order by local_step) as next_pos from pos) select doc_id, cast(sum(next_pos - row_pos) as bigint) as jump, count(next_pos) as linked, max(next_pos - row_pos) as furthest from nx group by doc_id",
    "d09_targets": _POS + " select doc_id, row_pos, token, target from pos",
    "d10_doc_index": _ROLES + " select doc_id, cast(0 as integer) as doc_idx, content + n_blocks + cast(has_tail as integer) as positions from doc",
    "d11_step_groups": _POS + ", g as (select doc_id, count(*) as size from pos group by doc_id, phase, step, case when phase = 1 then 0 else local_step end) select doc_id, count(*) as steps, cast(max(size) as integer) as widest, cast(sum(size * size) as bigint) as squares from g group by doc_id",
    "d12_flat_groups": _ROLES + _STEPS + """, batch as (select doc_id, cast(sum(m) as integer) as ramp from (select doc_id, max(len + 1) as m from thr where thread >= n_warm and not is_tail group by doc_id, (thread - n_warm) // 4) group by doc_id)
        select s.doc_id, s.flat_steps as flat, cast(s.warm_tokens + s.n_warm + coalesce(b.ramp, 0) + case when s.has_tail then s.tail_tokens + 2 else 0 end as integer) as flat_capped from summary s left join batch b using (doc_id)""",
    "d13_yield_summary": _ROLES + _STEPS + " select doc_id, n_blocks, has_tail, n_warm, n_middle, tokens_incl, tokens_excl, steps, flat_steps, warm_tokens, middle_tokens, tail_tokens from summary",
    "d14_token_yield": _ROLES + _STEPS + _YIELD,
    "d14_token_yield_capped": "with recursive " + roles() + capped(CAP) + _STEPS.replace("summary as", "uncapped as") + _CAPPED_STEPS + _YIELD,
    "d15_generation_steps": _POS + ", g as (select *, dense_rank() over (partition by doc_id order by phase, step, case when phase = 1 then 0 else local_step end) as g from pos), f as (select *, min(case when row_pos >= 2 then g end) over (partition by doc_id) as f from g) select doc_id, cast(max(case when row_pos < 2 then 0 else g - f + 1 end) as integer) as steps, cast(sum(case when row_pos < 2 then 0 else g - f + 1 end) as bigint) as total from f group by doc_id",
    "d16_trace": _POS + f", ww as (select words[i] || case when i = len and b < nb - 1 then chr(10) else '' end as w from (select *, unnest(range(1, len + 1)) as i from blk)), vocab as (select {tid('w')} as id, min(w) as w from ww group by 1) select doc_id, case when local_step > 0 then case when token = 5 and local_step = 1 then 'block_open' end when thread = 0 then 'stream_start' else 'thread_start' end as tag, count(*) as n, cast(sum(length(w)) as bigint) as chars from pos left join vocab on token = id group by 1, 2",
    "d17_row_segments": _POS + """, c as (select *, case when lag(thread) over w = thread and lag(stage) over w = stage and lag(local_step) over w + 1 = local_step and lag(rope) over w + 1 = rope then 0 else 1 end as cut from pos window w as (partition by doc_id order by row_pos)),
        s as (select *, sum(cut) over (partition by doc_id order by row_pos) as segment from c)
        select doc_id, min(thread) as thread, min(stage) as stage, min(row_pos) as first_pos, max(row_pos) as last_pos, min(local_step) as first_step, max(local_step) as last_step from s group by doc_id, segment""",
    "d18_logical_lines": _POS + """, r as (select doc_id, thread, row_pos, row_pos - row_number() over (partition by doc_id, thread order by row_pos) as run from pos),
        s as (select doc_id, thread, min(row_pos) as a, max(row_pos) as b from r group by doc_id, thread, run)
        select doc_id, thread, cast(sum(b - a + 1) as bigint) as n, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ',' order by a) as spans from s group by doc_id, thread""",
    "d19_row_windows": _POS + """, n as (select doc_id, max(row_pos) + 1 as n from pos group by doc_id), sp as (select doc_id, row_pos as s, row_pos + 3 as e from pos where local_step = 2 and phase = 2),
        w as (select p.doc_id, p.row_pos, n.n, sp.s, sp.e from pos p join n using (doc_id) left join sp using (doc_id)),
        u as (select doc_id, row_pos, 'head' as win from w where row_pos < 40 union all select doc_id, row_pos, 'answer' from w where row_pos between s - 12 and e - 1 + 12 union all select doc_id, row_pos, 'tail' from w where row_pos >= n - 80)
        select doc_id, win as "window", count(*) as n, min(row_pos) as first_pos, max(row_pos) as last_pos from u group by doc_id, win""",
    "d20_slice_labels": _POS + f""", l as (select *, case when thread < n_warm then 0 when thread < n_warm + n_middle then 1 else 2 end as line_role, cast(target in (1, 2, 3, 5) as integer) as is_anchor_target,
          coalesce({_BUCKET.format(d='next_step')}, -1) as d0 from pos),
        m as (select *, case when next_step is null then -1 else d0 end as depth_in_line, coalesce(cast(is_anchor_target = 0 and next_step = case when line_role = 2 then 2 else 1 end as integer), 0) as line_start,
          case when line_role = 1 then count(*) filter (where line_role = 1) over (partition by doc_id, phase, step) else 1 end as wave_width from l)
        select doc_id, line_role, depth_in_line, line_start, is_anchor_target, count(*) as n, cast(sum(wave_width) as bigint) as width from m group by all""",
    "d21_position_labels": _POS + """, c as (select *, local_step >= case when is_tail then 2 else 1 end as c from pos),
        i as (select *, sum(cast(c as integer)) over (partition by doc_id order by thread, local_step) - 1 as i from c),
        l as (select *, lead(c) over w as nc, lead(i) over w as ni, lead(row_pos) over w as nr from i window w as (partition by doc_id, thread order by local_step))
        select doc_id, cast(sum(case when nc then ni else -1 end * (row_pos % 97 + 1)) as bigint) as a, cast(sum(case when nc then nr else -1 end * (row_pos % 89 + 1)) as bigint) as b, count(*) filter (where nc) as n from l group by doc_id""",
    "d22_plain_slice_labels": _STREAM + f""", c as (select *, token = 1 or is_newline as brk, target_bytes > 0 as content, coalesce(max(case when token = 1 or is_newline then pos end) over (partition by doc_id order by pos), -1) as last_ from s1),
        l as (select *, case when content then {_BUCKET.format(d='(pos - last_ + 1)')} else -1 end as depth_in_line, cast(brk and content as integer) as line_start, cast(target_bytes = 0 as integer) as is_anchor_target from c)
        select doc_id, depth_in_line, line_start, is_anchor_target, count(*) as n, cast(sum(pos) as bigint) as pos_sum from l group by all""",
    "d23_carry_wave": WAVE_STREAM + " select doc_id, cast(wave as integer) as wave, count(*) as n from waves group by doc_id, wave",
}
