"""Queries of sources and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from ..operators import longlines as B
from ..sources import corpus as A
from ..sources import items as I
from ..sources import published
from ..sources.shared import shared_path
from ..streaming.ingest import ingest, ingest_batches, stream_corpus
from ._base import DOCS, documents, table

CURSOR = ("src3", 500)


def a01_split_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    val = A.split_by_group(docs, "source", "val").select("doc_id", F.lit("val").alias("split"))
    return val.unionByName(A.split_by_group(docs, "source", "train").select("doc_id", F.lit("train").alias("split")))


def a02_scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scan_text(table(spark, sf_dir, "documents"))


def a03_strided_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assign_shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


def a04_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.replay(table(spark, sf_dir, "documents").select("doc_id", "source"), 3)


def a05_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.after_cursor(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", CURSOR)


def a05_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus through the resumable stream, to a folder that all executors share; the pattern fits a file and a folder."""
    root = shared_path(spark, "ingest")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    ingest(stream_corpus(spark, f"{sf_dir}/documents.parque[t]", schema=schema), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


def a05_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words by line number, an aggregation that runs in each micro-batch and is published once."""
    root = shared_path(spark, "batches")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    lines = lambda d: d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).groupBy("line").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("t", " "))).alias("words"))
    ingest_batches(stream_corpus(spark, f"{sf_dir}/documents.parque[t]", schema=schema), f"{root}/out", f"{root}/checkpoint", lines).awaitTermination()
    return published.read_published(spark, f"{root}/out").groupBy("line").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


def a06_prepare_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


def a07_cap_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cap_chars(table(spark, sf_dir, "documents"), 10_000).select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def a08_take_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return A.take_budget(docs, F.col("n_chars"), 1_000_000, "source", "doc_id").select("doc_id", "source")


def a08_take_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(F.split("text", " ")).alias("words"))
    return A.take_budget(docs, F.col("words"), 100_000, "source", "doc_id", inclusive=False).select("doc_id", "source")


def a09_round_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.round_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 500_000, 4, 1024, 2)


def _rewritten(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """The corpus without full stops at line ends, published by source: where, and what each of two calls wrote."""
    out = shared_path(spark, "rewritten")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    fix = lambda d: d.withColumn("text", F.regexp_replace("text", "[.]\n", "\n"))
    return out, *(A.rewrite_shards(spark, docs, "source", out, fix, "doc_id") for _ in range(2))


def a10_rewrite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first call wrote; the second one finds all shards there."""
    _, first, second = _rewritten(spark, sf_dir)
    return first.unionByName(second)


def a10_rewritten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = _rewritten(spark, sf_dir)
    return published.read_published(spark, out).select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "modified")


def a11_read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as JSON lines in four files, with a blank line after every third item, read back with line numbers."""
    path = shared_path(spark, "items")
    item = F.to_json(F.struct(F.col("text").alias("query"), F.array(F.lit("yes"), F.lit("no")).alias("choices"), (F.col("item_id") % 2).cast("int").alias("gold")))
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("part"), "item_id", F.concat(item, F.when(F.col("item_id") % 3 == 0, "\n ").otherwise("")).alias("value"))
    rows.repartition(4, "part").sortWithinPartitions("part", "item_id").select("part", "value").write.partitionBy("part").text(path)
    return I.read_items(spark, f"{path}/part=*").select(F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part"), "line", "query", F.array_join("choices", "/").alias("choices"), "gold")


def a12_read_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of the sources as CSV, read back with the declared schema."""
    path = shared_path(spark, "baselines")
    base = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("label")).agg((F.min("doc_id") % 50 / 2).alias("random_baseline"))
    base.write.option("header", True).csv(path)
    return I.read_baselines(spark, path)


def a13_select_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("label")).agg(F.count("*").cast("int").alias("num_fewshot"))
    wanted = table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), (F.col("n_chars") % 25).cast("string")).alias("label")).distinct()
    own = tasks.where("label < 'src2'").select("label", F.lit(5).alias("num_fewshot"))
    chosen, missing = I.select_tasks(tasks, wanted, own, 10)
    return chosen.select("label", "num_fewshot", F.lit(False).alias("missing")).unionByName(missing.select("label", F.lit(None).cast("int").alias("num_fewshot"), F.lit(True).alias("missing")))


def a14_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.subsample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    acc = F.avg(F.when(F.col("n_chars") % 2 == 0, 1.0).otherwise(0.0))
    return docs.groupBy(F.col("source").alias("task")).agg(acc.alias("accuracy")).withColumn("centered", (F.col("accuracy") - 0.25) / 0.75)


def a15_score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back; 22 tasks are expected, and there are fewer sources."""
    return I.read_scores(spark, I.write_scores(_scores(spark, sf_dir), shared_path(spark, "scores"), "run", expected=22))


def a16_metrics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir).select(F.lit("r").alias("run"), F.lit("task").alias("slice"), F.col("task").alias("label"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    path = shared_path(spark, "metrics")
    I.write_metrics(s, path)
    return I.read_metrics(spark, path)


def a17_latest_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest_per_run(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "event_type", "value"))


def b01_cap_newline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" the "), F.lit("\n" * 9)).alias("t"))
    return docs.select("doc_id", F.length(T.cap_newline_runs(F.col("t"), 4)).alias("chars"), F.length("t").alias("before"))


def b02_split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_segments(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "seg", "content", F.length("sep").alias("sep"))


def b03_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.split_segments(documents(spark, sf_dir).select("doc_id", "text"))
    return s.select("doc_id", "seg", B.over_budget(F.col("content"), F.col("sep"), 60, B.n_words).alias("over"))


def b04_split_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_long_lines(documents(spark, sf_dir).select("doc_id", "text"), 60)


def b05_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line behind its number."""
    s = B.split_segments(documents(spark, sf_dir).select("doc_id", "text"))
    return B.rejoin(s.withColumn("line", F.concat_ws(":", "seg", "content")), "doc_id", "text")


def b06_modified_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(*A.modified_stats(F.col("text"), F.replace("text", F.lit(" the "), F.lit(" "))))


def b07_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text"), F.lit(" "), F.col("lang")).alias("line"))


def _story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story prompts from the benchmark's words: a story, two earlier questions, a final one."""
    w = F.split(F.regexp_replace("text", "\\s+", " "), " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    text = F.concat(F.lit(T.STORY + "\n\nStory:\n"), part(1, 8), F.lit("\n\nPreceding questions:\nQuestion: "), part(9, 3), F.lit("\nAnswer: "), part(12, 1), F.lit("\nQuestion: "), part(13, 2), F.lit("\nAnswer: "), part(15, 1), F.lit("\n\nFinal question:\nQuestion: "), F.array_join(F.slice(w, F.lit(16), F.greatest(F.size(w), F.lit(1))), " "), F.lit("\nAnswer: "))
    return table(spark, sf_dir, "benchmark").select("item_id", text.alias("t"))


def b08_joined_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).select("item_id", T.joined_history(F.col("t")).alias("prompt"))


def b09_without_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).select("item_id", T.without_history(F.col("t")).alias("prompt"))


def b10_final_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.regexp_replace("text", "\\s+", " "), F.lit("\nQuestion: who "), F.col("item_id").cast("string"), F.lit("\nAnswer:  "))
    return table(spark, sf_dir, "benchmark").select("item_id", T.final_pair_on_one_line(t).alias("prompt"))


def b11_final_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story(spark, sf_dir).select("item_id", T.final_question(F.col("t")).alias("question"), T.count_turns(F.col("t")).alias("turns"))


QUERIES = {f.__name__: f for f in (
    a01_split_by_shard, a02_scan_text, a03_strided_shards, a04_replay, a05_after_cursor, a05_stream_ingest, a05_stream_batches, a06_prepare_docs, a07_cap_chars, a08_take_budget, a08_take_token_budget, a09_round_budget, a10_rewrite_stats, a10_rewritten_text,
    a11_read_items, a12_read_baselines, a13_select_tasks, a14_subsample, a15_score_lines, a16_metrics_round_trip, a17_latest_per_run, b01_cap_newline_runs, b02_split_segments, b03_over_budget, b04_split_long_lines, b05_rejoin,
    b06_modified_stats, b07_one_line, b08_joined_history, b09_without_history, b10_final_pair, b11_final_question)}

_SCORES = "s as (select source as task, avg(case when n_chars % 2 = 0 then 1.0::double else 0.0::double end) as accuracy from documents group by source)"
_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seg, len(string_split(text, chr(10))) as n from docs)"
_W = r"w as (select item_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') as w from benchmark)"
_PART = "array_to_string(w[{a}:{b}], ' ')"


def _prompt(old: bool) -> str:
    p = lambda a, n: _PART.format(a=a, b=a + n - 1)
    nl, rest = " || chr(10) || ", "array_to_string(w[16:], ' ')"
    if old:  # the history on single lines
        return f"'{T.STORY}' || chr(10)" + nl + f"'Story:'{nl}{p(1, 8)}{nl}chr(10) || 'Preceding questions:'{nl}'Question: ' || {p(9, 3)} || ' Answer: ' || {p(12, 1)}{nl}'Question: ' || {p(13, 2)} || ' Answer: ' || {p(15, 1)}{nl}chr(10) || 'Final question: Question: ' || {rest} || ' Answer: '"
    return f"'{T.STORY_ALONE}' || chr(10)" + nl + f"'Story:'{nl}{p(1, 8)}{nl}chr(10) || 'Question: ' || {rest}{nl}'Answer: '"


ORACLE_SQL = {
    "a01_split_by_shard": "select doc_id, case when source = (select max(source) from documents) then 'val' else 'train' end as split from documents",
    "a02_scan_text": "select text from documents",
    "a03_strided_shards": "select doc_id, cast(doc_id % 7 as integer) as worker from documents",
    "a04_replay": "select doc_id, source, cast(unnest(range(1, 4)) as integer) as epoch from documents",
    "a05_after_cursor": "select source, doc_id from documents where source > 'src3' or (source = 'src3' and doc_id > 500)",
    "a05_stream_ingest": rf"with {DOCS} select doc_id, regexp_replace(text, '([\n\r]{{16}})[\n\r]+', '\1', 'g') as text from docs where length(text) > 0",
    "a06_prepare_docs": f"with {DOCS} select doc_id, text from docs where length(text) > 0",
    "a07_cap_chars": "select doc_id, cast(least(length(text), 10000) as integer) as chars, md5(substr(text, 1, 10000)) as digest from documents",
    "a05_stream_batches": rf"with {DOCS}, t as (select regexp_replace(text, '([\n\r]{{16}})[\n\r]+', '\1', 'g') as text from docs where length(text) > 0), l as (select unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from t) select cast(line as integer) as line, count(*) as docs, cast(sum(len(string_split(t, ' '))) as bigint) as words from l group by 1",
    "a08_take_budget": "with c as (select doc_id, source, sum(n_chars) over (order by source, doc_id) - n_chars as before from documents) select doc_id, source from c where before <= 1000000",
    "a08_take_token_budget": "with c as (select doc_id, source, sum(len(string_split(text, ' '))) over (order by source, doc_id) - len(string_split(text, ' ')) as before from documents) select doc_id, source from c where before < 100000",
    "a09_round_budget": "select doc_id, n_chars from documents order by doc_id limit 488",
    "a10_rewrite_stats": "select source, count(*) as docs, count(*) filter (where contains(text, '.' || chr(10))) as modified, count(*) filter (where contains(text, '.' || chr(10))) / count(*) as ratio from documents group by source",
    "a11_read_items": """with n as (select *, item_id % 4 as part, row_number() over (partition by item_id % 4 order by item_id) as i,
          count(*) filter (where item_id % 3 = 0) over (partition by item_id % 4 order by item_id rows between unbounded preceding and 1 preceding) as blank from benchmark)
        select cast(part as integer) as part, i + blank as line, text as query, 'yes/no' as choices, cast(item_id % 2 as integer) as gold from n""",
    "a12_read_baselines": "select source as label, cast(min(doc_id) % 50 / 2 as double) as random_baseline from documents group by source",
    "a14_subsample": "select doc_id, source from documents qualify row_number() over (partition by source order by md5('1337:' || doc_id), doc_id) <= 20",
    "a13_select_tasks": """with t as (select source as label, count(*) as n from documents group by source), w as (select distinct 'src' || (n_chars % 25) as label from documents)
        select label, cast(case when t.n is null then null when label < 'src2' then 5 else 10 end as integer) as num_fewshot, t.n is null as missing from w left join t using (label)""",
    "a10_rewritten_text": "select source, doc_id, md5(replace(text, '.' || chr(10), chr(10))) as digest, contains(text, '.' || chr(10)) as modified from documents",
    "a15_score_lines": f"with {_SCORES}, c as (select task, accuracy, (accuracy - 0.25::double) / 0.75::double as centered from s) select task, accuracy, centered from c union all select case when count(*) < 22 then 'CORE_PARTIAL' else 'CORE' end, null, avg(centered) from c",
    "a16_metrics_round_trip": f"with {_SCORES} select 'r' as run, 'task' as slice, task as label, 'accuracy' as metric, accuracy as value from s",
    "a17_latest_per_run": "select user_id as run, max(event_id) as step, max_by(event_type, event_id) as event_type, max_by(value, event_id) as value from events group by user_id",
    "b01_cap_newline_runs": "with t as (select doc_id, replace(text, ' the ', repeat(chr(10), 9)) as t from documents) select doc_id, cast(length(regexp_replace(t, '(\n{4})\n+', '\\1', 'g')) as integer) as chars, cast(length(t) as integer) as before from t",
    "b02_split_segments": f"with {DOCS}, {_LINES} select doc_id, cast(seg as integer) as seg, content, cast(case when seg < n - 1 then 1 else 0 end as integer) as sep from l",
    "b03_over_budget": f"with {DOCS}, {_LINES} select doc_id, cast(seg as integer) as seg, case when strlen(content) + case when seg < n - 1 then 1 else 0 end <= 60 then false else len(string_split(content, ' ')) + case when seg < n - 1 then 1 else 0 end > 60 end as over from l",
    "b04_split_long_lines": rf"""with recursive {DOCS}, t as (select doc_id, regexp_replace(text, '([\n\r]{{16}})[\n\r]+', '\1', 'g') as text from docs where length(text) > 0),
        g as (select doc_id, unnest(regexp_extract_all(text, '[^\n\r]+[\n\r]*|[\n\r]+')) as s, generate_subscripts(regexp_extract_all(text, '[^\n\r]+[\n\r]*|[\n\r]+'), 1) as seg from t),
        l as (select doc_id, seg, regexp_replace(s, '[\n\r]+$', '') as c, s[length(regexp_replace(s, '[\n\r]+$', '')) + 1:] as sep from g),
        p as (select doc_id, seg, '' as path, c as t, greatest(1, length(sep)) as room, strlen(c) + length(sep) <= 60 or len(string_split(c, ' ')) + length(sep) <= 60 as fits from l
          union all select doc_id, seg, path || side, case side when '0' then t[:cut] else t[cut + 1:] end, case side when '0' then 1 else room end,
            length(case side when '0' then t[:cut] else t[cut + 1:] end) < 2 or len(string_split(case side when '0' then t[:cut] else t[cut + 1:] end, ' ')) + case side when '0' then 1 else room end <= 60
          from (select *, case when stop > 0 and low + stop < length(t) then low + stop else length(t) // 2 end as cut from
            (select *, length(regexp_extract(t[low + 1:least(length(t), length(t) // 2 + half)], '(?s)^(.*[{B.STOPS}])', 1)) as stop from
              (select *, greatest(0, length(t) // 2 - half) as low from (select *, greatest(1, cast(floor(length(t) * {B.WINDOW}) as bigint)) as half from p where not fits)))), (values ('0'), ('1')) v(side)),
        j as (select doc_id, seg, string_agg(t, chr(10) order by path) as t from p where fits group by doc_id, seg)
        select doc_id, string_agg(j.t || l.sep, '' order by j.seg) as text from j join l using (doc_id, seg) group by doc_id""",
    "b05_rejoin": rf"with {DOCS}, s as (select doc_id, unnest(regexp_extract_all(text, '[^\n\r]+[\n\r]*|[\n\r]+')) as s, generate_subscripts(regexp_extract_all(text, '[^\n\r]+[\n\r]*|[\n\r]+'), 1) - 1 as seg from docs) select doc_id, string_agg(seg || ':' || s, '' order by seg) as text from s group by doc_id",
    "b06_modified_stats": "select lang, count(*) as docs, count(*) filter (where contains(text, ' the ')) as modified, count(*) filter (where contains(text, ' the ')) / count(*) as ratio from documents group by lang",
    "b07_one_line": r"select doc_id, trim(regexp_replace(text, '[ \t]*\r?\n[ \t]*', ' ', 'g')) || ' ' || lang as line from documents",
    "b08_joined_history": f"with {_W} select item_id, {_prompt(True)} as prompt from w",
    "b09_without_history": f"with {_W} select item_id, {_prompt(False)} as prompt from w",
    "b10_final_pair": r"select item_id, regexp_replace(text, '\s+', ' ', 'g') || chr(10) || 'Question: who ' || item_id || ' Answer:' as prompt from benchmark",
    "b11_final_question": f"with {_W} select item_id, array_to_string(w[16:], ' ') as question, cast(2 as integer) as turns from w",
}
