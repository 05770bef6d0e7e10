"""Tables and shared SQL of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, streams
from ..sources.corpus import prepare_docs
from ..sources.shared import shared_path

WARM = 16
#: Bytes of a full split.
SPLIT = 128 << 20
CAP = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out over all cores.

    A file of few row groups is read by as few tasks, and array functions on its texts run where it is read. Inputs that
    fill the cores with full splits are left alone, so nothing of size is shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SPLIT * cores
    return df.repartition(cores) if small else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a join plans with its measured size, and broadcasts it while small."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_docs(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")))


def word_documents(spark: SparkSession, sf_dir: str, warm: int = WARM, ids: bool = False) -> DataFrame:
    """(doc_id, lang, source, [blocks,] lens, roles): documents as blocks of words, with the ids of the words or their number alone."""
    out = streams.word_lists(documents(spark, sf_dir), "doc_id", "lang", "source", ids=ids)
    return layout.assign_roles(out, warm)


def token_positions(spark: SparkSession, sf_dir: str, cap: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    return layout.positions(word_documents(spark, sf_dir, ids=True), "doc_id", cap=cap, more=more)


def tid(word: str) -> str:
    """SQL for a token's id."""
    return f"cast(('0x' || substr(md5({word}), 1, 7)) as integer)"


DOCS = r"""docs as (select doc_id, lang, source, n_chars, regexp_replace(text, '^[\n\r]+', '') as text from documents where regexp_matches(text, '\S'))"""
BLOCKS = DOCS + """,
 lines as (select doc_id, lang, source, unnest(l) as line, generate_subscripts(l, 1) - 1 as b, len(l) as nb from (select *, string_split(text, chr(10)) as l from docs)),
 blk as (select *, string_split(line, ' ') as words, len(string_split(line, ' ')) as len from lines)"""


def roles(warm: int = WARM, blocks: str = BLOCKS, carried: str = "") -> str:
    return blocks + f""",
 cum as (select *, sum(len) over (partition by doc_id order by b) - len as before from blk),
 doc as (select doc_id, any_value(lang) as lang, any_value(source) as source, cast(max(nb) as integer) as n_blocks, max(nb) >= 2 as has_tail, cast(sum(len) as integer) as content,
   cast(count(*) filter (where (nb = 1 or b < nb - 1) and before <= {warm}) as integer) as n_warm,
   cast(max(nb) - count(*) filter (where (nb = 1 or b < nb - 1) and before <= {warm}) - cast(max(nb) >= 2 as integer) as integer) as n_middle from cum group by doc_id),
 thr as (select c.doc_id, d.lang, d.n_blocks, d.has_tail, d.n_warm, d.n_middle, cast(c.b as integer) as thread, c.words, c.len{carried}, d.has_tail and c.b = d.n_blocks - 1 as is_tail from cum c join doc d using (doc_id))"""


def capped(cap: int) -> str:
    """CTE ``sched`` (doc_id, t, s): the start of each middle thread and of the tail candidate, one thread after the other.

    Needs ``with recursive``. ``f`` has the ``cap`` latest finishes so far, the latest first.
    """
    return f""",
 midl as (select d.doc_id, any_value(d.n_middle) as n_middle, coalesce(list(t.len order by t.thread) filter (where t.thread >= d.n_warm and not t.is_tail), []) as lens from doc d join thr t using (doc_id) group by d.doc_id),
 sched as (select doc_id, n_middle, lens, 0 as t, 0 as s, [coalesce(lens[1], 0)] as f from midl
   union all select doc_id, n_middle, lens, t + 1, nxt, list_sort(list_append(f, nxt + cast(coalesce(lens[t + 2], 0) as integer)), 'DESC')[1:{cap}]
   from (select *, greatest(s + 1, coalesce(f[{cap}] + 1, 0)) as nxt from sched where t < n_middle))"""


def positions_sql(warm: int = WARM, cap: int | None = None, blocks: str = BLOCKS, ids: tuple[int, int, int, int] = (1, 2, 3, 5), token: str | None = None, carried: str = "", shown: str = "") -> str:
    """CTE ``pos``: the token grain, with the ids of bos, sot, eot, sot_tail and stride 256.

    ``blocks`` defines ``blk`` (doc_id, lang, source, b, nb, words, len); ``token`` is the id of word ``k`` of ``words``, by
    default that of the word as a string with the newline of its block. Columns of ``blk`` that are ``carried`` along can be
    ``shown`` by expressions over ``k``, which is null at anchors.
    """
    bos, sot, eot, sot_tail = ids
    token = token or tid("words[k] || case when k = len and thread < n_blocks - 1 then chr(10) else '' end")
    begin = "thread - n_warm" if cap is None else "(select any_value(s) from sched where sched.doc_id = p1.doc_id and t = p1.thread - p1.n_warm)"
    return roles(warm, blocks, carried) + (capped(cap) if cap else "") + f""",
 p0 as (select *, case when j > cast(is_tail as integer) then j - cast(is_tail as integer) end as k from (select *, unnest(range(0, len + 1 + cast(is_tail as integer))) as j from thr)),
 p1 as (select doc_id, n_blocks, has_tail, n_warm, n_middle, thread, is_tail, cast(j as integer) as local_step,
   case when j = 0 then (case when thread = 0 then {bos} else {sot} end) when is_tail and j = 1 then {sot_tail} else {token} end as token{shown},
   case when thread < n_warm then 0 when is_tail and j > 0 then 2 else 1 end as phase from p0),
 p2 as (select *, cast(case phase when 0 then thread when 2 then local_step else {begin} + local_step end as integer) as step,
   case when thread < n_warm then thread when is_tail and n_middle > 0 then n_warm + 1 else n_warm end as stage, thread * 256 + local_step as rope,
   coalesce(lead(token) over (partition by doc_id, thread order by local_step), case when thread = n_blocks - 1 then {bos} else {eot} end) as target,
   lead(local_step) over (partition by doc_id, thread order by local_step) as next_step from p1),
 pos as (select *, cast(row_number() over (partition by doc_id order by phase, step, case phase when 0 then local_step else thread end) - 1 as integer) as row_pos from p2)"""


def packer_sql(capacity: int, buffer: int, crop: bool = False) -> str:
    """CTE ``packed`` (shard, row, id, off, used, lost): best fit of ``item`` (shard, ord, id, n), one pick after the other.

    Needs ``with recursive``. The buffer is the first ``buffer`` items of a shard that have no place yet. Where none of them
    fits the row ends, or with ``crop`` the shortest one is cropped to fill it.
    """
    shortest = f"list_sort([struct_pack(n := -x.n, o := -x.ord, id := x.id) for x in rem[1:{buffer}]], 'DESC')[1]"
    pick = f"case when f is null then struct_pack(n := -s.n, o := s.o, id := s.id) else f end from (select *, {shortest} as s from fit)" if crop else "f from fit"
    return f""",
 pk as (select shard, list(struct_pack(n := n, ord := ord, id := id) order by ord) as rem, 0 as row, {capacity} as room, cast(null as bigint) as id, 0 as was, 0 as off, 0 as used, 0 as lost from item where n > 0 {"" if crop else f"and n <= {capacity}"} group by shard
   union all select * from (with fit as (select *, list_sort([struct_pack(n := x.n, o := -x.ord, id := x.id) for x in rem[1:{buffer}] if x.n <= room], 'DESC')[1] as f from pk where len(rem) > 0),
     best as (select shard, rem, row, room, {pick.replace("from", "as b from", 1)})
     select shard, case when b is null then rem else list_filter(rem, lambda x: x.ord <> -b.o) end, case when b is null or least(b.n, room) = room then row + 1 else row end,
     case when b is null or least(b.n, room) = room then {capacity} else room - b.n end, case when b is null then null else b.id end, row, {capacity} - room, least(b.n, room), b.n - least(b.n, room) from best)),
 packed as (select shard, dense_rank() over (partition by shard order by was) - 1 as row, id, off, used, lost from pk where id is not null)"""
