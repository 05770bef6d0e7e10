"""Turn documents of the conversations table, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_id
from ..operators import chat, layout
from ..schemas import SPECIALS
from ._base import WARM, spread, table, tid

#: Ids of the special tokens by name, and those that the layout needs.
MARKS = {name.strip("<|>"): i for i, name in enumerate(SPECIALS)}
CHAT_IDS = layout.Ids(bos=MARKS["bos"], sot=MARKS["sot"], eot=MARKS["eot"], sot_tail=MARKS["sot_tail"])
#: The newline token's id, as any word's.
NEWLINE = int(hashlib.md5(b"\n").hexdigest()[:7], 16)


def words(c: Column) -> Column:
    return F.split(c, " ")


def word_ids(c: Column) -> Column:
    return F.transform(words(c), token_id)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, conv_id, pair, prompt, reply, blocks, mask, lens, roles): a turn document for each prompt with its reply."""
    pairs = chat.turn_pairs(chat.merge_system(turns(spark, sf_dir)))
    pairs = pairs.withColumn("doc_id", (F.col("conv_id") * (1 << 20) + F.col("pair")).cast("bigint"))
    return layout.assign_roles(chat.turn_documents(pairs, word_ids, MARKS, NEWLINE), WARM)


#: CTE ``t``: turns with a leading system turn merged into the user turn after it; ``p``: prompts with their replies.
SYSTEM = """s as (select *, lag(role) over w as pr, lag(text) over w as pt, lead(role) over w as nr, row_number() over w as rn from conversations window w as (partition by conv_id order by turn)),
 t as (select conv_id, turn, role, case when rn = 2 and pr = 'system' and role = 'user' then pt || chr(10) || chr(10) || text else text end as text from s where not coalesce(rn = 1 and role = 'system' and nr = 'user', false))"""
PAIRS = SYSTEM + """,
 ahead as (select conv_id, turn, role, text as prompt, lead(role) over w as nr, lead(text) over w as reply from t window w as (partition by conv_id order by turn)),
 p as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as pair, prompt, reply from ahead where role = 'user' and nr = 'assistant')"""
_IDS = f"[{tid('w')} for w in string_split(%s, ' ')]"
_M = "list_resize(cast([] as integer[]), len(string_split(%s, ' ')), %d)"
CHAT_BLOCKS = PAIRS + f""",
 bl as (select conv_id * 1048576 + pair as doc_id, 0 as b, list_concat([{MARKS["user_start"]}], {_IDS % "coalesce(prompt, '')"}, [{MARKS["user_end"]}]) as words, list_resize([0], len(string_split(coalesce(prompt, ''), ' ')) + 2, 0) as masks from p
   union all select conv_id * 1048576 + pair, i, list_concat(case when i = 1 then [{MARKS["assistant_start"]}] else [] end, {_IDS % "line"}, case when i < n then [{NEWLINE}] else [{MARKS["assistant_end"]}, {NEWLINE}] end),
     list_concat(case when i = 1 then [0] else [] end, {_M % ("line", 1)}, case when i < n then [1] else [1, 0] end)
   from (select *, unnest(string_split(coalesce(reply, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(reply, ''), chr(10)), 1) as i, len(string_split(coalesce(reply, ''), chr(10))) as n from p)),
 blk as (select doc_id, '' as lang, '' as source, b, max(b) over (partition by doc_id) + 1 as nb, words, masks, len(words) as len from bl)"""
