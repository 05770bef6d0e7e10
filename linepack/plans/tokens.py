"""Queries of tokenizer statistics and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_blocks
from ..operators import chat as H
from ..operators import layout as L
from ..operators import merges as M
from ..operators import packing as E
from ..operators import tokens as C
from ..operators.ranks import rank_rows
from ..schemas import SPECIALS
from ..sources.shared import shared_path
from ._base import BLOCKS, WARM, documents, packer_sql, positions_sql, spread, table, word_documents
from .chat import CHAT_BLOCKS, CHAT_IDS, chat_documents

#: Merges that the queries learn; ``merges.train_bpe`` takes any number.
MERGES = 1024
#: Keys a packing shard spans: a hot source is many shards.
SPAN = 1 << 14


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_counts(documents(spark, sf_dir), F.flatten(word_blocks(F.col("text"))))


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the corpus as tokens, by count."""
    ranked = rank_rows(_words(spark, sf_dir), F.desc("n"), "word")
    return C.build_vocab(ranked.select("rank", F.col("word").alias("token")), SPECIALS[:8])


#: Merges learned in this session, by application and tables: a few thousand triples each.
_LEARNED: dict[tuple[str, str], list[M.Merge]] = {}


def _merges(spark: SparkSession, sf_dir: str) -> list[M.Merge]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEARNED:
        _LEARNED[key] = M.train_bpe(C.word_counts(documents(spark, sf_dir), C.pretokenize(F.col("text"))), MERGES, protect_newlines=True)
    return _LEARNED[key]


def c01_pretokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = documents(spark, sf_dir).select("doc_id", "text", C.pretokenize(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("words"), (F.array_join("w", "") == F.col("text")).alias("lossless"))


def c02_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


def c03_train_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_merges(spark, sf_dir), "left_id int, right_id int, new_id int")


def c04_build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)


def c05_extend_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extend_vocab(_vocab(spark, sf_dir), SPECIALS)


def c06_token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_bytes(_vocab(spark, sf_dir))


def c07_token_bytes_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_bytes_stats(C.token_bytes(_vocab(spark, sf_dir)))


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[list[M.Merge], DataFrame]:
    """The documents in ids of the learned vocabulary behind its bos."""
    m = _merges(spark, sf_dir)
    return m, C.encode(documents(spark, sf_dir), C.pretokenize(F.col("text")), m, first=256 + len(m))


def c08_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir)[1].select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary")).alias("digest"))


def c09_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts that come back."""
    m, ids = _encoded(spark, sf_dir)
    return C.decode(ids, m).select("doc_id", F.md5(F.col("decoded").cast("binary")).alias("digest"), F.octet_length("decoded").alias("n_bytes"))


def _token_blocks(spark: SparkSession, sf_dir: str) -> tuple[list[M.Merge], DataFrame]:
    """Documents in learned ids, cut into blocks by the vocabulary's newline classes; the merges come from a stored table."""
    path = shared_path(spark, "merges")
    M.write_merges(spark, _merges(spark, sf_dir), path)
    m = M.read_merges(spark, path)
    ids = C.encode(documents(spark, sf_dir), C.pretokenize(F.col("text")), m)
    return m, L.token_blocks(ids, M.token_classes(m))


def c08_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block of learned tokens, decoded: the text's own blocks, as no token breaks a line."""
    m, docs = _token_blocks(spark, sf_dir)
    each = docs.select("doc_id", F.posexplode("blocks").alias("block", "ids"))
    return C.decode(each, m).select("doc_id", "block", F.md5(F.col("decoded").cast("binary")).alias("digest"))


def d14_token_yield_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield a decode step of documents in learned tokens."""
    _, docs = _token_blocks(spark, sf_dir)
    return L.token_yield(L.yield_summary(L.assign_roles(docs, WARM)))


def c10_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversed documents in the vocabulary of bytes, bos first."""
    ids = C.encode(documents(spark, sf_dir), F.array("text"), [], first=256, backwards=True)
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 3, "0")), " ").cast("binary")).alias("digest"))


def _n_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("n", F.size(F.flatten(word_blocks(F.col("text")))))


def c11_compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compression_report(_n_words(spark, sf_dir), "lang", F.col("text"), F.col("n"))


def c12_compare_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _n_words(spark, sf_dir)
    chars = C.compression_report(docs, "source", F.col("text"), F.floor(F.length("text") / 6))
    return C.compare_tokenizers(chars, C.compression_report(docs, "source", F.col("text"), F.col("n")), "source")


def c13_newline_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).groupBy(C.newline_class(F.col("word")).alias("nl_class")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n"))


def c14_check_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a vocabulary of words and ASCII characters that passes the check."""
    letters = spark.range(1, 128).select(F.char(F.col("id")).alias("token"))
    vocab = _words(spark, sf_dir).select(F.col("word").alias("token")).unionByName(letters).distinct().withColumn("is_special", F.lit(False))
    C.check_vocab(vocab)
    return vocab.groupBy(C.newline_class(F.col("token")).alias("nl_class")).agg(F.count("*").alias("tokens"), F.sum(F.octet_length("token")).alias("bytes"))


def c14_learned_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned vocabulary, which passes the check as merges that break lines are refused."""
    vocab = C.merged_vocab(spark, _merges(spark, sf_dir), SPECIALS)
    C.check_vocab(vocab)
    return vocab.select("id", F.hex("token").alias("token"), "is_special", C.newline_class(F.decode("token", "ISO-8859-1")).alias("nl_class"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n_words(spark, sf_dir).select("doc_id", "source", (F.col("n") + 1).alias("length"))


def _shard(df: DataFrame) -> DataFrame:
    """Add the packing shard: a source's documents in ranges of ``SPAN`` ids."""
    return df.withColumn("shard", F.concat_ws("/", "source", F.floor(F.col("doc_id") / SPAN).cast("string")))


def e01_pack_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pack_crop(_shard(_lengths(spark, sf_dir)), 512, "shard")


#: Positions of a packed row, of documents and of conversations.
ROW, CHAT_ROW = 512, 1024


def _packed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as blocks of token ids, and their places in rows by the lengths of their layouts."""
    lengths = _shard(L.fits(word_documents(spark, sf_dir), ROW).select("doc_id", "source", L.row_length().alias("length")))
    return word_documents(spark, sf_dir, ids=True), E.pack_whole(lengths, ROW, "shard")


def _text(*names: str):
    return [F.array_join(F.col(n).cast("array<string>"), " ").alias(n) for n in names]


def e02_pack_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, packed = _packed_documents(spark, sf_dir)
    rows = E.assemble_rows(packed, L.rows(L.fits(docs, ROW), "doc_id"), ROW, "shard", "doc_id", {"token": 0, "target": -1, "rope": 0})
    return rows.select("shard", "row", "docs", "used", *_text("token", "target", "rope"))


def e03_rebase_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position offsets of the documents of packed rows: a document's last position is its last thread's deepest one."""
    _, packed = _packed_documents(spark, sf_dir)
    docs = word_documents(spark, sf_dir)
    furthest = F.array_max(F.transform("lens", lambda n, t: t * 256 + n + F.when((t == F.col("n_blocks") - 1) & F.col("has_tail"), 1).otherwise(0)))
    placed = packed.join(docs.select("doc_id", furthest.alias("furthest")), "doc_id")
    return E.rebase_offsets(placed, ["shard", "row"], "offset", F.col("furthest"), 256).select("shard", "row", "doc_id", "rope_offset")


def e04_shift_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in rows of 32 inputs; the last one is filled up."""
    w = documents(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w"))
    w = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - 1) / 32).cast("int") - 1))).alias("row"))
    part = F.slice("w", F.col("row") * 32 + 1, F.lit(33))
    w = w.select("doc_id", "row", F.concat(part, F.array_repeat(F.lit("<pad>"), 33 - F.size(part))).alias("w"))
    a, b = E.shift_io(F.col("w"), 32)
    return w.select("doc_id", "row", F.array_join(a, " ").alias("inputs"), F.array_join(b, " ").alias("targets"))


def e05_drop_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drop_overflow(_lengths(spark, sf_dir), "doc_id", "length", 2000, 8)


def e06_pack_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn documents with masked targets; pads are bos, and positions count on through them."""
    docs = chat_documents(spark, sf_dir)
    lengths = L.fits(docs, CHAT_ROW).select("doc_id", F.floor(F.col("conv_id") / SPAN).alias("shard"), L.row_length().alias("length"))
    packed = E.pack_whole(lengths, CHAT_ROW, "shard", buffer=200)
    rows = H.masked_rows(L.rows(L.fits(docs, CHAT_ROW), "doc_id", ids=CHAT_IDS, payloads=("mask",)))
    made = E.assemble_rows(packed, rows, CHAT_ROW, "shard", "doc_id", {"token": CHAT_IDS.bos, "target": -1, "rope": 0}, count_on=True)
    return made.select("shard", "row", "docs", "used", *_text("token", "target", "rope"))


def e07_packing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shard(_lengths(spark, sf_dir))
    return E.packing_stats(E.pack_crop(docs, 512, "shard"), docs, 513, "doc_id", "length", "shard")


def e08_pack_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice labels in packed rows, each at the position that predicts."""
    docs, packed = _packed_documents(spark, sf_dir)
    rows = E.assemble_rows(packed, L.rows(L.fits(docs, ROW), "doc_id", more=L.LABELS, only=("token", *L.LABELS)), ROW, "shard", "doc_id", {"token": 0, **{n: -1 for n in L.LABELS}})
    return rows.select("shard", "row", *_text("token", *L.LABELS))


QUERIES = {f.__name__: f for f in (
    c01_pretokenize, c02_word_counts, c03_train_bpe, c04_build_vocab, c05_extend_vocab, c06_token_bytes, c07_token_bytes_stats, c08_encode, c08_token_blocks, d14_token_yield_learned, c09_decode, c10_reverse, c11_compression_report, c12_compare_tokenizers,
    c13_newline_class, c14_check_vocab, c14_learned_vocab, e01_pack_crop, e02_pack_whole, e03_rebase_offsets, e04_shift_io, e05_drop_overflow, e06_pack_chat, e07_packing_stats, e08_pack_with_labels)}

_W = "with " + BLOCKS + """,
 w as (select doc_id, lang, source, words[i] || case when i = len and b < nb - 1 then chr(10) else '' end as word from (select *, unnest(range(1, len + 1)) as i from blk)),
 wc as (select word, count(*) as n from w group by word)"""


def _vocab_sql(specials: list[str]) -> str:
    named = " union all ".join(f"select {k} as k, '{s}' as token" for k, s in enumerate(specials))
    return _W + f""", kept as (select word as token, cast(row_number() over (order by n desc, word) - 1 as integer) as id from wc), sp as ({named}),
 vocab as (select id, token, false as is_special from kept union all select cast((select count(*) from kept) + k as integer), token, true from sp)"""


_V = _vocab_sql(SPECIALS[:8])
_LEN = _W + ", d as (select doc_id, any_value(source) as source, cast(count(*) + 1 as integer) as length from w group by doc_id)"
_CROPPED = "with recursive " + BLOCKS + f""",
 item as (select any_value(source) || '/' || cast(doc_id // {SPAN} as varchar) as shard, doc_id as ord, doc_id as id, cast(sum(len) + 1 as integer) as n from blk group by doc_id)""" + packer_sql(513, 1000, True)
_PLACED = """,
 placed as (select p.shard, cast(p.row as integer) as row, p.id as doc_id, p.off, cast(sum(f.step) over (partition by p.shard, p.row order by p.off) - f.step as bigint) as rope_offset, f.step as width
   from packed p join (select doc_id, (max(rope) // 256 + 1) * 256 as step from pos group by doc_id) f on f.doc_id = p.id)"""
_ITEM = ", item as (select {shard} as shard, d.doc_id as ord, d.doc_id as id, cast(content + n_blocks + cast(has_tail as integer) as integer) as n from doc d)"
_ROWS = "with recursive " + positions_sql() + _ITEM.format(shard="(select any_value(source) from docs where docs.doc_id = d.doc_id) || '/' || cast(d.doc_id // %d as varchar)" % SPAN) + packer_sql(ROW, 1000) + _PLACED
_MADE = """,
 made as (select shard, row, cast(count(*) filter (where row_pos = 0) as integer) as docs, cast(count(*) as integer) as used, list(token order by off + row_pos) as token, list(target order by off + row_pos) as target,
   list(cast(rope + rope_offset as integer) order by off + row_pos) as rope, max(rope_offset + width) as ends from placed join pos using (doc_id) group by shard, row)"""
_CHAT_ROWS = ("with recursive " + positions_sql(blocks=CHAT_BLOCKS, ids=(CHAT_IDS.bos, CHAT_IDS.sot, CHAT_IDS.eot, CHAT_IDS.sot_tail), token="words[k]", carried=", c.masks", shown=", masks[k] as mask").replace("pos as (", "pos0 as (")
    + ", pos as (select * replace (case when local_step >= 1 and coalesce(mask, 0) = 0 then -1 else target end as target) from pos0)"
    + _ITEM.format(shard="(d.doc_id >> 20) // %d" % SPAN) + packer_sql(CHAT_ROW, 200) + _PLACED)


def _grid(name: str, fill: int, length: int = ROW) -> str:
    return f"array_to_string(list_resize({name}, {length}, {fill}), ' ') as {name}"


ORACLE_SQL = {
    "c02_word_counts": _W + " select word, n from wc",
    "c04_build_vocab": _V + " select * from vocab",
    "c05_extend_vocab": _vocab_sql(SPECIALS) + " select * from vocab",
    "c06_token_bytes": _V + " select id, cast(case when is_special then 0 else strlen(token) end as integer) as n_bytes from vocab",
    "c07_token_bytes_stats": _V + " select cast(min(strlen(token)) as integer) as min, cast(max(strlen(token)) as integer) as max, avg(strlen(token)) as mean, stddev_samp(strlen(token)) as std from vocab where not is_special and strlen(token) > 0",
    "c08_token_blocks": "with " + BLOCKS + " select doc_id, cast(b as integer) as block, md5(line || case when b < nb - 1 then chr(10) else '' end) as digest from blk",
    "c09_decode": "with " + BLOCKS + " select doc_id, md5(text) as digest, cast(strlen(text) as integer) as n_bytes from docs",
    "c10_reverse": "with " + BLOCKS + """, b as (select doc_id, hex(encode(text)) as h from docs) select doc_id, cast(len(h) // 2 + 1 as integer) as n,
        md5('100 ' || array_to_string(['0' || x for x in list_reverse(regexp_extract_all(h, '..'))], ' ')) as digest from b""",
    "c11_compression_report": _W + ", t as (select lang, count(*) as tokens from w group by lang), b as (select lang, cast(sum(strlen(text)) as bigint) as bytes from docs group by lang) select lang, bytes, tokens, bytes / tokens as bytes_per_token from t join b using (lang)",
    "c12_compare_tokenizers": _W + """, t as (select source, count(*) as o from w group by source), b as (select source, cast(sum(length(text) // 6) as bigint) as c from docs group by source)
        select source, c as base_tokens, o as our_tokens, (c - o) * 100.0::double / c as relative, case when c > o then 'ours' when c < o then 'base' else 'tie' end as winner from t join b using (source)""",
    "c13_newline_class": _W + " select case when not contains(word, chr(10)) then 'NO' when word = chr(10) then 'PURE' else 'TRAIL' end as nl_class, count(*) as tokens, cast(sum(n) as bigint) as n from wc group by 1",
    "c14_check_vocab": _W + ", v as (select word from wc union select chr(cast(i as integer)) from range(1, 128) t(i)) select case when not regexp_matches(word, '[\\n\\r]') then 'NO' when regexp_full_match(word, '[\\n\\r]+') then 'PURE' else 'TRAIL' end as nl_class, count(*) as tokens, cast(sum(strlen(word)) as bigint) as bytes from v group by 1",
    "e01_pack_crop": _CROPPED + " select shard, cast(row as integer) as row, cast(row_number() over (partition by shard, row order by off) - 1 as integer) as part, id as doc_id, cast(off as integer) as \"offset\", cast(used as integer) as used, cast(lost as integer) as lost from packed",
    "e07_packing_stats": _CROPPED + """, r as (select shard, row, sum(used) as kept, sum(lost) as cropped from packed group by all)
        select shard, count(*) as rows, cast(sum(kept) as bigint) as kept, cast(sum(cropped) as bigint) as cropped, cast(sum(513 - kept) as bigint) as padded, sum(kept) / (count(*) * 513) as utilization, cast(0 as bigint) as dropped from r group by shard""",
    "e02_pack_whole": _ROWS + _MADE + f" select shard, row, docs, used, {_grid('token', 0)}, {_grid('target', -1)}, {_grid('rope', 0)} from made",
    "e03_rebase_offsets": _ROWS + " select shard, row, doc_id, rope_offset from placed",
    "e06_pack_chat": _CHAT_ROWS + _MADE + f", more as (select *, list_concat(rope, [cast(m.ends + k as integer) for k in range(0, {CHAT_ROW} - used)]) as whole from made m) select shard, row, docs, used, {_grid('token', 0, CHAT_ROW)}, {_grid('target', -1, CHAT_ROW)}, array_to_string(whole, ' ') as rope from more",
    "e08_pack_with_labels": _ROWS + f""", l as (select * from (select *, case when thread < n_warm then 0 when thread < n_warm + n_middle then 1 else 2 end as line_role, cast(target in (1, 2, 3, 5) as integer) as is_anchor_target from pos)),
        m as (select *, case when next_step is null then -1 when next_step = 1 then 0 when next_step = 2 then 1 when next_step <= 4 then 2 when next_step <= 8 then 3 when next_step <= 16 then 4 else 5 end as depth_in_line,
          coalesce(cast(is_anchor_target = 0 and next_step = case when line_role = 2 then 2 else 1 end as integer), 0) as line_start,
          case when line_role = 1 then count(*) filter (where line_role = 1) over (partition by doc_id, phase, step) else 1 end as wave_width from l),
        labelled as (select shard, row, {", ".join(f"list({n} order by off + row_pos) as {n}" for n in ("token", *L.LABELS))} from placed join m using (doc_id) group by shard, row)
        select shard, row, {_grid('token', 0)}, {", ".join(_grid(n, -1) for n in L.LABELS)} from labelled""",
    "e04_shift_io": "with " + BLOCKS + """, w0 as (select doc_id, string_split(text, ' ') as w from docs), w1 as (select *, cast(unnest(range(0, greatest(1, cast(ceil((len(w) - 1) / 32) as bigint)))) as integer) as row from w0),
        w as (select doc_id, row, list_resize(w[row * 32 + 1 : row * 32 + 33], 33, '<pad>') as w from w1) select doc_id, row, array_to_string(w[1:32], ' ') as inputs, array_to_string(w[2:33], ' ') as targets from w""",
    "e05_drop_overflow": _LEN + " select doc_id, source, length, doc_id // 8 as batch from d where doc_id // 8 not in (select doc_id // 8 from d group by 1 having max(length) >= 2000)",
}
