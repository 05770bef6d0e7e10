"""Cross-tokenizer alignment against a plain walk over ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from linepack.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n,m", [(0, 0), (0, 5), (5, 0), (1, 1), (1, 1000), (7, 7), (64, 65), (1000, 3), (999, 5000)])
def test_gallop_counts_the_entries_below(n, m):
    rnd = np.random.default_rng(n * 7 + m)
    for spread in (2, 5, 100):
        driver, longer = (np.sort(rnd.choice(max(n, m, 1) * spread, k, replace=False)) if k else np.zeros(0, np.int64) for k in (n, m))
        assert alignment.gallop(driver, longer).tolist() == np.searchsorted(longer, driver).tolist()


def plain(texts):
    """Rows of the contract, one text after the other."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters = {c: b for c, b in alignment._byte_letters().items()}
    counts, rows = Counter(), []
    for text in texts:
        ids_a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = tb.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in ta.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [tb.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append(([], [], []))
            continue
        ends = [np.cumsum([len(x) for x in of]).tolist() for of in (bytes_a, bytes_b)]
        links, groups, pa, pb = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0].index(e) + 1, ends[1].index(e) + 1
            links.append((ids_a[i - 1], ids_b[j - 1]))
            groups.append((ids_a[pa:i], ids_b[pb:j]))
            pa, pb = i, j
        counts.update(links)
        rows.append((ids_a, ids_b, groups) if links else ([], [], []))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for ids_a, ids_b, groups in rows:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if ids_a else ""
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


ODD = [None, "", " ", "a", "▁x", "é é ﬁ", "<|endoftext|> <s> </s> <unk> <0x0A>", "\x00\x01\n\n\t ", "日本語 テキスト 😀🏽" * 20, "z" * 3000, "the same text", "the same text", "  two  blanks "]


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_odd_texts(spark):
    rnd = random.Random(1)
    some = ODD + ["".join(rnd.choice("ab éß\n<>|日😀.,1") for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(None if t == "a" else i // 2, t, 5, "x") for i, t in enumerate(some)], "doc_id long, text string, n_a int, times string")
    got = rows_of(alignment.alignment_report(df.repartition(3), A, B))
    assert got == sorted((t == "a", 0 if t == "a" else i // 2, *x) for i, (t, x) in enumerate(zip(some, plain(some), strict=True)))
    assert alignment.alignment_report(df.limit(0), A, B).count() == 0


def test_fast_encoders_equal_the_libraries():
    """Random strings over all planes, runs of blanks, special strings; 20 000 texts."""
    rnd = random.Random(2)
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    char = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 127), 32, 32, 10, 9, rnd.randrange(0x3000), rnd.randrange(0xE000, 0x110000), 0x2581]))
    for _ in range(20):
        texts = ["".join(char() for _ in range(rnd.randrange(25))) for _ in range(1000)] + ["<s> <|endoftext|>", "a" * 300 + " " * 40 + "b"]
        raw = [x.encode() for x in texts]
        assert alignment.byte_level(A)[0](raw) == [x.ids for x in ta.encode_batch(texts, add_special_tokens=False)]
        assert alignment.pieces(B)[0](raw) == [tb.encode(x) for x in texts]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(queries.op11_cross_tokenizer_alignment(spark, sf))
    assert got == sorted((False, d.doc_id, *x) for d, x in zip(docs, plain([d.text for d in docs]), strict=True))


def test_overlaps_are_the_slices_between_common_ends():
    ends_a, ends_b = np.array([2, 5, 6, 9, 12]), np.array([1, 5, 9, 11, 12])
    n_a, n_b = np.array([3, 2]), np.array([2, 3])  # documents of 6 and 6 bytes; the first ends at no common place but 5
    common = alignment.common_ends(ends_a, n_a, ends_b, n_b)
    assert common.doc.tolist() == [0, 1, 1] and common.a.tolist() == [1, 3, 4] and common.b.tolist() == [1, 2, 4]
    assert alignment.overlaps(common, n_a, n_b).tolist() == [[0, 0, 2, 0, 2], [1, 0, 1, 0, 1], [1, 1, 2, 1, 3]]


def test_linked_pairs_stay_below_their_bound(spark, sf):
    a, b = alignment.byte_level(A)[1], alignment.pieces(B)[1]
    counts = alignment.link_counts(alignment.align(spark.read.parquet(f"{sf}/documents.parquet"), A, B)).collect()
    assert all(a[r.a].endswith(b[r.b]) or b[r.b].endswith(a[r.a]) for r in counts) and len(counts) < alignment.most_links(a, b) < 1_000_000
