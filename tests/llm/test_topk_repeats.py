"""op6 with repeated ids, against its SQL."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from linepack.llm import queries, topk


@pytest.mark.parametrize("copies", [2, 5, 9])
def test_repeated_query_ids(spark, copies):
    rng = np.random.default_rng(copies)
    vectors = [(i, rng.normal(size=32).tolist()) for i in range(1, 50)] + [(51 + i, (rng.normal(size=32) * 0.1).tolist()) for i in range(40)]
    vectors += [(50, (rng.normal(size=32) * 4).tolist())] * copies + [(100, rng.normal(size=32).tolist())] + [(7, rng.normal(size=32).tolist())] * 2
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 50).collect()
    c = duckdb.connect()
    c.execute("create table embeddings (vec_id bigint, embedding double[])")
    c.executemany("insert into embeddings values (?, ?)", [list(v) for v in vectors])
    want = c.sql(queries.ORACLE_SQL["op6_exact_top_k"]).fetchall()
    assert Counter(map(tuple, got)) == Counter(want)


def test_copies_of_the_query_do_not_raise_the_floor():
    rng = np.random.default_rng(1)
    query = rng.integers(-900, 900, 64)
    cols = np.concatenate([np.repeat(query[:, None], 12, 1), rng.integers(-300, 300, (64, 60))], 1)
    ids = np.array([50] * 12 + list(range(1000, 1060)))
    tails = np.sqrt(np.cumsum((cols.astype(float) ** 2)[::-1], axis=0)[::-1][:: topk.DIMS])
    scores, found = topk.search_block(query, 50, ids, cols, tails, 5)
    every = query @ cols[:, 12:]
    order = np.lexsort((ids[12:], -every))[:5]
    assert found.tolist() == ids[12:][order].tolist() and scores.tolist() == every[order].tolist()
