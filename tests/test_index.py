import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from labelloom.operators.index import dense_index, earlier_max


def brute_index(data, group, order):
    out, seen = {}, {}
    for r in sorted(data, key=lambda r: (group(r), order(r))):
        seen[group(r)] = seen.get(group(r), 0) + 1
        out[r] = seen[group(r)]
    return out


@pytest.mark.parametrize("n,hot", [(1, 1.0), (500, 0.0), (700, 0.6)])
def test_dense_index_per_group_matches_brute_force(spark, make, n, hot):
    rng = random.Random(n)
    data = [("hot" if rng.random() < hot else rng.choice("abc"), i * 3 - 100, f"p{i}") for i in range(n)]
    rng.shuffle(data)
    df = make("g string, k bigint, p string", *data).repartition(5)
    got = {tuple(r)[:3]: r.idx for r in dense_index(df, ["k"], ["g"]).collect()}
    assert got == brute_index(data, lambda r: r[0], lambda r: r[1])


def test_dense_index_counts_from_start_without_gaps(spark):
    df = dense_index(spark.range(0, 1000, 1, 7).select((F.col("id") * 17 % 1000).alias("k")), ["k"], start=5, name="n")
    assert rows(df) == [(k, k + 5) for k in range(1000)]


def test_dense_index_orders_by_several_columns_and_keeps_null_groups(make):
    df = make("g string, a int, b int", (None, 1, 2), (None, 1, 1), ("x", 0, 9), (None, 0, 7))
    assert rows(dense_index(df, ["a", "b"], ["g"]), "a", "b", "idx") == [(0, 7, 1), (0, 9, 1), (1, 1, 2), (1, 2, 3)]


def test_dense_index_of_nothing(make):
    assert rows(dense_index(make("k int"), ["k"])) == []


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_earlier_max_over_chunks(make, chunk):
    rng = random.Random(7)
    data = [(g, i, rng.randrange(100)) for g in "ab" for i in range(25)]
    want, top = {}, {}
    for g, i, v in data:
        want[(g, i)] = top.get(g)
        top[g] = max(v, top.get(g, v))
    got = earlier_max(make("g string, i int, v int", *data), "v", ["i"], ["g"], "m", chunk)
    assert {(r.g, r.i): r.m for r in got.collect()} == want
