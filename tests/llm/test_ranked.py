"""Ranked search against plain scores of every document."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from labelloom.llm import ranked

SCHEMA = "doc_id bigint, text string, item_id int, n string, slices int, score long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, depth):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    df = Counter(t for _, c in counts for t in c)
    total, n_docs = sum(sum(c.values()) for _, c in counts), sum(1 for _, c in counts if c)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for doc, c in counts:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:depth], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(11)
    words = [f"w{k}" for k in range(300)] + ["Über", "été", "naïve", "x9"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(pick.choices(words, weights, k=pick.choice([1, 5, 40, 200, 2000]))) for _ in range(300)]
    copies = [(1000 + k, texts[0]) for k in range(90)]
    odd = [(2000, None), (2001, ""), (2002, "..."), (None, texts[1]), (2003, "W1,w1;W2-w2"), (2003, "W1,w1;W2-w2"), (2004, "w5 " * 30_000)]
    return list(enumerate(texts)) + copies + odd


@pytest.fixture(scope="module")
def items(rows):
    return [(1, rows[0][1]), (2, "W1 w2, w250 Über"), (3, None), (4, "nowhere"), (5, rows[7][1]), (5, "w3 w299"), (None, "w1"), (6, "été naïve x9")]


def found(frame):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("depth,block", [(10, 100_000), (3, 40), (500, 100_000)])
def test_like_plain_scores(spark, rows, items, depth, block, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    docs = spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA).repartition(5)
    wanted = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, doc_id int")
    assert found(ranked.search(docs, wanted, depth)) == plain(rows, items, depth)


def test_bounds_are_never_below_scores(rows):
    """Also where the filters are far too full."""
    import numpy as np
    import pyarrow as pa
    texts = [t or "" for _, t in rows]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    words = [f"w{k}" for k in range(0, 300, 7)] + ["über"]
    queries = ranked.Queries.of(pa.table({"term": words * 2, "item_id": [1] * len(words) + [2] * len(words)}))
    counts = [Counter(terms(t)) for t in texts]
    df = np.array([sum(t in c for c in counts) for t in queries.terms.to_pylist()])
    scoring = ranked.Scoring.of(len(texts), sum(sum(c.values()) for c in counts), df)
    for bits in (1, 12):
        ranked.BITS_EACH, kept = bits, ranked.BITS_EACH
        try:
            blocks = list(ranked._index(iter([batch])))
        finally:
            ranked.BITS_EACH = kept
        seen = 0
        for b in blocks:
            width, ids, n = b.column("width")[0].as_py(), b.column("docs")[0].as_py(), np.array(b.column("n")[0].as_py())
            data = np.frombuffer(b.column("slices")[0].as_py(), np.uint8).reshape(width, -1)
            found = ranked.bounds(queries, scoring, ranked.hash_strings(queries.terms), width, n, data)
            m = scoring.lengths(n)
            for k, doc in enumerate(ids):
                tf = np.array([counts[doc][t] for t in queries.terms.to_pylist()])
                exact = scoring.parts(np.arange(len(tf)), tf, np.full(len(tf), m[k])).sum()
                assert (found[:, k] >= exact).all()
                seen += 1
        assert seen == sum(bool(c) for c in counts)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranked.search(none, items).collect() == []
    assert ranked.search(docs, items.where("item_id > 1")).collect() == []
    text_ids = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert [(r.doc_id, r["rank"]) for r in ranked.search(text_ids, items).collect()] == [("1", 1)]
