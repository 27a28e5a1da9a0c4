"""Phrase mining against plain counts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from labelloom.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, words string, a int"


def plain(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        found = {p: n for p, n in own.items() if n >= least}
        kept = []
        for p, a in found.items():
            if len(p) == 1:
                continue
            score, k = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * found[q] >= 80 * a for q in found if len(q) > len(p) and any(
                q[j:j + len(p)] == p for j in range(len(q) - len(p) + 1)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, totals[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    words = "The of a, new York city is. big; ünd très über\tthe THE machine learning model\nin b!c d?e x:y".split(" ")
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(80))) for _ in range(150)]
    fixed = "state of the art method"
    out = [(k, t + (" " + fixed if k % 3 else ""), ("en", "de", None)[k % 3]) for k, t in enumerate(texts)]
    return out + [(900, None, "en"), (901, "", None), (902, " \t.;\n", "fr"), (903, "same " * 3000, "en"), (903, "same " * 40, "en"), (None, fixed, "en")]


def collected(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("one_in", [1, 3, 10_000])
def test_like_plain_counts(spark, rows, one_in):
    """Whatever the sample proposes, nothing or all, the result is that of counting everything."""
    docs = spark.createDataFrame([(*r, "p", 1, "w", 2) for r in rows], SCHEMA).repartition(3)
    assert collected(collocations.collocations(docs, least=6, top=25, one_in=one_in)) == plain(rows, 6, 25)


def test_a_full_filter_counts_more_and_finds_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    docs = spark.createDataFrame([(*r, "p", 1, "w", 2) for r in rows], SCHEMA)
    assert collected(collocations.collocations(docs, least=6, top=25)) == plain(rows, 6, 25)


def test_scores_past_64_bits(spark):
    """The product of a count with 2,000,000 may pass 64 bits; decimals hold it."""
    score = spark.sql("SELECT (cast(9000000000000000000 as decimal(20,0)) * 2000000) div (cast(9100000000000000000 as decimal(20,0)) + 9200000000000000000) AS s")
    assert score.first().s == 2_000_000 * 9_000_000_000_000_000_000 // 18_300_000_000_000_000_000


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
