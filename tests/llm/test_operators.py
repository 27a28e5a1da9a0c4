"""Every operator on small tables with the odd cases, against plain versions."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import decontaminate, langid, licenses, lines, near, quality, recompress, sentencepiece, suffix_dedup, toxicity
from labelloom.llm.suffix_sort import Suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, key int, doc int, a string, n int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau ypsilon".split()


def prose(seed, n, vocabulary=None):
    pick = random.Random(seed)
    return " ".join(pick.choice(vocabulary or WORDS) + str(pick.randrange(40)) for _ in range(n))


def odd_rows():
    """Copies, near copies, shared passages, repeated rows and ids, nulls, empty and long texts."""
    passage, long = prose("p", 60), prose("l", 6000)
    base = prose("b", 120)
    edited = base.split()
    edited[60] = "changed"
    one_word = " ".join(["same"] * 130)
    rows = [(1, base), (2, base), (3, " ".join(edited)), (4, prose(4, 30) + " " + passage + " " + prose(44, 30)),
            (5, passage + "\n" + prose(5, 80)), (6, None), (7, ""), (8, "one two"), (9, "one two"), (10, long), (11, long + " end"),
            (12, one_word), (13, one_word + " x"), (14, "é" * 150), (15, "ü" + "é" * 150), (None, base), (None, None), (1, base),
            (16, prose(16, 55)), (16, prose(17, 55)), (-5, passage), (18, "  \n\t "), (19, "===== " * 60), (20, "A b C d E"), (21, "a B c D e")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2, "k", 3, 4, "a", 5) for i, t in odd_rows()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def distinct_ids():
    """Rows by id as the plain versions of the dedup operators see them: ids that repeat are one document."""
    return sorted({(i, t or "") for i, t in odd_rows() if i is not None and i != 16})


def test_byte_repeats_like_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 16]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out if r.doc_id is not None}
    seen, want = set(), set()
    for doc, text in distinct_ids():
        raw, own = text.encode(), []
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(raw[p:p + 100])
        own = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.add((doc, len(raw), sum(gone), spans, hashlib.sha256(own).hexdigest()))
    assert got == want
    assert len(out) == len(rows)
    assert all(r.n_removed == 0 for r in out if r.doc_id is None)


def test_word_repeats_like_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 16]
    out = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out if r.doc_id is not None}
    first, want = {}, set()
    for doc, text in distinct_ids():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(words)
        for p in range(len(words) - 49):
            if first.setdefault(tuple(words[p:p + 50]), doc) != doc:
                gone[p:p + 50] = [True] * 50
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want.add((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == want and len(out) == len(rows)


def test_suffix_sort_orders_buckets():
    pick = np.random.default_rng(3)
    data = pick.integers(0, 2, 600).astype(np.uint8)
    starts = pick.integers(0, 560, 90)
    bucket = np.sort(pick.integers(0, 6, 90)).astype(np.uint64)
    suffixes = Suffixes(data, starts, 40)
    order = suffixes.sort(bucket)
    whole = [data[s:s + 40].tobytes() for s in starts]
    assert order.tolist() == sorted(range(90), key=lambda k: (bucket[k], whole[k], k))
    same = suffixes.equal_to_previous(order, bucket)
    assert same.tolist() == [k > 0 and (bucket[order[k]], whole[order[k]]) == (bucket[order[k - 1]], whole[order[k - 1]]) for k in range(90)]


def plain_components(rows, similar):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        if not words:
            return frozenset()
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in sets:
        for j, t in sets:
            if s and t and 100 * len(s & t) >= similar * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {(i, len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("similar", [80, 85])
def test_near_duplicates_like_brute_force(spark, docs, similar, monkeypatch):
    monkeypatch.setattr(near, "LONG_LIST", 3)  # also split long lists
    group = [(100 + k, prose("g", 40) + f" tail{k} more{k} words{k}") for k in range(12)]
    rows = odd_rows() + group
    out = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similar).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == plain_components(rows, similar)
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").isEmpty()


def test_line_copies(spark, docs):
    shared = "this line is long enough to count as boilerplate text"
    rows = [(1, f"{shared}\nunique a\nshort\nshorter\nlast of these few lines, and a longer one"), (2, f"own start\n{shared}\n\nown end"),
            (3, "x\nshort\nshorter\nlast of these few lines, and a longer one\ny"), (4, shared), (5, "short\nz"), (6, f"{shared}\n{shared}"),
            (7, None), (8, ""), (None, shared), (1, f"{shared}\nunique a\nshort\nshorter\nlast of these few lines, and a longer one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect() if r.doc_id is not None}
    assert got == {1: rows[0][1], 2: "own start\n\nown end", 3: "x\ny", 5: "short\nz", 7: None, 8: ""}
    counts = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs) for r in lines.count_copies(df).collect() if r.doc_id is not None}
    assert counts[2] == (4, 1, 1) and counts[6] == (2, 2, 1) and counts[7] == (0, 0, 0) and counts[8] == (1, 0, 0)
    assert lines.dedup_lines(docs).columns == docs.columns


def test_whole_line_runs_like_brute_force(spark):
    pick = random.Random(11)
    footer = ["ab", "first of a footer", "second of footer", "third of footer"]
    texts = [["top"] + ["fifteen letters", "fifteen LETTERS", "FIFTEEN letters"], ["x y"] + ["fifteen letters", "fifteen LETTERS", "FIFTEEN letters"] + ["end"]]
    for k in range(40):
        own = [pick.choice(["a", "bb", "", "c" * 9, "d" * 14, f"line {pick.randrange(3)}", "e" * 45]) for _ in range(pick.randrange(1, 14))]
        texts.append([f"doc {k}"] + own + (footer if k % 5 == 0 else []) + (["tail"] if k % 2 else []))
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(
        spark, spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), "").collect()}
    first, want = {}, {}
    for k, t in enumerate(texts):
        gone = set()
        for p in range(len(t)):
            for end in range(p + 1, len(t) + 1):
                if sum(len(x) + 1 for x in t[p:end]) >= 40 and first.setdefault(tuple(t[p:end]), (k, p)) != (k, p):
                    gone.update(range(p, end))
        left = "\n".join(x for i, x in enumerate(t) if i not in gone)
        if left.strip() or not gone:
            want[k] = left
    assert got == want and got[1] == "x y\nend"


def test_quality(spark, docs):
    out = {r.doc_id: r for r in quality.measure(docs).collect() if r.doc_id is not None}
    assert out[6].n_words == 0 and out[6].base_failed and not out[6].kept
    assert out[12].base_failed and out[12].n_repeat_words == 130
    assert out[1].kept and out[1].n_repeat_words == 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {1, 2, 3, 10} <= {r.doc_id for r in good.collect()}
    assert good.where("doc_id IN (6, 7, 12, 18)").isEmpty()
    rules = quality.order_rules([quality.Estimate(quality.RULES[0], .1, 1), quality.Estimate(quality.RULES[1], .1, .1),
                                 quality.Estimate(quality.RULES[2], 0, .01)])
    assert [r.name for r in rules] == ["repeated_words", "few_words", "symbols"]


def test_licenses(spark, docs):
    notice = dict((t[0], t[2]) for t in licenses.TEMPLATES)["mit-text"]
    rows = [(1, "x Apache License y\nReleased under the MIT License."), (2, "CC-BY cc by"), (3, notice.title() + " or so"), (4, None), (5, ""),
            (6, "licensed under cc by nc 4.0"), (7, "nothing to see under the license"), (None, "mit license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 7, "apache,mit")
    assert "mit-line" in got[1].labels and got[2].n_base == 2 and got[3].labels == "mit-text" and got[3].n_base == 0
    assert got[4].n_words == 0 and got[4].score == 0.0 and got[7].labels == "" and got[None].base_labels == "mit"
    assert "cc-by-nc-4.0" in got[6].labels and licenses.scan(docs).count() == docs.count()


def test_languages(spark, docs):
    texts = {"en": "the house and the garden of this old man", "fr": "la maison et le jardin de ce vieil homme"}
    rows = [(k, f"{texts[lang]} {k}", lang) for k in range(60) for lang in [("en", "fr")[k % 2]]]
    rows += [(100, None, None), (101, "123 !?", "en"), (102, "jardins maisons", None), (103, "gardens houses", None)]
    got = {r.doc_id: r for r in langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == ("en", "fr")[k % 2] for k in range(60))
    assert got[100].lang_pred == "und" and got[101].lang_pred == "und" and got[101].score == 0.0
    assert got[102].lang_pred == "fr" and got[103].lang_pred == "en" and 0 <= got[103].score <= 1
    assert langid.predict_languages(docs).count() == docs.count()


def test_toxicity(spark, docs, empty):
    rows = [(k, f"some words number {k} " + ("you moron" if k % 3 == 0 else "you friend")) for k in range(300)]
    rows += [(1000, "what a m0r0n"), (1001, "such a m o r o n here"), (1002, "mooooron"), (1003, ""), (1004, None), (1005, "some friend")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.predict_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert all(got[k].predicted == (k % 3 == 0) for k in range(300))
    assert [got[k].predicted for k in (1000, 1001, 1002)] == [1, 1, 1] and got[1005].predicted == 0 and 0 <= got[1004].score <= 1
    assert toxicity.predict_toxicity(docs, labels.where("false")).count() == docs.count()


def plain_viterbi(chunk, scores, floor):
    best = [(0.0, [])]
    for end in range(1, len(chunk) + 1):
        options = []
        for at in range(end):
            part = chunk[at:end]
            if part in scores or len(part) == 1:
                options.append((best[at][0] + scores.get(part, -floor), best[at][1] + [part]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][0]


def test_sentencepiece_bpe_like_the_library(spark, docs):
    library = pytest.importorskip("sentencepiece")
    processor = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rows = odd_rows() + [(30, "a\tb   ﬁ é é ① 梦梦abc"), (31, "a" * 300 + " " * 90), (32, "x ▁ y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = sentencepiece.Model.load()
    for hot in (1_000_000, 20):
        out = sentencepiece.encode(df, model, hot)
        got = sorted((r.doc_id or 0, r.ids) for r in out.collect())
        assert got == sorted((i or 0, processor.encode(t or "")) for i, t in rows)
        assert {r.doc_id for r in out.where("NOT exact").collect()} == {32}
    texts = {(r.doc_id, r.text) for r in sentencepiece.decode(out, model).collect()}
    assert texts == {(i, (t or "").replace("▁", " ")) for i, t in rows}


def test_sentencepiece_chunks_counted_once_reach_their_text_by_its_key(spark):
    library = pytest.importorskip("sentencepiece")
    processor = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rows = [(1, "common word zqxjkv"), (1, "common word wvutqq"), (2, "common vbnmqw word"), (2, "common vbnmqw word"), (None, "qqzzkk"),
            (None, "common"), (3, "word twiceq"), (4, "twiceq common onlyhereq"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = sentencepiece.Model.load()
    once = [r for r in sentencepiece.chunk_counts(df, model).collect() if r.n == 1]
    texts = {r.key: r.text for r in sentencepiece.text_key(df.where("text <> ''")).collect()}
    assert once and all(r.chunk.replace("▁", " ") in " " + texts[r.key] for r in once)
    for hot in (1_000_000, 2):
        out = sentencepiece.encode(df, model, hot)
        got = sorted((r.doc_id or 0, list(r.ids)) for r in out.collect())
        assert got == sorted((i or 0, processor.encode(t or "")) for i, t in rows)
        # Texts are only looked through for chunks that are neither counted once nor in the table.
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("Generate" in plan) == (hot == 2)


def test_sentencepiece_takes_little_memory_for_a_piece_of_texts():
    model = sentencepiece.Model.load()
    pick = random.Random(11)
    known = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(pick.choice(known) for _ in range(1500)) for _ in range(300)]
    size = sum(map(len, texts))
    assert model.joins  # kept with the model

    def peak(run):
        tracemalloc.start()
        try:
            result = run()
            return result, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    chunks, most = peak(lambda: sentencepiece.Chunks.of(texts, model))
    assert most < 18 * size
    _, first = np.unique(chunks.hashes, return_index=True)
    names = [chunks.text(k) for k in first.tolist()]
    table = sentencepiece.Table.of(pa.array(names, pa.string()), np.arange(2 * len(names), dtype=np.int32) % 30_000, np.full(len(names), 2))
    encoder = sentencepiece.Encoder(model, table)
    (ids, starts), most = peak(lambda: encoder.encode(texts))
    assert len(ids) == 2 * len(chunks.hashes) and most < 18 * size
    plain, most = peak(lambda: encoder.decode(ids, starts))
    assert len(plain) == len(texts) and most < 15 * size


def test_sentencepiece_piece_table_needs_no_python_worker(spark):
    chunks = spark.createDataFrame([("▁word", 1, 1)], "chunk string, n bigint, key int").coalesce(1)
    plan = sentencepiece.lattice(chunks, sentencepiece.Model.load())._jdf.queryExecution().optimizedPlan()
    assert "LocalRelation" in plan.toString()


def test_sentencepiece_unigram_is_viterbi(spark):
    pick = random.Random(5)
    scores = {c: -pick.uniform(3, 6) for c in "abc▁"}
    for _ in range(25):
        scores["".join(pick.choice("abc") for _ in range(pick.randint(2, 4)))] = -pick.uniform(2, 9)
    rows = [("<unk>", 0, 0.0, 2)] + [(p, k, s, 1) for k, (p, s) in enumerate(scores.items(), 1)]
    model = sentencepiece.Model.of(sentencepiece.UNIGRAM, rows)
    by_id = {k: p for p, k, _, _ in rows}
    texts = ["".join(pick.choice("abc") for _ in range(n)) for n in (1, 5, 20, 59, 150)] + ["abd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece.encode(df, model).collect():
        total = sum(scores.get(by_id[i], -sentencepiece.unknown_cost(model)) for i in r.ids)
        assert total == pytest.approx(plain_viterbi("▁" + texts[r.doc_id], scores, sentencepiece.unknown_cost(model)))


def test_decontamination(spark, docs, empty):
    item = "which of these seven rivers flows north through the old capital before it reaches the cold sea"
    edited = item.replace("seven", "many").replace("old capital", "former capital")
    rows = [(1, prose(1, 40) + " " + item + " " + prose(2, 40)), (2, prose(3, 40) + "\n" + edited), (3, prose(4, 200)), (4, None), (5, ""), (None, item),
            (6, "these seven rivers"), (7, "Short item!"), (1, prose(1, 40) + " " + item)]
    items = spark.createDataFrame([(10, item), (11, "short item"), (12, None), (13, ""), (None, "x y z")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 11)}
    assert got[1, 10].score == 1.0 and got[1, 10].first_word == 40 and 0.5 <= got[2, 10].score < 1
    left = decontaminate.decontaminate(df, items)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 4, 5, 6]
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert decontaminate.leaks(df, items.where("false")).isEmpty()


def plain_alignment(text, item):
    """Smith-Waterman cell by cell."""
    above, best = [0] * (len(text) + 1), 0
    for word in item:
        row = [0]
        for k, other in enumerate(text, 1):
            row.append(max(0, above[k - 1] + (2 if word == other else -1), above[k] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(item))


def test_edited_copies_like_brute_force(spark):
    pick = random.Random(7)
    items = [(k, prose(f"item{k}", 25)) for k in range(30)]
    rows = []
    for k, text in items:  # one copy each, every fifth word changed on average
        copy = " ".join(f"new{pick.randrange(10 ** 6)}" if pick.random() < 0.2 else w for w in text.split())
        rows.append((k, prose(f"head{k}", 30) + " " + copy + " " + prose(f"tail{k}", 30)))
    want = set()
    for doc, text in rows:
        words = text.split()
        grams = {tuple(words[i:i + 3]) for i in range(len(words) - 2)}
        for k, item in items:
            own = item.split()
            if len(grams & {tuple(own[i:i + 3]) for i in range(len(own) - 2)}) >= 2 and plain_alignment(words, own) >= 0.5:
                want.add((doc, k))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 20


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2, 0.3, 0.35])
def test_seeds_lose_few_copies_that_align(share):
    """Of copies with words changed, left out and put in, nine in ten that align have the seeds for it."""
    pick = random.Random(int(share * 100))
    items = decontaminate.Items.of([(k, prose(f"recall{k}", pick.randrange(15, 40))) for k in range(60)])
    able = found = 0
    for words in items.words:
        edited = []
        for w in words.tolist():
            u = pick.random()
            edited += [0] if u < share / 2 else [] if u < share * 3 / 4 else [w, 0] if u < share else [w]
        text = np.array([0] * 10 + edited + [0] * 10)
        if decontaminate.align(text, words)[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(words):
            keys, own = decontaminate.text_keys(text, items.base, False)[0], np.unique(decontaminate.gram_keys(words, items.base))
            able += 1
            found += len(np.intersect1d(keys, own)) >= min(decontaminate.MIN_SEEDS, len(own))
    assert able > 20 and found >= 0.9 * able


def test_many_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    items = spark.createDataFrame([(k, prose(f"i{k}", 20)) for k in range(9)], "item_id long, text string")
    df = spark.createDataFrame([(k, prose(k, 30) + " " + prose(f"i{k}", 20)) for k in range(9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, items).collect()} == {(k, k) for k in range(9)}


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = sentencepiece.Model.load()
    for out in (suffix_dedup.remove_repeats(empty), recompress.remove_repeats(empty), near.near_duplicates(empty), lines.count_copies(empty),
                lines.dedup_lines(empty), quality.measure(empty), licenses.scan(empty), langid.predict_languages(empty),
                toxicity.predict_toxicity(empty, labels), sentencepiece.encode(empty, model), near.keep_one(empty), quality.keep_good(empty)):
        assert out.count() == 0


def test_odd_rows_everywhere(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    n = docs.count()
    for out in (suffix_dedup.remove_repeats(docs), recompress.remove_repeats(docs), toxicity.predict_toxicity(docs, labels),
                lines.count_copies(docs), quality.measure(docs), near.near_duplicates(docs)):
        assert out.count() == n


def test_columns_named_like_the_operators_own(spark, docs):
    clash = docs.withColumnsRenamed({"kept": "_later", "key": "_leak", "a": "_runs", "n": "_hash"})
    items = spark.createDataFrame([(1, prose("p", 60))], "item_id long, text string")
    for run in (near.keep_one, lines.dedup_lines, lambda d: decontaminate.decontaminate(d, items)):
        out = run(clash)
        assert out.columns == clash.columns and 0 < out.count() < clash.count()
