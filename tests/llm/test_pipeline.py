"""The pipeline against a plain version of its five stages."""

import random
import re

import pytest

import corpus_pipeline
from labelloom.llm import sentencepiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau ypsilon river mountain "
              "garden window letter number colour bridge market island").split()


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(VOCABULARY) + pick.choice(("", "s", "ed", "ing")) for _ in range(n))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def is_good(text):
    ws, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    repeated = len({k + j for k, g in enumerate(grams) if g in twice for j in range(3)})
    chars, n = sum(map(len, ws)), len(ws)
    return not (n < 50 or repeated * 100 > n * 50 or sum(c in "#*$%&|<>" for c in text) * 10 > n * 3
                or (len(lines) - len(set(lines))) * 100 > len(lines) * 50 or not 2 * n <= chars <= 15 * n
                or sum(c.isupper() for c in text) * 2 > chars)


def without_copies(docs):
    first, out = {}, []
    for doc, text in sorted(docs):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x) + 1 for x in lines[a:b]) >= 40 and first.setdefault(tuple(lines[a:b]), (doc, a)) != (doc, a):
                    gone.update(range(a, b))
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or words(left):
            out.append((doc, left))
    return out


def one_of_each(docs):
    def shingles(text):
        ws = words(text.lower())
        return {tuple(ws[k:k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}
    sets, group = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return [(d, t) for d, t in docs if group[d] == d]


def holds(text, item):
    """Smith-Waterman without any seeds."""
    text, item = (re.findall(r"[^\W_]+", x.lower()) for x in (text, item))
    above, best = [0] * (len(text) + 1), 0
    for word in item:
        row = [0]
        for k, other in enumerate(text, 1):
            row.append(max(0, above[k - 1] + (2 if word == other else -1), above[k] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best >= len(item)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick, path = random.Random(9), str(tmp_path_factory.mktemp("pipeline"))
    notice = "all rights reserved by the owners of this page\nplease read our terms before you go on"
    items = [(k, prose(f"item{k}", 22)) for k in range(6)]
    docs = [(k, prose(k, pick.randrange(60, 140)) + "\n" + prose(-k - 1, 30)) for k in range(40)]
    docs += [(100 + k, t + "\n" + notice) for k, (_, t) in enumerate(docs[:6])]
    near = docs[7][1].split(" ")
    near[10], near[-1] = "changed", "end"  # one word of each line
    docs += [(200, " ".join(near)), (201, docs[8][1]), (202, "short text"), (203, "x " * 200), (204, None), (205, ""),
             (206, prose("s", 60) + " ###" * 40), (207, prose("u", 80).upper()), (208, "\n".join(["same line of text here and on"] * 20)),
             (209, notice), (210, prose("own", 70) + "\n" + notice + "\n" + prose("more", 20))]
    for k, text in items[:3]:
        docs.append((300 + k, prose(f"a{k}", 50) + " " + text + "\n" + prose(f"b{k}", 40)))
    edited = items[4][1].split()
    edited[5], edited[14] = "other", "changed"
    docs.append((310, prose("c", 50) + " " + " ".join(edited) + " " + prose("d", 30)))
    rows = [(d, t, ("en", None)[d % 2], "web", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_all_stages_like_the_plain_version(spark, folder):
    path, docs, items = folder
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.MODEL)
    stages = [[(d, t) for d, t in docs if is_good(t)]]
    stages.append(without_copies(stages[0]))
    stages.append(one_of_each(stages[1]))
    stages.append([(d, t) for d, t in stages[2] if not any(holds(t, i) for _, i in items)])
    assert len(docs) > len(stages[0]) and stages[0] != stages[1] and len(stages[1]) > len(stages[2]) > len(stages[3]) > 20
    got = {r.doc_id: (list(r.ids), r.n_tokens, r.exact) for r in corpus_pipeline.run(spark, path).collect()}
    want = {d: library.encode(t) for d, t in stages[3]}
    assert got == {d: (ids, len(ids), True) for d, ids in want.items()}


def test_every_stage_works_on_what_the_one_before_kept(spark, folder):
    path, _, _ = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, path), "stage")
        assert now.columns == columns, name


def test_empty_folder(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
