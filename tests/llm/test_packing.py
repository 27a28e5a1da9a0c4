"""Packing against the plain tokenizer and plain bookkeeping."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from labelloom.llm import packing

SCHEMA = "doc_id bigint, text string, lang string, ids int, sequence_id string, closed int"


TOKENIZER = Tokenizer.from_str(packing.vocabulary())


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def texts():
    words = [f"w{k % 37}x{'yz' * (k % 5)}" for k in range(9_000)]
    return {1: None, 2: "", 3: " \n\t ", 4: "Don't <|endoftext|> I'LL é é x\x0by a\x85b", 5: " ".join(words),
            6: "q" * 20_000, 7: "same text", 8: "same text", **{k: " ".join(words[:k * 3]) for k in range(10, 60)}}


def check(rows, expected, length):
    """Pieces hold the document, sequences are gapless and never too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(expected)
    for doc, ids in expected.items():
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // length)))
        assert [i for r in own for i in np.frombuffer(r.ids, '<u4')] == ids
        assert all(r.length == length for r in own[:-1]) and all(r.start == r.piece * length for r in own)
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return len(by_sequence)


@pytest.mark.parametrize("length,most", [(2048, 256), (64, 3)])
def test_pieces_and_sequences(spark, texts, length, most):
    docs = spark.createDataFrame([(k, t, "en", 1, "s", 1) for k, t in texts.items()], SCHEMA).repartition(3, "doc_id")
    expected = {k: plain(t) for k, t in texts.items()}
    packed = packing.pack(docs, length=length, most=most)
    rows = packed.collect()
    used = check(rows, expected, length)
    tokens = sum(map(len, expected.values()))
    assert used <= 1.1 * tokens / length + 3
    sums = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.digests(packed).collect()}
    assert sums == {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in rows}
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * tokens and len(whole) == used


def test_best_fit_takes_the_fullest_bin_that_has_room():
    bins = packing.Bins(10, 2)
    assert list(bins.place(7, ("a",))) == [] and list(bins.place(6, ("b",))) == []
    assert list(bins.place(3, ("c",))) == [[(("a",), 0), (("c",), 7)]]
    assert list(bins.place(9, ("d",))) == []
    assert list(bins.place(8, ("e",))) == [[(("d",), 0)]]  # no room and no further bin: the fullest closes
    assert sorted(len(h) for h in bins.rest()) == [1, 1]


def test_forgotten_words_are_encoded_again(texts):
    import pyarrow as pa
    few = packing.WordIds(packing.vocabulary(), held=10)
    for t in texts.values():
        ids, starts = few.encode(pa.array([t or ""], pa.large_string()))
        assert ids.tolist() == plain(t) and starts.tolist() == [0, len(ids)]


def test_frequent_words_stay_remembered():
    import pyarrow as pa
    some = packing.WordIds(packing.vocabulary(), held=6)
    for k in range(30):
        some.encode(pa.array([f"often also w{k}a"], pa.large_string()))
    assert {"often", "also"} <= set(some.known)


def test_odd_characters_like_the_tokenizer():
    import random

    import pyarrow as pa
    pick, one = random.Random(1), packing.WordIds(packing.vocabulary())
    signs = "aZé'.,;:!?-_$ \t\n|<>sßÿÉ÷\u0301 1²語\x85\x0b"
    for text in ["A<|EndOfText|>B", "a<|endoftext|>,b", "x,'s 's. 'S,'ll", *("".join(pick.choice(signs) for _ in range(pick.randrange(40))) for _ in range(1500))]:
        assert one.encode(pa.array([text], pa.large_string()))[0].tolist() == plain(text)


def test_empty_table_repeated_ids_and_text_ids(spark):
    assert packing.digests(packing.pack(spark.createDataFrame([], SCHEMA))).count() == 0
    docs = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "z")], "doc_id string, text string")
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id or "", np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted([("a", plain("x y"))] * 2 + [("", plain("z"))])
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3
