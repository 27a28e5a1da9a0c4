"""Words and chunks on which polynomial hashes modulo a power of two fail."""

import sentencepiece as library

from labelloom.llm import recompress, sentencepiece


def twins(a, b, n):
    """A sequence and its complement whose polynomial hashes are equal modulo 2**64."""
    one = "".join(a if bin(k).count("1") % 2 else b for k in range(n))
    return one, one.translate(str.maketrans(a + b, b + a))


def test_different_long_words_are_not_taken_for_one(spark):
    words = [f"w{k}" for k in range(49)]
    one, other = twins("a", "b", 2048)
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, " ".join([*words, one]))]
    got = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 50)]


def test_different_long_chunks_keep_their_ids(spark):
    one, other = twins("a", "b", 2048)
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id bigint, text string")
    plain = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for row in sentencepiece.encode(docs, sentencepiece.Model.load()).collect():
        assert row.exact and list(row.ids) == plain.encode((one, other)[row.doc_id - 1])
