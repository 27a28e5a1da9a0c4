"""Words of letters and their counts over a corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
# A counter goes on to the shuffle when it holds so many different words.
HELD = 1_000_000


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


def _counts(group: str, split: Callable[[str], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(g, w, n) for g, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                   names=["label", "word", "n"])

        for batch in batches:
            for label, text in zip(batch.column(group).to_pylist(), batch.column("text").to_pylist()):
                if text:
                    held.setdefault(label, Counter()).update(split(text))
            if sum(map(len, held.values())) > HELD:
                yield flush()
        if held:
            yield flush()
    return run


def word_counts(docs: DataFrame, label: str, split: Callable[[str], list[str]] = letter_words) -> DataFrame:
    """(label, word, n) over all texts; each task adds up its own words before the shuffle."""
    return docs.select(F.col(label).alias("label"), "text").mapInArrow(
        _counts("label", split), "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n"))
