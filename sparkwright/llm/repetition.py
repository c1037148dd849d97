"""Quality rules by repetition coverage.

One pass over the texts: rolling hashes of several n-gram lengths find the
words that stand in an n-gram seen before in the same text, and whole-line
hashes find lines seen before.  What counts is the share of characters in such
later copies.  There is no shuffle; each text is judged alone.

Defined results: a null text counts as empty; an empty text has no words and
fails ``min_words``; ids may be null or repeat, every input row gives one row;
input columns other than those asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sparkwright.llm import textops as tx

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_gram_chars array<long>"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits; shares are of the characters in words."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: n-gram length -> greatest share of characters in later copies of n-grams
    max_gram_share: dict[int, float] = field(default_factory=lambda: {5: 0.30, 8: 0.25, 10: 0.20})
    max_line_share: float = 0.30


def _later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key stands at an earlier place, and the earlier neighbours."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return order[1:][same], order[:-1][same]


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Later copies of lines with a word: a count for each document, and a flag for each word."""
    n_docs = len(w.offsets) - 1
    flag = np.zeros(len(w.start), bool)
    if not len(w.start):
        return np.zeros(n_docs, np.int64), flag
    cut = np.flatnonzero(w.data == 10)
    start = np.union1d(w.offsets[:-1], cut + 1)
    start = start[start < len(w.data)]
    end = np.append(start[1:], len(w.data))
    end = end - (w.data[end - 1] == 10)
    line_of_word = np.searchsorted(start, w.start, side="right") - 1
    has = np.unique(line_of_word)
    start, end = start[has], end[has]
    doc = np.searchsorted(w.offsets, start, side="right") - 1
    line = tx.Words(w.data, w.offsets, start, end, doc, np.searchsorted(start, w.offsets))
    later, _ = _later(tx.word_hashes(line) ^ tx.mix(doc.astype(tx.U64) + tx.U64(77)))
    flag = np.isin(line_of_word, has[later])
    return np.bincount(doc[later], minlength=n_docs).astype(np.int64), flag


def judge(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All measures of one slice of texts, by name."""
    w = tx.words(column)
    n_docs, n = len(w.offsets) - 1, w.counts.astype(np.int64)
    # code points: bytes that do not continue one
    total = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=total[1:])
    chars = total[w.end] - total[w.start]
    out = {
        "n_words": n,
        "word_chars": tx.sums(chars, w.first),
        "n_symbols": tx.sums(_SYMBOL[w.data], w.offsets),
    }
    out["n_dup_lines"], dup_line = _lines(w)
    out["dup_line_chars"] = tx.sums(chars * dup_line, w.first)

    h = tx.word_hashes(w)
    limit = np.maximum(out["word_chars"], 1)
    bad = out["dup_line_chars"] > rules.max_line_share * limit
    repeated = np.zeros(len(h), bool)
    grams: list[np.ndarray] = []
    for k in sorted({*rules.max_gram_share, rules.window}):
        s, at = tx.windows(h, w, k)
        later, first = _later(s ^ tx.mix(w.doc[at].astype(tx.U64)))
        if k == rules.window:
            repeated = _covered(len(h), np.concatenate([at[later], at[first]]), k)
        if k in rules.max_gram_share:
            grams.append(tx.sums(chars * _covered(len(h), at[later], k), w.first))
            bad |= grams[-1] > rules.max_gram_share[k] * limit
    out["n_repeat_words"] = tx.sums(repeated.astype(np.int64), w.first)
    out["dup_gram_chars"] = np.stack(grams, 1) if grams else np.zeros((n_docs, 0), np.int64)
    out["base_failed"] = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n)
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def measure(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text: str = "text", rules: Rules | None = None) -> DataFrame:
    """``columns`` of every row, then the measures; a column named like a measure is left out."""
    rules = rules or Rules()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = tuple(c for c in columns if c not in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tx.slices(batch.column(len(columns))):
                found = judge(part, rules)
                grams = found["dup_gram_chars"]
                bounds = pa.array(np.arange(len(grams) + 1, dtype=np.int32) * grams.shape[1], pa.int32())
                arrays = [batch.column(i).slice(at, len(part)) for i in range(len(columns))]
                arrays += [pa.ListArray.from_arrays(bounds, pa.array(grams.ravel())) if x == "dup_gram_chars" else pa.array(found[x]) for x in names]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *names])

    own = docs.select(*columns, docs[text].alias("_text"))
    schema = StructType([*own.schema.fields[:-1], *StructType.fromDDL(SCHEMA).fields])
    return own.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text passes every rule."""
    rules = rules or Rules()
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tx.slices(batch.column(place)):
                yield batch.slice(at, len(part)).filter(pa.array(judge(part, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
