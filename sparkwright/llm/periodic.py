"""Periodic runs: stretches of words that repeat with a period, three times or more.

A sparse dynamic program over diagonals.  A diagonal is a lag between a word
and an earlier occurrence of it; its match length grows by one while the next
word has an occurrence at the same lag, and where it ends with enough words the
run is emitted at once.  Following every earlier occurrence of every word costs
the square of a word's frequency, so occurrences are taken in context, on one
scale for each doubling of the period: a run with smallest period q in
(g/2, g] holds g-word contexts that stand q words apart, and by the theorem of
Fine and Wilf the nearest earlier occurrence of such a context is exactly q
words back.  On each scale a word therefore has one active lag, and a text of n
words costs O(n log^2 n) whatever it repeats.  Any run has 16 or more matching
words, so the first scale is g = 16 and serves all periods up to 16; each next
scale only looks at contexts of which both halves repeat.

Each text is one task's work and there is no shuffle.  Words and contexts are
known by 64-bit hashes.

Defined results: a null text counts as empty and gives no run; ids may be null
or repeat, every input row gives one row; input columns other than those asked
for are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sparkwright.llm import textops as tx

RUN = "struct<start: long, length: long, period: long>"
SCHEMA = f"n_words long, runs array<{RUN}>, collapsed string"
_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


@dataclass(frozen=True)
class Params:
    """A run has at least ``min_words`` words and ``min_periods`` times its period."""

    min_words: int = 24
    min_periods: int = 3

    def __post_init__(self) -> None:
        if self.min_periods < 3 or self.min_words < 1:
            raise ValueError("min_periods is 3 or more (a context must fit into what matches), min_words 1 or more")

    @property
    def first_context(self) -> int:
        """Words that match, at least, in any run (a power of two below that)."""
        least = min(max(self.min_words - q, (self.min_periods - 1) * q) for q in range(1, self.min_words + 1))
        return 1 << (max(1, least).bit_length() - 1)


def runs(h: np.ndarray, first: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run among the word hashes ``h`` of texts with the bounds ``first``, by start, then period."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    end = np.repeat(first[1:], n)  # of the text that a word stands in
    g, step = p.first_context, tx.constants(64, 61)
    context, width = h, 1
    while width < g:  # contexts of 2, 4, ... words from each place, where the text is long enough
        context = tx.mix(context[: len(context) - width] * step[0] + context[width:] * step[1] + tx.U64(width)) if len(context) > width else context[:0]
        width *= 2
    at = np.flatnonzero(end[: len(context)] - np.arange(len(context)) >= g)
    context = context[at] if len(at) else context[:0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0  # periods above it belong to this scale
    while len(at):
        key = context ^ tx.mix(text[at].astype(tx.U64) + tx.U64(g))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        here, before = order[1:][same], order[:-1][same]
        lag = np.zeros(len(at), np.int64)
        lag[here] = at[here] - at[before]
        live = np.flatnonzero((lag > low) & (lag <= g))
        if len(live):  # active diagonals: neighbours in the text with one lag
            place, q = at[live], lag[live]
            cut = np.flatnonzero((place[1:] != place[:-1] + 1) | (q[1:] != q[:-1]) | (text[place[1:]] != text[place[:-1]])) + 1
            begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(live)]])
            matched = stop - begin + g - 1
            start, q = place[begin] - q[begin], q[begin]
            enough = matched + q >= np.maximum(p.min_words, p.min_periods * q)
            found.append((start[enough], (matched + q)[enough], q[enough]))
        # the next scale: contexts twice as long, of which both halves repeat, in texts with room for such a run
        repeats = np.zeros(len(at), bool)
        repeats[here] = repeats[before] = True
        at, context = at[repeats], context[repeats]
        roomy = n[text[at]] >= p.min_periods * (g + 1)
        other = np.searchsorted(at, at + g)
        has = roomy & (other < len(at))
        has[has] = at[other[has]] == at[has] + g
        has &= end[at] - at >= 2 * g
        context = tx.mix(context[has] * step[0] + context[other[has]] * step[1] + tx.U64(g))
        at, low, g = at[has], g, 2 * g
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(w: tx.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    k = np.flatnonzero(keep)
    followed = np.zeros(len(k), bool)
    followed[:-1] = w.doc[k[1:]] == w.doc[k[:-1]]
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start[k]] = 1
    edge[w.end[k]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8) > 0
    gap = w.end[k[followed]]  # white space, as another word of the text comes
    data = w.data.copy()
    data[gap], take[gap] = 32, True
    total = np.zeros(len(take) + 1, np.int64)
    np.cumsum(take, out=total[1:])
    return pa.Array.from_buffers(pa.large_string(), len(w.offsets) - 1, [None, pa.py_buffer(total[w.offsets].tobytes()), pa.py_buffer(data[take].tobytes())])


def find(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text: str = "text", params: Params | None = None) -> DataFrame:
    """``columns`` of every row, then n_words, its runs by start and period, and the text without repetitions.

    A run is a stretch of words with smallest period q, of at least
    ``min_words`` and ``min_periods * q`` words, that can't be made longer with
    the same period.  ``collapsed`` holds the words that no run contains after
    that run's first q words, joined by single spaces.  A column named like a
    result is left out.
    """
    p = params or Params()
    names = ["n_words", "runs", "collapsed"]
    columns = tuple(c for c in columns if c not in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tx.slices(batch.column(len(columns))):
                w = tx.words(part)
                start, length, period = runs(tx.word_hashes(w), w.first, p)
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                collapsed = _collapsed(w, np.cumsum(edge[:-1]) == 0)
                doc = w.doc[start] if len(start) else np.zeros(0, np.int64)
                bounds = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                fields = [pa.array(x) for x in (start - w.first[doc], length, period)]
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, fields=list(_RUN)))
                arrays = [batch.column(i).slice(at, len(part)) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(w.counts.astype(np.int64)), lists, collapsed.cast(pa.string())], [*columns, *names])

    own = docs.select(*columns, docs[text].alias("_text"))
    return own.mapInArrow(run, StructType([*own.schema.fields[:-1], *StructType.fromDDL(SCHEMA).fields]))
