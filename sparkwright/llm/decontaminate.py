"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with
other parameters still has the template of the benchmark item.  Windows of
template tokens are hash-joined with those of the benchmark; the hits of one
alignment of an item with a text are an occurrence, and in an occurrence each
parameter of the item must stand for one value throughout.  A template needs
literal tokens; copies whose windows have too few of them (arithmetic, lists of
names, title case) are found by a second hash of every window, over its
lower-cased tokens as they are.  An item of fewer tokens than a template needs
is found where its tokens make up whole sentences or lines of a text.

Only windows that pass a bitmap of the benchmark's windows leave the scan; the
bitmap has a fixed greatest size and is a filter only, the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import storage
from sparkwright.llm import textops as tx

# Words that are units when they follow a number.
UNITS = (
    "m km cm mm mi ft in kg g mg lb oz l ml s sec min h hr day days week weeks month months year years hour hours "
    "minute minutes second seconds meter meters metre metres mile miles gram grams kilogram kilograms dollar dollars "
    "euro euros cent cents usd eur percent degree degrees"
).split()
LITERAL, NUMBER, NAME, UNIT = range(4)

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True


@dataclass(frozen=True)
class Params:
    window: int = 8
    #: tokens of a window that must be literal for its template to count; verbatim windows need none
    min_literal: int = 4
    #: an occurrence counts from this many windows on, or from this share of the item's windows if that is fewer
    min_windows: int = 5
    min_share: float = 0.25
    #: share of an item's parameters that must stand for one value
    min_consistent: float = 0.75
    max_bitmap_bits: int = 1 << 28


def template(column: pa.Array) -> tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, their kinds, template hashes, value hashes, and which open a sentence or line.

    Tokens are runs of letters and digits; a point or comma between digits
    belongs to the number.  A capitalised word is a name unless it starts a
    sentence or is upper-case throughout.
    """
    data, offsets = tx.raw(column)
    inside = _TOKEN[data]
    if len(data) > 2:
        mid = ((data[1:-1] == 44) | (data[1:-1] == 46)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        inside = inside.copy()
        inside[1:-1] |= mid
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # nothing goes on from one text to the next
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    w = tx.Words(np.where(_UPPER[data], data + 32, data).astype(np.uint8), offsets, start, end, doc, first)
    value = tx.word_hashes(w)
    kind, opens = np.zeros(len(start), np.int8), np.ones(len(start), bool)
    if len(start):
        # accented capitals of two bytes: C3 80 to C3 9E
        high = np.append(data[1:], 0)
        capital = _UPPER[data] | ((data == 0xC3) & (high >= 0x80) & (high <= 0x9E))
        total = np.concatenate([[0], np.cumsum(capital)])
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        gap = np.concatenate([[0], end[:-1]])
        opens = np.concatenate([[True], doc[1:] != doc[:-1]]) | (stops[start] > stops[np.minimum(gap, start)])
        n_capital, n_letters = total[end] - total[start], letters[end] - letters[start]
        name = capital[start] & ~opens & ((n_capital < n_letters) | (n_letters < 2))
        kind[name] = NAME
        kind[_DIGIT[data[start]]] = NUMBER
        units = tx.word_hashes(tx.words(pa.array(UNITS)))
        after = np.concatenate([[False], kind[:-1] == NUMBER]) & np.concatenate([[False], doc[1:] == doc[:-1]])
        kind[after & (kind != NUMBER) & np.isin(value, units)] = UNIT
    slots = tx.constants(4, 61)
    return w, kind, np.where(kind == LITERAL, value, slots[kind]), value, opens


def _windows(column: pa.Array, sizes: list[int], min_literal: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each size, hash, document, place and token span: templates of windows with enough literals, then values of all windows.

    Windows too short for a template count if they begin and end with a sentence or line.
    """
    w, kind, token, value, opens = template(column)
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    closes = np.append(opens[1:], True)
    for k in sizes:
        if k >= min_literal:
            h, at = tx.windows(token, w, k, seed=62)
            ok = literal[at + k] - literal[at] >= min_literal
            h, at = h[ok], at[ok]
            yield k, False, h + tx.U64(k), w.doc[at], at - w.first[w.doc[at]], at, kind, value
        h, at = tx.windows(value, w, k, seed=63)
        if k < min_literal:
            ok = opens[at] & closes[at + k - 1]
            h, at = h[ok], at[ok]
        yield k, True, h + tx.U64(k), w.doc[at], at - w.first[w.doc[at]], at, kind, value


def window_rows(texts: DataFrame, key: str, sizes: list[int], p: Params, bitmap=None, bits: int = 0, only_own: bool = False) -> DataFrame:
    """Rows ``key, hash, verbatim, place, kinds, vals`` of windows; with a bitmap only those it knows.

    ``only_own`` keeps, for each text, the windows of the full size, or of its
    whole length if it is shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at0, part in tx.slices(batch.column(1)):
                ids = batch.column(0).slice(at0, len(part))
                for k, verbatim, h, doc, place, at, kind, value in _windows(part, sizes, p.min_literal):
                    if bitmap is not None and len(h):
                        spot = (h % tx.U64(bits)).astype(np.int64)
                        table = np.frombuffer(bitmap.value, np.uint8)
                        hit = (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
                        h, doc, place, at = h[hit], doc[hit], place[hit], at[hit]
                    if only_own and len(h):
                        count = template(part)[0].counts[doc]
                        hit = np.minimum(count, max(sizes)) == k
                        h, doc, place, at = h[hit], doc[hit], place[hit], at[hit]
                    if not len(h):
                        continue
                    span = at[:, None] + np.arange(k)
                    cut = pa.array(np.arange(len(h) + 1, dtype=np.int32) * k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(doc)),
                            pa.array(h.view(np.int64)),
                            pa.array(np.full(len(h), verbatim)),
                            pa.array(place.astype(np.int64)),
                            pa.ListArray.from_arrays(cut, pa.array(kind[span].ravel().astype(np.int32))),
                            pa.ListArray.from_arrays(cut, pa.array(value[span].ravel().view(np.int64))),
                        ],
                        [key, "hash", "verbatim", "place", "kinds", "vals"],
                    )

    return texts.select(key, "text").mapInArrow(run, f"{key} long, hash long, verbatim boolean, place long, kinds array<int>, vals array<long>")


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """A bitmap of ``hashes`` modulo ``bits``, built in blocks on the executors; at most ``bits`` / 8 bytes."""
    block = 1 << 20

    def fill(batch: pa.Table) -> pa.Table:
        out = np.zeros(block // 8, np.uint8)
        spot = batch.column("spot").to_numpy() % block
        np.bitwise_or.at(out, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
        return pa.table({"block": batch.column("block")[:1].cast(pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    unsigned = F.expr(f"cast(pmod(pmod(hash, {bits}) + case when hash < 0 then {(1 << 64) % bits} else 0 end, {bits}) as long)")
    spots = hashes.select(unsigned.alias("spot")).distinct().withColumn("block", F.floor(F.col("spot") / block))
    out = bytearray(bits // 8)
    for row in spots.groupBy("block").applyInArrow(fill, "block long, data binary").collect():
        data = row["data"][: bits // 8]
        out[row["block"] * block // 8 : row["block"] * block // 8 + len(data)] = data
    return bytes(out)


def matches(docs: DataFrame, benchmark: DataFrame, params: Params | None = None) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_windows, item_windows, n_slots, consistent_slots.

    ``docs (doc_id, text)`` and ``benchmark (item_id, text)``.  Rows with a
    null id or text match nothing, nor do items without a token; an item of
    fewer than ``min_literal`` tokens matches where they are whole sentences or
    lines; repeated rows count once; other columns are ignored; where either
    table is empty so is the result.  An occurrence counts if enough of the
    item's templates are there and its slots are consistent, or if enough of
    its windows are there verbatim but for case; the numbers returned are of
    both kinds of windows together.  Of several occurrences of an item in a
    text, the one with the most windows is reported (ties: the earliest).
    """
    p = params or Params()
    spark = docs.sparkSession
    sizes = list(range(1, p.window + 1))
    items = benchmark.where("item_id is not null and text is not null")
    rows = window_rows(items, "item_id", sizes, p, only_own=True)
    known = storage.keep(rows.groupBy("item_id", "hash", "verbatim", "place").agg(F.first("kinds").alias("kinds"), F.first("vals").alias("vals")), "templates")
    n = known.select("hash").distinct().count()
    used = [r[0] for r in known.select(F.size("kinds")).distinct().collect()]  # at most ``window`` values
    bits = min(p.max_bitmap_bits, max(1 << 20, 1 << (64 * max(n, 1) - 1).bit_length()))
    bitmap = spark.sparkContext.broadcast(_bitmap(known.select("hash"), bits))
    hits = window_rows(docs.where("doc_id is not null and text is not null"), "doc_id", sorted(used) or [p.window], p, bitmap, bits)
    theirs = hits.select("doc_id", "hash", F.col("place").alias("at"), F.col("vals").alias("doc_vals"))
    aligned = theirs.join(known, "hash").withColumn("shift", F.col("at") - F.col("place"))
    aligned = storage.keep(aligned, "aligned")
    occurrence = ["doc_id", "item_id", "shift"]
    both = lambda: (F.max("verbatim").alias("as_value"), F.max(~F.col("verbatim")).alias("as_template"))
    places = lambda: (F.count_if("as_value").alias("values"), F.count_if("as_template").alias("templates"))
    counts = aligned.groupBy(*occurrence, "place").agg(*both()).groupBy(*occurrence).agg(F.count("*").alias("n_windows"), *places())
    slot = aligned.select(*occurrence, "verbatim", F.explode(F.arrays_zip("kinds", "vals", "doc_vals")).alias("s")).where(f"s.kinds <> {LITERAL}")
    templated = F.when(~F.col("verbatim"), F.col("s.doc_vals"))
    values = slot.groupBy(*occurrence, "s.kinds", "s.vals").agg(F.min("s.doc_vals").alias("lo"), F.max("s.doc_vals").alias("hi"), F.min(templated).alias("t_lo"), F.max(templated).alias("t_hi"))
    slots = values.groupBy(*occurrence).agg(
        F.count("*").alias("n_slots"), F.count_if(F.col("lo") == F.col("hi")).alias("consistent_slots"), F.count("t_lo").alias("t_slots"), F.count_if(F.col("t_lo") == F.col("t_hi")).alias("t_consistent")
    )
    whole = known.groupBy("item_id", "place").agg(*both()).groupBy("item_id").agg(F.count("*").alias("item_windows"), F.count_if("as_template").alias("item_templates"))
    enough = lambda n, of: (F.col(n) > 0) & (F.col(n) >= F.least(F.lit(p.min_windows), F.ceil(F.col(of) * p.min_share)))
    found = (
        counts.join(slots, occurrence, "left").na.fill(0, ["n_slots", "consistent_slots", "t_slots", "t_consistent"]).join(whole, "item_id")
        .where((enough("templates", "item_templates") & (F.col("t_consistent") >= F.col("t_slots") * p.min_consistent)) | enough("values", "item_windows"))
    )
    fields = ["n_windows", "item_windows", "n_slots", "consistent_slots"]
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-F.col("shift")).alias("early"), *fields[1:])).alias("b"))
    return best.select("doc_id", "item_id", *[F.col(f"b.{x}").alias(x) for x in fields])


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, that hold no benchmark item.

    Every row is judged by its own text, also where its id is null or repeated.
    """
    (row,) = storage.fresh(docs, "row")
    rows = storage.keyed(docs, row)
    with storage.temporary(docs.sparkSession) as stays:
        gone = storage.keep(matches(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, params).select(F.col("doc_id").alias(row)).distinct(), "gone")
        stays.append(gone)
    return storage.by_ids(rows, gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
