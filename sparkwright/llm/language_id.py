"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each of its places holds a
bit for every language, so one look-up of an n-gram (the AND of its places)
returns all languages that contain it.  A text's n-grams are looked up, the
languages' bits are counted, and each count is corrected for false positives:
n-grams share codes and codes share places, and the part of all codes that
pass a language's filter is the rate at which an n-gram that the language
doesn't have passes for either reason.

Training counts n-grams by language over all training texts; a language
contains an n-gram that is not rare in it and not much rarer than in the
language that uses it most.
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


@dataclass(frozen=True)
class Params:
    sizes: tuple[int, ...] = (3, 4)  # bytes of an n-gram
    gram_bits: int = 20  # n-grams are told apart by hashes of so many bits
    filter_bits: int = 19  # places of the filter
    hashes: int = 3
    min_share: float = 2e-5
    min_ratio: float = 0.3
    tables: int = 32  # languages that one task counts at once


_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, and their texts.  All ASCII but letters counts as a space; runs of spaces count once."""
    data, offsets = tx.raw(column)
    data = _CLASS[data]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data):
        keep = np.concatenate([[True], ~((data[1:] == 32) & (data[:-1] == 32) & (doc[1:] == doc[:-1]))])
        data, doc = data[keep], doc[keep]
    out, docs = [], []
    for n in p.sizes:
        if len(data) < n:
            continue
        ok = doc[: len(doc) - n + 1] == doc[n - 1 :]
        x = np.zeros(len(ok), np.uint64)
        for j in range(n):
            x = (x << tx.U64(8)) | data[j : len(data) - n + 1 + j].astype(np.uint64)
        out.append(tx.mix(x[ok] + tx.U64(n << 40)) & tx.U64((1 << p.gram_bits) - 1))
        docs.append(doc[: len(ok)][ok])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(docs)


def _places(gram: np.ndarray, p: Params) -> np.ndarray:
    """The places of each n-gram, hashes x n."""
    return np.stack([(tx.mix(gram + c) >> tx.U64(64 - p.filter_bits)).astype(np.int64) for c in tx.constants(p.hashes, 71)])


def count(texts: DataFrame, p: Params) -> DataFrame:
    """lang, gram, n over ``texts (text, lang)``: one row a task, language and n-gram at most, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, codes = 1 << p.gram_bits, {}
        table = np.zeros((p.tables, width), np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, code in codes.items():
                used = np.flatnonzero(table[code])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(table[code][used])], ["lang", "gram", "n"])
                table[code][used] = 0
            codes.clear()

        for batch in batches:
            for at, part in tx.slices(batch.column(0)):
                gram, doc = grams(part, p)
                langs = batch.column(1).slice(at, len(part)).to_pylist()
                for lang in set(langs):
                    if lang not in codes and len(codes) == p.tables:
                        yield from flush()
                    code = codes.setdefault(lang, len(codes))
                    mine = np.array([x == lang for x in langs])[doc]
                    table[code] += np.bincount(gram[mine].astype(np.int64), minlength=width)
        yield from flush()

    return texts.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    prior: int  # the language of most training texts
    table: np.ndarray  # places x words of 64 languages
    false_rate: np.ndarray


def train(texts: DataFrame, params: Params | None = None) -> Model:
    """The filter of all ``texts (text, lang)``; rows with a null in either column teach nothing.

    What comes to the driver is the finished filter, whose size is fixed by the
    parameters, and one row for each language.
    """
    p = params or Params()
    rows = texts.where("text is not null and lang is not null")
    counts = storage.keep(count(rows, p), "grams")
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    order = [(r["lang"], r["total"]) for r in by_lang.orderBy("lang").collect()]
    langs = [x for x, _ in order]
    width = -(-max(1, len(langs)) // 64)
    model = Model(langs, int(np.argmax([n for _, n in order])) if order else 0, np.zeros((1 << p.filter_bits, width), np.uint64), np.zeros(len(langs)))
    if not langs:
        return model
    codes = counts.sparkSession.createDataFrame([(x, i, n) for i, (x, n) in enumerate(order)], "lang string, code int, total long")
    share = counts.join(codes, "lang").select("gram", "code", (F.col("n") / F.col("total")).alias("share"))
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    member = share.join(most, "gram").where((F.col("share") >= p.min_share) & (F.col("share") >= p.min_ratio * F.col("most")))
    word = F.floor(F.col("code") / 64).cast("int")
    masks = member.groupBy("gram", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, code % 64)")).alias("mask"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy().astype(np.uint64), p)
            k = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.tile(batch.column(1).to_numpy(), k)), pa.array(np.tile(batch.column(2).to_numpy(), k))], ["place", "word", "mask"])

    filled = masks.mapInArrow(spread, "place long, word int, mask long").groupBy("place", "word").agg(F.bit_or("mask").alias("mask"))
    got = filled.toArrow()
    model.table[got.column("place").to_numpy(), got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    model.false_rate = false_rates(model, p)
    storage.drop(counts)
    return model


def look_up(model: Model, gram: np.ndarray, p: Params) -> np.ndarray:
    """The bits of all languages that contain each n-gram, 64 languages a word."""
    places = _places(gram, p)
    found = model.table[places[0]]
    for x in places[1:]:
        found &= model.table[x]
    return found


def false_rates(model: Model, p: Params) -> np.ndarray:
    """The part of all n-gram codes that passes each language's filter."""
    passed, codes = np.zeros(len(model.langs)), 1 << p.gram_bits
    for at in range(0, codes, 1 << 18):
        found = look_up(model, np.arange(at, min(codes, at + (1 << 18)), dtype=np.uint64), p)
        passed += [np.count_nonzero(found[:, i // 64] >> tx.U64(i % 64) & tx.U64(1)) for i in range(len(passed))]
    return passed / codes


def corrected(column: pa.Array, model: Model, p: Params) -> np.ndarray:
    """Counts of n-grams by text and language, without the expected false positives."""
    gram, doc = grams(column, p)
    n_docs = len(column)
    found = look_up(model, gram, p)
    total = np.bincount(doc, minlength=n_docs)
    out = np.zeros((n_docs, len(model.langs)))
    for i, rate in enumerate(model.false_rate):
        hits = np.bincount(doc[(found[:, i // 64] >> tx.U64(i % 64) & tx.U64(1)) > 0], minlength=n_docs)
        out[:, i] = np.maximum(0.0, hits - total * rate) / max(1e-9, 1 - rate)
    return out


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = tx.raw(column)
    ascii_ = tx.sums(_LETTER[data].astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~ascii_ & (tx.sums((data > 127).astype(np.int64), offsets) > 0)):
        ascii_[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return ascii_


def predict(docs: DataFrame, model: Model, params: Params | None = None) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs (doc_id, text)``.

    ``und`` and 0 for a text that is null or has no letter, or where no
    language was learned.  The score is the best language's part of all
    corrected counts.  Ties go to the language first by code point; a text
    without a known n-gram gets the language with most training data and 0.
    Null and repeated ids are rows of their own; other columns are ignored; an
    empty table gives an empty one.
    """
    p = params or Params()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, part in tx.slices(batch.column(1)):
                ok = has_letter(part)
                if model.langs:
                    counts = corrected(part, model, p)
                    total = counts.sum(1)
                    best = np.where(total > 0, counts.argmax(1), model.prior)
                    score = np.where(ok & (total > 0), counts.max(1) / np.maximum(total, 1e-12), 0.0)
                    names = np.array(model.langs, object)[best]
                else:
                    ok[:], score, names = False, np.zeros(len(part)), np.full(len(part), "und", object)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.where(ok, names, "und"), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
