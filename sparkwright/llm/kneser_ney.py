"""Interpolated modified Kneser-Ney n-gram model of any order, counted in Spark.

Levels go from the order down to two.  At each level a pass over the texts
counts, chunk by chunk in numpy, the n-grams of the order itself, or below it
the distinct words to the left of each n-gram, and sends them as blocks to
shards.  A shard is a range of the context's hash, so that it holds all of a
context: it writes one file with the n-grams as sorted hashes and their
counts, and the sums of each context that occurs more than once (a known
context that is not listed occurs once).  What a shard passes on is small:
word counts, how many words each word follows, and partial sums of hot keys.

Words travel as places in a list of frequent words, taken from the sample too,
and only others as hashes, so that a row takes the same room however few of a
chunk's rows go to one shard.

Hot keys: contexts, and n-grams with very many left words, that would fill a
large part of a shard by a sample of the texts, are spread over all shards and
their partial sums are added up; the sample decides only where rows go, never
what is counted.

Scoring: workers memory-map the shards and look up the n-grams of a slice of
texts.  Where the shared folder isn't mounted, shards are read into memory
instead, a bounded number at a time.

p_k(w|u) = max(a(u,w) - D, 0) / a(u) + g(u) p_(k-1)(w|u'), where a counts
occurrences at the order itself and distinct left words below it, u' is u
without its first word, and below level one stands 1 / (V + 1) for any token.
"""

from __future__ import annotations

import gc
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import storage
from sparkwright.llm import textops as tx

U64 = np.uint64
#: words are known by 64 bits of hash; within n-grams the first 48 of them stand for a word
SHORT = U64(16)
BEGIN, END = tx.constants(2, 81)[0] >> SHORT, tx.constants(2, 81)[1]
_PAIR, _CONTEXT, _LEFT = tx.constants(2, 82), tx.constants(2, 83), tx.constants(2, 84)
NONE = np.zeros(0, U64)
#: the place that says that a word isn't in the list of frequent ones
RARE = (1 << 16) - 1


@dataclass(frozen=True)
class Params:
    order: int = 3
    shard_bytes: int = 12 << 20  # text whose n-grams meet in one task
    chunk_tokens: int = 3 << 19  # tokens counted at once in a task
    slice_bytes: int = 2 << 20
    sample_tokens: int = 1 << 20  # the sample for hot keys and frequent words holds at least so many, and 64 a shard
    frequent: int = RARE


@dataclass
class Hot:
    """The hot keys of one level: contexts and n-grams (sorted hashes), and, once they are known, their sums."""

    context: np.ndarray = field(default_factory=lambda: NONE)
    pair: np.ndarray = field(default_factory=lambda: NONE)
    stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))  # total, one, two, more
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


@dataclass
class Model:
    """What every worker needs; the arrays stay in the files, whose names follow from level and shard."""

    folder: str
    order: int
    shards: int
    tokens: int = 0  # N
    types: int = 0  # V
    hot: dict[int, Hot] = field(default_factory=dict)
    discount: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # by level
    pairs: int = 0  # distinct bigrams
    word_gamma: float = 1.0


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts, each followed by the end token, and the n + 1 bounds."""
    w = tx.words(column, lower=True)
    h = tx.word_hashes(w)
    bounds = w.first + np.arange(len(w.first))
    out = np.empty(len(h) + len(w.first) - 1, U64)
    ends = bounds[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = h, END
    return out, bounds


def back(ids: np.ndarray, bounds: np.ndarray, n: int, begin=BEGIN) -> np.ndarray:
    """The token ``n`` places before each token; ``begin`` before a text."""
    out = np.full(len(ids), begin)
    out[n:] = ids[: max(0, len(ids) - n)]
    for i in range(n):
        at = bounds[:-1] + i
        out[at[at < bounds[1:]]] = begin
    return out


def contexts(ids: np.ndarray, bounds: np.ndarray, levels: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each level from two on, the hash of the words before each token that it looks at."""
    out = tx.mix(back(ids, bounds, 1))
    yield 2, out
    for k in range(3, levels + 1):
        out = tx.mix(out * _CONTEXT[0] + back(ids, bounds, k - 1) * _CONTEXT[1])
        yield k, out


def all_begin(level: int) -> np.uint64:
    return [c for _, c in contexts(np.zeros(1, U64), np.array([0, 1]), level)][-1][0]


def pair_id(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tx.mix(context * _PAIR[0] + word * _PAIR[1])


def left_id(pair: np.ndarray, left: np.ndarray) -> np.ndarray:
    return tx.mix(pair * _LEFT[0] + left * _LEFT[1])


def known(keys: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted array ``have``, and which are there."""
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def placed(hot: Hot, context: np.ndarray, pair: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """The number that gives each row its shard: of its context, or of more of the row where that is hot."""
    out = tx.mix(context)
    is_hot = known(context, hot.context)[1]
    out[is_hot] = pair[is_hot]
    if left is not None and len(hot.pair):
        is_hot = known(pair, hot.pair)[1]
        out[is_hot] = left_id(pair[is_hot], left[is_hot])
    return out


def shard_of(place: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each place; rising with it."""
    return ((place >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _compact(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == U64 else _small(x)


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new)


def _lengths(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begin, n))


def _add(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = _runs(keys)
    return keys[begin], *(np.add.reduceat(v[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64) for v in values)


ROWS = "kind string, shard long, name string, blob binary, n array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "shard", "name", "blob", "n"])


def _blob(kind: str, shard: int, *arrays: np.ndarray) -> tuple:
    return kind, int(shard), None, _pack(*arrays), None


def _blobs(frame: pa.Table) -> list[list[np.ndarray]]:
    return [_unpack(x) for x in frame.column("blob").to_pylist()]


def _signed(x) -> int:
    return int(np.array(x, U64).view(np.int64))


def _unsigned(x: list[int]) -> np.ndarray:
    return np.array(x, np.int64).view(U64)


def _chunks(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token ids and bounds of a bounded number of texts at a time."""
    ids: list[np.ndarray] = []
    bounds: list[np.ndarray] = [np.zeros(1, np.int64)]
    held = 0
    for batch in batches:
        for _, part in tx.slices(batch.column(0), p.slice_bytes):
            t, b = tokens(part)
            ids.append(t)
            bounds.append(b[1:] + held)
            held += len(t)
            if held >= p.chunk_tokens:
                yield np.concatenate(ids), np.concatenate(bounds)
                ids, bounds, held = [], [np.zeros(1, np.int64)], 0
    if held:
        yield np.concatenate(ids), np.concatenate(bounds)


def _level(ids: np.ndarray, bounds: np.ndarray, level: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Context, pair and left word of every token at a level, and the hash that tells its rows apart."""
    context = [c for _, c in contexts(ids, bounds, level)][-1]
    pair = pair_id(context, ids)
    left = back(ids, bounds, level) if level < order else None
    return context, pair, left, pair if left is None else left_id(pair, left)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns by byte planes; most high bytes of codes and counts are zero."""
    parts = []
    for x in map(_compact, columns):
        parts.append((x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()))
    return zstandard.compress(pickle.dumps(parts, 5), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(zstandard.decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def _hot_keys(texts: DataFrame, size: int, shards: int, p: Params) -> tuple[dict[int, Hot], np.ndarray]:
    """By a sample: keys of more than a quarter of a shard's rows, four a shard, level and kind at most; and the most frequent words."""
    want = max(p.sample_tokens, 64 * shards)
    fraction = min(1.0, 6.0 * want / max(1, size))
    sample = texts.sample(fraction, 7) if fraction < 1 else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bounds in _chunks(batches, p):
            word, n = np.unique(ids >> SHORT, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int64)), pa.array(["word"] * len(n), pa.string()), pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["level", "kind", "key", "n"])
            for level in range(2, p.order + 1):
                context, pair, left, whole = _level(ids >> SHORT, bounds, level, p.order)
                one = np.unique(whole, return_index=True)[1]
                out = [("all", NONE[:1], np.array([len(one)]))]
                for kind, key in (("context", context[one]), *([("pair", pair[one])] if left is not None else [])):
                    key, n = np.unique(key, return_counts=True)
                    out.append((kind, key[n > 1], n[n > 1]))
                for kind, key, n in out:
                    k = max(1, len(key)) if kind == "all" else len(key)
                    values = key.view(np.int64) if len(key) else np.zeros(k, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([level] * k, pa.int64()), pa.array([kind] * k, pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["level", "kind", "key", "n"])

    counts = storage.keep(sample.select("text").mapInArrow(run, "level long, kind string, key long, n long").groupBy("level", "kind", "key").agg(F.sum("n").alias("n")), "sample")
    total = counts.where("kind = 'all'").select("level", F.greatest(F.lit(16), F.col("n") / (4 * shards)).alias("least"))
    found = counts.where("kind in ('context', 'pair')").join(total, "level").where("n > least").collect()
    words = counts.where("kind = 'word'").orderBy(F.desc("n"), "key").limit(p.frequent).select("key").collect()
    storage.drop(counts)
    frequent = _unsigned([r["key"] for r in words])
    return {k: Hot(*(np.sort(_unsigned([r["key"] for r in found if r["level"] == k and r["kind"] == kind])) for kind in ("context", "pair"))) for k in range(2, p.order + 1)}, frequent


def _context_of(words: list[np.ndarray]) -> np.ndarray:
    """The hash of contexts, given their words in order."""
    context = tx.mix(words[-1])
    for x in words[-2::-1]:
        context = tx.mix(context * _CONTEXT[0] + x * _CONTEXT[1])
    return context


def _coded(words: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Places in the list of frequent words, and the words that aren't there."""
    return [place, words[place == RARE]]


def _decoded(place: np.ndarray, rare: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    place = place.astype(np.int64)
    out = np.append(frequent, U64(0))[np.minimum(place, len(frequent))]
    out[place == RARE] = rare
    return out


def _count(texts: DataFrame, level: int, shards: int, hot: Hot, frequent, p: Params) -> DataFrame:
    """Blocks of the rows of one level, by shard; at the order itself the word counts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bounds in _chunks(batches, p):
            word, code, n = np.unique(ids, return_inverse=True, return_counts=True)
            if level == p.order:
                cuts = np.append(_runs(at := shard_of(word, shards)), len(word))
                yield _rows([_blob("words", at[a], word[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            # codes follow the list of frequent words, then come the others; BEGIN, which no word has as its id, gets the last
            sorted_, at_ = np.sort(frequent.value), np.argsort(frequent.value)
            at, ok = known(word >> SHORT, sorted_)
            place = np.where(ok, at_[at] if len(at_) else 0, RARE)
            order = np.argsort(place, kind="stable")
            rank = np.empty(len(word), np.int64)
            rank[order] = np.arange(len(word))
            word, place, code = np.append(word[order] >> SHORT, BEGIN), np.append(place[order], RARE), rank[code]
            columns = [back(code, bounds, k, len(word) - 1) for k in range(level - 1, 0, -1)] + [code]
            if level < p.order:
                columns.append(back(code, bounds, level, len(word) - 1))
            bits = len(word).bit_length()
            if bits * len(columns) < 64:
                whole = columns[0].astype(U64)
                for x in columns[1:]:
                    whole = whole << U64(bits) | x.astype(U64)
            else:
                whole = _level(ids >> SHORT, bounds, level, p.order)[3]
            order = np.argsort(whole)
            begin = _runs(whole[order])
            one, n = order[begin], _lengths(begin, len(order))
            columns = [x[one] for x in columns]
            context = _context_of([word[x] for x in columns[: level - 1]])
            pair = pair_id(context, word[columns[level - 1]])
            at = shard_of(placed(hot, context, pair, word[columns[level]] if level < p.order else None), shards)
            order = np.argsort(at.astype(np.min_scalar_type(shards)), kind="stable")
            at, n, columns = at[order], n[order], [x[order] for x in columns]
            cuts, out, held = np.append(_runs(at), len(at)), [], 0
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = [x[a:b] for x in columns]
                new = np.ones(b - a, bool)
                new[1:] = False
                for x in own[: level - 1]:
                    new[1:] |= x[1:] != x[:-1]
                begin = np.flatnonzero(new)
                own = [*(x[begin] for x in own[: level - 1]), *own[level - 1 :]]
                out.append(_blob("grams", at[a], _lengths(begin, b - a), *(y for x in own for y in _coded(word[x], place[x])), *([n[a:b]] if level == p.order else [])))
                held += len(out[-1][3])
                if held > 1 << 22:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    return texts.select("text").mapInArrow(run, ROWS)


def _directory(key: np.ndarray) -> list[np.ndarray]:
    """Sorted 64-bit keys as the start of each bucket of leading bits, and the next 32 bits of each key."""
    bits = max(1, int(len(key)).bit_length() - 3)
    bucket = key >> U64(64 - bits)
    start = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=U64))
    return [start.astype("<u4"), ((key << U64(bits)) >> U64(32)).astype("<u4")]


def _bytes_and_more(n: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; those of 255 and more apart, with their places."""
    more = np.flatnonzero(n >= 255)
    return [np.minimum(n, 255).astype(np.uint8), more.astype("<u4"), n[more].astype("<u8")]


def _write(folder: str, kind: str, shard: int, arrays: list[np.ndarray]) -> str:
    """One file: number of arrays, then length and type of each, then the arrays at multiples of eight bytes."""
    name = f"{kind}-{shard}-{TaskContext.get().attemptNumber()}-{uuid.uuid4().hex}.tmp"
    system, root = storage.open_fs(folder)
    system.create_dir(root, recursive=True)
    head = np.array([len(arrays), *(v for x in arrays for v in (len(x), x.itemsize))], "<i8")
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(head.tobytes())
        for x in arrays:
            out.write(np.ascontiguousarray(x).data)
            out.write(b"\0" * (-x.nbytes % 8))
    return name


def _merge(folder: str, level: int, hot: Hot, frequent, p: Params):
    first = all_begin(level)

    def grams(shard: int, parts: list[tuple]) -> list[tuple]:
        found: list[list[np.ndarray]] = [[], [], []]
        while parts:
            runs, *columns = parts.pop()
            words = [_decoded(*columns[i : i + 2], frequent.value) for i in range(0, len(columns) - 1, 2)]
            found[0].append(np.repeat(_context_of(words[: level - 1]), runs))
            found[1].append(words[level - 1])
            found[2].append(words[level] if level < p.order else columns[-1].astype(np.int64))
        context, word, last = (np.concatenate(found.pop(0)) for _ in range(3))
        pair = pair_id(context, word)
        if level == p.order:
            n = last
        else:  # a left word counts once
            one = np.unique(left_id(pair, last), return_index=True)[1]
            context, word, pair, n = context[one], word[one], pair[one], np.ones(len(one), np.int64)
        order = np.argsort(pair)
        pair = pair[order]
        begin = _runs(pair)
        n = np.add.reduceat(n[order], begin)
        pair, one = pair[begin], order[begin]
        context, word = context[one], word[one]
        out = []
        if len(hot.pair):
            is_hot = known(pair, hot.pair)[1]
            out += [("pair", _signed(c), None, None, [_signed(w), int(k), _signed(h)]) for c, w, k, h in zip(context[is_hot], word[is_hot], n[is_hot], pair[is_hot], strict=True)]
            context, word, pair, n = context[~is_hot], word[~is_hot], pair[~is_hot], n[~is_hot]
        u, total, ones, twos, more = _add(context, n, n == 1, n == 2, n > 2)
        is_hot = known(u, hot.context)[1]
        out += [("hot", _signed(u[i]), None, None, [int(x[i]) for x in (total, ones, twos, more)]) for i in np.flatnonzero(is_hot)]
        listed = ~is_hot & ((total > 1) | (u == first))
        stats = [_small(x[listed]) for x in (total, ones, twos, more)]
        name = _write(folder, f"level{level}", shard, [*_directory(pair), *_bytes_and_more(n), *_directory(u[listed]), *stats])
        out.append(("file", shard, name, None, [len(pair), *(int((n == i).sum()) for i in (1, 2, 3, 4))]))
        if level == 2:
            out.append(_blob("follows", shard, *_add(word, np.ones(len(word), np.int64))))
        return out

    def merge(block: pa.Table) -> pa.Table:
        shard, kind = block.column("shard")[0].as_py(), block.column("kind")[0].as_py()
        parts = _blobs(block)
        if kind == "words":
            return pa.Table.from_batches([_rows([_blob("words", shard, *_add(*map(np.concatenate, zip(*parts, strict=True))))])])
        return pa.Table.from_batches([_rows(grams(shard, parts))])

    return merge


def _deal_words(shards: int):
    """Word counts, and numbers of words that a (short) word follows, cut by the words' shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, n = _unpack(row["blob"])
                cuts = np.append(_runs(at := shard_of(word if row["kind"] == "words" else word << SHORT, shards)), len(word))
                yield _rows([_blob(row["kind"], at[a], word[a:b], n[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])

    return run


def _merge_words(folder: str):
    def merge(block: pa.Table) -> pa.Table:
        shard, parts = block.column("shard")[0].as_py(), _blobs(block)
        own = {k: [x for x, kind in zip(parts, block.column("kind").to_pylist(), strict=True) if kind == k] or [(NONE, NONE)] for k in ("words", "follows")}
        w, count = _add(*map(np.concatenate, zip(*own["words"], strict=True)))
        short, n = _add(*map(np.concatenate, zip(*own["follows"], strict=True)))
        at, ok = known(w >> SHORT, short)
        follows = np.where(ok, n[at] if len(n) else 0, 0)
        name = _write(folder, "words", shard, [w, _small(count), _small(follows)])
        sums = [int(count.sum()), int((count > 0).sum()), int(follows.sum()), *(int((follows == i).sum()) for i in (1, 2, 3, 4)), int((follows > 2).sum())]
        return pa.Table.from_batches([_rows([("file", shard, name, None, sums)])])

    return merge


def _settle(files: DataFrame, folder: str) -> list[int]:
    """Give the files of a committed table their final names; returns the sums of ``n``.  A repeated attempt finds the work done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                kind = row["name"].split("-", 1)[0]
                target = f"{root}/{kind}-{row['shard']}"
                try:
                    system.move(f"{root}/{row['name']}", target)
                except OSError:
                    if system.get_file_info(target).type.name == "NotFound":
                        raise
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("n"))], ["n"])

    moved = files.where("kind = 'file'").mapInArrow(run, "n array<long>")
    rows = moved.select(F.posexplode("n").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = {r["i"]: int(r["v"]) for r in rows}
    return [sums.get(i, 0) for i in range(8)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many have the counts 1 to 4; kept between 0 and the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(i - 0.01, max(0.01, d)) for i, d in enumerate(raw, 1))


def _free(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of frames that are gone; they would stay on disk until the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def train(docs: DataFrame, params: Params | None = None) -> Model:
    """Count all texts of ``docs (text)`` and write the model below the shared folder.

    A null text counts as empty, which is one end token; an empty table gives
    a model that knows no token.  What comes to the driver are sums and the hot
    keys, whose number is bounded by that of the shards.
    """
    p = params or Params()
    if p.order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-size // p.shard_bytes))
    hot_keys, frequent = _hot_keys(docs, size, shards, p)
    model = Model(storage.scratch(spark, "kneser-ney"), p.order, shards, hot=hot_keys)
    frequent = spark.sparkContext.broadcast(frequent)
    kept, follows = [], []
    for level in range(p.order, 1, -1):
        hot = model.hot[level]
        blocks = _count(docs, level, shards, hot, frequent, p).repartition(shards, "shard")
        merged = storage.keep(blocks.groupBy("kind", "shard").applyInArrow(_merge(model.folder, level, hot, frequent, p), ROWS), f"level{level}")
        del blocks
        kept.append(merged)
        _, *ones = _settle(merged, model.folder)[:5]
        # hot n-grams first, as hot contexts hold them too; both are bounded by the sample's threshold
        pairs = merged.where("kind = 'pair'").groupBy("shard", F.col("n")[0].alias("word"), F.col("n")[2].alias("pair")).agg(F.sum(F.col("n")[1]).alias("n")).collect()
        stats = merged.where("kind = 'hot'").groupBy("shard").agg(*(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(4))).collect()
        hot.stats, hot.count = np.zeros((len(hot.context), 4), np.int64), np.zeros(len(hot.pair), np.int64)
        for r in stats:
            hot.stats[np.searchsorted(hot.context, _unsigned([r[0]])[0])] += r[1:]
        for r in pairs:
            hot.count[np.searchsorted(hot.pair, _unsigned([r["pair"]])[0])] = r["n"]
            hot.stats[np.searchsorted(hot.context, _unsigned([r["shard"]])[0])] += [r["n"], r["n"] == 1, r["n"] == 2, r["n"] > 2]
            if r["n"] <= 4:
                ones[r["n"] - 1] += 1
        if level == 2 and pairs:
            word, n = _add(_unsigned([r["word"] for r in pairs]), np.ones(len(pairs), np.int64))
            follows = [("follows", 0, None, bytearray(_pack(word, n)), None)]
        model.discount[level] = discounts(ones)
        _free(spark)
    words = kept[0].where("kind = 'words'").unionAll(kept[-1].where("kind = 'follows'")).unionAll(spark.createDataFrame(follows, ROWS))
    dealt = words.mapInArrow(_deal_words(shards), ROWS).repartition(shards, "shard")
    finished = storage.keep(dealt.groupBy("shard").applyInArrow(_merge_words(model.folder), ROWS), "words")
    model.tokens, model.types, model.pairs, *ones, more = _settle(finished, model.folder)
    model.discount[1] = d = discounts(ones)
    model.word_gamma = (d[0] * ones[0] + d[1] * ones[1] + d[2] * more) / model.pairs if model.pairs else 1.0
    for x in (*kept, finished):
        storage.drop(x)
    _free(spark)
    return model


@lru_cache(maxsize=64)
def _in_memory(path: str) -> bytes | None:
    system, inner = storage.open_fs(path)
    try:
        with system.open_input_file(inner) as source:
            return source.read()
    except FileNotFoundError:
        return None


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.memmap | None:
    try:
        return np.memmap(path, np.uint8, "r")
    except FileNotFoundError:
        return None


@lru_cache(maxsize=4096)
def _arrays(path: str, kinds: tuple[str | None, ...]) -> list[np.ndarray] | None:
    """The arrays of a file, or None where no shard was written."""
    local = storage.local_path(path)
    buffer = _mapped(local) if local else _in_memory(path)
    if buffer is None:
        return None
    n = int(np.frombuffer(buffer, "<i8", 1)[0])
    head = np.frombuffer(buffer, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for (length, item), kind in zip(head, kinds, strict=True):
        out.append(np.frombuffer(buffer, np.dtype(kind or f"<u{item}"), length, at))
        at += length * item + (-length * item % 8)
    return out


_LEVEL = ("<u4", "<u4", "u1", "<u4", "<u8", "<u4", "<u4", None, None, None, None)
_WORDS = ("<u8", None, None)


def _find(key: np.ndarray, start: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a directory, and their places there."""
    bits = U64((len(start) - 1).bit_length() - 1)
    bucket = (key >> (U64(64) - bits)).astype(np.int64)
    want = ((key << bits) >> U64(32)).astype(np.uint32)
    at, end = start[bucket].astype(np.int64), start[bucket + 1]
    open_ = np.flatnonzero(at < end)
    found = []
    while len(open_):
        here = low[at[open_]]
        found.append(open_[here == want[open_]])
        open_ = open_[here < want[open_]]
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    hit = np.concatenate(found) if found else np.zeros(0, np.int64)
    return hit, at[hit]


def word_stats(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and number of followed words of each of the sorted distinct ids; zeros for unknown ones."""
    count, follows = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    cuts = np.append(_runs(shard := shard_of(ids, model.shards)), len(ids))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if arrays := _arrays(f"{model.folder}/words-{shard[a]}", _WORDS):
            at, ok = known(ids[a:b], arrays[0])
            at, place = at[ok], a + np.flatnonzero(ok)
            count[place], follows[place] = arrays[1][at], arrays[2][at]
    return count, follows


def level_stats(model: Model, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count of each (context, word), and total, one, two and more of each context where it is listed."""
    hot, pair = model.hot[level], pair_id(context, word)
    place = placed(hot, context, pair)
    order = np.argsort(place)
    n, stats = np.zeros(len(word), np.int64), np.zeros((len(word), 4), np.int64)
    cuts = np.append(_runs(shard := shard_of(place[order], model.shards)), len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        arrays = _arrays(f"{model.folder}/level{level}-{shard[a]}", _LEVEL)
        if arrays is None:
            continue
        start, low, count, more, large, c_start, c_low, *sums = arrays
        rows = order[a:b]
        hit, at = _find(pair[rows], start, low)
        found = count[at].astype(np.int64)
        if len(more):
            full = np.flatnonzero(found == 255)
            found[full] = large[np.searchsorted(more, at[full])]
        n[rows[hit]] = found
        c = context[rows]
        begin = _runs(c)
        hit, at = _find(c[begin], c_start, c_low)
        got = np.zeros((len(begin), 4), np.int64)
        for i, x in enumerate(sums):
            got[hit, i] = x[at]
        stats[rows] = np.repeat(got, _lengths(begin, len(c)), axis=0)
    if len(hot.context):
        at, ok = known(context, hot.context)
        stats[ok] = hot.stats[at[ok]]
    if len(hot.pair):
        at, ok = known(pair, hot.pair)
        n[ok] = hot.count[at[ok]]
    return n, stats


def _off(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0)


def probabilities(model: Model, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p of each token after those before it, and the token's count in training."""
    distinct, code = np.unique(ids, return_inverse=True)
    count, follows = (x[code] for x in word_stats(model, distinct))
    p = _off(follows, model.discount[1]) / max(1, model.pairs) + model.word_gamma / (model.types + 1)
    seen = count  # how often the n-gram that ends at each token occurs, one level below
    ids = ids >> SHORT
    for level, context in contexts(ids, bounds, model.order):
        n, stats = level_stats(model, level, context, ids)
        # a context is an n-gram that ends one token earlier; where it is known but not listed it occurs once
        once = np.zeros(len(ids), bool)
        once[1:] = seen[:-1] > 0
        once[bounds[:-1]] = False
        stats[once & (stats[:, 0] == 0)] = (1, 1, 0, 0)
        total = np.maximum(1, stats[:, 0])
        upper = _off(n, model.discount[level]) / total + (stats[:, 1:] @ np.array(model.discount[level])) / total * p
        p, seen = np.where(stats[:, 0] > 0, upper, p), n
    return p, count


def score(docs: DataFrame, model: Model, params: Params | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs (doc_id, text)``.

    Scores are log10 probabilities of the whole text with its end token;
    perplexity is ``10 ** (-score / n_tokens)``.  A null text counts as empty.
    Null and repeated ids are rows of their own; other columns are ignored; an
    empty table gives an empty one; a model without training text gives every
    token the same probability.
    """
    p = params or Params()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, part in tx.slices(batch.column(1), p.slice_bytes):
                ids, bounds = tokens(part)
                prob, count = probabilities(model, ids, bounds)
                n = np.diff(bounds).astype(np.int64)
                add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end token
                base = add(np.log10((count + 1) / (model.tokens + model.types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(n), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(add(np.log10(prob)))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
