"""Token-ID output by bit-plane shuffling.

A file holds the ids of a range of documents in order.  Ids are cut into
blocks of a fixed size; each block, as little-endian 32-bit numbers, is
transposed into 4 byte planes or 32 bit planes, every plane is compressed with
zstandard by itself, and the chunk index at the end of the file holds the
place, the count and the plane lengths of each block, so that any span can be
read without the rest.  A document index (id, count) follows.

Layout: magic, planes of block 0, planes of block 1, ..., index (zstandard of
int64 arrays), then its length and the magic again.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm import storage
from sparkwright.llm import textops as tx

MAGIC = b"SWPLANE1"


@dataclass(frozen=True)
class Params:
    tokenizer: str
    end_id: int = 2
    block_ids: int = 1 << 16
    planes: str = "byte"  # or "bit"
    level: int = 3
    #: text encoded at once; what a worker holds beside its remembered pieces is some sixty times this
    slice_bytes: int = 1 << 18
    #: strings of special tokens in a text are ordinary text, so that no document can forge an id
    special_as_text: bool = True


# white space by the tokenizer's rule: these bytes, and the sequences in ``_spaces``
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any script."""
    out = _SPACE[data]
    if len(data) > 1:
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        out[:-1] |= two
        out[1:] |= two
    if len(data) > 2:
        x, y, z = data[:-2], data[1:-1], data[2:]
        general = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        three = general | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        for i in range(3):
            out[i : len(data) - 2 + i] |= three
    return out


class PieceEncoder:
    """Byte-level BPE through the tokenizers library, with each piece of text encoded once.

    A single space between two characters other than white space always
    begins a new pre-token, so texts are cut there, and only there, and each
    piece encodes by itself.  Pieces are found by 64-bit hashes of their bytes,
    and the bytes of a remembered piece are compared before its ids are used; a
    text with a piece that only has the hash of another one is encoded whole.
    New pieces are encoded together and told apart by the tokens that start
    with a space, or one by one where that doesn't work.  When the memory of
    pieces is full, those that no second slice of texts had are forgotten.
    """

    def __init__(self, path: str, special_as_text: bool, limit: int = 1 << 19) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.known, self.fresh = none, none  # sorted hashes and their places; fresh ones join the others now and then
        self.ids, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32)
        # the bytes of each piece, as lanes, and their number
        self.lane, self.lane_bounds, self.size = np.zeros(1 << 15, np.uint64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = np.zeros(1 << 14, np.uint8)  # slices that had the piece, two at most
        self.n = 0

    def _forget(self) -> None:
        """Keep the pieces that were used again, unless that is most of them."""
        keep = np.flatnonzero(self.used[: self.n] > 1)
        if len(keep) > self.limit // 2:
            keep = keep[:0]
        place = np.full(self.n, -1, np.int32)
        place[keep] = np.arange(len(keep), dtype=np.int32)
        h, at = self._joined(self.known, self.fresh)
        stay = place[at] >= 0
        ids, bounds, lane, lane_bounds, size = self.ids, self.bounds, self.lane, self.lane_bounds, self.size[keep]
        self._reset()
        self._bytes(*self._taken(lane, lane_bounds, keep), size)
        self._put(*self._taken(ids, bounds, keep))
        self.known = (h[stay], place[at[stay]])

    @staticmethod
    def _taken(values: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs ``keep`` of ``values``, and the length of each."""
        count = (bounds[keep + 1] - bounds[keep]).astype(np.int64)
        return values[np.repeat(bounds[keep] - (np.cumsum(count) - count), count) + np.arange(count.sum())], count

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        end, n = self.bounds[self.n], self.n + len(lengths)
        self.ids, self.bounds = self._room(self.ids, end + len(ids)), self._room(self.bounds, n + 1)
        self.ids[end : end + len(ids)] = ids
        self.bounds[self.n + 1 : n + 1] = end + np.cumsum(lengths)
        self.n = n

    def _bytes(self, lane: np.ndarray, count: np.ndarray, size: np.ndarray) -> None:
        """The bytes of pieces whose ids are put next."""
        end, n = self.lane_bounds[self.n], self.n + len(size)
        self.lane, self.lane_bounds = self._room(self.lane, end + len(lane)), self._room(self.lane_bounds, n + 1)
        self.size, self.used = self._room(self.size, n), self._room(self.used, n)
        self.lane[end : end + len(lane)] = lane
        self.lane_bounds[self.n + 1 : n + 1] = end + np.cumsum(count)
        self.size[self.n : n], self.used[self.n : n] = size, 0

    def _learn(self, pieces: list[str], hashes: np.ndarray, lane: np.ndarray, bounds: np.ndarray, size: np.ndarray) -> None:
        simple = np.array([x[0] == " " and len(x) > 1 and " " not in x[1:] and not x[1].isspace() and not x[-1].isspace() for x in pieces])
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        first = self.n
        self._bytes(*self._taken(lane, bounds, order), size[order])
        for i in range(0, len(together := np.flatnonzero(simple).tolist()), 4096):
            part = [pieces[k] for k in together[i : i + 4096]]
            ids = np.array(self._whole("".join(part)), np.uint32)
            starts = np.flatnonzero(self.starts[ids])
            if len(starts) == len(part):
                self._put(ids, np.diff(np.append(starts, len(ids))))
            else:
                self._each(part)
        self._each([pieces[k] for k in np.flatnonzero(~simple).tolist()])
        self.fresh = self._joined(self.fresh, (hashes[order], np.arange(first, self.n, dtype=np.int32)))
        if len(self.fresh[0]) > 1 << 15:
            self.known = self._joined(self.known, self.fresh)
            self.fresh = (self.fresh[0][:0], self.fresh[1][:0])

    def _each(self, pieces: list[str]) -> None:
        own = [self._whole(x) for x in pieces]
        self._put(np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64))

    @staticmethod
    def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(h)
        return h[order], at[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of sorted hashes, -1 where new."""
        out = np.full(len(hashes), -1, np.int64)
        for have, at in (self.known, self.fresh):
            if len(have):
                i = np.minimum(np.searchsorted(have, hashes), len(have) - 1)
                hit = have[i] == hashes
                out[hit] = at[i[hit]]
        return out

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if self.n > self.limit:
            self._forget()
        data, offsets = tx.raw(column)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        space = _spaces(data)
        cut = np.zeros(len(data), bool)
        if len(data) > 2:
            cut[1:-1] = (data[1:-1] == 0x20) & ~space[:-2] & ~space[2:] & ~edge[1:-2] & ~edge[2:-1]
        start = np.flatnonzero(cut | edge[:-1])
        end = np.append(start[1:], len(data)) if len(start) else start
        first = np.searchsorted(start, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        size = end - start
        lane, bounds = tx.lanes(data, start, size)
        hashes, at, place = np.unique(tx.lane_hashes(lane, bounds, size), return_index=True, return_inverse=True)
        codes = self._find(hashes)
        new = np.flatnonzero(codes < 0)
        if len(new):
            text, one = data.tobytes(), at[new]
            pieces = [text[a:b].decode() for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            self._learn(pieces, hashes[new], *tx.lanes(data, start[one], size[one]), size[one])
            codes = self._find(hashes)
        self.used[codes] = np.minimum(self.used[codes] + 1, 2)
        codes = codes[place]
        # bytes decide: the number, then all lanes
        other = size != self.size[codes]
        count = np.where(other, 0, np.diff(bounds))
        piece = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        other[piece[lane[bounds[piece] + step] != self.lane[self.lane_bounds[codes[piece]] + step]]] = True
        lengths = (self.bounds[codes + 1] - self.bounds[codes]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.bounds[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        cut = ends[first]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in np.unique(doc[other]).tolist():
            out[i] = np.array(self._whole(column[i].as_py()), np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path, special_as_text)


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [x.tobytes() for x in np.ascontiguousarray(rows.T)]
    return [np.packbits(x).tobytes() for x in np.ascontiguousarray(np.unpackbits(rows, axis=1, bitorder="little").T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.stack([np.frombuffer(x, np.uint8) for x in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in planes], 1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel().astype(np.uint32)


class Writer:
    """Blocks ids and writes one file; holds one block and the document index."""

    def __init__(self, out, p: Params) -> None:
        self.out, self.p = out, p
        self.pending: list[np.ndarray] = []
        self.n_pending = self.at = 0
        self.chunks: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.doc_counts: list[int] = []
        self.zstd = zstandard.ZstdCompressor(level=p.level)
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        begin, packed = self.at, [self.zstd.compress(x) for x in to_planes(ids, self.p.planes)]
        for x in packed:
            self._write(x)
        self.chunks.append([begin, len(ids), *map(len, packed)])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.doc_counts.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.p.block_ids:
            held = np.concatenate(self.pending)
            cut = len(held) - len(held) % self.p.block_ids
            for i in range(0, cut, self.p.block_ids):
                self._block(held[i : i + self.p.block_ids])
            self.pending, self.n_pending = [held[cut:]], len(held) - cut

    def close(self) -> None:
        if self.n_pending:
            self._block(np.concatenate(self.pending))
        chunks = np.array(self.chunks, "<i8").reshape(len(self.chunks), -1)
        null = np.array([x is None for x in self.doc_ids], "<i8")
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        head = np.array([len(chunks), chunks.shape[1], len(ids), self.p.block_ids], "<i8")
        index = self.zstd.compress(b"".join(x.tobytes() for x in (head, chunks, ids, null, np.array(self.doc_counts, "<i8"))))
        self._write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to one file through its chunk index."""

    def __init__(self, source, size: int) -> None:
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token plane file, or cut short")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        index = np.frombuffer(self.zstd.decompress(source.read(length)), "<i8")
        n, width, docs, self.block_ids = (int(x) for x in index[:4])
        self.chunks = index[4 : 4 + n * width].reshape(n, width)
        self.doc_ids, null, self.doc_counts = index[4 + n * width :].reshape(3, docs)
        self.doc_null = null.astype(bool)

    def block(self, k: int) -> np.ndarray:
        begin, n, *lengths = (int(x) for x in self.chunks[k])
        self.source.seek(begin)
        data, planes, at = self.source.read(sum(lengths)), [], 0
        for x in lengths:
            planes.append(self.zstd.decompress(data[at : at + x]))
            at += x
        return from_planes(planes, n)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file on."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * self.block_ids :][:n]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; one block is held at a time."""
        held, k = np.zeros(0, np.uint32), 0
        for n in self.doc_counts.tolist():
            parts = []
            while n > len(held):
                parts.append(held)
                n -= len(held)
                held, k = self.block(k), k + 1
            yield np.concatenate([*parts, held[:n]]) if parts else held[:n]
            held = held[n:]


def write(docs: DataFrame, folder: str, p: Params, text: str = "text") -> DataFrame:
    """Write the files of ``docs`` below ``folder``; returns the committed manifest.

    Documents are dealt by ranges of doc_id (nulls first), sorted, encoded,
    ended with ``end_id`` and written.  A null text counts as empty; repeated
    ids stay together, ordered by a hash of their text.  Manifest: file, bytes,
    first_id, n_docs, n_tokens, start (ids in all files before).  Other columns
    are ignored; an empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = None
        for batch in batches:
            for at, part in tx.slices(batch.column(1), p.slice_bytes):
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                if writer is None and ids:
                    context = TaskContext.get()
                    name = f"part-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.planes"
                    system, root = storage.open_fs(folder)
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    writer, first, total = Writer(out, p), ids[0], 0
                for doc_id, found in zip(ids, encoder(p.tokenizer, p.special_as_text).encode(part), strict=True):
                    found = np.append(found, np.uint32(p.end_id))
                    writer.add(doc_id, found)
                    total += len(found)
        if writer:
            writer.close()
            out.close()
            row = {"file": [name], "bytes": [writer.at], "first_id": [first], "n_docs": [len(writer.doc_ids)], "n_tokens": [total]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), *((x, pa.int64()) for x in list(row)[1:])]))

    own = docs.select("doc_id", F.col(text).alias("text"))
    dealt = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = storage.keep(dealt.mapInArrow(run, "file string, bytes long, first_id long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy(F.asc_nulls_first("first_id")).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of ``manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    reader = Reader(source, row["bytes"])
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in reader.documents()]
                start = row["start"] + np.cumsum(reader.doc_counts) - reader.doc_counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, mask=reader.doc_null), pa.array(start), pa.array(reader.doc_counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    files = manifest.select("file", "bytes", "start")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, p: Params) -> DataFrame:
    """Write ``docs`` to a scratch folder and read the documents back from the files."""
    folder = storage.scratch(docs.sparkSession, "planes")
    return read(write(docs, folder, p), folder)
