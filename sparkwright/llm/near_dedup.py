"""Near-duplicate documents by SuperMinHash.

1. One pass over the texts makes each document's set of word shingles, a
   128-bit digest of the set and a SuperMinHash signature: every shingle ranks
   the slots by its own random permutation, the rank is the leading part of
   the value it offers, so a document stops once every slot holds a value from
   an earlier rank.
2. Documents with equal digests are one class; only its smallest id goes on.
3. Bands of the signature are hashed into buckets.  Buckets with the same
   members (by two 64-bit hashes of all of them) are looked at once.
4. The members' full sets meet in tasks of some ``block`` documents or
   ``shingles`` shingles, with the bucket's leader; pairs are confirmed on the
   full sets and only a spanning forest of confirmed links leaves the task.
5. Where a bucket has more than one block, components are formed first.  If it
   has several, its members meet again by prefixes: of two similar sets, the
   shingles that come first in any one order, as many as may be missing and one
   more, have one in common.  With the rarest first, what pages of one template
   share is in no prefix, so only sets that share something rare are compared,
   and only if they are in different components; no link is lost.
6. Components come from a distributed contraction.

With 32 bands of 4 rows a pair at the threshold of 0.75 misses all buckets
with probability below 1e-5; everything after the buckets is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import storage
from sparkwright.llm import textops as tx
from sparkwright.llm.components import connected_components


@dataclass(frozen=True)
class Params:
    words: int = 5
    #: link where ``percent * union <= 100 * intersection``
    percent: int = 75
    bands: int = 32
    rows: int = 4
    block: int = 512
    #: shingles of a block, about
    shingles: int = 4_000_000
    #: cells that count how frequent a shingle is, which orders prefixes
    cells: int = 1 << 18

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def super_minhash(s: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, ``n_docs`` x ``m``, of the hashes ``s`` of each document.

    A value is the rank in its top bits and random bits below, so that lesser
    ranks win.  Documents without shingles keep the greatest value everywhere.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_docs * m, top)
    active = np.arange(len(s))
    perm = None
    step = tx.constants(2 * m, 31)
    for j in range(m):
        h, d = s[active], doc[active]
        low = tx.mix(h ^ step[2 * j]) >> tx.U64(12)
        k = j + (tx.mix(h ^ step[2 * j + 1]) % tx.U64(m - j)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(active))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, d * m + slot, low | (tx.U64(j) << tx.U64(52)))
        # a later rank can't lower a document whose slots all hold values up to this rank
        open_doc = (sig.reshape(n_docs, m) >> tx.U64(52)).max(1) > j
        stay = open_doc[d]
        if not stay.any():
            break
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.int16), (int(stay.sum()), 1))
            row, first = np.arange(len(perm)), k[stay]
            perm[row, first] = 0
            perm[:, 0] = first
        else:
            perm = perm[stay]
        active = active[stay]
    return sig.reshape(n_docs, m)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, digest (set_a, set_b) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tx.slices(batch.column(1)):
                n = len(part)
                s, doc, bounds = tx.shingles(tx.words(part, lower=True), p.words)
                sig = super_minhash(s, doc, n, p.slots)
                c = tx.constants(p.rows, 41)
                keys = np.zeros((n, p.bands), np.uint64)
                for j in range(p.rows):
                    keys += sig[:, j :: p.rows] * c[j]
                keys = tx.mix(keys.ravel() + np.tile(tx.constants(p.bands, 42), n)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.bands), pa.array(keys))
                digest = [tx.sums(tx.mix(s + tx.U64(x)), bounds).view(np.int64) for x in (51, 52)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(np.diff(bounds)), *map(pa.array, digest), lists],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id and the sorted 64-bit shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tx.slices(batch.column(1)):
                s, _, bounds = tx.shingles(tx.words(part, lower=True), p.words)
                off = pa.py_buffer((bounds * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.Array.from_buffers(pa.binary(), len(part), [None, off, pa.py_buffer(s.tobytes())])],
                    ["doc_id", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def forest(ids: np.ndarray, side: np.ndarray, group: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of one task.

    Two sets are compared if at least one has ``side`` true and their known
    ``group`` differs.  Each set with ``side`` is counted against all others at
    once through a list of who has each shingle.
    """
    n = len(sets)
    parent = list(range(n))
    known: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, g in enumerate(group.tolist()):
        parent[find(i)] = find(known.setdefault(g, i))
    size = np.array([len(x) for x in sets], np.int64)
    out: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append((int(ids[i]), int(ids[j])))

    if n <= 3:
        for i in range(n):
            for j in range(i):
                if (side[i] or side[j]) and find(i) != find(j) and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        link(i, j)
        return out
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(code, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(n)
    for i in np.flatnonzero(side).tolist():
        c = code[at[i] : at[i + 1]]
        c = c[count[c] > 1]
        if not len(c):
            continue
        lengths = count[c]
        first = np.repeat(begin[c] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        both = np.bincount(holders[first + np.arange(len(first))], minlength=n)
        # of two sets with side, the later one looks at the earlier
        hits = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & ((place < i) | ~side) & (place != i))
        for j in hits.tolist():
            link(i, j)
    return out


def _confirm(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in ``tasks (task, doc_id, side, grp)``."""

    def solve(block: pa.Table) -> list[tuple[int, int]]:
        raw = block.column("shingles").to_pylist()
        return forest(block.column("doc_id").to_numpy(), block.column("side").to_numpy(), block.column("grp").to_numpy(), [np.frombuffer(x, np.uint64) for x in raw], percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the task that may go on in the next batch
        for batch in batches:
            task = batch.column(0).to_numpy()
            cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
            if held and len(task) and held[0].column(0)[0].as_py() != task[0]:
                cuts = np.concatenate([[0], cuts])
            links: list[tuple[int, int]] = []
            begin = 0
            for cut in cuts.tolist():
                held.append(batch.slice(begin, cut - begin))
                links += solve(pa.Table.from_batches(held))
                held, begin = [], cut
            held.append(batch.slice(begin))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held:
            links = solve(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tasks.join(sets, "doc_id").select("task", "doc_id", "side", "grp", "shingles")
    return rows.repartition(parts, "task").sortWithinPartitions("task", "doc_id").mapInArrow(run, "a long, b long")


def _blocks(p: Params) -> Column:
    return F.greatest(F.ceil(F.col("n") / p.block), F.ceil(F.col("mass") / p.shingles)).cast("int")


def _sized_hint(table: DataFrame) -> DataFrame:
    """A table of ``keep`` with a row a group: broadcast up to a counted limit, merged beyond it."""
    return table.hint("broadcast") if table.count() <= storage.BROADCAST_IDS // 4 else table.hint("merge")


def _frequency(sets: DataFrame, cells: int) -> np.ndarray:
    """How often the shingles of each cell stand in ``sets``: ``cells`` numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, part in tx.slices(batch.column(0)):
                cell = tx.raw(part)[0].view(np.uint64) & np.uint64(cells - 1)
                total += np.bincount(cell.astype(np.int64), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = sets.select("shingles").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, often: np.ndarray, p: Params) -> DataFrame:
    """shingle, doc_id, grp and n_shingles for each shingle in the prefix of each of ``sets (doc_id, grp, shingles)``."""
    frequency = sets.sparkSession.sparkContext.broadcast(often.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(frequency.value, np.int64)
        for batch in batches:
            for at, part in tx.slices(batch.column(2)):
                data, offsets = tx.raw(part)
                s, bounds = data.view(np.uint64), offsets >> 3
                size = np.diff(bounds)
                take = np.where(size > 0, size - -(-size * p.percent // 100) + 1, 0)
                doc = np.repeat(np.arange(len(size)), size)
                # each document's shingles, the rarest first, and of these its prefix
                order = np.lexsort((s, often[(s & np.uint64(len(often) - 1)).astype(np.int64)], doc))
                kept = order[np.arange(len(s)) - bounds[doc] < take[doc]]
                row = pa.array(doc[kept] + at)
                yield pa.RecordBatch.from_arrays([pa.array(s[kept].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(size[doc[kept]])], ["shingle", "doc_id", "grp", "n_shingles"])

    return sets.select("doc_id", "grp", "shingles").mapInArrow(run, "shingle long, doc_id long, grp long, n_shingles long")


def rest_tasks(open_: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Tasks (task, doc_id, side, grp) in which all similar documents of ``open_ (doc_id, grp)`` meet that are in different groups.

    Documents of one prefix shingle are a task, if they have several groups.
    Very many of them are dealt to blocks, and what is outside the largest
    group, in as few parts as its number asks for, meets all blocks.
    """
    held = storage.keep(sets.join(open_, "doc_id").select("doc_id", "grp", "shingles"), "open")
    first = storage.keep(prefixes(held, _frequency(held, p.cells), p), "prefixes")
    members = (F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"members_{i}") for i in (1, 2))
    shared = first.groupBy("shingle").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("mass"), F.min("grp").alias("lo"), F.max("grp").alias("hi"), *members).where("n > 1 and lo <> hi")
    shared = storage.keep(shared.groupBy("n", "mass", "members_1", "members_2").agg(F.min("shingle").alias("shingle")).select("shingle", _blocks(p).alias("blocks")), "shared")
    met = storage.keep(first.join(_sized_hint(shared), "shingle").select(F.col("shingle").alias("key"), "doc_id", "grp", "blocks"), "met")
    for x in (held, first):
        storage.drop(x)
    tasks = met.where("blocks = 1").select(F.xxhash64("key").alias("task"), "doc_id", F.lit(True).alias("side"), "grp")
    large = met.where("blocks > 1")
    if large.isEmpty():
        return tasks
    most = large.groupBy("key", "grp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "grp")).alias("top"), F.sum("n").alias("n"))
    most = storage.keep(most.select("key", F.col("top.grp").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / p.block).cast("int").alias("parts")), "most")
    known = storage.keep(large.join(_sized_hint(most), "key"), "large")
    rest = known.where("grp <> main").withColumn("row", F.pmod(F.xxhash64("doc_id", F.lit(1)), "parts"))
    rows = rest.select("key", "row", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("col"), "doc_id", F.lit(True).alias("side"), "grp")
    used = rest.select("key", "row").distinct()
    cols = known.withColumn("col", F.pmod(F.xxhash64("doc_id", F.lit(2)), "blocks").cast("int")).join(used, "key").select("key", "row", "col", "doc_id", F.lit(False).alias("side"), "grp")
    grid = rows.union(cols).groupBy("key", "row", "col", "doc_id", "grp").agg(F.max("side").alias("side"))
    return tasks.union(grid.select(F.xxhash64("key", "row", "col").alias("task"), "doc_id", "side", "grp"))


def cluster(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs (doc_id, text)``.

    A null or empty text, or one without words, has an empty set and links with
    nothing.  A row with a null id links with nothing, its component is null
    and it is kept.  Repeated rows give equal results.  Other columns are
    ignored; an empty table gives an empty one.
    """
    p = params or Params()
    sigs = storage.keep(signatures(docs, p), "signatures")
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    digest = ["n_shingles", "set_a", "set_b"]
    classes = storage.keep(some.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "bands"))["bands"].alias("bands")), "classes")

    placed = classes.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("bands").alias("key"))
    buckets = (
        placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("mass"), F.min("doc_id").alias("leader"), *(F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"members_{i}") for i in (1, 2)))
        .where("n > 1").groupBy("n", "mass", "leader", "members_1", "members_2").agg(F.min("key").alias("key"))
        .withColumn("blocks", _blocks(p))
    )
    inside = storage.keep(placed.join(buckets, "key").select("key", "doc_id", "leader", "blocks", F.pmod(F.xxhash64("doc_id", "key"), "blocks").cast("int").alias("block")), "inside")
    involved = inside.select("doc_id")
    sets = storage.keep(full_sets(storage.by_ids(docs.select("doc_id", "text"), involved, "doc_id", "left_semi"), p), "sets")

    own = inside.select(F.xxhash64("key", "block").alias("task"), "doc_id")
    led = inside.where("blocks > 1").select(F.xxhash64("key", "block").alias("task"), F.col("leader").alias("doc_id")).distinct()
    tasks = own.union(led).select("task", "doc_id", F.lit(True).alias("side"), F.col("doc_id").alias("grp"))
    links = storage.keep(_confirm(tasks, sets, p.percent), "links")
    groups = storage.keep(connected_components(links), "groups")

    large = inside.where("blocks > 1")
    if not large.isEmpty():
        named = storage.keep(large.join(groups, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("grp")), "named")
        several = storage.keep(named.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("key"), "several")
        open_ = storage.keep(named.join(_sized_hint(several), "key").select("doc_id", "grp").distinct(), "open_ids")
        extra = _confirm(rest_tasks(open_, sets, p), sets, p.percent)
        first, old = links, groups
        links = storage.keep(links.union(extra), "links")
        groups = storage.keep(connected_components(links), "groups")
        for x in (first, old, named, open_):
            storage.drop(x)
    for x in (sets, inside, links):
        storage.drop(x)

    named = classes.select(*digest, "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(*digest, F.coalesce("component_id", "rep").alias("component_id"))
    linked = some.select("doc_id", *digest).join(named, digest).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, without near copies: of each group the row with the smallest id stays.

    Every row is judged by itself, also where its id is null or repeated: null
    ids come after all others, and of equal ids the row that is first in its
    file stays.  Rows without words are no copies of each other.
    """
    spark = docs.sparkSession
    (row,) = storage.fresh(docs, "row")
    rows = storage.keyed(docs, row)
    with storage.temporary(spark) as stays:
        found = storage.keep(cluster(rows.select(F.col(row).alias("doc_id"), "text"), params).where("n_shingles > 0").select("doc_id", "component_id"), "found")
        # a group of very many copies: its key is aggregated map-side, written, and joined apart from that
        several = storage.keep(found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "several")
        ids = rows.select(F.col(row).alias("doc_id"), F.struct(F.col("`doc_id`").isNull().alias("none"), F.col("`doc_id`").alias("id"), F.col(row).alias("at")).alias("order"))
        named = storage.keep(found.join(_sized_hint(several), "component_id").join(ids, "doc_id"), "named")
        first = storage.keep(named.groupBy("component_id").agg(F.min("order").alias("first")), "first")
        gone = storage.keep(named.join(_sized_hint(first), "component_id").where("order <> first").select(F.col("doc_id").alias(row)), "gone")
        stays.append(gone)
    return storage.by_ids(rows, gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
