"""Repair of conversation structure by a grammar-compressed dynamic program.

A row is a symbol: the initial of its role, whether its text is cut off, and
whether it has to go (blank, or said before).  What the cheapest repair of a
stretch of symbols costs, and how it reads, depends only on the state of the
turn-taking before and after it, so a stretch is a 4 x 4 matrix over (min, +)
whose entries also carry the audit: the edits' initials, as a rope.

1. Rows are put in order by a range sort over conversation and turn, so that a
   long conversation spreads over many tasks, and written once.
2. Faults are flagged; repeated rows are found by an aggregation over their
   hashes.  The symbols of up to ``piece`` consecutive rows of a conversation
   make a piece.
3. Re-Pair over all pieces, weighted by how often each occurs: in every round
   the most frequent pairs that share no symbol become rules.  A rule's matrix
   is the product of its two sides', computed bottom-up once and used in all
   conversations.
4. A piece's matrix is the product of what is left of it under the rules; a
   conversation's is the product of its pieces'.  The audit is its entry from
   the start to a complete conversation; of equal costs the least text wins.
5. The audit is cut at the pieces and joined back to the rows.

The grammar only saves work: any grammar gives the same repair.

Order: by turn (nulls first), then role, then the text's first 32 characters
and its hash; repeated rows stand together.  Defined results: null roles and
texts are one space; a null conversation id is a conversation; null turns count
in no gap; roles of other initials than s, u and a can only be replaced or
deleted; columns other than the four are ignored, whatever their names; an empty
table gives an empty one.  A conversation's audit is one string, and its digest
one sequential hash: what streams through one task there is bounded in memory,
not in time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkwright.llm import storage

#: a row's symbol: role (o: another one), in upper case if cut off; x has to go
SYMBOLS = "suaoSUAOx"
#: nothing yet, after system, after user, after assistant
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
#: (state, initial of the row that comes) -> next state
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: what may be put at a state
NEEDS = ("u", "u", "a", "u")
LEGAL = ("su", "ua", "au")
NAME = {"u": "user", "a": "assistant"}

#: a string, or two ropes
Rope = object
Entry = tuple[int, Rope] | None
Matrix = list[Entry]


@dataclass(frozen=True)
class Params:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    #: rows that make a piece, at most (a power of two)
    piece: int = 256
    #: rounds of pairing and pairs in a round
    rounds: int = 8
    batch: int = 16

    def __post_init__(self) -> None:
        if self.rounds * self.batch + len(SYMBOLS) > 256 or self.rounds > 10 or self.piece & (self.piece - 1):
            raise ValueError("a symbol is a byte: rounds * batch + 9 is at most 256, rounds at most 10, piece a power of two")
        if min(self.rerole, self.delete, self.insert) <= 0 or self.truncated < 0:
            raise ValueError("edits have positive costs")


def flat(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += (x[1], x[0])
    return "".join(out)


def _better(a: Entry, b: Entry) -> Entry:
    """The cheaper entry; of equal costs the one whose audit is less."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return min(a, b, key=lambda x: x[0])
    return a if flat(a[1]) <= flat(b[1]) else b


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [None] * (STATES * STATES)
    for i in range(STATES):
        for k in range(STATES):
            if (a := x[i * STATES + k]) is not None:
                for j in range(STATES):
                    if (b := y[k * STATES + j]) is not None:
                        to = i * STATES + j
                        if out[to] is None or a[0] + b[0] <= out[to][0]:
                            out[to] = _better(out[to], (a[0] + b[0], (a[1], b[1])))
    return out


def identity() -> Matrix:
    return [(0, "") if i == j else None for i in range(STATES) for j in range(STATES)]


def balanced(found: Sequence[Matrix]) -> Matrix:
    """The product of all, in a tree of logarithmic depth."""
    found = list(found) or [identity()]
    while len(found) > 1:
        found = [product(found[i], found[i + 1]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0]


def inserts(p: Params) -> Matrix:
    """Any number of rows put in."""
    out = identity()
    for i in range(STATES):
        state, cost, audit = i, 0, ""
        for _ in range(STATES):
            state, cost, audit = STEP[state, NEEDS[state]], cost + p.insert, audit + "I"
            out[i * STATES + state] = _better(out[i * STATES + state], (cost, audit))
    return out


def terminal(symbol: str, p: Params) -> Matrix:
    """Rows put in before the row, and what is done with the row."""
    own: Matrix = [None] * (STATES * STATES)
    late = p.truncated if symbol.isupper() else 0
    for i in range(STATES):
        own[i * STATES + i] = (p.delete, "D")
        if symbol != "x":
            to = i * STATES + STEP[i, NEEDS[i]]
            own[to] = _better(own[to], (p.rerole + late, "R"))
            if (i, symbol.lower()) in STEP:
                to = i * STATES + STEP[i, symbol.lower()]
                own[to] = _better(own[to], (late, "K"))
    return product(inserts(p), own)


def closed(m: Matrix, p: Params) -> tuple[int, str]:
    """Cost and audit from the start to nothing or a complete conversation."""
    last = product(m, inserts(p))
    cost, rope = _better(last[START], last[ASSISTANT])
    return cost, flat(rope)


class Grammar:
    """Rules over bytes below 256: symbol ``len(SYMBOLS) + i`` stands for the pair ``rules[i]``."""

    def __init__(self, p: Params, rules: Sequence[tuple[int, int]] = ()) -> None:
        self.p, self.rules, self.matrices = p, list(rules), []
        self._codes = bytes.maketrans(SYMBOLS.encode(), bytes(range(len(SYMBOLS))))

    def compressed(self, piece: str) -> bytes:
        out = piece.encode().translate(self._codes)
        for i, (a, b) in enumerate(self.rules):
            if len(out) == 1:
                break
            out = out.replace(bytes((a, b)), bytes((len(SYMBOLS) + i,)))
        return out

    def matrix(self, piece: str) -> Matrix:
        """The piece's matrix, from those of the rules that it comes to."""
        if not self.matrices:
            self.matrices = [terminal(x, self.p) for x in SYMBOLS]
            for a, b in self.rules:
                m = product(self.matrices[a], self.matrices[b])
                self.matrices.append([x and (x[0], flat(x[1])) for x in m])
        return balanced([self.matrices[x] for x in self.compressed(piece)])


def learn(pieces: DataFrame, p: Params) -> Grammar:
    """A grammar of all ``pieces (seq, n)``.

    What a round brings to the driver are its ``batch * batch`` most frequent
    pairs; a pair of two equal symbols counts at all places where it stands.
    """
    grammar = Grammar(p)
    for _ in range(p.rounds):
        rules = list(grammar.rules)

        def count(batches: Iterator[pa.RecordBatch], rules: list[tuple[int, int]] = rules) -> Iterator[pa.RecordBatch]:
            own, total = Grammar(p, rules), np.zeros(1 << 16, np.int64)
            for batch in batches:
                for seq, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(own.compressed(seq), np.uint8).astype(np.int64)
                    np.add.at(total, x[:-1] * 256 + x[1:], n)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

        top = pieces.select("seq", "n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(p.batch * p.batch).collect()
        used: set[int] = set()
        new = []
        for row in top:
            a, b = divmod(row["pair"], 256)
            if row["n"] > 1 and not {a, b} & used and len(new) < p.batch:
                new.append((a, b))
                used |= {a, b}
        if not new:
            break
        grammar.rules += new
    return grammar


def ordered(rows: DataFrame) -> DataFrame:
    """The rows of all conversations in order, written once: conv_id, turn, role, text, their place ``at`` and what they look like."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "prefix", "hash", "row"]
    placed = plain.withColumn("prefix", F.substring("text", 1, 32)).withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    initial = F.substring("role", 1, 1)
    return storage.keep(
        placed.select(
            "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
            F.unhex(F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)).alias("same"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"),
        ),
        "turns",
    )


def flagged(turns: DataFrame) -> DataFrame:
    """``turns`` without texts, with the first fault of each row and its symbol."""
    repeats = storage.keep(turns.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"), "repeats")
    small = repeats.count() <= storage.BROADCAST_IDS // 4
    rows = turns.drop("role", "text").join(repeats.hint("broadcast") if small else repeats.hint("merge"), "same", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return rows.withColumn("fault", fault).select("conv_id", "turn", "at", "initial", "fault", symbol.alias("symbol"))


def pieces_of(rows: DataFrame, p: Params) -> DataFrame:
    """Up to ``piece`` neighbouring rows of a conversation as one: their places, symbols and initials."""
    group = F.floor(F.col("at") / p.piece).alias("block")
    own = rows.groupBy("conv_id", group).agg(F.sort_array(F.collect_list(F.struct("at", "symbol", "initial"))).alias("rows"))
    joined = lambda x: F.array_join(F.col(f"rows.{x}"), "")
    return storage.keep(own.select("conv_id", F.col("rows.at")[0].alias("first"), F.col("rows.at").alias("places"), joined("symbol").alias("seq"), joined("initial").alias("initials")), "pieces")


def solved(pieces: DataFrame, grammar: Grammar, p: Params) -> DataFrame:
    """conv_id, cost, audit, illegal and ``parts (first, state, edits)`` of each conversation of ``pieces``."""
    rules = list(grammar.rules)
    shape = "first long, n long, illegal long, ends string, costs array<int>, audits array<string>"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Grammar(p, rules), {}
        for batch in batches:
            costs, audits, illegal, ends = [], [], [], []
            for seq, initials in zip(batch.column("seq").to_pylist(), batch.column("initials").to_pylist(), strict=True):
                if seq not in known:
                    if len(known) >= 50_000:
                        known.clear()
                    m = own.matrix(seq)
                    known[seq] = [x and x[0] for x in m], [x and flat(x[1]) for x in m]
                costs.append(known[seq][0])
                audits.append(known[seq][1])
                illegal.append(sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1)))
                ends.append(initials[0] + initials[-1])
            n = [len(x) for x in batch.column("seq").to_pylist()]
            arrays = [pa.array(n, pa.int64()), pa.array(illegal, pa.int64()), pa.array(ends, pa.string()), pa.array(costs, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("first"), *arrays], ["conv_id", *(x.split()[0] for x in shape.split(", "))])

    key = pieces.schema["conv_id"]
    weighed = pieces.select("conv_id", "first", "seq", "initials").mapInArrow(weigh, StructType([key, *StructType.fromDDL(shape).fields]))
    own = weighed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "n", "illegal", "ends", "costs", "audits"))).alias("pieces"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("first", pa.int64()), ("state", pa.int32()), ("edits", pa.string())])
        for batch in batches:
            out: list[tuple] = []
            for found in batch.column("pieces"):
                found = found.as_py()
                matrices = [[None if c is None else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True)] for x in found]
                cost, audit = closed(balanced(matrices), p)
                ends = [x["ends"] for x in found]
                illegal = sum(x["illegal"] for x in found) + sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:]))
                out.append((cost, audit, illegal, cut(audit, [(x["first"], x["n"]) for x in found], matrices)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.list_(part)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], ["conv_id", "cost", "audit", "illegal", "parts"])

    parts = "cost long, audit string, illegal long, parts array<struct<first: long, state: int, edits: string>>"
    return storage.keep(own.mapInArrow(solve, StructType([key, *StructType.fromDDL(parts).fields])), "audits")


def cut(audit: str, pieces: list[tuple[int, int]], matrices: list[Matrix]) -> list[dict]:
    """The audit's part for each piece, and the state where it begins; the matrices tell to which state a part leads."""
    out, at, state = [], 0, START
    for (first, n), m in zip(pieces, matrices, strict=True):
        begin = at
        while n:
            n -= audit[at] != "I"
            at += 1
        edits = audit[begin:at]
        out.append({"first": first, "state": state, "edits": edits})
        state = next(j for j in range(STATES) if (x := m[state * STATES + j]) is not None and flat(x[1]) == edits)
    out[-1]["edits"] += audit[at:]
    return out


def edits_of(pieces: DataFrame, audits: DataFrame) -> DataFrame:
    """at, the roles of rows put in before, the edit, the role that replaces, the roles of rows put in after; of each row."""
    parts = audits.select(F.explode("parts").alias("x")).select("x.*")
    joined = pieces.select("first", "places", "initials").join(parts, "first").select("places", "initials", "state", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, before, edit, role, after = [], [], [], [], []
            for places, initials, state, edits in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                put: list[str] = []
                row = 0
                for x in edits:
                    if x == "I":
                        put.append(NAME[NEEDS[state]])
                        state = STEP[state, NEEDS[state]]
                        continue
                    at.append(places[row])
                    before.append(put)
                    edit.append(x)
                    role.append(NAME[NEEDS[state]] if x == "R" else None)
                    after.append([])
                    put = []
                    if x != "D":
                        state = STEP[state, NEEDS[state] if x == "R" else initials[row]]
                    row += 1
                if put:
                    after[-1] = put
            roles = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(before, roles), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(after, roles)], ["at", "before", "edit", "new_role", "after"])

    return joined.mapInArrow(run, "at long, before array<string>, edit string, new_role string, after array<string>")


@dataclass(frozen=True)
class Repair:
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation with a row
    summary: DataFrame
    #: conv_id, at, k, role and text of each row after the repair; (at, k) is their order in a conversation
    rows: DataFrame
    grammar: Grammar


def repair(conversations: DataFrame, params: Params | None = None) -> Repair:
    """Faults and the cheapest repair of ``conversations (conv_id, turn, role, text)``.

    The repaired roles' initials read ``(s?(ua)+)?``.  Keeping a row is free,
    giving it the role user or assistant, deleting it and putting in an empty
    one have their costs; blank and repeated rows must go, and cut-off rows
    that stay cost something.  ``audit`` has the edits' initials (K, R, D, I).
    """
    p = params or Params()
    turns = ordered(conversations)
    rows = storage.keep(flagged(turns), "flagged")
    pieces = pieces_of(rows, p)
    counted = storage.keep(pieces.groupBy("seq").agg(F.count("*").alias("n")), "sequences")
    grammar = learn(counted, p)
    audits = solved(pieces, grammar, p)
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated"))
    )
    of = audits.withColumnRenamed("conv_id", "_of")
    summary = counts.join(of, F.col("conv_id").eqNullSafe(F.col("_of"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    put = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    stays = F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))
    made = F.concat(put("before"), F.when(F.col("edit") != "D", F.array(stays)).otherwise(F.array().cast("array<struct<role: string, text: string>>")), put("after"))
    edits = edits_of(pieces, audits).where("edit <> 'D' or size(before) > 0 or size(after) > 0")
    fixed = turns.select("conv_id", "at", "role", "text").join(edits, "at").select("conv_id", "at", F.posexplode(made).alias("k", "r")).select("conv_id", "at", "k", "r.role", "r.text")
    storage.drop(counted)
    return Repair(summary, fixed, grammar)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, joined by newlines, of each conversation of ``Repair.rows``.

    Rows stream through in order, so a task holds none; each conversation is hashed by one task.
    """
    key = rows.schema["conv_id"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = rows.repartition(parts, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "at", "k").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], batch.column(0).type), pa.array([x[1] for x in done])], ["conv_id", "repaired_sha256"])
            kind = batch.column(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return stream.mapInArrow(run, StructType([key, *StructType.fromDDL("repaired_sha256 string").fields]))
