"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by its content (SHA-256 of the UTF-8
text).  The ledger is a table in the shared folder with one row for each blob
and version of the rules: the findings of that pair, also where there are none.
An update

1. addresses all versions, without moving a text;
2. leaves out the pairs that the ledger has, and takes of each other blob one
   version (the least by a hash of its path and version) for the scan;
3. scans the chosen texts where they lie, and appends the findings;
4. joins the ledger back to all versions by address.

A text is therefore scanned once for each version of the rules, in however many
paths, versions and earlier updates it stands.  Blobs with findings are
broadcast up to a counted limit and joined by shuffle beyond it, where adaptive
execution splits a blob that very many paths hold.  The ledger is only ever
appended to by Spark's committer; a pair that two writers scanned at a time is
there twice with the same findings and counts once.

Defined results: a null text counts as empty; paths and versions may be null or
repeat, and every input row gives one row; other columns are ignored, whatever
their names; an empty table gives an empty one and scans nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import storage

SPAN = "struct<kind: string, begin: long, end: long>"
LEDGER = f"rules string, blob binary, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    #: a text without any of these (in lower case) can't match
    hints: Sequence[str] = ()
    #: ``pattern`` holds the least length itself and finds the same matches, sooner
    exact: bool = False


#: the kinds that every scan has, in the order of ties
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", exact=True),
)
#: further kinds: key blocks, signed web tokens, personal access tokens, and passwords in addresses
MORE = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", hints=("eyj",)),
    Rule("access_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")),
    Rule("address_password", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", hints=("://",)),
)


@dataclass(frozen=True)
class RuleSet:
    version: str = "1"
    rules: Sequence[Rule] = BASE + MORE

    @property
    def kinds(self) -> list[str]:
        return [r.kind for r in self.rules]


def scan(text: str, rules: RuleSet) -> list[tuple[int, int, int]]:
    """(begin, place of the kind, end) of every match in code points, in this order."""
    low, out = text.lower(), []
    for k, rule in enumerate(rules.rules):
        if rule.hints and not any(x in low for x in rule.hints):
            continue
        for m in re.finditer(rule.pattern, text):
            begin, end = m.span(rule.group)
            if rule.exact or end - begin >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def addressed(versions: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """``columns``, the text, its address, and a hash of all of these that tells rows apart."""
    blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return versions.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"), blob.alias("_blob")).withColumn("_version", F.xxhash64(*columns, "_blob"))


class Ledger:
    """The ledger at ``path``; a new one where nothing is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def pairs(self, rules: RuleSet) -> DataFrame:
        """blob and spans of every pair with this version of the rules."""
        try:
            seen = self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            seen = self.spark.createDataFrame([], LEDGER)
        return seen.where(F.col("rules") == rules.version).select("blob", "spans")

    def unseen(self, versions: DataFrame, rules: RuleSet) -> DataFrame:
        """One row of ``versions (_version, _blob)`` for each blob without a pair."""
        first = versions.groupBy("_blob").agg(F.min("_version").alias("_version"))
        return first.join(self.pairs(rules).select(F.col("blob").alias("_blob")), "_blob", "left_anti")

    def update(self, versions: DataFrame, rules: RuleSet | None = None, columns: Sequence[str] = ("path", "version"), text: str = "text") -> int:
        """Scan what is new in ``versions`` and append it; returns the number of blobs that were scanned."""
        rules = rules or RuleSet()
        rows = addressed(versions, columns, text)
        chosen = storage.keep(self.unseen(rows.select("_version", "_blob"), rules), "unseen")
        n = chosen.count()
        if n:
            held = storage.by_ids(rows, chosen, "_version", "left_semi").select("_blob", "_text")
            # one row a pair, also where rows are repeated or their hashes are equal
            found = _scanned(held, rules).groupBy("blob").agg(F.first("spans").alias("spans"))
            found.select(F.lit(rules.version).alias("rules"), "blob", "spans").write.mode("append").parquet(self.path)
        storage.drop(chosen)
        return n

    def findings(self, versions: DataFrame, rules: RuleSet | None = None, columns: Sequence[str] = ("path", "version"), text: str = "text") -> DataFrame:
        """``columns`` of every row of ``versions`` and the spans of its text, by begin, then kind as listed.

        Rows whose blob has not been scanned with these rules have null spans.
        """
        rules = rules or RuleSet()
        rows = storage.keep(addressed(versions, columns, text).drop("_text", "_version"), "addressed")
        pairs = self.pairs(rules).groupBy("blob").agg(F.first("spans").alias("_spans"))
        held = storage.keep(pairs.where(F.size("_spans") > 0), "held")
        empty = F.array().cast(f"array<{SPAN}>")
        small = held.count() <= storage.BROADCAST_IDS // 8
        out = rows.join(held.hint("broadcast") if small else held.hint("merge"), F.col("_blob") == F.col("blob"), "left")
        missing = storage.keep(self.unseen(rows.withColumn("_version", F.lit(0)), rules).select("_blob"), "missing")
        if missing.isEmpty():
            return out.select(*columns, F.coalesce("_spans", empty).alias("spans"))
        gone = missing.select(F.col("_blob").alias("_gone"))
        return out.join(gone, F.col("_blob") == F.col("_gone"), "left").select(*columns, F.when(F.col("_gone").isNull(), F.coalesce("_spans", empty)).alias("spans"))


def _scanned(blobs: DataFrame, rules: RuleSet) -> DataFrame:
    """blob and spans of ``blobs (_blob, _text)``."""
    kinds = rules.kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": kinds[k], "begin": a, "end": b} for a, k, b in scan(text.as_py(), rules)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["blob", "spans"])

    return blobs.select("_blob", "_text").mapInArrow(run, f"blob binary, spans array<{SPAN}>")


def joined(spans: Column | str) -> Column:
    """``kind:begin:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
