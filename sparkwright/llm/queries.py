"""The registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import conversation_repair, decontaminate, kneser_ney, language_id, near_dedup, periodic, quality_model, repetition, secret_ledger, source_mix, storage, token_planes, url_rules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = url_rules.Params(
    (
        url_rules.Rule("allow", "org", "/"),
        url_rules.Rule("block", "example.org", "/es/"),
        url_rules.Rule("block", "example.org", "/en/1"),
        url_rules.Rule("allow", "com", "/fr/"),
        url_rules.Rule("block", "com", "/de/"),
    )
)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _held_out(4, 2)
    model = language_id.train(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _held_out(5, 0)
    weights = quality_model.train(docs, _table(spark, sf_dir, "labels").where(~held))
    return quality_model.score(docs, weights).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _held_out(7, 2)
    model = kneser_ney.train(docs.where(~held))
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return kneser_ney.score(docs, model).select("doc_id", held.alias("held_out"), *columns)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return repetition.measure(_table(spark, sf_dir, "documents")).select(*columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(_table(spark, sf_dir, "documents"), token_planes.Params(tokenizer_path()))


def _tiled(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents, by their id's hash, the words from some place on repeat a pattern."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(source_mix.WORD), F.lit(0))).alias("words")).withColumn("n", F.size("words"))
    placed = chosen.withColumn("a", (F.col("g") % F.when(F.col("n") > 0, F.col("n"))).cast("int")).withColumn("left", F.col("n") - F.col("a"))
    placed = placed.withColumn("p", (1 + F.floor(F.col("left") / (3 + F.col("g") % 8))).cast("int"))
    pattern = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(F.col("left") / F.col("p")).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), pattern), F.lit(1), F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(_tiled(_table(spark, sf_dir, "documents")))
    first = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    found = found.withColumn("best", F.aggregate("runs", F.lit(None).cast(periodic.RUN), first))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = _table(spark, sf_dir, "documents"), secret_ledger.RuleSet()
    ledger = secret_ledger.Ledger(spark, storage.scratch(spark, "ledger"))
    ledger.update(docs, rules, ["doc_id"])
    base = [r.kind for r in secret_ledger.BASE]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return ledger.findings(docs, rules, ["doc_id"]).select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(secret_ledger.joined(of(*base)), 256).alias("base_sha256"), secret_ledger.joined("spans").alias("spans"),
    )


def _damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with a quarter of its rows damaged by the hash of their place; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(_damaged(turns))
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    every = turns.select("conv_id").distinct()
    every = every.join(named(found.summary, "_s"), F.col("conv_id").eqNullSafe(F.col("_s")), "left").join(named(conversation_repair.digests(found.rows), "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_minhash_dedup, op3_url_filter, op4_language_id, op5_quality_model, op6_source_mix, op7_kneser_ney, op8_repetition, op9_decontaminate, op10_token_planes, op11_periodic_runs, op12_secret_ledger, op13_conversation_repair)
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
o as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from o
"""

_OP2 = f"""
with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
             else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select c.a, c.b from c join n na on na.doc_id = c.a join n nb on nb.doc_id = c.b where 100 * shared >= 75 * (na.n + nb.n - shared)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as component_id from r group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d left join n using (doc_id) join m on m.a = d.doc_id
"""


def _covered(n: int, later: bool) -> str:
    """Words in n-word windows seen before in the text (or seen twice or more), one row a word."""
    which = "rn > 1" if later else "k > 1"
    return f"""select distinct doc_id, i + j as i from (
  select doc_id, i, row_number() over (partition by doc_id, g order by i) as rn, count(*) over (partition by doc_id, g) as k
  from (select doc_id, unnest(range(1, len(ws) - {n - 2})) as i, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda x: array_to_string(ws[x:x + {n - 1}], ' '))) as g
        from w where len(ws) >= {n})) t, unnest(range(0, {n})) as u(j) where {which}"""


_GRAMS = {5: 0.30, 8: 0.25, 10: 0.20}
_OP8 = f"""
with w as (select doc_id, coalesce(text, '') as text, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
q as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(list_transform(ws, lambda x: length(x))) as chars from w),
t as (select doc_id, count(*) as n_words, sum(chars) as word_chars from q group by doc_id),
ln as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k, unnest(string_split(text, chr(10))) as line from w),
ld as (select doc_id, count(*) as n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) as line_chars
       from (select *, row_number() over (partition by doc_id, line order by k) as rn from ln where regexp_matches(line, '[^\\x20\\x09-\\x0D]')) where rn > 1 group by doc_id),
rep as (select doc_id, count(*) as n from ({_covered(8, False)}) group by doc_id),
{', '.join(f"c{n} as (select doc_id, sum(chars) as chars from ({_covered(n, True)}) join q using (doc_id, i) group by doc_id)" for n in _GRAMS)},
f as (
  select w.doc_id, coalesce(t.n_words, 0) as n_words, coalesce(t.word_chars, 0) as word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(ld.n_dup_lines, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
         coalesce(ld.line_chars, 0) > 0.30::double * greatest(coalesce(t.word_chars, 0), 1)
         {' '.join(f"or coalesce(c{n}.chars, 0) > {x}::double * greatest(coalesce(t.word_chars, 0), 1)" for n, x in _GRAMS.items())} as bad
  from w left join t using (doc_id) left join ld using (doc_id) left join rep using (doc_id) {' '.join(f"left join c{n} using (doc_id)" for n in _GRAMS)})
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not bad as kept
from f
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the whole result."""
    return {"op1_warc": _OP1, "op2_minhash_dedup": _OP2, "op8_repetition": _OP8}
