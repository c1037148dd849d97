"""Names of many projects, looked for in many texts at once.

``terms`` is (project_id, kind, place, term) with the kinds brand, alias,
competitor and domain, in the order of ``place``.  Texts and terms are cut into
pieces, words and what is between them in turn.  A term stands in a text where
its pieces follow one another there; it is looked up by its first piece, in
one hash join of all texts with all terms of their projects, and the pieces
that follow are compared beside it.  No pattern is made for a term, so
thousands of projects with names of their own are one plan.

An end of a term is a word boundary: a term that begins or ends with other
characters than (ASCII) letters, digits and ``_`` needs a word beside it.  Terms
with CJK characters, and domains, count anywhere in a text.  Letters of both
cases are equal.  Empty terms, and texts that are null, match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import expr as E
from sparkwright.functions.lexicons import Lexicon
from sparkwright.operators.probes import PLAIN
from sparkwright.sources.shared import settle

CJK = "[一-鿿぀-ヿ가-힯]"
_EDGE = "(?<=[a-z0-9_])(?=[^a-z0-9_])|(?<=[^a-z0-9_])(?=[a-z0-9_])"
#: terms that may be sent to every executor: some 30 MB
BROADCAST_TERMS = 200_000
#: terms of one project that each of its texts may be searched for one by one
FEW_TERMS = 64


def pieces(text: Column) -> Column:
    return F.split(F.lower(text), _EDGE)


def _wordy(piece: Column) -> Column:
    return piece.rlike("^[a-z0-9_]")


def found(texts: DataFrame, terms: DataFrame, key: Sequence[str]) -> DataFrame:
    """The columns of ``terms (project_id, term, part, ...)`` with ``key`` of the texts where each stands, once each.

    ``texts`` is (project_id, text) and ``key``; a term with ``part`` may stand
    inside a word.  The terms are counted: up to ``BROADCAST_TERMS`` they are
    broadcast and no text moves; beyond that both sides are dealt by project
    and first piece.
    """
    own = terms.where("term <> ''").withColumn("_p", pieces(F.col("term")))
    size = own.agg(F.count("*").alias("n"), F.max(F.size("_p")).alias("longest")).first()
    hinted = (lambda df: df.hint("broadcast")) if size["n"] <= BROADCAST_TERMS else (lambda df: df.hint("merge"))
    longest = size["longest"] or 1
    own = own.withColumnRenamed("project_id", "_project")
    p = F.col("_pieces")
    shifted = F.arrays_zip(*(F.slice(p, j + 1, F.greatest(F.size(p) - j, F.lit(0))).alias(f"p{j}") for j in range(longest + 1)))
    cut = texts.where("text is not null").select("project_id", *key, pieces(F.col("text")).alias("_pieces"))
    windows = cut.select("project_id", *key, F.posexplode(shifted).alias("_at", "_w"))
    words = hinted(own.where("not part").withColumns({"_first": F.col("_p")[0], "_n": F.size("_p")}))
    joined = windows.join(words, (F.col("project_id") == F.col("_project")) & (F.col("_w.p0") == F.col("_first")))
    same = F.lit(True)
    for j in range(1, longest):
        same = same & ((F.col("_n") <= j) | (F.col(f"_w.p{j}") == F.try_element_at("_p", F.lit(j + 1))))
    after = F.element_at(F.array(*(F.col(f"_w.p{j}") for j in range(1, longest + 1))), F.col("_n"))
    at_word = (_wordy(F.col("_first")) | (F.col("_at") > 0)) & (_wordy(F.element_at("_p", -1)) | after.isNotNull())
    columns = [*key, *(c for c in terms.columns if c not in key)]
    whole = joined.where(same & at_word).select(*columns)
    parts = texts.where("text is not null").join(hinted(own.where("part")), F.col("project_id") == F.col("_project")).where(F.contains(F.lower("text"), F.lower("term"))).select(*columns)
    return whole.union(parts).distinct()


def _stands(text: Column) -> Column:
    """Whether the term of a row with ``_low`` and ``_pattern`` stands in a text in lower case; looking for its letters first spares most texts the pattern."""
    return F.contains(text, F.col("_low")) & (F.col("part") | F.rlike(text, F.col("_pattern")))


def standing(texts: DataFrame, terms: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``texts`` with each term that ``found`` finds in them, ``_low`` and ``_pattern``.

    Where no project has more than ``FEW_TERMS``, each text is asked for its
    project's terms as it is, which costs less than cutting it into pieces;
    else by ``found``.
    """
    edge = lambda at, inside, outside: F.when(_wordy(F.substring("_low", at, 1)), inside).otherwise(outside)
    quoted = F.concat(F.lit("\\Q"), F.col("_low"), F.lit("\\E"))  # in lower case, so without an end of the quotation
    own = terms.where("term <> ''").withColumn("_low", F.lower("term")).withColumn("_pattern", F.concat(edge(1, "(?<![a-z0-9_])", "(?<=[a-z0-9_])"), quoted, edge(-1, "(?![a-z0-9_])", "(?=[a-z0-9_])")))
    per = own.groupBy("project_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    some = texts.where("text is not null")
    if (per["most"] or 0) > FEW_TERMS:
        columns = [c for c in terms.columns if c != "project_id"]
        marks = own.select("project_id", *columns, "_low", "_pattern").distinct()
        return some.join(found(texts, terms, key).join(marks, ["project_id", *columns]), ["project_id", *key])
    own = own.hint("broadcast") if (per["n"] or 0) <= BROADCAST_TERMS else own
    return some.withColumn("_text", F.lower("text")).join(own, "project_id").where(_stands(F.col("_text"))).drop("_text")


def _looked_for(terms: DataFrame) -> DataFrame:
    """Each term as it counts for presence (``named``) and, of the brand, for the feeling of a sentence (``felt``), where only plain words need boundaries."""
    cjk, domain = F.col("term").rlike(CJK), F.col("kind") == "domain"
    named = terms.select("project_id", "kind", "place", F.when(domain, E.norm_domain(F.col("term"))).otherwise(F.col("term")).alias("term"), F.lit("named").alias("sense"), (cjk | domain).alias("part"))
    felt = terms.where("kind in ('brand', 'alias')").select("project_id", "kind", "place", "term", F.lit("felt").alias("sense"), (~F.col("term").rlike(f"(?i)^{PLAIN}$")).alias("part"))
    return named.union(felt)


def parse(answers: DataFrame, terms: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """``answers (project_id, evidence_id, answer_text, ...)`` with brand_present, competitors, sentiment, hedged and unknown_admission, each by its own project's terms.

    What ``probes.parse`` finds for one site.  An answer is known by its
    evidence_id.  Answers of projects without terms name nothing.
    """
    lex = lex or Lexicon()
    wanted = settle(_looked_for(terms), "terms")
    text = F.coalesce("answer_text", F.lit(""))
    texts = answers.select("project_id", "evidence_id", text.alias("text"))
    named, felt, own = F.col("sense") == "named", F.col("sense") == "felt", F.col("kind") != "competitor"
    # a term stands in a sentence only if it stands in its text, so the rows of the texts are all that sentences are asked for
    told = standing(texts, wanted, ["evidence_id"]).withColumn("mine", F.when(F.col("kind").isin("brand", "alias"), F.filter(E.sentences(F.col("text")), lambda s: _stands(F.lower(s)))))
    some = lambda sense, cond: F.coalesce(F.bool_or(sense & F.exists("mine", cond)), F.lit(False))
    hits = told.groupBy("evidence_id").agg(
        F.bool_or(named & own).alias("brand_present"), F.sort_array(F.collect_set(F.when(named & ~own, F.struct("place", "term")))).alias("rivals"),
        some(named, lambda s: E.hits_any(s, lex.hedges)).alias("hedged"), some(felt, lambda s: E.hits_any(s, lex.comparisons, PLAIN)).alias("compared"), some(felt, lambda s: E.hits_any(s, lex.negatives, PLAIN)).alias("negative"),
        some(felt, lambda s: E.hits_any(s, lex.positives, PLAIN) & ~E.hits_any(s, lex.negations, PLAIN)).alias("positive"),
    )
    present = F.coalesce("brand_present", F.lit(False))
    sentiment = F.when(~present, "neutral").when(F.col("compared"), "comparison").when(F.col("negative"), "negative").when(F.col("positive"), "positive").otherwise("neutral")
    rest = [c for c in answers.columns if c not in ("brand_present", "competitors", "sentiment", "hedged", "unknown_admission")]
    admits = answers.select(*rest, E.hits_any(text, lex.admissions).alias("unknown_admission"))
    return admits.join(hits, "evidence_id", "left").select(
        *rest, present.alias("brand_present"), F.coalesce(F.transform("rivals", lambda r: r["term"]), F.array().cast("array<string>")).alias("competitors"), sentiment.alias("sentiment"),
        F.coalesce("hedged", F.lit(False)).alias("hedged"), "unknown_admission",
    )


def share_of_voice(samples: DataFrame, terms: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Percent of each project's samples that name its brand (ordinal 0) and each of its competitors, zeros included.

    ``by`` starts with project_id.  A name that a project has twice counts once, at its first place.
    """
    totals = samples.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("brand_present").alias("own"))
    said = samples.select(*by, F.explode("competitors").alias("name")).groupBy(*by, "name").agg(F.count("*").alias("c"))
    names = terms.where("kind = 'competitor' and term <> ''").groupBy("project_id", F.col("term").alias("name")).agg(F.min("place").alias("ordinal"))
    rivals = totals.join(names, "project_id").join(said, [*by, "name"], "left").select(*by, "n", "name", F.lit(False).alias("you"), "ordinal", F.coalesce("c", F.lit(0)).alias("c"))
    brand = terms.where("kind = 'brand' and term <> ''").groupBy("project_id").agg(F.min_by("term", "place").alias("name"))
    mine = totals.join(brand, "project_id").select(*by, "n", "name", F.lit(True).alias("you"), F.lit(0).alias("ordinal"), F.col("own").alias("c"))
    return mine.unionByName(rivals).select(*by, F.col("n").alias("samples"), "name", "you", F.col("ordinal").cast("int").alias("ordinal"), E.js_round(F.col("c") / F.col("n") * 100).cast("long").alias("pct"))
