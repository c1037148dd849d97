"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import components, decontaminate, kneser_ney, language_id, near_dedup, quality_model, repetition, source_mix, storage, token_planes, url_rules, warc
from sparkwright.llm import textops as tx
from sparkwright.llm.queries import URL_RULES, tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def docs_of(spark, texts, first=0, lang="en", source="s"):
    rows = [(first + i, t, lang, source, 1, True, 0.0, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages and odd cases."""
    rng = random.Random(5)
    vocabulary = ["w" + str(i) for i in range(400)] + ["É", "ß.", "the", "And", "x|y"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t\n", "one", "one", "a b c d", "A b  c\nd", "word " * 30, "😀 é ü"]
    passage = make(60)
    for i in range(60):
        texts.append(" ".join(make(rng.randint(3, 120))))
        if i % 4 == 0:
            base = make(90)
            texts.append(" ".join(base))
            for k in (1, 2, 4, 6):
                near = list(base)
                for _ in range(k):
                    near[rng.randrange(90)] = rng.choice(vocabulary)
                texts.append("\n".join(near))
            texts.append(" ".join(base))
        if i % 5 == 0:
            texts.append(" ".join(make(20) + passage + make(20)))
    texts.append(" ".join(make(20_000)))
    return texts


def test_words_and_hashes(corpus):
    column = pa.array(corpus, pa.string())
    w = tx.words(column, lower=True)
    want = [WORD.findall(low(t)) for t in corpus]
    assert w.counts.tolist() == [len(x) for x in want]
    h = tx.word_hashes(w).tolist()
    flat = [x for y in want for x in y]
    assert len(set(zip(flat, h, strict=True))) == len(set(flat)) == len(set(h))
    parts = [(at, len(p)) for at, p in tx.slices(column, 500)]
    assert sum(n for _, n in parts) == len(corpus) and parts[0][0] == 0
    assert tx.words(pa.array([], pa.string())).counts.tolist() == []
    assert tx.words(column.slice(3, 4)).counts.tolist() == [len(x) for x in want[3:7]]


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, corpus, block):
    df = docs_of(spark, corpus)
    got = {r.doc_id: r for r in near_dedup.cluster(df, near_dedup.Params(block=block)).collect()}
    assert len(got) == len(corpus)
    for i, (n, c) in enumerate(brute_components(corpus)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i), i
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.cluster(df).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (7, 7, True)], key=str)
    assert near_dedup.cluster(df.limit(0)).count() == 0


def test_super_minhash_estimates():
    rng = np.random.default_rng(3)
    pool = tx.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    a, b = pool[:200], pool[50:250]
    s, d = np.concatenate([a, b, a]), np.repeat([0, 1, 2], 200)
    sig = near_dedup.super_minhash(s, d, 4, 256)
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.1
    assert (sig[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    tiny = near_dedup.super_minhash(a[:1], np.zeros(1, np.int64), 1, 64)
    assert sorted((tiny[0] >> np.uint64(52)).tolist()) == list(range(64))  # one element ranks every slot


@pytest.mark.parametrize("shape", ["path", "star", "ring", "pairs", "none"])
def test_components(spark, shape):
    n = 40
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "ring": [(i, (i + 1) % n) for i in range(n)], "pairs": [(2 * i, 2 * i + 1) for i in range(n)], "none": []}[shape]
    df = spark.createDataFrame([*edges, (None, 3), (9, 9)] if edges else [], "a long, b long")
    got = {r.id: r.component_id for r in components.connected_components(df).collect()}
    want = {v: v - v % 2 for e in edges for v in e} if shape == "pairs" else {v: 0 for e in edges for v in e}
    assert got == want


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def brute_kept(text, rules):
    text = text or ""
    w = WORD.findall(text)
    n, chars, _, _, repeat = brute_measures(text)
    if n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n:
        return False
    for k, share in rules.max_gram_share.items():
        seen, cover = set(), set()
        for i in range(n - k + 1):
            g = tuple(w[i : i + k])
            if g in seen:
                cover.update(range(i, i + k))
            seen.add(g)
        if sum(len(w[i]) for i in cover) > share * chars:
            return False
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += sum(map(len, WORD.findall(line)))
        seen.add(line)
    return dup <= rules.max_line_share * chars


def test_repetition(spark, corpus):
    line = "this line is here and then again it is"
    texts = [*corpus, "\n".join([line] * 3 + corpus[10:14]), "|| ## é\n|| ## é\n", " \n \n", " ".join("abcdefghi") + " " + " ".join("abcdefghi"), " ".join(f"u{i}" for i in range(40)) + " " + " ".join(f"u{i}" for i in range(12))]
    got = {r.doc_id: r for r in repetition.measure(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(t), i
        assert r.kept is brute_kept(t, repetition.Rules()), i
    df = docs_of(spark, texts)
    assert {r.doc_id for r in repetition.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}
    clash = repetition.measure(df, ("doc_id", "source", "kept"))
    assert clash.columns[:3] == ["doc_id", "source", "n_words"]
    assert repetition.measure(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(3, "http://a/1", "x" * 150), (1, "http://a/2", "x" * 150), (2, "http://a/\r\nX: y", "é" * 60), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "z", "y" * 200), (9, "z", "y" * 200), (9, "z", "y" * 200), (10, "l", "\r\n\r\nWARC/1.1 " * 30_000), (8, "z", "y" * 200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type long").repartition(3)
    got = defaultdict(list)
    for r in warc.round_trip(df).collect():
        got[r.page_id].append(r)
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            best[h] = min(best.get(h, i), i)
    assert sum(map(len, got.values())) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        first = best.get(h) if len(data) >= 100 else None
        ref = first if first is not None and first != i else None
        for r in got[i]:
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if ref is not None else "response", ref)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_streams():
    record = [warc.record(i, f"http://h/{i}", b"p" * n, "d", None, False) for i, n in enumerate((0, 10, 3_000_000))]
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = one.compress(b"".join(record)) + one.flush()
    members = b"".join((lambda z: z.compress(r) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31)) for r in record)
    for data in (whole, members):
        assert [b for _, b in warc.records(warc.inflate(io.BytesIO(data)))] == record
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(iter([record[1][:-9]])))


def test_url_parts(spark):
    urls = ["http://A.b/c?d#e", "https://X.org", "no scheme", None, "", "a://b?c/d", "http://h#f/g", "p://q://r/s", "http://h/p\nq?x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.h, r.p) for r in df.select("page_id", url_rules.host(F.col("url")).alias("h"), url_rules.path(F.col("url")).alias("p")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        assert got[i] == (low(host), re.match("[^?#]*", rest[len(host) :])[0]), u


def test_url_rules(spark):
    urls = [f"http://site{i % 7}.example.{('org', 'com', 'net')[i % 3]}/{('fr', 'de', 'es', 'en')[i % 4]}/{i}" for i in range(200)] + [None, "x", "http://sub.com/fr/x", "http://notorg/x"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(0, urls[0], "c")], "page_id long, url string, verdict string")
    got = url_rules.judge(df, URL_RULES).collect()
    assert len(got) == len(urls) + 1
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(urls):
        r, best = by_id[i], None
        for rule in URL_RULES.rules:
            if (r.host == rule.host or r.host.endswith("." + rule.host)) and r.path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                best = rule
        assert r.rule == (best.name if best else None), u
        if best:
            assert r.verdict == best.verdict
    # brute-force association rules over the labelled urls
    sets = {i: frozenset(t) for i, t in ((r.page_id, r.t) for r in df.select("page_id", url_rules.tokens(F.coalesce("url", F.lit("")), url_rules.host(F.col("url")), url_rules.path(F.col("url"))).alias("t")).collect())}
    labelled = [(sets[i], by_id[i].verdict) for i in range(len(urls)) if by_id[i].rule] + ([(sets[0], by_id[0].verdict)] if by_id[0].rule else [])
    # tokens of exactly the same labelled urls count as the least of them
    where = defaultdict(set)
    for k, (s, _) in enumerate(labelled):
        for t in s:
            where[t].add(k)
    least = {t: min(x for x in where if where[x] == where[t]) for t in where if len(where[t]) >= URL_RULES.min_support * len(labelled)}
    same = url_rules.bundles(spark.createDataFrame([(list(s),) for s, _ in labelled], "tokens array<string>"), URL_RULES)
    assert same == {t: x for t, x in least.items() if sum(y == x for y in least.values()) > 1}
    sets = {i: frozenset(least.get(t, t) for t in s) for i, s in sets.items()}
    labelled = [(frozenset(least.get(t, t) for t in s), y) for s, y in labelled]
    mined = url_rules.mine(spark.createDataFrame([(list(s), y) for s, y in labelled], "tokens array<string>, label string"), URL_RULES).collect()
    assert mined
    for m in mined:
        have = [y for s, y in labelled if set(m.antecedent) <= s]
        both = sum(y == m.label for y in have)
        assert math.isclose(m.confidence, both / len(have)) and m.confidence >= URL_RULES.min_confidence
        assert both >= URL_RULES.min_support * len(labelled) - 1e-9 and m.rarest in m.antecedent
    for i, u in enumerate(urls):
        r = by_id[i]
        if not r.rule:
            fit = [(m.confidence, m.support, m.label, " ".join(m.antecedent)) for m in mined if u and "://" in u and set(m.antecedent) <= sets[i]]
            assert r.verdict == (max(fit)[2] if fit else URL_RULES.default), u
    assert url_rules.judge(df.limit(0), URL_RULES).count() == 0
    assert {r.by for r in url_rules.judge(df.where("url like '%net%'"), URL_RULES).collect()} == {"default"}


def test_url_rules_of_long_common_paths(spark, monkeypatch):
    """Many segments that always stand together are mined as one; without a broadcast the rows are the same."""
    path = "/".join(f"part{k}" for k in range(40))
    urls = [f"http://site{i}.{'com/de' if i % 2 else 'com/fr'}/{path if i % 2 else 'x'}/{i}" for i in range(60)] + [f"http://other.net/{path}/{i}" for i in range(20)] + ["http://other.net/part7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(url_rules.judge(df, URL_RULES).collect())
    assert [r.verdict for r in got] == ["block" if i % 2 else "allow" for i in range(60)] + ["block"] * 21
    monkeypatch.setattr(url_rules, "MAX_BROADCAST", 0)
    assert sorted(url_rules.judge(df, URL_RULES).collect()) == got


def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(docs.where(~held))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !?"), (-4, "Ω")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(docs.select("doc_id", "text").union(odd), model).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.where(held).collect()]
    assert len(right) > 20 and sum(right) / len(right) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    assert got[-4].lang_pred in model.langs and all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.train(docs.limit(0))
    assert nothing.langs == [] and language_id.predict(docs.limit(3), nothing).first().lang_pred == "und"


def test_language_filter_is_a_superset():
    """A Bloom filter never misses, and the correction removes what chance adds."""
    p = language_id.Params(filter_bits=10, hashes=2)
    model = language_id.Model(["a", "b"], 0, np.zeros((1 << 10, 1), np.uint64), np.zeros(2))
    gram, _ = language_id.grams(pa.array(["the quick brown fox"]), p)
    model.table[language_id._places(gram, p)] |= np.uint64(1)
    counts = language_id.corrected(pa.array(["the quick brown fox", "zzz", ""]), model, p)
    assert counts[0, 0] == len(gram) and counts[0, 1] == 0 and counts[2].sum() == 0


def test_quality(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    good = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(40)) for _ in range(80)]
    df = docs_of(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(230) if i % 5] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    w = quality_model.train(df, labels)
    got = {r.doc_id: r for r in quality_model.score(df, w).collect()}
    assert len(got) == 232
    assert all(got[i].predicted == int(i < 150) for i in range(0, 230, 5))
    assert got[230].score == got[231].score and 0 <= got[230].score <= 1
    again = quality_model.train(df.repartition(7), labels)
    assert np.array_equal(w, again)
    flat = quality_model.train(df, labels.limit(0))
    assert {r.score for r in quality_model.score(df, flat).collect()} == {0.5}


def brute_targets(sizes, weights, cap):
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000], [10, 20, 1000], [], [0, 10], [0, 0], [1, 5, 40, 300, 2000, 7, 7, 7], list(range(200))])
def test_mix_targets(spark, sizes):
    names = [None if i == len(sizes) - 1 else f"{i:04d}" for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long").repartition(3)
    got = {r["source"]: (r["code"], r["target"]) for r in source_mix.targeted(source_mix.coded(df), source_mix.Params()).collect()}
    want = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [got[n][0] for n in names] == list(range(len(sizes)))
    assert [got[n][1] for n in names] == pytest.approx(want)


def test_mix_many_sources(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 5).cast("int")).alias("text"))
    got = source_mix.mix(df).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).first()
    assert (got.n, got["size"]) == (n, 2 * n) and got.over <= 0 and math.isclose(got.target, 2 * n)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), s) for i, s in enumerate(["b", "a", None, "c"] * 120)] + [(900, None, "a"), (901, "tiny", "d"), (None, "x y", "a"), (4, "w", "b")]
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], "doc_id long, text string, source string, size long, taken long")
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3), strict=True))
    taken = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 3, s
    again = sorted(source_mix.mix(df.repartition(5)).collect(), key=str)
    assert [(r.doc_id, r.taken) for r in again] == [(r.doc_id, r.taken) for r in sorted(got, key=str)]
    assert source_mix.mix(df.limit(0)).count() == 0
    out = source_mix.resample(df.where("doc_id is not null and text <> 'w'"))
    assert out.columns == df.columns


def test_resample_gives_each_row_its_own_copies(spark):
    rng = random.Random(3)
    ids = [*range(150), *[None] * 150, *[500] * 150, *[501, 502] * 75]
    rows = [(d, f"t{i} " + " ".join(["w"] * rng.randint(0, 60)), "abc"[i % 3]) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mix.resample(df).collect()
    words = lambda t: len(WORD.findall(t))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.source_size)
    size = Counter()
    for _, t, s in rows:
        size[s] += words(t)
    taken, want = Counter(), Counter()
    for r in out:
        assert (r.doc_id, r.text, r.source) in rows
        taken[r.doc_id is None, r.doc_id or 0, words(r.text), size[r.source]] += 1
    for r in source_mix.mix(df).collect():
        if r.copies:
            want[key(r)] += r.copies
    assert len(set(size.values())) == 3 and taken == want
    assert any(r.doc_id is None for r in out)
    again = source_mix.resample(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_entropy_dual_against_bisection():
    size = np.array([1.0, 5.0, 20.0, 100.0])
    for target in (40.0, 126.0, 300.0):
        lo, hi = -5.0, 5.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (size * np.minimum(3, np.exp(mid * size))).sum() < target else (lo, mid)
        rate = np.minimum(3, np.exp(lo * size))
        assert abs((size * rate).sum() - target) < 1e-6
        copies = source_mix._diffuse(size[::-1].astype(np.int64), rate[::-1], 3)
        assert abs((copies * size[::-1]).sum() - target) <= 100 and copies.max() <= 3


def brute_kneser_ney(train, texts, order):
    """Every quantity from the definition, with ``order - 1`` begin tokens before each text."""
    tokens = lambda t: [*["<s>"] * (order - 1), *WORD.findall(low(t)), "</s>"]
    grams = lambda x, k: [tuple(x[i - k + 1 : i + 1]) for i in range(order - 1, len(x))]
    rows = [tokens(t) for t in train]
    count = Counter(w for x in rows for w in x[order - 1 :])
    levels = {order: Counter(g for x in rows for g in grams(x, order))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in {g for x in rows for g in grams(x, k + 1)})
    off = {k: kneser_ney.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in levels.items()}
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for k, c in levels.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            kinds[k, g[:-1]][min(n, 3) - 1] += 1
    n, v = sum(count.values()), len(count)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (v + 1)
        key, lower = (k, gram[:-1]), p(gram[1:])
        if not total[key]:
            return lower
        c = levels[k].get(gram, 0)
        return (max(c - off[k][min(c, 3) - 1], 0) / total[key] if c else 0) + sum(x * y for x, y in zip(off[k], kinds[key], strict=True)) / total[key] * lower

    begin = ("<s>",) * (order - 1)
    assert math.isclose(sum(p((*begin, w)) for w in count) + p((*begin, object())), 1.0)
    out = []
    for t in texts:
        x = tokens(t)
        own = x[order - 1 :]
        out.append((len(own), sum(w in count for w in own), n, sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in own), sum(math.log10(p(g)) for g in grams(x, order))))
    return out


@pytest.mark.parametrize(("order", "hot"), [(2, True), (3, True), (3, False), (4, False), (5, True)])
def test_kneser_ney(spark, corpus, order, hot):
    structured = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = [*corpus, "never seen words", "the The THE", *(f"x{i} is a" for i in range(90)), " ".join(f"y{i} is a" for i in range(90)), structured, structured.translate(str.maketrans("ab", "ba"))]
    df = docs_of(spark, texts)
    # with a small sample and shards some contexts and n-grams are hot
    params = kneser_ney.Params(order=order, shard_bytes=1 << (11 if hot else 14), chunk_tokens=3000, slice_bytes=1 << 14, sample_tokens=20_000 if hot else 10)
    model = kneser_ney.train(df.where("doc_id % 3 <> 0"), params)
    if hot:
        assert any(len(x.context) for x in model.hot.values())
        assert order == 2 or any(len(x.pair) for x in model.hot.values())
    got = {r.doc_id: r for r in kneser_ney.score(df, model, params).collect()}
    for i, want in enumerate(brute_kneser_ney([t for i, t in enumerate(texts) if i % 3], texts, order)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3], i
        assert math.isclose(r.base_score, want[3], rel_tol=1e-9) and math.isclose(r.score, want[4], rel_tol=1e-9), i


def test_kneser_ney_empty(spark):
    df = docs_of(spark, ["a b"])
    empty = kneser_ney.train(df.limit(0))
    r = kneser_ney.score(docs_of(spark, ["a b"]), empty).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


ITEMS = ["In 2019 Anna drove 150 km to the old harbour and met Carl near the mill", "Which planet has the largest ring system of all and why is it so bright", "too short"]


def test_decontamination(spark):
    filler = "some plain words that no item has in any order at all "
    texts = [
        filler * 3, filler + ITEMS[0] + " " + filler, filler + "in 1987 Berta drove 42 km to the old harbour and met Otto near the mill " + filler, filler + ITEMS[1].upper(), filler + "Which planet has the largest ring", None, "",
        filler + "1 2 3 4 5 6 7 8 9 10 11 12", filler * 200 + ITEMS[1] + filler * 200, filler + ITEMS[0] + filler + ITEMS[0],
    ]
    df = docs_of(spark, texts)
    bench = spark.createDataFrame([*enumerate(ITEMS), (8, None), (None, ITEMS[1]), (0, ITEMS[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 1), (8, 1), (9, 0)}
    assert got[2, 0].n_slots == got[2, 0].consistent_slots >= 3
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {0, 4, 5, 6, 7}
    assert decontaminate.matches(df.limit(0), bench).count() == 0
    assert decontaminate.matches(df, bench.limit(0)).count() == 0


def test_copies_without_literals_are_found(spark):
    sums = "What is 23 * 45 + 12 - 7 + 88 / 4 - 19 + 3 * 61 - 5"
    names = "Anna Berta Carl Dora Emil Frida Gustav Hanna Ivan Jana Karl Lena"
    filler = "some plain words that no item has in any order at all. "
    texts = [filler + sums + " " + filler, filler + names.lower() + " " + filler, filler + ITEMS[1].title() + " " + filler, filler + sums.replace("45", "46").replace("88", "89").replace("61", "62"), filler * 3, filler + names.upper()]
    df = docs_of(spark, texts)
    bench = spark.createDataFrame([(0, sums), (1, names), (2, ITEMS[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (5, 1)}
    assert all(r.n_windows == r.item_windows and r.n_slots == r.consistent_slots for r in got.values())
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {3, 4}


def test_short_items_are_found_as_sentences(spark):
    texts = ["Sums. 12 + 7 = ? More.", "12 and 7 are numbers", "a 12 + 7 = ?", "x\n12 + 7 =\ny", "12 + 7 + 1", None, "", "paris", "Go to Paris!"]
    bench = spark.createDataFrame([(0, "12 + 7 = ?"), (1, "Paris"), (2, "?!"), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 0), (3, 0), (7, 1)}


TOKEN = re.compile(r"(?:[0-9A-Za-z\u0080-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+")


def brute_matches(texts, items, p):
    """Occurrences by comparing every window of every text with every window of every item."""

    def parse(text):
        out, before = [], None
        for m in TOKEN.finditer(text):
            word = m[0]
            opens = before is None or any(c in ".!?:\n" for c in text[before : m.start()])
            capitals, kind = sum("A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" for c in word), ""
            first = "A" <= word[0] <= "Z" or "\u00c0" <= word[0] <= "\u00de"
            if word[0].isascii() and word[0].isdigit():
                kind = "#"
            elif out and out[-1][1] == "#" and low(word) in decontaminate.UNITS:
                kind = "U"
            elif first and not opens and (capitals < len(word) or len(word) < 2):
                kind = "N"
            out.append((low(word), kind))
            before = m.end()
        return out

    found = set()
    parsed = [parse(t) for t in items]
    for i, text in enumerate(texts):
        t = parse(text or "")
        for j, item in enumerate(parsed):
            k = min(p.window, len(item))
            if k < p.min_literal:
                continue
            windows = range(len(item) - k + 1)
            shape = lambda x: tuple(w if not kind else kind for w, kind in x)
            rich = [q for q in windows if sum(not kind for _, kind in item[q : q + k]) >= p.min_literal]
            for shift in range(-len(item), len(t)):
                here = [q for q in windows if 0 <= q + shift <= len(t) - k]
                templated = [q for q in here if q in rich and shape(item[q : q + k]) == shape(t[q + shift : q + shift + k])]
                same = [q for q in here if [w for w, _ in item[q : q + k]] == [w for w, _ in t[q + shift : q + shift + k]]]
                slots = defaultdict(set)
                for q in templated:
                    for x, y in zip(item[q : q + k], t[q + shift : q + shift + k], strict=True):
                        if x[1]:
                            slots[x].add(y[0])
                enough = lambda n, of: n and n >= min(p.min_windows, math.ceil(of * p.min_share))
                steady = sum(len(v) == 1 for v in slots.values()) >= p.min_consistent * len(slots)
                if (enough(len(templated), len(rich)) and steady) or enough(len(same), len(windows)):
                    found.add((i, j))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["the", "boat", "sails", "past", "old", "mill", "Anna", "Carl", "12", "7", "3.5", "km", "hours", "and", "then", "É", "why"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    items = [sentence(rng.randint(4, 30)) for _ in range(25)]
    texts = [None, ""]
    for item in items:
        words = item.split(" ")
        for change in range(4):
            new = [rng.choice(["5", "9", "40"]) if w in ("12", "7") and change == 1 else rng.choice(vocabulary) if change == 2 and rng.random() < 0.15 else w for w in words]
            texts.append(sentence(12) + " " + " ".join(new[rng.randint(0, 3) :]) + " " + sentence(12))
    p = decontaminate.Params()
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = brute_matches(texts, items, p)
    assert got == want and len(want) > 40


def test_values_do_not_hide_a_template(spark):
    """Windows without literals neither raise the number of templates needed nor make slots inconsistent."""
    item = "the old harbour had 7 boats and each boat held 7 men " + " ".join(map(str, range(100, 140)))
    text = "the old harbour had 9 boats and each boat held 9 men " + " ".join(map(str, range(200, 240)))
    got = decontaminate.matches(docs_of(spark, [text]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 1)]


def test_inconsistent_slots_are_no_match(spark):
    item = "From 10 take 10 then add 10 and the last 10 gives what the first 10 had before we began"
    same = item.replace("10", "77")
    mixed = item
    for n in ("1", "2", "3", "4", "5"):
        mixed = mixed.replace("10", n, 1)
    df = docs_of(spark, [same, mixed])
    got = decontaminate.matches(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [0]


def test_templates():
    w, kind, *_ = decontaminate.template(pa.array(["Anna saw 3.5 km, then Bob PAID 1,000 dollars. Carl left", None, "Éva met Éva"]))
    words = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert words[:6] == ["anna", "saw", "3.5", "km", "then", "bob"]
    names = {0: "", 1: "#", 2: "N", 3: "U"}
    assert [names[k] for k in kind.tolist()] == ["", "", "#", "U", "", "N", "", "#", "U", "", "", "", "", "N"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_pieces(tokenizer, corpus):
    texts = [t or "" for t in corpus] + ["a", " a", "a ", "  a b", "x\n y", "x \n", "it's we're\tfine\n\nok", "<|endoftext|> hi <|endoftext|>", "a b  c", "日本 語 12 345,6", " ", "\n", "a b", "x\u2003 y", "x \u2003y", "a\u00a0 b", "é à", "\u3000 x", "x \u3000", "x\u0085 y"]
    encoder = token_planes.PieceEncoder(tokenizer_path(), True, limit=50)
    for _ in range(2):  # from memory too, and after it was emptied
        for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string())), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes(planes):
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 2**32 if i % 2 else 50_000, n, dtype=np.uint32) for i, n in enumerate([0, 1, 999, 5000, 0, 2000, 1000])]
    out = io.BytesIO()
    writer = token_planes.Writer(out, token_planes.Params("", block_ids=1000, planes=planes))
    for i, x in enumerate(parts):
        writer.add(None if i == 2 else i, x)
    writer.close()
    reader = token_planes.Reader(out, len(out.getvalue()))
    assert all(np.array_equal(a, b) for a, b in zip(parts, reader.documents(), strict=True))
    whole = np.concatenate(parts)
    for start, n in ((0, 0), (0, 1), (999, 2), (1500, 4000), (0, len(whole))):
        assert np.array_equal(reader.span(start, n), whole[start : start + n])
    assert reader.doc_null.tolist() == [i == 2 for i in range(7)]
    with pytest.raises(ValueError, match="cut short"):
        token_planes.Reader(io.BytesIO(out.getvalue()[:-3]), len(out.getvalue()) - 3)


def test_token_output(spark, tokenizer, corpus):
    df = docs_of(spark, list(reversed(corpus))).repartition(5)
    got = sorted(token_planes.round_trip(df, token_planes.Params(tokenizer_path(), block_ids=512)).collect())
    start = 0
    for i, text in enumerate(reversed(corpus)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, "b")], "doc_id long, text string")
    rows = token_planes.round_trip(odd, token_planes.Params(tokenizer_path())).collect()
    assert sorted((r.start, r.n_tokens) for r in rows)[0] == (0, 2) and sum(r.n_tokens for r in rows) == 5
    assert token_planes.round_trip(odd.limit(0), token_planes.Params(tokenizer_path())).count() == 0


M64 = (1 << 64) - 1


def mix_of(x):
    """splitmix64's finaliser on one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def brute_language(train, texts, p):
    """The filter by sets of places, and every text scored one n-gram at a time."""

    def codes(text):
        out, kept = [], bytearray()
        for b in (text or "").encode():
            c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
            if not (c == 32 and kept[-1:] == b" "):
                kept.append(c)
        for n in p.sizes:
            for i in range(len(kept) - n + 1):
                out.append(mix_of((int.from_bytes(kept[i : i + n], "big") + (n << 40)) & M64) & ((1 << p.gram_bits) - 1))
        return out

    seeds = [int(c) for c in tx.constants(p.hashes, 71)]
    places = lambda g: [mix_of((g + c) & M64) >> (64 - p.filter_bits) for c in seeds]
    counts = defaultdict(Counter)
    for text, lang in train:
        counts[lang].update(codes(text))
    langs = sorted(counts)
    share = {x: {g: n / sum(counts[x].values()) for g, n in counts[x].items()} for x in langs}
    bits = {}
    for x in langs:
        mine = [g for g, v in share[x].items() if v >= p.min_share and v >= p.min_ratio * max(share[y].get(g, 0) for y in langs)]
        bits[x] = {q for g in mine for q in places(g)}
    has = lambda x, g: all(q in bits[x] for q in places(g))
    rate = {x: sum(has(x, g) for g in range(1 << p.gram_bits)) / (1 << p.gram_bits) for x in langs}
    out = []
    for text in texts:
        grams = codes(text)
        score = {x: max(0.0, sum(has(x, g) for g in grams) - len(grams) * rate[x]) / max(1e-9, 1 - rate[x]) for x in langs}
        total = sum(score.values())
        best = max(langs, key=lambda x: (score[x], [-ord(c) for c in x]))
        out.append((best if total > 0 else None, score[best] / total if total > 0 else 0.0))
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ba", "ko", "ti", "ru"], "bb": ["sch", "ein", "ung", "ö"], "cc": ["eau", "que", "ç", "ti"]}
    make = lambda x, n: " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(n))
    train = [(make(x, rng.randint(5, 60)), x) for x in syllables for _ in range(12)]
    texts = [make(x, n) for x in syllables for n in (1, 3, 40)] + [make("aa", 6) + " " + make("bb", 3), "x", "12", None, "", make("cc", 3000)]
    p = language_id.Params(gram_bits=10, filter_bits=11)
    model = language_id.train(spark.createDataFrame([*train, (None, "aa"), ("zz", None)], "text string, lang string"), p)
    rows = [(i, t, "other", 9.0) for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, texts[1], None, None)]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), model, p).collect()
    assert len(got) == len(rows)
    want = brute_language(train, texts, p)
    for r in got:
        lang, score = want[1 if r.doc_id is None else r.doc_id]
        if lang is None or not any(c.isalpha() for c in (texts[r.doc_id] if r.doc_id is not None else "x") or ""):
            assert r.score == 0.0
        else:
            assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-9), r
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_id.predict(empty, model, p).count() == 0
    none = language_id.train(spark.createDataFrame([], "text string, lang string"), p)
    assert {r.lang_pred for r in language_id.predict(empty.union(spark.createDataFrame([(1, "abc")], "doc_id long, text string")), none, p).collect()} == {"und"}


def test_ftrl_against_scalar_updates(spark, corpus):
    texts = [t for t in corpus if t is None or len(t) < 3000][:70] + ["same text", "same text", "other text"]
    ids = [*range(len(texts) - 3), 5, 5, 5]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)] + [(None, "x", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    p = quality_model.Params(bits=12, max_train=40, epochs=2)
    got = quality_model.train(df, labels, p)
    keyed = df.where("doc_id is not null and doc_id <> 7 or doc_id = 7").select("doc_id", "text", F.xxhash64("doc_id").alias("rank"), F.xxhash64("text").alias("tie")).where("doc_id is not null").distinct().orderBy("rank", "doc_id", "tie").collect()
    z, g2 = [0.0] * ((1 << p.bits) + 1), [0.0] * ((1 << p.bits) + 1)
    rows = []
    for r in keyed[: p.max_train]:
        idx, val, _ = quality_model.features(pa.array([r.text], pa.string()), p)
        x = Counter()
        for i, v in zip(idx.tolist(), val.tolist(), strict=True):
            x[i] += v
        x = {i: float(np.float32(v)) for i, v in x.items()} | {1 << p.bits: 1.0}
        rows.append((x, 0 if r.doc_id == 5 else r.doc_id % 2))
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(g2[i])) / p.alpha + p.l2)
    for _ in range(p.epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            q = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (q - y) * v
                z[i] += g - (math.sqrt(g2[i] + g * g) - math.sqrt(g2[i])) / p.alpha * w[i]
                g2[i] += g * g
    want = np.array([weight(i) for i in range(len(z))])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-5) and np.count_nonzero(want) > 50
    assert np.array_equal(got, quality_model.train(df.repartition(7), labels, p))
    assert quality_model.score(df.limit(0), got, p).count() == 0
    assert not quality_model.train(df.limit(0), labels, p).any()


def test_structured_words_stay_apart(spark, tokenizer):
    """Texts of regular structure, which hashes of sums of powers can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    df = docs_of(spark, [f"one two three four {a}", f"one two three four {b}", f"{a}\n{b}\n{a} x", f"hi {a} end hi {b} end"])
    assert [r.component_id for r in near_dedup.cluster(df).orderBy("doc_id").collect()] == [0, 1, 2, 3]
    assert [r.n_dup_lines for r in repetition.measure(df).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in (r.text for r in df.orderBy("doc_id").collect())]
    got = token_planes.round_trip(df, token_planes.Params(tokenizer_path())).orderBy("doc_id").collect()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    bench = spark.createDataFrame([(0, f"q w e r t {a}")], "item_id long, text string")
    found = decontaminate.matches(docs_of(spark, [f"q w e r t {b}", f"q w e r t {a}"]), bench).collect()
    assert [r.doc_id for r in found] == [1]


def test_pieces_with_equal_hashes(tokenizer, monkeypatch, corpus):
    """With a hash of eight bits nearly all pieces collide, and the ids are still the library's."""
    real = tx.lane_hashes
    monkeypatch.setattr(tx, "lane_hashes", lambda *a: real(*a) & np.uint64(255))
    encoder = token_planes.PieceEncoder(tokenizer_path(), True, limit=100)
    texts = [t or "" for t in corpus[:60]]
    for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "k8s://host"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(Cluster)
