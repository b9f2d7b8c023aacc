"""Phrases, quality and lexical search: against their SQL, plain Python and hand-made cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import collocations, lexical, quality
from sparkgauge.llm.common import read_table

SF = "/root/testdata/sf0.01"


def texts(n=150, seed=4):
    r = np.random.default_rng(seed)
    pool = ["New York", "new york city", "a", "b", "the", "of the", "x", "É é", "漢字", "to be or not to be", ",", ". ", "\n", "\t", "!?", "ab-c"]
    return [(i, " ".join(r.choice(pool, int(r.integers(0, 40)))), ["en", "de", None, "und"][i % 4]) for i in range(n)]


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases_by_hand(rows, rules):
    """The definition, phrase by phrase."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, rules.longest + 1) for i in range(len(w) - k + 1))
    known = {p: c for p, c in f.items() if c >= rules.threshold}
    candidates = {p: c for p, c in known.items() if len(p[1]) > 1}
    out = {}
    for (lang, w), a in candidates.items():
        holds = lambda big, w=w: len(big) > len(w) and any(big[i : i + len(w)] == w for i in range(len(big)))
        if any(b == lang and holds(big) and 100 * c >= rules.share * a for (b, big), c in candidates.items()):
            continue
        cut = min((rules.factor * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    return sorted(((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[: rules.top], 1)), key=repr)


@pytest.mark.parametrize("rules", [collocations.Rules(threshold=5), collocations.Rules(threshold=3, longest=3, top=4), collocations.Rules(threshold=300, share=60), collocations.Rules(threshold=20, share=50)])
def test_phrases_equal_the_definition_and_the_sql(spark, tmp_path, rules):
    import duckdb

    rows = [*texts(), (900, None, "en"), (901, "", None), (902, "of the of the of the " * 120, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = as_rows(collocations.mine_collocations(docs, rules), *PHRASES)
    assert got == phrases_by_hand(rows, rules)
    assert got
    docs.write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(c.sql(collocations.oracle_sql(rules)).fetchall(), key=repr) == got


def test_phrases_with_small_tables_and_chunks(spark, monkeypatch):
    """Full bit tables and many chunks cost more and change nothing."""
    rows, rules = texts(60, 8), collocations.Rules(threshold=4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = as_rows(collocations.mine_collocations(docs, rules), *PHRASES)
    tight = collocations.Rules(threshold=4, max_bits=collocations.BLOCK_BITS)
    assert as_rows(collocations.mine_collocations(docs.repartition(7), tight), *PHRASES) == whole
    chunk = [(b"en", t.encode()) for _, t, _ in rows]
    one, many = collocations._Chunk(chunk), [collocations._Chunk([x]) for x in chunk]
    found = Counter()
    for c in many:
        at = np.flatnonzero(c.room >= 4)
        for lang, phrase, n in zip(*c.counted(at, 4), strict=True):
            found[lang, phrase] += n
    at = np.flatnonzero(one.room >= 4)
    assert found == Counter({(lang, p): n for lang, p, n in zip(*one.counted(at, 4), strict=True)})


def test_scores_beyond_64_bits(spark):
    """1000 x a x n passes 64 bits in the score's expression."""
    y = spark.range(1).select(F.expr("cast(cast(900000000000 as decimal(16,0)) * cast(900000000000000 as decimal(16,0)) * cast(1000 as decimal(5,0)) as decimal(38,0)) div cast(cast(900000000001 as decimal(16,0)) * cast(900000000003 as decimal(16,0)) as decimal(38,0))"))
    assert y.first()[0] == 900000000000 * 900000000000000 * 1000 // (900000000001 * 900000000003)


@pytest.mark.parametrize("kind", ["odd", "wide", "empty"])
def test_odd_rows(kind, spark, request):
    df = request.getfixturevalue(kind).withColumn("lang", F.col("source"))
    for c in ("phrase", "rank", "item_id", "term", "features", "quality", "words", "f"):
        df = df.withColumn(c, df.doc_id)
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    found = as_rows(collocations.mine_collocations(df, collocations.Rules(threshold=2)), *PHRASES)
    assert found == phrases_by_hand(rows, collocations.Rules(threshold=2))
    items = spark.createDataFrame([("q1", "Six one, LONG"), ("q1", "end"), (None, "漢字"), ("q2", None), ("q3", "nothing_here")], "item_id string, text string").withColumn("doc_id", F.lit(1))
    hits = lexical.rank_documents(df, items, k=3)
    expected = ranked_by_hand(rows, [tuple(r) for r in items.select("item_id", "text").collect()], 3)
    assert as_rows(hits, "item_id", "rank", "doc_id", "score") == expected
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 0), (8, 1)], "doc_id long, quality int")
    scored = quality.score_quality(df, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert {r.score for r in quality.score_quality(df, labels.filter("quality = 1")).collect()} <= {1 / (1 + math.exp(-4))}


def ranked_by_hand(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(d, Counter(terms(t))) for d, t, *_ in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, c, size in held:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s:
                scores.append((-s, d is None, d or 0))
        out += [(i, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "lot"), [(5, 500_000), (200, 500_000), (7, 20)])
def test_search_equals_the_definition(spark, k, lot):
    docs = [(d, t) for d, t, _ in texts(300, 2)] + [(1000 + i, "tied text of the same words") for i in range(30)]
    items = [(i, t) for i, t, _ in texts(12, 77)] + [(50, "tied words"), (51, "the x")]
    found = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k, lot)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert as_rows(found, "item_id", "rank", "doc_id", "score") == ranked_by_hand(docs, items, k)


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = [(d, t) for d, t, _ in texts(200, 3)], [(i, t) for i, t, _ in texts(5, 21)]
    expected = ranked_by_hand(docs, items, 9)
    rows = pa_batches(docs)
    vocabulary = sorted({t for _, x in items for t in re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x.lower())})
    number = {t.encode(): i for i, t in enumerate(vocabulary)}
    block = lexical._Postings()
    for d, t in rows:
        block.add(d, t, number)
    row = block.row([t.encode() for t in vocabulary]).to_pylist()[0]
    for term, place, tf in zip(row["terms"], row["places"], row["tfs"], strict=True):
        at, n = np.frombuffer(place, np.uint16).astype(np.int64), np.frombuffer(tf, np.uint32).astype(np.int64)
        ((words, slices),) = lexical.term_slices(n, at, np.array([len(n)]))
        w = np.frombuffer(words, np.uint8)
        s = np.frombuffer(slices, np.uint64).reshape(-1, len(w))
        back = {}
        for j, own in enumerate(w):
            for d in range(64):
                v = sum(int(s[b, j] >> np.uint64(d) & np.uint64(1)) << b for b in range(len(s)))
                if v:
                    back[int(own) * 64 + d] = v
        assert back == dict(zip(at.tolist(), n.tolist(), strict=True)), term
    assert expected


def pa_batches(docs):
    return [(d, t.encode()) for d, t in docs]


def test_slices_add_and_rank_like_numbers():
    r = np.random.default_rng(5)
    for n, wide in ((1, 1), (2, 3), (7, 2), (33, 64)):
        values = r.integers(0, 1 << 34, (n, wide * 64)) * (r.random((n, wide * 64)) < 0.4)
        x = np.zeros((36, n, wide), np.uint64)
        for i, v in enumerate(values):
            ((w, s),) = lexical.term_slices(v, np.arange(wide * 64), np.array([len(v)]))
            own = np.frombuffer(s, np.uint64).reshape(-1, len(np.frombuffer(w, np.uint8)))
            x[: len(own), i, np.frombuffer(w, np.uint8)] = own
        total, sums = lexical.add_slices(x), values.sum(axis=0)
        order = r.permutation(wide * 64)
        for k in (1, 5, 60, wide * 64):
            at, score = lexical.best_places(total, k, order)
            want = [p for p in np.lexsort((order, -sums)) if sums[p] > 0][:k]
            assert sorted(at.tolist()) == sorted(want) and np.array_equal(score, sums[at])


def test_slices_of_many_terms_are_those_of_each():
    r = np.random.default_rng(6)
    n = np.array([1, 5, 200, 3, 64])
    place = np.concatenate([np.sort(r.choice(1024, k, replace=False)) for k in n])
    value = r.integers(1, 1 << 30, n.sum()) * (np.repeat(np.arange(5), n) != 3)
    found, first = lexical.term_slices(value, place, n), np.cumsum(n) - n
    assert found[3] is None
    for k in (0, 1, 2, 4):
        own = slice(first[k], first[k] + n[k])
        assert found[k] == lexical.term_slices(value[own], place[own], n[k : k + 1])[0]


def test_context_sums_equal_a_plain_loop():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 40, n).astype(np.int32) for n in (0, 1, 2, 30, 200)]
    sums = quality.ContextSums()
    sums.add(docs[:3])
    sums.add(docs[3:])
    places, want = quality.index_places(), np.zeros_like(sums.table)
    for d in docs:
        for i, w in enumerate(d):
            want[w, quality.DIM] += 1
            for j in range(max(0, i - quality.REACH), min(len(d), i + quality.REACH + 1)):
                if j != i:
                    want[w, places[d[j]][: quality.SIDE]] += 1
                    want[w, places[d[j]][quality.SIDE :]] -= 1
    assert np.array_equal(sums.table, want)


def test_context_table_does_not_hang_on_partitions(spark):
    docs = spark.createDataFrame([(t,) for _, t, _ in texts(80)], "text string")
    one = quality.context_table(docs.coalesce(1))
    assert np.array_equal(one, quality.context_table(docs.repartition(6))) and one[:, quality.DIM].sum() > 500


def test_gradients_and_temperature():
    r = np.random.default_rng(1)
    p = {"A": r.standard_normal((6, 4)), "a": r.standard_normal(4), "b": r.standard_normal(4), "c": r.standard_normal(1)}
    z, y = r.standard_normal((20, 6)), r.integers(0, 2, 20).astype(float)

    def loss(q):
        logit = np.maximum(0, z @ q["A"] + q["a"]) @ q["b"] + q["c"][0]
        return np.logaddexp(0, np.where(y > 0, -logit, logit)).mean()

    for k, g in quality.gradients(p, z, y).items():
        for at in np.ndindex(g.shape):
            up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - g[at]) < 1e-5
    logit = r.standard_normal(4000) * 2
    y = (r.random(4000) < 1 / (1 + np.exp(-logit))).astype(float)
    assert abs(quality.temperature(logit * 3, y) - 3) < 0.3


def test_quality_of_held_out_documents(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    scored = quality.score_quality(docs, labels)
    known = scored.join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in known if r.quality == 1]
    assert len(known) > 60 and sum(r.predicted == r.quality for r in known) >= 0.9 * len(known)
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    # equal texts, equal scores; labels of held-out rows teach nothing
    by_text = scored.join(docs, "doc_id").groupBy("text").agg(F.countDistinct("score").alias("n")).agg(F.max("n")).first()[0]
    assert by_text == 1
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs, turned).collect()}
    assert all(again[r.doc_id] == r.score for r in scored.collect())
