"""Operators over whole tables: SimHash, neighbours, toxicity, components, the pipeline."""

import itertools

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgauge.llm import components, entries, neighbours, simhash, toxicity
from sparkgauge.llm.common import DOCUMENT_COLUMNS

# --- components ------------------------------------------------------------------------


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    r = np.random.default_rng(4)
    yield [(i, i + 1) for i in range(0, 60)]  # a chain
    yield [(0, i) for i in range(1, 80)] + [(100, i) for i in range(101, 105)]  # stars
    yield [tuple(map(int, e)) for e in r.integers(-300, 300, (250, 2))]


@pytest.mark.parametrize("edges", list(graphs()))
def test_components(spark, edges):
    expected = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    node, root = components.forest(a, b)
    labels = dict(zip(node.tolist(), root.tolist(), strict=True))
    assert all(labels.get(k, k) == v for k, v in union_find(edges).items())


# --- SimHash ---------------------------------------------------------------------------


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [None, "", " \t", "One", "one two", "A b C d", "Äb ß \x1c c\x85d e", "x y z " * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(rows).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_thresholds_sum_and_spare_common_values():
    r = np.random.default_rng(0)
    fp = r.integers(-(2**63), 2**63 - 1, 500)
    for m in (2, 3, 4):
        groups = simhash.group_bits(np.abs(np.eye(64)), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        values = simhash.part_values(fp, groups)
        counts = [np.ones(1 << simhash.COUNT_BITS, dtype=np.int64) for _ in groups]
        # as many fingerprints of each of the first part's values as for 65,536 cells of 100,000
        counts[0][:] = 100_000 << (16 - simhash.COUNT_BITS)
        chosen = simhash.allocate(values, [simhash.estimates(c, len(g)) for c, g in zip(counts, groups, strict=True)], [len(g) for g in groups])
        assert (chosen.sum(axis=0) == 3 - m + 1).all()
        if m > 2:
            assert (chosen[0] == -1).all()


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_equal_brute_force(spark, monkeypatch, parts):
    r = np.random.default_rng(parts)
    centre = r.integers(-(2**63), 2**63 - 1, 40)
    near = [int(c) ^ int(sum(1 << int(b) for b in r.choice(63, k, replace=False))) for c in centre for k in (1, 2, 3, 4)]
    # a dense ball around one value: its part values are common
    near += [int(centre[0]) ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(12), 2)]
    fp = sorted({*map(int, centre), *near})
    monkeypatch.setattr(simhash, "part_count", lambda n, radius=3: parts)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    nodes = spark.createDataFrame([(x, 0) for x in fp], "fp long, more long")
    got = {x.node: x.root for x in components.connected_components(simhash.link(nodes)).collect()}
    expected = union_find([(a, b) for a, b in itertools.combinations(fp, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3])
    assert got == expected


def test_blocks_follow_true_buckets():
    r = np.random.default_rng(3)
    # sparse parts of 32 bits: 200 million fingerprints in 65,536 cells, no value common
    sparse = r.poisson(200e6 / 65_536, 1 << 16)
    assert simhash.block_counts(sparse, 32).max() <= 1
    sparse[77] += 10 * simhash.BLOCK
    assert simhash.block_counts(sparse, 32)[77] >= 10
    assert simhash.block_counts(np.full(1 << simhash.COUNT_BITS, 3 * simhash.BLOCK), simhash.COUNT_BITS).max() == 3


@pytest.mark.parametrize("radius", [3, 7])
def test_parts_allow_thresholds_of_the_radius(radius):
    for n in (10, 10**5, 10**7, 10**9, 10**11):
        m = simhash.part_count(n, radius)
        assert 2 <= m <= radius + 1
        assert radius - m + 1 <= m * simhash.MAX_THRESHOLD


def test_wider_links_equal_brute_force(spark):
    r = np.random.default_rng(8)
    centre = r.integers(-(2**63), 2**63 - 1, 30)
    fp = sorted({*map(int, centre), *(int(c) ^ int(sum(1 << int(b) for b in r.choice(63, k, replace=False))) for c in centre for k in range(4, 10))})
    got = {x.node: x.root for x in components.connected_components(simhash.link(spark.createDataFrame([(x, 0) for x in fp], "fp long, more long"), 7)).collect()}
    assert got == union_find([(a, b) for a, b in itertools.combinations(fp, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 7])


def test_a_hub_with_many_neighbours(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 3000)]
    got = {r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {0}


def test_links_hold_on_the_further_bits(spark):
    links = lambda *rows: {x.node: x.root for x in components.connected_components(simhash.link(spark.createDataFrame(list(rows), "fp long, more long"), 7, 18)).collect()}
    assert links((0, 0), (1, 2**19 - 1)) == {}
    assert links((0, 0), (1, 2**18 - 1)) == {0: 0, 1: 0}
    # too far apart on the further bits, and linked through another
    assert links((0, 0), (1, 2**19 - 1), (2, 2**18 - 1), (2**40, 0)) == {0: 0, 1: 0, 2: 0, 2**40: 0}


def test_near_copies_go_and_others_stay(spark):
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("abcdefghiklmnoprstu"), 6)) for _ in range(4000)]
    texts = [list(r.choice(words, 400)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:30]):
        t[200] = "changed"
        rows.append((100 + i, " ".join(t)))
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(60))
    assert len(kept) <= 62


def test_one_row_of_each_component_stays(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (5, "a b c d", 2), (2, "another text of its own", 1), (5, "another text of its own", 3), (None, "no id here", 1), (None, "no id here", 1), (None, "nor here, but else", 1)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, digest int"))
    got = sorted((r.text, r.doc_id) for r in kept.collect())
    assert got == sorted([("a b c d", 5), ("another text of its own", 2), ("no id here", None), ("nor here, but else", None)])
    assert kept.columns == ["doc_id", "text", "digest"]


def test_near_duplicates(spark, wide, empty):
    rows = simhash.near_duplicates(wide).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.component_id, set()).add(r.doc_id)
    assert by[1] == {1, 2}
    assert by[3] == {3, 4, 5}
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(wide)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id < 6").collect()) == [1, 3]
    assert simhash.keep_one(empty).count() == 0


# --- neighbours ------------------------------------------------------------------------


def test_index_retrieves_every_code_within_the_radius():
    r = np.random.default_rng(1)
    codes = r.integers(0, 65_536, (400, 5)).astype("<u2")
    codes[1:40] = codes[0]
    codes[20:40, 2] ^= r.integers(0, 65_536, 20).astype("<u2")
    queries = codes[::9]
    far = np.array([[sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(q, c, strict=True)) for c in codes] for q in queries])
    for radius in (0, 3, 8, 30):
        q, i = neighbours.MultiIndex(codes).within(queries, radius)
        assert {*zip(q.tolist(), i.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True)}


def test_nearest_recall(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 24)) * r.uniform(0.5, 2, (1500, 1))
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] * 24), (5004, [1.0]), (None, [1.0] * 24), (5020, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = neighbours.nearest(df, block_rows=300, block_queries=40).orderBy("query_id", "rank").collect()
    assert len(got) == 75 * 20
    hits = 0
    for q in range(0, 1500, 20):
        mine = [g for g in got if g.query_id == q]
        assert [g.rank for g in mine] == list(range(1, 21))
        s = x @ x[q]
        assert all(g.score == pytest.approx(s[g.vec_id]) for g in mine)
        assert [(-g.score, g.vec_id) for g in mine] == sorted((-g.score, g.vec_id) for g in mine)
        s[q] = -np.inf
        hits += len({g.vec_id for g in mine} & {*np.argsort(-s)[:20].tolist()})
    assert hits >= 0.9 * 75 * 20


def test_recall_on_the_embeddings_table(spark):
    import os

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(path).select("vec_id", "embedding")
    every = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in every]), np.stack([v for _, v in every])
    got = {}
    for r in neighbours.nearest(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.where(ids == ids[i], -np.inf, x @ x[i])
        true = {*ids[np.lexsort((ids, -s))[:20]].tolist()}
        hits, total = hits + len(true & got[int(ids[i])]), total + len(true)
    assert hits >= 0.9 * total


def test_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (20, [1.0, 1.0, 1.0]), (21, [0.0, 0.0, 2.0]), (40, [3.0] * 5)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 2, 0.5), (0, 2, 1, 0.25), (20, 1, 21, 2.0)]


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(few.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------


def test_gradients():
    net = toxicity.Network(0)
    words = ["alpha", "beta", "gamma", "de", "é"]
    x = net.inputs(words).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at = np.array([[0, 1, 2, 3], [4, 4, 0, 0]])
    mask = np.array([[True] * 4, [True, True, False, False]])
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    g, d_x, _ = net.gradients(x, at, mask, y, w)
    loss = lambda: net.gradients(x, at, mask, y, w)[2]
    for name in ("Wf", "Ub", "Bf", "A", "v", "w"):
        p = net.p[name]
        i = np.unravel_index(p.size // 2, p.shape)
        old, e = p[i], 1e-2
        p[i] = old + e
        up = loss()
        p[i] = old - e
        down = loss()
        p[i] = old
        assert g[name][i] == pytest.approx((up - down) / (2 * e), abs=2e-4), name
    x[0, 2] += 1e-2
    up = loss()
    x[0, 2] -= 2e-2
    assert d_x[0, 2] == pytest.approx((up - loss()) / 2e-2, abs=2e-4)


def plain_logit(net, words):
    """One window's logit, number by number."""
    import math

    logistic = lambda x: 1 / (1 + math.exp(-x))
    h, p = toxicity.HIDDEN, {k: v.astype(float) for k, v in net.p.items()}
    x = []
    for w in words:
        word, grams, _ = toxicity.word_inputs([w])
        x.append([*net.words[word[0]].astype(float), *np.mean([net.grams[g].astype(float) for g in grams], axis=0)])
    states = [[0.0] * (2 * h) for _ in words]
    for side, order, base in (("f", range(len(words)), 0), ("b", range(len(words) - 1, -1, -1), h)):
        s = [0.0] * h
        for t in order:
            into = [sum(x[t][i] * p["W" + side][i, j] for i in range(len(x[t]))) + p["B" + side][j] for j in range(3 * h)]
            back = lambda v, j: sum(v[i] * p["U" + side][i, j] for i in range(h))  # noqa: B023, E731
            z = [logistic(into[j] + back(s, j)) for j in range(h)]
            r = [logistic(into[h + j] + back(s, h + j)) for j in range(h)]
            rs = [a * b for a, b in zip(r, s, strict=True)]
            m = [math.tanh(into[2 * h + j] + back(rs, 2 * h + j)) for j in range(h)]
            s = [(1 - z[j]) * m[j] + z[j] * s[j] for j in range(h)]
            states[t][base : base + h] = s
    e = [sum(math.tanh(sum(st[i] * p["A"][i, k] for i in range(2 * h)) + p["a"][k]) * p["v"][k] for k in range(toxicity.ATTENTION)) for st in states]
    weight = [math.exp(v - max(e)) for v in e]
    context = [sum(w * st[i] for w, st in zip(weight, states, strict=True)) / sum(weight) for i in range(2 * h)]
    return sum(c * w for c, w in zip(context, p["w"], strict=True)) + p["c"][0]


def test_scores_equal_a_plain_forward_pass():
    net = toxicity.Network(5)
    net.p["a"][:], net.p["c"][:] = 0.3, -0.2
    words = [f"w{i * 7 % 23}x" for i in range(70)]
    texts = [" ".join(words[:n]) for n in (1, 5, 32, 33, 70)]
    for text, got in zip(texts, toxicity.Scorer(net).window_logits(texts), strict=True):
        own = text.split()
        expected = [plain_logit(net, own[s : s + toxicity.WINDOW]) for s in toxicity.windows(len(own))]
        assert got.tolist() == pytest.approx(expected, abs=1e-4)


def ordered(n, seed=3):
    """Texts whose label is only in the order of two words, so that no count of words can tell it."""
    r = np.random.default_rng(seed)
    for i in range(n):
        words = list(r.choice([f"filler{k}" for k in range(40)], int(r.integers(8, 24))))
        at = int(r.integers(0, len(words)))
        y = i % 2
        words[at:at] = ["zuq", "wop"] if y else ["wop", "zuq"]
        yield " ".join(words), y


def test_the_recurrent_part_learns_what_word_counts_cannot():
    rows = list(ordered(1200))
    net = toxicity.train([t for t, _ in rows[:900]], [y for _, y in rows[:900]], toxicity.Limits(epochs=25))
    right = lambda n: np.mean((toxicity.Scorer(n).scores([t for t, _ in rows[900:]]) >= 0.5) == [y == 1 for _, y in rows[900:]])
    full = right(net)
    for side in "fb":
        net.p["U" + side][:] = 0
    assert full >= 0.9
    assert right(net) <= 0.75


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, limits: seen.append(texts))
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), toxicity.Limits(chars=1050))
    assert len(seen[0]) == 10


def test_windows_overlap_and_cover():
    for n in (0, 1, 32, 33, 48, 1000):
        starts = toxicity.windows(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def corpus(n):
    r = np.random.default_rng(6)
    clean = ["".join(r.choice(list("abcdeghiklmnoprst"), r.integers(2, 8))) for _ in range(300)]
    for i in range(n):
        words = list(r.choice(clean, r.integers(5, 150)))
        if toxic := i % 4 == 0:
            words.insert(int(r.integers(0, len(words))), "zuwqi" + "".join(r.choice(list("aeiou"), 3)))
        yield i, " ".join(words), int(toxic)


def test_toxicity_held_out(spark, wide, empty):
    rows = list(corpus(700))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").unionByName(wide.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, toxicity.Limits(epochs=4)).collect()
    assert len(got) == 700 + len(ODD)
    import zlib

    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (10_003, 10_004, 10_005))
    assert toxicity.score_toxicity(empty, labels.limit(0)).count() == 0
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit("own")), labels, toxicity.Limits(epochs=1))
    assert (kept.columns, kept.filter("score <> 'own'").count()) == (["doc_id", "text", "score"], 0)
    none = toxicity.score_toxicity(docs, labels.limit(0)).filter("predicted = 1").count()
    assert none == 0


# --- pipeline --------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rows = list(corpus(300))
    docs = [(i, t, "en", f"s{i % 2}", len(t)) for i, t, _ in rows]
    docs += [(1000 + k, rows[1][1], "en", "s0", len(rows[1][1])) for k in range(3)] + [(2000, None, None, None, None), (2001, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [now.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == list(DOCUMENT_COLUMNS)
        if k == 2:
            # line dedup has emptied the copies; one empty document stands for all
            assert now.filter("doc_id between 1000 and 1999 and text <> ''").count() == 0
            assert now.filter("coalesce(trim(text), '') = ''").count() == 1
        counts.append(now.count())
    assert counts[1] < counts[0]
    assert counts[3] < counts[2]
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def near_groups(rows):
    """Smallest id of each document's group, by all pairs: five words, 7 bits and 18 further ones."""
    import re

    import xxhash

    def bits(text, seed):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) > 4 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    two = {i: (bits(t, 42), bits(t, 43)) for i, t in rows}
    far = lambda a, b: bin(a ^ b).count("1")
    edges = [(a, b) for a, b in itertools.combinations(sorted(two), 2) if far(two[a][0], two[b][0]) <= 7 and (far(two[a][1], two[b][1]) <= 18 or two[a][0] == two[b][0])]
    return {**{i: i for i in two}, **union_find(edges)}


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    """run() against plain Python, stage by stage; the network is fitted once and shared."""
    import zlib
    from collections import Counter

    from test_rows import WORD, brute_targets, plain, repeated_runs

    r = np.random.default_rng(21)
    rows = list(corpus(160))
    shared = "a passage of some length that several of the documents hold, word for word"
    texts = {i: t + ("\n" + shared if i % 9 == 1 else "") for i, t, _ in rows}
    for k, i in enumerate((1, 2, 3, 5, 6)):
        texts[500 + k] = texts[i]
        words = texts[i].split(" ")
        words[len(words) // 2] = "other"
        texts[600 + k] = " ".join(words)
    texts |= {700: "", 701: " ", 702: "kurz"}
    docs = [(i, t, "en", f"s{int(r.integers(0, 4))}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    net = toxicity.train([t for _, t, _ in rows[:100]], [y for _, _, y in rows[:100]], toxicity.Limits(epochs=3))
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: net)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # toxicity: the largest logit of a text's windows
    def is_toxic(text):
        words = text.lower().split()
        logit = max(plain_logit(net, words[s : s + toxicity.WINDOW]) for s in toxicity.windows(len(words))) if words else None
        return logit is not None and net.slope * logit + net.shift >= 0

    kept = {i: t for i, t in texts.items() if not is_toxic(t)}
    assert 0 < len(kept) < len(texts)
    # line dedup
    gone = repeated_runs(list(kept.items()))
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in kept.items()}
    # near duplicates
    group = near_groups(list(kept.items()))
    kept = {i: t for i, t in kept.items() if group[i] == i}
    # mixing: every document whole, 0 to 3 times; sources near their targets
    sources = {i: s for i, _, _, s, _ in docs}
    size = {i: len(t.split()) for i, t in kept.items()}
    copies = {}
    ids = {i: np.append(plain(WORD, t), 2).astype("<u4") for i, t in kept.items()}
    assert {p.doc_id for p in pieces} <= set(kept)
    for i in kept:
        own = [p for p in pieces if p.doc_id == i]
        assert all(p.doc_tokens == len(ids[i]) and zlib.crc32(ids[i][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
        n, left = divmod(sum(p.length for p in own), len(ids[i]))
        copies[i] = n
        assert left == 0
        assert n <= 3
        assert Counter(x for p in own for x in range(p.start, p.start + p.length)) == (Counter({x: n for x in range(len(ids[i]))}) if n else Counter())
    targets = brute_targets({s: sum(size[i] for i in kept if sources[i] == s) for s in {sources[i] for i in kept}})
    for s, target in targets.items():
        assert abs(sum(copies[i] * size[i] for i in kept if sources[i] == s) - target) <= max(size[i] for i in kept if sources[i] == s)
    # packing: sequences without gaps
    for q in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == q), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_stages_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(None, None, None, None, None)] * 2):
        now = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            assert (now.count() > 0) == bool(rows), name


def test_entries_are_registered():
    assert [int(k[2:].split("_")[0]) for k in entries.QUERIES] == list(range(1, 11))
    assert set(entries.ORACLE_SQL) <= set(entries.QUERIES)
