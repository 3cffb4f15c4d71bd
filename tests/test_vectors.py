"""Vectors, joins, components and Ward against brute force."""

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import clusters as C
from paperloom.operators import vectors as V

WORDS = "kiln wavelet harbour lattice enzyme basin furnace delta meadow quarry".split()


def corpus(n=60, seed=1):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, rng.integers(3, 9))) for _ in range(n)]
    texts[5], texts[6], texts[7] = texts[3], "", "the of and"
    return texts


def dense(vectors, n):
    rows = vectors.collect()
    terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    m = np.zeros((n, len(terms) or 1))
    for r in rows:
        m[r.idx, terms[r.term]] = r.w
    return m


def test_tfidf_and_pairs(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx long, text string")
    vectors = V.tfidf(rows, V.words(), 5000)
    m = dense(vectors, len(texts))
    assert np.allclose(np.linalg.norm(m, axis=1)[[0, 1, 6]], 1) and not m[7].any()
    s = m @ m.T
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.6}
    for method in ("prefix", "blocks"):
        got = {(r.idx_a, r.idx_b): r.similarity for r in V.cosine_pairs(V.vectors(rows, V.words(), 5000), 0.6, method=method).collect()}
        assert set(got) == expected and all(abs(got[p] - s[p]) < 1e-9 for p in got)
    split = {(r.idx_a, r.idx_b) for r in V.cosine_pairs(V.as_arrays(vectors), 0.6, method="prefix", hot_term=3).collect()}  # nearly every term is dealt to several tasks
    assert split == expected
    for fronts in (V.FRONTS, (4, 8), ()):
        first = [(r.idx_a, r.idx_b) for r in V.first_pairs(V.as_arrays(vectors), 0.6, 7, fronts).collect()]
        assert first == sorted(expected)[:7]


def test_char_counts(spark):
    rows = spark.createDataFrame([(0, "Ab  ab"), (1, "")], "idx long, text string")
    got = {(r.idx, r.term): r.tf for r in V.char_counts(rows, 2, 2).collect()}
    assert got[0, "ab"] == 2 and got[0, "b "] == 1 and got[1, "pl"] == 1


def test_transform_and_models(spark):
    rows = spark.createDataFrame([(0, "kiln kiln harbour"), (1, "harbour basin"), (2, "the")], "idx long, text string")
    known = V.fit(rows, V.words(), 3)
    other = spark.createDataFrame([(7, "basin basin"), (8, "unknown words"), (9, None)], "idx long, text string")
    assert [(r.idx, [known.terms[t] for t in r.terms], r.weights) for r in V.transform(other, known).collect()] == [(7, ["basin"], [1.0])]
    model = lambda texts: np.array([[len(t), 1.0] if t != "the" else [0.0, 0.0] for t in texts])
    got = {(r.idx_a, r.idx_b): r.similarity for r in V.cosine_pairs(V.embedded(rows, model), 0.5).collect()}
    assert list(got) == [(0, 1)] and got[0, 1] > 0.99


def test_counts_of_tasks_are_summed(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "idx long, text string").repartition(3)
    own = V.word_counts(rows).groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df"))
    assert {tuple(r) for r in V.vocabulary(rows, V.words(), 10_000).collect()} == {tuple(r) for r in own.collect()}


def test_text_cosine():
    assert abs(V.text_cosine("kiln wavelet", "kiln wavelet") - 1) < 1e-12
    assert abs(V.text_cosine("", "   ") - 1) < 1e-12  # both are the placeholder
    assert V.text_cosine("the of", "kiln") == 0 and V.text_cosine(None, "kiln") == 0


def naive_ward(d, cut):
    groups, d2 = [[i] for i in range(len(d))], d.astype(float) ** 2
    np.fill_diagonal(d2, np.inf)
    live = list(range(len(d)))
    while len(live) > 1:
        a, b = min(((x, y) for k, x in enumerate(live) for y in live[k + 1 :]), key=lambda p: (d2[p], p))
        h = d2[a, b]
        if h**0.5 > cut:
            break
        for w in live:
            if w not in (a, b):
                na, nb, nw = len(groups[a]), len(groups[b]), len(groups[w])
                d2[a, w] = d2[w, a] = ((na + nw) * d2[a, w] + (nb + nw) * d2[b, w] - nw * h) / (na + nb + nw)
        groups[a] += groups[b]
        live.remove(b)
    return {frozenset(groups[i]) for i in live}


def partition(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)}


def test_ward_equals_naive():
    rng = np.random.default_rng(0)
    for _ in range(40):
        x = rng.random((rng.integers(2, 14), 4))
        x /= np.linalg.norm(x, axis=1)[:, None]
        d = np.clip(1 - x @ x.T, 0, 2)
        cut = rng.uniform(0.02, 0.4)
        assert partition(C.ward(d, cut)) == naive_ward(d, cut)
    assert list(C.ward(np.zeros((1, 1)), 0.3)) == [0]
    assert len(set(C.ward(np.zeros((4, 4)), 0.3))) == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (200, 201)], "idx_a long, idx_b long")
    got = {r.idx: r.component for r in C.components(edges, spark.range(300).withColumnRenamed("id", "idx")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[102] == 100 and got[201] == 200 and got[250] == 250


def test_rounds_of_components_leave_nothing_to_the_planner(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "idx_a long, idx_b long")
    got = C.components(edges)
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1_000
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(61)}


def block(m, first=0):
    rows = [np.flatnonzero(r) for r in m]
    return V.Block(np.arange(first, first + len(m)), np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows).astype(np.int32), np.concatenate([m[i][r] for i, r in enumerate(rows)]))


def test_folded_products_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.random((300, 400)) * (rng.random((300, 400)) < 0.05) + np.eye(300, 400) * 0.01
    m[150:, :200], m[:150, 200:] = 0, 0  # two vocabularies
    m[150, 399] = m[40][0] = 0.3
    m[1::2] = m[::2] + 0.1 * (rng.random((150, 400)) < 0.02) * rng.random((150, 400))
    for sign in (1, -1):
        m[7] *= sign
        m /= np.linalg.norm(m, axis=1)[:, None]
        monkeypatch.setattr(V, "TILE", (64, 32))
        monkeypatch.setattr(V, "FOLD_MASS", 0.01)  # at least 64 columns for 400 terms
        s = m @ m.T
        expected = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.5}
        whole, low, high = block(m), block(m[:130]), block(m[130:], 130)
        for parts in (((whole, whole),), ((low, low), (low, high), (high, high))):
            got = [(min(x), max(x), w) for a, b in parts for i, j, v in V.folded_products(a, b, 400, 0.5, False) for *x, w in zip(i.tolist(), j.tolist(), v.tolist())]
            assert len(got) == len(expected) and {g[:2] for g in got} == expected and all(abs(s[i, j] - w) < 1e-12 for i, j, w in got)


def test_pairs_leave_a_task_in_batches(monkeypatch):
    monkeypatch.setattr(V, "PAIR_ROWS", 100)
    m = np.random.default_rng(6).random((60, 5))
    b = block(m / np.linalg.norm(m, axis=1)[:, None])
    got = list(V.pair_batches(V.row_products(b, b, 1e-5, True)))
    assert sum(x.num_rows for x in got) == 60 * 59 // 2 and len(got) > 10 and max(x.num_rows for x in got) < 160


def test_ward_clusters_by_component(spark):
    texts = [t for t in corpus(40, 3) if t and t != "the of and"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx long, text string")
    vectors = V.tfidf(rows, V.words(), 5000)
    m = dense(vectors, len(texts))
    got = C.ward_clusters(V.as_arrays(vectors), rows.select("idx"), 0.5, 1).collect()
    labels = np.array([{r.idx: r.cluster for r in got}[i] for i in range(len(texts))])
    assert partition(labels) == naive_ward(np.clip(1 - m @ m.T, 0, 2), 0.5)


def test_empty_and_zero(spark):
    empty = spark.createDataFrame([], "idx long, text string")
    vectors = V.vectors(empty, V.words(), 10)
    assert V.cosine_pairs(vectors, 0.5).count() == 0 and V.first_pairs(vectors, 0.5, 5).count() == 0
    assert C.ward_clusters(vectors, empty.select("idx"), 0.5, 1).count() == 0
    two = spark.createDataFrame([(0, "the"), (1, "kiln kiln"), (2, "harbour")], "idx long, text string")
    joined = C.ward_clusters(V.vectors(two, V.words(), 10), two.select("idx"), 0.75, 2)
    assert joined.count() >= 2  # a text without terms is at distance 0 from the others


def test_named_pairs(spark):
    rows = spark.createDataFrame(list(enumerate(corpus())), "idx long, text string")
    vectors = V.vectors(rows, V.words(), 5000)
    named = vectors.withColumn("name", F.when(F.col("idx") % 5 > 0, F.concat(F.lit("n"), "idx")))
    name = lambda i: f"n{i}" if i % 5 else None
    for threshold in (1e-5, 0.6):
        want = {(r.idx_a, name(r.idx_a), r.idx_b, name(r.idx_b), r.similarity) for r in V.cosine_pairs(vectors, threshold, above=True).collect()}
        got = [tuple(r) for r in V.named_pairs(named, threshold).collect()]
        assert len(got) == len(want) and {r[:4] for r in got} == {r[:4] for r in want}
    assert V.named_pairs(named.limit(0), 0.5).count() == 0
