import zlib

import numpy as np

from concord.llm.toxicity import Features, Model, Trees, isotonic, op6_toxicity, score_toxicity, train


def test_features():
    f = Features()
    assert f(None) == f(b"") == f(b"  ..") == [0.0] * 18
    for w in (b"id10t", b"m*ron", b"s.t.u.p.i.d", b"l0ser", b"$tupid"):
        assert f(b"well " + w + b" here")[6] > 0, w
    assert f(b"you are an idiot")[4] == 0.25 and f(b"an idiot is here")[4] == 0


def test_isotonic():
    k, v = isotonic(np.array([3.0, 1, 2, 2, 4]), np.array([0.0, 0, 1, 0, 1]))
    assert list(np.interp([1, 2, 3, 4], k, v)) == [0, 1 / 3, 1 / 3, 1]


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((Trees().fit(x, y).margin(x) > 0) == (y > 0)).mean() > 0.97


def test_small(spark, docs, tmp_path):
    d = docs([None, "", "you idiot", "x " * 200_000, "you idiot"], ["score", "label", "predicted"])
    labels = spark.createDataFrame([(0, 1), (2, None), (7, 1), (None, 0)], "doc_id long, label int")
    m = train(d, labels, str(tmp_path))
    assert m.share == 1.0
    assert {r.score for r in score_toxicity(d, m).collect()} == {1.0}
    assert train(d, labels.limit(0), str(tmp_path)).share == 0.0
    assert score_toxicity(d.limit(0), Model()).count() == 0
    assert train(d.limit(0), labels, str(tmp_path)).trees is None


def test_query(spark, small):
    out = {r.doc_id: r for r in op6_toxicity(spark, small.replace("sf0.001", "sf0.01")).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in out.items())
    held = [(r.predicted, labels[i]) for i, r in out.items() if r.held_out and i in labels]
    assert sum(p for p, y in held if y == 0) <= 0.02 * len(held)
    assert sum(p for p, y in held if y) >= 0.4 * sum(y for _, y in held)


def test_few_labels():
    """Toxic texts are told from clean ones by few labelled rows, and with toxic ones outside the calibration rows only."""
    bad, good = b"you stupid idiot, you are trash", b"a calm day by the sea with friends"
    for y in ([1, 0], [1, 0, 1, 0, 1, 0], [1, 0] * 19, [0, 1, 1, 1] * 15):
        a, b = Model().fit([bad if v else good for v in y], np.array(y, float)).score([bad, good])
        assert a >= 0.7 and b < 0.5, (len(y), a, b)


def test_train(spark, docs, tmp_path):
    """From a table as from texts at hand, repeated ids and texts included."""
    rng = np.random.default_rng(2)
    voc = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(300):
        bad = rng.random() < 0.3
        w = list(rng.choice(voc, rng.integers(3, 30))) + (["blorp", "you", "idiot"] if bad and rng.random() < 0.8 else [])
        texts.append(" ".join(w))
        y.append(int(bad))
    texts[7], texts[9], texts[12] = None, "", texts[11]
    d = docs(texts).repartition(3)
    d = d.unionByName(d.where("doc_id < 20")).unionByName(docs(["blorp other"]).selectExpr("CAST(5 AS LONG) AS doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, label int")
    got = train(d, labels, str(tmp_path))
    rows = d.join(labels, "doc_id").selectExpr("label", "coalesce(text, '') AS t", "xxhash64(doc_id) AS a", "doc_id", "xxhash64(coalesce(text, '')) AS h").orderBy("a", "doc_id", "h").collect()
    want = Model().fit([r.t.encode() for r in rows], np.array([r.label for r in rows], float))
    assert got.learned == want.learned and b"blorp" in got.learned
    test = [t.encode() if t else None for t in texts]
    assert np.allclose(got.score(test), want.score(test), atol=1e-12)


def plain_score(m, text):
    """The model's score, tree by tree and node by node."""
    x, margin = Features(m.learned)(text), m.trees.start
    for feature, cut, value in zip(m.trees.feature, m.trees.cut, m.trees.value, strict=True):
        node = 0
        for _ in range(3):
            bucket = sum(e < x[feature[node]] for e in m.trees.edges[feature[node]])
            node = 2 * node + 1 + (bucket > cut[node])
        margin += value[node - 7]
    knots, means = m.calibration
    if margin <= knots[0]:
        return means[0]
    for a, b, p, q in zip(knots, knots[1:], means, means[1:], strict=False):
        if margin <= b:
            return p + (q - p) * (margin - a) / (b - a)
    return means[-1]


def test_query_against_plain_scores(spark, small, tmp_path):
    """Every row of the query, scored one by one; a score at the limit counts as toxic."""
    small = small.replace("sf0.001", "sf0.01")
    d = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").selectExpr("doc_id", "toxic AS label").where("crc32(CAST(doc_id AS STRING)) % 3 <> 1")
    m = train(d, labels, str(tmp_path))
    texts = {r.doc_id: r.text for r in d.collect()}
    out = op6_toxicity(spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        want = min(1.0, max(0.0, plain_score(m, texts[r.doc_id].encode() if texts[r.doc_id] else None)))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    tie = Model(0.7)
    assert {x.predicted for x in score_toxicity(d, tie).collect()} == {1}
