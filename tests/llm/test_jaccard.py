import random
from array import array

import numpy as np

from concord.llm import jaccard
from concord.llm.common import scratch
from concord.llm.jaccard import class_of, elements, jaccard_components, join_group, linked, op8_jaccard_join, t_occurrence


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def sets(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    return out


def brute(ids, texts, percent=85):
    s, root = sets(texts), {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, x in enumerate(s):
        by.setdefault(frozenset(x), []).append(i)
    keys = [k for k in by if k]
    for k in keys:
        for i in by[k]:
            root[find(i)] = find(by[k][0])
    holds = {}
    for n, k in enumerate(keys):
        for t in k:
            holds.setdefault(t, []).append(n)
    for a, k in enumerate(keys):
        for b in {m for t in k for m in holds[t] if m > a}:
            both = len(k & keys[b])
            if 100 * both >= percent * (len(k) + len(keys[b]) - both):
                root[find(by[keys[b]][0])] = find(by[k][0])
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, len(s[i]), least[find(i)]) for i, d in enumerate(ids)}


def test_t_occurrence(monkeypatch):
    rng = random.Random(3)
    for k in range(600):
        monkeypatch.setattr(jaccard, "HEAP", 500 if k % 3 else 0)
        monkeypatch.setattr(jaccard, "PROBE", 0.0085 if k % 2 else 0.5)
        lists = [array("i", sorted(rng.sample(range(30), rng.randint(1, 25)))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, 12)
        want = {x: n for x in range(30) if (n := sum(x in y for y in lists)) >= least}
        assert t_occurrence(lists, least, 30) == want


def test_join_group():
    rng = np.random.default_rng(4)
    for percent in (85, 60, 95):
        base = [np.unique(rng.integers(0, 10**6, 60)) for _ in range(4)]
        made = []
        for _ in range(150):
            b = base[rng.integers(4)].copy()
            b[rng.integers(0, len(b), rng.integers(0, 12))] = rng.integers(0, 10**6)
            made.append(np.unique(b))
        root = list(range(len(made)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(made):
            for j in range(i):
                both = len(np.intersect1d(a, made[j]))
                if 100 * both >= percent * (len(a) + len(made[j]) - both):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
        assert join_group(made, percent) == [find(i) for i in range(len(made))]


def test_elements():
    """Linked sets always meet."""
    rng = np.random.default_rng(8)
    assert [class_of(n) for n in (1, 2, 3, 4, 5)] == [0, 1, 2, 3, 3] and all(np.ceil(1.5 ** class_of(n)) <= n < np.ceil(1.5 ** (class_of(n) + 1)) for n in range(1, 5000))
    met = 0
    for percent in (85, 60):
        for _ in range(1500):
            x = np.unique(rng.integers(-(2**63), 2**63 - 1, int(np.exp(rng.uniform(0, 6.5)))))
            union = 100 * len(x) // percent
            y = np.unique(np.concatenate((rng.choice(x, max(1, len(x) - rng.integers(0, union - len(x) + 2)), replace=False), rng.integers(-(2**63), 2**63 - 1, rng.integers(0, union - len(x) + 1)))))
            both = len(np.intersect1d(x, y))
            if linked(len(x), len(y), both, percent):
                met += 1
                assert len(np.intersect1d(elements(x, percent), elements(y, percent))), (len(x), len(y), both)
    assert met > 500


def corpus(rng):
    voc = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(voc, k=40))
    texts = [None, "", "  ", "One two", "one TWO", "one two three", "a b c d", "a b c d", "x " * 60_000]
    for _ in range(12):
        base = rng.choices(voc, k=rng.randint(5, 120))
        for _ in range(rng.choice([1, 2, 3, 25])):
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(voc)
            texts.append(" ".join(w) + (" " + shared if rng.random() < 0.4 else ""))
    return texts


def test_small(spark, docs):
    texts = corpus(random.Random(7))
    want = brute(range(len(texts)), texts)
    d = docs(texts, ["node", "root", "component_id"])
    for group in (1_000_000, 1500):
        got = jaccard_components(d, scratch(spark, "t"), group=group)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == want, group
    assert jaccard_components(d.limit(0), scratch(spark, "t")).count() == 0


def test_blocks(spark, docs, monkeypatch):
    """A component over a task's share is dealt to blocks; no group has more than its part of it."""
    sizes = spark.createDataFrame([(10,), (2000,), (60_000,), (400_000,), (90_000_000,)], "n long")
    at = lambda *x: [r[0] for r in sizes.orderBy("n").select(jaccard.blocks_of(sizes["n"], *x)).collect()]
    assert at(500_000, 211, 1_000_000) == [1, 1, 26, 42, 180] and at(500_000, 4, 10**9) == [1, 1, 1, 4, 6]
    monkeypatch.setattr(jaccard, "SHARE", 100)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(80):
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    got = jaccard_components(docs(texts), scratch(spark, "t"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute(range(80), texts)


def test_ties_are_stored(spark, docs, monkeypatch):
    """The rounds read their edges several times; all elements must be sorted once only."""
    plans, find = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges, folder: plans.append(edges._jdf.queryExecution().toString()) or find(edges, folder))
    texts = ["a b c d e f g h", "a b c d e f g h i", "x y z"] * 2
    got = jaccard_components(docs(texts), scratch(spark, "t"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute(range(6), texts)
    assert len(plans) == 2 and not any("Window" in p or "MapInArrow" in p for p in plans)


def test_query(spark, small):
    t = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = brute([r.doc_id for r in t], [r.text for r in t])
    assert {tuple(r) for r in op8_jaccard_join(spark, small).collect()} == want
    assert any(a != c for a, _, c in want)
