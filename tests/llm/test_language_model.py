import math
import zlib
from collections import Counter

import numpy as np
import pytest

import concord.llm.language_model as lm
from concord.llm.common import scratch
from concord.llm.elias_fano import EliasFano, dump, mapped


@pytest.mark.parametrize("n,top", [(1, 1), (5, 3), (1000, 50), (1000, 10**6), (3000, 2**63 - 1), (200, 200)])
def test_elias_fano(n, top, tmp_path):
    rng = np.random.default_rng(n + top)
    v = np.sort(rng.integers(0, top, n))
    dump(str(tmp_path / "x"), EliasFano.of(v).arrays("v"))
    e = EliasFano.load(mapped(str(tmp_path / "x")), "v")
    i = rng.integers(0, n, 500)
    assert (e.access(i) + e.base == v[i]).all()
    q = np.sort(np.concatenate((v, rng.integers(int(v[0]), top, 500), v[-1:] + 1)))
    at, found = e.successor((q - e.base).astype(np.uint64))
    assert (at == np.searchsorted(v, q)).all()
    assert (found == np.isin(q, v)).all()


def test_elias_fano_unsigned():
    v = np.sort(np.random.default_rng(9).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    e = EliasFano.of(v)
    at, found = e.successor(v - np.uint64(e.base))
    assert found.all() and (at == np.arange(len(v))).all()


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def brute(train, texts):
    uni, bi, kids = Counter(), Counter(), Counter()
    for t in train:
        w = [b"", *words(t), b""]
        uni.update(w[1:])
        bi.update(zip(w, w[1:], strict=False))
    for a, _ in bi:
        kids[a] += 1
    total, distinct, out = sum(uni.values()), len(uni), []
    for t in texts:
        w, base, score, known = [b"", *words(t), b""], 0.0, 0.0, 0
        for a, b in zip(w, w[1:], strict=False):
            p = (uni[b] + 1) / (total + distinct + 1)
            known += uni[b] > 0
            base += math.log10(p)
            if uni[a]:
                p = max(bi[a, b] - lm.DISCOUNT, 0) / uni[a] + lm.DISCOUNT * kids[a] / uni[a] * p
            score += math.log10(p)
        out.append((len(w) - 1, known, total, base, score))
    return out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3], rel=1e-9)
        assert g.bigram_score == pytest.approx(w[4], abs=2e-4 * w[0] + 1e-9)


TEXTS = [None, "", "the cat sat on the mat", "The cat ran", "the dog sat on the cat " * 300, "é É \x1c\xa0 x\ty\x0bz", "the cat sat on the mat", "word" * 30_000]
TEST = [*TEXTS, "unknown words only", "the unknown cat", "cat the"]


@pytest.mark.parametrize("size", [3_000_000, 7])
def test_small(spark, docs, size, monkeypatch):
    monkeypatch.setattr(lm, "FILE", size)
    model = lm.learn(docs(TEXTS, ["hash", "n", "score"]).repartition(3), scratch(spark, "t"))
    assert size > 100 or len(model.pairs) > 5 and len(model.words) > 2
    same(lm.score(docs(TEST, ["score"]), model).orderBy("doc_id").collect(), brute(TEXTS, TEST))


def test_empty(spark, docs):
    none = docs(["x"]).limit(0)
    model = lm.learn(none, scratch(spark, "t"))
    got = lm.score(docs([None, "a b"]), model).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got] == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert lm.score(none, model).count() == 0


def test_opened(tmp_path, monkeypatch):
    """Files that cannot be mapped are held up to a bound."""
    import concord.llm.elias_fano as ef

    for i in range(4):
        dump(str(tmp_path / f"{i}"), {"x": np.arange(i, 100 + i)})

    class Far:
        type_name = "far"

        def open_input_file(self, path):
            return open(path, "rb")

    monkeypatch.setattr(ef, "open_fs", lambda uri: (Far(), uri))
    o = ef.Opened(lambda a: a["x"])
    o.HELD_BYTES = 2000
    assert [int(o[str(tmp_path / f"{i % 4}")][0]) for i in range(8)] == [0, 1, 2, 3] * 2 and len(o) == 2


def test_normalised():
    uni = Counter("a b a c b a".split())
    total, distinct = 6, 3
    assert sum((n + 1) / (total + distinct + 1) for n in [*uni.values(), 0]) == pytest.approx(1)


def test_query(spark, small):
    t = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in t]
    got = lm.op3_language_model(spark, small).orderBy("doc_id").collect()
    assert [r.held_out for r in got] == held
    same(got, brute([r.text for r, h in zip(t, held, strict=True) if not h], [r.text for r in t]))


def brute_trigrams(train, texts):
    uni, bi, tri, kids, kids_2 = (Counter() for _ in range(5))
    for t in train:
        w = [b"", *words(t), b""]
        uni.update(w[1:])
        bi.update(zip(w, w[1:], strict=False))
        tri.update(zip(w, w[1:], w[2:], strict=False))
    for a, _ in bi:
        kids[a] += 1
    for a, b, _ in tri:
        kids_2[a, b] += 1
    total, distinct, out = sum(uni.values()), len(uni), []
    for t in texts:
        w, score = [b"", *words(t), b""], 0.0
        for i in range(1, len(w)):
            p, c, pair = (uni[w[i]] + 1) / (total + distinct + 1), w[i - 1], tuple(w[i - 2 : i]) if i > 1 else None
            if uni[c]:
                p = max(bi[c, w[i]] - lm.DISCOUNT, 0) / uni[c] + lm.DISCOUNT * kids[c] / uni[c] * p
            if pair and bi[pair]:
                p = max(tri[*pair, w[i]] - lm.DISCOUNT, 0) / bi[pair] + lm.DISCOUNT * kids_2[pair] / bi[pair] * p
            score += math.log10(p)
        out.append((len(w) - 1, score))
    return out


@pytest.mark.parametrize("size", [3_000_000, 7])
def test_trigrams(spark, docs, size, monkeypatch):
    monkeypatch.setattr(lm, "FILE", size)
    model = lm.learn(docs(TEXTS).repartition(3), scratch(spark, "t"))
    test = [*TEST, "cat sat on the mat", "mat the on sat cat", "the cat sat unknown mat"]
    got = lm.score(docs(test, ["score", "bigram_score"]), model).orderBy("doc_id").collect()
    for g, (n, w) in zip(got, brute_trigrams(TEXTS, test), strict=True):
        assert g.score == pytest.approx(w, abs=4e-4 * n + 1e-9)
    # A repeated phrase of three words and more gains from the third level.
    assert got[2].score > got[2].bigram_score + 0.3


def test_triples_of_many_words():
    rng = np.random.default_rng(3)
    pair, after, n = rng.integers(0, 30, 500), rng.integers(0, 5, 500), rng.integers(1, 9, 500)
    for weights in (None, n):
        small, large = (lm.counted_triples(pair, after, weights, d) for d in (5, 2**22))
        assert all((a == b).all() for a, b in zip(small[:3], large[:3], strict=True))


def test_query_trigrams(spark, small):
    t = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = lm.op3_language_model(spark, small).orderBy("doc_id").collect()
    want = brute_trigrams([r.text for r in t if zlib.crc32(str(r.doc_id).encode()) % 7 != 2], [r.text for r in t])
    for g, (n, w) in zip(got, want, strict=True):
        assert g.score == pytest.approx(w, abs=4e-4 * n + 1e-9)
