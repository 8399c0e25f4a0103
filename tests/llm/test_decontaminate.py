import random
import re

import concord.llm.decontaminate as dc
from concord.llm.decontaminate import decontaminate, op1_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, window=13):
    out = []
    for t in texts:
        d, hit, found = words(t), set(), set()
        for i, item in items:
            w = words(item)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                x = w[k : k + window]
                for p in range(len(d) - len(x) + 1):
                    if d[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        found.add(str(i))
        out.append((len(d), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(d)))
    return out


ITEMS = [(1, "A b c d e f g h i j k l m n o p"), (2, "short one"), (3, None), (4, ""), (2, "short one"), (10, "über Straße 12 x")]
TEXTS = [
    None, "", "a b c d e f g h i j k l m", "x a B c. d e f g h i j k l m n o p, y short one short-one", "nothing here",
    "a b c d e f g h i j k l", "ÜBER über straße 12 X " * 3, "short one " + "z " * 60, "w" * 100_000 + " short one", "short one",
]


def rows(df):
    return [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.orderBy("doc_id").collect()]


def test_small(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = docs(TEXTS, ["spans", "items", "n_hit", "item_id"])
    want = brute(TEXTS, ITEMS)
    assert rows(decontaminate(d, items)) == want
    assert rows(decontaminate(d, items, block_words=5)) == want
    kept = decontaminate(docs(TEXTS[:3], ["_key", "block"]), items)
    assert {(r._key, r.block) for r in kept.collect()} == {("x", "x")}
    assert rows(decontaminate(d, items.limit(0)))[2] == (13, 0, [], False)
    assert decontaminate(d.limit(0), items).count() == 0


def test_stretches(spark, docs, monkeypatch):
    """Long items in several stretches, candidates in several parts, many common words."""
    monkeypatch.setattr(dc, "STRETCH", 3)
    monkeypatch.setattr(dc, "CANDIDATES", 10)
    assert [len(x) for x in dc.stretches(list(range(20)), 5)] == [7, 7, 7, 7, 7, 5] and dc.stretches([], 5) == [] and dc.stretches([1], 5) == [[1]]
    rng = random.Random(6)
    item = lambda n: " ".join(rng.choices("abcd", k=n))
    items = [(i, item(rng.randint(1, 30))) for i in range(30)]
    texts = [item(rng.randint(0, 60)) for _ in range(60)] + [items[3][1], " ".join(x for _, x in items)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for window, words in ((4, 400_000), (6, 20), (13, 100)):
        assert rows(decontaminate(docs(texts), frame, window=window, block_words=words)) == brute(texts, items, window), window


def test_query(spark, small):
    t = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in op1_decontamination(spark, small).orderBy("doc_id").collect()]
    assert got == [(a, b, len(c), d) for a, b, c, d in brute([r.text for r in t], items)]
    assert any(d for *_, d in got)
