import random
import zlib

import numpy as np
from test_decontaminate import brute as windows
from test_jaccard import brute as groups
from test_secrets import brute as secrets
from test_tokens import best_fit
from tokenizers import Tokenizer

import corpus_pipeline as cp
from concord.llm.common import default_vocabulary
from concord.llm.secrets import redacted
from concord.llm.toxicity import score_toxicity, train


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "jaccard", "decontamination", "secrets", "packing"]
    assert cp.ORACLE_SQL is None


def test_run(spark, tmp_path):
    """All stages against brute force on a small corpus with planted cases."""
    rng = random.Random(11)
    voc = [f"word{i}" for i in range(300)]
    item = " ".join(rng.choices(voc, k=20))
    texts = []
    for i in range(120):
        w = rng.choices(voc, k=rng.randint(5, 80))
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), "you idiot")
        if i % 11 == 3:
            w += item.split()
        if i % 13 == 1:
            w.append("token=abcdef123")
        texts.append(" ".join(w))
    # A long document with one passage, far below one word in twenty.
    texts.append(" ".join([*rng.choices(voc, k=900), *item.split()[2:15], *rng.choices(voc, k=900)]))
    long = len(texts) - 1
    texts += texts[:15] + [texts[i] + " more" for i in range(20, 40)] + [None, "", "  "]
    d = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, int("idiot" in (t or ""))) for i, t, *_ in d], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = cp.run(spark, sf).collect()

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic AS label").where("crc32(CAST(doc_id AS STRING)) % 3 <> 1")
    kept = {r.doc_id: r.text for r in score_toxicity(docs, train(docs, labels, str(tmp_path / 'model'))).where("predicted = 0").collect()}
    assert not any("idiot" in (t or "") for t in kept.values())
    assert len(kept) >= sum("idiot" not in (t or "") for t in texts)
    ids = sorted(kept)
    kept = {i: kept[i] for i, _, c in sorted(groups(ids, [kept[i] for i in ids])) if i == c}
    bad = windows(list(kept.values()), [(1, item)])
    assert bad[list(kept).index(long)][1:] == (13, ["1"], False)
    kept = {i: t for (i, t), (_, hit, *_) in zip(kept.items(), bad, strict=True) if not hit}
    assert long not in kept
    kept = {i: redacted(t, secrets(t), cp.MARK) for i, t in kept.items()}
    tok = Tokenizer.from_file(default_vocabulary())
    want = {(i, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in kept.items()}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want
    assert len({r.sequence_id for r in got}) == best_fit([r.length for r in got], 2048)


def test_secrets_stage(spark, docs):
    d = docs(["token=abcdef x", "clean", None])
    assert [(r.text, r.n_chars) for r in cp.secrets(spark, d, "").orderBy("doc_id").collect()] == [("[SECRET] x", 10), ("clean", 5), (None, 0)]


def test_repeated_rows(spark, docs):
    d = docs(["a b c d e", "a b c d e", None, ""]).selectExpr("CASE WHEN doc_id < 2 THEN 7 ELSE doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    d = d.unionByName(spark.createDataFrame([(None, "a b c d e", "en", "s", 9)], d.schema))
    got = cp.jaccard(spark, d, "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == [-1, 2, 3, 7]
    assert cp.jaccard(spark, d.limit(0), "").count() == 0


def test_wordless_pass_toxicity(spark, docs, tmp_path):
    """Even where every score reaches the limit."""
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = docs(["you idiot", None, "", " .. ", "é"])
    assert sorted(r.doc_id for r in cp.toxicity(spark, d, str(tmp_path)).collect()) == [1, 2, 3]


def test_run_odd_tables(spark, tmp_path):
    """Empty tables, and columns named as results of the operators are; nothing crashes, clean documents stay."""
    texts = ["one clean text of some words", None, "", "another clean text, longer than the first one by a few words", "token=abcdef123 in it"]
    d = [(i, t, "en", "s", len(t or ""), "x", 1.0, 2, "y") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, n_words long, secrets string"
    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, rows, bench, want in (("no-labels", d, [(1, "some benchmark item")], {0, 1, 2, 3, 4}), ("nothing", [], [], set()), ("hit", d, [(1, "clean text of some words")], {1, 2, 3, 4})):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame(bench, items).write.parquet(f"{sf}/benchmark.parquet")
        assert {r.doc_id for r in cp.run(spark, sf).collect()} == want, name
