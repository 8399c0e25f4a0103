import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from tokenizers import Tokenizer

from concord.llm.common import Encoder, default_vocabulary, open_fs, scratch
from concord.llm.packing import CapacityTree, op5_packing, pack, plan
from concord.llm.token_files import ShardReader, op4_token_files, read_token_files, write_token_files

TEXTS = [
    None, "", " ", "Hello World", "x" * 3000, "a<|endoftext|>b <|startoftext|>", "tab\there\x1cthere  x y\rz", "é é ́x İI ß don't they'll 12345 %%%", "Hello World",
    "ΣΑΣ ΣΑΣ\nΣ", "word " * 9000, "漢字かな 한국어 😀👍🏽",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_vocabulary())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder(plain):
    e = Encoder(default_vocabulary())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e(TEXTS)] == [plain(t) for t in TEXTS]


def test_other_vocabularies(tmp_path):
    """Of a tokenizer that keeps the space with the word, each text is encoded as a whole."""
    from tokenizers import models, pre_tokenizers

    import public_tokenizers

    t = Tokenizer(models.BPE())
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    pairs = [("t", "h"), ("th", "e"), ("Ġ", "c"), ("Ġc", "a"), ("Ġca", "t")]
    names = sorted({x for p in pairs for x in (*p, "".join(p))} | set("thecasĠ"))
    t.model = models.BPE(vocab={x: i for i, x in enumerate(names)}, merges=pairs)
    t.save(str(tmp_path / "t.json"))
    for path in (str(tmp_path / "t.json"), public_tokenizers.path("byte_bpe_50k.json")):
        e, whole = Encoder(path), Tokenizer.from_file(path)
        assert not e.known and Encoder(default_vocabulary()).known
        for text in ("the cat sat", "  the\n cat ", "the"):
            assert np.frombuffer(e([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, path


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files(spark, docs, plain):
    folder = scratch(spark, "test-files")
    rolled = write_token_files(docs(TEXTS), folder + "r", default_vocabulary(), shards=2, shard_ids=40)
    assert rolled.count() > 3
    one = [tuple(r) for r in read_token_files(spark, folder + "r", rolled).orderBy("doc_id").collect()]
    assert one == [tuple(r) for r in read_token_files(spark, folder, write_token_files(docs(TEXTS), folder, default_vocabulary())).orderBy("doc_id").collect()]
    shards = write_token_files(docs(TEXTS, ["shard", "ids"]), folder, default_vocabulary(), shards=3)
    got = read_token_files(spark, folder, shards).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, TEXTS, strict=True):
        want = [*plain(t), 2]
        assert (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.start, r.n_tokens) == (want, at, len(want))
        at += len(want)
    fs, path = open_fs(shards.orderBy("shard").first().path)
    with fs.open_input_file(path) as f:
        dictionary = open_fs(f"{folder}/dictionary")
        s = ShardReader(f, dictionary[0].open_input_file(dictionary[1]).read())
        assert np.frombuffer(s.find(3), "<u4").tolist() == [*plain(TEXTS[3]), 2] and s.find(10**6) is None
        with pytest.raises(ValueError):
            ShardReader(f, b"other")
    # Rows without a doc_id come first, in order of text.
    d = docs(["b", "x y", "a", None]).selectExpr("CASE WHEN doc_id < 3 THEN CAST(NULL AS LONG) ELSE -5 END AS doc_id", "text")
    for shards in (1, 3):
        named = write_token_files(d, f"{folder}n{shards}", default_vocabulary(), shards=shards)
        got = read_token_files(spark, f"{folder}n{shards}", named).orderBy("start").collect()
        assert [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got] == [*((None, [*plain(t), 2]) for t in ("a", "b", "x y")), (-5, [2])]
        fs, path = open_fs(named.orderBy(named.shard.desc()).first().path)
        with fs.open_input_file(path) as f:
            s = ShardReader(f, fs.open_input_file(open_fs(f"{folder}n{shards}/dictionary")[1]).read())
            assert np.frombuffer(s.find(-5), "<u4").tolist() == [2] and s.find(0) is None
    empty = write_token_files(docs(["x"]).limit(0), folder + "e", default_vocabulary())
    assert read_token_files(spark, folder + "e", empty).count() == 0


def test_files_query(spark, small, plain):
    want, at = [], 0
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*plain(r.text), 2]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in op4_token_files(spark, small).orderBy("doc_id").collect()] == want


def best_fit(lengths, size):
    room, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(room, x)
        if i == len(room):
            n += 1
            left = size - x
        else:
            left = room.pop(i) - x
        insort(room, left)
    return n


def test_plan():
    rng = random.Random(5)
    for size in (1, 7, 64, 100):
        for _ in range(30):
            h = {x: rng.randint(1, 40) for x in rng.sample(range(1, size + 1), rng.randint(1, size))}
            used, taken = {}, {}
            for length, rank, count, first, per, offset in plan(h, size):
                assert rank == taken.get(length, 0)
                taken[length] = rank + count
                for i in range(count):
                    used.setdefault(first + i // per, []).append((offset + i % per * length, length))
            assert taken == h
            for x in used.values():
                end = 0
                for o, n in sorted(x):
                    assert o == end
                    end += n
                assert end <= size
            assert len(used) == best_fit([x for x, n in h.items() for _ in range(n)], size)


def test_tree():
    t = CapacityTree(20)
    for c in (3, 9, 20):
        t.put(c, True)
    assert [t.tightest(x) for x in (0, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    t.put(20, False)
    assert t.tightest(10) is None


def check_packing(rows, texts, plain, size):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        ids, at = [*plain(t), 0], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32, r.length) == (k, at, crc(ids[at : at + r.length]), min(size, len(ids) - at))
            at += r.length
        assert at == len(ids)
    for x in seqs.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= size
    assert len(seqs) == best_fit([r.length for r in rows], size)


def test_pack(spark, docs, plain):
    d = docs(TEXTS, ["rank", "task", "length"]).repartition(3)
    check_packing(pack(d, default_vocabulary(), scratch(spark, "t"), size=50).collect(), dict(enumerate(TEXTS)), plain, 50)
    assert pack(d.limit(0), default_vocabulary(), scratch(spark, "t")).count() == 0


def test_pack_query(spark, small, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_packing(op5_packing(spark, small).collect(), texts, plain, 2048)
