import hashlib
import random
import wave
import zlib
from io import BytesIO

import numpy as np

from concord.llm.common import open_fs, scratch
from concord.llm import media
from concord.llm.media import GEAR, MAX, MIN, chunk_ends, cut_points, dedupe, op9_media, padded, read, rolled, samples, store, wav_header


def test_rolled():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert rolled(data).tolist() == want


def test_chunks():
    rng = random.Random(2)
    a = bytes(rng.randrange(256) for _ in range(200_000))
    cut = lambda x: [0, *chunk_ends(cut_points(np.frombuffer(x, np.uint8)), 0, len(x))]
    ends = cut(a)
    assert ends[-1] == len(a) and all(MIN <= y - x <= MAX for x, y in zip(ends, ends[1:-1], strict=False))
    pieces = lambda x: {x[i:j] for i, j in zip(cut(x), cut(x)[1:], strict=False)}
    assert len(pieces(a) & pieces(b"inserted" + a)) > 0.8 * len(pieces(a))


def test_wav():
    for t in (None, b"", b"a", b"x" * 64, b"x" * 65):
        load = padded(t)
        assert len(load) % 64 == 0 and load
        made = wav_header(len(load)) + load
        with wave.open(BytesIO(made)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, load)
        assert samples(made) == load


def brute(t):
    load = (t or "").encode()
    n = len(load)
    load += bytes(-n % 64 or (64 if not n else 0))
    return (n, len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-64:]))


def test_slices(spark, docs, monkeypatch):
    """Rows are put together in parts of bounded bytes; a second run of a task finds the first one's work."""
    monkeypatch.setattr(media, "SLICE_BYTES", 1000)
    texts = [f"{i} " * 200 for i in range(20)]
    folder = scratch(spark, "t")
    rows = store(docs(texts).repartition(2), folder)
    assert rows.select("task", "slice").distinct().count() > 8
    places = sorted(map(tuple, dedupe(rows, folder).collect()))
    assert sorted(map(tuple, dedupe(rows, folder).collect())) == places
    got = {r.doc_id: samples(bytes(r.media)) for r in read(rows, dedupe(rows, folder), folder).collect()}
    assert got == {i: padded(t.encode()) for i, t in enumerate(texts)}


def test_small(spark, docs):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    texts = [None, "", "a", "é" * 32, long, long, long[:90_000] + "x" + long[90_000:], "a"]
    d = docs(texts, ["task", "chunks", "n_bytes"]).repartition(3)
    folder = scratch(spark, "t")
    rows = store(d, folder)
    places = dedupe(rows, folder)
    got = {r.doc_id: (r.n_bytes, samples(bytes(r.media))) for r in read(rows, places, folder).collect()}
    assert got == {i: (len((t or "").encode()), padded((t or "").encode())) for i, t in enumerate(texts)}
    fs, at = open_fs(f"{folder}/packs")
    kept = sum(fs.get_file_info(f"{at}/{n:06d}").size for n in {r.task for r in places.collect()})
    assert places.count() == places.select("digest").distinct().count() and kept == places.groupBy().sum("size").first()[0]
    assert kept < 150_000
    none = store(d.limit(0), folder + "e")
    assert read(none, dedupe(none, folder + "e"), folder + "e").count() == 0


def test_query(spark, small):
    t = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op9_media(spark, small).collect()
    assert len(got) == len(t)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute(t[r.doc_id])
        assert r.media_bytes == r.payload_bytes + 44
