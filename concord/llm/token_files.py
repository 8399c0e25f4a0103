"""Token-id files: one zstandard frame for each document, a shared dictionary, an offset index.

A folder holds ``dictionary`` (raw bytes) and shards ``shard-NNNNN-MMMM.ids``, in
ascending order of doc_id over all shards, rows without a doc_id first. A shard is

    magic "TIDS2\\0\\0\\0", sha256 of the dictionary (32 bytes), frames,
    footer: per document doc_id (i8; 0 without one), frame offset (u8), tokens
    (u4) as three arrays, then the number of documents (u8), that of documents
    without a doc_id (u8) and the footer's offset (u8).

A frame is the document's ids (little-endian u4), each byte place of the ids
apart, compressed with the dictionary. The reader checks the dictionary's hash.
One document is read with one seek.

Texts are dealt by ranges of doc_id, of about SHARD_BYTES each on average, and a
task goes on in a further shard once one holds SHARD_IDS bytes of ids: no shard
grows with the corpus or with the length of the texts beside each other.

The dictionary is trained on at most SAMPLE_DOCS documents, those of the
smallest hashes of their ids, each cut to its first 8 * SAMPLE_IDS characters
and then SAMPLE_IDS ids, for training only; it affects the size of the files,
never what they hold.

Defined results: a null text is an empty one and holds just the end id; equal
doc_ids are ordered by text, and each keeps its row; rows without a doc_id come
before all others, ordered by text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import BATCH_BYTES, batches, default_vocabulary, encoder, open_fs, scratch, stored, table, tune_batches, write_file

MAGIC = b"TIDS2\0\0\0"
END_ID = 2
SHARD_BYTES, SMALL_BYTES = 128 << 20, 4 << 20  # of text: a range's, and below which none is cut further for more tasks
SHARD_IDS = 512 << 20
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1500, 4096, 64 << 10, 3


def planes(ids: bytes) -> bytes:
    """The first bytes of all ids, then the second ones, and so on."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.tobytes()


class ShardWriter:
    def __init__(self, out, dictionary: bytes):
        self.out, self.at = out, 0
        self.ids, self.offsets, self.counts, self.nameless = [], [], [], 0
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Documents come in order; those without a doc_id first."""
        self.nameless += doc_id is None
        self.ids.append(doc_id or 0)
        self.offsets.append(self.at)
        self.counts.append(len(ids) // 4)
        self._put(self.pack.compress(planes(ids)))

    def close(self) -> None:
        footer = self.at
        for kind, values in (("<i8", self.ids), ("<u8", self.offsets), ("<u4", self.counts)):
            self._put(np.array(values, kind).tobytes())
        self._put(struct.pack("<QQQ", len(self.ids), self.nameless, footer))


class ShardReader:
    """Reads a shard; documents by their place in it."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        size = file.size()
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token-id shard")
        if file.read_at(32, 8) != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        n, self.nameless, footer = struct.unpack("<QQQ", file.read_at(24, size - 24))
        raw = file.read_at(20 * n, footer)
        self.ids = np.frombuffer(raw, "<i8", n)
        self.offsets = np.append(np.frombuffer(raw, "<u8", n, 8 * n), np.uint64(footer)).astype(np.int64)
        self.counts = np.frombuffer(raw, "<u4", n, 16 * n)
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=d)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> bytes:
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return unplanes(self.unpack.decompress(frame, max_output_size=4 * int(self.counts[k])))

    def find(self, doc_id: int) -> bytes | None:
        k = self.nameless + int(np.searchsorted(self.ids[self.nameless :], doc_id))
        return self.document(k) if k < len(self.ids) and self.ids[k] == doc_id else None

    def names(self, first: int, last: int) -> pa.Array:
        return pa.array(self.ids[first:last], pa.int64(), mask=np.arange(first, min(last, len(self.ids))) < self.nameless)


def train(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """The shared dictionary; empty where there is too little to train on."""
    chosen = [r.doc_id for r in docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return b""
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in chosen], "doc_id long"))
    end = struct.pack("<I", end_id)

    def run(frames):
        encode = encoder(vocabulary)
        for b in batches(frames):
            ids = [x[: 4 * SAMPLE_IDS] + end for x in encode([(t or "")[: 8 * SAMPLE_IDS] for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    got = docs.join(wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, ids binary").orderBy("doc_id", "ids").limit(2 * SAMPLE_DOCS).collect()
    samples = [planes(bytes(r.ids)) for r in got]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def shards_for(docs: DataFrame) -> int:
    """By the bytes of all texts: ranges of SHARD_BYTES, but as many as there are shuffle partitions where texts are fewer."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, -(-total // SHARD_BYTES), min(some, -(-total // SMALL_BYTES)))


INDEX = "shard long, part long, path string, n_docs long, n_tokens long, dictionary_sha256 string"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, shards: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the documents; gives (shard, part, path, n_docs, n_tokens, dictionary_sha256) of each file."""
    spark = docs.sparkSession
    tune_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dictionary = train(docs, vocabulary, end_id)
    write_file(f"{folder}/dictionary", lambda out: out.write(dictionary))
    held = spark.sparkContext.broadcast(dictionary)
    end = struct.pack("<I", end_id)
    # The range sampler reads only the ids; the text crosses the network once.
    dealt = docs.repartitionByRange(shards or shards_for(docs), F.asc_nulls_first("doc_id"))
    dealt = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").withColumn("shard", F.spark_partition_id())

    def run(frames):
        encode, sha = encoder(vocabulary), hashlib.sha256(held.value).hexdigest()

        def encoded():
            for b in batches(frames):
                for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                    yield b.column(2)[0].as_py(), doc_id, ids + end

        rows, part = encoded(), 0
        now = next(rows, None)
        while now:
            shard, said = now[0], []

            def fill(out):
                nonlocal now
                w, held_ids = ShardWriter(out, held.value), 0
                while now and held_ids < shard_ids:
                    w.add(now[1], now[2])
                    held_ids += len(now[2])
                    now = next(rows, None)
                w.close()
                said.append((len(w.ids), sum(w.counts)))  # noqa: B023  called at once

            path = f"{folder}/shard-{shard:05d}-{part:04d}.ids"
            write_file(path, fill)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": path, "n_docs": said[0][0], "n_tokens": said[0][1], "dictionary_sha256": sha}])
            part += 1

    return stored(dealt.mapInArrow(run, INDEX), f"{folder}/index")


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame, features: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (or, with features, only the crc32 of ids) of each document in the files."""
    starts, before = [], 0
    for k, r in enumerate(shards.orderBy("shard", "part").select("path", "n_tokens").toLocalIterator()):  # a row a file
        starts.append((k, r.path, before))
        before += r.n_tokens
    last = "ids_crc32 long" if features else "ids binary"
    schema = f"doc_id long, start long, n_tokens long, {last}"
    if not starts:
        return spark.createDataFrame([], schema)
    # One row per shard, a shard in a task of its own.
    tasks = spark.createDataFrame(starts, "nth long, path string, before long").repartition(len(starts), "nth")

    def run(frames):
        for b in batches(frames):
            for row in b.to_pylist():
                fs, at = open_fs(f"{folder}/dictionary")
                with fs.open_input_file(at) as f:
                    dictionary = f.read()
                fs, at = open_fs(row["path"])
                with fs.open_input_file(at) as f:
                    shard, start, k = ShardReader(f, dictionary), row["before"], 0
                    while k < len(shard):
                        # As many documents as come to BATCH_BYTES, but one at least.
                        size = np.cumsum(4 * shard.counts[k : k + 1000].astype(np.int64))
                        m = k + max(1, int(np.searchsorted(size, BATCH_BYTES, side="right")))
                        ids = [shard.document(i) for i in range(k, min(m, len(shard)))]
                        n = [len(x) // 4 for x in ids]
                        first = [start + x for x in np.cumsum([0, *n[:-1]]).tolist()]
                        start += sum(n)
                        value = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if features else pa.array(ids, pa.binary())
                        yield pa.RecordBatch.from_arrays([shard.names(k, m), pa.array(first, pa.int64()), pa.array(n, pa.int64()), value], ["doc_id", "start", "n_tokens", last.split()[0]])
                        k = m

    return tasks.mapInArrow(run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    shards = write_token_files(table(spark, sf_dir, "documents"), folder, default_vocabulary())
    return read_token_files(spark, folder, shards, features=True)
