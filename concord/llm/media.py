"""Media columns: texts as 8-bit samples in WAV form, stored as deduplicated content-defined chunks.

The payload of a row (its UTF-8 bytes, zero-padded to a positive multiple of 64)
is the sample data of an 8-bit mono WAV file. A rolling gear hash of the last
32 bytes cuts payloads into chunks of MIN to MAX bytes, so equal stretches give
equal chunks wherever they stand.

1. Each task cuts its rows, writes each chunk it has not seen yet as a
   zstandard frame to a pack of its own in the shared folder, and notes the
   row's header and its ordered chunk digests.
2. Spark groups the digests of all packs: the first place of a digest owns it.
3. Packs are rewritten with the frames they own, and the first ones removed. A
   repeated task finds the finished pack and only works out the places again.
4. To read, the distinct digests of each slice of a task's rows are joined with
   their places (a digest that stands in every row crosses the join once a
   slice), and the rows of a slice, of bounded bytes, are put together from
   header and chunks; lengths and digests are verified.

Only digests and places are shuffled, never the bytes.

Defined results: a null text counts as empty (64 zero bytes); equal texts give
equal values; repeated rows keep theirs; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, open_fs, scratch, stored, table, text_bytes, tune_batches

BLOCK, RATE = 64, 8000
MIN, BITS, MAX = 1024, 12, 32 << 10  # 2**BITS is the mean distance of cuts beyond MIN
LEVEL = 3
CACHE_BYTES = 16 << 20
SLICE_BYTES = 32 << 20  # payload of the rows that are put together at a time

CHUNKS = "array<struct<digest:binary,len:int>>"
PLACES = "array<struct<digest:binary,at:long,size:int>>"


def gear() -> np.ndarray:
    """256 pseudo-random 32-bit numbers, by splitmix64."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear()


def rolled(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there: sum of GEAR[b] << age."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut_points(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero(rolled(data) >> np.uint32(32 - BITS) == 0) + 1


def chunk_ends(points: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]; points: possible cuts, ascending."""
    out = []
    while end - start > MIN:
        i = int(np.searchsorted(points, start + MIN))
        cut = int(points[i]) if i < len(points) else end
        cut = min(cut, start + MAX, end)
        out.append(cut)
        start = cut
    if start < end:
        out.append(end)
    return out


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def wav_header(n: int) -> bytes:
    """Header of a mono WAV file of n 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples(media: bytes) -> bytes:
    """Sample data of such a WAV file."""
    kind, size, form, _, _, codec, channels, _, _, _, bits, _, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (kind, form, codec, channels, bits, size) != (b"RIFF", b"WAVE", 1, 1, 8, 36 + n) or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Pack:
    """A file of frames, under its final name only once it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.part, compression=None), 0

    def add(self, frame: bytes) -> int:
        self.out.write(frame)
        self.at += len(frame)
        return self.at - len(frame)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def store(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Writes packs; gives doc_id, task, slice (of SLICE_BYTES), n_bytes, header, chunks (in order) and fresh (chunks this row added to the task's pack)."""
    spark = docs.sparkSession
    tune_batches(spark)
    chunk_kind = pa.list_(pa.struct([("digest", pa.binary()), ("len", pa.int32())]))
    place_kind = pa.list_(pa.struct([("digest", pa.binary()), ("at", pa.int64()), ("size", pa.int32())]))

    def run(frames):
        task, pack, known, seen = TaskContext.get().partitionId(), None, set(), 0
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for b in batches(frames):
            pack = pack or Pack(f"{folder}/first/{task:06d}")
            texts = text_bytes(b.column(1))
            loads = [padded(t) for t in texts]
            ends = np.cumsum([len(x) for x in loads])
            points = cut_points(np.frombuffer(b"".join(loads), np.uint8))
            chunks, fresh = [], []
            for load, last in zip(loads, ends.tolist(), strict=True):
                first = start = last - len(load)
                mine, new = [], []
                for end in chunk_ends(points, start, last):
                    chunk = load[start - first : end - first]
                    d = digest(chunk)
                    mine.append({"digest": d, "len": len(chunk)})
                    if d not in known:
                        known.add(d)
                        frame = press.compress(chunk)
                        new.append({"digest": d, "at": pack.add(frame), "size": len(frame)})
                    start = end
                chunks.append(mine)
                fresh.append(new)
            part = (seen + ends) // SLICE_BYTES
            seen += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(np.full(len(loads), task), pa.int32()), pa.array(part, pa.int32()), pa.array([len(t or b"") for t in texts], pa.int64()),
                    pa.array([wav_header(len(x)) for x in loads], pa.binary()), pa.array(chunks, chunk_kind), pa.array(fresh, place_kind),
                ],
                ["doc_id", "task", "slice", "n_bytes", "header", "chunks", "fresh"],
            )
        if pack:
            pack.close()

    schema = f"doc_id long, task int, slice int, n_bytes long, header binary, chunks {CHUNKS}, fresh {PLACES}"
    return stored(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, schema), f"{folder}/rows")


def dedupe(rows: DataFrame, folder: str) -> DataFrame:
    """Rewrites the packs without what another pack owns; gives digest, task, at, size of every chunk."""
    places = rows.select("task", F.explode("fresh").alias("x")).select("x.digest", "task", "x.at", "x.size")
    owned = places.groupBy("digest").agg(F.min(F.struct("task", "at", "size")).alias("x")).select("digest", "x.*")
    schema = "digest binary, task int, at long, size int"

    def run(_key, t):
        # All chunks of one pack, which is what one task of the first pass has read.
        task = t["task"][0].as_py()
        order = np.argsort(t["at"].to_numpy())
        size = t["size"].to_numpy()[order]
        at = t["at"].to_numpy()[order]
        (fs, first), (_, final) = open_fs(f"{folder}/first/{task:06d}"), open_fs(f"{folder}/packs/{task:06d}")
        done = lambda: fs.get_file_info(final).type.name != "NotFound"
        try:
            if not done():
                pack = Pack(f"{folder}/packs/{task:06d}")
                with fs.open_input_file(first) as f:
                    for a, n in zip(at.tolist(), size.tolist(), strict=True):
                        pack.add(f.read_at(n, a))
                pack.close()
            fs.delete_file(first)
        except OSError:
            # Another run of this task has removed the first pack, for the finished one is there.
            if not done():
                raise
        return t.take(pa.array(order)).set_column(2, "at", pa.array(np.cumsum(np.append(0, size[:-1])), pa.int64()))

    # A column of its own as key: the table that comes in then still has task.
    made = owned.groupBy("task").applyInArrow(run, schema)
    return stored(made, f"{folder}/places")


def read(rows: DataFrame, places: DataFrame, folder: str, features: bool = False) -> DataFrame:
    """doc_id, n_bytes and the media (or, with features, what is computed from it), put together from chunks and verified."""
    wanted = rows.select(F.col("task").alias("reader"), F.col("slice").alias("of"), F.explode("chunks.digest").alias("digest")).distinct()
    found = wanted.join(places.withColumnRenamed("task", "pack"), "digest").select("reader", "of", "digest", "pack", "at", "size")
    schema = "doc_id long, n_bytes long, " + (FEATURES if features else "media binary")

    def run(_key, left, right):
        where = {d: (t, a, n) for d, t, a, n in zip(*(right[c].to_pylist() for c in ("digest", "pack", "at", "size")), strict=True)}
        files, kept, held = {}, {}, 0
        unpress = zstandard.ZstdDecompressor()
        out = []
        for row in left.select(["doc_id", "n_bytes", "header", "chunks"]).to_pylist():
            parts = [row["header"]]
            for c in row["chunks"]:
                d = c["digest"]
                if d not in kept:
                    task, at, n = where[d]
                    if task not in files:
                        if len(files) > 64:
                            files.pop(next(iter(files))).close()
                        fs, path = open_fs(f"{folder}/packs/{task:06d}")
                        files[task] = fs.open_input_file(path)
                    chunk = unpress.decompress(files[task].read_at(n, at))
                    if len(chunk) != c["len"] or digest(chunk) != d:
                        raise ValueError(f"chunk {d.hex()} of document {row['doc_id']} is damaged")
                    if held > CACHE_BYTES:
                        kept, held = {}, 0
                    kept[d], held = chunk, held + len(chunk)
                parts.append(kept[d])
            media = b"".join(parts)
            out.append({"doc_id": row["doc_id"], "n_bytes": row["n_bytes"], **(described(media) if features else {"media": media})})
        for f in files.values():
            f.close()
        return pa.Table.from_pylist(out, schema=_arrow(schema))

    return rows.groupBy("task", "slice").cogroup(found.groupBy("reader", "of")).applyInArrow(run, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: bytes) -> dict:
    load = samples(media)
    x = np.frombuffer(load, np.uint8).astype(np.int64) - 128
    crossed = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    feature = f"sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossed}"
    return {
        "payload_bytes": len(load), "payload_sha256": hashlib.sha256(load).hexdigest(), "tail_crc32": zlib.crc32(load[-BLOCK:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature,
    }


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    rows = store(table(spark, sf_dir, "documents"), folder)
    return read(rows, dedupe(rows, folder), folder, features=True)
