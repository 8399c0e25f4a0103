"""Helpers shared by the training-data operators: files, byte words, token ids."""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.files import opened as open_fs
from concord.files import remove as drop_scratch
from concord.files import scratch, stored


# Bytes of text that one Arrow batch may bring to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_file(uri: str, fill: Callable[[pa.NativeFile], None]) -> None:
    """Writes a file under a name of its own, then renames it: a repeated or
    killed task never leaves half a file under the final name."""
    fs, at = open_fs(uri)
    fs.create_dir(posixpath.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        fill(out)
    fs.move(part, at)


def tune_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch holds, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.binary()).to_pylist()


def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        if b.num_rows:
            yield b


def lower_az(keep: Callable[[int], bool] | None = None) -> bytes:
    """A byte table that lower-cases A-Z and turns bytes outside keep to spaces."""
    out = bytearray(range(256))
    for c in range(256):
        if 0x41 <= c <= 0x5A:
            out[c] = c + 32
        elif keep is not None and not keep(c):
            out[c] = 0x20
    return bytes(out)


#: A-Z lower-cased; white space is what bytes.split() takes: \x20 and \x09-\x0D.
PLAIN = lower_az()
#: Words are runs of 0-9, a-z and everything beyond ASCII.
ALNUM = lower_az(lambda c: 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80)


class WordHash(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def hashes(words: list[bytes], seen: WordHash) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class ByteWords:
    """64-bit hashes of the words of a column of texts, without a Python object for each word.

    A word of bytes c hashes to the sum of LETTER[c[i]] * BASE**i, which is the
    difference of two running sums over the text, divided by a power of BASE
    (BASE is odd, so it has an inverse modulo 2**64), mixed with its length.
    Texts are taken in stretches of PART bytes, whatever the length of a word.
    """

    PART = 1 << 18
    BASE = 0x9E6C63D0876A9A63  # odd

    def __init__(self, table: bytes):
        """table: what each byte becomes; white space (as bytes.split has it) ends a word."""
        self.table = np.frombuffer(table, np.uint8)
        self.letter = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[self.table]
        self.inside = ~np.isin(self.table, [0x20, 9, 10, 11, 12, 13])
        self.letter[~self.inside] = 0
        n = self.PART + 1
        self.power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, self.BASE, np.uint64))))
        self.inverse = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64))))

    @staticmethod
    def finished(h: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mixed(h ^ (size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))

    def of(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of bytes, in order, and where each begins. breaks: ascending places at which a text begins, which end a word before them."""
        hashes, places = [], []
        held, held_size, held_at = np.uint64(0), 0, 0  # a word that goes on in the next stretch
        for lo in range(0, len(data), self.PART):
            part = data[lo : lo + self.PART]
            # With clip, numpy takes straight into the result.
            inside = np.take(self.inside, part, mode="clip")
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            cut = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, lo + len(part))] - lo
            first[cut] = inside[cut]
            going = bool(held_size) and inside[0] and not (len(cut) and cut[0] == 0)
            if held_size and not going:
                hashes.append(self.finished(np.array([held]), np.array([held_size])))
                places.append(np.array([held_at]))
                held_size = 0
            if going:
                first[0] = True
            start = np.flatnonzero(first)
            if not len(start):
                continue
            # A word ends before the next byte that is outside, or at which another begins.
            final = inside.copy()
            final[:-1] &= ~inside[1:] | first[1:]
            end = np.flatnonzero(final) + 1
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.take(self.letter, part, out=sums[1:], mode="clip")
            sums[1:] *= self.power[: len(part)]
            np.cumsum(sums[1:], out=sums[1:])
            h, size = (sums[end] - sums[start]) * self.inverse[start], end - start
            place = start + lo
            if going:
                h[:1] = held + h[:1] * np.uint64(pow(self.BASE, held_size, 1 << 64))
                size[0] += held_size
                place[0] = held_at
            held_size = 0
            if end[-1] == len(part):
                held, held_size, held_at = h[-1], int(size[-1]), int(place[-1])
                h, size, place = h[:-1], size[:-1], place[:-1]
            hashes.append(self.finished(h, size))
            places.append(place)
        if held_size:
            hashes.append(self.finished(np.array([held]), np.array([held_size])))
            places.append(np.array([held_at]))
        return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all rows, one row after the other, and how many each row has; a null has none."""
        column = pc.fill_null(column, "").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        starts = offsets - offsets[0]
        h, at = self.of(raw, np.unique(starts[:-1][starts[:-1] < len(raw)]))
        return h, np.diff(np.searchsorted(at, starts))

    def word(self, word: bytes) -> int:
        """The hash of one word, or of no bytes at all."""
        if not word:
            return int(self.finished(np.zeros(1, np.uint64), np.zeros(1, np.int64))[0])
        return int(self.of(np.frombuffer(word, np.uint8), np.zeros(1, np.int64))[0][0])


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in an order in which most equal ones follow each other, and where a new value starts there.

    Of few bits of the value and the place one number is made, whose sort is much
    faster than one that keeps track of places. Values that agree in those bits
    only may stand between equal ones, which then start more than once.
    """
    bits = max(1, int(len(h) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    v = h[order]
    return order, np.concatenate((np.ones(min(1, len(v)), bool), v[1:] != v[:-1]))


def ascending(k: np.ndarray) -> np.ndarray:
    """Places of int64 values >= 0 in ascending order."""
    if not len(k):
        return np.empty(0, np.int64)
    bits, wide = max(1, int(len(k) - 1).bit_length()), int(k.max()).bit_length()
    cut = max(0, wide + bits - 63)
    key = (k >> cut << bits) | np.arange(len(k))
    key.sort()
    order = key & ((1 << bits) - 1)
    if cut:
        v = k[order]
        if (v[1:] < v[:-1]).any():
            # Nearly sorted: merging runs is fast.
            order = order[np.argsort(v, kind="stable")]
    return order


#: Stretches of plain characters only: visible ASCII and Latin-1 letters, which NFC leaves alone.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]{1,100}")
#: What the vocabulary's own splitter makes of such a stretch, once lower-cased.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# The parts of a tokenizer file for which texts may be cut at white space and pieces encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself if visible, else one from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Lower-case piece -> its ids as bytes, by the tokenizer's BPE model."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most, self.letters = model, most, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        v = self[piece] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return v


class Encoder(dict):
    """Text -> token ids (little-endian unsigned 32-bit), by the tokenizers library.

    A tokenizer of the known kind never joins across white space, so each
    stretch between spaces or line feeds is encoded once and remembered, up to a
    bound. A stretch of plain characters is cut as the vocabulary's splitter
    would and its pieces go to the library's BPE model; any other goes through
    the whole tokenizer. With any other kind of tokenizer (``known`` is false)
    each text goes through it as a whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pieces = Pieces(self.whole.model, most)
        self.most = most
        said = json.loads(self.whole.to_str())
        self.known = (
            said["normalizer"] == _NORMALIZER and said["pre_tokenizer"] == _SPLITTER and not said["truncation"] and not said["padding"]
            and said["model"]["type"] == "BPE" and not said["model"]["dropout"]
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] or not t["content"].startswith("<|") for t in said["added_tokens"])
        )

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            v = b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))
        else:
            v = self.ids(word)
        if len(word) <= 100:
            if len(self) >= self.most:
                self.clear()
            self[word] = v
        return v

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null and empty texts have none."""
        if not self.known:
            return [self.ids(t) if t else b"" for t in texts]
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


def encoder(path: str, _kept: dict = {}) -> Encoder:  # noqa: B006
    """One Encoder for each worker process and vocabulary."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hash_bucket(column: str, mod: int):
    """crc32 of a number as text, modulo mod."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def extended(df: DataFrame, ddl: str) -> tuple[DataFrame, StructType]:
    """df without columns named as in ddl (results replace them), and its schema with ddl's columns added."""
    more = StructType.fromDDL(ddl)
    df = df.drop(*(c for c in df.columns if c in more.names))
    return df, StructType([*df.schema.fields, *more.fields])
