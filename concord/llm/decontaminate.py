"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of a benchmark item; an item of fewer
words is one window. Exact containment asks for every word of a window, so a
prefix of one word is enough: the word of the window that is rarest in all
documents. The words of a document are joined with these prefix words; a
match at position p of a word that stands at offset o of a window of length L
can only be the window at [p - o, p - o + L), which must lie inside the
document (length and position bounds), and is then compared word by word.

1. Items are cut into stretches of at most STRETCH windows, which are dealt to
   blocks of about BLOCK_WORDS words; long items have several stretches.
2. The words of each block are counted in all documents.
3. Spark brings the stretches and word counts of a block together; its index
   (prefix words, offsets and lengths, windows) is a file in the shared folder.
4. Documents are read once more. A task takes HELD_BYTES of text at a time
   through the blocks, with one block in memory; nothing is broadcast, nothing
   but the list of files comes to the driver, and documents are not shuffled.

The plan is the same however many blocks there are.

Defined results: a null or word-less document has no hits; null items and items
without words are ignored; repeated documents and items each keep their row;
an empty benchmark contaminates nothing. Columns named n_words, spans, n_hit,
items or contaminated are replaced; other columns are left alone.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, BATCH_BYTES, WordHash, batches, extended, hashes, mixed, scratch, stored, table, text_bytes, tune_batches
from .elias_fano import dump, loaded

WINDOW = 13
BLOCK_WORDS = 400_000  # of the stretches of a block; each gives at most one window
STRETCH = 4096
HELD_BYTES = 64 << 20  # of text with which a task goes through several blocks
CANDIDATES = 1_000_000  # positions that are compared at a time

SPANS = "array<struct<item_id:string,start:int,end:int>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def stretches(item: list[bytes], window: int) -> list[list[bytes]]:
    """Parts of an item's words that together hold each of its windows once."""
    many = max(1, len(item) - window + 1) if item else 0
    return [item[i : i + STRETCH + window - 1] for i in range(0, many, STRETCH)]


def window_keys(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the size[i] word hashes from start[i] on."""
    out = np.zeros(len(start), np.uint64)
    for j in range(int(size.max(initial=0))):
        odd = mixed(np.array([j + 1], np.uint64)) | np.uint64(1)
        out += np.where(j < size, h[start + np.minimum(j, size - 1)] * odd, np.uint64(0))
    return mixed(out)


class Index:
    """The windows of a block.

    names: prefix words and their numbers; groups: for each its ``at`` offsets
    and ``size`` lengths, from ptr[i] to ptr[i + 1]; keys: windows' hashes mixed
    with their group, ascending; bytes of window i from text[i] to text[i + 1];
    its items from of[i] to of[i + 1] in item.
    """

    NAMES = ("ptr", "at", "size", "keys", "text", "of", "item")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for n in self.NAMES:
            setattr(self, n, arrays[n])
        self.items = json.loads(arrays["items"].tobytes())
        self.raw = arrays["blob"].tobytes()
        self.names = {w: i for i, w in enumerate(arrays["names"].tobytes().split())}

    @staticmethod
    def keyed(key: np.ndarray, group: np.ndarray) -> np.ndarray:
        return mixed(key + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    @classmethod
    def arrays(cls, parts: list[tuple[str, list[bytes]]], count: dict[bytes, int], window: int) -> dict[str, np.ndarray]:
        """parts: item and words of each stretch; count: of each word in all documents."""
        seen, found = WordHash(), {}
        for item, w in parts:
            size = min(window, len(w))
            # Rarest first; ties by word, then by place.
            order = {x: i for i, x in enumerate(sorted(set(w), key=lambda x: (count.get(x, 0), x)))}
            at = np.lib.stride_tricks.sliding_window_view(np.fromiter(map(order.__getitem__, w), np.int64, len(w)), size).argmin(1)
            key = window_keys(hashes(w, seen), np.arange(len(at)), np.full(len(at), size))
            for i, (o, k) in enumerate(zip(at.tolist(), key.tolist(), strict=True)):
                found.setdefault((w[i + o], o, size, k, b" ".join(w[i : i + size])), set()).add(item)
        rows = sorted(found)
        items = sorted({i for x in found.values() for i in x})
        number = {x: i for i, x in enumerate(items)}
        groups = sorted({r[:3] for r in rows})
        place = {g: i for i, g in enumerate(groups)}
        keys = cls.keyed(np.array([r[3] for r in rows], np.uint64), np.array([place[r[:3]] for r in rows], np.int64))
        order = np.argsort(keys, kind="stable")
        rows = [rows[i] for i in order]
        ptr = [i for i, g in enumerate(groups) if i == 0 or g[0] != groups[i - 1][0]]
        lists = [sorted(number[i] for i in found[r]) for r in rows]
        sums = lambda n: np.concatenate(([0], np.cumsum(np.array(n, np.int64)))).astype(np.int64)
        return {
            "names": np.frombuffer(b" ".join(groups[i][0] for i in ptr), np.uint8), "ptr": np.array([*ptr, len(groups)], np.int64), "at": np.array([g[1] for g in groups], np.int64), "size": np.array([g[2] for g in groups], np.int64), "keys": keys[order],
            "text": sums([len(r[4]) for r in rows]), "blob": np.frombuffer(b"".join(r[4] for r in rows), np.uint8), "of": sums([len(x) for x in lists]),
            "item": np.array([i for x in lists for i in x], np.int64), "items": np.frombuffer(json.dumps(items).encode(), np.uint8),
        }

    def find(self, flat: list[bytes], first: np.ndarray, last: np.ndarray, seen: WordHash) -> list[tuple[int, int, str]]:
        """(start, end, item) of each window that stands in a document; first and last: of each word's document."""
        names = self.names
        p = np.array([i for i, w in enumerate(flat) if w in names], np.int64)
        out: list[tuple[int, int, str]] = []
        rank = np.fromiter((names[flat[i]] for i in p.tolist()), np.int64, len(p))
        many = self.ptr[rank + 1] - self.ptr[rank]
        cuts = np.searchsorted(np.cumsum(many), np.arange(CANDIDATES, int(many.sum()), CANDIDATES)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
            n = many[i:j]
            pos = np.repeat(p[i:j], n)
            group = np.repeat(self.ptr[rank[i:j]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(pos)) if len(pos) else pos
            start, size = pos - self.at[group], self.size[group]
            ok = (start >= first[pos]) & (start + size <= last[pos])
            start, size, group = start[ok], size[ok], group[ok]
            # Only the words of candidates are hashed.
            covered = np.zeros(len(flat) + 1, np.int64)
            np.add.at(covered, start, 1)
            np.add.at(covered, start + size, -1)
            at = np.flatnonzero(np.cumsum(covered)[:-1])
            h = np.zeros(len(flat), np.uint64)
            h[at] = hashes([flat[k] for k in at.tolist()], seen)
            key = self.keyed(window_keys(h, start, size), group)
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                s, e = int(start[k]), int(start[k] + size[k])
                text = b" ".join(flat[s:e])
                for w in range(lo[k], hi[k]):
                    if self.raw[self.text[w] : self.text[w + 1]] == text:
                        out += [(s, e, self.items[i]) for i in self.item[self.of[w] : self.of[w + 1]].tolist()]
        return out


def joined(hits: list[tuple[int, int, str]]) -> list[dict]:
    """Spans of a document by item, joined where an item's overlap or touch."""
    by: dict[str, set] = {}
    for s, e, item in hits:
        by.setdefault(item, set()).add((s, e))
    out: list[dict] = []
    for item, spans in sorted(by.items()):
        for s, e in sorted(spans):
            if out and out[-1]["item_id"] == item and s <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], e)
            else:
                out.append({"item_id": item, "start": s, "end": e})
    return out


class Words:
    """The words of some texts, one after the other."""

    def __init__(self, texts: list[bytes | None]):
        docs = [words(t) for t in texts]
        self.n = np.array([len(d) for d in docs], np.int64)
        self.flat = [w for d in docs for w in d]
        self.ends = np.cumsum(self.n)


def _held(frames, blocks: int):
    """Batches in groups of HELD_BYTES, or one by one where there is but one block."""
    most, group = (HELD_BYTES // BATCH_BYTES if blocks > 1 else 1), []
    for b in batches(frames):
        group.append(b)
        if len(group) >= most:
            yield group
            group = []
    if group:
        yield group


def cut_items(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item_id, words (joined) and n (words) of each stretch."""

    def run(frames):
        for b in batches(frames):
            rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True) for w in stretches(words(t), window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.string()), pa.array([b" ".join(w) for _, w in rows], pa.binary()), pa.array([len(w) for _, w in rows], pa.int64())],
                ["item_id", "words", "n"],
            )

    given = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    return given.mapInArrow(run, "item_id string, words binary, n long").distinct()


def write_vocabularies(parts: DataFrame, folder: str) -> list[tuple[int, str]]:
    """A file of the words of each block."""

    def run(_key, t):
        block = t["block"][0].as_py()
        path = f"{folder}/words-{block:06d}"
        dump(path, {"words": np.frombuffer(b" ".join(sorted({w for x in t["words"].to_pylist() for w in x.split()})), np.uint8)})
        return pa.Table.from_pylist([{"block": block, "path": path}], pa.schema([("block", pa.int32()), ("path", pa.string())]))

    made = stored(parts.groupBy("block").applyInArrow(run, "block int, path string"), f"{folder}/vocabularies")
    return [tuple(r) for r in made.orderBy("block").collect()]  # a row a block


def count_words(docs: DataFrame, text: str, vocabularies: list[tuple[int, str]]) -> DataFrame:
    """block, word, n: how often each of a block's words stands in all documents."""

    def run(frames):
        kept: dict[int, frozenset] = {}
        n: Counter = Counter()

        def counted(block):
            return pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int32()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["block", "word", "n"])

        for group in _held(frames, len(vocabularies)):
            read = [Words(text_bytes(b.column(0))).flat for b in group]
            for block, path in vocabularies:
                if block not in kept:
                    if kept:
                        yield counted(next(iter(kept)))
                    n.clear()
                    kept = {block: frozenset(loaded(path)["words"].tobytes().split())}
                for flat in read:
                    n.update(filter(kept[block].__contains__, flat))
        if kept:
            yield counted(next(iter(kept)))

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "block int, word binary, n long").groupBy("block", "word").agg(F.sum("n").alias("n"))


def write_indexes(parts: DataFrame, counts: DataFrame, window: int, folder: str) -> list[str]:
    """The index of each block, as a file."""

    def run(_key, left, right):
        if not left.num_rows:
            return pa.table({"path": pa.array([], pa.string())})
        count = dict(zip(right["word"].to_pylist(), right["n"].to_pylist(), strict=True))
        path = f"{folder}/index-{left['block'][0].as_py():06d}"
        rows = [(i, w.split()) for i, w in zip(left["item_id"].to_pylist(), left["words"].to_pylist(), strict=True)]
        dump(path, Index.arrays(rows, count, window))
        return pa.table({"path": pa.array([path], pa.string())})

    made = stored(parts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, "path string"), f"{folder}/indexes")
    return [r.path for r in made.orderBy("path").collect()]  # a row a block


def with_spans(docs: DataFrame, text: str, paths: list[str]) -> DataFrame:
    """docs with n_words and spans; no shuffle."""
    docs, schema = extended(docs, f"n_words long, spans {SPANS}")
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(frames):
        seen, kept = WordHash(), {}
        for group in _held(frames, len(paths)):
            read = [Words(text_bytes(b.column(at))) for b in group]
            hits = [[[] for _ in w.n] for w in read]
            for path in paths:
                if path not in kept:
                    kept.clear()
                    kept[path] = Index(loaded(path))
                for w, mine in zip(read, hits, strict=True):
                    first, last = np.repeat(w.ends - w.n, w.n), np.repeat(w.ends, w.n)
                    for s, e, item in kept[path].find(w.flat, first, last, seen):
                        base = int(first[s])
                        mine[int(np.searchsorted(w.ends, s, side="right"))].append((s - base, e - base, item))
            for b, w, mine in zip(group, read, hits, strict=True):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w.n), pa.array([joined(x) for x in mine], kind)], [*b.schema.names, "n_words", "spans"])

    return docs.mapInArrow(run, schema)


def _covered(spans: Column) -> Column:
    """Words inside at least one span."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        ordered,
        zero,
        lambda a, x: F.struct(
            F.greatest(a["end"], x["e"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"])).cast("long")).alias("n"),
        ),
        lambda a: a["n"],
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    folder: str | None = None,
) -> DataFrame:
    """docs and, for each row, n_words, spans (item, start, end in words), n_hit, items, contaminated."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "decontamination")
    tune_batches(spark)
    parts = stored(cut_items(items, item_id, item_text, window), f"{folder}/stretches")
    blocks = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // block_words))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int"))
    vocabularies = write_vocabularies(parts, folder)
    counts = count_words(docs, text, vocabularies)
    out = with_spans(docs, text, write_indexes(parts, counts, window, folder) if vocabularies else [])
    out = out.withColumn("n_hit", _covered(F.col("spans"))).withColumn("items", F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["item_id"]))))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
