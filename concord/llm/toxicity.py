"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, how
near second-person words stand to lexicon words, capitals, punctuation, and how
often words are obfuscated (leet digits, inner symbols, stars). The trees fit
logistic loss on binned features (Newton steps); isotonic regression on labelled
rows that the trees have not seen turns their margin into a probability.

Labels are learned from at most SAMPLE labelled rows, those of the smallest
hashes of doc_id. Their words are counted and their features worked out by
Spark; no text comes to the driver. Every row is scored, in one pass without a shuffle. Only the
text goes into a score.

Defined results: null and empty texts get the score of their (all-zero)
features; rows without a label or with a null one are not learned from; with no
labelled rows, or labels of one kind only, the score is the share of label 1
(0 without rows). With fewer than FEW labelled rows, or labels of one kind only
among those for calibration or for the trees, the trees learn from all of them
and the score is their own probability, not calibrated. Repeated rows score alike. Input columns that are named like
results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, batches, drop_scratch, extended, hash_bucket, scratch, stored, table, text_bytes, tune_batches

SAMPLE = 12_000
LIMIT = 0.7
TREES, DEPTH, RATE, RIDGE, BINS, LEAST = 60, 3, 0.2, 1.0, 32, 5.0
CALIBRATE = 4  # one labelled row of so many is kept for calibration
FEW = 40  # labelled rows; with fewer, none is kept for calibration
LEARNED = 200

# Insults and second-person words.
INSULTS = "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting garbage fool jerk imbecile vermin filth hate ugly shut idiota imbécil estúpido basura idioot dumm blöd abschaum müll stupide imbécile ordure minable"
SECOND = "you your yours yourself u ur youre du dich dir dein deine ihr euch tu te toi ton ta vous votre ti tus usted"
LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")

FEATURES = (
    "lexicon", "lexicon_log", "learned", "learned_log", "near_you", "you", "obfuscated_hits", "obfuscated", "capitals", "shouted",
    "punctuation", "exclaimed", "symbols", "digits", "repeats", "words_log", "word_length", "variety",
)

_SUSPECT = re.compile(rb"(?<![A-Za-z0-9])[A-Za-z0-9@$!*._-]*(?:[A-Za-z][0-9@$!*._-]|[0-9@$!*][A-Za-z])[A-Za-z0-9@$!*._-]*[A-Za-z]")
_REPEAT = re.compile(rb"([A-Za-z])\1\1")
_SHOUT = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")


def lexicon_of(words: str) -> frozenset[bytes]:
    return frozenset(w.encode() for w in words.split())


def starred(lexicon: frozenset[bytes]) -> frozenset[bytes]:
    return frozenset(w[:i] + b"*" + w[i + 1 :] for w in lexicon for i in range(1, len(w) - 1))


class Features:
    def __init__(self, learned: frozenset[bytes] = frozenset()):
        self.insults, self.you, self.learned = lexicon_of(INSULTS), lexicon_of(SECOND), learned
        self.starred = starred(self.insults)

    def unmasked(self, word: bytes) -> bool:
        """Whether a word with inner symbols or leet digits hides a lexicon word."""
        w = word.lower()
        if w in self.starred or re.sub(rb"[._-]", b"", w) in self.insults:
            return True
        return re.sub(rb"[^a-z]", b"", w.translate(LEET)) in self.insults

    def __call__(self, text: bytes | None) -> list[float]:
        words = text.translate(ALNUM).split() if text else []
        if not words:
            return [0.0] * len(FEATURES)
        n = len(words)
        b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        letters = int(b[65:91].sum() + b[97:123].sum() + b[0xC3:].sum()) or 1
        marks = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        symbols = int(b[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 124, 126]].sum())
        hits = [] if self.insults.isdisjoint(words) else [i for i, w in enumerate(words) if w in self.insults]
        extra = 0 if self.learned.isdisjoint(words) else sum(map(self.learned.__contains__, words))
        you = [] if self.you.isdisjoint(words) else [i for i, w in enumerate(words) if w in self.you]
        near = 0.0
        if hits and you:
            at = np.searchsorted(you, hits)
            y = np.array([-(10**9), *you, 10**9])
            near = 1.0 / (1.0 + float(np.minimum(np.abs(y[at + 1] - hits), np.abs(np.array(hits) - y[at])).min()))
        suspects = [m[0] for m in _SUSPECT.finditer(text)]
        hidden = sum(map(self.unmasked, suspects))
        return [
            len(hits) / n, np.log1p(len(hits)), extra / n, np.log1p(extra), near, len(you) / n, np.log1p(hidden), len(suspects) / n,
            int(b[65:91].sum()) / letters, len(_SHOUT.findall(text)) / n, marks / len(text), int(b[33] + b[63]) / n, symbols / len(text),
            int(b[48:58].sum()) / len(text), len(_REPEAT.findall(text)) / n, np.log1p(n), letters / n, len(set(words)) / n,
        ]


def words_of(text: bytes) -> set[bytes]:
    """What of a text may come into the learned lexicon."""
    return {w for w in text.translate(ALNUM).split() if len(w) > 2}


def chosen_words(with_1: dict, with_0: dict, n1: int, n0: int, most: int = LEARNED) -> frozenset[bytes]:
    """Words whose share of the n1 texts with label 1 is far above that of the n0 with label 0; with_1, with_0: texts that hold each."""
    scored = []
    for w, k in with_1.items():
        if k >= max(5, 0.01 * n1):
            odds = np.log((k + 0.5) / (n1 + 1)) - np.log((with_0.get(w, 0) + 0.5) / (n0 + 1))
            if odds > 3:
                scored.append((-odds * np.log1p(k), w))
    return frozenset(w for _, w in sorted(scored)[:most])


def learn_lexicon(texts: list[bytes], y: np.ndarray) -> frozenset[bytes]:
    """Equal texts count once, with the last one's label."""
    once = {t: v for t, v in zip(texts, y, strict=True) if t}
    with_1, with_0, n1 = Counter(), Counter(), int(sum(once.values()))
    for t, v in once.items():
        (with_1 if v else with_0).update(words_of(t))
    return chosen_words(with_1, with_0, n1, len(once) - n1)


class Trees:
    """Newton boosting on binned features; complete trees of fixed depth as arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        # A leaf of few rows may be smaller.
        self.least = min(LEAST, max(1.0, len(y) // 8))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.start)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            f, c, v, leaf = self._tree(b, p - y, np.maximum(p * (1 - p), 1e-9))
            self.feature.append(f)
            self.cut.append(c)
            self.value.append(v)
            margin = margin + v[leaf]
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        f, c = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS + 1)
        node = np.zeros(len(b), int)
        for depth in range(DEPTH):
            base, many = 2**depth - 1, 2**depth
            at = node - base
            best = np.full(many, 1e-9)
            for j in range(b.shape[1]):
                k = at * (BINS + 1) + b[:, j]
                gs, hs = (np.bincount(k, w, many * (BINS + 1)).reshape(many, -1).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                n = np.bincount(k, minlength=many * (BINS + 1)).reshape(many, -1).cumsum(1)
                gain[(n < self.least) | (n[:, -1:] - n < self.least)] = -1
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(many), top] > best):
                    best[i], f[base + i], c[base + i] = gain[i, top[i]], j, top[i]
            node = 2 * node + 1 + (b[np.arange(len(b)), f[node]] > c[node])
        leaf = node - (2**DEPTH - 1)
        v = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        return f, c, v, leaf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing means."""
    values, inverse = np.unique(x, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []
    for v, k, s in zip(values, n, np.bincount(inverse, y), strict=True):
        blocks.append([v, v, s, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, s1, k1 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + s1, blocks[-1][3] + k1]
    knots, means = [], []
    for lo, hi, s, k in blocks:
        knots += [lo, hi] if hi > lo else [lo]
        means += [s / k] * (2 if hi > lo else 1)
    return np.array(knots), np.array(means)


def roles(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept for calibration, and the places of those from which words are learned.

    The learned words come from rows whose features the trees don't learn from
    alone: half and half.
    """
    kept = np.arange(len(y)) % CALIBRATE == 0
    if len(y) < FEW or len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept[:] = False
    return kept, np.flatnonzero(~kept)[::2]


class Model:
    def __init__(self, share: float = 0.0):
        self.share, self.trees, self.learned = share, None, frozenset()

    def fit(self, texts: list[bytes], y: np.ndarray) -> "Model":
        """From texts at hand; train gives the same from a table."""
        self.share = float(y.mean()) if len(y) else 0.0
        if len(set(y)) < 2:
            return self
        kept, half = roles(y)
        self.learned = learn_lexicon([texts[i] for i in half], y[half])
        make = Features(self.learned)
        return self.fit_features(np.array([make(t) for t in texts]), y, kept)

    def fit_features(self, x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> "Model":
        self.trees = Trees().fit(x[~kept], y[~kept])
        self.calibration = isotonic(self.trees.margin(x[kept]), y[kept]) if kept.any() else None
        return self

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        make = Features(self.learned)
        margin = self.trees.margin(np.array([make(t) for t in texts]))
        return np.interp(margin, *self.calibration) if self.calibration else 1 / (1 + np.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, folder: str, text: str = "text", sample: int = SAMPLE) -> Model:
    """labels: doc_id and label; at most sample rows are learned from. Of them only ids, the learned words and features come to the driver."""
    spark = docs.sparkSession
    tune_batches(spark)
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = given.join(F.broadcast(chosen), "doc_id").select("doc_id", "h", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample).collect()
    y = np.array([r.label for r in rows], float)
    model = Model(float(y.mean()) if len(y) else 0.0)
    if len(set(y)) < 2:
        return model
    kept, half = roles(y)
    # One row for each id and text, and for each text one that may teach words: the last.
    teaches = {rows[i].h: i for i in half.tolist()}
    wanted = {(r.doc_id, r.h): i for i, r in enumerate(rows)}
    frame = spark.createDataFrame([(d, h, int(y[i]), h in teaches and rows[teaches[h]].doc_id == d, int(y[teaches[h]]) if h in teaches else 0) for (d, h), i in wanted.items()], "doc_id long, h long, label int, teaches boolean, says int")
    picked = stored(given.join(F.broadcast(frame), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]), f"{folder}/labelled")

    def count(frames):
        n: Counter = Counter()
        for b in batches(frames):
            for t, v in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                n.update((w, v) for w in words_of(t))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.binary()), pa.array([v for _, v in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["word", "label", "n"])

    taught = picked.where("teaches AND t <> ''")
    n1, texts = taught.agg(F.coalesce(F.sum("says"), F.lit(0)), F.count("*")).first()
    words = taught.select("t", "says").mapInArrow(count, "word binary, label int, n long").groupBy("word")
    words = words.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"))
    # By the rule of chosen_words, so that few words come to the driver.
    frequent = words.where((F.col("n1") >= max(5, 0.01 * n1)) & (F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (texts - n1 + 1)) > 3)).collect()
    model.learned = chosen_words({bytes(r.word): r.n1 for r in frequent}, {bytes(r.word): r.n0 for r in frequent}, n1, texts - n1)
    learned = model.learned

    def features(frames):
        make = Features(learned)
        for b in batches(frames):
            x = [make(t) for t in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "h", "x"])

    x = {(r.doc_id, r.h): r.x for r in picked.select("doc_id", "h", "t").mapInArrow(features, "doc_id long, h long, x array<double>").collect()}  # at most sample rows of numbers
    drop_scratch(f"{folder}/labelled")
    return model.fit_features(np.array([x[r.doc_id, r.h] for r in rows]), y, kept)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """docs with score and predicted."""
    tune_batches(docs.sparkSession)
    docs, schema = extended(docs, "score double, predicted int")
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for b in batches(frames):
            s = np.clip(held.value.score(text_bytes(b.column(at))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= limit).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(hash_bucket("doc_id", 3) != 1)
    out = score_toxicity(docs, train(docs, labels, scratch(spark, "toxicity")))
    return out.select("doc_id", (hash_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
