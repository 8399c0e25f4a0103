"""N-gram language model in an Elias-Fano trie, learned and queried over all documents.

Level 1 holds the words: their sorted 64-bit hashes (ByteWords) and the running sum of their
counts, both monotone and Elias-Fano coded; a word's rank is its id. Level 2
holds the pairs that occur: for each context the monotone pointers to its
children, and the children as ascending context * V + word, with the quantised
discounted probability of each. A pair is looked up by a successor search within
its context's children. Level 3 holds all triples that occur, in the file of the
pair that is their context: ascending pair's rank in the file * V + word, with
the quantised discounted probability of each, and for each pair the quantised
share that goes to level 2.

    p(w | b, c) = max(n(b, c, w) - D, 0) / n(b, c) + D * children(b, c) / n(b, c) * p(w | c)
    p(w | c)    = max(n(c, w) - D, 0) / n(c) + D * children(c) / n(c) * p(w)
    p(w)        = (n(w) + 1) / (N + V + 1)

score is of all three levels, bigram_score of the first two. The first word of a
document has the end of a document as its only context; an unknown context
leaves the probability of the level below.

Level 1 is dealt to files by the top bits of the hash. Levels 2 and 3 are dealt
by where a pair would stand among all pairs if words were independent, known
from level 1 alone: files are ranges of the trie of like size, without a sampling
pass, and a frequent word is split between several as a context; a pair is not.
Triples are counted once for both levels (each pair of a document starts a
triple, the last one with nothing after it), added up in each task and shuffled
as arrays. Nothing but totals and one row for each file reaches the driver.

Defined results: a null text counts as empty and is just its end; with nothing
to learn from, p is 1 over 1 (an empty model knows no word); repeated rows count
and are scored each; over 3.03e9 distinct words are an error, for a pair of them
must fit in 63 bits. Input columns named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN, ByteWords, ascending, batches, extended, grouped, hash_bucket, scratch, stored, table, tune_batches
from .elias_fano import EliasFano, Opened, dump

DISCOUNT = 0.75
END = np.uint64(ByteWords(PLAIN).word(b""))  # no word is empty
FLUSH = 2_000_000  # tokens that a task adds up at a time
FILE = 3_000_000  # words, or tokens of pairs, for each file
PIECE = 200_000  # triples in a row of the shuffle
STEP = 12.0 / 65535  # of a quantised log10 probability
WORDS_KEPT = 400_000
POWERS = 10.0 ** (-STEP * np.arange(65536))


def counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands there."""
    k = np.sort(np.concatenate(keys))
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[starts], np.diff(np.append(starts, len(k)))


def _pieces(rows: list, names: list[str], size: int = 200_000):
    for i in range(0, len(rows[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in rows], names)


def count_words(docs: DataFrame) -> DataFrame:
    """hash and n of each word, the end among them."""

    def run(frames):
        read, kept, many = ByteWords(PLAIN), [], 0
        for b in batches(frames):
            h, _ = read(b.column(0))
            kept += [h, np.full(b.num_rows, END)]
            many += len(h) + b.num_rows
            if many >= FLUSH:
                yield from _pieces([x.view(np.int64) for x in counted(kept)], ["hash", "n"])
                kept, many = [], 0
        if kept:
            yield from _pieces([x.view(np.int64) for x in counted(kept)], ["hash", "n"])

    return docs.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def write_words(words: DataFrame, folder: str, total: int) -> list[tuple[str, int, int, int]]:
    """Writes level 1; gives (path, top bits, words, tokens) of each file in order."""
    bits = max(0, (-(-total // FILE) - 1).bit_length())
    top = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = words.select(top.alias("file"), "hash", "n").repartition(1 << bits, "file").sortWithinPartitions("file", F.shiftrightunsigned("hash", 1), F.col("hash").bitwiseAND(F.lit(1)))
    schema = "path string, file long, words long, tokens long"

    def run(frames):
        file, hashes, n = None, [], []

        def close():
            h, c = np.concatenate(hashes).view(np.uint64), np.concatenate(n)
            path = f"{folder}/words-{file:05d}.trie"
            dump(path, EliasFano.of(h).arrays("hash") | EliasFano.of(np.concatenate(([0], np.cumsum(c)))).arrays("sum"))
            return pa.RecordBatch.from_pylist([{"path": path, "file": file, "words": len(h), "tokens": int(c.sum())}])

        for b in batches(frames):
            f, h, c = (b.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if file is not None and f[i] != file:
                    yield close()
                    hashes, n = [], []
                file = int(f[i])
                hashes.append(h[i:j])
                n.append(c[i:j])
        if file is not None:
            yield close()

    made = stored(dealt.mapInArrow(run, schema), f"{folder}/word-files")
    return [tuple(r) for r in made.orderBy("file").collect()], bits


class Words:
    """Level 1 in a worker: hash of a word -> row of arrays id, n (count) and before (sum of the counts of lower ids)."""

    def __init__(self, model: "Model"):
        self.bits, self.files = model.bits, {}
        ids = sums = 0
        for path, file, words, total in model.words:
            self.files[file] = (path, ids, sums, words)
            ids, sums = ids + words, sums + total
        self.open = Opened(lambda a: (EliasFano.load(a, "hash"), EliasFano.load(a, "sum")))
        self.clear()

    def clear(self) -> None:
        self.known, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in order, and their rows
        self.id, self.n, self.before = (np.empty(0, np.int64) for _ in range(3))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id (-1: unknown), count and sum of lower counts, for uint64 hashes."""
        ids, n, before = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for file in np.unique(top).tolist():
            if file not in self.files:
                continue
            path, first, base, _ = self.files[file]
            names, sums = self.open[path]
            k = np.flatnonzero((top == file) & (hashes >= np.uint64(names.base)))
            k = k[np.argsort(hashes[k])]
            i, found = names.successor(hashes[k] - np.uint64(names.base))
            k, i = k[found], i[found]
            low = sums.access(i)
            ids[k], before[k], n[k] = first + i, base + low, sums.access(i + 1) - low
        return ids, n, before

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Row numbers of words; those of an earlier call may be gone once there are over WORDS_KEPT."""
        if len(self.id) > WORDS_KEPT:
            self.clear()
        order, new = grouped(h)
        distinct = h[order[new]]
        row = np.full(len(distinct), -1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            hit = self.known[at] == distinct
            row[hit] = self.at[at[hit]]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            u = np.unique(distinct[missing])
            first = len(self.id)
            row[missing] = first + np.searchsorted(u, distinct[missing])
            self.id, self.n, self.before = (np.concatenate(x) for x in zip((self.id, self.n, self.before), self.find(u), strict=True))
            at = np.searchsorted(self.known, u)
            self.known, self.at = np.insert(self.known, at, u), np.insert(self.at, at, np.arange(first, len(self.id)))
        out = np.empty(len(h), np.int64)
        out[order] = row[np.cumsum(new) - 1]
        return out


def file_of(c: np.ndarray, c_n: np.ndarray, w: np.ndarray, total: int, files: int) -> np.ndarray:
    """Level-2 file of pairs: sums below and counts of their contexts, sums below their words."""
    return np.minimum((c + c_n * (w / total)) * (files / total), files - 1).astype(np.int64)


def framed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of documents, n of each, between two ends a document (the first is only a context); where each begins, and the place after it."""
    stop = np.cumsum(n + 2)
    start = stop - n - 2
    out = np.full(int(stop[-1]), END)
    word = np.ones(len(out), bool)
    word[start] = word[stop - 1] = False
    out[word] = h
    return out, start, stop


def counted_triples(pair: np.ndarray, after: np.ndarray, n: np.ndarray | None, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, word after it) in order, the sum of n (or how often each stands there), and a place of each."""
    order = ascending(pair)
    p = pair[order]
    # The pair's rank and the word fit in one number.
    key = np.zeros(len(p), np.int64)
    np.cumsum(p[1:] != p[:-1], out=key[1:])
    key *= distinct + 1
    key += after[order]
    order = order[ascending(key)]
    del p, key
    pair, after = pair[order], after[order]
    starts = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (after[1:] != after[:-1]))))
    n = np.diff(np.append(starts, len(pair))) if n is None else np.add.reduceat(n[order], starts)
    return pair[starts], after[starts], n, order[starts]


def count_triples(docs: DataFrame, model: "Model") -> DataFrame:
    """file, and arrays of pair, after and n, added up within each task; after is V where a document ends with the pair."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = held.value
        words, read, kept, many = Words(m), ByteWords(PLAIN), [], 0

        def flush():
            pair, after, file = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            pair, after, n, at = counted_triples(pair, after, None, m.distinct)
            file = file[at]
            cuts = [0, *(np.flatnonzero(file[1:] != file[:-1]) + 1).tolist(), len(file)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for i in range(lo, hi, PIECE):
                    j = min(hi, i + PIECE)
                    # Differences of ascending pairs are small and compress well.
                    row = {"file": int(file[lo]), "pair": np.diff(pair[i:j], prepend=0).tobytes(), "after": after[i:j].tobytes(), "n": n[i:j].tobytes()}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.int32()), ("pair", pa.binary()), ("after", pa.binary()), ("n", pa.binary())]))

        for b in batches(frames):
            if many >= FLUSH:
                yield from flush()
                many = 0
            h, _, stop = framed(*read(b.column(0)))
            row = words.rows(h)
            ids = words.id[row]
            after = np.append(ids[2:], m.distinct)
            after[stop - 2] = m.distinct
            # No pair goes over from a document to the next.
            inside = np.ones(len(ids), bool)
            inside[stop - 1] = False
            c, w = row[:-1][inside[:-1]], row[1:][inside[:-1]]
            kept.append((words.id[c] * m.distinct + words.id[w], after[inside[:-1]], file_of(words.before[c], words.n[c], words.before[w], m.total, m.files).astype(np.int32)))
            many += len(c)
        if kept:
            yield from flush()

    return docs.mapInArrow(run, "file int, pair binary, after binary, n binary")


def quantised(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-np.log10(np.maximum(p, 1e-12)) / STEP, 0, 65535)).astype(np.uint16)


def write_pairs(triples: DataFrame, model: "Model", folder: str) -> list[tuple]:
    """Writes levels 2 and 3; gives path, file and, of its first and last context, id and number of children."""
    held = triples.sparkSession.sparkContext.broadcast(model)
    dealt = triples.repartitionById(model.files, "file")
    schema = "path string, file long, first long, first_n long, last long, last_n long"

    def run(frames):
        m = held.value
        words = Words(m)
        rows: dict[int, list[tuple]] = {}
        for b in batches(frames):
            for r in b.to_pylist():
                pair, after, n = (np.frombuffer(r[x], np.int64) for x in ("pair", "after", "n"))
                rows.setdefault(r["file"], []).append((np.cumsum(pair), after, n))
        for file in sorted(rows):
            pair, after, n, _ = counted_triples(*map(np.concatenate, zip(*rows.pop(file), strict=True)), m.distinct)
            new = np.concatenate(([True], pair[1:] != pair[:-1]))
            rank = np.cumsum(new) - 1
            k, sums = pair[new], np.add.reduceat(n, np.flatnonzero(new))
            c = k // m.distinct
            first, last = int(c[0]), int(c[-1])
            children = np.bincount(c - first, minlength=last - first + 1)
            total = context_counts(words, np.arange(first, last + 1))[c - first]
            real = after < m.distinct
            rank, after, n = rank[real], after[real], n[real]
            path = f"{folder}/pairs-{file:05d}.trie"
            dump(
                path,
                EliasFano.of(k).arrays("key")
                | EliasFano.of(np.concatenate(([0], np.cumsum(children)))).arrays("pointer")
                | {"p": quantised((sums - DISCOUNT) / total), "first": np.array([first])}
                | EliasFano.of(rank * m.distinct + after).arrays("next")
                | {"next_p": quantised((n - DISCOUNT) / sums[rank]), "rest": quantised(DISCOUNT * np.bincount(rank, minlength=len(k)) / sums)},
            )
            yield pa.RecordBatch.from_pylist([{"path": path, "file": file, "first": first, "first_n": int(children[0]), "last": last, "last_n": int(children[-1])}])

    made = stored(dealt.mapInArrow(run, schema), f"{folder}/pair-files")
    return [tuple(r) for r in made.orderBy("file").collect()]


def context_counts(words: Words, ids: np.ndarray) -> np.ndarray:
    """Counts of consecutive ids."""
    out = np.zeros(len(ids), np.int64)
    for path, first, _, many in words.files.values():
        k = np.flatnonzero((ids >= first) & (ids < first + many))
        if len(k):
            sums = words.open[path][1]
            out[k] = sums.access(ids[k] - first + 1) - sums.access(ids[k] - first)
    return out


class Model:
    """What the executors need to find the files: a row for each, and the totals."""

    def __init__(self, words: list[tuple], bits: int, total: int, distinct: int):
        self.words, self.bits, self.total, self.distinct = words, bits, total, distinct
        self.files = max(1, -(-total // FILE))
        self.pairs: dict[int, str] = {}
        self.split: dict[int, int] = {}

    def add_pairs(self, files: list[tuple]) -> None:
        for path, file, first, first_n, last, last_n in files:
            self.pairs[file] = path
            self.split[first] = self.split.get(first, 0) + first_n
            if last != first:
                self.split[last] = self.split.get(last, 0) + last_n


class Scorer:
    """The trie in a worker."""

    def __init__(self, model: Model):
        self.model, self.words, self.read = model, Words(model), ByteWords(PLAIN)
        self.open = Opened(lambda a: (EliasFano.load(a, "key"), EliasFano.load(a, "pointer"), a["p"], int(a["first"][0]), EliasFano.load(a, "next"), a["next_p"], a["rest"]))

    def level(self, file: int) -> tuple:
        return self.open[self.model.pairs[file]]

    def pairs(self, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of distinct pairs of known words (rows of words) in ascending order of keys: discounted probability, number of children of the context, file, rank in it (-1: unknown) and, as a context itself, the share that goes to level 2."""
        m, words = self.model, self.words
        key = words.id[c] * m.distinct + words.id[w]
        total = max(1, m.total)
        file = file_of(words.before[c], words.n[c], words.before[w], total, m.files)
        low, high = (file_of(words.before[c], words.n[c], np.full(len(c), x), total, m.files) for x in (0, total))
        p, children, rank, rest = np.zeros(len(c)), np.zeros(len(c), np.int64), np.full(len(c), -1), np.ones(len(c))
        # Keys ascend, and so do their files.
        cuts = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(file)], strict=True):
            f = int(file[lo])
            if f not in m.pairs:
                continue
            k = np.arange(lo, hi)
            keys, pointers, stored_p, first, _, _, stored_rest = self.level(f)
            ctx = words.id[c[k]] - first
            inside = (ctx >= 0) & (ctx < pointers.n - 1)
            k, ctx = k[inside], ctx[inside]
            if not len(k):
                continue
            new = np.concatenate(([True], ctx[1:] != ctx[:-1]))
            one, back = ctx[new], np.cumsum(new) - 1
            start, end = pointers.access(one)[back], pointers.access(one + 1)[back]
            children[k] = end - start
            some = (end > start) & (key[k] >= keys.base)
            k, start, end = k[some], start[some], end[some]
            i, found = keys.successor((key[k] - keys.base).astype(np.uint64), start, end)
            k, i = k[found], i[found]
            p[k], rank[k], rest[k] = POWERS[stored_p[i]], i, POWERS[stored_rest[i]]
        over = np.flatnonzero(low != high)
        ctx, back = np.unique(words.id[c[over]], return_inverse=True)
        children[over] = np.array([m.split.get(x, 0) for x in ctx.tolist()], np.int64)[back]
        return p, children, file, rank, rest

    def triples(self, file: np.ndarray, rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Discounted probability of words (ids) after known pairs, in ascending order of pair and word."""
        p = np.zeros(len(file))
        cuts = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(file)], strict=True):
            nexts, stored_p = self.level(int(file[lo]))[4:6]
            key = rank[lo:hi] * self.model.distinct + ids[lo:hi]
            k = np.flatnonzero(key >= nexts.base) if nexts.n else np.empty(0, np.int64)
            i, found = nexts.successor((key[k] - nexts.base).astype(np.uint64))
            p[lo + k[found]] = POWERS[stored_p[i[found]]]
        return p

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        m, words = self.model, self.words
        h, start, stop = framed(*self.read(texts))
        rows, context, word = words.rows(h), np.ones(len(h), bool), np.ones(len(h), bool)
        context[stop - 1] = word[start] = False
        c, w = rows[context], rows[word]
        lengths = stop - start - 1
        n = words.n[w]
        unigram = (n + 1) / (m.total + m.distinct + 1)
        prob = unigram.copy()
        k = np.flatnonzero(words.n[c] > 0)
        if len(k):
            # Unknown words share the place after all ids: only the context's children count for them.
            key = words.id[c[k]] * (m.distinct + 1) + np.where(n[k] > 0, words.id[w[k]], m.distinct)
            order = ascending(key)
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            one, back = k[order[new]], np.empty(len(k), np.int64)
            back[order] = np.cumsum(new) - 1
            p, children, file, rank, rest = self.pairs(c[one], w[one])
            unknown = n[one] == 0
            p[unknown], rank[unknown] = 0.0, -1
            prob[k] = p[back] + DISCOUNT * children[back] / words.n[c[k]] * unigram[k]
        ends = np.cumsum(lengths)
        triple = prob.copy()
        if len(k):
            # The pair before each word, as its place among the distinct ones.
            pair = np.full(len(c) + 1, -1)
            pair[k + 1] = np.where(rank >= 0, np.arange(len(rank)), -1)[back]
            pair[ends] = -1
            pair = pair[:-1]
            k = np.flatnonzero(pair >= 0)
            triple[k] = rest[pair[k]] * prob[k]
            k = k[n[k] > 0]
        if len(k):
            key = pair[k] * m.distinct + words.id[w[k]]
            order = ascending(key)
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            one, back = k[order[new]], np.empty(len(k), np.int64)
            back[order] = np.cumsum(new) - 1
            triple[k] += self.triples(file[pair[one]], rank[pair[one]], words.id[w[one]])[back]
        add = lambda x: np.add.reduceat(x, ends - lengths)  # noqa: E731  no document is without tokens
        return {
            "n_tokens": lengths, "n_known": add((n > 0).astype(np.int64)), "base_score": add(np.log10(unigram)), "bigram_score": add(np.log10(prob)), "score": add(np.log10(triple)),
        }


def learn(docs: DataFrame, folder: str, text: str = "text") -> Model:
    """Learns from all rows of docs; the files are in folder."""
    tune_batches(docs.sparkSession)
    docs = docs.select(F.col(text).cast("string").alias("text"))
    words = stored(count_words(docs), f"{folder}/counts")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if distinct * (distinct + 1) >= 2**63:
        raise ValueError(f"{distinct} distinct words: a pair of their numbers does not fit in 63 bits")
    model = Model(*write_words(words, folder, distinct), total, distinct)
    if total:
        model.add_pairs(write_pairs(count_triples(docs, model), model, folder))
    return model


RESULTS = "n_tokens long, n_known long, train_tokens long, base_score double, bigram_score double, score double"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, bigram_score and score."""
    tune_batches(docs.sparkSession)
    docs, schema = extended(docs, RESULTS)
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        scorer = Scorer(held.value)
        for b in batches(frames):
            r = scorer(b.column(at))
            train = pa.array(np.full(b.num_rows, scorer.model.total), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(r["n_tokens"]), pa.array(r["n_known"]), train, pa.array(r["base_score"]), pa.array(r["bigram_score"]), pa.array(r["score"])],
                [*b.schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "bigram_score", "score"],
            )

    return docs.mapInArrow(run, schema)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = hash_bucket("doc_id", 7) == 2
    # A null doc_id has no remainder and is learned from.
    model = learn(docs.where(~F.coalesce(held_out, F.lit(False))), scratch(spark, "language-model"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "bigram_score", "score")
