"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their components.

1. Each document becomes a set of 64-bit shingle hashes; equal sets become one
   node (their hash), so copies, however many, cost one.
2. Hash space is cut into buckets, about CROWD shingles of a set to each; what a
   set has in one bucket is one element. Linked sets of n shingles differ in at
   most d = floor(15 floor(100 n / 85) / 100) shingles (for 85 %), hence in at
   most d elements, and so share one of their first d + 1 in any one order. The
   order is by size: large elements are rare ones. Sets with too few elements
   share a further one. The number of buckets goes by classes of size; a set
   near the end of its class stands in the next one as well.
3. Nodes with a common element are tied to the least of them: in each task
   first, so that a very common element leaves a task once, then by Spark.
4. Components of these ties hold every link within them. The sets of a
   component are dealt to blocks, and every two blocks meet in a group, so every
   pair meets; a component of no more than a task's share of all shingles has one
   block. A larger one has as many as it has shares, though no more than make a
   few groups for each task, or as many as keep groups below GROUP shingles. So
   one plan serves every size, and no task has more than its share while
   components are below GROUP * sqrt(2 * tasks) shingles.
5. In a group, a T-occurrence search (DivideSkip) over inverted lists counts
   overlaps exactly: short lists are merged by a heap, long ones probed by
   bisection. The lists are of leaders, sets not linked with an earlier leader.
   1 - Jaccard is a metric: a set that is further than twice the radius from a
   leader has no link with what is linked to that leader; the other sets of its
   ball are compared one by one unless they are in one component already.

Defined results: null and word-less texts have no shingles and are linked with
nothing; fewer words than ``n`` make one shingle of all words; repeated rows are
copies; a null doc_id has itself as component. Input columns named like results
are replaced. Two different sets are taken for one only if their 64-bit hashes
collide (about one pair in 10**19).
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLAIN, ByteWords, batches, drop_scratch, mixed, scratch, stored, table, tune_batches
from .components import components

N, PERCENT = 4, 85
CLASS = 1.5  # sizes of a class lie within this ratio
CROWD, SMALL = 4.2, 64  # shingles to a bucket for the largest sets of a class; below SMALL shingles one to a bucket
FLUSH = 2_000_000  # elements that a task ties at a time
GROUP = 1_000_000  # shingles of a group of sets that are compared in one task
SHARE = 2_000  # shingles; components of no more are never dealt to blocks
TRIED = 4  # leaders, of the largest balls, that a set is tried with while there is one component
HEAP = 500  # ids that are merged by a heap
PROBE = 0.5  # weight of a probe against the merge of an id, in DivideSkip's choice of long lists
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(h: np.ndarray, words: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text; h: its words' hashes, ``words`` of each text, one text after the other."""

    def of(k: int, h: np.ndarray) -> np.ndarray:
        """Shingles of k words from each place on."""
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * _ODD[i % 8] ** np.uint64(1 + i // 8)
        return mixed(out).view(np.int64)

    every, out, at = of(n, h) if len(h) >= n else None, [], 0
    for m in words.tolist():
        s = np.sort(every[at : at + m - n + 1]) if m >= n else of(m, h[at : at + m]) if m else np.empty(0, np.int64)
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        at += m
    return out


def node_of(s: np.ndarray) -> int:
    """The hash that stands for a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def most_different(n: int, percent: int) -> int:
    """The largest symmetric difference with which a set of n can be linked."""
    return (100 - percent) * (100 * n // percent) // 100


def class_of(n: int) -> int:
    k = max(0, int(math.log(n) / math.log(CLASS)) - 1)
    while math.ceil(CLASS ** (k + 1)) <= n:
        k += 1
    return k


def elements(s: np.ndarray, percent: int) -> np.ndarray:
    """The element hashes by which a set meets all sets it may be linked with."""
    n, out = len(s), []
    d = most_different(n, percent)
    h = s.view(np.uint64)
    order = np.argsort(h)  # the set is in order of signed numbers
    h = h[order]
    own = mixed(h)
    for level in range(class_of(n), class_of(100 * n // percent) + 1):
        top = math.ceil(CLASS ** (level + 1))
        buckets = top if top <= SMALL else math.ceil(top / CROWD)
        at = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        size = np.diff(np.append(starts, n))
        made = mixed(np.add.reduceat(own, starts) + at[starts] * _ODD[0] + np.uint64(level * int(_ODD[1]) % 2**64))
        out.append(made[np.argsort(-size, kind="stable")[: d + 1]])
        if len(made) <= d:
            out.append(mixed(np.array([level], np.uint64)))
    return np.concatenate(out).view(np.int64)


def describe(docs: DataFrame, text: str, n: int) -> DataFrame:
    """doc_id, n_shingles, node (null without shingles)."""

    def run(frames):
        read = ByteWords(PLAIN)
        for b in batches(frames):
            sets = shingle_sets(*read(b.column(1)), n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "node"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, node long")


def tied(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements with their least node, and the pairs of other nodes with it."""
    order = np.argsort(tokens)
    t, v = tokens[order], nodes[order]
    new = np.concatenate(([True], t[1:] != t[:-1]))
    first = np.minimum.reduceat(v, np.flatnonzero(new))
    least = first[np.cumsum(new) - 1]
    pairs = np.unique(np.stack((v[v != least], least[v != least]), 1), axis=0)
    return t[new], first, pairs[:, 0], pairs[:, 1]


def element_rows(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """(key, node, kind): kind 0 an element and the least node of a task that has it, kind 1 a node and one it is tied to."""

    def run(frames):
        read, done = ByteWords(PLAIN), set()
        tokens, nodes, many = [], [], 0

        def flush():
            if not tokens:
                return
            t, v, a, b = tied(np.concatenate(tokens), np.concatenate(nodes))
            key, node = np.concatenate((t, a)), np.concatenate((v, b))
            kind = np.repeat(np.array([0, 1], np.int32), (len(t), len(a)))
            for i in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (key, node, kind)], ["key", "node", "kind"])

        for b in batches(frames):
            for s in shingle_sets(*read(b.column(0)), n):
                if not len(s) or (node := node_of(s)) in done:
                    continue
                if len(done) >= 200_000:
                    done.clear()
                done.add(node)
                e = elements(s, percent)
                tokens.append(e)
                nodes.append(np.full(len(e), node, np.int64))
                many += len(e)
            if many >= FLUSH:
                yield from flush()
                tokens, nodes, many = [], [], 0
        yield from flush()

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "key long, node long, kind int")


def ties(rows: DataFrame) -> DataFrame:
    """(u, v): each node with the least one that shares an element with it."""
    least = F.min("node").over(Window.partitionBy("key", "kind"))
    tie = F.when(F.col("kind") == 0, F.struct(F.col("node").alias("u"), least.alias("v"))).otherwise(F.struct(F.col("key").alias("u"), F.col("node").alias("v")))
    return rows.select(tie.alias("tie")).select("tie.*").where("u <> v").distinct()


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def t_occurrence(lists: list[array], least: int, most: int) -> dict[int, int]:
    """DivideSkip: what stands in at least ``least`` of the ascending lists, with how many; most: ids there are.

    The longest lists are probed by bisection for what the shorter ones, merged,
    hold often enough. Up to HEAP ids are merged by a heap; more are merged by
    counting, which gives the same in a tenth of the time.
    """
    if len(lists) < least:
        return {}
    lists.sort(key=len, reverse=True)
    long = min(least - 1, int(least / (PROBE * math.log2(most + 1) + 1)))
    short, enough = lists[long:], least - long
    if sum(map(len, short)) > HEAP:
        n = np.bincount(np.concatenate([np.frombuffer(x, np.int32) for x in short]))
        ids = np.flatnonzero(n >= enough)
        n = n[ids]
        for k, x in enumerate(lists[:long]):
            # As many as there are lists left may be missing.
            some = n >= least - (long - k)
            ids, n = ids[some], n[some]
            p = np.frombuffer(x, np.int32)
            n += p[np.minimum(np.searchsorted(p, ids), len(p) - 1)] == ids
        return dict(zip(ids[n >= least].tolist(), n[n >= least].tolist(), strict=True))
    out = {}
    for x, run in groupby(heapq.merge(*short)):
        n = sum(1 for _ in run)
        if n < enough:
            continue
        for k, probe in enumerate(lists[:long]):
            if n < least - (long - k):
                break
            i = bisect_left(probe, x)
            n += i < len(probe) and probe[i] == x
        if n >= least:
            out[x] = n
    return out


def join_group(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the index of the first one of its component, by links among these sets."""
    parent, groups = list(range(len(sets))), 0  # groups: components so far

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def union(i: int, j: int) -> None:
        nonlocal groups
        i, j = sorted((find(i), find(j)))
        if i != j:
            parent[j] = i
            groups -= 1

    near = max(0, 2 * percent - 100)
    leaders: list[int] = []
    ball: list[list[int]] = []
    largest: list[int] = []  # places of the TRIED leaders with the largest balls
    index: dict[int, array] = {}
    for x, s in enumerate(sets):
        # With one component nothing is left to connect but x: any leader it is linked with will do.
        own = next((k for k in largest if together(s, sets[leaders[k]], percent)), None) if groups == 1 else None
        groups += 1
        found = []
        if own is not None:
            union(x, leaders[own])
        else:
            lists = [index[t] for t in s.tolist() if t in index]
            for k, both in t_occurrence(lists, max(1, -(-near * len(s) // 100)), len(leaders)).items():
                size = len(sets[leaders[k]])
                if linked(len(s), size, both, percent):
                    own = k if own is None else own
                    union(x, leaders[k])
                elif linked(len(s), size, both, near):
                    found.append(k)
        for k in found:
            # All of a ball is in its leader's component.
            if find(x) != find(leaders[k]) and any(together(s, sets[y], percent) for y in ball[k]):
                union(x, leaders[k])
        if own is None:
            own = len(leaders)
            for t in s.tolist():
                index.setdefault(t, array("i")).append(own)
            leaders.append(x)
            ball.append([])
        else:
            ball[own].append(x)
        if own not in largest:
            largest = sorted([*largest, own], key=lambda k: -len(ball[k]))[:TRIED]
    return [find(i) for i in range(len(sets))]


def together(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets are linked."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    return linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent)


def group_links(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """rows: g, i, j, node, text, all rows of a group following each other -> (u, v)."""

    def run(frames):
        read = ByteWords(PLAIN)
        key, nodes, sets = None, [], []

        def close():
            first = join_group(sets, percent) if len(sets) > 1 else []
            return [(nodes[k], nodes[r]) for k, r in enumerate(first) if k != r]

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

        for b in batches(frames):
            out = []
            for *k, node, s in zip(*(b.column(c).to_pylist() for c in range(4)), shingle_sets(*read(b.column(4)), n), strict=True):
                if k != key:
                    out += close()
                    key, nodes, sets = k, [], []
                # Repeated ids may bring another text or the same one twice.
                if len(s) and node_of(s) == node and (not nodes or nodes[-1] != node):
                    nodes.append(node)
                    sets.append(s)
            yield batch(out)
        yield batch(close())

    return rows.mapInArrow(run, "u long, v long")


def blocks_of(size: Column, total: int, tasks: int, group: int) -> Column:
    """Blocks of a component of some shingles, of ``total`` in all; two would meet in one group like one."""
    share = max(SHARE, -(-total // tasks))
    some = F.least(F.ceil(size / share), F.lit(math.ceil(math.sqrt(8 * tasks))))
    many = F.greatest(some, F.ceil(size / (group / 2))).cast("int")
    return F.when((size <= share) | (many <= 2), 1).otherwise(many)


def jaccard_components(docs: DataFrame, folder: str, text: str = "text", n: int = N, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, node and component_id, one row for each row of docs."""
    spark = docs.sparkSession
    tune_batches(spark)
    each = stored(describe(docs, text, n), f"{folder}/each")
    # Stored, for a round reads its edges several times, and would sort all elements anew each time.
    tie = stored(ties(element_rows(docs, text, n, percent)), f"{folder}/ties")
    near = components(tie, f"{folder}/near")
    drop_scratch(f"{folder}/ties")
    reps = each.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    roots = near.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = near.unionByName(roots).join(reps, "node").where("rep IS NOT NULL")
    size = F.sum("n").cast("long")
    sizes = members.groupBy("root").agg(blocks_of(size, total, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), group).alias("blocks"))
    members = stored(members.join(sizes, "root"), f"{folder}/members")
    # Sorted at every size: how many members there are must not change the plan.
    met = docs.select("doc_id", F.col(text).cast("string").alias("text")).hint("merge").join(members.select(F.col("rep").alias("doc_id"), "node", "root", "blocks"), "doc_id")
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    met = met.withColumn("with", F.explode(others)).select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "text")
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    links = stored(group_links(met, n, percent), f"{folder}/links")
    linked = components(links, f"{folder}/linked")
    nodes = reps.join(linked, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = nodes.join(least, "root").select("node", "component_id")
    return each.join(named, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "jaccard"))
    return out.select("doc_id", "n_shingles", "component_id")
