"""Secrets: keywords first, patterns only where a keyword stands, then embedded checksums.

An Aho-Corasick automaton finds all keywords of a text in one pass. At each
place a keyword starts, the pattern of its kind is matched, anchored there;
since every match of the pattern starts with one of its keywords, the
matches taken from left to right are the leftmost non-overlapping ones. Runs
of hex digits have no keyword and are found as runs.

Base kinds: assign (a value of 6 or more characters is given to a password,
token or the like), access (AKIA... of 20 or more) and hex (24 or more). Added
kinds, kept only where they prove themselves: github and npm (last six
characters are the base-62 crc32 of the rest), jwt (header and payload decode to
JSON objects) and key (a PEM block with a matching end line).

Defined results: a null text counts as empty and has no spans; repeated rows
keep theirs; other columns are left alone, those named like results are
replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, extended, table, tune_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "key")

# The keywords and patterns of each kind.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "key": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "key": re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----"),
}
#: Where a pattern fails at a keyword, it fails at all further ones of the same run.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*+")}
HEX = re.compile(r"[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {c: c + 32 for c in range(65, 91)}

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(width, "0")


def _object(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        body, check = m[0][4:-6], m[0][-6:]
        return base62(zlib.crc32(body.encode()), 6) == check
    if kind == "jwt":
        return all(map(_object, m[0].split(".")[:2]))
    return True


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """A-Z lower-cased, every code point in its place."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def scan(text: str | None, a: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    if not text:
        return []
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    starts: dict[str, list[int]] = {}
    for last, (kind, n) in a.iter(lowered(text)):
        starts.setdefault(kind, []).append(last - n + 1)
    for kind, places in starts.items():
        end, pattern, rank = 0, PATTERNS[kind], KINDS.index(kind)
        for p in sorted(set(places)):
            if p < end:
                continue
            if m := pattern.match(text, p):
                end = m.end()
                if valid(kind, m):
                    found.append((p, rank, end))
            elif kind in RUNS:
                end = RUNS[kind].match(text, p).end()
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def find_secrets(docs: DataFrame, text: str = "text", redact: str | None = None) -> DataFrame:
    """docs with ``secrets``: spans by start, then kind; with redact, the text has that in place of each stretch of spans."""
    tune_batches(docs.sparkSession)
    docs, schema = extended(docs, f"secrets {SPANS}")
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(frames):
        a = automaton()
        for b in batches(frames):
            texts = b.column(at).to_pylist()
            spans = [scan(t, a) for t in texts]
            columns = list(b.columns)
            if redact is not None:
                columns[at] = pa.array([redacted(t, s, redact) for t, s in zip(texts, spans, strict=True)], pa.string())
            made = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kind)
            yield pa.RecordBatch.from_arrays([*columns, made], [*b.schema.names, "secrets"])

    return docs.mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[str, int, int]], put: str) -> str | None:
    """text with put in place of each stretch that spans cover; a null stays null."""
    if not spans:
        return text
    out, end = [], 0
    for _, s, e in spans:
        if s >= end:
            out += [text[end:s], put]
        end = max(end, e)
    return "".join([*out, text[end:]])


def labelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(n(k).alias(f"n_{k}") for k in BASE),
        F.sha2(labelled(F.filter("secrets", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        labelled(F.col("secrets")).alias("spans"),
    )
