"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is built from Spark's own functions. The places of the matches of a
pattern come from two of them: regexp_extract_all gives the matches, split the
text between them; their lengths, added up, are the offsets (in code points).

The patterns are the plain ones, written so that Java neither backtracks nor
recurses on long runs: repeats are possessive, and a look-behind keeps a scan
from starting anew inside a run in which the first try failed.

Kinds: email, ip, card (Luhn) and phone are always kept. iban (mod 97), ssn and
mac are added when their score, raised by context words nearby, reaches
``threshold``.

Defined results: a null text counts as empty; no spans give zero counts, an
empty span list and the digest of the empty string. Rows are never joined or
grouped, so repeated ids keep their rows; other columns are left alone, but for
one named pii, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The patterns of the base kinds and of the added ones.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
MAC = r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
# Words that raise the score of a span near which they stand.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|pay",
    "phone": "call|phone|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto|cuenta",
    "ssn": "ssn|social|security|tax",
    "mac": "mac|device|hardware|ethernet",
}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "mac")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "mac": 0.5}
NEAR, BONUS, THRESHOLD = 40, 0.3, 0.6
PIECE = 512  # code points of the pieces of a text from which context is cut; over NEAR

SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    at = lambda i: F.substring(F.reverse(digits), i, 1).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i)),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10."""
    bare = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97,
    )
    return rest == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


# A character that any match holds: texts without it are not scanned.
_NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.contains("."),
    "phone": lambda t: t.contains("+"),
    "ssn": lambda t: t.contains("-"),
    "mac": lambda t: t.contains(":"),
}


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _starts(text: Column, kind: str, found: Column) -> Column:
    """Where the matches of one kind start (code points, from 0).

    Running sums over groups of about sqrt(n) matches, then over the groups: an
    array that grows by one at a time is copied each time, so none gets long.
    """
    n = F.size(found)
    size = F.ceil(F.sqrt(n)).cast("int")
    gaps = F.slice(F.split(text, _PATTERN[kind], -1), 1, n)
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    within = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out"))
    over = lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    # An array of one binds a value that is used more than once.
    groups = lambda s: F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda i: F.aggregate(F.slice(s, i * size + 1, size), zero, within))
    moved = lambda gs: F.flatten(F.zip_with(gs, F.aggregate(gs, zero, over)["out"], lambda g, base: F.transform(g["out"], lambda x: x + base)))
    return F.get(F.transform(F.transform(F.array(steps), groups), moved), F.lit(0))


def _window(pieces: Column, at: Column, n: Column) -> Column:
    """n (at most NEAR) code points of the text from a place on."""
    i = (at / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit("")))
    return F.substring(both, at % PIECE + 1, n)


def _places(kind: str, text: Column, pieces: Column, found: Column) -> Column:
    """Confirmed spans of one kind, in order of place."""

    def span(x: Column) -> Column:
        start = x["start"]
        end = start + F.length(x["m"])
        lead = F.greatest(start - NEAR, F.lit(0))
        near = F.lower(F.concat(_window(pieces, lead, start - lead), x["m"], _window(pieces, end, F.lit(NEAR))))
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), BONUS).otherwise(0.0))
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), score.alias("score"))

    placed = F.zip_with(_starts(text, kind, found), found, lambda s, m: F.struct(s.alias("start"), m.alias("m")))
    spans = F.transform(F.filter(placed, lambda x: confirmed(kind, x["m"])), span)
    return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(spans.cast(SPAN))


_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "mac": MAC}


def find_pii(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``pii``: spans (start, kind's number, end, score), by start, then kind."""
    own = "_pii"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    none = F.array().cast("array<string>")
    t, match = F.col(f"{own}_text"), {k: F.col(f"{own}_{k}") for k in KINDS}
    out = docs.withColumn(f"{own}_text", F.coalesce(F.col(text), F.lit("")))
    some = {k: _matches(t, _PATTERN[k]) for k in KINDS}
    out = out.withColumns({f"{own}_{k}": F.when(_NEEDS[k](t), m).otherwise(none) if k in _NEEDS else m for k, m in some.items()})
    found = sum((F.size(m) for m in match.values()), F.lit(0))
    out = out.withColumn(f"{own}_pieces", F.when(found > 0, _matches(t, rf"(?s).{{1,{PIECE}}}")).otherwise(none))
    spans = F.concat(*(_places(k, t, F.col(f"{own}_pieces"), match[k]) for k in KINDS))
    out = out.withColumn("pii", F.array_sort(F.filter(spans, lambda s: (s["kind"] < len(BASE)) | (s["score"] >= threshold))))
    return out.drop(f"{own}_text", f"{own}_pieces", *(f"{own}_{k}" for k in KINDS))


def labelled(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(n(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(labelled(F.filter("pii", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        labelled(F.col("pii")).alias("spans"),
    )
