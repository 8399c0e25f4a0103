"""Set intersection and difference of two parties' keys: semi and anti joins."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.keys import keyed_pair


class Protocol(IntEnum):
    """How a deployment would compute the set; the result is the same."""

    ECDH = 0
    KKRT = 1
    TEE = 2


def protocol(p: Protocol | int | str) -> Protocol:
    try:
        return Protocol[p.upper()] if isinstance(p, str) else Protocol(p)
    except (KeyError, ValueError):
        raise ValueError(f"no such protocol: {p}") from None


def _join(client: DataFrame, server: DataFrame, keys: list[str], server_keys: list[str] | None, how: str, p: Protocol, unique: bool) -> DataFrame:
    server_keys = server_keys or keys
    if len(keys) != len(server_keys):
        raise ValueError("both parties need as many key columns")
    p = protocol(p)
    masked = p is Protocol.TEE
    left, right, names, equal = keyed_pair(client, keys, server, server_keys, masked)
    if p is Protocol.KKRT and (client.isEmpty() or server.isEmpty()):
        raise ValueError("KKRT does not take an empty set")
    if unique:
        left = left.dropDuplicates(names)
    # A semi join needs no distinct right side, and only keys are shuffled.
    return left.join(right, equal, how).drop(*names)


def intersection(client: DataFrame, server: DataFrame, keys: list[str], server_keys: list[str] | None = None, protocol: Protocol | int | str = Protocol.ECDH, unique: bool = False) -> DataFrame:
    """Rows of client whose keys the server has; unique: one row for each key."""
    return _join(client, server, keys, server_keys, "left_semi", protocol, unique)


def difference(client: DataFrame, server: DataFrame, keys: list[str], server_keys: list[str] | None = None, protocol: Protocol | int | str = Protocol.ECDH, unique: bool = False) -> DataFrame:
    """Rows of client whose keys the server does not have."""
    return _join(client, server, keys, server_keys, "left_anti", protocol, unique)


def cardinality(client: DataFrame, server: DataFrame, keys: list[str], server_keys: list[str] | None = None, **options) -> DataFrame:
    """Only the number of client rows in the intersection."""
    return intersection(client, server, keys, server_keys, **options).agg(F.count("*").alias("cardinality"))


def two_party(values: dict[str, DataFrame], receiver: str, broadcast: bool = False, protocol: Protocol | int | str = Protocol.ECDH) -> dict[str, DataFrame]:
    """Intersection of two one-column frames by party; the receiver gets it, with broadcast both do."""
    if len(values) != 2 or receiver not in values:
        raise ValueError("two parties are needed, the receiver among them")
    other = next(p for p in values if p != receiver)
    mine, theirs = values[receiver], values[other]
    found = intersection(mine, theirs, mine.columns[:1], theirs.columns[:1], protocol)
    return {receiver: found} | ({other: found} if broadcast else {})


def align_samples(host: DataFrame, guest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both frames, each without the rows whose key the other lacks."""
    return intersection(host, guest, [key]), intersection(guest, host, [key])


def aligned_join(host: DataFrame, guest: DataFrame, key: str) -> DataFrame:
    """Vertical parties side by side on the shared key; as in align_samples, a missing key equals a missing one."""
    left, right, names, equal = keyed_pair(host, [key], guest, [key], keep=True)
    return left.join(right.drop(key), equal).drop(*names, "_right0")
