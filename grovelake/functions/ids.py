"""Content hashes and base-62 ids (xxh64 with seed 0; Spark's own xxhash64 has another seed)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: digits of the ids, in order.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ID_CHARS = 11


def base62(n: int) -> str:
    """``n`` in base 62, padded with zeros to eleven digits."""
    out = []
    for _ in range(ID_CHARS):
        n, r = divmod(n, 62)
        out.append(ALPHABET[r])
    return "".join(reversed(out))


def xxh64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def positional_id(source: str, parent: str, index: int) -> str:
    """Id of the ``index``-th child of ``parent`` in ``source``; it survives edits of the content."""
    return base62(xxh64("\0".join([source, parent, str(index)]).encode()))


def payload_id(namespace: str, payload: str) -> str:
    """Id of a content that a tool wrote."""
    return base62(xxh64("\0".join([namespace, payload]).encode()))


def _hex(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else f"{xxh64(x.encode()):016x}")


def content_hash(column) -> Column:
    """Sixteen hexadecimal digits of xxh64; null of null."""
    return F.pandas_udf(_hex, "string")(column)


def _payload(ns: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else payload_id(a, b) for a, b in zip(ns, payload)])


def payload_ids(namespace, payload) -> Column:
    return F.pandas_udf(_payload, "string")(namespace, payload)
