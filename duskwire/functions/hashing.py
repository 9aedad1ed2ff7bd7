"""Content hashes and deterministic ids."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def name_uuid(name: Column) -> Column:
    """UUID version 5 of ``name`` in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def evidence_id(hash_col: Column, source_id: Column) -> Column:
    """Same content from the same source always gives the same id."""
    return name_uuid(F.concat(hash_col, F.lit(":"), source_id))


#: Longer values are hashed alone, so that a batch is never padded to the widest of them.
LONG = 1 << 16
#: Padded bytes that are hashed side by side.
TOGETHER = 1 << 24
_M32 = 0xFFFFFFFF


def _mix(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    k = (k << np.uint32(15)) | (k >> np.uint32(17))
    return k * np.uint32(0x1B873593)


def _body(data: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """State after all bytes of values of like length, four bytes of all of them at a time."""
    width = max(4, int(-(-lengths.max() // 4) * 4))
    words = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in data), dtype="<u4").reshape(len(data), -1)
    h = np.zeros(len(data), dtype=np.uint32)
    full = lengths // 4
    for i in range(int(full.max())):
        mixed = h ^ _mix(words[:, i])
        mixed = (mixed << np.uint32(13)) | (mixed >> np.uint32(19))
        h = np.where(i < full, mixed * np.uint32(5) + np.uint32(0xE6546B64), h)
    tail = words[np.arange(len(data)), np.minimum(full, words.shape[1] - 1)]
    return np.where(lengths % 4 > 0, h ^ _mix(tail), h)


def _long_body(value: bytes) -> int:
    """The same for one long value, piece by piece."""
    h = 0
    whole = len(value) // 4 * 4
    for at in range(0, whole, LONG):
        for k in _mix(np.frombuffer(value, "<u4", min(LONG, whole - at) // 4, at)).tolist():
            h ^= k
            h = ((h << 13) | (h >> 19)) & _M32
            h = (h * 5 + 0xE6546B64) & _M32
    if len(value) > whole:
        h ^= int(_mix(np.frombuffer(value[whole:].ljust(4, b"\0"), "<u4"))[0])
    return h


def _groups(lengths: np.ndarray):
    """Indexes of the values up to ``LONG`` bytes in groups of like length and bounded padded size."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= LONG]
    lo = 0
    for hi in range(1, len(order) + 1):
        if hi == len(order) or lengths[order[hi]] * (hi + 1 - lo) > TOGETHER:
            yield order[lo:hi]
            lo = hi


def murmur3_32(values: pd.Series) -> pd.Series:
    """Signed MurmurHash3 (32 bit, seed 0) of byte strings; null stays null."""
    data = [b"" if v is None else bytes(v) for v in values]
    lengths = np.array([len(b) for b in data], dtype=np.int64)
    h = np.zeros(len(data), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for rows in _groups(lengths):
            h[rows] = _body([data[i] for i in rows], lengths[rows])
        for i in np.flatnonzero(lengths > LONG):
            h[i] = _long_body(data[i])
        h = h ^ lengths.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = h ^ (h >> np.uint32(16))
    out = pd.Series(h.view(np.int32), dtype="Int32")
    return out.mask(values.isna().to_numpy())


@F.pandas_udf(IntegerType())
def favicon_hash32(values: pd.Series) -> pd.Series:
    """Favicon fingerprint."""
    return murmur3_32(values)
