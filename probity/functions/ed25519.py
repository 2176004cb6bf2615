"""Ed25519 signatures (RFC 8032) for manifests and log heads: few, small messages; verification as a pandas UDF.

Plain integer arithmetic, not hardened against timing: keys that matter belong in a key store, and records are
verified where they enter. A verification takes some milliseconds, by a key that many rows share less.
"""

from __future__ import annotations

import functools
import hashlib
import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the curve: field, group order, constant, square root of -1, base point.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
_Y = 4 * pow(5, -1, P) % P

Point = tuple[int, int, int, int]
_ZERO: Point = (0, 1, 1, 0)


def _x_of(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (not x and odd):
        return None
    return P - x if x & 1 != odd else x


_X = _x_of(_Y, 0)
_BASE: Point = (_X, _Y, 1, _X * _Y % P)


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    out = _ZERO
    for bit in bin(n)[2:]:
        out = _add(out, out)
        if bit == "1":
            out = _add(out, p)
    return out


@functools.lru_cache(maxsize=64)
def _table(p: Point) -> list[list[Point]]:
    """d * 16^i times a point for each of the 64 digits d of a number: what is signed or checked by one key shares it."""
    rows = []
    for _ in range(64):
        row = [_ZERO]
        for _ in range(15):
            row.append(_add(row[-1], p))
        rows.append(row)
        p = _add(row[-1], p)
    return rows


def _by_table(n: int, p: Point) -> Point:
    """``_times`` of a point that is often used and a number of at most 256 bits: an addition for each digit."""
    out = _ZERO
    for row in _table(p):
        if n & 15:
            out = _add(out, row[n & 15])
        n >>= 4
    return out


def _same(p: Point, q: Point) -> bool:
    return (p[0] * q[2] - q[0] * p[2]) % P == 0 and (p[1] * q[2] - q[1] * p[2]) % P == 0


def _pack(p: Point) -> bytes:
    inverse = pow(p[2], -1, P)
    x, y = p[0] * inverse % P, p[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> Point | None:
    y = int.from_bytes(data, "little")
    y, odd = y & (1 << 255) - 1, y >> 255
    x = _x_of(y, odd) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _secret(key: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(key).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def new_key() -> bytes:
    return os.urandom(32)


@functools.lru_cache(maxsize=64)
def public_key(key: bytes) -> bytes:
    return _pack(_by_table(_secret(key)[0], _BASE))


def sign(key: bytes, message: bytes) -> bytes:
    a, prefix = _secret(key)
    public = public_key(key)
    r = _number(prefix, message)
    commitment = _pack(_by_table(r, _BASE))
    return commitment + ((r + _number(commitment, public, message) * a) % ORDER).to_bytes(32, "little")


@functools.lru_cache(maxsize=64)
def _known(public: bytes) -> Point | None:
    return _unpack(public)


#: Rows of a batch by one key from which on its table is worth its thousand additions.
_OFTEN = 8


def verify(public: bytes, message: bytes, signature: bytes, often: bool = False) -> bool:
    """Whether the signature is the key's over the message; false for anything malformed. ``often`` keeps a table of the key's point."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _known(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    return _same(_by_table(s, _BASE), _add(r, (_by_table if often else _times)(_number(signature[:32], public, message), a)))


def verify_hex(public: str | None, message: str | None, signature: str | None, often: bool = False) -> bool:
    """``verify`` of hexadecimal texts; false for null or what isn't hexadecimal."""
    try:
        return verify(*(bytes.fromhex(x) for x in (public, message, signature)), often)
    except (TypeError, ValueError):
        return False


@F.pandas_udf(T.BooleanType())
def signature_ok(public: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    often = public.map(public.value_counts()) >= _OFTEN
    return pd.Series([verify_hex(*x) for x in zip(public, message, signature, often.tolist(), strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def signed(key: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([sign(bytes.fromhex(k), bytes.fromhex(m)).hex() for k, m in zip(key, message, strict=True)], dtype=object)
