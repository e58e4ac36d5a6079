"""Vectors as whole numbers: scaling, exact inner products of any size, and the order of scores that no long holds."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Key of a score that a long holds: above those of scores below all longs, below those of scores above.
INSIDE = b"\x01"


def to_integers(lists: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for one that is null or holds a null or non-finite component.

    int64 where no inner product of such vectors can pass 2**62, else an array of Python's integers, which have no bounds.
    """
    out = []
    for v in lists:
        x = None if not v.is_valid else v.values
        if x is None or x.null_count:
            out.append(None)
            continue
        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(x).all():
            out.append(None)
        elif np.abs(x).max(initial=0) * scale < math.sqrt(2.0**62 / max(1, len(x))):
            out.append(np.floor(scale * x).astype(np.int64))
        else:
            out.append(np.array([math.floor(scale * c) if abs(c) < 2.0**52 else int(c) * scale for c in x.tolist()], object))
    return out


def to_bytes(x: np.ndarray) -> bytes:
    return json.dumps(x.tolist()).encode() if x.dtype == object else x.astype("<i8").tobytes()


def from_bytes(raw: bytes, rows: int, dim: int, wide: bool) -> np.ndarray:
    if wide:
        out = np.empty((rows, dim), object)
        out[:] = json.loads(raw)
        return out
    return np.frombuffer(raw, "<i8").reshape(rows, dim)


def fit(x: np.ndarray, dim: int) -> np.ndarray:
    """Rows widened to dim by zeros: a vector of fewer components counts as zero in the others."""
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows with all; an array of Python's integers if either side is one."""
    dim = max(q.shape[1], x.shape[1])
    q, x = fit(q, dim), fit(x, dim)
    if object in (q.dtype, x.dtype):
        return q.astype(object) @ x.T.astype(object) if dim else np.zeros((len(q), len(x)), object)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(dim, 1) < 2**53:  # exact in floating point
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def clamped(scores: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores as longs, those beyond at the nearest long, and the key that orders equal longs by their exact scores; None stands for INSIDE."""
    if scores.dtype != object:
        return scores, [None] * len(scores)
    return np.array([min(max(s, LEAST), MOST) for s in scores], np.int64), [to_key(s) for s in scores]


def to_key(score: int) -> bytes | None:
    """Bytes in the order of the scores: a sign, the length of the magnitude and the magnitude, turned round below zero."""
    if LEAST <= score <= MOST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + raw if score > 0 else b"\x00" + bytes(255 - b for b in raw)


def from_key(score: int, key: bytes | None) -> int:
    """The exact score."""
    if key is None or key == INSIDE:
        return score
    raw = key[1:] if key[0] else bytes(255 - b for b in key[1:])
    return int.from_bytes(raw[4:], "big") * (1 if key[0] else -1)


def finite(column: str) -> str:
    """SQL: a vector, none of whose components is null or non-finite."""
    return f"`{column}` is not null and forall(`{column}`, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
