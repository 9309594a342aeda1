"""Hashes of the tokens of texts, over whole Arrow columns and in bounded memory."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._common import text_parts

#: Spans are hashed in blocks of so many bytes; a longer span is several blocks of its own.
BLOCK = 1 << 19

U = np.uint64
_R = 0x9E3779B97F4A7C15
MIX = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX[0]
    h = (h ^ (h >> U(27))) * MIX[1]
    return h ^ (h >> U(31))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each ordered pair."""
    return finish(a * MIX[2] + b * MIX[3])


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_R, pow(_R, -1, 1 << 64)):
        power = np.full(BLOCK, base, U)
        power[0] = 1
        out.append(np.multiply.accumulate(power))
    return tuple(out)


def span_hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The hash of each span ``first[i] : stop[i]`` (in order, apart) of the folded bytes: a polynomial in
    the byte values, taken as the difference of two prefix sums and shifted to begin at power 0."""
    up, down = _powers()
    wide = fold.astype(U) + U(1)
    out, k = np.empty(len(first), U), 0
    while k < len(first):
        lo = int(first[k])
        end = int(np.searchsorted(stop, lo + BLOCK, "right"))
        if end <= k:
            total = 0
            for at in range(lo, int(stop[k]), BLOCK):
                part = data[at : min(at + BLOCK, int(stop[k]))]
                total += int((wide[part] * up[: len(part)]).sum(dtype=U)) * pow(_R, at - lo, 1 << 64)
            out[k] = U(total % (1 << 64))
            k += 1
            continue
        part = data[lo : int(stop[end - 1])]
        sums = np.zeros(len(part) + 1, U)
        powers = wide[part]
        powers *= up[: len(part)]
        np.cumsum(powers, out=sums[1:])
        a, b = first[k:end] - lo, stop[k:end] - lo
        out[k:end] = (sums[b] - sums[a]) * down[a]
        k = end
    return finish(out)


def token_spans(data: np.ndarray, kinds: np.ndarray, single: int | None = None, starts: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(first, stop)`` of every run of bytes of one kind (0: none); each byte of the kind ``single`` is a run of its own.
    No run goes on past ``starts``."""
    kind = np.zeros(len(data) + 1, np.uint8)
    kind[:-1] = kinds[data]
    edge = np.empty(len(kind), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    if single is not None:
        edge[1:] |= kind[1:] == single
    edge[starts] = True
    at = np.flatnonzero(edge)
    inside = np.flatnonzero(kind[at[:-1]] != 0)
    return at[inside], at[inside + 1]


def token_parts(column: pa.Array, kinds: np.ndarray, fold: np.ndarray, single: int | None = None, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, token hashes, bounds)`` of bounded parts of a string column: row ``first + i`` has the tokens ``bounds[i] : bounds[i + 1]``."""
    for lo, data, starts, lengths in text_parts(column, size):
        first, stop = token_spans(data, kinds, single, starts)
        yield lo, span_hashes(data, first, stop, fold), np.append(np.searchsorted(first, starts), len(first))
