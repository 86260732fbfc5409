"""Vectorised word splitting and hashing over Arrow string buffers.

A word is a maximal run of letters, marks, digits and underscores of Unicode; punctuation, symbols, white
space and control characters of any script separate words. Texts are handled as UTF-8 bytes in blocks,
so that no Python object is made per word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlstone.session import lean, trim  # noqa: F401

#: Whether a code point separates words; those that Unicode has not assigned do not.
SEPARATES = np.array([(k := unicodedata.category(chr(c)))[0] in "PZSC" and k != "Cn" and c != ord("_") for c in range(sys.maxunicode + 1)])
_EDGES = np.flatnonzero(np.diff(np.concatenate([[True], SEPARATES, [True]]))).reshape(-1, 2)
WORD = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in _EDGES.tolist()) + "]+")
BLOCK_BYTES = 1 << 20

_G = np.uint64(0x9E3779B97F4A7C15 | 5)
_TABLE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
IS_WORD = np.zeros(256, bool)
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_":
    IS_WORD[_c] = True
IS_WORD[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        g = np.full(size, _G, np.uint64)
        g[0] = 1
        inv = pow(int(_G), -1, 2**64)
        i = np.full(size, inv, np.uint64)
        i[0] = 1
        _POW, _INV = np.multiply.accumulate(g), np.multiply.accumulate(i)
    return _POW[:n], _INV[:n]


def as_strings(column: pa.Array, lower: bool) -> pa.Array:
    """Nulls become empty, every text gets a closing newline; optionally lower-cased."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    return pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))


def blocks(column: pa.Array, lower: bool, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, start offset of each row and the end) for runs of whole texts."""
    if not len(column):
        return
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        part = as_strings(column.slice(lo, hi - lo), lower)  # copies of one block at a time
        off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + hi - lo + 1]
        yield lo, hi, np.frombuffer(part.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]
        lo = hi


def _clear_separators(buf: np.ndarray, flag: np.ndarray) -> None:
    """Set ``flag`` to 0 at the bytes of the non-ASCII characters that separate words."""
    lead = np.flatnonzero(buf >= 0xC0)
    if not len(lead):
        return
    first = buf[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | (buf[lead[more] + k] & 0x3F)
    gone = SEPARATES[code]
    lead, size = lead[gone], size[gone]
    for k in range(4):
        flag[lead[size > k] + k] = 0


def split(buf: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    flag = np.zeros(len(buf) + 5, np.int8)
    flag[1 : len(buf) + 1] = table[buf]
    if table is IS_WORD:
        _clear_separators(buf, flag[1:])
    flag = flag[: len(buf) + 2]
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    return edge[0::2], edge[1::2]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes hash equally wherever they stand."""
    p, inv = _powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_TABLE[buf] * p[:-1], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def rows_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row, how many word starts stand before it, and the total: word offsets by row."""
    return np.searchsorted(starts, offsets)


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive hashes, in order (length len(h) - k + 1)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    g = np.uint64(0xD6E8FEB86659FD93)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = out * g + h[j : j + n]
    return mix(out)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the words of one text; as many as ``split`` finds in its bytes, also lower-cased."""
    return [m.span() for m in WORD.finditer(text)]
