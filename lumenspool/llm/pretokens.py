"""Vectorised splitting of text by the byte-level tokenizers' PATTERN, and encoding through distinct pieces.

The pattern's matches are runs of letters, numbers, other marks or blanks, with one leading space
joined to a run that it precedes and with English contractions apart. Runs and their starts are
computed on code point classes for a whole slice of rows at once. Each distinct piece is encoded
once; a row's ids are gathered from the pieces' ids.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np

from lumenspool.llm import words as W

LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
#: The code points of Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
#: Distinct pieces that a worker keeps encoded; beyond it the store starts anew (same results).
STORE_PIECES = 500_000


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITE_SPACE] = BLANK
        _classes = table
    return _classes


def pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) in bytes: the pattern's matches of all rows; row i has first[i] .. first[i + 1]."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cps)
    edge = np.zeros(n + 4, bool)
    edge[np.searchsorted(lead, offsets[offsets < len(data)])] = True
    edge[n:] = True
    kind = classes()[cps]
    start = np.empty(n + 4, bool)
    start[0] = True
    start[1:n] = kind[1:] != kind[:-1]
    start[n:] = True
    start |= edge
    # A run of non-blanks after blanks: the last blank starts a piece; a space then takes the run along.
    run = np.flatnonzero(start[1:n] & ~edge[1:n] & (kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1
    start[run - 1] = True
    start[run[cps[run - 1] == 0x20]] = False
    # Contractions: an apostrophe that starts a piece.
    quote = np.flatnonzero((cps == 0x27) & start[:n])
    if len(quote):
        ahead = np.concatenate([cps, np.zeros(3, np.uint32)])
        a, b = ahead[quote + 1], ahead[quote + 2]
        one = ~edge[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~edge[quote + 1] & ~edge[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[quote[one] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 1] = False
        start[quote[two] + 3] = True
    starts = lead[np.flatnonzero(start[:n])]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)


class PieceStore:
    """Ids of pieces by hash, kept per worker; ``encode`` turns a list of new pieces into lists of ids."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode, self.known = encode, {}

    def rows(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all rows, first): row i has ids first[i] .. first[i + 1]."""
        starts, ends, first = pieces(offsets, data)
        hashes, at, inverse = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(self.known) > STORE_PIECES:
            self.known = {}
        known = self.known
        new = [k for k, h in enumerate(keys) if h not in known]
        if new:
            raw = data.tobytes()
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            made = self.encode([raw[a:b] for a, b in spans])
            size = [4 * len(x) for x in made]
            packed, stop = np.fromiter(chain.from_iterable(made), np.uint32).tobytes(), 0
            for k, n in zip(new, size, strict=True):
                known[keys[k]] = packed[stop : stop + n]
                stop += n
        found = [known[h] for h in keys]
        flat = np.frombuffer(b"".join(found), np.uint32)
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(length) - length
        many = length[inverse]
        stop = np.cumsum(many)
        ids = flat[np.repeat(begin[inverse] - (stop - many), many) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return ids, np.concatenate([np.zeros(1, np.int64), stop])[first]
