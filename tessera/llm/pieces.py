"""Vectorised split of texts into the pieces of public_tokenizers.PATTERN: one pass of numpy over code points, no regex per piece.

Character classes are read once from the regex module, so they are its \\s, \\p{L} and \\p{N}.
"""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, END = range(5)


@cache
def classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    whole, where = "".join(map(chr, points)), np.array(points)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, whole):
            out[where[m.start() : m.end()]] = kind
    return out


def split(texts: list[str]) -> tuple[str, list[int], list[int], np.ndarray]:
    """The joined texts, starts and ends of all pieces in it, and at [i] the number of pieces before text i (one more entry than texts)."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kind = classes()[cp]
    kind[ends] = END
    change = np.empty(len(cp), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[ends] = True
    change[np.minimum(ends[:-1] + 1, len(cp) - 1)] = True
    start = np.flatnonzero(change)
    stop = np.append(start[1:], len(cp))
    rk = kind[start]
    after = np.append(rk[1:], END)
    # white space before a word: a last blank goes to the word, any other last character stands alone
    gap = (rk == SPACE) & (after != END)
    last = cp[np.maximum(stop - 1, 0)]
    give = gap & (last == 32)
    alone = gap & (last != 32) & (stop - start > 1)
    taken = np.append(False, give[:-1])
    start = start - taken
    stop = stop - give
    # contractions: a lone apostrophe that no blank precedes, and its letters
    i = np.flatnonzero((rk == OTHER) & (stop - start == 1) & ~taken & (cp[np.minimum(start, len(cp) - 1)] == 39) & (after == LETTER))
    if len(i):
        a, left = cp[start[i] + 1], stop[i + 1] - start[i + 1]
        b = np.where(left > 1, cp[np.minimum(start[i] + 2, len(cp) - 1)], 0)
        n = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
        n[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))] = 2
        stop[i] += n
        start[i + 1] += n
    k = np.flatnonzero(alone)
    if len(k):
        more_start, more_stop = stop[k] - 1, stop[k].copy()
        stop[k] -= 1
        start, stop, rk = np.concatenate([start, more_start]), np.concatenate([stop, more_stop]), np.concatenate([rk, rk[k]])
        order = np.argsort(start, kind="stable")
        start, stop, rk = start[order], stop[order], rk[order]
    keep = (stop > start) & (rk != END)
    start, stop = start[keep], stop[keep]
    return joined, start.tolist(), stop.tolist(), np.append(0, np.searchsorted(start, ends))


class Packed(dict):
    """piece -> its ids as little-endian 32-bit bytes. It holds at most `most` pieces; others are encoded each time."""

    def __init__(self, encode, most: int = 300_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.encode(piece)).tobytes()
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = out
        return out

    def texts(self, texts: list[str]):
        """The packed ids of each text."""
        joined, start, stop, at = split(texts)
        got = list(map(self.__getitem__, [joined[a:b] for a, b in zip(start, stop)]))
        for i in range(len(texts)):
            yield b"".join(got[at[i] : at[i + 1]])
