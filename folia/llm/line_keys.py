"""Keys under which near lines meet: segments with length-aware substring probes, and rare pairs of words.

All keys of a chunk of lines come from one prefix sum of a polynomial over its characters, so a substring's hash is a
difference of two entries: no Python work per key. Keys only find candidates; a collision costs a comparison.
"""

from __future__ import annotations

import numpy as np

from folia.llm.sketch import places

#: Edits up to which lines link, and the characters that a line needs to take part; shorter lines always stay.
EDITS, LEAST_CHARS = 2, 40
#: With edits=None: the characters that a line needs for each edit, and so those below which only equal lines are one.
SHORT = 20
#: One in so many words may differ where the bound grows with the line.
SHARE = 10
#: Lines of fewer words are cut into segments of characters; from here on pairs of words find what EDITS edits leave alike.
WORDY = 24
#: The place of a pair of words that its line repeats, and of one beyond all that are told apart.
ANYWHERE = 0xFFFF

_SCRIPTS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_U = np.uint64


def _kinds() -> np.ndarray:
    """By code point: 0 a letter of a word, 1 a blank, 2 a letter of a script written without blanks, which is a word."""
    out = np.zeros(0x110000, dtype=np.uint8)
    out[[32, *range(9, 14)]] = 1
    for low, high in _SCRIPTS:
        out[low : high + 1] = 2
    return out


KINDS = _kinds()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.r_[_U(1), np.full(size - 1, b, dtype=_U)], dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Chunk:
    """Lines laid end to end as code points, their words, and hashes of any substrings."""

    def __init__(self, lines: list[str]):
        data = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.n = np.array([len(x) for x in lines], dtype=np.int64)
        self.at = np.cumsum(self.n + 1) - self.n - 1
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.r_[_U(0), np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], dtype=_U)]
        kind = KINDS.take(data, mode="clip")
        own, blank = kind == 2, kind == 1
        first = ~blank
        first[1:] &= own[1:] | (kind[:-1] != 0)
        edges = np.flatnonzero(first | blank)
        stops = np.r_[edges[1:], len(data)] if len(edges) else edges
        word = first[edges]
        self.codes, self.start, self.stop = data, edges[word], stops[word]
        self.word_at = np.searchsorted(self.start, self.at)  # the first word of each line
        self.m = np.diff(np.r_[self.word_at, len(self.start)])
        self.words = mixed(self.hashes(self.start, self.stop))

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def bound(n, edits: int | None = EDITS):
    """The edits up to which a line of n characters and one that is no shorter link."""
    return np.minimum(EDITS, n // SHORT) if edits is None else np.full_like(n, edits)


def _segment(n: np.ndarray, edits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of segment k of edits + 1 of a line of n symbols; the later segments are longer by one where n doesn't divide."""
    size, more = n // (edits + 1), n % (edits + 1)
    return k * size + np.maximum(0, k - (edits + 1 - more)), size + (k >= edits + 1 - more)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, info) of parts (key, line, info)."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key, line, info = zip(*parts)
    info = [np.broadcast_to(np.asarray(i, dtype=np.int64), k.shape) for i, k in zip(info, key)]
    return np.concatenate(key).view(np.int64), np.concatenate(line), np.concatenate(info)


def segment_keys(which: np.ndarray, n: np.ndarray, most, shortest: int, piece, salt: int, most_edits: int = EDITS) -> list[tuple]:
    """(key, line, 0) of the segments under which lines `which` of n symbols are indexed, (key, line, 1) of the substrings that they probe.

    most(n) is the bound of edits between a line of n symbols and a longer one, piece(lines, start, length) hashes substrings.
    A line within the bound of a shorter or equal one, of at least shortest symbols, has one of its segments unchanged: segment k with at
    most k edits to its left and the rest to its right, which bounds the place from both sides.
    """
    out = []
    for less in range(most_edits + 1):
        shorter = n - less
        bounds = most(shorter)
        for edits in np.unique(bounds[(bounds >= less) & (shorter >= shortest)]).tolist():
            at = np.flatnonzero((bounds == edits) & (shorter >= shortest))
            for k in range(edits + 1):
                s, w = _segment(shorter[at], edits, k)
                seed = mixed(shorter[at].astype(_U) * _FACTORS[0] + _FACTORS[1:2] * _U(salt << 32 | edits << 16 | k))
                low = np.maximum(np.maximum(s - k, s + less - (edits - k)), 0)
                high = np.minimum(np.minimum(s + k, s + less + (edits - k)), n[at] - w)
                if not less:
                    out.append((mixed(piece(which[at], s, w) ^ seed), which[at], 0))
                for shift in range(int((high - low).max(initial=-1)) + 1):
                    ok = np.flatnonzero(low + shift <= high)
                    out.append((mixed(piece(which[at[ok]], low[ok] + shift, w[ok]) ^ seed[ok]), which[at[ok]], 1))
    return out


def slack(m):
    """The words that may differ between linked lines, the longer one of m words, and by which places in them may differ."""
    return np.maximum(m // SHARE, 4)


def pair_hashes(chunk: Chunk, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its first word) of all pairs of neighbouring words of lines `which`."""
    if len(chunk.words) < 2:
        return chunk.words[:0], np.zeros(0, dtype=np.int64)
    taking = np.zeros(len(chunk.m), dtype=bool)
    taking[which] = True
    own = np.repeat(taking, chunk.m)
    last = (chunk.word_at + chunk.m - 1)[chunk.m > 0]
    own[last] = False
    at = np.flatnonzero(own)
    return mixed(chunk.words[at] * _FACTORS[0] + chunk.words[at + 1] * _FACTORS[1]), at


def rare_keys(chunk: Chunk, which: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """(key, line, (words << 16 | place) + 2) of the rarest pairs of words of lines `which`, as many as the edits can break and one more."""
    found, at = pair_hashes(chunk, which)
    if not len(found):
        return []
    line = np.repeat(np.arange(len(chunk.m), dtype=np.uint32), chunk.m)[at]
    known = np.minimum(counts[places(found)], (1 << 24) - 1).astype(_U)
    order = np.argsort((known << _U(40)) | (found >> _U(24)))
    order = order[np.argsort(line[order].astype(np.uint16) if len(chunk.m) < 1 << 16 else line[order], kind="stable")]
    found, line, at = found[order], line[order].astype(np.int64), at[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (line[1:] != line[:-1])]
    alone = new & np.r_[new[1:], True]
    place = np.where(alone, np.minimum(at - chunk.word_at[line], ANYWHERE), ANYWHERE)[new]
    found, line = found[new], line[new]
    start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    rank = np.arange(len(line)) - np.repeat(start, np.diff(np.r_[start, len(line)]))
    first = rank < 2 * slack(-(-SHARE * chunk.m[line] // (SHARE - 1))) + 1
    line = line[first]
    return [(mixed(found[first] + _U(1)), line, (chunk.m[line] << 16 | place[first]) + 2)]


def worded(chunk: Chunk) -> np.ndarray:
    """The lines that meet by pairs of words: 2 * SHARE words can link with 2 * (SHARE - 1)."""
    return np.flatnonzero((chunk.n >= LEAST_CHARS) & (chunk.m >= 2 * (SHARE - 1)))


def keys(lines: list[str], edits: int | None = EDITS, counts: np.ndarray | None = None, chunk: Chunk | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the line, info) of lines: info 0 for index keys, 1 for probes, from 2 on for pairs of words."""
    chunk = chunk or Chunk(lines)
    n, m = chunk.n, chunk.m

    def of_chars(line, start, length):
        return chunk.hashes(chunk.at[line] + start, chunk.at[line] + start + length)

    if edits is not None:
        return _joined(segment_keys(np.arange(len(n)), n, lambda x: bound(x, edits), 0, of_chars, 0, edits))
    folded = np.r_[_U(0), np.cumsum(chunk.words * _powers(len(chunk.words))[0][: len(chunk.words)], dtype=_U)]

    def of_words(line, start, length):
        first = chunk.word_at[line] + start
        return (folded[first + length] - folded[first]) * chunk.inverse[first]

    few = np.flatnonzero((n >= SHORT) & (m < WORDY))
    some = np.flatnonzero((n >= LEAST_CHARS) & (m >= SHARE - 1) & (m < 2 * SHARE))
    out = segment_keys(few, n[few], lambda x: bound(x, None), SHORT, of_chars, 1)
    out += [x for x in segment_keys(some, m[some], lambda x: np.where(x < 2 * SHARE, 1, 0), SHARE - 1, of_words, 2)]
    return _joined(out + rare_keys(chunk, worded(chunk), counts))
