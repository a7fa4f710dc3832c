"""The segmentation lattice of words over a fixed piece vocabulary.

All substrings of bounded length of many words are equi-joined to the piece table at once, on
hashes computed for whole arrays. A row of the lattice (an edge) is a word, a start, an end and a
piece; rows are grouped by the position at which they end, so that a fold over positions
serves all words together.
"""

from dataclasses import dataclass

import numpy as np
import sentencepiece

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = "▁"


@dataclass
class Edges:
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lengths: np.ndarray


class PieceTable:
    """Pieces of a SentencePiece model; row ``unknown`` stands for a character that is no piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.ids = np.array(ids, dtype=np.int32)
        self.scores = {p: model.get_score(i) for p, i in zip(self.pieces, ids, strict=True)}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin_bytes = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.unknown = len(self.pieces)
        self.longest = max(map(len, self.pieces))
        self._powers = _powers(self.longest)
        points, _, ends = _code_points(self.pieces)
        prefix = _prefix_hashes(points)
        starts = np.concatenate(([0], ends[:-1]))
        lengths = ends - starts
        hashes = _mixed(prefix[ends] - prefix[starts] * self._powers[lengths], lengths)
        self._slots = 1 << 19
        self._hash = np.zeros(self._slots, dtype=np.uint64)
        self._row = np.full(self._slots, -1, dtype=np.int32)
        for row, h in enumerate(hashes):
            at = int(h) & (self._slots - 1)
            while self._row[at] >= 0:
                if self._hash[at] == h:
                    raise ValueError("two pieces have one hash")
                at = (at + 1) & (self._slots - 1)
            self._hash[at], self._row[at] = h, row
        self._points = points
        self._starts = starts

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the pieces with these hashes, -1 for none."""
        at = (hashes & np.uint64(self._slots - 1)).astype(np.int64)
        found = self._row[at]
        open_ = np.nonzero((found >= 0) & (self._hash[at] != hashes))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & (self._slots - 1)
            found[open_] = self._row[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self._hash[at[open_]] != hashes[open_])]
        return found

    def edges(self, words: list[str]) -> Edges:
        """The lattice of ``words``, ordered by end, then word, then longest edge first."""
        points, owner, ends = _code_points(words)
        prefix = _prefix_hashes(points)
        here = np.arange(len(points))
        left = ends[owner] - here  # characters up to the end of the word
        first = np.concatenate(([0], ends[:-1])) if len(ends) else np.zeros(0, dtype=np.int64)
        found = []
        for length in range(1, min(self.longest, int(left.max(initial=0))) + 1):
            begin = here[left >= length]
            hashes = _mixed(prefix[begin + length] - prefix[begin] * self._powers[length], np.uint64(length))
            piece = self._find(hashes)
            if length == 1:
                piece = np.where(piece < 0, self.unknown, piece)
            hit = np.nonzero(piece >= 0)[0]
            hit = hit[self._same(points, begin[hit], piece[hit], length)]
            found.append((begin[hit], piece[hit], np.full(len(hit), length)))
        if not found:
            empty = np.zeros(0, dtype=np.int64)
            return Edges(empty, empty, empty, empty, np.diff(ends, prepend=0))
        begin, piece, length = (np.concatenate(x) for x in zip(*found, strict=True))
        word = owner[begin]
        start = begin - first[word]
        order = np.lexsort((-length, word, start + length))
        return Edges(word[order], start[order], (start + length)[order], piece[order], np.diff(ends, prepend=0))

    def _same(self, points: np.ndarray, begin: np.ndarray, piece: np.ndarray, length: int) -> np.ndarray:
        """Whether the characters are the piece's, not only their hash."""
        known = piece < self.unknown
        same = np.ones(len(begin), dtype=bool)
        at = np.where(known, self._starts[np.minimum(piece, self.unknown - 1)], 0)
        for i in range(length):
            same &= ~known | (points[begin + i] == self._points[at + i])
        return same


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in a row, the word of each, and where each word ends."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return points, np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths)


def _powers(most: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 to base ** most, modulo 2 ** 64."""
    table = np.full(most + 1, base, dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def _prefix_hashes(points: np.ndarray) -> np.ndarray:
    """prefix[j] - prefix[i] * BASE ** (j - i) is the hash of characters i to j (modulo 2 ** 64)."""
    # prefix[j] = sum of c[i] * BASE ** (j - 1 - i); by way of the inverse of BASE.
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    down, up = _powers(len(points), inverse), _powers(len(points))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.add.accumulate((points + np.uint64(1)) * down[1:])))
    return sums * up


def _mixed(hashes: np.ndarray, lengths) -> np.ndarray:
    h = hashes + np.asarray(lengths).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))
