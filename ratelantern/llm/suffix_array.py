"""Suffix arrays by induced sorting, and permuted common prefixes, for whole numpy arrays.

A suffix is S if it is smaller than the next one and L if larger; an S suffix after an L one is leftmost-smaller
(LMS). LMS substrings are sorted by inducing from their first symbols, named in that order, and the row of
their names is sorted by recursion. From the sorted LMS suffixes, one scan of the buckets upwards induces all L
suffixes and one downwards all S suffixes. A bucket's members are induced together: they are read in
order, their predecessors dealt to the ends of the buckets by a stable sort on the symbol. Members that
induce into their own bucket form runs of one symbol and are taken round by round.

Where nearly each name has a bucket of its own, the recursion ends and ranks are doubled instead.
"""

import numpy as np

#: Recursion pays off with this many suffixes to a bucket.
LEAST_PER_BUCKET = 48


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. ``text`` ends with 0, which stands nowhere else."""
    symbols = int(text.max()) + 1
    if len(text) < 2:
        return np.arange(len(text))
    text = text.astype(np.uint16 if symbols < 1 << 16 else np.int64)
    smaller = _smaller(text)
    lms = np.nonzero(smaller[1:] & ~smaller[:-1])[0] + 1
    buckets = _Buckets(text, smaller, symbols)
    by_substring = buckets.induced(lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    by_substring = by_substring[is_lms[by_substring]]
    names, count = _names(text, lms, by_substring)
    if count == len(lms):
        order = by_substring
    elif count * LEAST_PER_BUCKET <= len(lms):
        order = lms[suffix_array(names)]
    else:
        order = lms[_doubled(names)]
    return buckets.induced(order)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is."""
    n = len(text)
    differs = np.ones(n, dtype=bool)
    differs[:-1] = text[:-1] != text[1:]
    # The type of a run is that of its last symbol.
    last = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    rises = np.ones(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    return rises[last]


class _Buckets:
    """Suffixes by first symbol: first the L ones, then the S ones."""

    def __init__(self, text: np.ndarray, smaller: np.ndarray, symbols: int):
        self.text = text
        counts = np.bincount(text, minlength=symbols)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.split = self.start + np.bincount(text[~smaller], minlength=symbols)
        self.present = np.nonzero(counts)[0].tolist()

    def induced(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, in the order that follows from that of the LMS ones."""
        text = self.text
        order = np.full(len(text), -1, dtype=np.int64)
        head = self.start.copy()
        starts, splits, ends = self.start.tolist(), self.split.tolist(), self.end.tolist()
        of_symbol = np.searchsorted(text[lms], np.arange(len(starts) + 1)).tolist()
        for c in self.present:
            found = []
            low, high = starts[c], int(head[c])
            while low < high:
                before = order[low:high] - 1
                if before[0] < 0 or before.min() < 0:
                    before = before[before >= 0]
                symbol = text[before]
                same = before[symbol == c]
                larger = symbol > c
                found.append((before[larger], symbol[larger]))
                order[high : high + len(same)] = same
                low, high = high, high + len(same)
            a, b = of_symbol[c], of_symbol[c + 1]
            if b > a:
                before = lms[a:b] - 1
                found.append((before, text[before]))
            self._deal(order, head, found, 1)
        tail = self.end.copy()
        order[0], tail[0] = len(text) - 1, 0  # the last suffix follows from none
        for c in reversed(self.present):
            found = []
            low, high = int(tail[c]), ends[c]
            while low < high:
                before = order[low:high][::-1] - 1
                if before.min() < 0:
                    before = before[before >= 0]
                symbol = text[before]
                same = before[symbol == c]
                smaller = symbol < c
                found.append((before[smaller], symbol[smaller]))
                order[low - len(same) : low] = same[::-1]
                low, high = low - len(same), low
            a, b = starts[c], splits[c]
            if b > a:
                before = order[a:b][::-1] - 1
                if before.min() < 0:
                    before = before[before >= 0]
                symbol = text[before]
                smaller = symbol < c
                found.append((before[smaller], symbol[smaller]))
            self._deal(order, tail, found, -1)
        return order

    @staticmethod
    def _deal(order: np.ndarray, ends: np.ndarray, found: list, step: int) -> None:
        """Put suffixes, in this order, to the ends of the buckets of their symbols."""
        if not found:
            return
        at = found[0][0] if len(found) == 1 else np.concatenate([f[0] for f in found])
        if not len(at):
            return
        symbol = found[0][1] if len(found) == 1 else np.concatenate([f[1] for f in found])
        if len(at) > 1:
            by = np.argsort(symbol, kind="stable")
            at, symbol = at[by], symbol[by]
        first = np.concatenate(([0], np.nonzero(symbol[1:] != symbol[:-1])[0] + 1))
        held = np.diff(first, append=len(at))
        which = symbol[first]
        rank = np.arange(len(at)) - np.repeat(first, held)
        if step > 0:
            order[np.repeat(ends[which], held) + rank] = at
            ends[which] += held
        else:
            order[np.repeat(ends[which], held) - 1 - rank] = at
            ends[which] -= held


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in the order of the text, equal ones alike, and how many there are."""
    number = np.zeros(len(text), dtype=np.int64)
    number[lms] = np.arange(len(lms))
    which = number[ordered]
    length = np.diff(lms, append=len(text))[which]  # up to the next one, which belongs to it too
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = length[1:] != length[:-1]
    open_ = np.nonzero(~new)[0]
    a, b, left = ordered[open_ - 1], ordered[open_], length[open_]
    j = 0
    while len(open_):
        differs = text[a + j] != text[b + j]
        new[open_[differs]] = True
        j += 1
        go = ~differs & (left >= j)
        open_, a, b, left = open_[go], a[go], b[go], left[go]
    name = np.cumsum(new) - 1
    names = np.empty(len(lms), dtype=np.int64)
    names[which] = name
    return names, int(name[-1]) + 1


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffixes in order, by ranks over 1, 2, 4 ... names; only those with equals so far are sorted again."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    slots, key = np.arange(n), names[order]
    rank = np.zeros(n, dtype=np.int64)
    while True:
        # A rank is the first slot of all that are equal so far.
        new = np.ones(len(slots), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.nonzero(new)[0]
        held = np.diff(first, append=len(slots))
        rank[order[slots]] = np.repeat(slots[first], held)
        slots = slots[np.repeat(held > 1, held)]
        if not len(slots):
            return order
        mine = order[slots]
        after = mine + reach
        key = rank[mine] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, order[slots] = key[by], mine[by]
        reach *= 2


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, by its start: how long a prefix it shares with the one before it in order.

    Where the symbols before both are equal, the value is one less than that of the start before.
    Only the others are compared, four symbols at a time.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    compared = np.ones(n, dtype=bool)
    inner = np.arange(1, n)
    compared[1:] = (before[1:] <= 0) | (text[inner - 1] != text[before[1:] - 1])
    compared[order[0]] = False
    padded = np.zeros(n + 4, dtype=np.uint16)
    padded[:n] = text
    words = np.ndarray((n + 1,), dtype="<u8", buffer=padded.data, strides=(2,))
    common = np.zeros(n, dtype=np.int64)
    at = np.nonzero(compared)[0]
    mine, other = at, before[at]
    while len(at):
        differ = words[mine] ^ words[other]
        equal = differ == 0
        ended = differ[~equal]
        low = np.where(ended & 0xFFFF, 0, np.where(ended & 0xFFFFFFFF, 1, np.where(ended & 0xFFFFFFFFFFFF, 2, 3)))
        common[at[~equal]] += low
        at, mine, other = at[equal], mine[equal] + 4, other[equal] + 4
        common[at] += 4
    compared[order[0]] = True  # shares nothing
    start = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    return np.maximum(common[start] - (np.arange(n) - start), 0)


def occurring_again(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, whether each of its substrings of ``length`` bytes starts at another place in any of them."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    text = np.ones(int(sizes.sum()) + len(strings) + 1, dtype=np.uint16)  # 1 ends a string, 0 the whole
    text[-1] = 0
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    joined = np.frombuffer(b"\x00".join(strings) + b"\x00", dtype=np.uint8)
    text[:-1] = joined
    text[:-1] += 2
    text[ends - 1] = 1
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order)[order] >= length
    again = np.zeros(len(text), dtype=bool)
    again[order] = shared
    again[order[:-1]] |= shared[1:]
    return [again[a : a + max(n - length + 1, 0)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
