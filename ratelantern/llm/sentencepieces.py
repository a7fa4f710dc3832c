"""SentencePiece encoding and decoding over the segmentation lattice.

Texts are cut into words (spaces become the mark U+2581, a word starts at the first of a run of
marks). The words of a batch form a lattice: their substrings of bounded length, equi-joined
to the piece table and grouped by word. A fold over positions keeps the best path. The
vocabulary used is of the merge kind, whose encoding no sum of scores describes: there a path is
valid exactly if each pair of neighbours is, and one path is. So the fold has
weight 0 for edges that may follow the path that ends where they start and minus infinity
for all others, which gives the library's own ids.

Words are local to a task and their ids are remembered there, so that texts and words are never shuffled.

* Characters that are no piece become byte pieces. A null text has null ids, an empty one none.
* Ids that are null and repeated rows are returned as they are. Other columns are not read.
"""

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.llm.bpe import MergeRule
from ratelantern.llm.common import remembered
from ratelantern.llm.lattice import BASE, SPACE, PieceTable

WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MAX_KNOWN = 300_000
#: Pairs of pieces whose verdict is remembered; a pair takes the slot of one met before.
PAIR_BITS = 20
PAIR_SLOTS = 1 << PAIR_BITS
#: Words above this length are folded one by one.
LONG = 128


class Encoder:
    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.rule = MergeRule({p: -s for p, s in self.table.scores.items()})
        self.bytes_of = {int(i): p.replace(SPACE, " ").encode() for i, p in zip(self.table.ids, self.table.pieces, strict=True)}
        self.bytes_of |= self.table.begin_bytes
        self.pair_keys = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, dtype=bool)
        self.forget()

    def forget(self) -> None:
        """Words known by the mark they start with and their rows: row ``r`` has the ids from ``bounds[r]`` to ``bounds[r + 1]``."""
        self.known: dict[str, dict[str, int]] = {"": {}, SPACE: {}}
        self.bounds = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.wrong: set[int] = set()

    def words(self, text: str) -> tuple[str, list[str]]:
        """The words of a text, and the mark that each is understood to start with."""
        if not text:
            return "", []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return "", WORD.findall(SPACE + text.replace(" ", SPACE))
        return SPACE, text.split(" ")

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each piece ``right`` may follow the piece ``left``; pairs met before are looked up."""
        keys = left * (self.table.unknown + 2) + right
        slots = (keys.astype(np.uint64) * BASE >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        fits = self.pair_fits[slots]
        new = np.nonzero(self.pair_keys[slots] != keys)[0]
        if len(new):
            pairs, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            pieces, unknown = self.table.pieces, self.table.unknown
            made = np.array([self.rule.follows(None if x == unknown else pieces[x], pieces[y]) for x, y in zip(left[new[first]].tolist(), right[new[first]].tolist(), strict=True)])
            fits[new] = made[back]
            self.pair_keys[slots[new[first]]], self.pair_fits[slots[new[first]]] = pairs, made
        return fits

    def fold(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words are folded together, position by position; the few long ones one by one."""
        found: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            owner, piece, ends = self.paths([words[i] for i in short])
            bounds = np.searchsorted(owner, np.arange(len(short) + 1)).tolist()
            ids = np.append(self.table.ids, -1)[piece].tolist()
            for i, a, b in zip(short, bounds[:-1], bounds[1:], strict=True):
                found[i] = ids[a:b]
            for w in set(owner[piece == self.table.unknown].tolist()):
                i, places = short[w], ends[bounds[w] : bounds[w + 1]].tolist()
                found[i] = [x for known, end in zip(found[i], places, strict=True) for x in ([known] if known >= 0 else self.byte_ids(words[i][end - 1]))]
        for i, word in enumerate(words):
            if len(word) > LONG:
                found[i] = self.fold_one(word)
        return found

    def byte_ids(self, letter: str) -> list[int]:
        return [self.table.byte_ids[b] for b in letter.encode()]

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, piece and end of all edges on the valid paths, in order."""
        unknown = self.table.unknown
        lattice = self.table.edges(words)
        base = np.cumsum(lattice.lengths + 1) - (lattice.lengths + 1)
        # Last piece of the path to each position (-1: no path) and where it starts; the start
        # of the word and an unknown character put no condition on what follows.
        last = np.full(int((lattice.lengths + 1).sum()), -1, dtype=np.int64)
        came = np.zeros(len(last), dtype=np.int64)
        last[base] = unknown
        source, target, piece = base[lattice.word] + lattice.start, base[lattice.word] + lattice.end, lattice.piece.astype(np.int64)
        cuts = np.searchsorted(lattice.end, np.arange(1, int(lattice.lengths.max(initial=0)) + 2)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = a + np.nonzero(last[source[a:b]] >= 0)[0]
            # The longest edge of each word first; words that may not take it try their next one.
            while len(rows):
                first = np.diff(target[rows], prepend=-1) != 0
                tried, rows = rows[first], rows[~first]
                fits = piece[tried] == unknown
                fits[~fits] = self.follows(last[source[tried[~fits]]], piece[tried[~fits]])
                tried = tried[fits]
                last[target[tried]], came[target[tried]] = piece[tried], source[tried]
                rows = rows[last[target[rows]] < 0]
        owner, at = np.nonzero(lattice.lengths > 0)[0], (base + lattice.lengths)[lattice.lengths > 0]
        steps = []
        while len(owner):
            steps.append((owner, at))
            at = came[at]
            inside = at > base[owner]
            owner, at = owner[inside], at[inside]
        owner, at = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (owner, at)
        order = np.argsort(at)
        owner, at = owner[order], at[order]
        return owner, last[at], at - base[owner]

    def fold_one(self, word: str) -> list[int]:
        """The same for one word of any length."""
        table = self.table
        lattice = table.edges([word])
        pieces, unknown = table.pieces, table.unknown
        last, came = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        last[0] = unknown
        for s, e, p in zip(lattice.start.tolist(), lattice.end.tolist(), lattice.piece.tolist(), strict=True):
            left = last[s]
            if last[e] >= 0 or left < 0:
                continue
            if p == unknown or self.rule.follows(None if left == unknown else pieces[left], pieces[p]):
                last[e], came[e] = p, s
        at, ids = len(word), []
        while at:
            p, s = last[at], came[at]
            if p == unknown:
                ids.extend(reversed(self.byte_ids(word[s:at])))
            else:
                ids.append(int(table.ids[p]))
            at = s
        return ids[::-1]

    def learn(self, mark: str, words: list[str]) -> None:
        """Fold words not met before and see whether their ids decode to them."""
        known = self.known[mark]
        for i in range(0, len(words), 20_000):
            part = [mark + w for w in words[i : i + 20_000]]
            found = self.fold(part)
            first = len(self.bounds) - 1
            known.update(zip(words[i : i + 20_000], range(first, first + len(part)), strict=True))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), dtype=np.int32)))
            letters = self.bytes_of.__getitem__
            for row, (word, ids) in enumerate(zip(part, found, strict=True), first):
                if b"".join(map(letters, ids)) != word.replace(SPACE, " ").encode():
                    self.wrong.add(row)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray | None], list[bool | None]]:
        """Ids of each text, and whether all its words decode to themselves."""
        if max(map(len, self.known.values())) > MAX_KNOWN:
            self.forget()
        by_text = [None if t is None else self.words(t) for t in texts]
        rows = {}
        for mark, known in self.known.items():
            own = [found[1] for found in by_text if found is not None and found[0] == mark]
            at = np.fromiter(map(known.get, chain.from_iterable(own), repeat(-1)), dtype=np.int64)
            if (at < 0).any():
                self.learn(mark, list(dict.fromkeys(w for w, r in zip(chain.from_iterable(own), at.tolist(), strict=True) if r < 0)))
                at = np.fromiter(map(known.__getitem__, chain.from_iterable(own)), dtype=np.int64, count=len(at))
            rows[mark] = at
        result: list[np.ndarray | None] = []
        same: list[bool | None] = []
        used = dict.fromkeys(rows, 0)
        for found in by_text:
            if found is None:
                result.append(None)
                same.append(None)
                continue
            mark, own = found
            at = rows[mark][used[mark] : used[mark] + len(own)]
            used[mark] += len(own)
            begin, counts = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
            ends = np.cumsum(counts)
            result.append(self.ids[np.repeat(begin - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)])
            same.append(not self.wrong or self.wrong.isdisjoint(at.tolist()))
        return result, same

    def decode(self, ids: list[int]) -> str:
        """The text; the first mark stands for no space."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return remembered((__name__, path), lambda: Encoder(path))


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    offsets[1:] = np.cumsum([len(x) if x is not None else 0 for x in ids])
    values = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, dtype=np.int32)])
    missing = pa.array([x is None for x in ids], pa.bool_()) if any(x is None for x in ids) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=missing)


def encode(docs: DataFrame, model: str, rows_at_once: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (decoding the ids gives the text again, seen word by word) and the columns to ``keep``."""
    kept = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    made = ["doc_id", "ids", "n_ids", "round_trip"]
    schema = ", ".join(["doc_id long, ids array<int>, n_ids long, round_trip boolean", *(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for whole in batches:
            for i in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(i, rows_at_once)
                texts = batch.column("text").to_pylist()
                ids, same = enc.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        _lists(ids),
                        pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                        pa.array(same, pa.bool_()),
                        *(batch.column(c) for c in keep),
                    ],
                    [*made, *keep],
                )

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
