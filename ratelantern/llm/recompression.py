"""Removal of long repeated passages by recompression.

A text is a row of word symbols. A round names maximal runs of one symbol, then pairs of
neighbours whose left member falls into one half of the alphabet and whose right member into the other
(by a bit of their names). Names are hashes of what they stand for, so all tasks give equal
strings equal names without asking each other. Each symbol also carries its context: the words that
decide that it is there and what it is. Wherever these words stand, the symbol stands.

A window of ``window`` words is marked by one of the symbols whose context it covers: the one
whose context has the smallest hash. Equal windows have equal marks, so only windows
whose mark occurs twice or more anywhere can repeat; windows that cover no context stay candidates.
Candidates are compared by a 96-bit hash of their words, and of each distinct one the
first place (smallest id, then start) is found. All other candidates are repeats.

Spark rounds: (1) marks are dealt by hash and the repeated ones set bits of a filter of bounded
size; (2) candidate windows, thinned per task to the first of equal ones, are dealt by hash
and first places found; (3) these go back to their documents by id. A full filter only lets more
candidates through, results stay the same.

* Null and empty texts and texts shorter than a window lose nothing.
* Null ids sort before all others. Rows with one id count as one document: none is earlier than
  the other, and first places of any of them hold for all. Only ``doc_id`` and ``text`` are read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelantern.llm.common import pieces_for, remembered, text_bytes
from ratelantern.llm.rolling import BASE, OTHER_BASE, WordNames, mixed, prefix_hashes, span_hashes, words_of
from ratelantern.session import write_stage

#: Upper bound of the filter that is sent to all tasks.
FILTER_BYTES = 64 << 20
#: About so many words are handled at once.
WORDS_AT_ONCE = 500_000
NO_ID = -(2**63)


class Parsed:
    """Symbols of some documents after the rounds, with contexts as positions among all their words."""

    def __init__(self, names: np.ndarray, ends: np.ndarray, rounds: int):
        starts = np.concatenate(([0], ends[:-1]))
        doc = np.repeat(np.arange(len(ends)), ends - starts)
        at = np.arange(len(names))
        self._parse(names, at, at + 1, doc, starts, ends, rounds)

    def _parse(self, sym, left, right, doc, starts, ends, rounds) -> None:
        for _ in range(rounds):
            # Runs. What decides a run includes the symbols next to it; at the edge of a document nothing can decide it.
            new = np.ones(len(sym), dtype=bool)
            new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
            first = np.nonzero(new)[0]
            length = np.diff(first, append=len(sym))
            sym = np.where(length > 1, mixed(sym[first], length), sym[first])
            inner_left, inner_right = left[first], right[first + length - 1]
            doc = doc[first]
            same = doc[1:] == doc[:-1]
            left, right = starts[doc] - 1, ends[doc] + 1
            left[1:] = np.where(same, inner_left[:-1], left[1:])
            right[:-1] = np.where(same, inner_right[1:], right[:-1])
            # Pairs.
            half = (mixed(sym, 1) & np.uint64(1)).astype(bool)
            joined = np.zeros(len(sym), dtype=bool)  # with the next one
            joined[:-1] = ~half[:-1] & half[1:] & same
            taken = np.zeros(len(sym), dtype=bool)  # by the one before
            taken[1:] = joined[:-1]
            after = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
            before = np.maximum(np.arange(len(sym)) - 1, 0)
            same_after = np.append(same, False)
            same_before = np.insert(same, 0, False)
            # A left symbol looks at its successor, a right one at its predecessor.
            right = np.where(~half, np.where(same_after, right[after], ends[doc] + 1), right)
            left = np.where(half & ~taken, np.where(same_before, left[before], starts[doc] - 1), left)
            sym = np.where(joined, mixed(sym * BASE + sym[after], 2), sym)
            keep = ~taken
            sym, left, right, doc = sym[keep], left[keep], right[keep], doc[keep]
        inside = (left >= starts[doc]) & (right <= ends[doc])
        self.left, self.right = left[inside], right[inside]


class Windows:
    """All windows of some documents: where they start and the hash of the symbol that marks them (0: none)."""

    def __init__(self, texts: list[str | None], window: int, rounds: int):
        self.words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in self.words], dtype=np.int64)
        ends = np.cumsum(counts)
        self.first_word = ends - counts
        names = remembered(__name__, WordNames).of([w for words in self.words for w in words])
        self.names = names
        prefix = prefix_hashes(names)
        per_doc = np.maximum(counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), per_doc)
        self.start = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        at = self.first_word[self.doc] + self.start
        self.at, self.window, self.prefix = at, window, prefix
        self.mark = np.zeros(len(at), dtype=np.uint64)
        self.contexts = np.zeros(0, dtype=np.uint64)
        if not len(at):
            return
        parsed = Parsed(names, ends, rounds)
        short = parsed.right - parsed.left <= window
        left, right = parsed.left[short], parsed.right[short]
        self.contexts = hashes = span_hashes(prefix, left, right) | np.uint64(1)
        # Contexts covered by a window are neighbours: from the first that starts in it to the last that ends in it.
        n = len(names) + 1
        low = np.concatenate(([0], np.cumsum(np.bincount(left, minlength=n))))[at]
        high = np.cumsum(np.bincount(right, minlength=n))[at + window]
        covered = high - low
        least = hashes
        step = 1
        while step <= covered.max(initial=0):
            rows = np.nonzero((covered >= step) & (covered < 2 * step))[0]
            self.mark[rows] = np.minimum(least[low[rows]], least[high[rows] - step])
            least = np.minimum(least[: max(len(least) - step, 0)], least[step:]) if len(least) > step else least[:0]
            step *= 2

    def hashes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for the words of these windows."""
        at = self.at[rows]
        other = prefix_hashes(self.names, OTHER_BASE)
        return (
            span_hashes(self.prefix, at, at + self.window),
            (span_hashes(other, at, at + self.window, OTHER_BASE) >> np.uint64(32)).astype(np.uint32),
        )


def _portions(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about ``WORDS_AT_ONCE`` words."""
    for batch in batches:
        lengths = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)], dtype=np.int64)
        part = np.cumsum(lengths) // (6 * WORDS_AT_ONCE)
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


class Filter:
    """Bits set for repeated marks; each part of the marks owns a segment."""

    def __init__(self, parts: int, bits_per_part: int):
        self.parts, self.bits = parts, bits_per_part

    def part(self, marks: np.ndarray) -> np.ndarray:
        return ((marks >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int64)

    def bit(self, marks: np.ndarray) -> np.ndarray:
        return (mixed(marks, 7) % np.uint64(self.bits)).astype(np.int64)

    def passes(self, segments: np.ndarray, marks: np.ndarray) -> np.ndarray:
        at = self.part(marks) * self.bits + self.bit(marks)
        return (segments[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _candidates(windows: Windows, filter_: Filter, segments: np.ndarray) -> np.ndarray:
    return np.nonzero((windows.mark == 0) | filter_.passes(segments, windows.mark))[0]


def without_repeats(docs: DataFrame, window: int = 20, rounds: int = 2, part_bytes: int = 32 << 20, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space; null stays null) of each row.

    ``keep_columns``: all columns of ``docs`` and n_words, n_removed, kept_text, which replace columns of these names.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_removed", "kept_text")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    base = docs.select(id_, "text")
    whole = docs.select(id_, *(c for c in docs.columns if c not in ("doc_id", "starts", *added))) if keep_columns else base
    size = text_bytes(base)
    parts = pieces_for(size, part_bytes)
    # About 16 bits for each mark of a text without repeats, within the bound.
    bits = max(64, min(size * 16 // 40, FILTER_BYTES * 8) // parts // 8 * 8)
    filter_ = Filter(parts, bits)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            windows = Windows(batch.column("text").to_pylist(), window, rounds)
            chosen = np.unique(windows.mark[windows.mark > 0])
            symbols = np.sort(windows.contexts)
            often = symbols[1:][symbols[1:] == symbols[:-1]]
            again = np.isin(chosen, often, assume_unique=False)
            part = filter_.part(chosen)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, chosen[order[a:b]].tobytes(), again[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                ["part", "marks", "again"],
            )

    def repeated(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = np.frombuffer(b"".join(rows["marks"]), dtype=np.uint64)
        again = np.frombuffer(b"".join(rows["again"]), dtype=bool)
        order = np.argsort(found, kind="stable")
        found, again = found[order], again[order]
        equal = found[1:] == found[:-1]
        hits = np.concatenate((found[1:][equal], found[again]))
        segment = np.zeros(bits, dtype=np.uint8)
        segment[filter_.bit(hits)] = 1
        return pd.DataFrame({"part": [int(key[0])], "segment": [np.packbits(segment, bitorder="little").tobytes()]})

    dealt = base.mapInArrow(marks, "part int, marks binary, again binary").repartition(parts, "part")
    segments = np.zeros((parts, bits // 8), dtype=np.uint8)
    # One bit segment per part, FILTER_BYTES at most in all; collect() runs the parts together, an iterator one after the other.
    for row in dealt.groupBy("part").applyInPandas(repeated, "part int, segment binary").collect():
        segments[row["part"]] = np.frombuffer(row["segment"], dtype=np.uint8)
    sent = spark.sparkContext.broadcast(segments.reshape(-1))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            windows = Windows(batch.column("text").to_pylist(), window, rounds)
            rows = _candidates(windows, filter_, sent.value)
            ids = batch.column("doc_id").to_numpy()[windows.doc[rows]]
            start = windows.start[rows].astype(np.int32)
            hash_, tag = windows.hashes(rows)
            order = np.lexsort((start, ids, tag, hash_))
            hash_, tag, ids, start = hash_[order], tag[order], ids[order], start[order]
            first = np.ones(len(hash_), dtype=bool)
            first[1:] = (hash_[1:] != hash_[:-1]) | (tag[1:] != tag[:-1])
            hash_, tag, ids, start = hash_[first], tag[first], ids[first], start[first]
            part = ((hash_ >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            columns: list[list] = [[], [], [], [], []]
            for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if b > a:
                    columns[0].append(p)
                    for i, values in enumerate((hash_, tag, ids, start)):
                        columns[i + 1].append(values[order[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "hash", "tag", "id", "start"])

    def firsts(rows: pd.DataFrame) -> pd.DataFrame:
        hash_, tag, ids, start = (
            np.frombuffer(b"".join(rows[c]), dtype=t) for c, t in (("hash", np.uint64), ("tag", np.uint32), ("id", np.int64), ("start", np.int32))
        )
        order = np.lexsort((start, ids, tag, hash_))
        hash_, tag, ids, start = hash_[order], tag[order], ids[order], start[order]
        first = np.ones(len(hash_), dtype=bool)
        first[1:] = (hash_[1:] != hash_[:-1]) | (tag[1:] != tag[:-1])
        ids, start = ids[first], start[first]
        # On to the tasks that gather by document.
        part = (mixed(ids.view(np.uint64), 9) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        used = [(p, order[a:b]) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pd.DataFrame({"part": [p for p, _ in used], "id": [ids[r].tobytes() for _, r in used], "start": [start[r].tobytes() for _, r in used]})

    def by_document(rows: pd.DataFrame) -> pd.DataFrame:
        ids, start = np.frombuffer(b"".join(rows["id"]), dtype=np.int64), np.frombuffer(b"".join(rows["start"]), dtype=np.int32)
        order = np.argsort(ids, kind="stable")
        ids, start = ids[order], start[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = ids[1:] != ids[:-1]
        bounds = [*np.nonzero(new)[0].tolist(), len(ids)]
        return pd.DataFrame({"doc_id": ids[bounds[:-1]], "starts": [start[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})

    places = write_stage(
        base.mapInArrow(candidates, "part int, hash binary, tag binary, id binary, start binary")
        .repartition(parts, "part")
        .groupBy("part")
        .applyInPandas(firsts, "part int, id binary, start binary")
        .repartition(parts, "part")
        .groupBy("part")
        .applyInPandas(by_document, "doc_id long, starts binary"),
        "repeat-places",
    )

    types = (T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*whole.schema.fields, *(T.StructField(c, t) for c, t in zip(added, types, strict=True))])

    names = list(whole.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            windows = Windows(batch.column("text").to_pylist(), window, rounds)
            rows = _candidates(windows, filter_, sent.value)
            bounds = np.searchsorted(windows.doc[rows], np.arange(batch.num_rows + 1))
            kept, removed = [], []
            for i, (words, starts, text) in enumerate(zip(windows.words, batch.column("starts").to_pylist(), batch.column("text"), strict=True)):
                own = windows.start[rows[bounds[i] : bounds[i + 1]]]
                gone = np.zeros(0, dtype=bool)
                if len(own):
                    repeat = np.ones(len(words), dtype=bool)
                    repeat[np.frombuffer(starts or b"", dtype=np.int32)] = False
                    own = own[repeat[own]]
                if len(own):
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    change[own] += 1
                    change[own + window] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(own) else words
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode() if text.is_valid else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array([len(w) for w in windows.words], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                [*names, *added],
            )

    return (
        whole.join(places, "doc_id", "left")
        .select(*whole.columns, "starts")
        .mapInArrow(keep, schema)
        .withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
        .select(*(whole.columns if keep_columns else ["doc_id"]), *added)
    )
