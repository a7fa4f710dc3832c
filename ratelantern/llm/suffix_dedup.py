"""Removal of byte strings that occur again, from suffix arrays of shards.

Equal strings of ``window`` bytes must meet in one shard, and no shard may grow with a frequent passage.

1. The mark of a window is the hash of one of its ``gram``-byte substrings, the first with the smallest half of a hash, so equal
   windows have equal marks.
   Marks are dealt by hash and counted; those that occur again set bits of a filter, and hot ones, which occur
   more than ``hot`` times, bits of another.
2. Windows with hot marks are compared by a hash of the whole window, likewise. That cuts a frequent passage
   from what surrounds it, so that its pieces are the same wherever it stands.
3. Neighbouring windows marked by one place, with a mark that may occur again, are a piece of text. A task sends each distinct piece
   twice at most. Pieces are dealt to shards by mark; a shard cuts its pieces into portions of whole marks,
   builds the suffix array of each by induced sorting, and from its permuted common prefixes
   finds the windows that start at another place too. These are the result, whatever the hashes were.
4. Covered ranges of pieces go back to the texts they stand in by joins on the hashes (128 bits) of pieces and texts.

Filters only ever let too much through, so results are exact as far as equal 128-bit hashes mean equal strings. A
filter of ``filter_bytes`` holds about as many repeated marks; with more it lets more pieces through, and the work
grows up to that for all windows.

* Null and empty texts, and texts shorter than a window, lose nothing. Matches never cross documents.
* Ids are only carried along: null ids and rows that share an id or all values are documents of their own. All copies are removed.
* An empty table gives an empty result. Only ``doc_id`` and ``text`` are read; other columns do not matter.
"""

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.llm.common import pieces_for, text_bytes
from ratelantern.llm.rolling import mixed, powers, prefix_hashes
from ratelantern.llm.suffix_array import occurring_again
from ratelantern.session import write_stage

#: About so many bytes of text are handled at once.
BYTES_AT_ONCE = 1 << 20
#: A task deals out so many names of marks or windows at a time.
NAMES_AT_ONCE = 1_000_000
#: A task remembers so many texts and pieces; what it forgets it sends again.
REMEMBERED = 1 << 20
#: Half of a 64-bit word holds a place among the bytes handled at once.
PLACE = np.uint64(0xFFFFFFFF)

PIECES = "mark long, h1 long, h2 long, piece binary"
PLACES = "k1 long, k2 long, start int, h1 long, h2 long"
COVERED = "h1 long, h2 long, covered binary"
PACKED = "doc_id long, k1 long, k2 long, n_bytes long, packed binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


class Seen(Counter):
    """How often keys were met, at most twice; forgets all when it is full."""

    def again(self, key) -> int:
        """How often ``key`` was met before."""
        before = self[key]
        if before < 2:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = before + 1
        return before


class Bits:
    """A filter in parts; each part owns a segment."""

    def __init__(self, parts: int, bits_per_part: int):
        self.parts, self.bits = parts, bits_per_part
        self.segments = np.zeros((parts, bits_per_part // 8), dtype=np.uint8)

    def part(self, names: np.ndarray) -> np.ndarray:
        return ((names >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int64)

    def bit(self, names: np.ndarray) -> np.ndarray:
        return (mixed(names, 7) % np.uint64(self.bits)).astype(np.int64)

    def segment(self, names: np.ndarray) -> bytes:
        segment = np.zeros(self.bits, dtype=np.uint8)
        segment[self.bit(names)] = 1
        return np.packbits(segment, bitorder="little").tobytes()

    def passes(self, names: np.ndarray) -> np.ndarray:
        at = self.part(names) * self.bits + self.bit(names)
        return (self.segments.reshape(-1)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Runs:
    """Maximal runs of neighbouring windows marked by one place, in some texts put after one another."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.window, self.text = window, b"".join(texts)
        self.prefix = prefix_hashes(np.frombuffer(self.text, dtype=np.uint8).astype(np.uint64))
        n = len(self.text)
        if n < window:
            self.start = self.length = np.zeros(0, dtype=np.int64)
            self.mark = np.zeros(0, dtype=np.uint64)
            return
        hashes = self._hashes(gram)
        # The first place among equal hashes, so that each window of a repetitive text has a place of its own.
        least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        size, span = 1, window - gram + 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        change = np.zeros(n + 1, dtype=np.int8)
        long = np.nonzero(sizes >= window)[0]
        np.add.at(change, self.first[long], 1)
        np.add.at(change, self.first[long] + sizes[long] - window + 1, -1)
        inside = np.cumsum(change[: len(least)]) > 0
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        over = np.zeros(len(least) + 1, dtype=bool)
        over[:-1] = new | ~inside
        over[-1] = True
        self.start = np.nonzero(new)[0]
        ends = np.nonzero(over)[0]
        self.length = ends[np.searchsorted(ends, self.start, side="right")] - self.start
        self.mark = hashes[(least[self.start] & PLACE).astype(np.int64)]

    def _hashes(self, size: int) -> np.ndarray:
        """Of all substrings of ``size`` bytes."""
        return mixed(self.prefix[size:] - self.prefix[:-size] * powers(size)[size], size)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of these runs, and hashes of the windows."""
        length = self.length[which]
        at = np.repeat(self.start[which], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        base = powers(self.window)[self.window]
        return at, mixed(self.prefix[at + self.window] - self.prefix[at] * base, self.window)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n_bytes") if "n_bytes" in batch.schema.names else pc.binary_length(batch.column("text"))
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // BYTES_AT_ONCE
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _texts(batch: pa.RecordBatch, seen: Seen) -> tuple[list[bytes], list[int], list[int]]:
    """Texts met for the first or second time, their rows, and how often they were met before."""
    texts, rows, before = [], [], []
    for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        if text:
            times = seen.again(xxhash.xxh3_128_digest(text))
            if times < 2:
                texts.append(text)
                rows.append(row)
                before.append(times)
    return texts, rows, before


def _counted(texts: DataFrame, bits: Bits, names_of: Callable[[list[bytes]], np.ndarray], hot: int) -> tuple[Bits, Bits | None]:
    """Filters of the names that occur again, and of those that occur more than ``hot`` times (None if there are none)."""
    parts = bits.parts

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = Seen(), []
        for batch in _portions(batches):
            held.append(names_of(_texts(batch, seen)[0]))
            if sum(map(len, held)) >= NAMES_AT_ONCE:
                yield dealt_names(np.concatenate(held))
                held = []
        if held:
            yield dealt_names(np.concatenate(held))

    def dealt_names(all_names: np.ndarray) -> pa.RecordBatch:
        found, counts = np.unique(all_names, return_counts=True)
        part = bits.part(found)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        used = [(p, order[a:b]) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in used], pa.int32()),
                pa.array([found[r].tobytes() for _, r in used], pa.binary()),
                pa.array([counts[r].astype(np.uint32).tobytes() for _, r in used], pa.binary()),
            ],
            ["part", "names", "counts"],
        )

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = np.frombuffer(b"".join(rows["names"]), dtype=np.uint64)
        counts = np.frombuffer(b"".join(rows["counts"]), dtype=np.uint32)
        order = np.argsort(found)
        found = found[order]
        first = np.concatenate(([0], np.nonzero(found[1:] != found[:-1])[0] + 1))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        found = found[first]
        frequent = found[total > hot]
        return pd.DataFrame({"part": [int(key[0])], "again": [bits.segment(found[total > 1])], "hot": [bits.segment(frequent) if len(frequent) else None]})

    again, frequent, any_hot = bits, Bits(parts, bits.bits), False
    dealt = texts.select("text").mapInArrow(names, "part int, names binary, counts binary").repartition(parts, "part")
    # One segment of each filter per part, a bounded number of bytes in all.
    for row in dealt.groupBy("part").applyInPandas(summed, "part int, again binary, hot binary").collect():
        again.segments[row["part"]] = np.frombuffer(row["again"], dtype=np.uint8)
        if row["hot"] is not None:
            any_hot = True
            frequent.segments[row["part"]] = np.frombuffer(row["hot"], dtype=np.uint8)
    return again, frequent if any_hot else None


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts made small, each on its own, for the shuffle that takes them to their ranges."""
    codec = pa.Codec("zstd")
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "k1", "k2")),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary()),
            ],
            ["doc_id", "k1", "k2", "n_bytes", "packed"],
        )


def covered_ranges(again: np.ndarray, window: int) -> bytes:
    """Starts and ends (int32) of the maximal ranges that the marked windows cover."""
    at = np.nonzero(again)[0]
    if not len(at):
        return b""
    gap = np.nonzero(np.diff(at) > window)[0]
    starts = at[np.concatenate(([0], gap + 1))]
    ends = at[np.concatenate((gap, [len(at) - 1]))] + window
    return np.column_stack((starts, ends)).astype(np.int32).tobytes()


def shard_ranges(table: pa.Table, window: int, portion_bytes: int) -> pa.Table:
    """What is covered of each piece of a shard. A piece that a task sends again is empty; its text sorts first."""
    table = table.append_column("size", pc.binary_length(table["piece"])).combine_chunks()
    table = table.sort_by([("mark", "ascending"), ("h1", "ascending"), ("h2", "ascending"), ("size", "descending")])
    mark, h1, h2 = (table[c].to_numpy() for c in ("mark", "h1", "h2"))
    pieces = table["piece"]
    new = np.ones(len(mark), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (mark[1:] != mark[:-1])
    first = np.nonzero(new)[0]
    copies = np.diff(first, append=len(mark)) > 1
    sizes = table["size"].to_numpy()[first].astype(np.int64)
    # Portions of whole marks.
    mark_start = np.ones(len(first), dtype=bool)
    mark_start[1:] = mark[first[1:]] != mark[first[:-1]]
    filled = (np.cumsum(sizes) - sizes) // portion_bytes
    portion = filled[mark_start][np.cumsum(mark_start) - 1] if len(first) else filled
    cuts = [0, *(np.nonzero(np.diff(portion))[0] + 1).tolist(), len(first)]
    ids, covered = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        strings = pieces.take(pa.array(first[a:b])).to_pylist()
        for i, again in enumerate(occurring_again(strings, window) if strings else []):
            if copies[a + i]:
                again = np.ones(len(again), dtype=bool)
            if again.any():
                ids.append(first[a + i])
                covered.append(covered_ranges(again, window))
    return pa.table({"h1": h1[ids], "h2": h2[ids], "covered": pa.array(covered, pa.binary())})


def without_repeats(
    docs: DataFrame,
    window: int = 200,
    gram: int = 64,
    hot: int = 10_000,
    part_bytes: int = 32 << 20,
    shard_bytes: int = 8 << 20,
    portion_bytes: int = 1 << 20,
    filter_bytes: int = 64 << 20,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (remaining bytes) of each row."""
    spark = docs.sparkSession
    gram = min(gram, window)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(17), "text")}
    )
    size = text_bytes(base)
    parts, shards = pieces_for(size, part_bytes), pieces_for(size, shard_bytes)
    # About 16 bits for each mark of a text without repeats, within the bound.
    per_part = max(64, min(size * 16 * 2 // (window - gram + 2), filter_bytes * 8) // parts // 8 * 8)

    marks, hot_marks = _counted(base, Bits(parts, per_part), lambda texts: Runs(texts, window, gram).mark, hot)
    sent_marks, sent_hot, sent_windows = spark.sparkContext.broadcast(marks), None, None
    if hot_marks:
        sent_hot = spark.sparkContext.broadcast(hot_marks)

        def hot_windows(texts: list[bytes]) -> np.ndarray:
            runs = Runs(texts, window, gram)
            return runs.windows(np.nonzero(sent_hot.value.passes(runs.mark))[0])[1]

        sent_windows = spark.sparkContext.broadcast(_counted(base, Bits(parts, per_part), hot_windows, 1 << 62)[0])

    def candidates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs]:
        """First window, number of windows and mark of all pieces."""
        runs = Runs(texts, window, gram)
        again = np.nonzero(sent_marks.value.passes(runs.mark))[0]
        start, length, mark = runs.start[again], runs.length[again], runs.mark[again]
        if sent_hot is not None:
            is_hot = sent_hot.value.passes(mark)
            at, names = runs.windows(again[is_hot])
            owner = np.repeat(np.arange(is_hot.sum()), length[is_hot])
            passed = sent_windows.value.passes(names)
            at, owner = at[passed], owner[passed]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
            first = np.nonzero(new)[0]
            start = np.concatenate((start[~is_hot], at[first]))
            length = np.concatenate((length[~is_hot], np.diff(first, append=len(at))))
            mark = np.concatenate((mark[~is_hot], mark[is_hot][owner[first]]))
        return start, length, mark, runs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, each distinct one twice at most, the second time by name alone."""
        seen, sent = Seen(), Seen()
        for batch in _portions(batches):
            texts, _, _ = _texts(batch, seen)
            start, length, mark, runs = candidates(texts)
            pieces, names, keep = [], [], []
            for i, (a, n) in enumerate(zip(start.tolist(), length.tolist(), strict=True)):
                piece = runs.text[a : a + n + window - 1]
                name = xxhash.xxh3_128_digest(piece)
                times = sent.again(name)
                if times < 2:
                    keep.append(i)
                    names.append(name)
                    pieces.append(b"" if times else piece)
            hashes = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark[keep].view(np.int64)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(pieces, pa.binary())],
                ["mark", "h1", "h2", "piece"],
            )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the pieces of each distinct text stand in it."""
        seen = Seen()
        for batch in _portions(batches):
            texts, rows, before = _texts(batch, seen)
            first = [i for i, times in enumerate(before) if not times]
            start, length, _, runs = candidates([texts[i] for i in first])
            owner = np.searchsorted(runs.first, start, side="right") - 1 if first else start
            ends = (start + length + window - 1).tolist()
            names = [xxhash.xxh3_128_digest(runs.text[a:b]) for a, b in zip(start.tolist(), ends, strict=True)]
            hashes = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
            row = pa.array(np.array(rows, dtype=np.int64)[np.array(first, dtype=np.int64)][owner])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(row),
                    batch.column("k2").take(row),
                    pa.array((start - runs.first[owner]).astype(np.int32)),
                    pa.array(hashes[:, 0]),
                    pa.array(hashes[:, 1]),
                ],
                ["k1", "k2", "start", "h1", "h2"],
            )

    # Texts are cut twice, as storing the pieces next to their shuffle would take as much disk again.
    covered = write_stage(
        base.select("text")
        .mapInArrow(cut, PIECES)
        .select("mark", "h1", "h2", "piece", F.pmod(F.xxhash64("mark"), F.lit(shards)).alias("shard"))
        .repartition(shards, "shard")
        .groupBy("shard")
        .applyInArrow(lambda table: shard_ranges(table, window, portion_bytes), COVERED),
        "suffix-covered",
    )
    ranges = (
        base.select("text", "k1", "k2")
        .mapInArrow(places, PLACES)
        .join(covered, ["h1", "h2"])
        .select("k1", "k2", "start", "covered")
        # One shuffle for both: copies of a text have sent their pieces from several tasks.
        .repartition("k1", "k2")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "covered")).alias("ranges"))
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in _portions(batches):
            removed, spans, kept = [], [], []
            sizes = batch.column("n_bytes").to_pylist()
            texts = [
                codec.decompress(t, decompressed_size=n, asbytes=True) if n else b""
                for t, n in zip(batch.column("packed").to_pylist(), sizes, strict=True)
            ]
            for text, ranges in zip(texts, batch.column("ranges"), strict=True):
                if ranges.is_valid:
                    found = ranges.values
                    at, covered = found.field("start").to_numpy(), found.field("covered").to_pylist()
                    pairs = np.frombuffer(b"".join(covered), dtype=np.int32).reshape(-1, 2)
                    pairs = pairs + np.repeat(at, [len(c) // 8 for c in covered])[:, None]
                    change = np.bincount(pairs[:, 0], minlength=len(text) + 1) - np.bincount(pairs[:, 1], minlength=len(text) + 1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
                else:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    texts = base.select("doc_id", "k1", "k2", "text").mapInArrow(packed, PACKED)
    return texts.join(ranges, ["k1", "k2"], "left").select("doc_id", "n_bytes", "packed", "ranges").mapInArrow(remove, RESULT)
