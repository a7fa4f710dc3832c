"""Token counts by a finite-state form of a byte-level BPE tokenizer.

The transducer reads a word byte by byte. Its state is the last token of the encoding so far
and, for every start of an entry that may still be completed, the place in the vocabulary's
trie, the token before that start and how many tokens were counted since. A transition
emits by how much the count changes (it can fall when a longer token replaces shorter ones).
States are built when first reached; the tables depend on the vocabulary only.

Texts are cut into chunks. A space after a character that is no white space always starts a
token, whatever stands around it, so a chunk maps any state before it to: the text up to its first
such place, a count, the text after its last one. These maps compose associatively (the
open ends of neighbours join and are counted), which is how the chunks of one text are put together.

* Strings of special tokens inside a text count as one token, as the library does by default.
* A null text is empty: 0 bytes, 0 tokens. A null id is returned as null. Repeated rows
  are counted and returned one by one. Only ``doc_id`` and ``text`` are read.
"""

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.llm.bpe import MergeRule
from ratelantern.llm.common import remembered, text_of

# Fixed value: the public pattern that separates words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A stretch ends before a space that follows a character other than white space.
STRETCH = re.compile(r"\s*\S*(?:[^\S ]\s*\S*)*")
#: Texts without this can be cut at every space.
UNEVEN = re.compile(r"\s |^ | \Z")
MAX_STATES = 300_000
MAX_KNOWN = 500_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        entries = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if all(c in letters for c in token)}
        special = [t["content"] for t in described["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.rule = MergeRule(entries)
        self.children: list[dict[int, int]] = [{}]
        self.complete: list[bytes | None] = [None]
        for token in entries:
            node = 0
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.complete.append(None)
                node = self.children[node][byte]
            self.complete[node] = token
        self.words = regex.compile(WORDS)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.counted: dict[str, int] = {}
        self.states = [(None, ())]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _move(self, number: int, byte: int) -> tuple[int, int]:
        last, starts = self.states[number]
        reached = []
        for node, before, since in (*starts, (0, last, 0)):
            child = self.children[node].get(byte)
            if child is not None:
                reached.append((child, before, since))
        for node, before, since in reached:  # longest entry first
            token = self.complete[node]
            if token is not None and self.rule.follows(before, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = 1 - since
        state = (token, tuple((n, b, s + emitted) for n, b, s in reached if self.children[n]))
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        made = self.moves[number][byte] = (self.numbers[state], emitted)
        return made

    def word(self, word: bytes) -> int:
        state = count = 0
        moves = self.moves
        for byte in word:
            step = moves[state].get(byte) or self._move(state, byte)
            state = step[0]
            count += step[1]
        return count

    def stretch(self, text: str) -> int:
        """Tokens of a text without chunks."""
        parts = self.special.split(text) if self.special else [text]
        total, counted = len(parts) - 1, self.counted
        for part in parts:
            for w in self.words.findall(part):
                n = counted.get(w)
                if n is None:
                    n = counted[w] = self.word(w.encode())
                total += n
        return total

    def count(self, stretches: list[str], before: str = "") -> int:
        """Tokens of stretches, each with ``before`` in front of it."""
        if len(self.states) > MAX_STATES or max(map(len, self.known.values()), default=0) > MAX_KNOWN:
            self._reset()
        known = self.known[before]
        counts = list(map(known.get, stretches))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    known[stretches[i]] = counts[i] = self.stretch(before + stretches[i])
        return sum(counts)

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """Open start, tokens counted inside, open end (None: no place to cut, all is open)."""
        found = STRETCH.findall(chunk)
        while found and not found[-1]:
            found.pop()
        if len(found) < 2:
            return chunk, 0, None
        return found[0], self.count(found[1:-1]), found[-1]

    def whole(self, text: str) -> int:
        if UNEVEN.search(text):
            return self.count(STRETCH.findall(text))
        first, *rest = text.split(" ")
        return self.count([first]) + self.count(rest, " ")

    def composed(self, maps: list[tuple[str, int, str | None]]) -> int:
        """Tokens of the text whose chunk maps are given in order."""
        opened, total = [], 0
        for start, inside, end in maps:
            opened.append(start)
            if end is not None:
                total += self.whole("".join(opened)) + inside
                opened = [end]
        return total + self.whole("".join(opened))


def counter(path: str) -> TokenCounter:
    """One counter per worker process; its tables are kept between batches."""
    return remembered((__name__, path), lambda: TokenCounter(path))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk_chars: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can open.
    """
    base = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    short = F.char_length("text") <= chunk_chars
    result = "doc_id long, n_bytes long, n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).whole
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([count(t.as_py()) for t in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    at_once = base.where(short).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(whole, result)

    # Long texts: chunks go to any task; rows that are equal give equal maps and are told apart by a count.
    chunks = (
        base.where(~short)
        .withColumn("content", F.sha2("text", 256))
        .select(
            "doc_id",
            "content",
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / chunk_chars).cast("int")),
                    lambda i: F.substring("text", i * chunk_chars + 1, F.lit(chunk_chars)),
                )
            ).alias("chunk", "text"),
        )
    )

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_map = counter(tokenizer).chunk_map
        for batch in batches:
            found = [chunk_map(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([m[i] for m in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            names = ["doc_id", "content", "n_bytes", "chunk"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *columns], [*names, "start", "inside", "end"])

    mapped = chunks.repartition("doc_id", "content", "chunk").mapInArrow(
        maps, "doc_id long, content string, n_bytes long, chunk int, start string, inside long, end string"
    )
    folded = mapped.groupBy("doc_id", "content", "n_bytes").agg(
        F.array_sort(F.collect_set(F.struct("chunk", "start", "inside", "end"))).alias("maps"),
        F.count_if(F.col("chunk") == 0).alias("copies"),
    )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        composed = counter(tokenizer).composed
        for batch in batches:
            totals = [composed([(m["start"], m["inside"], m["end"]) for m in row.as_py()]) for row in batch.column("maps")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    in_chunks = folded.select("doc_id", "n_bytes", "maps", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).mapInArrow(compose, result)
    return at_once.unionByName(in_chunks).withColumn("over_limit", F.col("n_tokens") > limit)
