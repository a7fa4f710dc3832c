"""How far sources differ in their words, from stripes folded in the mappers.

A task folds whole documents into stripes: for each language, term to document frequency and occurrences
by source. A stripe table that has grown to ``most_entries`` is spilled, one row per entry, and the entries of
all spills merge by a sum per (language, term, source), which streams and never holds a term's spills together. Merged
stripes of ``min_docs`` documents or more are kept. They are dealt to shards by term, and each shard
directly gives its part of every divergence and its first terms; sums and ranks of these are the result.

All arithmetic is exact: p = 1 + floor(10^9 (c + 2) / (N + 2 V)) by long division, f = floor((p - q)^2 / (p + q)) in 64 bits.

* Null text, lang and source are empty; an empty lang or source is one of its own. Rows that repeat an id are documents of their own.
* A language without kept terms has V = 0: each pair of its sources gets 0, and there are no terms.
* An empty table gives an empty result. Only ``text``, ``lang`` and ``source`` are read; other columns do not matter.
* Bounds: a language's sources, and their pairs, must fit one task; the result has a row for each of these pairs anyway.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratelantern.llm.common import pieces_for, text_bytes
from ratelantern.session import write_stage

#: Letters and all characters beyond ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCALE_STEPS = 3  # 10^9 in steps of 1000
#: Cells of a dense (term, source) table handled at once.
CELLS = 1 << 20

ENTRY = "lang string, term string, source string, n long, docs long"
PART = "lang string, source string, part string, item string, value long"


class Stripes:
    """Occurrences and document frequencies by term, for each (language, source)."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}

    def add(self, text: str, lang: str, source: str) -> None:
        terms = TERM.findall(text.encode().lower())  # bytes: only A-Z change
        if terms:
            self.counts.setdefault((lang, source), Counter()).update(terms)
            self.docs.setdefault((lang, source), Counter()).update(set(terms))

    def __len__(self) -> int:
        return sum(map(len, self.counts.values()))

    def entries(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in self.counts.items():
            docs = self.docs[lang, source]
            terms = pa.array(counts.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(lang, len(counts)),
                    terms,
                    pa.repeat(source, len(counts)),
                    pa.array(counts.values(), pa.int64()),
                    pa.array((docs[t] for t in counts), pa.int64()),
                ],
                ["lang", "term", "source", "n", "docs"],
            )


def stripe_entries(docs: DataFrame, most_entries: int = 1_000_000) -> DataFrame:
    """(lang, term, source, n, docs), summed over what a task folds between two spills."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, unseen = Stripes(), 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(c) for c in ("text", "lang", "source")), strict=True):
                text = text.as_py()
                stripes.add(text, lang.as_py(), source.as_py())
                unseen += len(text) // 2 + 1  # there can't be more new entries than that
                if unseen >= most_entries:
                    unseen = len(stripes)
                    if 2 * unseen >= most_entries:
                        yield from stripes.entries()
                        stripes, unseen = Stripes(), 0
        yield from stripes.entries()

    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))).mapInArrow(fold, ENTRY)


def merged_stripes(entries: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """Kept terms: (lang, shard, term, sources, counts)."""
    # One shuffle serves both sums: what is dealt by (lang, term) is together by (lang, term, source) too.
    summed = (
        entries.repartition(shards, "lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    frequency = F.sum("docs").over(W.partitionBy("lang", "term"))
    kept = summed.withColumn("df", frequency).where(F.col("df") >= min_docs)
    return kept.groupBy("lang", "term").agg(F.collect_list("source").alias("sources"), F.collect_list("n").alias("counts")).select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "term", "sources", "counts"
    )


def scaled(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 x counts / totals), exact for totals up to 2^63 / 1000."""
    out, rest = np.divmod(counts, totals)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_parts(stripes: pa.Table, info: pa.Table, top: int) -> pa.Table:
    """One shard's part of the sums over pairs, and the first ``top`` terms of each source in it."""
    if not stripes.num_rows or not info.num_rows:
        return pa.table({c: pa.array([], pa.int64() if c == "value" else pa.string()) for c in ("lang", "source", "part", "item", "value")})
    lang, names, totals = (info[c][0].as_py() for c in ("lang", "sources", "totals"))
    column = {s: i for i, s in enumerate(names)}
    smooth = 2 * info["n_terms"][0].as_py()
    totals = np.array(totals, dtype=np.int64) + smooth
    all_total = totals.sum() - smooth * (len(names) - 1)
    terms = np.array([t.encode() for t in stripes["term"].to_pylist()], dtype=object)
    order = np.argsort(terms, kind="stable")
    sources, counts = stripes["sources"].to_pylist(), stripes["counts"].to_pylist()
    pairs = np.zeros((len(names), len(names)), dtype=np.int64)
    best: list[list[tuple[int, bytes]]] = [[] for _ in names]
    step = max(1, CELLS // len(names))
    for at in range(0, len(order), step):
        rows = order[at : at + step]
        table = np.zeros((len(names), len(rows)), dtype=np.int64)
        for r, row in enumerate(rows.tolist()):
            for source, n in zip(sources[row], counts[row], strict=True):
                table[column[source], r] = n
        p = scaled(table + 2, totals[:, None])
        q = scaled(table.sum(axis=0) + 2, all_total)
        for i in range(len(names)):
            if i:
                pairs[i, :i] += divergence(p[:i], p[i]).sum(axis=1)
            here = np.nonzero((table[i] > 0) & (p[i] > q))[0]
            value = divergence(p[i, here], q[here])
            first = np.lexsort((here, -value))[:top]  # terms are in order here
            best[i] = sorted([*best[i], *((-int(value[k]), terms[rows[here[k]]]) for k in first)])[:top]
    pairs += pairs.T
    found = [(names[i], "pair", names[j], int(pairs[i, j])) for i in range(len(names)) for j in range(len(names)) if i != j]
    found += [(names[i], "term", term.decode(), -value) for i in range(len(names)) for value, term in best[i]]
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.table(
        {
            "lang": pa.array([lang] * len(found), pa.string()),
            "source": pa.array(columns[0], pa.string()),
            "part": pa.array(columns[1], pa.string()),
            "item": pa.array(columns[2], pa.string()),
            "value": pa.array(columns[3], pa.int64()),
        }
    )


def divergences(docs: DataFrame, min_docs: int = 10, top: int = 10, shard_bytes: int = 16 << 20) -> DataFrame:
    """lang, source, part, item, value and rank of all pairs of sources and of the first terms of each."""
    shards = pieces_for(text_bytes(docs), shard_bytes)
    stripes = write_stage(merged_stripes(stripe_entries(docs), shards, min_docs), "audit-stripes")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = write_stage(groups, "audit-groups")
    totals = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    listed = F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))))
    info = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(listed.alias("listed"))
    held = stripes.groupBy("lang", "shard").agg(F.count("*").alias("n"))
    info = write_stage(
        held.join(held.groupBy("lang").agg(F.sum("n").alias("n_terms")), "lang")
        .join(info, "lang")
        .select("lang", "shard", "n_terms", F.col("listed.source").alias("sources"), F.col("listed.total").alias("totals")),
        "audit-info",
    )
    parts = write_stage(
        stripes.groupBy("lang", "shard").cogroup(info.groupBy("lang", "shard")).applyInArrow(lambda left, right: shard_parts(left, right, top), PART),
        "audit-parts",
    )
    summed = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = (
        groups.join(groups.withColumnRenamed("source", "item"), "lang")
        .where("source != item")
        .join(summed, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)
