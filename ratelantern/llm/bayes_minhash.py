"""Near-duplicates by MinHash bands and sequential Bayesian verification.

Documents are sets of word shingles. Equal sets form a class, named by its smallest id; only classes
go on. A class is a candidate of another if one band of their signatures is equal. A pair's
signatures are compared in batches; with m of n values equal and no prior preference the
similarity has distribution Beta(m + 1, n - m + 1), and the pair is dropped as soon as the
probability of reaching the threshold falls below ``miss``. Survivors are compared on their full sets.

Groups are resolved without all their pairs. First each member of a bucket is compared with the
bucket's smallest id. Then only members of one bucket that are not yet in one component are compared, in
blocks of bounded size, so a bucket whose members all reach each other costs a comparison per member.

* Texts without words have an empty set (size 0) and link with nothing; texts with fewer words
  than a shingle have their whole word sequence as their only shingle.
* A null id cannot name a component: such rows link with nothing, have a null component and are
  kept. Repeated rows are returned one by one;
  rows with one id and different sets count as one document, compared by one of its sets. Only ``doc_id`` and ``text`` are read.
"""

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.llm.common import remembered
from ratelantern.llm.components import components
from ratelantern.llm.rolling import WordNames, mixed, words_of
from ratelantern.session import write_stage

BATCH = 32
#: Members of a block in which unresolved pairs are compared.
BLOCK = 2048
#: Ids are broadcast up to this number (8 bytes each) and joined by shuffle beyond it.
BROADCAST_IDS = 4_000_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted names of the distinct shingles."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    names = remembered(__name__, WordNames).of(words)
    k = min(shingle, len(names))
    made = names[: len(names) - k + 1].copy()
    for i in range(1, k):
        made = mixed(made, 3) + names[i : len(names) - k + 1 + i]
    return np.unique(mixed(made, k))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Smallest value of each of ``size`` hash functions over each set (not empty)."""
    rng = np.random.default_rng(20_240_229)
    factor = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    found = np.empty((len(sets), size), dtype=np.uint32)
    for i in range(size):
        found[:, i] = np.minimum.reduceat(((values * factor[i] + offset[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return found


def fewest_matches(size: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, least m) for each batch end: with fewer of n values equal the pair is dropped."""
    bounds = []
    for n in range(BATCH, size + 1, BATCH):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        bounds.append((n, m))
    return bounds


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Rows of signature pairs that no batch rules out."""
    rows = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    done = 0
    for n, least in bounds:
        matches = matches + (a[rows, done:n] == b[rows, done:n]).sum(axis=1)
        keep = matches >= least
        rows, matches, done = rows[keep], matches[keep], n
    return rows


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 x common >= percent x union, for sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, size)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    percent: int = 85,
    bands: int = 25,
    rows: int = 5,
    size: int = 128,
    miss: float = 1e-6,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; links need ``percent`` % similarity."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), "text")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
                full = [j for j, s in enumerate(sets) if len(s)]
                made = signatures([sets[j] for j in full], size) if full else None
                sign: list[bytes | None] = [None] * len(sets)
                content: list[bytes | None] = [None] * len(sets)
                for j, row in zip(full, made if full else [], strict=True):
                    sign[j] = row.tobytes()
                    content[j] = xxhash.xxh3_128_digest(sets[j].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(content, pa.binary()), pa.array(sign, pa.binary())],
                    ["doc_id", "n_shingles", "content", "signature"],
                )

    profiles = write_stage(base.mapInArrow(profile, "doc_id long, n_shingles long, content binary, signature binary"), "near-profiles")
    classes = write_stage(
        profiles.where("doc_id IS NOT NULL AND content IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("class"), F.first("signature").alias("signature")),
        "near-classes",
    )
    bounds = fewest_matches(size, percent / 100, miss)

    def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, size).astype(np.uint64)
            keys = []
            for b in range(bands):
                key = np.full(len(made), b + 1, dtype=np.uint64)
                for r in range(rows):
                    key = mixed(key, 5) + made[:, b * rows + r]
                keys.append(mixed(key, b).view(np.int64))
            ids = batch.column("class").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, bands))], ["band", "class"])

    members = classes.select("class", "signature").mapInArrow(band_keys, "band long, class long")
    buckets = members.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).where("least < most")
    members = write_stage(members.join(buckets, "band"), "near-members")

    def by_signature(pairs: DataFrame) -> DataFrame:
        signs = classes.select("class", "signature")
        joined = (
            pairs.join(signs.withColumnsRenamed({"class": "a", "signature": "sa"}), "a").join(signs.withColumnsRenamed({"class": "b", "signature": "sb"}), "b")
        )

        def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = survivors(_matrix(batch["sa"], size), _matrix(batch["sb"], size), bounds)
                yield batch.iloc[keep][["a", "b"]]

        return joined.mapInPandas(prune, "a long, b long")

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["class", "set"])

    def sets_of(needed: DataFrame, name: str) -> DataFrame:
        """Sets of the classes named in column doc_id."""
        needed = write_stage(needed.distinct(), f"near-needed-{name}")
        if needed.count() <= BROADCAST_IDS:
            needed = F.broadcast(needed)
        sets = base.join(needed, "doc_id", "left_semi").mapInArrow(make_sets, "class long, set binary")
        return write_stage(sets.dropDuplicates(["class"]), f"near-sets-{name}")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs, by the full sets of the classes concerned."""
        pairs = write_stage(pairs, "near-survivors")
        sets = sets_of(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), "1")
        joined = pairs.join(sets.withColumnsRenamed({"class": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"class": "b", "set": "sb"}), "b")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sets_a, sets_b = ([np.frombuffer(x, dtype=np.uint64) for x in batch[c]] for c in ("sa", "sb"))
                yield batch.loc[[linked(x, y, percent) for x, y in zip(sets_a, sets_b, strict=True)], ["a", "b"]]

        return write_stage(joined.mapInPandas(compare, "a long, b long"), "near-links-1")

    first = members.where("class > least").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct()
    links = verified(by_signature(first))
    found = components(links)

    # What is left: members of a bucket in different components, in blocks.
    placed = members.join(found.withColumnsRenamed({"id": "class"}), "class", "left").withColumn("component", F.coalesce("component", "class"))
    left = placed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("band")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    unresolved = (
        placed.join(left, "band")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "component")
        .join(classes.select("class", "signature"), "class")
    )

    def open_pairs(rows_: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of the low block with the members of the high one that its signature does not rule out."""
        signs = _matrix(rows_["signature"], size)
        own_, ids, comp = (rows_[c].to_numpy() for c in ("own", "class", "component"))
        lo, hi = rows_["lo"].iloc[0], rows_["hi"].iloc[0]
        for i in np.nonzero(own_ == lo)[0].tolist():
            others = np.nonzero((own_ == hi) & (comp != comp[i]) & ((ids > ids[i]) if lo == hi else True))[0]
            if len(others):
                kept = others[survivors(np.broadcast_to(signs[i], (len(others), size)), signs[others], bounds)]
                if len(kept):
                    yield i, kept

    def concerned(rows_: pd.DataFrame) -> pd.DataFrame:
        found = {k for i, kept in open_pairs(rows_) for k in (i, *kept.tolist())}
        return pd.DataFrame({"doc_id": rows_["class"].to_numpy()[sorted(found)]})

    def resolve(rows_: pd.DataFrame) -> pd.DataFrame:
        """Links that join components; pairs that links of this block have joined already are passed over."""
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows_["set"]]
        ids, comp = rows_["class"].to_numpy(), rows_["component"].to_numpy().copy()
        made = []
        for i, kept in open_pairs(rows_):
            for j in kept.tolist():
                if comp[i] != comp[j] and linked(sets[i], sets[j], percent):
                    comp[comp == comp[j]] = comp[i]
                    made.append((ids[i], ids[j]))
        return pd.DataFrame(made, columns=["a", "b"], dtype="int64")

    unresolved = write_stage(unresolved, "near-unresolved")
    block = ("band", "lo", "hi")
    sets = sets_of(unresolved.groupBy(*block).applyInPandas(concerned, "doc_id long"), "2")
    more = unresolved.join(sets, "class").groupBy(*block).applyInPandas(resolve, "a long, b long")
    links = links.unionByName(write_stage(more, "near-links-2"))
    found = components(links)
    return (
        profiles.select("doc_id", "n_shingles", "content")
        .join(classes.select("content", "class"), "content", "left")
        .join(found.withColumnsRenamed({"id": "class"}), "class", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
