"""Near-duplicate vectors by an inverted multi-index.

Vectors are normed and turned by a fixed rotation; each half is coded by a codebook of its own,
and the pairs of codes form a grid of cells per label. A vector visits the cells of the grid
nearest first, by how far it would have to move in either half to be coded there. A partner at the
threshold is a move of known length in a direction that the rotation makes random, so visiting all
cells up to a bound reaches the partner's cell with probability ``recall`` at least
(a bound never beyond the length of the move itself, which is certain). Members of visited cells are
verified by cosine in double precision.

Each unordered pair of cells is visited from the cell with the smaller number, and each pair of
vectors in one cell is compared once, in blocks of bounded size; a block reports the number of
links per vector and a spanning forest of its links, never all pairs.

* Labels must be equal and not null; vectors must have one length.
* Vectors that are null, zero or hold null or non-finite components, and rows with a null id, link
  with nothing: they have no links and are a component of their own (null for a null id; kept).
* Equal rows count once and are returned one by one; rows with one id share its result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelantern.llm.common import pieces_for
from ratelantern.llm.components import components
from ratelantern.llm.vectors import matrix, sample_of, unit, vectors
from ratelantern.session import write_stage

#: Vectors per cell that the codebooks aim at.
CELL_ROWS = 1024
MAX_CODES = 256
SAMPLE = 8192
BLOCK = 1024
PROBES = 4096
#: Rows are placed together while their visits to the whole grid would be this many numbers at most.
PLACED_AT_ONCE = 1 << 22
#: Visiting rows that are handed on together, each with its vector.
VISITS_AT_ONCE = 1 << 13


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codebook(rows: np.ndarray, codes: int) -> np.ndarray:
    """k-means centres; fewer than ``codes`` if there are fewer distinct rows."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.random.default_rng(1).permutation(len(distinct))[:codes]]
    for _ in range(8):
        nearest = ((rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def moves(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance from each row to the border of its own region towards each other centre (own: 0)."""
    square = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)
    own = square.argmin(1)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 1e-300))
    margin = (square - square[np.arange(len(rows)), own][:, None]) / (2 * apart[own])
    margin[np.arange(len(rows)), own] = 0
    return np.maximum(margin, 0) ** 2


def visits(rows: np.ndarray, books: tuple[np.ndarray, np.ndarray], bound: float):
    """Own cell of each row, and (row, cell) of the cells visited besides it."""
    half = rows.shape[1] // 2
    first, second = moves(rows[:, :half], books[0]), moves(rows[:, half:], books[1])
    own = first.argmin(1) * len(books[1]) + second.argmin(1)
    # The sequences of both halves are merged by their sum, up to the bound.
    row, a = np.nonzero(first <= bound)
    pair, b = np.nonzero(first[row, a][:, None] + second[row] <= bound)
    row, cell = row[pair], a[pair] * len(books[1]) + b
    other = cell > own[row]
    return own, row[other], cell[other]


def placed_rows(part: pd.DataFrame, books: tuple[np.ndarray, np.ndarray], bound: float) -> Iterator[pd.DataFrame]:
    """The vectors in their own cells, and once more for each cell they visit, a bounded number of visits at a time."""
    step = max(1, PLACED_AT_ONCE // (len(books[0]) * len(books[1])))
    turn = rotation(sum(book.shape[1] for book in books))
    for at in range(0, len(part), step):
        some = part.iloc[at : at + step]
        own, row, cell = visits(unit(matrix(some["vector"])) @ turn, books, bound)
        yield some.assign(cell=own, member=True)
        for i in range(0, len(row), VISITS_AT_ONCE):
            yield some.iloc[row[i : i + VISITS_AT_ONCE]].assign(cell=cell[i : i + VISITS_AT_ONCE], member=False)


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``links`` (rows: ids ``left``, columns: ids ``right``) connects."""
    far = np.iinfo(np.int64).max
    rows, cols = np.nonzero(links.any(1))[0], np.nonzero(links.any(0))[0]
    links = links[np.ix_(rows, cols)]
    of_left, of_right = left[rows].copy(), right[cols].copy()
    while True:
        new_left = np.minimum(of_left, np.where(links, of_right[None, :], far).min(axis=1, initial=far))
        new_right = np.minimum(of_right, np.where(links, new_left[:, None], far).min(axis=0, initial=far))
        if (new_left == of_left).all() and (new_right == of_right).all():
            break
        of_left, of_right = new_left, new_right
    return sorted({(int(i), int(r)) for i, r in [*zip(left[rows], of_left), *zip(right[cols], of_right)] if i != r})


def near_duplicates(table: DataFrame, threshold: float = 0.93, recall: float = 1 - 1e-6) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = table.sparkSession
    rows = write_stage(vectors(table).where("label IS NOT NULL").withColumn("label", F.col("label").cast("string")), "multi-vectors")
    sizes = {r["dim"]: (r["n"], r["labels"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).orderBy("dim").collect()}
    books, bounds = {}, {}
    reach = 2 - 2 * threshold
    for dim, (n, labels) in sizes.items():
        codes = int(min(MAX_CODES, max(1, round(np.sqrt(n / max(labels, 1) / CELL_ROWS) * 2))))
        some = matrix(r["vector"] for r in sample_of(rows.where(F.col("dim") == dim), SAMPLE, n).orderBy("vec_id").collect())
        turned = unit(some) @ rotation(dim) if len(some) else np.zeros((1, dim))
        books[dim] = (codebook(turned[:, : dim // 2], codes), codebook(turned[:, dim // 2 :], codes))
        bounds[dim] = min(reach, -2 * np.log(1 - recall) * reach / dim) + 1e-9
    sent = spark.sparkContext.broadcast((books, bounds))

    def place(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                dim = int(dim)
                yield from placed_rows(part, sent.value[0][dim], sent.value[1][dim])

    placed = rows.mapInPandas(place, "vec_id long, label string, vector array<double>, dim int, cell long, member boolean")
    placed = write_stage(placed, "multi-placed")
    key = ["label", "dim", "cell"]
    counts = placed.groupBy(*key).agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("probes"))
    chunks = F.ceil(F.col("members") / BLOCK).cast("int")
    probe_chunks = F.ceil(F.col("probes") / PROBES).cast("int")
    placed = placed.join(counts.where("members > 0"), key).withColumn("hash", F.xxhash64("vec_id", "vector"))
    placed = placed.withColumn("own", F.pmod("hash", F.when(F.col("member"), chunks).otherwise(probe_chunks)).cast("int"))
    spots = F.when(
        F.col("member"),
        F.concat(
            # With each other chunk of the cell, and with each chunk of probes.
            F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least("own", x).alias("lo"), F.greatest("own", x).alias("hi"), F.lit(-1).alias("probe"))),
            F.transform(F.when(probe_chunks > 0, F.sequence(F.lit(0), probe_chunks - 1)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(F.col("own").alias("lo"), F.col("own").alias("hi"), x.alias("probe"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(x.alias("lo"), x.alias("hi"), F.col("own").alias("probe"))))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        ids, own, member = part["vec_id"].to_numpy(), part["own"].to_numpy(), part["member"].to_numpy()
        normed = unit(matrix(part["vector"]))
        lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
        if part["probe"].iloc[0] >= 0:
            left, right, within = np.nonzero(~member)[0], np.nonzero(member)[0], False
        else:
            left, right, within = np.nonzero(own == lo)[0], np.nonzero(own == hi)[0], lo == hi
        linked = np.zeros(len(ids), dtype=np.int64)
        edges: list[tuple[int, int]] = []
        for i in range(0, len(left), BLOCK):
            some = left[i : i + BLOCK]
            if not len(right):
                break
            links = (normed[some] @ normed[right].T >= threshold) & (ids[some][:, None] != ids[right][None, :])
            linked[some] += links.sum(axis=1)
            if not within:  # within one chunk each pair is seen from both sides
                linked[right] += links.sum(axis=0)
            if links.any():
                edges += forest(links, ids[some], ids[right])
        some = np.nonzero(linked)[0]
        return pd.concat([pd.DataFrame({"a": ids[some], "b": ids[some], "n": linked[some]}), pd.DataFrame(edges, columns=["a", "b"], dtype="int64").assign(n=0)]).astype("int64")

    found = write_stage(
        placed.withColumn("spot", F.explode(spots))
        .select(*key, "vec_id", "vector", "member", "own", "spot.lo", "spot.hi", "spot.probe")
        .groupBy(*key, "lo", "hi", "probe")
        .applyInPandas(compare, "a long, b long, n long"),
        "multi-links",
    )
    linked = found.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    reached = components(found.where("n = 0").select("a", "b")).withColumnRenamed("id", "vec_id")
    return (
        table.select(F.col("vec_id").cast("long"))
        .join(linked, "vec_id", "left")
        .join(reached, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
