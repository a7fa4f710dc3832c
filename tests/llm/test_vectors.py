"""Operators on vectors against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from ratelantern.llm import multi_index, permutation_index
from ratelantern.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((600, 32))
    rows[100:160] = rows[100] + 0.1 * rng.standard_normal((60, 32))
    made = [(i, [float(x) for x in v], i % 3, 1.0, 1) for i, v in enumerate(rows)]
    odd = [(700, None, 0, None, None), (701, [0.0] * 32, 0, None, None), (702, [float("nan")] * 32, 0, None, None), (703, [None] * 32, 0, None, None), (None, made[0][1], 0, None, None), (704, made[0][1], None, None, None)]
    return spark.createDataFrame([*made, made[5], *odd], SCHEMA), rows


def test_nearest(table):
    df, rows = table
    normed = rows.astype(np.float32).astype(float)
    normed /= np.linalg.norm(normed, axis=1, keepdims=True)
    found = permutation_index.nearest(df, df.where("vec_id % 50 = 0"), 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, ids in got.items():
        s = normed @ normed[q]
        s[q] = -2
        hits += len({int(i) for i in np.argsort(-s)[:5]} & set(ids) | ({704} & set(ids)))
    assert hits >= 0.9 * 5 * len(got)


def test_links(table):
    df, rows = table
    normed = rows.astype(np.float32).astype(float)
    normed /= np.linalg.norm(normed, axis=1, keepdims=True)
    label = np.arange(600) % 3
    links = (normed @ normed.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(600, dtype=bool)
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(600)] == links.sum(1).tolist()
    assert all(got[i].component_id == min([i, *np.nonzero(links[i])[0].tolist()]) for i in range(100))
    assert all(got[i].n_links == 0 and got[i].kept for i in (700, 701, 702, 703, 704, None))
    assert df.count() == multi_index.near_duplicates(df).count()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert permutation_index.nearest(none, none).count() == 0
    assert multi_index.near_duplicates(none).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_placing_is_bounded_in_memory():
    """Rows handed on and numbers held at once do not grow with the batch; the rows are those of all visits at once."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((4000, 16))
    turned = multi_index.unit(rows) @ multi_index.rotation(16)
    books = (multi_index.codebook(turned[:2000, :8], 128), multi_index.codebook(turned[:2000, 8:], 128))
    part = pd.DataFrame({"vec_id": np.arange(4000), "vector": list(rows)})
    tracemalloc.start()
    most, seen = 0, []
    for made in multi_index.placed_rows(part, books, 0.03):
        most = max(most, len(made))
        seen.append(made[["vec_id", "cell", "member"]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own, row, cell = multi_index.visits(turned, books, 0.03)
    got = pd.concat(seen)
    assert most <= multi_index.VISITS_AT_ONCE < len(row)
    assert peak < 200 << 20
    assert (got[got.member].cell.to_numpy() == own).all()
    visits = got[~got.member]
    assert sorted(zip(visits.vec_id, visits.cell)) == sorted(zip(row, cell))
