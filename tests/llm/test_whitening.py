import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from gapwright.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def usable(vector, d):
    return vector is not None and len(vector) == d and all(c is not None and math.isfinite(c) for c in vector)


def plain(rows, components=8):
    """rows: (id, vector) -> per id and component: n, deviation, |whitened|, explained"""
    lengths = Counter(len(v) for _, v in rows if v is not None and usable(v, len(v)))
    d = max(lengths, key=lambda k: (lengths[k], k), default=0)
    held = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if usable(v, d)]
    n, sums = len(held), [sum(x[k] for _, x in held) for k in range(d)]
    off = np.array([[n * c - s for c, s in zip(x, sums)] for _, x in held], float).reshape(n, d) / max(n, 1)
    _, roots, axes = np.linalg.svd(off, full_matrices=False)
    out = []
    for k in range(min(components, len(roots))):
        if roots[k] <= 1e-10 * roots[0]:
            break
        places = off @ axes[k] / (roots[k] / n**0.5)
        for (i, x), place in zip(held, places):
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            out.append((i, k + 1, n, deviation, place, float(roots[k] ** 2 / (roots**2).sum())))
    return out


def agree(found, want, tight=1e-7):
    """Same rows, and whitened the same up to one sign per component."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert [(r[0], r[1], r[2], r[3]) for r in found] == [(w[0], w[1], w[2], w[3] if w[3] < 2**63 else None) for w in want]
    by = defaultdict(list)
    for r, w in zip(found, want):
        assert abs(r[5] - w[5]) <= 1e-6 * w[5] and r[6] <= 1e-4
        by[r[1]].append((r[4], w[4]))
    for pairs in by.values():
        a, b = np.array(pairs).T
        sign = np.sign(a @ b)
        assert np.abs(a - sign * b).max() < tight * max(1, np.abs(b).max())


def collected(df):
    return [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in df.collect()]


def vectors(seed, n, scales):
    r = np.random.default_rng(seed)
    turn = np.linalg.qr(r.normal(size=(len(scales), len(scales))))[0]
    return (r.normal(size=(n, len(scales))) * np.array(scales) @ turn).tolist()


def test_messy_table(spark):
    good = vectors(1, 400, [2.0**-k for k in range(12)])
    rows = list(enumerate(good)) + [
        (None, good[3]), (7, good[3]), (7, good[3]), (500, None), (501, [1.0, None] + good[0][2:]), (502, [float("nan")] + good[0][1:]),
        (503, [float("-inf")] + good[0][1:]), (504, []), (505, [1.0]), (506, good[0] + [0.5]),
    ]
    df = spark.createDataFrame([(i, v, "own", 3) for i, v in rows], "vec_id long, embedding array<double>, component string, extra int").repartition(5)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "extra", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(collected(out), plain(rows))


def test_badly_scaled_and_dependent_dimensions(spark):
    good = vectors(2, 300, [4.0**-k * 3000 for k in range(7)])
    # constant ones, one that is the sum of two others, and entries far from the origin
    rows = [(i, [*v, 5.0, float(math.floor(v[0]) + math.floor(v[1])), float(math.floor(v[0])), float(math.floor(v[1])), 1e6 + v[2]]) for i, v in enumerate(good)]
    found = collected(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)))
    assert {r[1] for r in found} == set(range(1, 9))
    agree(found, plain(rows), 1e-5)


def test_factor_is_found_in_few_passes(spark):
    rows = spark.createDataFrame(list(enumerate(vectors(3, 500, [1e4, 1e2, 1.0, 0.1]))), "vec_id long, embedding array<double>")
    found = whitening.fit(rows, "embedding", 4)
    assert 2 <= found.passes <= 5
    x = np.floor(1024 * np.array([r.embedding for r in rows.collect()]))
    want = np.linalg.svd(x - x.mean(axis=0))[1] ** 2 / len(x)
    assert np.allclose(found.values, want, rtol=1e-9)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [c * 1e9, c, -c]) for i, c in enumerate([0.5, 1.25, 3.0, 1e3, -7.75])]
    found = collected(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    agree(found, plain(rows), 1e-5)
    beyond = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])]
    found = collected(whitening.whiten(spark.createDataFrame(beyond, "vec_id long, embedding array<double>")))
    assert {(r[0], r[3] is None) for r in found} == {(1, True), (2, True), (3, False)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])] * 3])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    agree(collected(queries.QUERIES["op11_whitening"](spark, FOLDER)), plain(rows))
