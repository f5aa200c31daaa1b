"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from rankloom.llm import vectors


def brute(rows, least=0.98):
    def unit(e, label):
        if e is None or label is None or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            return None
        x = np.array(e, dtype=float)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(e, label) if i is not None else None for i, e, label in rows]
    n = len(rows)
    link = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]):
                link[a, b] = link[b, a] = units[a] @ units[b] >= least
    root = list(range(n))
    changed = True
    while changed:
        new = [min([root[a], *(root[b] for b in range(n) if link[a, b])]) for a in range(n)]
        changed, root = new != root, new
    out = []
    for a, (i, _, _) in enumerate(rows):
        c = min(rows[b][0] for b in range(n) if root[b] == root[a]) if i is not None else None
        out.append((i, int(link[a].sum()), c, i is None or i == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 4])
def test_links_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(5)
    rows, k = [], 0
    for label in (1, 2, -3):
        for size in (1, 1, 2, 25):
            base = r.standard_normal(16)
            for _ in range(size):
                rows.append((k := k + 1, (base + 0.08 * r.standard_normal(16)).tolist(), label))
    rows += [(100, rows[5][1], rows[5][2]), (101, rows[5][1], rows[5][2]), (102, [2 * v for v in rows[5][1]], rows[5][2]), (103, rows[5][1], None), (104, rows[5][1], 2)]
    rows += [(105, None, 1), (106, [], 1), (107, [0.0] * 16, 1), (108, [None] + [1.0] * 15, 1), (109, [float("nan")] + [1.0] * 15, 1), (110, [float("inf")] + [1.0] * 15, 1), (111, [1.0, 2.0], 1), (112, [1.0, 2.01], 1)]
    rows += [(113, [1e30, 1e30], 1), (114, [1e-30, 1e-30], 1), (None, rows[5][1], rows[5][2]), (5, rows[4][1], rows[4][2]), (7, [3.0, -1.0, 5.0], 9)]
    df = spark.createDataFrame([(i, e, label, 0) for i, e, label in rows], "vec_id long, embedding array<double>, label int, rep int").repartition(3)
    got = sorted((tuple(x[c] for c in ("vec_id", "n_links", "component_id", "kept")) for x in vectors.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_recall_at_the_threshold():
    """Pairs of cosine 0.98 exactly share a bucket."""
    r = np.random.default_rng(1)
    a = r.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.standard_normal(a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * z
    x, y = vectors.buckets(a), vectors.buckets(b)
    met = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean()
    assert met >= 0.999


def test_transform_is_orthonormal():
    x = vectors.hadamard(np.eye(8))
    assert np.allclose(x @ x.T, np.eye(8)) and np.allclose(np.abs(x), 8**-0.5)


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
