import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import ease as Z
from rankloom.operators import itemitem as I


@pytest.fixture(scope="module")
def pairs(spark):
    """User 0 holds every item; the rest hold a few."""
    r = np.random.default_rng(2)
    rows = {(0, i) for i in range(20)} | {(int(u), int(i)) for u, i in zip(r.integers(1, 30, 150), r.integers(0, 20, 150))}
    pdf = pd.DataFrame(sorted(rows), columns=["user_id", "video_id"])
    m = np.zeros((30, 20))
    m[pdf.user_id, pdf.video_id] = 1
    return spark.createDataFrame(pdf), m


def dense(df, n=20, value="w"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["item_i"], r["item_j"]] = r[value]
    return out


@pytest.mark.parametrize("per_slice", [3, 1000])
def test_cooccurrence_is_the_gram_matrix(pairs, per_slice):
    df, m = pairs
    assert (dense(I.cooccurrence(df, items_per_block=per_slice), value="co") == m.T @ m).all()


def test_small_pair_batches(pairs, monkeypatch):
    df, m = pairs
    plain = df.toPandas().rename(columns={"user_id": "user", "video_id": "item"}).assign(cell=0, is_left=True, two_blocks=False)
    monkeypatch.setattr(I, "PAIR_BATCH", 7)
    parts = [plain.iloc[i:i + 11] for i in range(0, len(plain), 11)]
    got = pd.concat(list(I._combine_pairs(iter(parts)))).groupby(["item_i", "item_j"])["co"].sum()
    g = m.T @ m
    assert all(g[i, j] == c for (i, j), c in got.items())
    assert len(got) == (np.triu(g) > 0).sum()


def test_cosine(pairs):
    df, m = pairs
    n = np.sqrt(m.sum(0))
    assert np.allclose(dense(I.cosine(df)), m.T @ m / np.outer(n, n))


@pytest.mark.parametrize("block", [7, 64])
def test_block_inverse(pairs, block):
    df, m = pairs
    want = np.linalg.inv(m.T @ m + 5 * np.eye(20))
    assert np.allclose(dense(Z.inverse_gram(df, 5.0, block=block), value="p"), want, atol=1e-12)


def test_ease_weights_and_score(spark, pairs):
    df, m = pairs
    p = np.linalg.inv(m.T @ m + 5 * np.eye(20))
    b = -p / np.diag(p)[None, :]
    np.fill_diagonal(b, 0)
    w = Z.ease_weights(df, 5.0, block=8)
    assert np.allclose(dense(w), b.T)
    rows = spark.createDataFrame([(1, 3, 4, 0), (2, 0, 7, 0), (3, 99, 4, 0)], "row_id int, user_id bigint, video_id bigint, y int")
    got = {r["row_id"]: (r["cf_sum"], r["u_hist_cnt"]) for r in I.history_score(rows, df, w).collect()}
    for rid, u, v in ((1, 3, 4), (2, 0, 7)):
        assert got[rid][0] == pytest.approx((b[:, v] * m[u]).sum())
        assert got[rid][1] == m[u].sum()
    assert got[3] == (0.0, 0)


def test_long_lists_are_scored_alike(spark, pairs):
    df, m = pairs
    rows = spark.createDataFrame([(u * 100 + v, u, v) for u in (0, 1, 40) for v in range(0, 22, 2 + u % 2)], "row_id int, user_id bigint, video_id bigint")
    sim = I.cosine(df)
    a = {r["row_id"]: r["cf_sum"] for r in I.history_score(rows, df, sim, product=8).collect()}
    b = {r["row_id"]: r["cf_sum"] for r in I.history_score(rows, df, sim).collect()}
    assert a == pytest.approx(b) and len(a) == rows.count()


def test_leave_user_out_equals_removing_the_user(spark, pairs):
    df, m = pairs
    u = 5
    v = int(np.flatnonzero(m[u])[0])
    rows = spark.createDataFrame([(1, u, v, 1), (2, u, v, 0)], "row_id int, user_id bigint, video_id bigint, y int")
    got = {r["row_id"]: r["cf_sum"] for r in I.leave_user_out(I.history_score(rows, df, I.cosine(df)), df, "y").collect()}
    n = np.sqrt(m.sum(0))
    without = np.delete(m, u, 0)
    co = without.T @ without / np.outer(n, n)
    hist = [w for w in np.flatnonzero(m[u]) if w != v]
    assert got[1] == pytest.approx(co[v, hist].sum())
    full = m.T @ m / np.outer(n, n)
    assert got[2] == pytest.approx(full[v, np.flatnonzero(m[u])].sum())


def test_two_phase_cut_is_the_middle_day_not_the_median_row(spark):
    days = [1] * 50 + [2, 3, 4]
    df = spark.createDataFrame(pd.DataFrame({"date": days}))
    assert df.select(I.middle_day(df).alias("c")).first()["c"] == 3


def test_two_phase_scores_early_rows_zero(spark):
    rows = spark.createDataFrame(pd.DataFrame({
        "row_id": range(6), "split": ["train"] * 4 + ["valid"] * 2, "user_id": [1, 1, 1, 2, 1, 2],
        "video_id": [1, 2, 1, 2, 2, 1], "date": [1, 1, 2, 2, 3, 3], "long_view": 1,
    }))
    got = {r["row_id"]: r["cf_sum"] for r in I.two_phase_score(rows, rows.where("split = 'train'"), "long_view", I.cosine).collect()}
    assert got[0] == got[1] == 0.0
    assert got[2] == pytest.approx(2.0)
    assert got[3] == 0.0
    assert got[4] > 1.0


def test_solved_columns_are_those_of_the_inverse(spark, pairs):
    """Conjugate gradients for some columns, more than one group of them, against numpy."""
    df, m = pairs
    g = (m.T @ m).astype(float)
    want = np.linalg.inv(g + 5.0 * np.eye(len(g)))
    some = [i for i in range(len(g)) if i % 3 != 1 and g[i, i] > 0]
    columns = spark.createDataFrame([(i,) for i in some], "item long")
    got = Z.solve_columns(I.cooccurrence(df), 5.0, columns, width=4).collect()
    assert {r["item_j"] for r in got} == set(some)
    p = np.zeros_like(want)
    for r in got:
        p[r["item_i"], r["item_j"]] = r["p"]
    assert np.abs(p[:, some] - want[:, some])[g.diagonal() > 0].max() < 1e-8


def test_both_ways_to_the_weights_agree(pairs):
    df, _ = pairs
    few = df.where("video_id % 2 = 0")
    dense_way = {(r["item_i"], r["item_j"]): r["w"] for r in Z.ease_weights(df, 5.0).collect()}
    sets = Z.ease_weight_sets(df, {"a": 5.0, "b": 50.0}, candidates=few, dense_items=0)
    solved = {(r["item_i"], r["item_j"]): r["w"] for r in sets["a"].collect()}
    assert solved and {i for i, _ in solved} == {i for i, _ in dense_way if i % 2 == 0}
    for k, w in dense_way.items():
        if k[0] % 2 == 0:
            assert abs(solved.get(k, 0.0) - w) < 1e-6
    assert sets["b"].count() > 0


def test_ease_queries_equal_numpy(spark):
    """Both ridge queries over whole tables against dense algebra: two phases, three strengths, two labels."""
    import __spark_entry__ as entry
    from rankloom.sources.views import impressions

    sf = "/root/testdata/sf0.001"
    imp = impressions(spark, sf).select("row_id", "split", "user_id", "video_id", "date", "long_view", "is_click").toPandas()
    train = imp[imp.split == "train"]
    days = sorted(train.date.unique())
    cut = days[len(days) // 2]

    def score(rows, pool, label, lam):
        """(sum, mean) per row of the weights of the user's positives for the row's item."""
        pos = pool[pool[label] == 1][["user_id", "video_id"]].drop_duplicates()
        items = {v: i for i, v in enumerate(sorted(pos.video_id.unique()))}
        users = {u: i for i, u in enumerate(pos.user_id.unique())}
        x = np.zeros((len(users), len(items)))
        x[pos.user_id.map(users), pos.video_id.map(items)] = 1
        p = np.linalg.inv(x.T @ x + lam * np.eye(len(items)))
        b = -p / np.diag(p)
        np.fill_diagonal(b, 0)
        out = {}
        for r in rows.itertuples():
            h = x[users[r.user_id]] if r.user_id in users else np.zeros(len(items))
            s = float(h @ b[:, items[r.video_id]]) if r.video_id in items else 0.0
            out[r.row_id] = (s, s / max(1.0, h.sum()))
        return out

    def two_phase(label, lam):
        late = train[train.date >= cut]
        zero = {i: (0.0, 0.0) for i in train[train.date < cut].row_id}
        return zero | score(late, train[train.date < cut], label, lam) | score(imp[imp.split != "train"], train, label, lam)

    want = two_phase("long_view", 250.0)
    got = {r["row_id"]: (r["ease_sum"], r["ease_mean"]) for r in entry.queries()["ease_score"](spark, sf).collect()}
    assert set(got) == set(want) and max(abs(a - b) for i in want for a, b in zip(got[i], want[i])) < 2e-6
    kinds = {"ease50_mean": ("long_view", 50.0), "ease1000_mean": ("long_view", 1000.0), "easeclk_mean": ("is_click", 250.0)}
    all_of_them = entry.queries()["ease_variants"](spark, sf).collect()
    for name, (label, lam) in kinds.items():
        want = two_phase(label, lam)
        got = {r["row_id"]: r["score"] for r in all_of_them if r["variant"] == name}
        assert set(got) == set(want) and max(abs(got[i] - want[i][1]) for i in want) < 2e-6
