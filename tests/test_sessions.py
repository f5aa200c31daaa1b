import numpy as np
import pandas as pd

from rankloom.operators import sessions as N
from rankloom.operators.ordering import Skew

SMALL = Skew(rows_per_task=15)
SEEN = {"uv": "video_id", "ut": "tag1"}


def stream(spark, seed=0, n=400):
    """One user owns 60 % of a stream with many equal timestamps."""
    r = np.random.default_rng(seed)
    t = r.integers(0, 60, n) * 7 * 60 * 1_000_000
    pdf = pd.DataFrame({
        "row_id": range(n), "split": np.where(r.random(n) < 0.7, "train", "valid"),
        "user_id": np.where(r.random(n) < 0.6, 1, r.integers(2, 9, n)), "video_id": r.integers(0, 5, n),
        "tag1": r.integers(0, 3, n), "time_us": t, "date": (t // (150 * 60 * 1_000_000)).astype(int),
        "long_view": r.integers(0, 2, n),
    })
    return spark.createDataFrame(pdf), pdf


def collect(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).toPandas().fillna(-1).round(9).itertuples(index=False)))


def test_heavy_user_sessions_equal_plain_windows(spark):
    df, _ = stream(spark)
    a = N.session_features(df, seen=SEEN, skew=SMALL)
    b = N.session_features(df, seen=SEEN)
    assert collect(a) == collect(b)


def test_sessions_by_hand(spark):
    minute = 60 * 1_000_000
    rows = [(0, 0), (1, 10), (2, 45), (3, 50), (4, 200)]
    pdf = pd.DataFrame([{"row_id": i, "split": "train", "user_id": 1, "time_us": m * minute, "date": int(m >= 48)} for i, m in rows])
    got = N.session_features(spark.createDataFrame(pdf)).orderBy("row_id").collect()
    # 35 minutes of silence, then a day change, then a long silence on the same day
    assert [r["sess_pos"] for r in got] == [0, 1, 0, 0, 0]
    assert [r["impr_idx_day"] for r in got] == [0, 1, 2, 0, 1]
    assert got[0]["gap_prev_ms"] is None and abs(got[1]["gap_prev_ms"] - np.log1p(600_000)) < 1e-9


def test_last_n_history_brute_force(spark):
    df, pdf = stream(spark, 4)
    pool = pdf[(pdf.split == "train") & (pdf.long_view == 1)]
    for skew in (SMALL, Skew()):
        got = {r["row_id"]: list(r["history"]) for r in N.last_n_history(df, df.where("split = 'train'"), 4, skew=skew).collect()}
        for r in pdf.itertuples():
            h = pool[(pool.user_id == r.user_id) & (pool.time_us < r.time_us)].sort_values(["time_us", "row_id"])
            assert got[r.row_id] == h.video_id.to_list()[-4:][::-1]


def test_days_since(spark):
    pdf = pd.DataFrame({"row_id": range(5), "k": 1, "dayord": [0, 0, 2, 5, 6], "split": ["train", "train", "train", "valid", "valid"]})
    df = spark.createDataFrame(pdf)
    got = N.days_since(df, df.where("split = 'train'"), "k", "gap").orderBy("row_id").collect()
    assert [r["gap"] for r in got] == [99, 99, 2, 3, 1]


def test_last_seen_has_no_horizon(spark):
    from rankloom.operators.sessions import last_seen

    log = spark.createDataFrame([(1, 0), (1, 150), (1, 150), (2, 400), (None, 3), (None, 9)], "author_id int, dayord int")
    got = sorted(((r["author_id"], r["dayord"], r["last_day"]) for r in last_seen(log, log, "author_id").collect()), key=str)
    assert got == sorted([(1, 0, None), (1, 150, 0), (1, 150, 0), (2, 400, None), (None, 3, None), (None, 9, None)], key=str)
