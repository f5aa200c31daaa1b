"""Session, recency, history, rank and running-best queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.metric_queries import POP, popularity_scored
from rankloom.catalog.registry import IMP, query, r6, rounded
from rankloom.operators import metrics as M
from rankloom.operators import ranks as K
from rankloom.operators import runs as R
from rankloom.operators import sessions as N
from rankloom.sources.views import impressions

SESS = """lagged AS (
  SELECT *, time_us - lag(time_us) OVER w AS gap, lag(date) OVER w AS prev_date FROM imp
  WINDOW w AS (PARTITION BY split, user_id ORDER BY time_us, row_id)),
flagged AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR prev_date <> date OR gap > 1800000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY split, user_id ORDER BY time_us, row_id) AS sess FROM lagged)"""


def exposures(spark, sf_dir):
    return impressions(spark, sf_dir).select("row_id", "split", "user_id", "video_id", "author_id", "date", "dayord", "time_us",
                                             F.col("tags")[0].alias("tag1"))


@query("gap_prev", "SELECT row_id, round(ln(1 + gap / 1000), 6) + 0.0 AS gap_prev_ms FROM lagged", (IMP, SESS))
def gap_prev(spark, sf_dir):
    """log1p milliseconds since the user's previous impression in the split."""
    return rounded(N.session_features(exposures(spark, sf_dir)).select("row_id", "gap_prev_ms"), "gap_prev_ms")


@query("session_position", """SELECT row_id, row_number() OVER (PARTITION BY split, user_id, sess ORDER BY time_us, row_id) - 1 AS sess_pos
FROM flagged""", (IMP, SESS))
def session_position(spark, sf_dir):
    """Position in the session: broken by user, day or 30 minutes of silence."""
    return N.session_features(exposures(spark, sf_dir)).select("row_id", "sess_pos")


@query("index_in_day", """SELECT row_id, row_number() OVER (PARTITION BY split, user_id, date ORDER BY time_us, row_id) - 1 AS impr_idx_day
FROM imp""", (IMP,))
def index_in_day(spark, sf_dir):
    """Position in the user's day."""
    return N.session_features(exposures(spark, sf_dir)).select("row_id", "impr_idx_day")


SEEN = {"uv_seen_today": "video_id", "ua_seen_today": "author_id", "ut_seen_today": "tag1"}


@query("seen_today", "SELECT row_id, " + ", ".join(
    f"row_number() OVER (PARTITION BY split, user_id, date, {k if k != 'tag1' else 'tags[1]'} ORDER BY time_us, row_id) - 1 AS {o}"
    for o, k in SEEN.items()) + " FROM imp", (IMP,))
def seen_today(spark, sf_dir):
    """How often the user met the item, author and tag earlier that day."""
    return N.session_features(exposures(spark, sf_dir), seen=SEEN).select("row_id", *SEEN)


def days_sql(key: str) -> str:
    return f"""coalesce(r.dayord - (SELECT max(p.dayord) FROM imp p WHERE p.{key} = r.{key} AND p.dayord < r.dayord
      AND (p.split = 'train' OR p.split = r.split)), 99)"""


@query("days_since", f"""SELECT r.row_id, CAST({days_sql('user_id')} AS INTEGER) AS u_days_since,
  CAST({days_sql('video_id')} AS INTEGER) AS v_days_since FROM imp r""", (IMP,))
def days_since(spark, sf_dir):
    """Days since user and item were last seen on a strictly earlier day."""
    rows = exposures(spark, sf_dir)
    train = impressions(spark, sf_dir, ["train"])
    out = N.days_since(rows, train, "user_id", "u_days_since")
    out = N.days_since(out, train, "video_id", "v_days_since")
    return out.select("row_id", "u_days_since", "v_days_since")


@query("asof_strict", """SELECT r.row_id, CAST((SELECT max(p.dayord) FROM imp p WHERE p.author_id = r.author_id AND p.split = 'train'
  AND p.dayord < r.dayord) AS INTEGER) AS last_day FROM imp r WHERE r.split = 'train'""", (IMP,))
def asof_strict(spark, sf_dir):
    """Strict backward as-of join: the latest earlier day of the row's author."""
    train = impressions(spark, sf_dir, ["train"]).select("row_id", "split", "author_id", "dayord")
    return N.last_seen(train, train, "author_id").select("row_id", "last_day")


@query("last_n_history", """SELECT row_id, len(h) AS hist_len, array_to_string(h, ',') AS history FROM (
  SELECT r.row_id, coalesce((list(p.video_id ORDER BY p.time_us DESC, p.row_id DESC) FILTER (p.row_id IS NOT NULL))[1:50], []) AS h
  FROM imp r LEFT JOIN imp p ON p.user_id = r.user_id AND p.split = 'train' AND p.long_view = 1 AND p.time_us < r.time_us
  GROUP BY r.row_id)""", (IMP,))
def last_n_history(spark, sf_dir):
    """The fifty latest earlier positives of the user, newest first."""
    h = N.last_n_history(impressions(spark, sf_dir), impressions(spark, sf_dir, ["train"]), 50)
    return h.select("row_id", F.col("hist_len").cast("long").alias("hist_len"),
                    F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query("time_rank_z", """SELECT row_id, row_number() OVER (PARTITION BY split, user_id ORDER BY time_us, row_id) AS time_rank,
  round((time_us - avg(time_us) OVER w) / coalesce(nullif(stddev_samp(time_us) OVER w, 0), 1), 4) + 0.0 AS time_z FROM imp
WINDOW w AS (PARTITION BY split, user_id)""", (IMP,))
def time_rank_z(spark, sf_dir):
    """Time order in the user's list, and time as a z-score."""
    z = N.time_rank_z(exposures(spark, sf_dir), ["split", "user_id"])
    return z.select("row_id", "time_rank", (F.round("time_z", 4) + 0.0).alias("time_z"))


@query("user_z", """SELECT row_id, round((score - avg(score) OVER w)
  / CASE WHEN coalesce(stddev_samp(score) OVER w, 0) < 1e-8 THEN 1 ELSE stddev_samp(score) OVER w END, 6) + 0.0 AS score_z FROM pop
WINDOW w AS (PARTITION BY split, user_id)""", (IMP, POP))
def user_z(spark, sf_dir):
    """Score standardised inside each list."""
    z = K.zscore(popularity_scored(spark, sf_dir), ["split", "user_id"], "score", "score_z")
    return z.select("row_id", r6("score_z").alias("score_z"))


@query("topk_by_user", """SELECT row_id, position FROM (SELECT row_id, row_number() OVER (PARTITION BY split, user_id
  ORDER BY score DESC, row_id) AS position FROM pop) WHERE position <= 5""", (IMP, POP))
def topk_by_user(spark, sf_dir):
    """Five best rows of each list."""
    return M.top_k(popularity_scored(spark, sf_dir), ["split", "user_id"], "score", ["row_id"], 5).select(
        "row_id", F.col("position").cast("long").alias("position")
    )


SERIES = "series AS (SELECT tab, dayord, avg(long_view) AS value, count(*) AS n FROM imp GROUP BY tab, dayord)"


def daily_series(spark, sf_dir):
    """One metric value per tab and day."""
    return impressions(spark, sf_dir).groupBy("tab", "dayord").agg(F.avg("long_view").alias("value"))


@query("running_best", """SELECT tab, dayord, round(value, 6) + 0.0 AS value, round(b, 6) + 0.0 AS best_before,
  round(value - b, 6) + 0.0 AS delta FROM (SELECT *, max(value) OVER (PARTITION BY tab ORDER BY dayord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM series)""", (IMP, SERIES))
def running_best(spark, sf_dir):
    """Best earlier value of a series and the gain over it."""
    r = R.running_best(daily_series(spark, sf_dir), ["tab"], "dayord", "value")
    return rounded(r, "value", "best_before", "delta").select("tab", "dayord", "value", "best_before", "delta")


@query("convergence", """SELECT tab, dayord, CAST(n AS INTEGER) AS n, coalesce(recent - before <= 0.0005, false) AND n >= greatest(6, 5) AS stop
FROM (SELECT tab, dayord, row_number() OVER w AS n, max(value) OVER (PARTITION BY tab ORDER BY dayord ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent,
  max(value) OVER (PARTITION BY tab ORDER BY dayord ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS before FROM series
  WINDOW w AS (PARTITION BY tab ORDER BY dayord))""", (IMP, SERIES))
def convergence(spark, sf_dir):
    """Windowed stop rule: the last four gain at most 0.0005, after six iterations."""
    c = R.converged(daily_series(spark, sf_dir), ["tab"], "dayord", "value", 0.0005, 4, 6)
    return c.select("tab", "dayord", "n", "stop")


@query("stale_counter", """SELECT tab, dayord, CAST(rn - max(g) OVER (PARTITION BY tab ORDER BY dayord) AS INTEGER) AS stale FROM (
  SELECT tab, dayord, rn, CASE WHEN b IS NULL OR value > b + 0.0005 THEN rn END AS g FROM (
    SELECT *, row_number() OVER (PARTITION BY tab ORDER BY dayord) AS rn, max(value) OVER (PARTITION BY tab ORDER BY dayord
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM series))""", (IMP, SERIES))
def stale_counter(spark, sf_dir):
    """Iterations since the last gain above the threshold."""
    return R.stale_runs(daily_series(spark, sf_dir), ["tab"], "dayord", "value", 0.0005).select("tab", "dayord", "stale")
