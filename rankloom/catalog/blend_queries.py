"""Rank-space blends, searches, bootstrap and single-feature power."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.metric_queries import PROTOCOL, click_sql, pieces_cte, protocol_sql, rounded_protocol
from rankloom.catalog.registry import IMP, query, r6, rounded
from rankloom.operators import blend as B
from rankloom.operators import bootstrap as T
from rankloom.operators import metrics as M
from rankloom.operators import stats as S
from rankloom.operators.ordering import Prefix, ordered_prefix
from rankloom.sources.views import impressions

MODELS = {"item": "video_id", "author": "author_id", "tab": "tab"}


def model_sql(m: str, key: str) -> str:
    return f"""SELECT '{m}' AS model, i.split, i.user_id, i.row_id, i.long_view, i.is_click, i.time_us,
  coalesce((s + 20.0 * g) / (c + 20.0), g) AS score
  FROM imp i LEFT JOIN (SELECT {key}, sum(long_view) AS s, count(*) AS c FROM imp WHERE split = 'train' GROUP BY {key}) p USING ({key}),
       (SELECT avg(long_view) AS g FROM imp WHERE split = 'train') WHERE i.split <> 'train'"""


SCORES = "scores AS (" + " UNION ALL ".join(model_sql(m, k) for m, k in MODELS.items()) + ")"
RANKED = """ranked AS (SELECT *, (row_number() OVER (PARTITION BY model, split ORDER BY score, row_id) - 1)
  / greatest(count(*) OVER (PARTITION BY model, split) - 1, 1) AS rank01 FROM scores)"""
WITHIN = RANKED.replace("ranked AS", "within AS").replace("PARTITION BY model, split", "PARTITION BY model, split, user_id")


def model_scores(spark, sf_dir, splits=("valid", "test")):
    """Popularity by item, author and tab as three models in long form."""
    train = impressions(spark, sf_dir, ["train"])
    rows = impressions(spark, sf_dir, list(splits))
    out = None
    for m, key in MODELS.items():
        s = S.score_popularity(rows, train, key, "long_view").select(
            F.lit(m).alias("model"), "split", "user_id", "row_id", "long_view", "is_click", "time_us", "score"
        )
        out = s if out is None else out.unionByName(s)
    return out


def wide_scores(spark, sf_dir, splits=("valid",)):
    """The same three scores as columns of one row."""
    train = impressions(spark, sf_dir, ["train"])
    rows = impressions(spark, sf_dir, list(splits))
    for m, key in MODELS.items():
        rows = S.score_popularity(rows, train, key, "long_view", m)
    return rows


@query("global_rank01", "SELECT model, row_id, round(rank01, 6) + 0.0 AS rank01 FROM ranked", (IMP, SCORES, RANKED))
def global_rank01(spark, sf_dir):
    """Rank over a whole split scaled to [0, 1]."""
    return B.ranked_models(model_scores(spark, sf_dir)).select("model", "row_id", r6("rank01").alias("rank01"))


@query("rank_within_user", "SELECT model, row_id, round(rank01, 6) + 0.0 AS rank01 FROM within", (IMP, SCORES, WITHIN))
def rank_within_user(spark, sf_dir):
    """Rank inside the user's list scaled to [0, 1]."""
    return B.ranked_models(model_scores(spark, sf_dir), within_user=True).select("model", "row_id", r6("rank01").alias("rank01"))


@query("rank_average", "SELECT row_id, round(avg(rank01), 6) + 0.0 AS score FROM ranked GROUP BY row_id", (IMP, SCORES, RANKED))
def rank_average(spark, sf_dir):
    """Equal-weight mean of the models' ranks."""
    return rounded(B.rank_average(B.ranked_models(model_scores(spark, sf_dir)), ["row_id"]), "score")


# Weights of the final blend.
FINAL_WEIGHTS = {"item": 0.8, "author": 0.2}
BLENDED = """blended AS (SELECT split, user_id, row_id, long_view, sum(CASE model WHEN 'item' THEN 0.8 ELSE 0.2 END * rank01) / 1.0 AS score
  FROM ranked WHERE model IN ('item', 'author') GROUP BY split, user_id, row_id, long_view)"""


@query("final_blend", protocol_sql("split", "pieces"),
       (IMP, SCORES, RANKED, BLENDED, pieces_cte("pieces", "blended", "split, user_id", "row_id")))
def final_blend(spark, sf_dir):
    """Recipe fixed on validation, applied to both splits with the same transform."""
    ranks = B.ranked_models(model_scores(spark, sf_dir))
    mix = B.rank_blend(ranks, ["split", "user_id", "row_id", "long_view"], FINAL_WEIGHTS)
    return rounded_protocol(M.evaluate(mix, ["split"], "user_id", "long_view", "score", ["row_id"]))


@query("model_leaderboard", protocol_sql("split, model", "pieces"),
       (IMP, SCORES, pieces_cte("pieces", "scores", "split, model, user_id", "row_id")))
def model_leaderboard(spark, sf_dir):
    """Protocol of every single model."""
    return rounded_protocol(
        B.leaderboard(model_scores(spark, sf_dir), "user_id", "long_view", "score", ["row_id"], ("split", "model"))
    )


WIDE = """wide AS (SELECT split, user_id, row_id, is_click, time_us, max(CASE WHEN model = 'item' THEN score END) AS item,
    max(CASE WHEN model = 'author' THEN score END) AS author FROM scores WHERE split = 'valid' GROUP BY ALL),
z AS (SELECT *, (item - avg(item) OVER u) / CASE WHEN coalesce(stddev_samp(item) OVER u, 0) < 1e-8 THEN 1 ELSE stddev_samp(item) OVER u END AS zi,
    (author - avg(author) OVER u) / CASE WHEN coalesce(stddev_samp(author) OVER u, 0) < 1e-8 THEN 1 ELSE stddev_samp(author) OVER u END AS za,
    row_number() OVER (PARTITION BY user_id ORDER BY time_us, row_id) AS tr FROM wide WINDOW u AS (PARTITION BY user_id)),
zt AS (SELECT *, (tr - avg(tr) OVER u) / CASE WHEN coalesce(stddev_samp(tr) OVER u, 0) < 1e-8 THEN 1 ELSE stddev_samp(tr) OVER u END AS zt
    FROM z WINDOW u AS (PARTITION BY user_id))"""
SWEEP = """sweep AS (
  SELECT 'valid' AS part, mode, w, user_id, row_id, is_click, CASE WHEN mode = 'user_z' THEN w * zi + (1 - w) * za ELSE w * item + (1 - w) * author END AS score
  FROM z, (SELECT unnest(['user_z', 'raw']) AS mode), (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS w)
  UNION ALL SELECT 'valid', 'item_only', 1.0, user_id, row_id, is_click, 1.0 * item + (1 - 1.0) * author FROM z
  UNION ALL SELECT 'valid', 'author_only', 0.0, user_id, row_id, is_click, 0.0 * item + (1 - 0.0) * author FROM z)"""


@query("blend_sweep", click_sql("mode, w", "sweep", "row_id", "is_click"), (IMP, SCORES, WIDE, SWEEP))
def blend_sweep(spark, sf_dir):
    """Click metrics over blend weights on raw and per-user z scores."""
    v = wide_scores(spark, sf_dir)
    m = B.weight_sweep(v, ["split"], "user_id", "is_click", "item", "author", ["row_id"],
                       probe=impressions(spark, sf_dir, ["valid"])).drop("split")
    return rounded(m, "ndcg_at_10", "ndcg_at_5", "recall_at_50", "score")


GRID = """grid AS (SELECT a / 10.0 AS time_coef, b / 20.0 AS pop_coef FROM (SELECT unnest(range(-5, 6)) AS a), (SELECT unnest(range(-4, 5)) AS b)),
points AS (SELECT time_coef, pop_coef, user_id, row_id, is_click, zi + time_coef * zt + pop_coef * za AS score FROM zt, grid)"""


@query("rerank_grid", click_sql("time_coef, pop_coef", "points", "row_id", "is_click"), (IMP, SCORES, WIDE, GRID))
def rerank_grid(spark, sf_dir):
    """Click metrics over 11 x 9 re-rank coefficients."""
    v = ordered_prefix(wide_scores(spark, sf_dir), ["split", "user_id"], "time_us", ["row_id"], Prefix(number="time_rank"),
                       probe=impressions(spark, sf_dir, ["valid"]))
    m = B.rerank_grid(v, ["split"], "user_id", "is_click", "item", "author", "time_rank", ["row_id"],
                      probe=impressions(spark, sf_dir, ["valid"])).drop("split")
    return rounded(m, "ndcg_at_10", "ndcg_at_5", "recall_at_50", "score")


@query("rerank_best", "SELECT time_coef, pop_coef, ndcg_at_10, recall_at_50 FROM ("
       + click_sql("time_coef, pop_coef", "points", "row_id", "is_click") + ") ORDER BY ndcg_at_10 DESC, time_coef, pop_coef LIMIT 1",
       (IMP, SCORES, WIDE, GRID))
def rerank_best(spark, sf_dir):
    """Coefficients with the best nDCG@10, the first in grid order on ties."""
    best = B.best_point(rerank_grid(spark, sf_dir), [], "ndcg_at_10", ["time_coef", "pop_coef"])
    return best.select("time_coef", "pop_coef", "ndcg_at_10", "recall_at_50")


@query("greedy_blend")
def greedy_blend(spark, sf_dir):
    """Greedy forward selection on validation ranks, then the mix's protocol."""
    ranks = B.ranked_models(model_scores(spark, sf_dir, ("valid",)))
    wide = ranks.groupBy("user_id", "row_id", "long_view").pivot("model", list(MODELS)).agg(F.max("rank01"))
    mix, _, scored = B.greedy_blend(wide, list(MODELS), "user_id", "long_view")
    text = ", ".join(f"{m}={w:.4f}" for m, w in sorted(mix.items()))
    scored = scored.withColumn("weights", F.lit(text))
    return rounded_protocol(M.evaluate(scored, ["weights"], "user_id", "long_view", "score", ["row_id"]))


PAIR = "pair AS (SELECT split, CASE model WHEN 'tab' THEN 'a' ELSE 'b' END AS system, user_id, row_id, long_view, score FROM scores WHERE model IN ('tab', 'item'))"
BOOT = """users AS (SELECT split, user_id, row_number() OVER (PARTITION BY split ORDER BY user_id) AS no, count(*) OVER (PARTITION BY split) AS n
  FROM pieces WHERE system = 'a'),
blocks AS (SELECT split, rep, CAST(floor(floor(CAST(('0x' || substr(md5(rep || ':' || (no - 1)), 1, 8)) AS BIGINT) / 4294967296.0 * n) / 64) AS BIGINT) AS b,
    count(*) AS c, any_value(n) AS n FROM users, (SELECT unnest(range(0, 2000)) AS rep) GROUP BY 1, 2, 3),
draws AS (SELECT split, rep, b * 64 + 1 + CAST(floor(CAST(('0x' || substr(md5(rep || ':' || b || ':' || j), 1, 8)) AS BIGINT) / 4294967296.0
    * least(64, n - b * 64)) AS BIGINT) AS no FROM (SELECT *, unnest(range(0, c)) AS j FROM blocks)),
rep_metrics AS (SELECT split, rep, system, """ + PROTOCOL + """ AS gauc, avg(ndcg) AS ndcg
  FROM draws JOIN users USING (split, no) JOIN pieces USING (split, user_id) GROUP BY split, rep, system),
deltas AS (SELECT split, rep, metric, sum(CASE system WHEN 'b' THEN v ELSE -v END) AS delta FROM (
  SELECT split, rep, system, unnest(['gauc', 'ndcg_at_5', 'primary_score']) AS metric, unnest([gauc, ndcg, (gauc + ndcg) / 2]) AS v FROM rep_metrics)
  GROUP BY split, rep, metric)"""


@query("bootstrap_paired", """SELECT split, metric, round(avg(delta), 6) + 0.0 AS mean, round(quantile_cont(delta, 0.025), 6) + 0.0 AS lo95,
  round(quantile_cont(delta, 0.975), 6) + 0.0 AS hi95, round(avg(CAST(delta <= 1e-12 AS INTEGER)), 6) + 0.0 AS p_le_0, count(*) AS reps
FROM deltas GROUP BY split, metric""", (IMP, SCORES, PAIR, pieces_cte("pieces", "pair", "split, system, user_id", "row_id"), BOOT))
def bootstrap_paired(spark, sf_dir):
    """Item against tab popularity on 2000 paired resamples of the users."""
    s = model_scores(spark, sf_dir).where("model IN ('tab', 'item')").withColumn(
        "system", F.when(F.col("model") == "tab", "a").otherwise("b")
    )
    pieces = M.user_pieces(s, ["split", "system", "user_id"], "long_view", "score", ["row_id"])
    deltas = T.paired_deltas(T.paired_resamples(pieces, ["split"], "user_id", 2000, block=64), ["split"])
    return rounded(T.summarise(deltas, ["split"]), "mean", "lo95", "hi95", "p_le_0")


FEATURES = """feats AS (
  SELECT i.split, i.user_id, i.row_id, i.long_view, unnest(['duration_ms', 'hour', 'user_rows', 'item_rows']) AS feature,
         unnest([CAST(duration_ms AS DOUBLE), CAST(hour AS DOUBLE), CAST(coalesce(u, 0) AS DOUBLE), CAST(coalesce(v, 0) AS DOUBLE)]) AS score
  FROM imp i LEFT JOIN (SELECT user_id, count(*) AS u FROM imp WHERE split = 'train' GROUP BY user_id) USING (user_id)
    LEFT JOIN (SELECT video_id, count(*) AS v FROM imp WHERE split = 'train' GROUP BY video_id) USING (video_id)
  WHERE i.split <> 'train')"""


@query("single_feature_power", protocol_sql("split, feature", "pieces"),
       (IMP, FEATURES, pieces_cte("pieces", "feats", "split, feature, user_id", "row_id")))
def single_feature_power(spark, sf_dir):
    """Lists ranked by one feature at a time; a feature constant per user sits at 0.5."""
    train = impressions(spark, sf_dir, ["train"])
    rows = impressions(spark, sf_dir, ["valid", "test"])
    rows = S.attach_counts(rows, train, ["user_id"], {}, "past", "user_rows")
    rows = S.attach_counts(rows, train, ["video_id"], {}, "past", "item_rows")
    names = ["duration_ms", "hour", "user_rows", "item_rows"]
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    long = rows.select("split", "user_id", "row_id", "long_view", F.explode(pairs).alias("feature", "score"))
    return rounded_protocol(M.evaluate(long, ["split", "feature"], "user_id", "long_view", "score", ["row_id"]))
