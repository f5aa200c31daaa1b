"""Ranking-evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import IMP, ORD, query, r6, rounded
from rankloom.functions.hashing import uniform
from rankloom.operators import metrics as M
from rankloom.operators import stats as S
from rankloom.sources.views import ORDER_TIES, impressions, order_impressions

POP = """pop AS (
  SELECT i.row_id, i.split, i.user_id, i.video_id, i.tab, i.time_us, i.long_view, i.is_click,
         coalesce((p.s + 20.0 * g.m) / (p.c + 20.0), g.m) AS score
  FROM imp i LEFT JOIN (SELECT video_id, sum(long_view) AS s, count(*) AS c FROM imp WHERE split = 'train'
                        GROUP BY video_id) p USING (video_id)
       CROSS JOIN (SELECT avg(long_view) AS m FROM imp WHERE split = 'train') g
  WHERE i.split <> 'train')"""

ORD_POP = """scored AS (
  SELECT i.*, coalesce((p.s + 20.0 * g.m) / (p.c + 20.0), g.m) AS score
  FROM ord_imp i LEFT JOIN (SELECT video_id, sum(long_view) AS s, count(*) AS c FROM ord_imp WHERE split = 'train'
                            GROUP BY video_id) p USING (video_id)
       CROSS JOIN (SELECT avg(long_view) AS m FROM ord_imp WHERE split = 'train') g
  WHERE i.split <> 'train')"""


def pieces_cte(name: str, source: str, keys: str, ties: str, label: str = "long_view", score: str = "score") -> str:
    """Per-list pieces by plain windows."""
    return f"""{name}_r AS (
  SELECT {keys}, {label} AS y,
         row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, {ties}) AS rn,
         row_number() OVER (PARTITION BY {keys} ORDER BY {label} DESC) AS ideal_rn,
         rank() OVER (PARTITION BY {keys} ORDER BY {score})
           + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0 AS rk
  FROM {source}),
{name} AS (
  SELECT {keys}, count(*) AS n, CAST(sum(y) AS BIGINT) AS npos,
         CASE WHEN sum(y) > 0 AND sum(y) < count(*)
              THEN (sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END AS auc,
         CASE WHEN sum(y) > 0
              THEN sum(CASE WHEN rn <= 5 THEN y / log2(rn + 1) ELSE 0 END)
                   / sum(CASE WHEN ideal_rn <= 5 THEN y / log2(ideal_rn + 1) ELSE 0 END)
              ELSE 0 END AS ndcg
  FROM {name}_r GROUP BY {keys})"""


PROTOCOL = """coalesce(sum(npos * auc) / sum(CASE WHEN auc IS NOT NULL THEN npos END), 0.5)"""


def protocol_sql(by: str, source: str) -> str:
    return f"""SELECT {by}, round(gauc, 6) + 0.0 AS gauc, round(ndcg, 6) + 0.0 AS ndcg_at_5,
       round((gauc + ndcg) / 2, 6) + 0.0 AS primary_score, users, row_count
FROM (SELECT {by}, {PROTOCOL} AS gauc, avg(ndcg) AS ndcg, count(*) AS users, CAST(sum(n) AS BIGINT) AS row_count
      FROM {source} GROUP BY {by})"""


def popularity_scored(spark, sf_dir):
    """Valid and test impressions scored by train popularity."""
    train = impressions(spark, sf_dir, ["train"])
    return S.score_popularity(impressions(spark, sf_dir, ["valid", "test"]), train, "video_id", "long_view")


def orders_scored(spark, sf_dir):
    rest, train = (order_impressions(spark, sf_dir, splits=x) for x in (["valid", "test"], ["train"]))
    return S.score_popularity(rest, train, "video_id", "long_view")


def rounded_protocol(df):
    return rounded(df, "gauc", "ndcg_at_5", "primary_score")


@query("protocol", protocol_sql("split", "pieces"),
       (IMP, POP, pieces_cte("pieces", "pop", "split, user_id", "row_id")))
def protocol(spark, sf_dir):
    """Popularity fitted on train, official protocol on valid and test."""
    return rounded_protocol(
        M.evaluate(popularity_scored(spark, sf_dir), ["split"], "user_id", "long_view", "score", ["row_id"],
                   probe=impressions(spark, sf_dir, ["valid", "test"]))
    )


@query("protocol_orders", protocol_sql("split", "pieces"),
       (ORD, ORD_POP, pieces_cte("pieces", "scored", "split, user_id", ", ".join(ORDER_TIES))))
def protocol_orders(spark, sf_dir):
    """Same over order lines: many users, large catalogue."""
    return rounded_protocol(
        M.evaluate(orders_scored(spark, sf_dir), ["split"], "user_id", "long_view", "score", ORDER_TIES,
                   probe=order_impressions(spark, sf_dir, splits=["valid", "test"]))
    )


@query("auc_by_user",
       "SELECT split, user_id, n, npos, round(coalesce(auc, 0.5), 6) + 0.0 AS auc FROM pieces",
       (IMP, POP, pieces_cte("pieces", "pop", "split, user_id", "row_id")))
def auc_by_user(spark, sf_dir):
    """Tie-corrected AUC per list, 0.5 for a single class."""
    p = M.user_pieces(popularity_scored(spark, sf_dir), ["split", "user_id"], "long_view", "score", ["row_id"],
                      probe=impressions(spark, sf_dir, ["valid", "test"]))
    return p.select("split", "user_id", "n", "npos", r6(F.coalesce("auc", F.lit(0.5))).alias("auc"))


@query("ndcg_by_user", "SELECT split, user_id, npos, round(ndcg, 6) + 0.0 AS ndcg_at_5 FROM pieces",
       (IMP, POP, pieces_cte("pieces", "pop", "split, user_id", "row_id")))
def ndcg_by_user(spark, sf_dir):
    """nDCG@5 per list, 0 without a positive."""
    p = M.user_pieces(popularity_scored(spark, sf_dir), ["split", "user_id"], "long_view", "score", ["row_id"],
                      probe=impressions(spark, sf_dir, ["valid", "test"]))
    return p.select("split", "user_id", "npos", r6("ndcg").alias("ndcg_at_5"))


@query("gauc", f"""SELECT split, round({PROTOCOL}, 6) + 0.0 AS gauc,
       CAST(sum(CASE WHEN auc IS NOT NULL THEN npos END) AS BIGINT) AS weight, count(auc) AS mixed_users
FROM pieces GROUP BY split""", (IMP, POP, pieces_cte("pieces", "pop", "split, user_id", "row_id")))
def gauc(spark, sf_dir):
    """Positive-weighted mean AUC over lists with both classes."""
    p = M.user_pieces(popularity_scored(spark, sf_dir), ["split", "user_id"], "long_view", "score", ["row_id"],
                      probe=impressions(spark, sf_dir, ["valid", "test"]))
    mixed = F.col("auc").isNotNull()
    return p.groupBy("split").agg(
        r6(M.protocol_columns()[0]).alias("gauc"),
        F.sum(F.when(mixed, F.col("npos"))).alias("weight"),
        F.count("auc").alias("mixed_users"),
    )


FAST = """fast_r AS (
  SELECT split, user_id, long_view AS y, row_number() OVER (PARTITION BY split, user_id ORDER BY score, row_id) AS rk,
         row_number() OVER (PARTITION BY split, user_id ORDER BY score DESC, row_id) AS rn,
         row_number() OVER (PARTITION BY split, user_id ORDER BY long_view DESC) AS ideal_rn FROM pop),
fast AS (
  SELECT split, user_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS npos,
         CASE WHEN sum(y) > 0 AND sum(y) < count(*)
              THEN (sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END AS auc,
         CASE WHEN sum(y) > 0
              THEN sum(CASE WHEN rn <= 5 THEN y / log2(rn + 1) ELSE 0 END)
                   / sum(CASE WHEN ideal_rn <= 5 THEN y / log2(ideal_rn + 1) ELSE 0 END) ELSE 0 END AS ndcg
  FROM fast_r GROUP BY split, user_id)"""


@query("fast_protocol", protocol_sql("split", "fast"), (IMP, POP, FAST))
def fast_protocol(spark, sf_dir):
    """Protocol without tie correction."""
    return rounded_protocol(
        M.fast_evaluate(popularity_scored(spark, sf_dir), ["split"], "user_id", "long_view", "score", ["row_id"],
                        probe=impressions(spark, sf_dir, ["valid", "test"]))
    )


def click_sql(by: str, source: str, ties: str, label: str, score: str = "score") -> str:
    return f"""SELECT {by}, round(ndcg10, 6) + 0.0 AS ndcg_at_10, round(ndcg5, 6) + 0.0 AS ndcg_at_5,
       round(recall, 6) + 0.0 AS recall_at_50, round(0.5 * ndcg10 + 0.5 * recall, 6) + 0.0 AS score,
       users, scored_users
FROM (SELECT {by}, avg(d10 / i10) AS ndcg10, avg(d5 / i5) AS ndcg5, avg(hits / npos) AS recall,
             count(*) AS users, count(npos) AS scored_users
      FROM (SELECT {by}, user_id, nullif(sum(y), 0) AS npos, sum(CASE WHEN rn <= 50 THEN y ELSE 0 END) AS hits,
                   sum(CASE WHEN rn <= 10 THEN y / log2(rn + 1) ELSE 0 END) AS d10,
                   nullif(sum(CASE WHEN ideal_rn <= 10 THEN y / log2(ideal_rn + 1) ELSE 0 END), 0) AS i10,
                   sum(CASE WHEN rn <= 5 THEN y / log2(rn + 1) ELSE 0 END) AS d5,
                   nullif(sum(CASE WHEN ideal_rn <= 5 THEN y / log2(ideal_rn + 1) ELSE 0 END), 0) AS i5
            FROM (SELECT {by}, user_id, {label} AS y,
                         row_number() OVER (PARTITION BY {by}, user_id ORDER BY {score} DESC, {ties}) AS rn,
                         row_number() OVER (PARTITION BY {by}, user_id ORDER BY {label} DESC) AS ideal_rn
                  FROM {source}) GROUP BY {by}, user_id) GROUP BY {by})"""


@query("v0_metrics", click_sql("split", "pop", "row_id", "is_click"), (IMP, POP))
def v0_metrics(spark, sf_dir):
    """Click protocol: nDCG@10, nDCG@5, recall@50 over users with a positive."""
    m = M.click_metrics(popularity_scored(spark, sf_dir), ["split"], "user_id", "is_click", "score", ["row_id"],
                        probe=impressions(spark, sf_dir, ["valid", "test"]))
    return rounded(m, "ndcg_at_10", "ndcg_at_5", "recall_at_50", "score")


@query("global_auc", """SELECT split, count(*) AS row_count, CAST(sum(is_click) AS BIGINT) AS positives,
       round((sum(is_click * rk) - sum(is_click) * (sum(is_click) + 1) / 2.0)
             / (sum(is_click) * (count(*) - sum(is_click))), 6) + 0.0 AS auc
FROM (SELECT split, is_click, rank() OVER (PARTITION BY split ORDER BY score)
             + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS rk FROM pop) GROUP BY split""", (IMP, POP))
def global_auc(spark, sf_dir):
    """AUC over all rows of a split."""
    return rounded(M.global_auc(popularity_scored(spark, sf_dir), ["split"], "is_click", "score"), "auc")


@query("avg_rank", """SELECT split, user_id, round(score, 6) + 0.0 AS score, count(*) AS n,
       round(min(rk), 6) + 0.0 AS avg_rank
FROM (SELECT split, user_id, score, rank() OVER (PARTITION BY split, user_id ORDER BY score)
             + (count(*) OVER (PARTITION BY split, user_id, score) - 1) / 2.0 AS rk FROM pop)
GROUP BY split, user_id, pop_key(score)""".replace("pop_key(score)", "score"), (IMP, POP))
def avg_rank(spark, sf_dir):
    """Average rank of each distinct score in a list."""
    r = M.average_rank(popularity_scored(spark, sf_dir), ["split", "user_id"], "score")
    return rounded(r, "score", "avg_rank")


@query("list_profile", """SELECT split, count(*) AS users, CAST(sum(c) AS BIGINT) AS row_count,
       round(quantile_cont(c, 0.5), 6) + 0.0 AS list_len_p50, round(quantile_cont(c, 0.9), 6) + 0.0 AS list_len_p90,
       max(c) AS list_len_max, round(avg(CAST(c <= 10 AS INTEGER)), 6) + 0.0 AS frac_le_10,
       round(avg(CAST(c <= 50 AS INTEGER)), 6) + 0.0 AS frac_le_50
FROM (SELECT split, user_id, count(*) AS c FROM ord_imp GROUP BY split, user_id) GROUP BY split""", (ORD,))
def list_profile(spark, sf_dir):
    """Impression-list sizes per split."""
    p = M.list_profile(order_impressions(spark, sf_dir), ["split"], "user_id")
    return rounded(p, "list_len_p50", "list_len_p90", "frac_le_10", "frac_le_50")


@query("label_composition", """SELECT split, CAST(sum(c) AS BIGINT) AS row_count, count(*) AS users,
       round(sum(s) / sum(c), 6) + 0.0 AS positive_rate, count(CASE WHEN s = 0 THEN 1 END) AS users_no_positive,
       round(avg(CAST(s = 0 AS INTEGER)), 6) + 0.0 AS share_no_positive,
       count(CASE WHEN s = c THEN 1 END) AS users_all_positive,
       round(avg(CAST(s = c AS INTEGER)), 6) + 0.0 AS share_all_positive
FROM (SELECT split, user_id, count(*) AS c, sum(long_view) AS s FROM ord_imp GROUP BY split, user_id)
GROUP BY split""", (ORD,))
def label_composition(spark, sf_dir):
    """Label make-up of the lists per split."""
    c = M.label_composition(order_impressions(spark, sf_dir), ["split"], "user_id", "long_view")
    return rounded(c, "positive_rate", "share_no_positive", "share_all_positive")


CLICK_PAIR = """pair AS (
  SELECT split, 'item' AS model, user_id, row_id, is_click, score FROM pop
  UNION ALL SELECT split, 'tab' AS model, user_id, row_id, is_click, tm AS score
  FROM pop JOIN (SELECT tab, avg(is_click) AS tm FROM imp WHERE split = 'train' GROUP BY tab) USING (tab))"""


def tab_scored(spark, sf_dir):
    """Baseline: click rate of the tab, fitted on train."""
    train = impressions(spark, sf_dir, ["train"])
    rate = train.groupBy("tab").agg(F.avg("is_click").alias("score"))
    return impressions(spark, sf_dir, ["valid", "test"]).join(rate, "tab")


@query("metric_delta", """SELECT split, metric, round(max(CASE WHEN model = 'item' THEN value END), 6) + 0.0 AS value,
       round(max(CASE WHEN model = 'tab' THEN value END), 6) + 0.0 AS baseline,
       round(max(CASE WHEN model = 'item' THEN value END) - max(CASE WHEN model = 'tab' THEN value END), 6) + 0.0 AS delta
FROM (SELECT split, model, unnest(['ndcg_at_10', 'ndcg_at_5', 'recall_at_50', 'score']) AS metric,
             unnest([ndcg_at_10, ndcg_at_5, recall_at_50, score]) AS value FROM (""" +
       click_sql("split, model", "pair", "row_id", "is_click").replace("round(", "round10(")
       .replace("round10(", "round(").replace(", 6)", ", 12)") + ")) GROUP BY split, metric", (IMP, POP, CLICK_PAIR))
def metric_delta(spark, sf_dir):
    """Click metrics of item popularity against the tab-rate baseline."""
    names = ["ndcg_at_10", "ndcg_at_5", "recall_at_50", "score"]
    ours = M.click_metrics(popularity_scored(spark, sf_dir), ["split"], "user_id", "is_click", "score", ["row_id"])
    base = M.click_metrics(tab_scored(spark, sf_dir), ["split"], "user_id", "is_click", "score", ["row_id"])
    return rounded(M.metric_delta(ours, base, ["split"], names), "value", "baseline", "delta")


REFERENCE_SCORES = """ref AS (
  SELECT split, user_id, row_id, long_view, 'perfect' AS model, CAST(long_view AS DOUBLE) AS score
  FROM imp WHERE split <> 'train'
  UNION ALL SELECT split, user_id, row_id, long_view, 'random' || seed AS model,
         CAST(('0x' || substr(md5(seed || ':' || row_id), 1, 8)) AS BIGINT) / 4294967296.0 AS score
  FROM imp, (SELECT unnest(['0', '1', '2', '3', '4']) AS seed) WHERE split <> 'train')"""


def reference_scores(rows):
    """Label-perfect scores and five random ones, in long form by ``model``."""
    scored = F.array(
        F.struct(F.lit("perfect").alias("model"), F.col("long_view").cast("double").alias("score")),
        *[F.struct(F.lit(f"random{s}").alias("model"), uniform(s, "row_id").alias("score")) for s in range(5)],
    )
    return rows.select("split", "user_id", "row_id", "long_view", F.explode(scored).alias("_m")).select(
        "split", "user_id", "row_id", "long_view", "_m.*"
    )


@query("reference_points", """SELECT split, CASE WHEN model = 'perfect' THEN model ELSE 'random' END AS reference,
       round(avg(gauc), 6) + 0.0 AS gauc, round(avg(ndcg), 6) + 0.0 AS ndcg_at_5,
       round(avg((gauc + ndcg) / 2), 6) + 0.0 AS primary_score, count(*) AS systems
FROM (SELECT split, model, """ + PROTOCOL + """ AS gauc, avg(ndcg) AS ndcg FROM pieces GROUP BY split, model)
GROUP BY 1, 2""", (IMP, REFERENCE_SCORES, pieces_cte("pieces", "ref", "split, model, user_id", "row_id")))
def reference_points(spark, sf_dir):
    """Label-perfect and random (mean of five seeds) reference points."""
    rows = reference_scores(impressions(spark, sf_dir, ["valid", "test"]))
    m = M.evaluate(rows, ["split", "model"], "user_id", "long_view", "score", ["row_id"])
    kind = F.when(F.col("model") == "perfect", "perfect").otherwise("random")
    return m.groupBy("split", kind.alias("reference")).agg(
        r6(F.avg("gauc")).alias("gauc"), r6(F.avg("ndcg_at_5")).alias("ndcg_at_5"),
        r6(F.avg("primary_score")).alias("primary_score"), F.count(F.lit(1)).alias("systems"),
    )


@query("range_position", """SELECT split, round(x, 6) + 0.0 AS primary_score, round(lo, 6) + 0.0 AS low,
       round(hi, 6) + 0.0 AS high, round((x - lo) / (hi - lo), 6) + 0.0 AS position
FROM (SELECT split, avg(CASE WHEN model LIKE 'random%' THEN p END) AS lo, max(CASE WHEN model = 'perfect' THEN p END) AS hi,
             max(CASE WHEN model = 'pop' THEN p END) AS x
      FROM (SELECT split, model, (""" + PROTOCOL + """ + avg(ndcg)) / 2 AS p FROM pieces GROUP BY split, model)
      GROUP BY split)""",
       (IMP, POP, REFERENCE_SCORES,
        "both_scores AS (SELECT * FROM ref UNION ALL SELECT split, user_id, row_id, long_view, 'pop', score FROM pop)",
        pieces_cte("pieces", "both_scores", "split, model, user_id", "row_id")))
def range_position(spark, sf_dir):
    """Where popularity lies between the two reference points."""
    refs = reference_scores(impressions(spark, sf_dir, ["valid", "test"]))
    pop = popularity_scored(spark, sf_dir).select(
        "split", "user_id", "row_id", "long_view", F.lit("pop").alias("model"), "score"
    )
    m = M.evaluate(refs.unionByName(pop), ["split", "model"], "user_id", "long_view", "score", ["row_id"])
    p, model = F.col("primary_score"), F.col("model")
    s = m.groupBy("split").agg(
        F.max(F.when(model == "pop", p)).alias("primary_score"),
        F.avg(F.when(model.startswith("random"), p)).alias("low"),
        F.max(F.when(model == "perfect", p)).alias("high"),
    )
    s = s.withColumn("position", M.range_position(F.col("primary_score"), F.col("low"), F.col("high")))
    return rounded(s, "primary_score", "low", "high", "position")
