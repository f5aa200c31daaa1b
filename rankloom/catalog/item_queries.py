"""Item-item similarity, history scores, ridge weights, ordered statistics, attention pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import IMP, query, r6, rounded
from rankloom.functions.hashing import hash32
from rankloom.functions.scalars import smooth
from rankloom.operators import attention as A
from rankloom.operators import ease as Z
from rankloom.operators import itemitem as I
from rankloom.operators import stats as S
from rankloom.operators.ordering import Prefix, ordered_prefix
from rankloom.sources.views import impressions, item_vectors

PAIRS = """pairs AS (SELECT DISTINCT user_id, video_id FROM imp WHERE split = 'train' AND long_view = 1),
norms AS (SELECT video_id, 1 / sqrt(count(*)) AS ninv FROM pairs GROUP BY video_id),
co AS (SELECT a.video_id AS item_i, b.video_id AS item_j, count(*) AS co FROM pairs a JOIN pairs b USING (user_id) GROUP BY 1, 2),
sim AS (SELECT item_i, item_j, co, co * a.ninv * b.ninv AS w FROM co JOIN norms a ON a.video_id = item_i
        JOIN norms b ON b.video_id = item_j)"""


def train_of(spark, sf_dir):
    return impressions(spark, sf_dir, ["train"])


def train_pairs(spark, sf_dir, label="long_view"):
    return I.distinct_pairs(train_of(spark, sf_dir), label)


SLIM = ("row_id", "split", "user_id", "video_id", "date", "long_view")


@query("cooccurrence", "SELECT CAST(item_i AS BIGINT) AS item_i, CAST(item_j AS BIGINT) AS item_j, co FROM co", (IMP, PAIRS))
def cooccurrence(spark, sf_dir):
    """Users who liked both items."""
    return I.cooccurrence(train_pairs(spark, sf_dir))


@query("item_cosine", "SELECT CAST(item_i AS BIGINT) AS item_i, CAST(item_j AS BIGINT) AS item_j, round(w, 6) + 0.0 AS w FROM sim",
       (IMP, PAIRS))
def item_cosine(spark, sf_dir):
    """Item-item cosine over positives."""
    return I.cosine(train_pairs(spark, sf_dir)).select("item_i", "item_j", r6("w").alias("w"))


CF_OUT = "row_id, round(cf_sum, 6) + 0.0 AS cf_sum, round(cf_sum / greatest(h, 1), 6) + 0.0 AS cf_mean, CAST(h AS BIGINT) AS u_hist_cnt"


def cf_columns(df):
    return df.select("row_id", r6("cf_sum").alias("cf_sum"), r6("cf_mean").alias("cf_mean"),
                     F.col("u_hist_cnt").cast("long").alias("u_hist_cnt"))


@query("cf_score", f"""SELECT {CF_OUT} FROM (SELECT r.row_id, coalesce(sum(w), 0) AS cf_sum, count(h.video_id) AS h
  FROM imp r LEFT JOIN pairs h USING (user_id) LEFT JOIN sim ON item_i = r.video_id AND item_j = h.video_id
  WHERE r.split <> 'train' GROUP BY r.row_id)""", (IMP, PAIRS))
def cf_score(spark, sf_dir):
    """Similarity of the row's item to the user's train history."""
    pairs = train_pairs(spark, sf_dir)
    rows = impressions(spark, sf_dir, ["valid", "test"]).select(*SLIM)
    return cf_columns(I.history_score(rows, pairs, I.cosine(pairs)))


@query("cf_leave_user_out", f"""SELECT {CF_OUT} FROM (
  SELECT r.row_id, coalesce(sum(CASE WHEN r.long_view = 0 THEN w WHEN h.video_id <> r.video_id
           THEN (coalesce(co, 0) - 1) * a.ninv * b.ninv END), 0) AS cf_sum,
         count(h.video_id) - CASE WHEN count(h.video_id) > 0 THEN r.long_view ELSE 0 END AS h
  FROM imp r LEFT JOIN pairs h USING (user_id) LEFT JOIN sim ON item_i = r.video_id AND item_j = h.video_id
    LEFT JOIN norms a ON a.video_id = r.video_id LEFT JOIN norms b ON b.video_id = h.video_id
  WHERE r.split = 'train' GROUP BY r.row_id, r.long_view)""", (IMP, PAIRS))
def cf_leave_user_out(spark, sf_dir):
    """Train rows with their own user taken out of every co-count."""
    pairs = train_pairs(spark, sf_dir)
    scored = I.history_score(train_of(spark, sf_dir).select(*SLIM), pairs, I.cosine(pairs))
    return cf_columns(I.leave_user_out(scored, pairs, "long_view"))


EARLY = PAIRS.replace("pairs", "pairs_e").replace("norms", "norms_e").replace("co AS", "co_e AS").replace("FROM co ", "FROM co_e ") \
    .replace("sim AS", "sim_e AS").replace("split = 'train'", "split = 'train' AND date < (SELECT cut FROM mid)")
MID = """mid AS (SELECT d[len(d) // 2 + 1] AS cut FROM (SELECT list(date ORDER BY date) AS d
  FROM (SELECT DISTINCT date FROM imp WHERE split = 'train')))"""


@query("cf_two_phase", f"""SELECT {CF_OUT} FROM (
  SELECT r.row_id, coalesce(sum(w), 0) AS cf_sum, count(h.video_id) AS h FROM imp r LEFT JOIN pairs h USING (user_id)
    LEFT JOIN sim ON item_i = r.video_id AND item_j = h.video_id WHERE r.split <> 'train' GROUP BY r.row_id
  UNION ALL SELECT r.row_id, coalesce(sum(w), 0), count(h.video_id) FROM imp r LEFT JOIN pairs_e h USING (user_id)
    LEFT JOIN sim_e ON item_i = r.video_id AND item_j = h.video_id
  WHERE r.split = 'train' AND r.date >= (SELECT cut FROM mid) GROUP BY r.row_id
  UNION ALL SELECT row_id, 0, 0 FROM imp WHERE split = 'train' AND date < (SELECT cut FROM mid))""",
       (IMP, PAIRS, MID, EARLY))
def cf_two_phase(spark, sf_dir):
    """First half of the days scores the second; the whole train scores the rest."""
    rows = impressions(spark, sf_dir).select(*SLIM)
    return cf_columns(I.two_phase_score(rows, train_of(spark, sf_dir), "long_view", I.cosine))


@query("ease_residual", """SELECT CAST(a.video_id AS BIGINT) AS item_i, CAST(b.video_id AS BIGINT) AS item_j,
  CASE WHEN a.video_id = b.video_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM norms a, norms b""", (IMP, PAIRS))
def ease_residual(spark, sf_dir):
    """(G + lam I) P over the computed inverse P: the identity."""
    pairs = train_pairs(spark, sf_dir)
    inv = Z.inverse_gram(pairs, 250.0)
    return rounded(Z.residual(inv, I.cooccurrence(pairs), 250.0), "r")


@query("ease_score")
def ease_score(spark, sf_dir):
    """Two-phase ridge score of every row: sum and mean over the history."""
    rows = impressions(spark, sf_dir).select(*SLIM)
    out = I.two_phase_score(rows, train_of(spark, sf_dir), "long_view", lambda p: Z.ease_weights(p, 250.0, candidates=rows))
    return out.select("row_id", r6("cf_sum").alias("ease_sum"), r6("cf_mean").alias("ease_mean"))


# Ridge strength and label of the ridge variants.
EASE_VARIANTS = {"ease50_mean": ("long_view", 50.0), "ease1000_mean": ("long_view", 1000.0),
                 "easeclk_mean": ("is_click", 250.0)}


@query("ease_variants")
def ease_variants(spark, sf_dir):
    """Ridge scores for other strengths and for clicks, in long form; strengths of one label share its Gram table."""
    rows = impressions(spark, sf_dir).select(*SLIM)
    train = train_of(spark, sf_dir)
    out = None
    for label in ("long_view", "is_click"):
        lams = {n: lam for n, (y, lam) in EASE_VARIANTS.items() if y == label}
        for name, s in I.two_phase_scores(rows, train, label, lambda p, lams=lams: Z.ease_weight_sets(p, lams, candidates=rows)).items():
            s = s.select("row_id", F.lit(name).alias("variant"), r6("cf_mean").alias("score"))
            out = s if out is None else out.unionByName(s)
    return out


@query("ordered_target_stats", """SELECT row_id, c AS seen, round((s + 1.0 * m) / (c + 1.0), 6) + 0.0 AS ots FROM (
  SELECT row_id, count(*) OVER w AS c, coalesce(sum(long_view) OVER w, 0) AS s FROM imp WHERE split = 'train'
  WINDOW w AS (PARTITION BY video_id ORDER BY substr(md5('0:' || row_id), 1, 8), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  (SELECT avg(long_view) AS m FROM imp WHERE split = 'train')""", (IMP,))
def ordered_target_stats(spark, sf_dir):
    """Smoothed target mean over the rows that come earlier in a hashed permutation."""
    train = train_of(spark, sf_dir).select("row_id", "video_id", "long_view").withColumn("_h", hash32(0, "row_id"))
    got = ordered_prefix(train, ["video_id"], "_h", ["row_id"], Prefix(number="_no", sums={"_s": "long_view"}))
    rate = smooth(F.col("_s"), F.col("_no") - 1, S.pool_mean(train, "long_view"), 1.0)
    return got.select("row_id", (F.col("_no") - 1).alias("seen"), r6(rate).alias("ots"))


@query("attention_pool", """SELECT row_id, count(d) AS hist_len, round(coalesce(sum(exp(d) * d) / sum(exp(d)), 0), 6) + 0.0 AS attention FROM (
  SELECT r.row_id, list_dot_product(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d
  FROM (SELECT row_id, video_id, unnest(CASE WHEN len(h) = 0 THEN [NULL] ELSE h END) AS hist FROM (
      SELECT r.row_id, r.video_id, coalesce((list(p.video_id ORDER BY p.time_us DESC, p.row_id DESC) FILTER (p.row_id IS NOT NULL))[1:50], []) AS h
      FROM imp r LEFT JOIN imp p ON p.user_id = r.user_id AND p.split = 'train' AND p.long_view = 1 AND p.time_us < r.time_us
      GROUP BY r.row_id, r.video_id)) r
    LEFT JOIN embeddings c ON c.vec_id = r.video_id LEFT JOIN embeddings e ON e.vec_id = r.hist) GROUP BY row_id""", (IMP,))
def attention_pool(spark, sf_dir):
    """Softmax of candidate-history similarity over the last fifty positives, pooled."""
    rows = impressions(spark, sf_dir).select("row_id", "user_id", "video_id", "time_us")
    return rounded(A.attention_pool(rows, train_of(spark, sf_dir), item_vectors(spark, sf_dir)), "attention")
