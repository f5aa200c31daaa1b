"""Learners, ranking gradients and table checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankloom.catalog.blend_queries import SCORES, model_scores
from rankloom.catalog.metric_queries import POP, popularity_scored, rounded_protocol
from rankloom.catalog.registry import IMP, query, r6, rounded
from rankloom.catalog.scalar_queries import ITEM_COUNTS, STAT_NAMES, STAT_SQL, item_statistics
from rankloom.catalog.stat_queries import AUX, HATE, STAY
from rankloom.functions.scalars import item_stat_columns
from rankloom.operators import checks as C
from rankloom.operators import gradients as G
from rankloom.operators import fm as FM
from rankloom.operators import metrics as M
from rankloom.operators import splits as P
from rankloom.operators import stats as S
from rankloom.operators import trees as T
from rankloom.plans.features import FEEDBACK, GROUPS, LOG_GROUPS, build_features
from rankloom.plans.variants import compare_variants, variant_table
from rankloom.session import checkpoint_dir
from rankloom.sources.views import impressions, table

# Groups of the smaller learner queries, and which of their columns are categories.
SLIM_GROUPS = ("base", "item", "user", "ids", "uv")
CATEGORIES = {"tab", "tag1", "dur_bucket", "video_type", "upload_type", "visible_status", "music_type", "user_active_degree",
              "user_id_c", "video_id_c", "author_id_c", *[f"onehot_feat{i}" for i in range(18)]}


def learner_rows(spark, sf_dir, groups=SLIM_GROUPS, mixed=None, **sides):
    """(train rows with past-only statistics, scored rows, categories, numbers), written once.

    ``mixed`` adds the train rows' ``weight`` before that, where the table meets by row id anyway.
    """
    rows, train = (with_feedback(impressions(spark, sf_dir, splits)) for splits in (None, ["train"]))
    checkpoint_dir(spark)
    features = build_features(rows, train, groups, **sides)
    if mixed is not None:
        weights = S.mixed_weight(train.select("row_id", "user_id", "date", "long_view"), ["user_id", "date"], "long_view", mixed)
        features = features.join(weights.select("row_id", "weight"), "row_id", "left")
    table = T.written(features, "features", ["split"])
    columns = [c for g in GROUPS if g in groups for c in GROUPS[g]]
    cats = [c for c in columns if c in CATEGORIES]
    return table.where("split = 'train'"), table.where("split <> 'train'"), cats, [c for c in columns if c not in cats]


def scored_protocol(scored):
    return rounded_protocol(M.evaluate(scored, ["split"], "user_id", "long_view", "score", ["row_id"]))


def with_feedback(df):
    """Feedback flags that the driver's log does not carry, derived from play time."""
    flags = {c: F.expr(f"CAST({AUX[n]} AS INT)") for n, c in FEEDBACK.items()}
    return df.withColumns({**flags, "is_hate": F.expr(HATE.format("")), "profile_stay_time": F.expr(STAY)})


@query("feature_table")
def feature_table(spark, sf_dir):
    """All features the log alone gives, train rows past-only."""
    return build_features(*(with_feedback(impressions(spark, sf_dir, splits)) for splits in (None, ["train"])))


# Side columns the driver's tables do not carry, made of the part's and the customer's numbers.
VSIDE = [c for c in GROUPS["vside"] if c not in ("video_type", "tag1")]
USIDE = [c for c in GROUPS["uside"] if c != "user_active_degree"]
SIDE_ITEM = {c: f"(p_partkey * {k + 3} + p_size) % {k + 11}" for k, c in enumerate(VSIDE)}
SIDE_USER = {c: f"(c_custkey * {k + 2} + c_nationkey) % {k + 5}" for k, c in enumerate(USIDE)}


@query("feature_table_sides", "SELECT row_id, duration_ms, round(ln(1 + duration_ms), 6) + 0.0 AS log_dur, hour, dow, tab, tags[1] AS tag1, video_type, "
       + "user_active_degree, " + ", ".join([*VSIDE, *USIDE, *[f"round({n}, 6) + 0.0 AS {n}" for n in STAT_NAMES]]) + f"""
FROM imp LEFT JOIN (SELECT item, {STAT_SQL} FROM (SELECT l_partkey AS item, {", ".join(f"{e} AS {n}" for n, e in ITEM_COUNTS.items())}
    FROM lineitem GROUP BY l_partkey)) ON item = video_id
  LEFT JOIN (SELECT p_partkey, p_type AS video_type, {", ".join(f"{e} AS {c}" for c, e in SIDE_ITEM.items())} FROM part) ON p_partkey = video_id
  LEFT JOIN (SELECT c_custkey, c_mktsegment AS user_active_degree, {", ".join(f"{e} AS {c}" for c, e in SIDE_USER.items())} FROM customer)
    ON c_custkey = user_id""", (IMP,))
def feature_table_sides(spark, sf_dir):
    """Base columns with all columns of the item, item-statistic and user side tables joined."""
    f = build_features(impressions(spark, sf_dir), impressions(spark, sf_dir, ["train"]), ("base", "vside", "vstat", "uside"),
                       **side_tables(spark, sf_dir))
    return rounded(f.drop("split", "user_id", "video_id", "date", "long_view"), "log_dur", *STAT_NAMES)


def side_tables(spark, sf_dir):
    """Item, item-statistic and user side tables with the columns of their groups."""
    items = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").select(
        F.col("p_partkey").cast("int").alias("video_id"), F.col("p_type").alias("video_type"),
        *[F.expr(e).alias(c) for c, e in SIDE_ITEM.items()])
    cols = item_stat_columns()
    stats = item_statistics(spark, sf_dir).select(F.col("item").cast("int").alias("video_id"), *[cols[c].alias(c) for c in STAT_NAMES])
    users = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("user_active_degree"), *[F.expr(e).alias(c) for c, e in SIDE_USER.items()])
    return {"items": items, "item_stats": stats, "users": users}


def variant_sides(spark, sf_dir):
    """Item and user side tables of the click learner's variants."""
    items = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_size").select(
        F.col("p_partkey").cast("int").alias("video_id"), F.col("p_type").alias("video_type"), F.col("p_brand").alias("music_type"),
        F.col("p_size").alias("server_width"), (F.col("p_partkey") % 40).alias("server_height"))
    users = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("user_active_degree"), F.col("c_nationkey").cast("string").alias("onehot_feat0"),
        F.col("c_acctbal").alias("register_days"))
    return items, users


FIELDS = ["user_id", "video_id", "author_id", "tab"]
LISTS = {"user": "user_id", "label": "long_view", "ties": ["row_id"]}


def machine_rows(spark, sf_dir):
    rows = impressions(spark, sf_dir).select("row_id", "split", "long_view", *FIELDS)
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


@query("fm_scores")
def fm_scores(spark, sf_dir):
    """Factorisation machine over user, item, author and tab, stopped by the metric on valid; protocol per split."""
    train, others = machine_rows(spark, sf_dir)
    model = FM.fit(train, FIELDS, "long_view", valid=others.where("split = 'valid'"), user="user_id")
    return scored_protocol(model.predict(others))


@query("fm_oof_scores")
def fm_oof_scores(spark, sf_dir):
    """Out-of-fold factorisation machine, five folds fitted side by side with the full model."""
    train, others = machine_rows(spark, sf_dir)
    return FM.out_of_fold(train, others, FIELDS, "long_view").select("row_id", "split", "score")


FOLD = "CAST(CAST(('0x' || substr(md5('0:' || row_id), 1, 8)) AS BIGINT) % 5 AS INTEGER)"


@query("oof_folds", f"SELECT row_id, {FOLD} AS fold FROM imp WHERE split = 'train'", (IMP,))
def oof_folds(spark, sf_dir):
    """Five disjoint folds by row hash."""
    return P.fold_of(impressions(spark, sf_dir, ["train"]).select("row_id"), 5, 0)


@query("oof_scores")
def oof_scores(spark, sf_dir):
    """Out-of-fold boosted-tree scores for train in five folds, full-model scores for the rest."""
    train, others, cats, nums = learner_rows(spark, sf_dir)
    scored = T.out_of_fold(train, others, lambda rows, k: T.boost(rows, cats, nums, "long_view", params=T.Boosting(seed=100 * k)))
    return scored.select("row_id", "split", "score")


@query("oof_popularity", f"""SELECT r.row_id, r.fold, round((coalesce(sum(p.long_view), 0) + 20.0 * any_value(g.m)) / (count(p.row_id) + 20.0), 6) + 0.0 AS score
FROM folded r LEFT JOIN folded p ON p.video_id = r.video_id AND p.fold <> r.fold
  JOIN (SELECT a.fold, avg(b.long_view) AS m FROM (SELECT DISTINCT fold FROM folded) a JOIN folded b ON b.fold <> a.fold GROUP BY a.fold) g ON g.fold = r.fold
GROUP BY r.row_id, r.fold""", (IMP, f"folded AS (SELECT *, {FOLD} AS fold FROM imp WHERE split = 'train')"))
def oof_popularity(spark, sf_dir):
    """Out-of-fold popularity: every fold is scored by the item rates of the others."""
    train = P.fold_of(impressions(spark, sf_dir, ["train"]), 5, 0).select("row_id", "video_id", "long_view", "fold")
    by_fold = train.groupBy("video_id", "fold").agg(F.sum("long_view").alias("s"), F.count(F.lit(1)).alias("c"))
    whole = by_fold.groupBy("video_id").agg(F.sum("s").alias("_s"), F.sum("c").alias("_c"))
    mean = by_fold.groupBy("fold").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    totals = by_fold.agg(F.struct(F.sum("s").alias("s"), F.sum("c").alias("c")).alias("t")).scalar()
    mean = mean.select("fold", ((totals.getField("s") - F.col("s")) / (totals.getField("c") - F.col("c"))).alias("_m"))
    rest = by_fold.join(whole, "video_id").join(mean, "fold").select(
        "video_id", "fold",
        ((F.col("_s") - F.col("s") + 20.0 * F.col("_m")) / (F.col("_c") - F.col("c") + 20.0)).alias("score"),
    )
    return train.join(rest, ["video_id", "fold"]).select("row_id", "fold", r6("score").alias("score"))


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Boosted trees on the whole feature table with mixed-list weights, stopped by the metric on valid; protocol per split."""
    train, others, cats, nums = learner_rows(spark, sf_dir, (*LOG_GROUPS, "vside", "vstat", "uside", "ids"), mixed=0.3, **side_tables(spark, sf_dir))
    model, _ = T.boost_best(train, others.where("split = 'valid'"), cats, nums, **LISTS, weight="weight")
    return scored_protocol(model.predict(others))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Gain table of a fitted boosted-tree model."""
    train, _, cats, nums = learner_rows(spark, sf_dir)
    return T.boost(train, cats, nums, "long_view").importances(spark)


@query("early_stop")
def early_stop(spark, sf_dir):
    """The metric on valid of every number of first trees, from one fit, and the number early stopping keeps."""
    train, others, cats, nums = learner_rows(spark, sf_dir)
    model, seen = T.boost_best(train, others.where("split = 'valid'"), cats, nums, **LISTS)
    rows = [(n, v, n == model.model.getNumTrees) for n, v in seen]
    return rounded(spark.createDataFrame(rows, "trees int, primary_score double, kept boolean"), "primary_score")


@query("saved_model_scores")
def saved_model_scores(spark, sf_dir):
    """A model written to a folder of its own in shared storage, read back, and applied to test."""
    train, others, cats, nums = learner_rows(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    T.boost(train, cats, nums, "long_view").save(path)
    return scored_protocol(T.BoostedTrees.load(spark, path).predict(others.where("split = 'test'")))


@query("feature_variants")
def feature_variants(spark, sf_dir):
    """Six feature sets of the click learner, fitted from one table: (variant, split, metric, value)."""
    rows = impressions(spark, sf_dir).withColumn("tags", F.transform("tags", lambda t: t.cast("string")))
    items, users = variant_sides(spark, sf_dir)
    table, variants = variant_table(rows, rows.where("split = 'train'"), items, users)
    return rounded(compare_variants(table, variants), "value")


def ranker(name: str, objective, doc: str):
    @query(name)
    def run(spark, sf_dir):
        train, others, cats, nums = learner_rows(spark, sf_dir)
        model = T.boost(train, cats, nums, "long_view", objective, keep=["user_id"])
        return scored_protocol(model.predict(others))

    run.__doc__ = doc
    return run


lambdarank_scores = ranker(
    "lambdarank_scores", lambda d, _: G.lambda_gradients(d, ["user_id"], "long_view", "score", ["row_id"], 10),
    "Boosted trees on the truncated pairwise objective.")
xendcg_scores = ranker(
    "xendcg_scores", lambda d, r: G.xendcg_gradients(d, ["user_id"], "long_view", "score", seed=r),
    "Boosted trees on the listwise objective, with new draws every round.")


LAMBDA = """placed AS (SELECT split, user_id, row_id, long_view AS y, score AS s, row_number() OVER (PARTITION BY split, user_id ORDER BY score DESC, row_id) AS at FROM pop),
lists AS (SELECT split, user_id, max(s) AS best, min(s) AS worst, sum(CASE WHEN i <= 10 THEN y / log2(i + 1) ELSE 0 END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY split, user_id ORDER BY y DESC) AS i FROM placed) GROUP BY split, user_id),
pairs AS (SELECT h.split, h.user_id, h.row_id AS hi, l.row_id AS lo, h.s - l.s AS ds,
    abs(1 / log2(h.at + 1) - 1 / log2(l.at + 1)) / ideal / CASE WHEN best <> worst THEN 0.01 + abs(h.s - l.s) ELSE 1 END AS delta
  FROM placed h JOIN placed l ON h.split = l.split AND h.user_id = l.user_id AND h.y > l.y AND least(h.at, l.at) <= 10
    JOIN lists ON lists.split = h.split AND lists.user_id = h.user_id),
terms AS (SELECT *, delta / (1 + exp(ds)) AS l, delta / (1 + exp(ds)) * (1 - 1 / (1 + exp(ds))) AS w FROM pairs),
mass AS (SELECT split, user_id, 2 * sum(l) AS m FROM terms GROUP BY split, user_id),
grads AS (SELECT row_id, sum(g) AS g, sum(w) AS h FROM (SELECT hi AS row_id, -l AS g, w FROM terms UNION ALL SELECT lo, l, w FROM terms) GROUP BY row_id)"""


@query("lambda_gradients", """SELECT split, user_id, p.row_id, round(coalesce(g * CASE WHEN m > 0 THEN log2(1 + m) / m ELSE 1 END, 0), 6) + 0.0 AS lambda,
  round(coalesce(h * CASE WHEN m > 0 THEN log2(1 + m) / m ELSE 1 END, 0), 6) + 0.0 AS hessian
FROM placed p LEFT JOIN grads USING (row_id) LEFT JOIN mass USING (split, user_id)""", (IMP, POP, LAMBDA))
def lambda_gradients(spark, sf_dir):
    """Pairwise nDCG gradients of the popularity scores, truncated at 10."""
    g = G.lambda_gradients(popularity_scored(spark, sf_dir), ["split", "user_id"], "long_view", "score", ["row_id"], 10)
    return rounded(g, "lambda", "hessian")


XENDCG = """x0 AS (SELECT split, user_id, row_id, exp(score - max(score) OVER w) AS e, count(*) OVER w AS n,
    2.0 ** long_view - CAST(('0x' || substr(md5('0:' || row_id), 1, 8)) AS BIGINT) / 4294967296.0 AS phi FROM pop WINDOW w AS (PARTITION BY split, user_id)),
x1 AS (SELECT *, e / sum(e) OVER w AS rho, phi / sum(phi) OVER w AS target FROM x0 WINDOW w AS (PARTITION BY split, user_id)),
x2 AS (SELECT *, rho - target AS t1, (rho - target) / nullif(1 - rho, 0) AS p1 FROM x1),
x3 AS (SELECT *, rho * (sum(p1) OVER w - p1) AS t2, rho * (sum(p1) OVER w - p1) / nullif(1 - rho, 0) AS p2 FROM x2 WINDOW w AS (PARTITION BY split, user_id)),
x4 AS (SELECT *, rho * (sum(p2) OVER w - p2) AS t3 FROM x3 WINDOW w AS (PARTITION BY split, user_id))"""


@query("xendcg_gradients", """SELECT split, user_id, row_id, round(CASE WHEN n = 1 THEN 0 ELSE t1 + t2 + t3 END, 6) + 0.0 AS lambda,
  round(CASE WHEN n = 1 THEN 0 ELSE rho * (1 - rho) END, 6) + 0.0 AS hessian FROM x4""", (IMP, POP, XENDCG))
def xendcg_gradients(spark, sf_dir):
    """Listwise cross-entropy gradients of the popularity scores."""
    g = G.xendcg_gradients(popularity_scored(spark, sf_dir), ["split", "user_id"], "long_view", "score")
    return rounded(g, "lambda", "hessian")


@query("attached_scores", "SELECT row_id, split, round(score, 6) + 0.0 AS sidecar FROM pop", (IMP, POP))
def attached_scores(spark, sf_dir):
    """An external score joined by key; a missing row on either side is an error."""
    rows = impressions(spark, sf_dir, ["valid", "test"]).select("row_id", "split")
    ext = popularity_scored(spark, sf_dir).select("row_id", F.col("score").alias("ext"))
    return C.attach_scores(rows, ext, "ext").select("row_id", "split", r6("ext").alias("sidecar"))


@query("recompute_diff", """SELECT row_id, CAST(round(score * 1000) AS BIGINT) AS milli, side, copies FROM (
  SELECT row_id, score, 'stored' AS side, 1::BIGINT AS copies FROM pop WHERE split = 'valid' AND video_id < 5
  UNION ALL SELECT row_id, 0.0, 'recomputed', 1 FROM pop WHERE split = 'valid' AND video_id < 5)""", (IMP, POP))
def recompute_diff(spark, sf_dir):
    """Stored scores against a recomputation that differs on five items."""
    s = popularity_scored(spark, sf_dir).where("split = 'valid'")
    milli = F.round(F.col("score") * 1000).cast("long").alias("milli")
    changed = s.withColumn("score", F.when(F.col("video_id") < 5, 0.0).otherwise(F.col("score")))
    return C.table_diff(s.select("row_id", milli), changed.select("row_id", milli))


@query("content_digest", """SELECT split, CAST(sum(CAST(('0x' || substr(md5(length(CAST(user_id AS VARCHAR)) || ':' || user_id || length(CAST(row_id AS VARCHAR)) || ':' || row_id || '1:' || long_view), 1, 8)) AS BIGINT)) AS BIGINT) AS digest,
  count(*) AS row_count FROM imp GROUP BY split""", (IMP,))
def content_digest(spark, sf_dir):
    """Digest of the labels slice, independent of row order."""
    return C.content_digest(impressions(spark, sf_dir), ["user_id", "row_id", "long_view"], ["split"])


@query("metric_drift", """SELECT tab, round(e, 6) + 0.0 AS expected, round(a, 6) + 0.0 AS actual, abs(e - a) > 5e-7 AS drifted
FROM (SELECT tab, avg(long_view) AS e, avg(CASE WHEN tab = 'click' THEN 1 - long_view ELSE long_view END) AS a FROM imp GROUP BY tab)""", (IMP,))
def metric_drift(spark, sf_dir):
    """Recorded against recomputed metric; one group was altered."""
    rows = impressions(spark, sf_dir)
    e = rows.groupBy("tab").agg(F.avg("long_view").alias("m"))
    a = rows.groupBy("tab").agg(F.avg(F.when(F.col("tab") == "click", 1 - F.col("long_view")).otherwise(F.col("long_view"))).alias("m"))
    return rounded(C.metric_drift(e, a, ["tab"], "m"), "expected", "actual")


@query("misaligned_keys", "SELECT row_id, CASE WHEN split = 'valid' THEN 'rows' ELSE 'scores' END AS side FROM imp WHERE split IN ('valid', 'train')", (IMP,))
def misaligned_keys(spark, sf_dir):
    """Keys on one side only: valid rows have no score, train scores no row."""
    rows, scores = impressions(spark, sf_dir, ["valid", "test"]), impressions(spark, sf_dir, ["train", "test"])
    return C.misaligned(rows, scores)


# Notes of parts, from their type and name, in which the outcome words stand.
NOTES = """replace(replace(replace(p_type, 'PROMO', 'confirmed after a recovery'), 'ECONOMY', 'Negative'), 'LARGE', 'ERROR in setup')"""
WORDS = ("ERROR", "RECOVERY", "CONFIRMED", "NEGATIVE", "NEUTRAL", "DECLINED", "ABANDONED")


@query("run_outcomes", f"""SELECT p_partkey, array_to_string([w FOR w IN {list(WORDS)} IF contains(upper(note), w)], ' / ') AS outcome
FROM (SELECT p_partkey, concat_ws(' ', {NOTES}, replace(p_name, 'red', 'neutral')) AS note FROM part)""")
def run_outcomes(spark, sf_dir):
    """Outcome words found in the notes of every part, in fixed order."""
    from rankloom.operators.runs import outcome

    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_name")
    return p.select("p_partkey", outcome(F.expr(NOTES), F.expr("replace(p_name, 'red', 'neutral')")).alias("outcome"))
