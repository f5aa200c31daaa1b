"""History-statistic queries.  Their SQL counts the pool rows of each row by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.metric_queries import pieces_cte
from rankloom.catalog.registry import IMP, ORD, query, r6, rounded
from rankloom.catalog.scalar_queries import duration_edges
from rankloom.functions import scalars as X
from rankloom.operators import metrics as M
from rankloom.operators import stats as S
from rankloom.sources.views import impressions, order_impressions, table

TRAIN = "train AS (SELECT * FROM imp WHERE split = 'train')"
MODE_SQL = {
    "past": "AND (r.split <> 'train' OR p.dayord < r.dayord)",
    "loo": "AND (r.split <> 'train' OR p.row_id <> r.row_id)",
    "insample": "",
}


def counts_cte(name: str, keys: list[str], sums: dict[str, str], mode: str, rows: str = "imp", pool: str = "train") -> str:
    """Per row of ``rows``: matching pool rows ``cnt`` and sums over them."""
    on = " AND ".join(f"p.{k} = r.{k}" for k in keys)
    cols = ", ".join(f"coalesce(sum({e}), 0) AS {o}" for o, e in sums.items())
    return (f"{name} AS (SELECT r.row_id, count(p.row_id) AS cnt{', ' + cols if cols else ''} FROM {rows} r "
            f"LEFT JOIN {pool} p ON {on} {MODE_SQL[mode]} GROUP BY r.row_id)")


def rate_sql(s: str, c: str, mean: str, prior: str = "20.0") -> str:
    return f"({s} + {prior} * ({mean})) / ({c} + {prior})"


def mean_of(expr: str) -> str:
    return f"SELECT avg({expr}) FROM train"


def out6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def load(spark, sf_dir):
    """All impressions and the train pool."""
    return impressions(spark, sf_dir), impressions(spark, sf_dir, ["train"])


def mode_query(name: str, mode: str):
    @query(name, f"SELECT row_id, cnt AS v_imp, CAST(s AS BIGINT) AS v_lv, "
                 f"{out6(rate_sql('s', 'cnt', mean_of('long_view')), 'v_lv_rate')} FROM k",
           (IMP, TRAIN, counts_cte("k", ["video_id"], {"s": "p.long_view"}, mode)))
    def run(spark, sf_dir):
        rows, train = load(spark, sf_dir)
        rows = rows.select("row_id", "split", "video_id", "dayord", "long_view")
        got = S.attach_counts(rows, train, ["video_id"], {"v_lv": "long_view"}, mode, "v_imp")
        rate = X.smooth(F.col("v_lv"), F.col("v_imp"), S.pool_mean(train, "long_view"))
        return got.select("row_id", "v_imp", "v_lv", r6(rate).alias("v_lv_rate"))

    run.__doc__ = f"Smoothed item rate, train rows in mode {mode}."
    return run


smoothed_rate = mode_query("smoothed_rate", "insample")
past_only_rate = mode_query("past_only_rate", "past")
loo_rate = mode_query("loo_rate", "loo")


@query("mean_fallback", f"""SELECT row_id, cnt AS u_cnt,
  {out6(f"CASE WHEN cnt > 0 THEN s / greatest(cnt, 1) ELSE ({mean_of('duration_ms')}) END", 'u_dur')} FROM k""",
       (IMP, TRAIN, counts_cte("k", ["user_id"], {"s": "p.duration_ms"}, "past")))
def mean_fallback(spark, sf_dir):
    """Past mean by user, pool mean where the user has no past."""
    rows, train = load(spark, sf_dir)
    got = S.attach_rates(rows.select("row_id", "split", "user_id", "dayord", "duration_ms"), train, ["user_id"], {},
                         {"u_dur": "duration_ms"}, "past", "u_cnt")
    return got.select("row_id", "u_cnt", r6("u_dur").alias("u_dur"))


RATIO = "least({0}play_time_ms / greatest({0}duration_ms, 1), 5)"
HATE = "CAST({0}play_time_ms < 3000 AS INTEGER)"  # a flag the driver's log does not carry, derived from play time
VALUES = {"long_view": "{0}long_view", "is_click": "{0}is_click", "is_hate": HATE, "ratio": RATIO, "play_time_ms": "{0}play_time_ms"}
BASE = {
    "v": (["video_id"], {"v_lv_rate": "long_view", "v_click_rate": "is_click", "v_hate_rate": "is_hate"},
          {"v_play_ratio": "ratio", "v_play_ms": "play_time_ms"}),
    "u": (["user_id"], {"u_lv_rate": "long_view", "u_click_rate": "is_click"}, {"u_play_ratio": "ratio"}),
    "a": (["author_id"], {"a_lv_rate": "long_view"}, {}),
}


def base_sql() -> str:
    cols = []
    for k, (_, rates, means) in BASE.items():
        cols.append(f"{k}.cnt AS {k}_imp")
        for n, c in rates.items():
            cols.append(out6(rate_sql(f"{k}.{c}", f"{k}.cnt", mean_of(VALUES[c].format(""))), n))
        for n, c in means.items():
            cols.append(out6(f"CASE WHEN {k}.cnt > 0 THEN {k}.{c} / greatest({k}.cnt, 1) ELSE ({mean_of(VALUES[c].format(''))}) END", n))
    return f"SELECT row_id, {', '.join(cols)} FROM v JOIN u USING (row_id) JOIN a USING (row_id)"


@query("base_rates", base_sql(), (IMP, TRAIN, *[
    counts_cte(k, keys, {c: VALUES[c].format("p.") for c in (*rates.values(), *means.values())}, "past")
    for k, (keys, rates, means) in BASE.items()]))
def base_rates(spark, sf_dir):
    """Item, user and author rates and means: one aggregate and one join per key."""
    rows, train = load(spark, sf_dir)
    derived = {"ratio": X.play_ratio("play_time_ms", "duration_ms"), "is_hate": F.expr(HATE.format(""))}
    rows, train = rows.withColumns(derived), train.withColumns(derived)
    names = []
    for k, (keys, rates, means) in BASE.items():
        rows = S.attach_rates(rows, train, keys, rates, means, "past", f"{k}_imp")
        names += [f"{k}_imp", *rates, *means]
    return rounded(rows.select("row_id", *names), *[n for n in names if not n.endswith("_imp")])


AUX = {"v_like_rate": "play_time_ms >= 80000", "v_comment_rate": "play_time_ms >= 90000",
       "v_forward_rate": "play_time_ms >= 120000", "v_penter_rate": "play_time_ms >= 70000"}


STAY = "play_time_ms % 7"  # stands for the profile stay time


def aux_columns(df):
    """Feedback flags the driver's log does not carry, derived from play time."""
    df = df.withColumns({f"y_{n}": F.expr(f"CAST({e} AS INT)") for n, e in AUX.items()})
    return df.withColumns({"margin_ms": X.margin("play_time_ms", "duration_ms"), "profile_stay_time": F.expr(STAY)})


@query("aux_rates", "SELECT row_id, " + ", ".join(
    [out6(rate_sql(f"v.{n}", "v.cnt", mean_of(f"CAST({e} AS INTEGER)")), n) for n, e in AUX.items()]
    + [out6(f"CASE WHEN {k}.cnt > 0 THEN {k}.m / greatest({k}.cnt, 1) ELSE ({mean_of('play_time_ms - least(duration_ms, 18000)')}) END",
            f"{k}_margin") for k in ("v", "u")]
    + [out6(f"CASE WHEN v.cnt > 0 THEN v.stay / greatest(v.cnt, 1) ELSE ({mean_of(STAY)}) END", "v_pstay")]) + " FROM v JOIN u USING (row_id)",
       (IMP, TRAIN,
        counts_cte("v", ["video_id"], {**{n: f"CAST(p.{e} AS INTEGER)" for n, e in AUX.items()},
                                       "m": "p.play_time_ms - least(p.duration_ms, 18000)", "stay": f"p.{STAY}"}, "past"),
        counts_cte("u", ["user_id"], {"m": "p.play_time_ms - least(p.duration_ms, 18000)"}, "past")))
def aux_rates(spark, sf_dir):
    """Rates of secondary feedback and mean margins over the label threshold."""
    rows, train = load(spark, sf_dir)
    train = aux_columns(train)
    rows = S.attach_rates(rows, train, ["video_id"], {n: f"y_{n}" for n in AUX}, {"v_margin": "margin_ms", "v_pstay": "profile_stay_time"},
                          "past", "_a")
    rows = S.attach_rates(rows, train, ["user_id"], {}, {"u_margin": "margin_ms"}, "past", "_b")
    names = [*AUX, "v_margin", "u_margin", "v_pstay"]
    return rounded(rows.select("row_id", *names), *names)


POS_DUR = counts_cte("d", ["user_id"], {"s": "p.duration_ms * p.long_view", "pos": "p.long_view"}, "past")
LV_DUR = """CASE WHEN pos > 0 THEN s / pos ELSE (SELECT avg(duration_ms) FROM train WHERE long_view = 1) END"""


@query("positive_duration", f"SELECT row_id, {out6(LV_DUR, 'u_lv_dur')} FROM d", (IMP, TRAIN, POS_DUR))
def positive_duration(spark, sf_dir):
    """Mean duration of the user's past positives."""
    rows, train = load(spark, sf_dir)
    rows = rows.select("row_id", "split", "user_id", "dayord", "duration_ms", "long_view")
    got = S.positive_mean(rows, train, ["user_id"], "duration_ms", "long_view", "u_lv_dur", "past")
    return got.select("row_id", r6("u_lv_dur").alias("u_lv_dur"))


@query("duration_affinity", f"""SELECT row_id, {out6('abs(duration_ms - q)', 'dur_diff')},
  {out6('least(duration_ms / greatest(q, 1), 20)', 'dur_ratio')}
FROM (SELECT row_id, duration_ms, {LV_DUR} AS q FROM d JOIN imp USING (row_id))""", (IMP, TRAIN, POS_DUR))
def duration_affinity(spark, sf_dir):
    """Distance and ratio of the item's duration to what the user liked."""
    rows, train = load(spark, sf_dir)
    rows = rows.select("row_id", "split", "user_id", "dayord", "duration_ms", "long_view")
    got = S.positive_mean(rows, train, ["user_id"], "duration_ms", "long_view", "q", "past")
    return got.select("row_id", r6(X.duration_gap("duration_ms", "q")).alias("dur_diff"),
                      r6(X.duration_ratio("duration_ms", "q")).alias("dur_ratio"))


CROSSES = {"ua": "author_id", "utab": "tab", "ud": "dur_bucket", "ut": "tag1"}
BUCKETED = """imp2 AS (SELECT *, tags[1] AS tag1, len([e for e in edges if e < duration_ms]) AS dur_bucket FROM imp,
  (SELECT quantile_cont(duration_ms, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM imp WHERE split = 'train')),
train2 AS (SELECT * FROM imp2 WHERE split = 'train')"""


@query("user_cross", "SELECT row_id, " + ", ".join(
    f"{k}.cnt AS {k}_cnt, " + out6(f"({k}.s + 5.0 * own) / ({k}.cnt + 5.0)", f"{k}_lv_rate") for k in CROSSES)
    + " FROM own JOIN " + " JOIN ".join(f"{k} USING (row_id)" for k in CROSSES),
       (IMP, TRAIN, BUCKETED, counts_cte("k", ["user_id"], {"s": "p.long_view"}, "past"),
        f"own AS (SELECT row_id, {rate_sql('s', 'cnt', mean_of('long_view'))} AS own FROM k)",
        *[counts_cte(k, ["user_id", c], {"s": "p.long_view"}, "past", "imp2", "train2") for k, c in CROSSES.items()]))
def user_cross(spark, sf_dir):
    """User x author, tab, duration-decile and first-tag rates, shrunk to the user's own past rate."""
    rows, train = load(spark, sf_dir)
    edges = duration_edges(train)

    def bucketed(df):
        df = df.withColumn("_edges", edges).withColumn("dur_bucket", X.bucket_left("duration_ms", F.col("_edges"))).drop("_edges")
        return df.withColumn("tag1", F.try_element_at("tags", F.lit(1)))

    rows, train = bucketed(rows), bucketed(train)
    rows = S.attach_rates(rows, train, ["user_id"], {"u_lv_rate": "long_view"}, {}, "past", "u_imp")
    names = []
    for k, c in CROSSES.items():
        rows = S.cross_rate(rows, train, ["user_id", c], "long_view", "u_lv_rate", f"{k}_lv_rate", f"{k}_cnt", "past")
        names += [f"{k}_cnt", f"{k}_lv_rate"]
    return rounded(rows.select("row_id", *names), *[f"{k}_lv_rate" for k in CROSSES])


@query("user_item_counts", "SELECT row_id, cnt AS uv_cnt, CAST(s AS BIGINT) AS uv_lv_cnt FROM k",
       (IMP, TRAIN, counts_cte("k", ["user_id", "video_id"], {"s": "p.long_view"}, "past")))
def user_item_counts(spark, sf_dir):
    """Earlier impressions and positives of the same user and item."""
    rows, train = load(spark, sf_dir)
    got = S.attach_counts(rows.select("row_id", "split", "user_id", "video_id", "dayord", "long_view"), train,
                          ["user_id", "video_id"], {"uv_lv_cnt": "long_view"}, "past", "uv_cnt")
    return got.select("row_id", "uv_cnt", "uv_lv_cnt")


TAG_MODE = {"past": MODE_SQL["past"], "loo": MODE_SQL["loo"], "insample": ""}


def tag_query(name: str, mode: str):
    @query(name, f"""SELECT row_id, {out6("avg((s + 5.0 * own) / (cnt + 5.0))", "utags_lv_rate")}, {out6("avg(cnt)", "utags_cnt")}
FROM (SELECT r.row_id, r.tag, count(p.row_id) AS cnt, coalesce(sum(p.long_view), 0) AS s
      FROM (SELECT row_id, split, user_id, dayord, unnest(tags) AS tag FROM imp) r
      LEFT JOIN (SELECT row_id, user_id, dayord, long_view, unnest(tags) AS tag FROM train) p
        ON p.user_id = r.user_id AND p.tag = r.tag {TAG_MODE[mode]} GROUP BY r.row_id, r.tag) JOIN own USING (row_id)
GROUP BY row_id""",
           (IMP, TRAIN, counts_cte("k", ["user_id"], {"s": "p.long_view"}, mode),
            f"own AS (SELECT row_id, {rate_sql('s', 'cnt', mean_of('long_view'))} AS own FROM k)"))
    def run(spark, sf_dir):
        rows, train = load(spark, sf_dir)
        rows = S.attach_rates(rows.select("row_id", "split", "user_id", "dayord", "long_view", "tags"), train,
                              ["user_id"], {"u_lv_rate": "long_view"}, {}, mode, "u_imp")
        got = S.tag_affinity(rows, train, ["row_id"], "user_id", "tags", "long_view", "u_lv_rate", mode)
        return rounded(got, "utags_lv_rate", "utags_cnt")

    run.__doc__ = f"Mean over the item's tags of the user's tag rate, train rows in mode {mode}."
    return run


multi_tag_affinity_past = tag_query("multi_tag_affinity_past", "past")
multi_tag_affinity_loo = tag_query("multi_tag_affinity_loo", "loo")
multi_tag_affinity_full = tag_query("multi_tag_affinity_full", "insample")


@query("popularity", """SELECT video_id, round((sum(long_view) + 20.0 * any_value(m)) / (count(*) + 20.0), 6) + 0.0 AS pop_score
FROM ord_imp, (SELECT avg(long_view) AS m FROM ord_imp WHERE split = 'train') WHERE split = 'train' GROUP BY video_id""", (ORD,))
def popularity(spark, sf_dir):
    """Smoothed positive rate per item of the order log."""
    train = order_impressions(spark, sf_dir, splits=["train"])
    return rounded(S.popularity(train, "video_id", "long_view"), "pop_score")


HIST = {"item_ctr": ["video_id"], "user_ctr": ["user_id"], "user_author_ctr": ["user_id", "author_id"],
        "user_hour_ctr": ["user_id", "hour"]}


@query("history_maps", "SELECT row_id, " + ", ".join(out6(rate_sql(f"{n}.s", f"{n}.cnt", mean_of("is_click")), n) for n in HIST)
       + ", " + out6("ln(1 + item_ctr.cnt)", "item_n") + ", " + out6("ln(1 + user_ctr.cnt)", "user_n")
       + " FROM item_ctr JOIN user_ctr USING (row_id) JOIN user_author_ctr USING (row_id) JOIN user_hour_ctr USING (row_id)",
       (IMP, TRAIN, *[counts_cte(n, k, {"s": "p.is_click"}, "insample") for n, k in HIST.items()]))
def history_maps(spark, sf_dir):
    """Train-fitted click rates and log counts by item, user, user-author, user-hour."""
    rows, train = load(spark, sf_dir)
    names = ["item_ctr", "item_n", "user_ctr", "user_n", "user_author_ctr", "user_hour_ctr"]
    got = S.history_maps(rows, train, "user_id", "video_id", "is_click")
    return rounded(got.select("row_id", *names), *names)


@query("tag_pop", """SELECT p_partkey, tag AS tag_pop, c AS tag_pop_cnt FROM (
  SELECT p_partkey, tag, c, row_number() OVER (PARTITION BY p_partkey ORDER BY c DESC, pos) AS rn
  FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)
       JOIN (SELECT tag, count(*) AS c FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag) USING (tag))
WHERE rn = 1""")
def tag_pop(spark, sf_dir):
    """Most frequent tag of each item, first one on ties."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("tags", F.split("p_name", " "))
    return S.tag_popularity(p, "p_partkey", "tags")


@query("mixed_weight", """SELECT row_id, CASE WHEN s > 0 AND s < c THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM (
  SELECT row_id, sum(long_view) OVER w AS s, count(*) OVER w AS c FROM imp WHERE split = 'train'
  WINDOW w AS (PARTITION BY user_id, date))""", (IMP,))
def mixed_weight(spark, sf_dir):
    """Down-weighted rows of single-class (user, day) lists."""
    train = impressions(spark, sf_dir, ["train"]).select("row_id", "user_id", "date", "long_view")
    return S.mixed_weight(train, ["user_id", "date"], "long_view", 0.3).select("row_id", "weight")


@query("group_sizes", "SELECT row_id, count(*) OVER (PARTITION BY split, user_id) AS list_size FROM imp", (IMP,))
def group_sizes(spark, sf_dir):
    """Length of the list each row belongs to."""
    rows = impressions(spark, sf_dir).select("row_id", "split", "user_id")
    return S.group_totals(rows, ["split", "user_id"], F.count(F.lit(1)).alias("list_size")).select("row_id", "list_size")


@query("label_rule_agreement", """SELECT split, count(*) AS row_count,
  round(avg(CAST(long_view = CAST(play_time_ms >= least(duration_ms, 18000) AS INTEGER) AS INTEGER)), 6) + 0.0 AS agreement
FROM imp GROUP BY split""", (IMP,))
def label_rule_agreement(spark, sf_dir):
    """Share of rows whose label equals the play-time rule."""
    rule = (F.col("play_time_ms") >= X.threshold("duration_ms")).cast("int")
    return impressions(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), r6(F.avg((F.col("long_view") == rule).cast("int"))).alias("agreement")
    )


@query("staleness", """SELECT pool, round(gauc, 6) + 0.0 AS gauc, round(ndcg, 6) + 0.0 AS ndcg_at_5, round((gauc + ndcg) / 2, 6) + 0.0 AS primary_score,
  users, row_count FROM (SELECT pool, coalesce(sum(npos * auc) / sum(CASE WHEN auc IS NOT NULL THEN npos END), 0.5) AS gauc,
  avg(ndcg) AS ndcg, count(*) AS users, CAST(sum(n) AS BIGINT) AS row_count FROM pieces GROUP BY pool)""",
       (IMP, """scored AS (SELECT r.row_id, r.user_id, r.long_view, g.pool, (coalesce(s, 0) + 20.0 * m) / (coalesce(c, 0) + 20.0) AS score
  FROM (SELECT * FROM imp WHERE split = 'valid') r,
       (SELECT pool, avg(long_view) AS m FROM (SELECT 'fresh' AS pool, long_view FROM imp WHERE dayord BETWEEN 7 AND 13
          UNION ALL SELECT 'stale', long_view FROM imp WHERE dayord BETWEEN 0 AND 6) GROUP BY pool) g
  LEFT JOIN (SELECT CASE WHEN dayord >= 7 THEN 'fresh' ELSE 'stale' END AS pool, video_id, sum(long_view) AS s, count(*) AS c
             FROM imp WHERE dayord <= 13 GROUP BY 1, 2) p ON p.pool = g.pool AND p.video_id = r.video_id)""",
        pieces_cte("pieces", "scored", "pool, user_id", "row_id")))
def staleness(spark, sf_dir):
    """The same valid rows scored from two pools of equal length and different age."""
    valid, train = impressions(spark, sf_dir, ["valid"]), impressions(spark, sf_dir, ["train"])
    pools = {"fresh": train.where("dayord BETWEEN 7 AND 13"), "stale": train.where("dayord BETWEEN 0 AND 6")}
    parts = [S.score_popularity(valid, p, "video_id", "long_view").withColumn("pool", F.lit(n)) for n, p in pools.items()]
    m = M.evaluate(parts[0].unionByName(parts[1]), ["pool"], "user_id", "long_view", "score", ["row_id"])
    return rounded(m, "gauc", "ndcg_at_5", "primary_score")
