"""Scans, splits, projections and dimension joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import IMP, ORD, query, r6, rounded
from rankloom.functions import scalars as X
from rankloom.operators import encode as E
from rankloom.operators import splits as P
from rankloom.operators import stats as S
from rankloom.operators.ordering import exact_quantiles
from rankloom.sources.views import impressions, order_impressions, table

ROW = ("row_id", "user_id", "video_id", "date", "long_view", "split")


@query("union_scan", "SELECT row_id, user_id, video_id, date, long_view, split FROM imp", (IMP,))
def union_scan(spark, sf_dir):
    """Two period scans put together by name."""
    return impressions(spark, sf_dir, ["train"]).select(*ROW).unionByName(
        impressions(spark, sf_dir, ["valid", "test"]).select(*ROW)
    )


@query("labels_slice", "SELECT split, user_id, row_id, long_view FROM imp", (IMP,))
def labels_slice(spark, sf_dir):
    """Labels per split, ordered by user and row."""
    return impressions(spark, sf_dir).select("split", "user_id", "row_id", "long_view").orderBy(
        "split", "user_id", "row_id"
    )


@query("date_split", """SELECT row_id, date, CASE WHEN date BETWEEN 20240101 AND 20240114 THEN 'train'
  WHEN date BETWEEN 20240115 AND 20240121 THEN 'valid' WHEN date BETWEEN 20240122 AND 20240130 THEN 'test' END AS split
FROM imp""", (IMP,))
def date_split(spark, sf_dir):
    """Inclusive integer date ranges."""
    ranges = {"train": (20240101, 20240114), "valid": (20240115, 20240121), "test": (20240122, 20240130)}
    return P.date_split(impressions(spark, sf_dir).select("row_id", "date"), ranges)


@query("time_fraction_split", """SELECT row_id, CASE WHEN row_number() OVER (ORDER BY time_us, row_id)
  <= floor(count(*) OVER () * 0.4) THEN 'valid' ELSE 'test' END AS part FROM imp WHERE split <> 'train'""", (IMP,))
def time_fraction_split(spark, sf_dir):
    """First 40 % of the late period by time."""
    late = impressions(spark, sf_dir, ["valid", "test"]).withColumn(
        "period", F.when(F.col("split") == "train", "early").otherwise("late")
    )
    return P.time_fraction_split(late, ["period"], 0.4, ["row_id"]).select("row_id", "part")


@query("split_selection", "SELECT row_id, user_id, date FROM imp WHERE split = 'valid'", (IMP,))
def split_selection(spark, sf_dir):
    """One split only; the date range reaches the Parquet scan."""
    return impressions(spark, sf_dir, ["valid"]).select("row_id", "user_id", "date")


@query("pool_override", """SELECT r.row_id, count(p.row_id) AS v_imp,
  round((coalesce(sum(p.long_view), 0) + 20 * (SELECT avg(long_view) FROM pool)) / (count(p.row_id) + 20), 6) + 0.0
    AS v_lv_rate
FROM imp r LEFT JOIN pool p USING (video_id) WHERE r.split = 'valid' GROUP BY r.row_id""",
       (IMP, "pool AS (SELECT * FROM imp WHERE date BETWEEN 20240108 AND 20240114)"))
def pool_override(spark, sf_dir):
    """Valid rows scored by statistics of one week."""
    pool = P.pool_of(impressions(spark, sf_dir), 20240108, 20240114)
    out = S.attach_rates(impressions(spark, sf_dir, ["valid"]), pool, ["video_id"], {"v_lv_rate": "long_view"},
                         mode="past", count="v_imp")
    return rounded(out.select("row_id", "v_imp", "v_lv_rate"), "v_lv_rate")


@query("split_summary", """SELECT split, count(*) AS row_count, count(DISTINCT user_id) AS users,
  round(avg(is_click), 6) + 0.0 AS click_rate FROM imp GROUP BY split""", (IMP,))
def split_summary(spark, sf_dir):
    """Rows, users and click rate per split."""
    return impressions(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("user_id").alias("users"),
        r6(F.avg("is_click")).alias("click_rate"),
    )


@query("log_coverage", """SELECT split, min(date) AS first_date, max(date) AS last_date, count(*) AS row_count,
  round(avg(CAST(tab = 'error' AS INTEGER)), 6) + 0.0 AS marked_share FROM imp GROUP BY split""", (IMP,))
def log_coverage(spark, sf_dir):
    """Date range of each split and the share of specially marked rows."""
    return impressions(spark, sf_dir).groupBy("split").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("row_count"),
        r6(F.avg((F.col("tab") == "error").cast("int"))).alias("marked_share"),
    )


@query("calendar_parts", """SELECT event_id AS row_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS dayord,
  CAST(hour(ts) AS INTEGER) AS hour, CAST((hour(ts) + 20) % 24 AS INTEGER) AS hour_wrapped,
  CAST(isodow(ts) - 1 AS INTEGER) AS dow FROM events""")
def calendar_parts(spark, sf_dir):
    """Day ordinal, hour of an hhmm integer (plain and wrapped), Monday-based weekday."""
    hm = F.hour("ts") * 100 + F.minute("ts")
    e = table(spark, sf_dir, "events", "event_id", "ts").withColumn("hourmin", hm)
    return e.select(
        F.col("event_id").alias("row_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("dayord"),
        X.hour_of("hourmin").alias("hour"), X.wrapped_hour(F.col("hourmin") + 2000).alias("hour_wrapped"),
        F.weekday("ts").alias("dow"),
    )


@query("ratio_log", """SELECT row_id, round(ln(1 + duration_ms), 6) + 0.0 AS log_dur,
  round(least(play_time_ms / greatest(duration_ms, 1), 5), 6) + 0.0 AS play_ratio FROM imp""", (IMP,))
def ratio_log(spark, sf_dir):
    """log1p duration and capped play ratio."""
    return impressions(spark, sf_dir).select(
        "row_id", r6(F.log1p("duration_ms")).alias("log_dur"),
        r6(X.play_ratio("play_time_ms", "duration_ms")).alias("play_ratio"),
    )


@query("label_threshold", """SELECT row_id, least(duration_ms, 18000) AS thresh_ms,
  round(least(duration_ms, 18000) / greatest(duration_ms, 1), 6) + 0.0 AS thresh_ratio,
  round(play_time_ms - least(duration_ms, 18000), 6) + 0.0 AS margin_ms FROM imp""", (IMP,))
def label_threshold(spark, sf_dir):
    """Play time the label asks for, its ratio, and the margin over it."""
    return impressions(spark, sf_dir).select(
        "row_id", X.threshold("duration_ms").alias("thresh_ms"), r6(X.threshold_ratio("duration_ms")).alias("thresh_ratio"),
        r6(X.margin("play_time_ms", "duration_ms")).alias("margin_ms"),
    )


@query("null_default", """SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def null_default(spark, sf_dir):
    """Missing side values replaced column by column."""
    d = table(spark, sf_dir, "documents", "doc_id")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").na.fill({"quality": 0, "toxic": -1})


@query("coerce_parse", """SELECT event_id AS row_id, TRY_CAST(substr(props, 7, 2) AS DOUBLE) AS num,
  strftime(TRY_CAST('2024-' || lpad(CAST(event_id % 15 AS VARCHAR), 2, '0') || '-10' AS DATE), '%Y-%m-%d') AS day
FROM events""")
def coerce_parse(spark, sf_dir):
    """Text that is no number or no date becomes null."""
    e = table(spark, sf_dir, "events", "event_id", "props")
    month = F.lpad((F.col("event_id") % 15).cast("string"), 2, "0")
    return e.select(
        F.col("event_id").alias("row_id"), X.to_number(F.substring("props", 7, 2)).alias("num"),
        F.date_format(X.to_day(F.concat(F.lit("2024-"), month, F.lit("-10"))), "yyyy-MM-dd").alias("day"),
    )


RANGE = """CASE WHEN c_acctbal < 0 THEN '0' WHEN c_acctbal < 1000 THEN '(0,10]' WHEN c_acctbal < 3000 THEN '(10,50]'
  WHEN c_acctbal < 5000 THEN '(50,100]' WHEN c_acctbal < 7000 THEN '500+' ELSE 'other' END"""


@query("code_map", f"""SELECT c_custkey, CASE {RANGE} WHEN '(0,10]' THEN 1 WHEN '(10,50]' THEN 2 WHEN '(50,100]' THEN 3
  WHEN '500+' THEN 7 ELSE 0 END AS code FROM customer""")
def code_map(spark, sf_dir):
    """Ordinal codes of range strings, unknown ones 0."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").withColumn("range", F.expr(RANGE))
    return c.select("c_custkey", X.code_of("range", X.FOLLOW_RANGE).alias("code"))


@query("fixed_bucket", """SELECT row_id, greatest(0, least(40, CAST(trunc(duration_ms / 10000) AS INTEGER))) AS duration_bucket,
  greatest(0, least(16, CAST(trunc(ln(1 + play_time_ms)) AS INTEGER))) AS show_bucket,
  greatest(0, least(12, CAST(trunc(ln(1 + play_time_ms * 100)) AS INTEGER))) AS like_bucket FROM imp""", (IMP,))
def fixed_bucket(spark, sf_dir):
    """Clipped fixed-width and log buckets."""
    return impressions(spark, sf_dir).select(
        "row_id", X.fixed_bucket("duration_ms").alias("duration_bucket"),
        X.log_bucket("play_time_ms", X.MAX_SHOW_BUCKET).alias("show_bucket"),
        X.log_bucket(F.col("play_time_ms") * 100, X.MAX_LIKE_BUCKET).alias("like_bucket"),
    )


DECILES = [i / 10 for i in range(1, 10)]


def duration_edges(train, value="duration_ms"):
    """Deciles of the train durations as a scalar array."""
    return exact_quantiles(train.select(F.lit("train").alias("_pool"), value), ["_pool"], value, DECILES).agg(
        F.first("quantiles").alias("q")
    ).scalar()


@query("quantile_bucket", """SELECT row_id, len([e for e in edges if e < duration_ms]) AS dur_bucket
FROM imp, (SELECT quantile_cont(duration_ms, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges
           FROM imp WHERE split = 'train')""", (IMP,))
def quantile_bucket(spark, sf_dir):
    """Deciles of train, left-sided search."""
    edges = duration_edges(impressions(spark, sf_dir, ["train"]))
    rows = impressions(spark, sf_dir).select("row_id", "duration_ms").withColumn("_edges", edges)
    return rows.select("row_id", X.bucket_left("duration_ms", F.col("_edges")).cast("long").alias("dur_bucket"))


TAG_TEXT = """CASE WHEN video_id % 7 = 0 THEN 'nan' WHEN video_id % 11 = 0 THEN '' WHEN video_id % 5 = 0
  THEN CAST(video_id % 8 AS {s}) ELSE concat(CAST(video_id % 8 AS {s}), ',', CAST(100 + video_id % 5 AS {s})) END"""


@query("tag_parts", f"""SELECT row_id,
  coalesce(TRY_CAST(CASE WHEN t[1] NOT IN ('', 'nan') THEN t[1] END AS BIGINT), 0) AS tag_a,
  coalesce(TRY_CAST(CASE WHEN t[2] NOT IN ('', 'nan') THEN t[2] END AS BIGINT), 0) AS tag_b,
  CAST(len([x for x in t if x <> '' AND x <> 'nan']) AS DOUBLE) AS n_tags,
  CASE WHEN t[1] IN ('', 'nan') THEN -1 ELSE CAST(t[1] AS INTEGER) END AS tag1
FROM (SELECT row_id, string_split({TAG_TEXT.format(s="VARCHAR")}, ',') AS t FROM imp)""", (IMP,))
def tag_parts(spark, sf_dir):
    """First tag, second tag and tag count of a comma list with empty and 'nan' entries."""
    rows = impressions(spark, sf_dir).withColumn("tag", F.expr(TAG_TEXT.format(s="STRING")))
    t = X.tag_list("tag")
    clean = F.transform(t, lambda x: F.when(x != "nan", x))
    return rows.select(
        "row_id", X.tag_at(t, 1).alias("tag_a"), X.tag_at(t, 2).alias("tag_b"), X.tag_count(t).alias("n_tags"),
        X.first_tag_or_minus_one(clean).alias("tag1"),
    )


@query("aspect_ratio", """SELECT p_partkey, round(p_size / greatest(p_size % 7, 1), 6) + 0.0 AS aspect,
  round(CASE WHEN p_size % 7 > 0 THEN p_size / (p_size % 7) ELSE 0 END, 6) + 0.0 AS aspect_guarded FROM part""")
def aspect_ratio(spark, sf_dir):
    """Two guards against a zero height."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("h", F.col("p_size") % 7)
    return p.select(
        "p_partkey", r6(X.aspect_clipped("p_size", "h")).alias("aspect"),
        r6(X.aspect_or_zero("p_size", "h")).alias("aspect_guarded"),
    )


@query("content_age", """SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS upload_age
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def content_age(spark, sf_dir):
    """Whole days between two dates."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", X.age_days("l_shipdate", "o_orderdate").alias("upload_age")
    )


# Item statistics of the order log: every raw count the rate features are made of.
ITEM_COUNTS = {
    "show_cnt": "count(*)", "play_cnt": "count(CASE WHEN l_returnflag <> 'N' THEN 1 END)",
    "play_user_num": "count(DISTINCT l_suppkey)", "play_progress": "avg(CAST(round(l_discount * 100) AS BIGINT)) / 100",
    **{c: f"count(CASE WHEN l_linenumber = {i} THEN 1 END)" for i, c in enumerate(
        ["complete_play_cnt", "long_time_play_cnt", "short_time_play_cnt", "valid_play_cnt"], start=1)},
    **{c: f"count(CASE WHEN l_quantity > {45 - 5 * i} THEN 1 END)" for i, c in enumerate(
        ["like_cnt", "comment_cnt", "share_cnt", "collect_cnt", "download_cnt", "follow_cnt", "reduce_similar_cnt",
         "double_click_cnt"])},
}
STAT_SQL = ", ".join(
    [f"ln(1 + {c}) AS {o}" for o, c in X.LOG_COUNTS.items()] + ["play_progress AS s_play_progress"]
    + [f"{c} / greatest(play_cnt, 1) AS {o}" for o, c in X.PER_PLAY.items()]
    + [f"{c} / greatest(show_cnt, 1) AS {o}" for o, c in X.PER_SHOW.items()]
)
STAT_NAMES = [*X.LOG_COUNTS, "s_play_progress", *X.PER_PLAY, *X.PER_SHOW]


def item_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
               "l_returnflag")
    return li.groupBy(F.col("l_partkey").alias("item")).agg(*[F.expr(f"{e} AS {n}") for n, e in ITEM_COUNTS.items()])


@query("item_stat_rates", "SELECT item, " + ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in STAT_NAMES)
       + f" FROM (SELECT item, {STAT_SQL} FROM (SELECT l_partkey AS item, "
       + ", ".join(f"{e} AS {n}" for n, e in ITEM_COUNTS.items()) + " FROM lineitem GROUP BY l_partkey))")
def item_stat_rates(spark, sf_dir):
    """16 item-statistic features: log counts, per-play and per-show rates."""
    cols = X.item_stat_columns()
    return item_statistics(spark, sf_dir).select("item", *[r6(cols[n]).alias(n) for n in STAT_NAMES])


@query("side_log", """SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) + 0.0 AS acctbal_log,
  CAST(greatest(c_nationkey - 5, 0) AS BIGINT) AS nation_cat FROM customer""")
def side_log(spark, sf_dir):
    """Side numbers clipped at 0 and logged, side categories clipped at 0."""
    return table(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(
        "c_custkey", r6(X.log_side("c_acctbal")).alias("acctbal_log"),
        X.category_side(F.col("c_nationkey") - 5).alias("nation_cat"),
    )


@query("category_na", """SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'NA') AS quality
FROM documents LEFT JOIN labels USING (doc_id)""")
def category_na(spark, sf_dir):
    """Missing category as text."""
    d = table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", X.category_text("quality").alias("quality"))


@query("seeded_sample", "SELECT row_id, user_id FROM imp ORDER BY substr(md5('7:' || row_id), 1, 8), row_id LIMIT 500",
       (IMP,))
def seeded_sample(spark, sf_dir):
    """Exactly 500 rows chosen by a seeded hash."""
    return P.seeded_sample(impressions(spark, sf_dir).select("row_id", "user_id"), 500, 7)


@query("label_coercion", "SELECT row_id, CASE WHEN CAST(video_id % 3 AS VARCHAR) <> '0' THEN 1 ELSE 0 END AS label FROM imp",
       (IMP,))
def label_coercion(spark, sf_dir):
    """Any text but '0' is a positive."""
    return impressions(spark, sf_dir).select("row_id", X.label_of((F.col("video_id") % 3).cast("string")).alias("label"))


INLIST_COLUMNS = {"tags": ["tag_a", "tag_b", "n_tags"], "res": ["server_width", "server_height", "aspect"], "time": ["time_rank", "time_z"]}


def inlist_sql(mode: str) -> str:
    """One mode's rows; columns of other groups are null."""
    picked = [c for g, cols in INLIST_COLUMNS.items() if mode in (g, "all") for c in cols]
    return f"SELECT row_id, '{mode}' AS mode, " + ", ".join(
        c if c in picked else f"NULL AS {c}" for cols in INLIST_COLUMNS.values() for c in cols) + " FROM inlist"


@query("inlist_modes", " UNION ALL ".join(inlist_sql(m) for m in ("all", "tags", "res", "time")), (IMP, """inlist AS (
  SELECT row_id, CAST(tags[1] AS BIGINT) AS tag_a, CAST(tags[2] AS BIGINT) AS tag_b, 2.0 AS n_tags,
    coalesce(CAST(p_size AS DOUBLE), 0) AS server_width, coalesce(CAST(p_partkey % 40 AS DOUBLE), 0) AS server_height,
    CASE WHEN p_partkey % 40 > 0 THEN round(p_size / (p_partkey % 40), 6) + 0.0 ELSE 0 END AS aspect,
    row_number() OVER (PARTITION BY split, user_id ORDER BY time_us, row_id) AS time_rank,
    round((time_us - avg(time_us) OVER w) / coalesce(nullif(stddev_samp(time_us) OVER w, 0), 1), 4) + 0.0 AS time_z
  FROM imp LEFT JOIN part ON p_partkey = video_id WINDOW w AS (PARTITION BY split, user_id))""",))
def inlist_modes(spark, sf_dir):
    """The in-list columns of each mode, computed for every impression."""
    from rankloom.plans.features import build_inlist

    rows = impressions(spark, sf_dir).select("row_id", "split", "user_id", "video_id", "time_us", F.transform("tags", lambda t: t.cast("string")).alias("tags"))
    items = table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").cast("int").alias("video_id"), F.col("p_size").alias("server_width"), (F.col("p_partkey") % 40).alias("server_height"))
    out = None
    for mode in ("all", "tags", "res", "time"):
        df = build_inlist(rows, items, mode).withColumn("mode", F.lit(mode))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumns({"aspect": r6("aspect"), "time_z": F.round("time_z", 4) + 0.0})


@query("dim_lookup", """SELECT c_mktsegment, p_brand, count(*) AS row_count, CAST(sum(long_view) AS BIGINT) AS positives,
  round(avg(coalesce(p_size, 0)), 6) + 0.0 AS mean_size
FROM ord_imp LEFT JOIN part ON video_id = p_partkey LEFT JOIN customer ON user_id = c_custkey
GROUP BY c_mktsegment, p_brand""", (ORD,))
def dim_lookup(spark, sf_dir):
    """Item and user side joined to the log; Spark sizes both sides from the files."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    o = order_impressions(spark, sf_dir)
    j = o.join(p, o.video_id == p.p_partkey, "left").join(c, o.user_id == c.c_custkey, "left")
    return j.groupBy("c_mktsegment", "p_brand").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("long_view").alias("positives"),
        r6(F.avg(F.coalesce("p_size", F.lit(0)))).alias("mean_size"),
    )


@query("composite_lookup", """SELECT r.row_id, coalesce(d.c, 0) AS shown FROM imp r LEFT JOIN
  (SELECT user_id, tab, count(*) AS c FROM imp WHERE split = 'train' GROUP BY user_id, tab) d USING (user_id, tab)""", (IMP,))
def composite_lookup(spark, sf_dir):
    """Two-column key with a default."""
    d = impressions(spark, sf_dir, ["train"]).groupBy("user_id", "tab").agg(F.count(F.lit(1)).alias("shown"))
    return impressions(spark, sf_dir).join(d, ["user_id", "tab"], "left").select(
        "row_id", F.coalesce("shown", F.lit(0)).alias("shown")
    )


@query("tag_explode_join", """SELECT tag, count(*) AS row_count, CAST(sum(long_view) AS BIGINT) AS positives
FROM (SELECT unnest(tags) AS tag, long_view FROM ord_imp) GROUP BY tag""", (ORD,))
def tag_explode_join(spark, sf_dir):
    """Impressions joined to the exploded tags of their item."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    tags = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    o = order_impressions(spark, sf_dir)
    return o.join(tags, o.video_id == tags.p_partkey).groupBy("tag").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("long_view").alias("positives")
    )


@query("dedup_dim", """SELECT l_partkey, l_suppkey AS first_supplier, round(mean_cents, 6) + 0.0 AS mean_cents FROM (
  SELECT l_partkey, l_suppkey, avg(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (PARTITION BY l_partkey) AS mean_cents,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem)
WHERE rn = 1""")
def dedup_dim(spark, sf_dir):
    """One row per key: the first by a total order, and the mean of the duplicates."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return li.groupBy("l_partkey").agg(
        first.getField("l_suppkey").alias("first_supplier"), r6(F.avg(F.round(F.col("l_extendedprice") * 100).cast("long"))).alias("mean_cents")
    )


@query("coalesce_join", """SELECT row_id, coalesce(CASE WHEN i.video_id % 3 <> 0 THEN i.author_id END, d.author_id, -1) AS author_id
FROM imp i LEFT JOIN (SELECT video_id, min(author_id) AS author_id FROM imp WHERE split = 'train' GROUP BY video_id) d
  ON i.video_id = d.video_id""", (IMP,))
def coalesce_join(spark, sf_dir):
    """A column of the log wins, the dimension fills its gaps."""
    rows = impressions(spark, sf_dir).select(
        "row_id", "video_id", F.when(F.col("video_id") % 3 != 0, F.col("author_id")).alias("author_id")
    )
    d = impressions(spark, sf_dir, ["train"]).groupBy("video_id").agg(F.min("author_id").alias("_dim"))
    return rows.join(d, "video_id", "left").select("row_id", F.coalesce("author_id", "_dim", F.lit(-1)).alias("author_id"))


FIELDS = ["user_id", "video_id", "author_id", "tab"]
VOCAB = """vocab AS (
  SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY first_row, value) AS idx FROM (
    SELECT field, value, min(row_id) AS first_row FROM (
      SELECT row_id, unnest(['user_id', 'video_id', 'author_id', 'tab']) AS field,
             unnest([CAST(user_id AS VARCHAR), CAST(video_id AS VARCHAR), CAST(author_id AS VARCHAR), tab]) AS value
      FROM imp WHERE split = 'train') GROUP BY field, value))"""


@query("vocab_fit", "SELECT field, value, idx FROM vocab", (IMP, VOCAB))
def vocab_fit(spark, sf_dir):
    """Train vocabulary by first appearance."""
    return E.fit_vocab(impressions(spark, sf_dir, ["train"]), FIELDS)


@query("vocab_encode", """SELECT row_id, coalesce(u.idx, 0) AS user_id_idx, coalesce(v.idx, 0) AS video_id_idx FROM imp
  LEFT JOIN vocab u ON u.field = 'user_id' AND u.value = CAST(user_id AS VARCHAR)
  LEFT JOIN vocab v ON v.field = 'video_id' AND v.value = CAST(video_id AS VARCHAR)""", (IMP, VOCAB))
def vocab_encode(spark, sf_dir):
    """Encoded user and item of every row; unseen values are 0."""
    vocab = E.fit_vocab(impressions(spark, sf_dir, ["train"]), ["user_id", "video_id"])
    rows = impressions(spark, sf_dir).select("row_id", "user_id", "video_id")
    return E.encode_vocab(rows, vocab, ["user_id", "video_id"]).select("row_id", "user_id_idx", "video_id_idx")


@query("vocab_decode", """SELECT row_id, coalesce(idx, 0) AS video_id_idx, value AS original
FROM imp LEFT JOIN vocab ON field = 'video_id' AND value = CAST(video_id AS VARCHAR)""", (IMP, VOCAB))
def vocab_decode(spark, sf_dir):
    """Back from the encoded item to its original id."""
    vocab = E.fit_vocab(impressions(spark, sf_dir, ["train"]), ["video_id"])
    rows = E.encode_vocab(impressions(spark, sf_dir).select("row_id", "video_id"), vocab, ["video_id"])
    return E.decode_vocab(rows.drop("video_id"), vocab, "video_id", "video_id_idx", "original")


@query("field_offsets", """SELECT row_id, coalesce(u.idx - 1, nu) AS user_id_slot, nu + 1 + coalesce(v.idx - 1, nv) AS video_id_slot,
  nu + nv + 2 + coalesce(t.idx - 1, nt) AS tab_slot
FROM imp LEFT JOIN vocab u ON u.field = 'user_id' AND u.value = CAST(user_id AS VARCHAR)
  LEFT JOIN vocab v ON v.field = 'video_id' AND v.value = CAST(video_id AS VARCHAR)
  LEFT JOIN vocab t ON t.field = 'tab' AND t.value = tab,
  (SELECT count(CASE WHEN field = 'user_id' THEN 1 END) AS nu, count(CASE WHEN field = 'video_id' THEN 1 END) AS nv,
          count(CASE WHEN field = 'tab' THEN 1 END) AS nt FROM vocab)""", (IMP, VOCAB))
def field_offsets(spark, sf_dir):
    """One index space over the fields, unseen slot last per field."""
    fields = ["user_id", "video_id", "tab"]
    vocab = E.fit_vocab(impressions(spark, sf_dir, ["train"]), fields)
    return E.encode_offsets(impressions(spark, sf_dir).select("row_id", *fields), vocab, fields).select(
        "row_id", "user_id_slot", "video_id_slot", "tab_slot"
    )
