"""Column expressions of the feature engine; all of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smoothing priors, the label's play-time threshold, and the caps
# of the ratio features.
PRIOR = 20.0
CROSS_PRIOR = 5.0
THRESHOLD_MS = 18000
PLAY_RATIO_CAP = 5.0
DURATION_RATIO_CAP = 20.0
MAX_DURATION_BUCKET = 40
MAX_SHOW_BUCKET = 16
MAX_LIKE_BUCKET = 12

# Ordinal codes of the range strings in the user side table.
ACTIVE_DEGREE = {
    "full_active": 4, "high_active": 3, "middle_active": 2, "2_14_day_new": 0, "low_active": 1,
    "single_low_active": 1, "30day_retention": 0, "day_new": 0, "UNKNOWN": 0,
}
FOLLOW_RANGE = {
    "0": 0, "(0,10]": 1, "(10,50]": 2, "(50,100]": 3, "(100,150]": 4, "(150,250]": 5, "(250,500]": 6, "500+": 7,
}
FANS_RANGE = {
    "0": 0, "[1,10)": 1, "[10,100)": 2, "[100,1k)": 3, "[1k,5k)": 4, "[5k,1w)": 5, "[1w,10w)": 6,
    "[10w,100w)": 6, "[100w,1000w)": 6,
}
FRIEND_RANGE = {"0": 0, "[1,5)": 1, "[5,30)": 2, "[30,60)": 3, "[60,120)": 4, "[120,250)": 5, "250+": 6}
REGISTER_RANGE = {
    "8-14": 0, "15-30": 0, "31-60": 1, "61-90": 2, "91-180": 3, "181-365": 4, "366-730": 5, "730+": 6,
}
VIDEO_TYPE = {"NORMAL": 1, "AD": 0, "UNKNOWN": 0}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def smooth(pos: Column, cnt: Column, prior_rate: Column, strength: float = PRIOR) -> Column:
    """Bayesian-smoothed rate; an unseen key (0, 0) gets the prior itself."""
    return (pos + strength * prior_rate) / (cnt + strength)


def mean_or(total: Column, cnt: Column, fallback: Column) -> Column:
    return F.when(cnt > 0, total / F.greatest(cnt, F.lit(1))).otherwise(fallback)


def hour_of(hourmin: Column | str) -> Column:
    """Hour of an hhmm integer."""
    return F.floor(col(hourmin) / 100).cast("int")


def wrapped_hour(hourmin: Column | str) -> Column:
    """Same, null read as 0 and wrapped into 0..23."""
    return F.pmod(F.floor(F.coalesce(col(hourmin), F.lit(0)) / 100), F.lit(24)).cast("int")


def play_ratio(play_ms: Column | str, duration_ms: Column | str) -> Column:
    return F.least(col(play_ms) / F.greatest(col(duration_ms), F.lit(1)), F.lit(PLAY_RATIO_CAP))


def threshold(duration: Column | str) -> Column:
    """Play time from which an impression counts as a long view."""
    return F.least(col(duration), F.lit(THRESHOLD_MS))


def threshold_ratio(duration: Column | str) -> Column:
    return threshold(duration) / F.greatest(col(duration), F.lit(1))


def margin(play_ms: Column | str, duration: Column | str) -> Column:
    return col(play_ms) - threshold(duration)


def code_of(value: Column | str, codes: Mapping[str, int]) -> Column:
    """Ordinal code of a string; unknown and null give 0."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(value)), F.lit(0))


def fixed_bucket(duration_ms: Column | str, width: float = 10_000.0, top: int = MAX_DURATION_BUCKET) -> Column:
    d = F.coalesce(col(duration_ms), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(top), (d / width).cast("int")))


def log_bucket(count: Column | str, top: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(top), F.log1p(col(count)).cast("int")))


def bucket_left(value: Column | str, edges: Column) -> Column:
    """Number of edges strictly below the value (left-sided search)."""
    return F.size(F.filter(edges, lambda e: e < col(value)))


def to_number(value: Column | str) -> Column:
    """Numeric parse, null where the text is not a number."""
    return col(value).try_cast("double")


def to_day(value: Column | str) -> Column:
    """Date parse, null where the text is not a date."""
    return col(value).try_cast("date")


def tag_list(tags: Column | str) -> Column:
    """Comma list as an array with empty and 'nan' entries kept in place."""
    return F.split(F.coalesce(col(tags), F.lit("")), ",")


def tag_at(tags: Column, n: int) -> Column:
    """n-th tag (1-based) as an integer; missing, empty, 'nan' or text gives 0."""
    t = F.try_element_at(tags, F.lit(n))
    return F.coalesce(F.when(~t.isin("", "nan"), t).try_cast("double").cast("long"), F.lit(0))


def first_tag_or_minus_one(tags: Column) -> Column:
    t = F.try_element_at(tags, F.lit(1))
    return F.coalesce(t.try_cast("double").cast("int"), F.lit(-1))


def tag_count(tags: Column) -> Column:
    return F.size(F.filter(tags, lambda t: (t != "") & (t != "nan"))).cast("double")


def aspect_clipped(width: Column | str, height: Column | str) -> Column:
    """Width over height with the height clipped at 1."""
    return col(width) / F.greatest(col(height), F.lit(1))


def aspect_or_zero(width: Column | str, height: Column | str) -> Column:
    """Width over height, 0 where the height is not positive."""
    return F.when(col(height) > 0, col(width) / col(height)).otherwise(F.lit(0.0))


def age_days(today: Column | str, upload: Column | str) -> Column:
    return F.datediff(col(today), col(upload))


def log_side(value: Column | str) -> Column:
    """log1p of a side-table number: null and negative values count as 0."""
    return F.log1p(F.greatest(F.coalesce(col(value).try_cast("double"), F.lit(0.0)), F.lit(0.0)))


def category_side(value: Column | str) -> Column:
    """Side-table category as a non-negative integer, null as 0."""
    return F.greatest(F.coalesce(col(value).try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast("long")


def category_text(value: Column | str) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit("NA"))


def label_of(text: Column | str) -> Column:
    """1 for anything but the text '0'."""
    return F.when(col(text) != "0", 1).otherwise(0)


def duration_gap(duration: Column | str, liked: Column | str) -> Column:
    return F.abs(col(duration) - col(liked))


def duration_ratio(duration: Column | str, liked: Column | str) -> Column:
    return F.least(col(duration) / F.greatest(col(liked), F.lit(1)), F.lit(DURATION_RATIO_CAP))


# Item statistics and the count each rate is relative to.
LOG_COUNTS = {"s_show_cnt": "show_cnt", "s_play_cnt": "play_cnt", "s_play_user_num": "play_user_num"}
PER_PLAY = {
    "s_complete_rate": "complete_play_cnt", "s_longtime_rate": "long_time_play_cnt",
    "s_shorttime_rate": "short_time_play_cnt", "s_valid_rate": "valid_play_cnt",
}
PER_SHOW = {
    "s_like_rate": "like_cnt", "s_comment_rate": "comment_cnt", "s_share_rate": "share_cnt",
    "s_collect_rate": "collect_cnt", "s_download_rate": "download_cnt", "s_follow_rate": "follow_cnt",
    "s_reduce_rate": "reduce_similar_cnt", "s_double_click_rate": "double_click_cnt",
}


def item_stat_columns() -> dict[str, Column]:
    """The 16 item-statistic features over an item-statistics table."""
    play = F.greatest(F.col("play_cnt"), F.lit(1))
    show = F.greatest(F.col("show_cnt"), F.lit(1))
    out = {o: F.log1p(F.col(c)) for o, c in LOG_COUNTS.items()}
    out["s_play_progress"] = F.col("play_progress")
    out |= {o: F.col(c) / play for o, c in PER_PLAY.items()}
    out |= {o: F.col(c) / show for o, c in PER_SHOW.items()}
    return out
