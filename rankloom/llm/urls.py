"""URL filter: rules by host and path, and for the rest trust and distrust that spread over host links.

Pages that a rule allows make their hosts trusted seeds, pages that a rule blocks make theirs blocked seeds.
Trust is a personalised PageRank from the trusted seeds along links; distrust is one from the blocked seeds along
reversed links (who links to blocked hosts is suspect). A page that no rule fits gets its host's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import forget, stored

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; of equally long ones block wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, hops: int = 4) -> DataFrame:
    """(host, rank): personalised PageRank over the weighted links (a, b, w) from ``seeds`` (host, weight).

    What reaches a host without links ends there. The rank is the sum of the waves that go out from the seeds, one
    link further each; a round sends ``hops`` of them. It ends when all later waves together cannot hold more than
    ``tolerance`` and the last round reached no new host, so the end of a long chain has its (small) share too.
    """
    out_weight = edges.groupBy("a").agg(F.sum("w").alias("total"))
    share = stored(edges.join(out_weight, "a").select("a", "b", (F.col("w") / F.col("total")).alias("share")), "shares")
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    rank = stored(seeds.select("host", (F.col("weight") / F.lit(float(total)) * (1 - damping)).alias("rank")), "ranks")
    wave, reached, old = rank, rank.count(), None
    while True:
        waves = None
        for hop in range(1, hops + 1):
            met = share.join(wave.withColumnRenamed("host", "a"), "a").groupBy(F.col("b").alias("host"))
            wave = met.agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
            one = wave.withColumn("hop", F.lit(hop))
            waves = one if waves is None else waves.union(one)
        waves = stored(waves, "waves")
        fresh = stored(rank.union(waves.select("host", "rank")).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
        wave = waves.where(F.col("hop") == hops).select("host", "rank")
        left, now = wave.agg(F.sum("rank")).first()[0], fresh.count()
        forget(rank, *([old] if old is not None else []))
        rank, old = fresh, waves
        if not left or (left * damping / (1 - damping) <= tolerance and now == reached):
            return rank
        reached = now


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, w): links between different hosts in the whole html, w pages linking."""
    found = pages.select("host", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("html", F.lit(LINK), 1), lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("x:"), u)).otherwise(u))))).alias("b"))
    return found.where("b <> '' and host <> '' and b <> host").groupBy(F.col("host").alias("a"), "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def judge(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 0.5, tolerance: float = 1e-9,
          page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, host_distrust): one row per input row.

    ``host_distrust`` is distrust / (trust + distrust), 0 where neither reached the host; a page without a rule is
    blocked above ``threshold``. A null url, or one without ``://``, has host and path empty, no rule, and is
    allowed; a null html has no links. Ids are only carried, so null and repeated ones do no harm.
    """
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    src = src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = src.withColumn("m", rule_for(F.col("host"), F.col("path"), rules))
    flat = stored(ruled.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("ruled")), "pages")
    links = stored(host_links(src), "links")
    seeds = stored(flat.where("ruled is not null").groupBy("host").agg(
        F.count(F.when(F.col("ruled") == "allow", 1)).cast("double").alias("allow"), F.count(F.when(F.col("ruled") == "block", 1)).cast("double").alias("block")), "seeds")
    trust = spread(links, seeds.where("allow > 0").select("host", F.col("allow").alias("weight")), damping, tolerance)
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    distrust = spread(back, seeds.where("block > 0").select("host", F.col("block").alias("weight")), damping, tolerance)
    hosts = stored(trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "hosts")
    bad = F.when(F.col("trust") + F.col("distrust") > 0, F.col("distrust") / (F.col("trust") + F.col("distrust"))).otherwise(0.0)
    return flat.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.coalesce(bad, F.lit(0.0)) > threshold, "block").otherwise("allow")).alias("verdict"),
        F.coalesce(bad, F.lit(0.0)).alias("host_distrust"))
