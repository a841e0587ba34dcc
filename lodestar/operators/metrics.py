"""Counts, diversity and summaries over plans, places and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import half_up, trip_sustainability
from ..sources.shared import materialise


def value_share(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share_pct) of a column."""
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("share_pct"))


def gini(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(system, gini) over the whole catalogue: ``counts(system, n)`` and ``catalogue(size)``.

    Items never chosen only shift ranks, so they are not materialised.  Equal
    counts are ranked together, which gives the same sum: a group of m equal
    values below which b lie has mean rank b + (m + 1) / 2.
    """
    by = counts.groupBy("system", "n").agg(F.count("*").alias("m"))
    w = Window.partitionBy("system").orderBy("n")
    by = by.withColumn("below", F.sum("m").over(w) - F.col("m"))
    tot = by.groupBy("system").agg(F.sum("m").alias("items"), F.sum(F.col("m") * F.col("n")).alias("total"))
    j = by.join(tot, "system").crossJoin(F.broadcast(catalogue.select("size")))
    full = F.greatest(F.col("size"), F.col("items"))
    rank = full - F.col("items") + F.col("below") + (F.col("m") + 1) / F.lit(2.0)
    term = (rank * 2 - full - 1) * F.col("n") * F.col("m")
    return j.groupBy("system").agg(F.round(F.sum(term / (full * F.col("total"))), 4).alias("gini"))


def plan_signature(stops: DataFrame) -> DataFrame:
    """(run_id, signature): "day:poi|.." in order."""
    item = F.struct("day_no", "slot", "poi_id")
    return stops.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: F.concat_ws(":", s["day_no"], s["poi_id"])), "|").alias("signature"))


def diversity(stops: DataFrame, runs: DataFrame, places: DataFrame) -> DataFrame:
    """One row per system: plans, recommendations, coverage, Gini, districts, top-5 share, distinct plans.

    The distinct-plan rate takes the first run of each request key.
    """
    s = stops.join(runs.select("run_id", "system", "request_key"), "run_id")
    freq = s.groupBy("system", "poi_id").agg(F.count("*").alias("n"))
    size = places.agg(F.count("*").alias("size"))
    w = Window.partitionBy("system").orderBy(F.desc("n"), "poi_id")
    top = freq.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("system").agg(F.sum("n").alias("top5"))
    tot = freq.groupBy("system").agg(F.sum("n").alias("total_recommendations"), F.count("*").alias("distinct_pois"))
    plans = s.groupBy("system").agg(F.countDistinct("run_id").alias("plans"))
    dist = freq.join(places.select("poi_id", "district"), "poi_id").groupBy("system").agg(F.countDistinct("district").alias("districts_covered"))
    sig = plan_signature(stops).join(runs.select("run_id", "system", "request_key"), "run_id")
    first = sig.groupBy("system", "request_key").agg(F.min(F.struct("run_id", "signature")).alias("x"))
    pct = first.groupBy("system").agg(F.round(F.countDistinct("x.signature") * 100.0 / F.count("*"), 2).alias("distinct_plan_pct"))
    j = plans.join(tot, "system").join(top, "system").join(dist, "system", "left").join(pct, "system").join(gini(freq.select("system", "n"), size), "system").crossJoin(F.broadcast(size))
    return j.select(
        "system",
        "plans",
        "total_recommendations",
        "distinct_pois",
        F.round(F.col("distinct_pois") * 100.0 / F.col("size"), 2).alias("catalogue_coverage_pct"),
        "gini",
        "distinct_plan_pct",
        F.coalesce("districts_covered", F.lit(0)).cast("long").alias("districts_covered"),
        F.round(F.col("top5") * 100.0 / F.col("total_recommendations"), 2).alias("top5_share_pct"),
    )


VIOLATIONS = ["unknown_poi", "duplicate_poi", "budget_exceeded", "day_overflow", "opening_hours", "empty_plan", "too_many_days", "transfer_too_long"]


def system_summary(verdicts: DataFrame, runs: DataFrame, emissions: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per system from verdicts; every run claims to be feasible.

    ``totals(run_id, s_pref, s_sust, utility)``; means of preference and
    sustainability are over plans with stops, that of utility over all runs.
    """
    v = verdicts.join(runs.select("run_id", "system"), "run_id").join(emissions, "run_id", "left").join(totals, "run_id", "left")
    pct = lambda a, b, d: F.round(a * 100.0 / F.greatest(b, F.lit(1)), d)
    n, ok, back = F.count("*"), F.count_if("feasible"), F.count_if(F.col("empty_plan") == 0)
    return v.groupBy("system").agg(
        n.alias("runs"),
        pct(back, n, 1).alias("answer_rate_pct"),
        pct(ok, back, 1).alias("csr_pct"),
        pct(ok, n, 1).alias("csr_all_queries_pct"),
        pct(F.count_if(~F.col("feasible")), n, 1).alias("false_feasible_pct"),
        F.round(F.avg("stops"), 2).alias("mean_stops"),
        F.round(F.avg("total_cost"), 0).alias("mean_cost"),
        F.round(F.avg("central"), 3).alias("mean_kg_ptd"),
        half_up(F.avg("s_pref"), 4).alias("mean_pref"),
        half_up(F.avg("s_sust"), 4).alias("mean_sust"),
        half_up(F.sum(F.coalesce("utility", F.lit(0.0))) / n, 4).alias("mean_utility"),
        half_up(F.avg(trip_sustainability(F.col("s_sust"), F.col("central"))), 4).alias("mean_trip_sust"),
    )


def quality_ratio(best: DataFrame, other: DataFrame) -> DataFrame:
    """One row, mean_quality: the mean utility of other plans over that of the best plan of their request.

    Both are ``(request_key, utility)``; requests without a best plan of positive
    utility do not count.
    """
    top = best.groupBy("request_key").agg(F.max("utility").alias("top")).where("top > 0")
    return other.join(top, "request_key").agg(half_up(F.avg(F.col("utility") / F.col("top")), 4).alias("mean_quality"))


def violation_rates(verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """(system, violation, pct) of runs with each violation."""
    v = verdicts.join(runs.select("run_id", "system"), "run_id")
    g = v.groupBy("system").agg(*(F.round(F.count_if(F.col(c) > 0) * 100.0 / F.count("*"), 1).alias(c) for c in VIOLATIONS))
    return g.unpivot("system", VIOLATIONS, "violation", "pct")


def at_ranks(df: DataFrame, group: str, value: str, ranks: DataFrame, parts: int = 64, most: int = 1 << 18) -> DataFrame:
    """(group, p, value): the value at rank ``r`` from 0 of its group in order, for ``ranks(group, p, r)``.

    Equal values are counted first.  While more than ``most`` values may hold a
    rank, they are split at approximate quantiles of themselves, whatever their
    spread, and the counts of the parts tell which one holds it; only that part
    goes on, so no task orders more than ``most`` values.  The result is exact.
    Null values are left out.
    """
    v = materialise(df.select(group, F.col(value).cast("double").alias("value")).where("value is not null").groupBy(group, "value").agg(F.count("*").alias("n")))
    none = F.lit(None).cast("double")
    # a rank is among the values in (lo, hi], with base rows below them
    want = ranks.select(group, "p", "r", F.lit(0).cast("long").alias("span"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("base"))
    want = materialise(want)

    def inside(spans: DataFrame) -> DataFrame:
        j = v.join(spans.select(group, "span", "lo", "hi").distinct(), group)
        return j.where((F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi"))))

    while True:
        sizes = inside(want).groupBy(group, "span").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
        big = want.join(sizes.select(group, "span"), [group, "span"], "left_semi")
        big = materialise(big)
        if big.isEmpty():
            break
        held = inside(big)
        ends = F.percentile_approx("value", [k / parts for k in range(1, parts)], 10_000).alias("ends")
        held = held.join(held.groupBy(group, "span").agg(ends), [group, "span"])
        part = F.size(F.filter("ends", lambda x: x < F.col("value")))
        sums = held.groupBy(group, "span", part.alias("part")).agg(F.sum("n").alias("m"), F.max("value").alias("top"))
        w = Window.partitionBy(group, "span").orderBy("part")  # at most ``parts`` rows
        sums = sums.withColumns({"upto": F.sum("m").over(w), "below": F.lag("top").over(w)})
        at = F.col("r") - F.col("base")
        hit = big.join(sums, [group, "span"]).where((at >= F.col("upto") - F.col("m")) & (at < F.col("upto")))
        hit = hit.select(group, "p", "r", (F.col("span") * (parts + 1) + F.col("part") + 1).alias("span"), F.coalesce("below", "lo").alias("lo"), F.col("top").alias("hi"), (F.col("base") + F.col("upto") - F.col("m")).alias("base"))
        want = materialise(want.join(big.select(group, "span").distinct(), [group, "span"], "left_anti").select(*hit.columns).unionByName(hit))
    rows = inside(want).withColumn("last", F.sum("n").over(Window.partitionBy(group, "span").orderBy("value")))
    at = F.col("r") - F.col("base")
    return rows.select(group, "span", "value", "n", "last").join(want, [group, "span"]).where((at >= F.col("last") - F.col("n")) & (at < F.col("last"))).select(group, "p", "value")


def nearest_rank(df: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """(group, p, value): the value at rank round(p / 100 * (n - 1)) from 0, half to even."""
    n = df.groupBy(group).agg(F.count(value).alias("n")).where("n > 0")
    ranks = n.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).select(group, "p", F.bround(F.col("p") / 100.0 * (F.col("n") - 1)).cast("long").alias("r"))
    return at_ranks(df, group, value, ranks)


def median_of(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median) of a column: the mean of the two middle values."""
    n = df.groupBy(group).agg((F.count(value) - 1).alias("n")).where("n >= 0")
    middle = F.explode(F.array(F.struct(F.lit(0).alias("p"), F.floor(F.col("n") / 2).alias("r")), F.struct(F.lit(1).alias("p"), F.ceil(F.col("n") / 2).alias("r"))))
    ranks = n.select(group, middle.alias("m")).select(group, "m.p", "m.r")
    return at_ranks(df, group, value, ranks).groupBy(group).agg(F.avg("value").alias("median"))


def average_rank(value: str, by: Window | None = None) -> Column:
    """Rank with ties at their mean."""
    whole = Window.orderBy(value) if by is None else by.orderBy(value)
    peers = Window.partitionBy(value) if by is None else by.partitionBy(value)
    return F.rank().over(whole) + (F.count("*").over(peers) - 1) / F.lit(2.0)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """``df`` with rank, the place of a row's value from 1 with ties at their mean; null for null values.

    Equal values are counted first, the values dealt out in ranges, and each
    range starts after the counts of those before it, so no task orders all.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    n = materialise(n.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    sums = n.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.withColumn("before", F.sum("m").over(Window.orderBy("part")) - F.col("m"))  # a row for each range
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(value))
    ranks = n.withColumn("upto", upto).join(F.broadcast(before), "part").select(value, (F.col("before") + F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))
    return df.join(ranks, value, "left")


def spearman(stays: DataFrame, value: str = "rooms") -> DataFrame:
    """(rho, n, t_stat) between the score of each stay type and its median of ``value``; types are few."""
    g = stays.groupBy("sltda_type").agg(F.first("category_score").alias("s"), F.median(value).alias("m")).where("s is not null and m is not null")
    r = g.select(average_rank("s").alias("rs"), average_rank("m").alias("rm")).agg(F.corr("rs", "rm").alias("rho"), F.count("*").alias("n"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return r.where("n >= 3").select(F.round("rho", 6).alias("rho"), "n", F.round(t, 4).alias("t_stat"))


def seasonality(views: DataFrame) -> DataFrame:
    """(title, period, factor, mean): a period's mean views over the mean of the periods' means."""
    g = views.groupBy("title", "period").agg(F.avg("views").alias("v"))
    w = Window.partitionBy("title")
    m = F.avg("v").over(w)
    return g.select("title", "period", F.round(F.col("v") / F.nullif(m, F.lit(0.0)), 3).alias("factor"), F.round(m, 6).alias("mean"))


def popularity_index(means: DataFrame) -> DataFrame:
    """(poi_id, popularity_index, source): log views on a 0-1 scale; unknown is 0 with source none."""
    logged = means.withColumn("lv", F.log1p("mean_views"))
    ends = logged.agg(F.min("lv").alias("lo"), F.max("lv").alias("hi"))
    j = logged.crossJoin(F.broadcast(ends))
    x = F.when(F.col("hi") > F.col("lo"), F.round((F.col("lv") - F.col("lo")) / (F.col("hi") - F.col("lo")), 4))
    return j.select("poi_id", F.coalesce(x, F.lit(0.0)).alias("popularity_index"), F.when(F.col("mean_views").isNull(), "none").otherwise("wikipedia").alias("source"))


def plan_jaccard(stops: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the place sets of run pairs; two empty plans are alike."""
    sets = stops.select("run_id", "poi_id").distinct()
    n = sets.groupBy("run_id").agg(F.count("*").alias("n"))
    both = pairs.join(sets.withColumnRenamed("run_id", "a"), "a").join(sets.withColumnRenamed("run_id", "b"), ["b", "poi_id"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    j = pairs.join(n.select(F.col("run_id").alias("a"), F.col("n").alias("na")), "a", "left").join(n.select(F.col("run_id").alias("b"), F.col("n").alias("nb")), "b", "left").join(both, ["a", "b"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    union = z("na") + z("nb") - z("both")
    return j.select("a", "b", F.when(union == 0, 1.0).otherwise(F.round(z("both") / F.greatest(union, F.lit(1)), 4)).alias("jaccard"))
