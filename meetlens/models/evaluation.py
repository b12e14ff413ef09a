"""Evaluation of calls against results: hits, calibration, pairwise separability, slopes with fixed effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Keys = list[str]


def hits(df: DataFrame, final: Keys, called: str, place: str, extra: Keys = ()) -> DataFrame:
    """Of each final: how many of the three called are on the podium, the places there are, whether the winner was named first."""
    return df.groupBy(*final, *extra).agg(F.count_if((F.col(called) <= 3) & (F.col(place) <= 3)).alias("hits"), F.count_if(F.col(place) <= 3).alias("possible"), F.max(F.coalesce((F.col(called) == 1) & (F.col(place) == 1), F.lit(False)).cast("int")).alias("winner_named"))


def hit_rates(results: DataFrame, cuts: Keys) -> DataFrame:
    """Hits, places and winners overall and by each cut (grouping sets)."""
    out = results.groupingSets([[], *[[F.col(c)] for c in cuts]], *[F.col(c) for c in cuts]).agg(F.sum("hits").alias("hits"), F.sum("possible").alias("possible"), F.sum("winner_named").alias("winners"), F.count("*").alias("finals"), *[F.grouping(F.col(c)).alias(f"all_{c}") for c in cuts])
    return out.withColumn("hit_rate", F.round(100.0 * F.col("hits") / F.col("possible"), 4))


def calibration(df: DataFrame, chance: str, outcome: Column, bins: int = 10) -> DataFrame:
    """Equal bins of the chance: count, mean chance, observed share. A chance of one is in the last bin."""
    b = F.least(F.lit(bins), F.floor(F.col(chance) * bins) + 1).cast("int")
    return df.where(F.col(chance).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(chance), 6).alias("predicted"), F.round(F.avg(outcome.cast("double")), 6).alias("observed"))


def favourite_bins(df: DataFrame, chance: str, won: Column, edges: list[float]) -> DataFrame:
    """Bins of the favourite's chance by their lower edges; bins without a favourite stay, with count 0."""
    spark: SparkSession = df.sparkSession
    frame = spark.createDataFrame([(i, float(e), float(edges[i + 1]) if i + 1 < len(edges) else None) for i, e in enumerate(edges)], "bin int, low double, high double")
    b = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        b = F.when(F.col(chance) >= e, F.lit(i)).otherwise(b)
    found = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(chance), 6).alias("predicted"), F.round(F.avg(won.cast("double")), 6).alias("observed"))
    return F.broadcast(frame).join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pairwise_win_rate(df: DataFrame, final: Keys, place: str, feature: str, at: int, low: int = 4, high: int = 99) -> DataFrame:
    """How often the athlete at a place had a higher value before the race than those placed low..high; ties count half.

    Finals with exactly one athlete at the place; both have a value. Each final gives its counts from one join on its key.
    """
    one = df.where((F.col(place) == at) & F.col(feature).isNotNull()).groupBy(*final).agg(F.count("*").alias("_c"), F.max(feature).alias("_v")).where("_c = 1")
    band = df.where(F.col(place).between(low, high) & F.col(feature).isNotNull())
    beaten = F.when(F.col(feature) < F.col("_v"), 1.0).when(F.col(feature) == F.col("_v"), 0.5).otherwise(0.0)
    return band.join(one, final).agg(F.count("*").alias("comparisons"), F.round(F.avg(beaten), 6).alias("win_rate"), F.count_distinct(F.struct(*final)).alias("finals"))


def pre_race_rank(df: DataFrame, final: Keys, place: str, feature: str, at: int, least: int = 6) -> DataFrame:
    """Rank by the value before the race (1 is highest, ties share the lowest) of the athlete at a place: median, share in 3 and 6."""
    w = Window.partitionBy(*final)
    rows = df.where(F.col(feature).isNotNull()).withColumns({"_n": F.count("*").over(w), "_r": F.rank().over(w.orderBy(F.desc(feature)))})
    own = rows.where((F.col("_n") >= least) & (F.col(place) == at))
    return own.agg(F.count("*").alias("finals"), F.median("_r").cast("double").alias("median_rank"), F.round(100 * F.avg((F.col("_r") <= 3).cast("double")), 4).alias("in_top3"), F.round(100 * F.avg((F.col("_r") <= 6).cast("double")), 4).alias("in_top6"), F.round(100 * 3 / F.avg("_n"), 4).alias("random_top3"))


def separability_report(df: DataFrame, final: Keys, place: str, features: Keys, places: tuple[int, ...] = (1, 2, 3), bands: tuple[tuple[int, int], ...] = ((4, 6), (4, 8), (4, 99))) -> DataFrame:
    """pairwise_win_rate for every place, feature and band."""
    out = None
    for at in places:
        for f in features:
            for low, high in bands:
                one = pairwise_win_rate(df, final, place, f, at, low, high).select(F.lit(at).alias("place"), F.lit(f).alias("feature"), F.lit(f"{low}-{high}").alias("band"), "*")
                out = one if out is None else out.union(one)
    return out


def within_slope(df: DataFrame, unit: Keys, y: str, x: str, by: Keys = (), least_marks: int = 3, least_rows: int = 200, controls: list[Column] | None = None) -> DataFrame:
    """Fixed-effects slope of y on x within each unit, per group: rows, units, slope, standard error (df = n - units - k).

    One control, with its square, may be given (day of year); the normal equations are sums, solved in closed form.
    """
    w = Window.partitionBy(*by, *unit)
    named = {"_y": F.col(y), "_x": F.col(x)} | {f"_c{i}": c for i, c in enumerate(controls or [])}
    rows = df.select(*by, *unit, *(v.cast("double").alias(k) for k, v in named.items())).dropna(subset=list(named))
    rows = rows.withColumn("_k", F.count("*").over(w)).where(F.col("_k") >= least_marks)
    rows = rows.select(*by, *unit, *((F.col(k) - F.avg(k).over(w)).alias(k) for k in named))
    products = [(a, b) for i, a in enumerate(named) for b in list(named)[i:]]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*unit)).alias("units"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in products)).where(F.col("n") >= least_rows)
    if not controls:
        slope = F.col("_x_y") if "_x_y" in sums.columns else F.col("_y_x")
        slope = slope / F.col("_x_x")
        rss, k, inverse = F.col("_y_y") - slope * F.col("_y_x"), 1, 1 / F.col("_x_x")
    else:
        # partial the controls out of x and y, one after the other (Frisch-Waugh), by their sums
        s = {tuple(sorted((a, b))): F.col(a + b) for a, b in products}
        get = lambda a, b: s[tuple(sorted((a, b)))]
        left = ["_y", "_x"]
        cs = [k for k in named if k.startswith("_c")]
        for i, c in enumerate(cs):
            s2 = {}
            live = left + cs[i + 1 :]
            for m, a in enumerate(live):
                for b in live[m:]:
                    s2[tuple(sorted((a, b)))] = get(a, b) - get(a, c) * get(b, c) / get(c, c)
            s = s2
            get = lambda a, b, s=s: s[tuple(sorted((a, b)))]
        slope = get("_x", "_y") / get("_x", "_x")
        rss, k, inverse = get("_y", "_y") - slope * get("_x", "_y"), 1 + len(cs), 1 / get("_x", "_x")
    se = F.sqrt(rss / (F.col("n") - F.col("units") - k) * inverse)
    return sums.select(*by, "n", "units", slope.alias("slope"), se.alias("std_error"))


def sign_agreement(slopes: DataFrame, event: Column, gender: Column) -> DataFrame:
    """Events whose slopes for men and women have the same sign."""
    two = slopes.groupBy(event.alias("event")).agg(F.max(F.when(gender == "men", F.signum("slope"))).alias("m"), F.max(F.when(gender == "women", F.signum("slope"))).alias("w")).dropna()
    return two.agg(F.count_if(F.col("m") == F.col("w")).alias("agree"), F.count("*").alias("events"))


def decide(ours: str, theirs: str, least: int) -> Column:
    """switch, user_decides or keep, by medallists named over at least so many finals."""
    a, b = F.col(ours), F.col(theirs)
    return F.when(F.col("finals") < least, "user_decides").when(a > b, "switch").when(a == b, "user_decides").otherwise("keep")
