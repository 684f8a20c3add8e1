"""Costs, rolling spend, latency and correction statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ring of corrections, the rules of threshold suggestions, and the weights of the moving average.
KEEP_RING = 500
MIN_FOR_PRESSURE = 3
MOST_DELTA = 15
NEW_WEIGHT, OLD_WEIGHT = 0.3, 0.7
HOUR = 3_600_000_000


def with_prices(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``price_in, price_out`` of the longest prefix of the model's name; 0 if none fits.

    ``prices (prefix, price_in, price_out)`` is a price list; models are looked up once each,
    by joining all their prefixes to the list as equal strings."""
    model = F.lower(F.trim("model"))
    names = usage.select(model.alias("_model")).distinct().filter(F.length("_model") > 0)
    tries = names.withColumn("_n", F.explode(F.sequence(F.lit(1), F.length("_model")))).withColumn("prefix", F.expr("substring(_model, 1, _n)"))
    found = tries.join(prices.withColumn("prefix", F.lower("prefix")), "prefix")
    best = found.groupBy("_model").agg(F.max_by(F.struct("price_in", "price_out"), "_n").alias("_p"))
    out = usage.join(best, model == F.col("_model"), "left")
    return out.withColumns({c: F.coalesce(F.col(f"_p.{c}"), F.lit(0.0)) for c in ("price_in", "price_out")}).drop("_model", "_p")


def estimate_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    zero = F.lit(0)
    return F.round((F.greatest(zero, tokens_in) * price_in + F.greatest(zero, tokens_out) * price_out) / 1e6, 6)


def cost_totals(usage: DataFrame) -> DataFrame:
    slug = F.coalesce(F.nullif(F.trim("slug"), F.lit("")), F.lit("unknown"))
    last = [F.max_by("provider", "ts").alias("provider")] if "provider" in usage.columns else []
    return usage.groupBy(slug.alias("slug")).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls"), F.max("ts").alias("last_call"), *last)


def hourly_spend(usage: DataFrame, key: str, micros: Column, cost: str) -> DataFrame:
    """``hourly``: the cost of the hour up to each row, its first instant included; a row without a time has the cost of all such rows.

    That is the running sum of a row's own clock hour, and of the clock hour before the running sum from its end back to the same minute and instant: no
    row is summed up for each of its neighbours, and nothing is subtracted.  A row lends its remainder to the next clock hour, and so a task
    holds two hours of a key at most, however hot the key is."""
    until, since = (Window.partitionBy(key, "_hour").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("_us"), F.desc("_us")))
    rows = usage.withColumn("_us", micros).withColumn("_hour", F.floor(F.col("_us") / HOUR))
    rows = rows.withColumns({"_until": F.sum(cost).over(until), "_since": F.sum(cost).over(since)})
    own = F.col("_own")
    both = rows.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).filter("_own OR _us IS NOT NULL")
    both = both.withColumns({"_in": F.when(own, F.col("_hour")).otherwise(F.col("_hour") + 1), "_at": F.when(own, F.col("_us")).otherwise(F.col("_us") + HOUR), "_since": F.when(~own, F.col("_since"))})
    both = both.withColumns({c: F.when(own, F.col(c)) for c in (*usage.columns, "_us", "_until") if c != key})
    # Backwards in time, the last remainder is that of the first row still inside the hour; where it is null, so are those before.
    nearest = Window.partitionBy(key, "_in").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_rest", F.last("_since", ignorenulls=True).over(nearest)).filter(own)
    hourly = F.round(F.coalesce(F.col("_until") + F.col("_rest"), F.col("_until"), F.col("_rest")), 4)
    return out.withColumn("hourly", hourly).drop("_own", "_in", "_at", "_hour", "_until", "_since", "_rest")


def spend_alerts(usage: DataFrame, key: str, threshold: float, tie: str) -> DataFrame:
    """The first row of each calendar hour, by time and ``tie``, whose rolling spend reaches the threshold; 0 is off."""
    if threshold <= 0:
        return usage.limit(0)
    hour = F.floor(F.col("_us") / 3_600_000_000)
    first = Window.partitionBy(key, "_hour").orderBy("_us", tie)
    return usage.filter(F.col("hourly") >= threshold).withColumn("_hour", hour).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_hour")


def threshold_crossings(counts: DataFrame, keys: list[str], order: str, threshold: int) -> DataFrame:
    """Rows where the count reaches the threshold from below; the count before the first is -1."""
    before = F.coalesce(F.lag("n").over(Window.partitionBy(*keys).orderBy(order)), F.lit(-1))
    return counts.withColumn("_before", before).filter((F.col("_before") < threshold) & (F.col("n") >= threshold)).drop("_before")


def minute_cap(events: DataFrame, key: str, seconds: Column, n: int, order: list[str]) -> DataFrame:
    """The first n of each key and minute; a blank key is unlimited."""
    nth = F.row_number().over(Window.partitionBy(key, "_minute").orderBy(*order))
    rows = events.withColumn("_minute", F.floor(seconds / 60)).withColumn("_n", nth)
    return rows.filter((F.col("_n") <= n) | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).drop("_n", "_minute")


def telemetry(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, error rate, tokens per second and nearest-rank percentiles over successes.

    The percentiles are exact: a group's buffer holds its distinct latencies with their counts, which whole milliseconds bound."""
    ok = F.col("ok")
    spread = {f"p{p}_ms": F.coalesce(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE ok)"), F.lit(0.0)) for p in (50, 95)}
    seconds = F.sum(F.when(ok, F.col("latency_ms"))) / 1000
    rate = F.when(seconds > 0, F.sum(F.when(ok, F.col("tokens"))) / seconds).otherwise(0.0)
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), (F.count_if(~ok) / F.count("*")).alias("error_rate"), F.coalesce(rate, F.lit(0.0)).alias("tokens_per_s"), *[c.alias(k) for k, c in spread.items()])


def drain_eta(remaining: Column, rate: Column) -> Column:
    return F.when(remaining <= 0, 0.0).when(rate <= 0, float("inf")).otherwise(remaining / rate)


def recent_corrections(corrections: DataFrame) -> DataFrame:
    """The last correction of each image, the newest 500 per slug."""
    newest = [F.desc("ts"), F.asc("image_key")]
    one = corrections.withColumn("_n", F.row_number().over(Window.partitionBy("slug", "image_key").orderBy(F.desc("ts"), F.desc("seq")))).filter("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy(*newest))).filter(F.col("_n") <= KEEP_RING).drop("_n")


def correction_stats(corrections: DataFrame) -> DataFrame:
    rows = recent_corrections(corrections).filter(F.trim("corrected") != "")
    return rows.groupBy("slug", "corrected").agg(F.count("*").alias("n"))


def exemplars(corrections: DataFrame, k: int) -> DataFrame:
    """The newest k corrections of each category, with a note."""
    nth = F.row_number().over(Window.partitionBy("slug", "corrected").orderBy(F.desc("ts"), "image_key"))
    note = F.coalesce(F.nullif(F.trim("note"), F.lit("")), F.concat(F.lit("user moved "), F.col("predicted"), F.lit(" → "), F.col("corrected")))
    return recent_corrections(corrections).withColumn("nth", nth).filter(F.col("nth") <= k).withColumn("note", note)


def ewma(values: Column) -> Column:
    """The first value seeds; each later one enters with weight 0.3.  ``values``: array of double, oldest first."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(NEW_WEIGHT * v + OLD_WEIGHT * a))


def suggest_thresholds(corrections: DataFrame, terminal: tuple[str, ...] = ("DISCARD", "CORRUPT")) -> DataFrame:
    """Per slug and axis, how far to move the minimum score: wrong keeps push up, wrong drops push down."""
    dropped, kept = F.col("corrected").isin(*terminal), F.col("predicted").isin(*terminal)
    rows = recent_corrections(corrections).withColumn("side", F.when(dropped & ~kept, "up").when(~dropped & kept, "down")).filter("side IS NOT NULL")
    long = rows.unpivot(["slug", "side", "ts", "image_key"], ["ovr", "rel"], "axis", "score").filter("score IS NOT NULL")

    def pressure(side: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("ts", "image_key", "score"))))
        values = F.transform(pairs, lambda p: p["score"].cast("double"))
        n = F.count_if(F.col("side") == side)
        return F.when(n < MIN_FOR_PRESSURE, 0.0).otherwise((2 + (n - MIN_FOR_PRESSURE)) * F.greatest(F.lit(0.1), F.coalesce(ewma(values), F.lit(0.0)) / 100))

    out = long.groupBy("slug", "axis").agg(F.count_if(F.col("side") == "up").alias("false_keeps"), F.count_if(F.col("side") == "down").alias("false_drops"), pressure("up").alias("up"), pressure("down").alias("down"))
    delta = F.least(F.greatest(F.bround(F.col("up") - F.col("down"), 0), F.lit(-float(MOST_DELTA))), F.lit(float(MOST_DELTA))).cast("int")
    return out.withColumn("delta", delta).withColumn("rationale", F.concat_ws(" ", F.col("false_keeps").cast("string"), F.lit("false keeps,"), F.col("false_drops").cast("string"), F.lit("false drops")))
