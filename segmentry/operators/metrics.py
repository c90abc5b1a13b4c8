"""Run metrics: episode and evaluation summaries, info statistics, meters, moments, curves, normalisers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from segmentry.operators.trajectory import numbered
from segmentry.sources.shared import sized, written


def episode_summary(steps: DataFrame, run: str = "run") -> DataFrame:
    """(run, episode): sums of learned and true reward, whether it ever succeeded, length."""
    return steps.groupBy(run, "episode").agg(F.sum("reward").alias("reward"), F.sum("true_reward").alias("true_reward"), F.max(F.col("success").cast("int")).alias("success"), F.count("*").alias("length"))


def evaluation_summary(steps: DataFrame, run: str = "run") -> DataFrame:
    """(run): mean returns over episodes, success in per cent, and success at the last step of the last episode."""
    ends = steps.groupBy(run).agg(F.max_by(F.col("success").cast("int"), F.struct("episode", "t")).alias("last_success"))
    by = episode_summary(steps, run).groupBy(run)
    means = by.agg(F.avg("reward").alias("reward"), F.avg("true_reward").alias("true_reward"), (F.avg("success") * 100).alias("success_rate"), F.count("*").alias("episodes"))
    return means.join(ends, run)


def long_info(steps: DataFrame, keys: list[str] | None = None, run: str = "run") -> DataFrame:
    """(run, episode, t, key, value) of the info map; keys are pruned before rows multiply."""
    info = F.col("info") if keys is None else F.map_filter("info", lambda k, v: k.isin(keys))
    return steps.select(run, "episode", "t", F.explode(info).alias("key", "value"))


def info_stats(steps: DataFrame, keys: list[str] | None = None, run: str = "run") -> DataFrame:
    """(key): mean over all steps, and mean of the last step of each episode."""
    by_episode = long_info(steps, keys, run).groupBy(run, "episode", "key").agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.max_by("value", "t").alias("last"))
    return by_episode.groupBy("key").agg((F.sum("s") / F.sum("n")).alias("mean"), F.avg("last").alias("final_mean"))


def path_diagnostics(steps: DataFrame, value: str, run: str = "run") -> DataFrame:
    """Mean, population deviation, largest and smallest of a value over all steps, and of its last value in each episode."""
    four = lambda c, p: [F.avg(c).alias(f"{p}mean"), F.stddev_pop(c).alias(f"{p}std"), F.max(c).alias(f"{p}max"), F.min(c).alias(f"{p}min")]
    final = steps.groupBy(run, "episode").agg(F.max_by(value, "t").alias("last"))
    return steps.agg(*four(value, "")).join(F.broadcast(final.agg(*four("last", "final_"))))


def meter_name(key: Column) -> Column:
    """The column of a key: its prefix goes, or stays before _ where a longer prefix than the split's is meant; / becomes _."""
    return F.regexp_replace(F.regexp_replace(key, "^(train|eval)/", ""), "/", "_")


def meters(metrics: DataFrame, keys: list[str], split: str | None = None) -> DataFrame:
    """A row for each (run_id, step) and a column for each key: sum of values over the larger of 1 and the sum of n; 0 where none was logged."""
    rows = metrics if split is None else metrics.where(F.col("split") == split)
    return rows.groupBy("run_id", "step").pivot("key", sorted(keys)).agg(F.sum("value") / F.greatest(F.sum("n"), F.lit(1))).na.fill(0.0, sorted(keys))


def obs_stats(steps: DataFrame, obs: str = "obs") -> DataFrame:
    """(dim, mean, std) of each dimension of an array column."""
    return steps.select(F.posexplode(obs).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def normalise_obs(steps: DataFrame, stats: DataFrame, obs: str = "obs", eps: float = 1e-8) -> DataFrame:
    """steps with `normalised`; the statistics, a row for each dimension, become two broadcast arrays."""
    arrays = stats.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    scale = lambda x, s: (x - s["mean"]) / (s["std"] + eps)
    return steps.join(F.broadcast(arrays)).withColumn("normalised", F.zip_with(obs, "_s", scale)).drop("_s")


def merge_moments(rows: DataFrame, batch: str, value: str, prior: tuple[float, float, float] = (0.0, 1.0, 1e-4)) -> DataFrame:
    """(n, mean, var): moments of all batches, merged with the prior (mean, variance, count) by Chan's rule.

    The rule is associative, so Spark's own partial moments of any rows stand for those of the batches, which give no other result: a task
    sends one row. Rows without a batch count too. Variances are those of the population, as the prior's.
    """
    mean, var, count = prior
    whole = rows.agg(F.count(value).cast("double").alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    n, d = F.col("n") + count, F.col("m") - mean
    merged = F.lit(var * count) + F.col("v") * F.col("n") + F.try_divide(d * d * count * F.col("n"), n)
    return whole.select(n.alias("n"), F.coalesce(mean + F.try_divide(d * F.col("n"), n), F.lit(float(mean))).alias("mean"), F.try_divide(merged, n).alias("var"))


def distinct_goals(tasks: DataFrame) -> DataFrame:
    """(env, n, n_distinct, ok): whether the goals sampled for a task all differ."""
    return tasks.groupBy("env").agg(F.count("*").alias("n"), F.countDistinct("rand_vec").alias("n_distinct")).withColumn("ok", F.col("n") == F.col("n_distinct"))


def split_by_task(rows: DataFrame, test: DataFrame, env: str = "env") -> tuple[DataFrame, DataFrame]:
    """Rows of the tasks that are not for testing, and of those that are; the table of tasks is broadcast if it is small."""
    names = sized(test.select(env).distinct())
    return rows.join(names, env, "left_anti"), rows.join(names, env, "left_semi")


def trailing(rows: DataFrame, run: str, order: str, w: int, chunk: int, **aggregates: Callable[[WindowSpec], Column]) -> DataFrame:
    """rows with `_at`, the place of each in its run (from 0), and the named aggregates over the w rows that end with it.

    Chunks of max(chunk, w) places get the last w - 1 rows of the chunk before as well, so that a run of any length is many tasks, each of two chunks at most.
    """
    held = max(chunk, w)
    placed = numbered(rows, run, order, "_at").withColumn("_chunk", F.floor(F.col("_at") / held))
    lent = F.col("_at") % held > held - w
    both = placed.withColumn("_for", F.explode(F.when(lent, F.array(F.col("_chunk"), F.col("_chunk") + 1)).otherwise(F.array("_chunk"))))
    frame = Window.partitionBy(run, "_for").orderBy("_at").rowsBetween(1 - w, 0)
    out = both.select("*", *(f(frame).alias(name) for name, f in aggregates.items()))
    return out.where(F.col("_for") == F.col("_chunk")).drop("_for", "_chunk")


def moving_average(curve: DataFrame, w: int, value: str = "value", order: str = "step", run: str = "run", chunk: int = 100_000) -> DataFrame:
    """curve with `smooth`: the trailing mean of w, raw for the first w - 1 and where w is 1 or more than there are.

    A run is cut into chunks of places (see trailing); rows without an order come first, rows of equal order in any.
    """
    if w <= 1:
        return curve.withColumn("smooth", F.col(value))
    rows = trailing(curve, run, order, w, chunk, smooth=lambda frame: F.avg(value).over(frame))
    return rows.withColumn("smooth", F.when(F.col("_at") >= w - 1, F.col("smooth")).otherwise(F.col(value))).drop("_at")


def teacher_thresholds(
    episodes: DataFrame, seg_len: int, horizon: int, eps: float, n: int = 10, squared: bool = False, initial_zero: bool = True, run: str = "run", value: str = "true_reward", chunk: int = 100_000
) -> DataFrame:
    """episodes with `threshold`: the mean return of the last n, by the segment's share of the horizon, times eps (or its square).

    With initial_zero the list of returns starts with one more 0. A run is cut into chunks of places (see trailing).
    """
    rows = trailing(episodes, run, "episode", n, chunk, threshold=lambda frame: F.sum(value).over(frame))
    n_used = F.least(F.col("_at") + (2 if initial_zero else 1), F.lit(n))
    return rows.withColumn("threshold", F.col("threshold") / n_used * seg_len / horizon * (eps * eps if squared else eps)).drop("_at")


def normalised_performance(steps: DataFrame, best: Column, value: str = "performance", first: Column | None = None, run: str = "run") -> DataFrame:
    """steps with `normalised`: the way from the episode's first value (or a fixed one) to the best, in shares."""
    start = F.first(value).over(Window.partitionBy(run, "episode").orderBy("t")) if first is None else first
    return steps.withColumn("_start", start).withColumn("normalised", F.try_divide(F.col(value) - F.col("_start"), best - F.col("_start"))).drop("_start")


#: Rows of a chunk of a scan at most, and the powers of ten over which the weights inside a chunk may range.
SCAN_ROWS, SCAN_POWERS = 10_000, 60


def affine_scan(rows: DataFrame, keys: list[str], place: str, add: Column, factor: float, name: str, longest: int, most: int = SCAN_ROWS) -> DataFrame:
    """rows with `name`: y[i] = factor * y[i - 1] + add[i], from 0 before place 0; places number the rows of a key from 0, factor is from 0 to 1, longest is the largest place.

    Affine maps compose, so a chunk of rows is one map, whose offset is a plain weighted sum; the value before a chunk comes from the maps of those before it, by the same scan over
    chunks, or, where the factor of a chunk is next to nothing, from the last few. A task holds a chunk of a key, whatever the key's length.
    """
    if factor == 0:
        return rows.withColumn(name, add)
    held = most if factor == 1 else max(1, min(most, int(SCAN_POWERS / -math.log10(factor))))
    inside = F.col(place) % held
    local = rows.withColumn("_add", add).withColumn("_chunk", F.floor(F.col(place) / held)).withColumn("_inside", inside)
    so_far = Window.partitionBy(*keys, "_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda n: F.pow(F.lit(float(factor)), n)
    out = local.withColumn(name, power(F.col("_inside")) * F.sum(F.col("_add") * power(-F.col("_inside"))).over(so_far))
    if longest >= held:
        ends = local.groupBy(*keys, "_chunk").agg(F.sum(F.col("_add") * power(held - 1 - F.col("_inside"))).alias("_end"))
        whole = factor**held
        if whole < 1e-20:  # after so many chunks nothing is left of a number in doubles
            reach = math.ceil(330 / -math.log10(whole))
            terms = F.explode(F.array(*(F.struct((F.col("_chunk") + k).alias("at"), (F.col("_end") * whole ** (k - 1)).alias("term")) for k in range(1, reach + 1))))
            before = ends.select(*keys, terms.alias("_t")).groupBy(*keys, F.col("_t.at").alias("_chunk")).agg(F.sum("_t.term").alias("_before"))
        else:
            scanned = _chunks_scanned(ends, keys, whole, longest // held, most)
            before = scanned.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), "_before")
        out = out.join(before, [*keys, "_chunk"], "left").withColumn(name, F.col(name) + power(F.col("_inside") + 1) * F.coalesce("_before", F.lit(0.0))).drop("_before")
    return out.drop("_add", "_chunk", "_inside")


def _chunks_scanned(ends: DataFrame, keys: list[str], factor: float, longest: int, most: int) -> DataFrame:
    rows = ends.select(*keys, F.col("_chunk").alias("_place"), F.col("_end").alias("_offset"))
    return affine_scan(rows, keys, "_place", F.col("_offset"), factor, "_carried", longest, most).select(*keys, F.col("_place").alias("_chunk"), F.col("_carried").alias("_before"))


def ema_normalise(steps: DataFrame, alpha: float, value: str = "value", order: str = "step", run: str = "run", centred: bool = True, most: int = SCAN_ROWS) -> DataFrame:
    """(run, order, value, normalised): value less a moving mean, over a moving deviation; each step moves the mean, then the variance.

    Observations are centred; rewards (centred false) are only divided by the deviation. A value may be an array, each of whose dimensions is normalised by itself.
    The mean starts at 0, the variance at 1. Both are affine scans, the variance's once the means are known. A value that is null, empty or holds a null has a null
    result and moves nothing; a dimension that shorter vectors lack goes on from the row before.
    """
    vector = steps.schema[value].dataType.typeName() == "array"
    rows = steps.select(run, order, F.col(value).cast("array<double>" if vector else "double").alias("_value"))
    usable = F.col("_value").isNotNull()
    if vector:
        usable = usable & (F.size("_value") > 0) & F.forall("_value", lambda x: x.isNotNull())
    known = written(numbered(rows.where(usable), run, order, "_at"), "ema")
    longest = known.agg(F.max("_at")).first()[0] or 0
    each = known.select(run, order, "_at", F.posexplode("_value").alias("_dim", "_x")) if vector else known.select(run, order, "_at", F.lit(0).alias("_dim"), F.col("_value").alias("_x"))
    keys, keep = [run, "_dim"], 1 - alpha
    scan = lambda rows, add, name: affine_scan(rows, keys, "_at", add, keep, name, longest, most)
    means = scan(each, alpha * F.col("_x"), "_mean")
    spread = scan(means, alpha * F.pow(F.col("_x") - F.col("_mean"), 2), "_var").withColumn("_var", F.col("_var") + F.pow(F.lit(keep), F.col("_at") + 1))
    top = F.col("_x") - F.col("_mean") if centred else F.col("_x")
    out = spread.select(run, order, "_dim", "_x", (top / (F.sqrt("_var") + 1e-8)).alias("_y"))
    if vector:
        pairs = F.sort_array(F.collect_list(F.struct("_dim", "_x", "_y")))
        out = out.groupBy(run, order).agg(pairs.alias("_p")).select(run, order, F.col("_p._x").alias(value), F.col("_p._y").alias("normalised"))
    else:
        out = out.select(run, order, F.col("_x").alias(value), F.col("_y").alias("normalised"))
    nothing = rows.where(~usable).select(run, order, F.col("_value").alias(value), F.lit(None).cast(out.schema["normalised"].dataType).alias("normalised"))
    return out.unionByName(nothing)
