"""Step tables: episodes, windows over them, segments, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.sources.shared import written


def numbered(rows: DataFrame, key: str, order: str, name: str = "t", chunk: int = 100_000) -> DataFrame:
    """rows with `name`: the place (from 0) of each among those of its key, in a unique order.

    Places are taken inside chunks of `chunk` values of the order column, and chunks start from the sizes of those before, so that a key of any
    number of rows is many tasks. A null key is a key; rows without an order, which is a number, come first.
    """
    rows = rows.withColumn("_chunk", F.floor(F.col(order) / chunk))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n")).select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(order)) - 1)
    met = ranked.join(sizes, ranked[key].eqNullSafe(sizes["_key"]) & ranked["_chunk"].eqNullSafe(sizes["_of"]))
    return met.withColumn(name, F.col(name) + F.col("_before")).drop("_chunk", "_before", "_key", "_of")


def assemble_episodes(steps: DataFrame, run: str = "run", order: str = "step", done: str = "done", chunk: int = 100_000) -> DataFrame:
    """steps with `episode` (from 0 in each run) and `t` (from 0 in each episode); a step with `done` closes its episode.

    Closed episodes and places are counted inside chunks of `chunk` values of the order column, and chunks go on from the
    totals of those before, so that a run of any length, with or without a closed episode, is many tasks.
    """
    inside = Window.partitionBy(run, "_chunk").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.col(done), F.lit(False))
    rows = steps.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_place", F.row_number().over(inside) - 1)
    ends = rows.groupBy(run, "_chunk").agg(F.count("*").alias("_n"), F.sum(closed.cast("long")).alias("_closed"), F.max(F.when(closed, F.col("_place") + 1)).alias("_end"))
    before = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ends = ends.withColumn("_rows", total("_n")).withColumn("_episodes", total("_closed")).withColumn("_begin", F.coalesce(F.max(F.col("_rows") + F.col("_end")).over(before), F.lit(0)))
    counted = rows.withColumn("_inside", F.coalesce(F.sum(closed.cast("long")).over(so_far), F.lit(0))).withColumn("_start", F.max(F.when(closed, F.col("_place") + 1)).over(so_far))
    placed = counted.join(ends.select(run, "_chunk", "_rows", "_episodes", "_begin"), [run, "_chunk"])
    t = F.col("_place") - F.coalesce("_start", F.col("_begin") - F.col("_rows"))
    return placed.withColumn("episode", F.col("_inside") + F.col("_episodes")).withColumn("t", t.cast("int")).drop("_chunk", "_place", "_inside", "_start", "_rows", "_episodes", "_begin")


def last_episodes(steps: DataFrame, n: int, run: str = "run") -> DataFrame:
    """The last n episodes of each run: a threshold by run, no ranking of rows. Episodes are numbered without gaps."""
    newest = steps.groupBy(run).agg(F.max("episode").alias("_newest"))
    return steps.join(newest, run).where(F.col("episode") > F.col("_newest") - n).drop("_newest")


def last_rows(rows: DataFrame, n: int, order: str, dense: bool = False) -> DataFrame:
    """The last n rows by a unique order: a threshold where the order has no gaps, else the n-th largest value.

    That value is found by the sizes of range partitions of the order column, and then in the one partition that holds it.
    """
    if dense:
        edge = rows.agg((F.max(order) - n).alias("_edge"))
        return rows.join(F.broadcast(edge), F.col(order) > F.col("_edge")).drop("_edge")
    values = written(rows.select(order).where(F.col(order).isNotNull()).repartitionByRange(F.desc(order)).withColumn("_part", F.spark_partition_id()), "order")
    reach = F.sum("_n").over(Window.orderBy("_part"))  # over a row a partition
    part = values.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_reach", reach).where(F.col("_reach") >= n).orderBy("_part").first()
    if part is None:
        return rows.where(F.col(order).isNotNull())
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(order)))
    edge = values.where(F.col("_part") == part["_part"]).withColumn("_rank", rank).where(F.col("_rank") == n - part["_reach"] + part["_n"]).select(F.col(order).alias("_edge"))
    return rows.join(F.broadcast(edge), F.col(order) >= F.col("_edge")).drop("_edge")


def episode_lengths(steps: DataFrame, run: str = "run") -> DataFrame:
    return steps.groupBy(run, "episode").agg(F.count("*").alias("length"))


def complete_trajectories(steps: DataFrame, run: str = "run") -> DataFrame:
    """Steps of the episodes that are as long as their run's first."""
    lengths = episode_lengths(steps, run)
    first = lengths.groupBy(run).agg(F.min_by("length", "episode").alias("_first"))
    kept = lengths.join(first, run).where(F.col("length") == F.col("_first")).select(run, "episode")
    return steps.join(kept, [run, "episode"], "left_semi")


def segments(steps: DataFrame, length: int, fields: list[str], run: str = "run") -> DataFrame:
    """(run, episode, start, steps) for each window of consecutive steps; starts end before T - length."""
    own = Window.partitionBy(run, "episode")
    ahead = own.orderBy("t").rowsBetween(0, length - 1)
    out = steps.withColumn("steps", F.collect_list(F.struct("t", *fields)).over(ahead)).withColumn("_total", F.count("*").over(own))
    return out.where(F.col("t") < F.col("_total") - length).select(run, "episode", F.col("t").alias("start"), "steps")


def frame_stack(steps: DataFrame, obs: str = "obs", goal: str | None = "goal", observable: bool = True, run: str = "run") -> DataFrame:
    """steps with `stacked`: this observation, the one before (this one at t = 0), and the goal (zeros if it isn't observable)."""
    own = Window.partitionBy(run, "episode").orderBy("t")
    parts = [F.col(obs), F.coalesce(F.lag(obs).over(own), F.col(obs))]
    if goal:
        parts.append(F.col(goal) if observable else F.transform(goal, lambda x: x * 0))
    return steps.withColumn("stacked", F.concat(*parts))


def parse_observation(obs: Column) -> dict[str, Column]:
    """Named parts of an observation vector: hand 0-2, gripper 3, object 4-6, the rest, goal last 3."""
    return {
        "hand": F.slice(obs, 1, 3),
        "gripper": F.element_at(obs, 4),
        "object": F.slice(obs, 5, 3),
        "rest": F.slice(obs, F.lit(8), F.greatest(F.size(obs) - 10, F.lit(0))),
        "goal": F.slice(obs, -3, 3),
    }


def state_action(obs: Column, action: Column) -> Column:
    return F.concat(obs, action)


def rescale_action(action: Column, low: float, high: float) -> Column:
    """From [-1, 1] to the bounds, clipped to them."""
    return F.transform(action, lambda a: F.greatest(F.lit(low), F.least(F.lit(high), low + (a + 1) / 2 * (high - low))))


def done_flags(steps: DataFrame, horizon: int, t: str = "t", done: str = "done") -> DataFrame:
    """done_no_max (false at the horizon's last step), not_done and not_done_no_max."""
    no_max = F.when(F.col(t) + 1 == horizon, False).otherwise(F.col(done))
    return steps.withColumn("done_no_max", no_max).withColumn("not_done", (~F.col(done)).cast("int")).withColumn("not_done_no_max", (~no_max).cast("int"))


def select_reward(mode: str, learned: Column, clip: Column, blip: Column, truth: Column, success: Column, flip: bool = False) -> Column:
    """The reward to train on, by source."""
    sign = -1 if flip else 1
    sources = {"learned": learned, "clip": (clip * 2 - 1) * sign, "blip": (blip * 2 - 1) * sign, "truth": truth, "sparse": success.cast("double")}
    return sources[mode]


def asof_version(steps: DataFrame, updates: DataFrame, run: str = "run", order: str = "step", chunk: int = 100_000) -> DataFrame:
    """steps with the `version` of the last update at or before them (null before the first); updates without a version change nothing.

    Updates are carried forward inside chunks of `chunk` values of the order column, and into a chunk from those before it, so that a run of any length is many tasks.
    """
    cols = [c for c in steps.columns]
    left = steps.withColumn("_kind", F.lit(1)).withColumn("version", F.lit(None).cast(updates.schema["version"].dataType))
    right = updates.select(run, order, "version", F.lit(0).alias("_kind"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col(order) / chunk))
    at = Window.partitionBy(run, "_chunk").orderBy(order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by("version", F.when(F.col("version").isNotNull(), F.col(order)))
    carried = both.groupBy(run, "_chunk").agg(last.alias("_last")).select(run, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = both.withColumn("version", F.last("version", ignorenulls=True).over(at)).where("_kind = 1").join(carried, [run, "_chunk"])
    return found.withColumn("version", F.coalesce("version", "_carried")).select(*cols, "version")


def sample_transitions(steps: DataFrame, n: int, seed: int, index: str = "idx", total: int | None = None) -> DataFrame:
    """n uniform draws with replacement: (draw, all columns of steps), by an equi-join on a dense index from 0."""
    from segmentry.functions import draws

    total = steps.count() if total is None else total
    picks = steps.sparkSession.range(n).select(F.col("id").alias("draw"), draws.index(seed, total, F.col("id")).alias(index))
    return picks.join(steps, index)


def dense_index(rows: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """rows with a dense index from 0 in a unique order: the rank inside a range partition plus the sizes of those before.

    The partitions are written first, so that ranks and sizes are of the same ones; the sizes are one small row a partition.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(*order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return ranked.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")
