"""Segment pairs: drawing, gathering, returns, filters, sets, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.functions import draws
from segmentry.operators.trajectory import dense_index, last_rows


def trajectory_lengths(steps: DataFrame, run: str = "run") -> DataFrame:
    """(run, episode, length) of each episode."""
    return steps.groupBy(run, "episode").agg(F.count("*").alias("length"))


def trajectory_index(steps: DataFrame, run: str = "run") -> DataFrame:
    """(traj, run, episode, length): a dense number for each episode, in order of run and episode."""
    return dense_index(trajectory_lengths(steps, run), [run, "episode"], "traj")


def sample_pairs(trajectories: DataFrame, n: int, seg_len: int, seed: int, run: str = "run", from_start: bool = False) -> DataFrame:
    """(pair_id, run_1, episode_1, start_1, ..._2): two draws with replacement of a trajectory, and of a start before length - seg_len.

    Draws are among the trajectories that are longer than seg_len, numbered in order of traj, or of run and episode where they have no number yet (one index
    instead of two), so that n pairs come back if there is one. With from_start
    segments begin with their trajectory, and those of seg_len steps or more are drawn from. Draws meet trajectories by equi-joins on their numbers.
    """
    spark: SparkSession = trajectories.sparkSession
    usable = dense_index(trajectories.where(F.col("length") >= seg_len + (not from_start)), ["traj"] if "traj" in trajectories.columns else [run, "episode"], "_traj")
    total = usable.count()
    out = spark.range(n if total else 0).select(F.col("id").alias("pair_id"))
    for side in ("1", "2"):
        chosen = usable.select("_traj", *(F.col(c).alias(f"{c}_{side}") for c in (run, "episode", "length")))
        start = F.lit(0).cast("long") if from_start else draws.index(f"{seed}|start{side}", F.col(f"length_{side}") - seg_len, F.col("pair_id"))
        out = out.withColumn("_traj", draws.index(f"{seed}|traj{side}", total, F.col("pair_id"))).join(chosen, "_traj").withColumn(f"start_{side}", start).drop("_traj", f"length_{side}")
    return out


def gather_steps(pairs: DataFrame, steps: DataFrame, seg_len: int, fields: list[str], run: str = "run") -> DataFrame:
    """(pair_id, side, t, fields): the steps of both segments of each pair, by one equi-join on (run, episode, t)."""
    sides = [pairs.select("pair_id", F.lit(int(s)).alias("side"), F.col(f"{run}_{s}").alias(run), F.col(f"episode_{s}").alias("episode"), F.col(f"start_{s}").alias("start")) for s in ("1", "2")]
    wanted = sides[0].unionByName(sides[1]).withColumn("t", F.explode(F.sequence("start", F.col("start") + seg_len - 1)))
    return wanted.join(steps.select(run, "episode", "t", *fields), [run, "episode", "t"]).select("pair_id", "side", "start", "t", *fields)


def segment_returns(gathered: DataFrame, seg_len: int, gamma: float, reward: str = "reward") -> DataFrame:
    """(pair_id, side, total, discounted): plain sums, and sums in which the last step weighs 1 and the first gamma^(L-1)."""
    weight = F.pow(F.lit(float(gamma)), seg_len - 1 - (F.col("t") - F.col("start")))
    return gathered.groupBy("pair_id", "side").agg(F.sum(reward).alias("total"), F.sum(F.col(reward) * weight).alias("discounted"))


def pair_returns(returns: DataFrame) -> DataFrame:
    """One row a pair: sum_1, sum_2, g_1, g_2."""
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    return returns.groupBy("pair_id").agg(*(side(c, s).alias(f"{n}_{s}") for c, n in (("total", "sum"), ("discounted", "g")) for s in (1, 2)))


def attach_frames(segments: DataFrame, frames: DataFrame, seg_len: int, k: int = 1, run: str = "run") -> DataFrame:
    """(segment_id, frames): the frame of the last step, or k frames seg_len // k apart up to it, in order. Keys join first, payload once."""
    last = F.col("start") + seg_len - 1
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: last - (k - 1 - i) * (seg_len // k)))
    wanted = segments.select("segment_id", run, "episode", at.alias("t"))
    met = wanted.join(frames.select(run, "episode", "t", "frame"), [run, "episode", "t"])
    return met.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("t", "frame"))).alias("f")).select("segment_id", F.col("f.frame").alias("frames"))


def skip_low_return(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.greatest("sum_1", "sum_2") > threshold) if threshold > 0 else pairs


def useful(image_1: Column, image_2: Column) -> Column:
    """Whether two images differ in any byte."""
    return ~image_1.eqNullSafe(image_2)


def good_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("label") != -1) & F.col("useful"))


def loggable_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("label") == -1) | F.col("useful"))


def flip_label(label: Column) -> Column:
    return F.when(label == -1, -1).otherwise(1 - label)


def unlabelled(pairs: DataFrame, cache: DataFrame, key: str = "pair_id") -> DataFrame:
    return pairs.join(cache.select(key), key, "left_anti")


def cached_labels(pairs: DataFrame, cache: DataFrame, key: str = "pair_id") -> DataFrame:
    return pairs.join(cache, key)


def append_labels(old: DataFrame, new: DataFrame, capacity: int, order: str = "arrival") -> DataFrame:
    """Both sets, of which the last `capacity` stay."""
    return last_rows(old.unionByName(new), capacity, order)


def member_batches(rows: DataFrame, members: int, size: int, seed: int, key: str = "id", buckets: int = 256) -> DataFrame:
    """(member, key, batch): for each member its own permutation, cut into batches.

    Rows are ordered by a digest; its leading bits are a bucket, in which rows are ranked, and buckets start from the totals before. The
    work is members x buckets tasks' worth, not one task a member.
    """
    each = rows.select(F.col(key), F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
    each = each.withColumn("_d", draws.digest(seed, F.col("member"), F.col(key))).withColumn("_b", F.floor(F.conv(F.substring("_d", 1, 8), 16, 10).cast("long") / (2**32 // buckets)))
    within = Window.partitionBy("member", "_b").orderBy("_d", key)
    before = Window.partitionBy("member").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = each.groupBy("member", "_b").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = each.withColumn("_r", F.row_number().over(within) - 1).join(firsts, ["member", "_b"])
    return ranked.select("member", key, F.floor((F.col("_r") + F.col("_first")) / size).cast("long").alias("batch"))


def scheduled_size(base: int, step: Column, total: int, schedule: str = "constant") -> Column:
    """Queries of a round that begins at `step` of `total`: the base, or whole parts of it times a share.

    linear: the share of the steps that are left, 0.01 where that is 0; growing: all steps over those left and one.
    """
    left = F.lit(float(total)) - step
    shares = {"constant": F.lit(1.0), "linear": F.when(left == 0, 0.01).otherwise(left / total), "growing": F.try_divide(F.lit(float(total)), left + 1)}
    return (base * shares[schedule]).cast("long")


def apply_budget(rounds: DataFrame, most: int, order: str = "round", requested: str = "requested", chunk: int = 10_000) -> DataFrame:
    """rounds (one row a feedback round) with `granted` and `used`: the batch that would pass `most` is cut, later ones are 0.

    The running sum is taken inside chunks of `chunk` values of the order column, and chunks start from the totals of those before.
    """
    rows = rounds.withColumn("_chunk", F.coalesce(F.floor(F.col(order) / chunk), F.lit(-(2**63))))
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_chunk").agg(F.sum(requested).alias("_sum")).select("_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_inside", F.coalesce(F.sum(requested).over(inside), F.lit(0))).join(totals, "_chunk")
    before = F.col("_inside") + F.col("_before")
    granted = F.greatest(F.lit(0), F.least(F.col(requested), most - before))
    out = placed.withColumn("granted", granted.cast("long")).withColumn("used", F.least(F.lit(most), before + F.col(requested)).cast("long"))
    return out.drop("_chunk", "_inside", "_before")
