"""Reward models: scoring, relabelling, fitting on preferences and on scores."""

from __future__ import annotations

import base64
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions import draws
from segmentry.operators.kernels import Network
from segmentry.sources.shared import scratch, sized, written

Batch = Callable[[np.ndarray], np.ndarray]


def score_rewards(rows: DataFrame, members: list[Batch], features: str = "sa", name: str = "reward_hat", std: str | None = None) -> DataFrame:
    """rows with the mean of the members' outputs (and their population deviation); members take (n, d) arrays. No shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(members)

    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            outs = np.stack([m(np.stack(batch.to_list()).astype(float)) for m in held.value])
            yield pd.Series(list(np.stack((outs.mean(axis=0), outs.std(axis=0)), axis=1)))

    scored = rows.withColumn("_out", predict(F.col(features).cast("array<double>")))
    out = scored.withColumn(name, F.col("_out")[0])
    return (out.withColumn(std, F.col("_out")[1]) if std else out).drop("_out")


def relabel(steps: DataFrame, members: list[Batch], features: str = "sa", reward: str = "reward") -> DataFrame:
    """All steps, their reward replaced by the ensemble's."""
    return score_rewards(steps, members, features, "_new").drop(reward).withColumnRenamed("_new", reward)


#: Rows of a file of a store that is written again, about.
FILE_ROWS = 1_000_000


def relabel_store(spark: SparkSession, path: str, members: list[Batch], parts: list[str], features: str = "sa", reward: str = "reward", where: Column | None = None) -> DataFrame:
    """Replace the rewards of a Parquet store, partitioned by `parts`, by the ensemble's; (parts, rows, changed) of the partitions that were written.

    where, a condition on `parts`, names the partitions to look at. Their rows are scored from one snapshot and written aside; then those partitions in which a reward changed,
    and no others, are overwritten. Rewards come from the features alone, so a job that died may run again: what it had written is the same, and what it had not is written.
    Others must not write to the partitions meanwhile. A partition whose value is null is left as it is.
    """
    rows = spark.read.parquet(path)
    rows = rows.where(F.concat(*(F.col(p).cast("string") for p in parts)).isNotNull())
    rows = rows if where is None else rows.where(where)
    scored = written(score_rewards(rows, members, features, "_new"), "relabelled")
    differs = (~F.col("_new").eqNullSafe(F.col(reward))).cast("long")
    totals = scored.groupBy(*parts).agg(F.count("*").alias("rows"), F.sum(differs).alias("changed"))
    changed = written(totals.where("changed > 0"), "changed")
    if not changed.isEmpty():
        files = F.pmod(F.xxhash64(*scored.columns), F.ceil(F.col("rows") / FILE_ROWS))
        fresh = scored.join(sized(changed.select(*parts, "rows")), parts).withColumn("_file", files).repartition(*parts, "_file")
        kind = dict(rows.dtypes)[reward]
        out = fresh.withColumn(reward, F.col("_new").cast(kind)).select(*rows.columns)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return changed


def ensemble_accuracy(preds: DataFrame) -> DataFrame:
    """(member, accuracy), and the mean over members with member null; label is 0 or 1 and ties prefer segment 1."""
    right = (F.when(F.col("r2") > F.col("r1"), 1).otherwise(0) == F.col("label")).cast("double")
    each = preds.groupBy("member").agg(F.avg(right).alias("accuracy"))
    return each.unionByName(each.agg(F.lit(None).cast("int").alias("member"), F.avg("accuracy").alias("accuracy")))


def bagged(rows: DataFrame, member: int, seed: int, key: str = "pair_id") -> DataFrame:
    """rows with a weight from 0 to 3, drawn by digest: linear members differ only by what they are fitted on."""
    u = draws.uniform(f"{seed}|bag{member}", F.col(key))
    return rows.withColumn("weight", F.when(u < 0.368, 0.0).when(u < 0.736, 1.0).when(u < 0.920, 2.0).otherwise(3.0))


def fit_preference(pairs: DataFrame, members: int = 3, seed: int = 0, margin: float | None = None, reg: float = 1e-4, key: str = "pair_id") -> list[np.ndarray]:
    """Linear Bradley-Terry members on `phi` (sums of features of segment 2 less those of segment 1) and `label`.

    With a margin labels are soft: each pair is two weighted rows, and -1 counts as a half each. Without, -1 must be filtered out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    if margin is None:
        rows = pairs.select(key, "phi", F.col("label").cast("double").alias("y"), F.lit(1.0).alias("share"))
    else:
        second = F.when(F.col("label") == -1, 0.5).otherwise(F.col("label").cast("double") * (1 - 2 * margin) + margin)
        rows = pairs.select(key, "phi", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), second.alias("share")), F.struct(F.lit(0.0).alias("y"), (1 - second).alias("share")))).alias("s")).select(key, "phi", "s.y", "s.share")
    data = rows.withColumn("features", array_to_vector(F.col("phi").cast("array<double>"))).persist()
    weights = []
    for member in range(members):
        bag = bagged(data, member, seed, key).withColumn("weight", F.col("weight") * F.col("share")).where("weight > 0")
        model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", fitIntercept=False, standardization=False, regParam=reg, maxIter=50).fit(bag)
        weights.append(model.coefficients.toArray())
    data.unpersist()
    return weights


class Linear:
    """A linear member; it can be sent to tasks."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def linear_member(weights: np.ndarray) -> Batch:
    return Linear(weights)


def fit_score(rows: DataFrame, features: str = "features", score: str = "score", reg: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squares on scored frames (null scores dropped)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = rows.where(F.col(score).isNotNull()).select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(score).alias("y"))
    model = LinearRegression(featuresCol="x", labelCol="y", regParam=reg, standardization=False, maxIter=50).fit(data)
    return model.coefficients.toArray(), float(model.intercept)


class Held:
    """The pairs of one task as arrays: the features of all steps of all first segments, then of all second ones, where each segment begins, and +1 or -1 by label."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        first, second, labels = [], [], []
        for batch in batches:
            first += [np.stack([np.asarray(x, float) for x in s]) for s in batch["a"]]
            second += [np.stack([np.asarray(x, float) for x in s]) for s in batch["b"]]
            labels += batch["label"].tolist()
        segments = first + second
        self.n, self.sign = len(labels), np.where(np.array(labels) == 1, 1.0, -1.0)
        self.x = np.concatenate(segments) if segments else np.zeros((0, 1))
        self.sizes = np.array([len(s) for s in segments], int)
        self.edges = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(int)

    def sums(self, network: Network) -> np.ndarray:
        """Number of pairs, sum of losses, and sums of gradients in the order of `flat`."""
        if not self.n:
            return np.zeros(2 + sum(p.size for p in network.flat()))
        y, kept, slope = network.forward(self.x)
        totals = np.add.reduceat(y[:, 0], self.edges)
        z = self.sign * (totals[self.n :] - totals[: self.n])
        out = -self.sign / (1 + np.exp(z))
        grads = network.backward(kept, slope, np.repeat(np.concatenate((-out, out)), self.sizes))
        return np.concatenate([[self.n, np.logaddexp(0, -z).sum()], *(g.ravel() for g in grads)])


class Adam:
    """A network's weights as one array, their moments, and the losses so far; what a fit goes on from."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.rate = weights, rate
        self.first, self.second, self.losses = np.zeros_like(weights), np.zeros_like(weights), np.zeros(0)

    def step(self, sums: np.ndarray) -> None:
        self.losses = np.append(self.losses, sums[1] / sums[0])
        g, n = sums[2:] / sums[0], len(self.losses)
        self.first, self.second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
        self.weights = self.weights - self.rate * (self.first / (1 - 0.9**n)) / (np.sqrt(self.second / (1 - 0.999**n)) + 1e-8)

    def save(self, folder: str) -> None:
        """As the file of this step; it has its name only when it is whole."""
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        waiting = f"{at}/waiting-{uuid.uuid4().hex}"
        with system.open_output_stream(waiting) as out:
            held = io.BytesIO()
            np.savez(held, weights=self.weights, first=self.first, second=self.second, losses=self.losses)
            out.write(held.getvalue())
        system.move(waiting, f"{at}/step-{len(self.losses):08d}")

    def load(self, folder: str, most: int) -> None:
        """The newest whole file of `most` steps or fewer, if there is one."""
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        there = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        names = sorted(f.base_name for f in there if f.base_name.startswith("step-") and int(f.base_name[5:]) <= most)
        if names:
            with system.open_input_file(f"{at}/{names[-1]}") as source, np.load(io.BytesIO(source.read())) as held:
                self.weights, self.first, self.second, self.losses = (held[k] for k in ("weights", "first", "second", "losses"))


def unflat(network: Network, weights: np.ndarray) -> Network:
    values, at = [], 0
    for p in network.flat():
        values.append(weights[at : at + p.size].reshape(p.shape))
        at += p.size
    return Network([(values[i], values[i + 1]) for i in range(0, len(values), 2)], network.end, network.slope)


def fit_network(
    pairs: DataFrame, network: Network, steps: int = 50, rate: float = 1e-2, seg_1: str = "seg_1", seg_2: str = "seg_2", tasks: int | None = None, save_every: int = 10, folder: str | None = None
) -> tuple[Network, list[float]]:
    """A network on preferences by full-batch Adam, in one barrier stage: each task reads its pairs once and keeps them, and tasks give each other the sums of their gradients.

    seg_1 and seg_2 are arrays of feature arrays, label is 0 or 1; pairs without a label or a segment are left out. Returns the network and the mean loss before each step.
    Every `save_every` steps the state is written to `folder`, a URI that driver and executors share: a stage that runs again, after an executor is lost, goes on from there, and
    so does a later call with the same pairs and folder. There must be as many slots as tasks, and their memory must hold all pairs; each step moves the weights once
    to each task, and Spark's barrier looks for the others once a second, so that a step takes a second or so however few pairs there are.
    """
    spark = pairs.sparkSession
    folder = scratch(spark, "fit") if folder is None else folder
    data = pairs.select(F.col(seg_1).alias("a"), F.col(seg_2).alias("b"), "label").where(F.col("label").isin(0, 1) & (F.size("a") > 0) & (F.size("b") > 0))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        held, context = Held(batches), BarrierTaskContext.get()
        adam = Adam(np.concatenate([p.ravel() for p in network.flat()]), rate)
        adam.load(folder, steps)
        if len(set(context.allGather(str(len(adam.losses))))) > 1:
            raise RuntimeError("tasks found different states")
        while len(adam.losses) < steps:
            own = base64.b64encode(held.sums(unflat(network, adam.weights)).tobytes()).decode()
            sums = sum(np.frombuffer(base64.b64decode(x)) for x in context.allGather(own))  # in order of the tasks, so that all get one result
            if not sums[0]:
                break
            adam.step(sums)
            if context.partitionId() == 0 and (len(adam.losses) % save_every == 0 or len(adam.losses) == steps):
                adam.save(folder)
        if context.partitionId() == 0:
            yield pd.DataFrame({"kind": "weight", "place": np.arange(len(adam.weights)), "value": adam.weights})
            yield pd.DataFrame({"kind": "loss", "place": np.arange(len(adam.losses)), "value": adam.losses})

    dealt = data.repartition(tasks or spark.sparkContext.defaultParallelism)
    found = dealt.mapInPandas(work, "kind string, place long, value double", barrier=True).toPandas().sort_values("place")
    values = {k: found[found["kind"] == k]["value"].to_numpy() for k in ("weight", "loss")}
    if not len(found):  # no task ran, as there were no pairs
        adam = Adam(np.concatenate([p.ravel() for p in network.flat()]), rate)
        adam.load(folder, steps)
        values = {"weight": adam.weights, "loss": adam.losses}
    return unflat(network, values["weight"]), values["loss"].tolist()
