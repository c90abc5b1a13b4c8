"""Queries of selection, reward models, labelling clients, frames and streams."""

from __future__ import annotations

import numpy as np
from pyspark.errors import PythonException, StreamingQueryException
from pyspark.sql import functions as F

from segmentry.functions import draws
from segmentry.functions.vectors import dot
from segmentry.operators import frames as FR
from segmentry.operators import label, reward, select
from segmentry.operators.kernels import Network
from segmentry.plans import views as V
from segmentry.plans.labels import CLEAN, PREFER, REPLIES, reply_rows
from segmentry.plans.measures import SESSIONS
from segmentry.plans.views import EMB, PAIRS, STEPS, query, u
from segmentry.streaming import streams

DIST = "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: pow(z[1] - z[2], 2))))"


def _sample(spark, d):
    rows = V.embeddings(spark, d)
    return rows.where("id % 10 = 0"), rows


@query("K1_knn_distance", f"WITH {EMB}, p AS (SELECT a.id, {DIST} AS d FROM emb a JOIN emb b ON a.id % 10 = 0), r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM p) SELECT id, round(d, 6) AS distance FROM r WHERE k = 6")
def _(spark, d):
    return select.knn_distance(*_sample(spark, d), 5).select("id", F.round("distance", 6).alias("distance"))


@query("J6_nearest_neighbour", f"WITH {EMB}, p AS (SELECT a.id, b.id AS o, {DIST} AS d FROM emb a JOIN emb b ON a.id % 10 <> 0 AND b.id % 10 = 0) SELECT id, arg_min(o, (d, o)) AS neighbour, round(min(d), 6) AS distance FROM p GROUP BY id")
def _(spark, d):
    few, rows = _sample(spark, d)
    return select.nearest_neighbour(rows.where("id % 10 <> 0"), few).select("id", "neighbour", F.round("distance", 6).alias("distance"))


@query("A11_entropy_summary", f"WITH {EMB}, p AS (SELECT a.id, {DIST} AS d FROM emb a JOIN emb b ON a.id % 10 = 0), r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM p) SELECT round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(min(d), 6) AS min, round(avg(d / 2), 6) AS mean_scaled FROM r WHERE k = 6")
def _(spark, d):
    rows = select.entropy_summary(select.knn_distance(*_sample(spark, d), 5), 2.0)
    return rows.select(*(F.round(c, 6).alias(c) for c in rows.columns))


def predictions(spark, d):
    """Three members' rewards of both segments of each pair, drawn."""
    pairs = V.drawn(spark, d)[0].select("pair_id", F.explode(F.array(*map(F.lit, range(3)))).alias("member"))
    r = lambda side: (draws.uniform(f"r{side}", F.col("pair_id"), F.col("member")) * 4).alias(f"r{side}")
    return pairs.select("pair_id", "member", r(1), r(2), (F.col("pair_id") % 2).cast("int").alias("label"))


PRED = f"""{PAIRS}, mm AS (SELECT CAST(unnest(range(0, 3)) AS INT) AS member), pp AS (SELECT pair_id, member, {u('r1', "pair_id || '|' || member")} * 4 AS r1, {u('r2', "pair_id || '|' || member")} * 4 AS r2, CAST(pair_id % 2 AS INT) AS label FROM pairs, mm),
pq AS (SELECT *, 1 / (1 + exp(r2 - r1)) AS p FROM pp)"""


@query("A12_ensemble_stats", f"WITH {PRED} SELECT pair_id, round(avg(r1), 6) AS mean, round(stddev_pop(r1), 6) AS std FROM pp GROUP BY pair_id")
def _(spark, d):
    return select.ensemble_stats(predictions(spark, d), "r1").select("pair_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("A15_ensemble_accuracy", f"WITH {PRED}, a AS (SELECT member, avg(CAST(CASE WHEN r2 > r1 THEN 1 ELSE 0 END = label AS DOUBLE)) AS accuracy FROM pp GROUP BY member) SELECT member, round(accuracy, 6) AS accuracy FROM a UNION ALL SELECT NULL, round(avg(accuracy), 6) FROM a")
def _(spark, d):
    return reward.ensemble_accuracy(predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("K2_disagreement", f"WITH {PRED} SELECT pair_id, round(stddev_pop(round(p, 9)), 6) AS std FROM pq GROUP BY pair_id ORDER BY std DESC, pair_id LIMIT 50")
def _(spark, d):
    return select.disagreement_topk(predictions(spark, d), 50)


@query("K3_entropy", f"WITH {PRED} SELECT pair_id, round(avg(round(abs(p * ln(p) + (1 - p) * ln(1 - p)), 9)), 6) AS entropy FROM pq GROUP BY pair_id ORDER BY entropy DESC, pair_id LIMIT 50")
def _(spark, d):
    return select.entropy_topk(predictions(spark, d), 50)


def _greedy(pool: str, n: int) -> str:
    """SQL of n greedy picks from the table `pool` (id, vec), whose distances to all with id % 10 = 0 are known first."""
    return f"""near AS (SELECT b.id, b.vec, min({DIST}) AS d FROM emb a JOIN {pool} b ON a.id % 10 = 0 GROUP BY b.id, b.vec),
state AS (SELECT CAST(0 AS INT) AS rank, id, vec, d FROM near UNION ALL
  SELECT CAST(a.rank + 1 AS INT), a.id, a.vec, least(a.d, {DIST}) FROM (SELECT *, first_value(id) OVER w AS pick, first_value(vec) OVER w AS best FROM state WINDOW w AS (ORDER BY d DESC, id)) a, LATERAL (SELECT a.best AS vec) b
  WHERE a.id <> a.pick AND a.rank < {n - 1})
SELECT rank, arg_max(id, (d, -id)) AS id, round(max(d), 6) AS distance FROM state GROUP BY rank"""


@query("K2_disagreement_half", f"WITH {PRED}, s AS (SELECT pair_id, round(stddev_pop(round(p, 9)), 6) AS std FROM pq GROUP BY pair_id) SELECT * FROM s ORDER BY std DESC, pair_id LIMIT (SELECT count(*) // 2 FROM s)")
def _(spark, d):
    """Half of all pairs."""
    preds = predictions(spark, d)
    return select.disagreement_topk(preds, preds.select("pair_id").distinct().count() // 2)


@query("K4_k_center", f"WITH RECURSIVE {EMB}, pool AS (SELECT id, vec FROM emb WHERE id % 10 <> 0), {_greedy('pool', 10)}")
def _(spark, d):
    few, rows = _sample(spark, d)
    return select.k_center(rows.where("id % 10 <> 0"), few, 10).withColumn("distance", F.round("distance", 6))


@query("K5_two_stage", f"""WITH RECURSIVE {PRED}, {EMB}, cand AS (SELECT id, vec FROM emb WHERE id % 10 <> 0),
spread AS (SELECT pair_id AS id, round(stddev_pop(round(p, 9)), 6) AS std FROM pq SEMI JOIN cand ON cand.id = pq.pair_id GROUP BY pair_id),
top AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY std DESC, id) AS i FROM spread) WHERE i <= (SELECT count(*) FROM cand) // 2),
pool AS (SELECT id, vec FROM cand SEMI JOIN top USING (id)), {_greedy('pool', 5)}""")
def _(spark, d):
    few, rows = _sample(spark, d)
    preds = predictions(spark, d).withColumnRenamed("pair_id", "id")
    return select.two_stage_select(preds, rows.where("id % 10 <> 0"), few, 5, key="id").withColumn("distance", F.round("distance", 6))


_W = np.round(np.sin(np.arange(64)), 3)


class Layer:
    """tanh of one linear layer."""

    def __init__(self, scale: float):
        self.scale = scale

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ (_W * self.scale))


_DOT = "list_dot_product(vec, [" + ", ".join(map(str, _W.tolist())) + "]::DOUBLE[])"


@query("V2_score_rewards", f"WITH {EMB} SELECT id, round((tanh({_DOT}) + tanh(2 * {_DOT})) / 2, 6) AS reward_hat, round(abs(tanh({_DOT}) - tanh(2 * {_DOT})) / 2, 6) AS spread FROM emb")
def _(spark, d):
    out = reward.score_rewards(V.embeddings(spark, d), [Layer(1.0), Layer(2.0)], "vec", std="spread")
    return out.select("id", F.round("reward_hat", 6).alias("reward_hat"), F.round("spread", 6).alias("spread"))


@query("V3_relabel", "WITH s AS (SELECT event_id AS step, user_id % 3 AS run, (value / 100) AS x FROM events) SELECT step, run, round(tanh(0.5 * x), 6) AS reward FROM s")
def _(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("step"), (F.col("user_id") % 3).alias("run"), F.col("value").alias("reward"), F.array(F.col("value") / 100).alias("sa"))
    return reward.relabel(rows, [Half()]).select("step", "run", F.round("reward", 6).alias("reward"))


class Half:
    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(0.5 * x[:, 0])


@query("V3_relabel_store", "WITH s AS (SELECT event_id AS step, user_id % 3 AS run, (value / 100) AS x FROM events) SELECT step, run, round(CASE WHEN run < 2 THEN tanh(0.5 * x) ELSE 100 * x END, 6) AS reward FROM s")
def _(spark, d):
    """A store by run and thousand of steps, two of whose three runs are relabelled where they are, and then once more."""
    path = V.scratch(spark, "store")
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("step"), (F.col("user_id") % 3).alias("run"), F.floor(F.col("event_id") / 1000).alias("chunk"), F.col("value").alias("reward"), F.array(F.col("value") / 100).alias("sa"))
    rows.write.partitionBy("run", "chunk").parquet(path)
    for _ in range(2):
        reward.relabel_store(spark, path, [Half()], ["run", "chunk"], where=F.col("run") < 2)
    return spark.read.parquet(path).select("step", F.col("run").cast("long").alias("run"), F.round("reward", 6).alias("reward"))


def preference_pairs(spark, d):
    """Pairs of vectors: phi is the second less the first, the label follows from hidden weights."""
    rows = V.embeddings(spark, d)
    n = rows.count()
    met = rows.withColumn("o", draws.index("fit", n, F.col("id"))).join(rows.select(F.col("id").alias("o"), F.col("vec").alias("other")), "o")
    phi = F.zip_with("other", "vec", lambda a, b: a - b)
    hidden = F.array(*map(F.lit, _W.tolist()))
    return met.select(F.col("id").alias("pair_id"), phi.alias("phi"), (dot(phi, hidden) > 0).cast("int").alias("label")).where("aggregate(phi, 0D, (a, x) -> a + abs(x)) > 0")


def _right(pairs, weights):
    """(member, n, accuracy) of linear members on pairs."""
    out = None
    for m, w in enumerate(weights):
        ok = ((dot(F.col("phi"), F.array(*map(F.lit, map(float, w)))) > 0).cast("int") == F.col("label")).cast("double")
        row = pairs.agg(F.lit(m).alias("member"), F.count("*").alias("n"), F.avg(ok).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


@query("V4_fit_preference")
def _(spark, d):
    pairs = preference_pairs(spark, d)
    return _right(pairs, reward.fit_preference(pairs))


@query("V5_fit_soft_labels")
def _(spark, d):
    pairs = preference_pairs(spark, d)
    unsure = pairs.withColumn("label", F.when(F.col("pair_id") % 7 == 0, -1).otherwise(F.col("label")))
    return _right(pairs, reward.fit_preference(unsure, margin=0.1))


_LINEAR = "list_dot_product(vec, [" + ", ".join(map(str, _W.tolist())) + "]::DOUBLE[]) + 0.25"


@query("V6_fit_score", f"WITH {EMB} SELECT id, round({_LINEAR}, 5) AS predicted FROM emb")
def _(spark, d):
    """Scores that are linear in the vectors are learned from those of even id, without a penalty, and come back for all."""
    rows = V.embeddings(spark, d).withColumn("score", dot(F.col("vec"), F.array(*map(F.lit, _W.tolist()))) + 0.25)
    weights, intercept = reward.fit_score(rows.where("id % 2 = 0"), "vec", reg=0.0)
    predicted = dot(F.col("vec"), F.array(*map(F.lit, map(float, weights)))) + intercept
    return rows.select("id", F.round(predicted, 5).alias("predicted"))


class Stub:
    """A client that reads the answer from the image, and fails on a third of the prompts at first."""

    def __init__(self):
        self.seen: set[str] = set()

    def ask(self, prompt: str, images: list[bytes]) -> str:
        if len(prompt) % 3 == 0 and prompt not in self.seen:
            self.seen.add(prompt)
            raise TimeoutError
        return images[0].decode() if images else prompt.rpartition(":")[2]


@query("V1_label_pairs", """WITH r AS (SELECT conv_id * 100 + turn AS pair_id FROM conversations) SELECT pair_id, CAST(CASE pair_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END AS INT) AS label FROM r""")
def _(spark, d):
    answer = F.element_at(F.array(F.lit("-1"), F.lit("0"), F.lit("1")), (F.col("pair_id") % 3 + 1).cast("int"))
    pairs = reply_rows(spark, d).select("pair_id", F.concat(F.lit("pair "), F.col("pair_id").cast("string")).alias("query"), F.lit("analysis:{reply}").alias("summary"), answer.cast("binary").alias("image_1"), F.lit(b"").alias("image_2"))
    return label.label_pairs(pairs, Stub, 8, pause=0.0).select("pair_id", "label")


class Dying:
    """A client that is gone after so many pairs."""

    def __init__(self, life: int):
        self.life = life

    def ask(self, prompt: str, images: list[bytes]) -> str:
        self.life -= bool(images)
        if self.life < 0:
            raise RuntimeError("the client's host went away")
        return images[0].decode() if images else prompt.rpartition(":")[2]


@query("V1_label_with_ledger", """WITH r AS (SELECT conv_id * 100 + turn AS pair_id FROM conversations) SELECT pair_id, CAST(CASE pair_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END AS INT) AS label FROM r""")
def _(spark, d):
    """The job dies when each of its clients has answered ten pairs, and goes on from the ledger: all pairs are labelled."""
    answer = F.element_at(F.array(F.lit("-1"), F.lit("0"), F.lit("1")), (F.col("pair_id") % 3 + 1).cast("int"))
    pairs = reply_rows(spark, d).select("pair_id", F.concat(F.lit("pair "), F.col("pair_id").cast("string")).alias("query"), F.lit("analysis:{reply}").alias("summary"), answer.cast("binary").alias("image_1"), F.lit(b"").alias("image_2"))
    folder = V.scratch(spark, "ledger")
    try:
        label.label_with_ledger(pairs, lambda: Dying(10), folder, 4, pause=0.0)
    except PythonException:
        pass
    return label.label_with_ledger(pairs, lambda: Dying(1 << 60), folder, 4, pause=0.0).select("pair_id", "label")


# Pixel (k, l) of the result: the flipped and cropped frame is q(y, x) = px(6 - y, x + 1), y and x from 0 to 5; of its doubled size every other pixel
# is kept, that at 2k, which lies a quarter before k.
_NEAR = lambda k, l: f"px[(6 - {k}) * 8 + {l} + 2]"  # noqa: E731, E741
_BLEND = "0.75 * (0.75 * {a} + 0.25 * {b}) + 0.25 * (0.75 * {c} + 0.25 * {d})"
_PIXELS = [
    "printf('%02X', CAST(round_even(" + _BLEND.format(a=_NEAR(k, l), b=_NEAR(k, max(l - 1, 0)), c=_NEAR(max(k - 1, 0), l), d=_NEAR(max(k - 1, 0), max(l - 1, 0))) + ", 0) AS INT))"
    for k in range(6) for l in range(6)  # noqa: E741
]


@query("F14_frame_transforms", f"WITH {EMB}, p AS (SELECT id, list_transform(vec, lambda v: CAST(floor((v + 1) * 127) AS INT)) AS px FROM emb) SELECT id, 6 AS h, 6 AS w, {' || '.join(_PIXELS)} AS pixels FROM p")
def _(spark, d):
    """Each vector as an 8 x 8 grey frame: flipped, cropped, resized, joined with itself and halved again."""
    data = F.transform("vec", lambda v: F.floor((v + 1) * 127).cast("int"))
    hexes = F.concat_ws("", F.transform(data, lambda p: F.lpad(F.hex(p), 2, "0")))
    rows = V.embeddings(spark, d).select("id", F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), F.unhex(hexes).alias("data")).alias("frame"))
    once = FR.transform_frames(rows, [("flip",), ("crop", 1, 7, 1, 7), ("resize", 12, 12)])
    twice = FR.transform_frames(once.withColumn("frame", FR.side_by_side(F.col("frame"), F.col("frame"))), [("left",), ("stride", 2)])
    return twice.select("id", "frame.h", "frame.w", F.hex("frame.data").alias("pixels"))


def _streamed(spark, rows, build, mode: str = "append", files: int = 4, last=None):
    """What a stream over rows wrote: they come to its folder in parts, in order of `order`, and the query resumes after each part; the rows of `last` come after all others.

    All parts are written at once, and each is moved to the stream's folder when it is due."""
    staged, source, out, state = (V.scratch(spark, f"stream-{x}") for x in ("parts", "in", "out", "state"))
    low, high = rows.agg(F.min("order"), F.max("order")).first()
    part = F.floor((F.col("order") - low) * files / (high - low + 1))
    rows.withColumn("part", part).where("part IS NOT NULL").write.partitionBy("part").parquet(staged)
    if last is not None:
        last.write.parquet(f"{staged}/part={files}")
    path = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join(x))
    system = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(source))
    append = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    for i in range(files + (last is not None)):
        if system.exists(path(staged, f"part={i}")) and not system.rename(path(staged, f"part={i}"), path(source, f"part-{i}")):
            raise OSError(f"part {i} of {staged} was not moved")
        stream = build(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(source).drop("order"))
        writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
        begun = writer.format("parquet").start(out) if mode == "append" else writer.outputMode(mode).foreachBatch(append).start()
        begun.awaitTermination()
    return spark.read.parquet(out)


#: Days over which steps come late in T1's stream.
LATE_DAYS = 5


@query("T1_stream_episodes", f"WITH {STEPS}, e AS (SELECT run, episode, sum(reward) AS reward, count(*) AS length, bool_or(done) AS ended FROM steps GROUP BY run, episode) SELECT run, episode, reward, length, ended FROM e")
def _(spark, d):
    """Steps come in any order, up to five days late, over eight batches; a row of no run, years ahead, moves the watermark past the last of them."""
    rows = V.raw_steps(spark, d).select("run", "step", F.col("ts").cast("timestamp").alias("ts"), "reward", "done")
    late = draws.uniform("late", F.col("step")) * LATE_DAYS * 86_400_000
    rows = rows.withColumn("order", F.unix_millis("ts") + late.cast("long"))
    with streams.keyed_state(spark):
        found = _streamed(spark, rows, lambda s: streams.stream_episodes(s, f"{LATE_DAYS} days 1 hour", 400 * 86_400_000), files=8, last=_beat(rows))
    return found.where("run >= 0").select("run", "episode", "reward", "length", "ended")


def _beat(rows):
    """A row of no run, years after all others, that moves a stream's watermark past them."""
    newest = rows.agg((F.max("ts") + F.expr("INTERVAL 3 YEARS")).alias("ts"))
    return newest.select(*(F.col("ts") if f.name == "ts" else F.lit(-1 if f.name == "run" else 0).cast(f.dataType).alias(f.name) for f in rows.schema))


@query("T3_stream_sessions", SESSIONS)
def _(spark, d):
    """Sessions of steps that come up to five days late, over eight batches, merged where a late step closes a gap."""
    rows = V.raw_steps(spark, d).select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "reward", F.col("step").alias("order"))
    rows = rows.withColumn("order", F.unix_millis("ts") + (draws.uniform("late", F.col("order")) * LATE_DAYS * 86_400_000).cast("long"))
    found = _streamed(spark, rows, lambda s: streams.stream_sessions(s, "6 hours", f"{LATE_DAYS} days 1 hour"), files=8, last=_beat(rows))
    return found.where("run >= 0").select("run", F.unix_micros("start").alias("start"), "reward", "length")


@query("T2_stream_meters", """WITH w AS (SELECT to_timestamp(floor(epoch(ts) / 21600) * 21600) AS start, event_type AS key, round(value * 100) AS value, max(ts) OVER () AS newest FROM events)
SELECT CAST(epoch(start) AS BIGINT) AS start, key, round(sum(value) / count(*), 6) AS value FROM w WHERE epoch(start) + 21600 <= epoch(newest) - 600 GROUP BY start, key""")
def _(spark, d):
    """Windows that the watermark has closed."""
    rows = V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), F.round(F.col("value") * 100).alias("value"), F.lit(1).alias("n"), F.col("event_id").alias("order"))
    closed = _streamed(spark, rows, lambda s: streams.stream_meters(s, "6 hours"))
    return closed.select(F.unix_timestamp("start").alias("start"), "key", F.round("value", 6).alias("value"))


@query("T4_stream_labels", f"WITH {REPLIES}, {CLEAN}, p AS (SELECT pair_id, {PREFER} AS label FROM cl WHERE pair_id % 5 <> 0) SELECT pair_id, label FROM p WHERE label <> -1")
def _(spark, d):
    rows = reply_rows(spark, d).select("pair_id", F.timestamp_seconds(F.col("pair_id")).alias("ts"), "reply", (F.col("pair_id") % 5 != 0).alias("useful"), F.col("pair_id").alias("order"))
    return _streamed(spark, rows.unionByName(rows), streams.stream_labels).select("pair_id", "label")


class Crash(Exception):
    pass


@query("T4_exactly_once_labels", f"WITH {REPLIES}, {CLEAN}, p AS (SELECT pair_id, {PREFER} AS label FROM cl WHERE pair_id % 5 <> 0) SELECT pair_id, label FROM p WHERE label <> -1")
def _(spark, d):
    """Labels in a store, over a driver that dies in each batch twice: once before the batch is in the ledger, and once after it, before the stream knows."""
    rows = reply_rows(spark, d).select("pair_id", F.timestamp_seconds(F.col("pair_id")).alias("ts"), "reply", (F.col("pair_id") % 5 != 0).alias("useful"))
    source, state, folder = (V.scratch(spark, f"labels-{x}") for x in ("in", "state", "store"))
    store = streams.LabelStore(spark, folder, "pair_id long, ts timestamp, label int")
    rows.repartition(4).write.parquet(source)
    tries: dict[int, int] = {}
    deaths: list[int] = []

    def sink(batch_rows, batch: int) -> None:
        tries[batch] = tries.get(batch, 0) + 1

        def crash(at: int) -> None:
            if tries[batch] == at:
                deaths.append(batch)
                raise Crash

        store.append(batch_rows, batch, lambda: crash(1))
        crash(2)

    while True:
        before = len(deaths)
        stream = streams.stream_labels(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source))
        begun = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()
        try:
            begun.awaitTermination()
            break
        except StreamingQueryException:
            if len(deaths) == before:  # of something else
                raise
    return store.read().select("pair_id", "label")


@query("T5_stream_moments", "SELECT event_type AS key, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var FROM events GROUP BY event_type")
def _(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.col("event_id").alias("order"))
    last = _streamed(spark, rows, streams.stream_moments, "update")
    newest = last.groupBy("key").agg(F.max(F.struct("batch", "n", "mean", "m2")).alias("s"))
    return newest.select("key", "s.n", F.round("s.mean", 6).alias("mean"), F.round(F.col("s.m2") / F.col("s.n"), 4).alias("var"))


@query("V4_fit_network")
def _(spark, d):
    """(step, loss) of a small network on pairs of segments of one step each."""
    rows = V.embeddings(spark, d)
    n = rows.count()
    met = rows.withColumn("o", draws.index("fit", n, F.col("id"))).join(rows.select(F.col("id").alias("o"), F.col("vec").alias("other")), "o").where("id <> o")
    hidden = F.array(*map(F.lit, _W.tolist()))
    pairs = met.select(F.array("vec").alias("seg_1"), F.array("other").alias("seg_2"), (dot(F.col("other"), hidden) > dot(F.col("vec"), hidden)).cast("int").alias("label"))
    _, losses = reward.fit_network(pairs, Network.random([64, 8, 1], 0), 10)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(losses)], "step int, loss double")
