import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from segmentry.operators import audit, label, metrics, pairs, particles, reward, select, trajectory
from segmentry.operators.kernels import Network
from segmentry.functions import preference, prompts
from segmentry.sources import logs
from segmentry.sources.shared import scratch
from segmentry.streaming import streams


def vectors(spark, values, start=0):
    return spark.createDataFrame([(start + i, [float(v)]) for i, v in enumerate(values)], "id long, vec array<double>")


def test_knn(spark):
    points = vectors(spark, [0, 1, 3, 7])
    assert [r.distance for r in select.knn_distance(points, points, 1).orderBy("id").collect()] == [1, 1, 2, 4]
    assert {r.distance for r in select.knn_distance(points, points, 0).collect()} == {0}


def test_k_center(spark):
    got = select.k_center(vectors(spark, [0, 1, 5, 9]), vectors(spark, [0], 100), 3).orderBy("rank").collect()
    assert [r.id for r in got] == [3, 2, 1]
    assert [r.distance for r in got] == sorted((r.distance for r in got), reverse=True)
    assert select.k_center(vectors(spark, [4, 4]), vectors(spark, [0]).limit(0), 1).first()["id"] == 0


def test_k_center_is_greedy(spark):
    rng = np.random.default_rng(4)
    few, many = rng.normal(size=(4, 3)), rng.normal(size=(40, 3))
    frame = lambda x, start: spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    d, want = np.sqrt(((many[:, None] - few[None]) ** 2).sum(2)).min(1), []
    for _ in range(20):
        want.append(int(d.argmax()))
        d = np.minimum(d, np.sqrt(((many - many[want[-1]]) ** 2).sum(1)))
        d[want] = -1
    assert [r.id for r in select.k_center(frame(many, 0), frame(few, 100), 20).orderBy("rank").collect()] == want


def test_k_center_settles_many_picks_a_job(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = lambda x, start: spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    points = rng.integers(0, 6, size=(1500, 3)).astype(float)  # many ties and repeated vectors
    few, many = frame(points[:5], 5000), frame(points[5:], 0)
    d, want = np.sqrt(((points[5:, None] - points[None, :5]) ** 2).sum(2)).min(1), []
    for k in range(10):
        best = int(d.argmax())
        want.append((k, best, float(d[best])))
        d = np.minimum(d, np.sqrt(((points[5:] - points[5 + best]) ** 2).sum(1)))
        d[best] = -1
    tables = []
    plain = select.written
    monkeypatch.setattr(select, "written", lambda df, what: (tables.append(what), plain(df, what))[1])
    for front, most in ((1, 10), (30, 10), (5000, 1)):
        tables.clear()
        assert [tuple(r) for r in select.k_center(many, few, 10, front=front).orderBy("rank").collect()] == want
        assert tables.count("k-center") <= most
    smooth = frame(rng.normal(size=(3000, 8)), 0)
    tables.clear()
    assert select.k_center(smooth, few.select("id", F.array_repeat(F.lit(0.0), 8).alias("vec")), 10).count() == 10
    assert tables.count("k-center") <= 3


def test_core_set_picks_from_the_candidates(spark):
    got = select.core_set(vectors(spark, range(50)), vectors(spark, [0], 100), 4, 3).collect()
    assert len({r.id for r in got}) == 4


def test_ring_and_dense_index(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 7)], "arrival long")
    for dense in (True, False):
        assert sorted(r.arrival for r in trajectory.last_rows(rows, 4, "arrival", dense).collect()) == [3, 4, 5, 6]
    assert sorted((r.arrival, r.idx) for r in trajectory.dense_index(rows, ["arrival"]).collect()) == [(i + 1, i) for i in range(6)]


def test_last_rows_of_any_order(spark):
    values = [7 * i % 1009 for i in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "arrival long").repartition(5)
    for n in (1, 137, 1000, 5000):
        assert sorted(r.arrival for r in trajectory.last_rows(rows, n, "arrival").collect()) == sorted(values)[-n:]


def test_pairs_are_all_drawn_where_some_trajectories_are_short(spark):
    index = spark.createDataFrame([(i, 0, 10 + i, n) for i, n in enumerate([3, 40, 8, 9, 2, 5])], "traj long, run long, episode long, length long")
    got = pairs.sample_pairs(index, 200, 8, 1).collect()
    assert sorted(r.pair_id for r in got) == [*range(200)] and {r.episode_1 for r in got} == {11, 13} and all(r.start_2 < {11: 32, 13: 1}[r.episode_2] for r in got)
    begun = pairs.sample_pairs(index, 200, 8, 1, from_start=True).collect()
    assert len(begun) == 200 and {r.episode_1 for r in begun} == {11, 12, 13} and {r.start_1 for r in begun} == {0}
    assert pairs.sample_pairs(index.where("length < 8"), 20, 8, 1).count() == 0
    assert sorted(pairs.sample_pairs(index.drop("traj"), 200, 8, 1).collect()) == sorted(got)


def test_numbers_and_versions_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(int(k), i) for i, k in enumerate(rng.integers(0, 3, 200))], "run long, step long")
    one, two = (sorted(map(tuple, trajectory.numbered(rows, "run", "step", chunk=c).collect())) for c in (11, 10**6))
    assert one == two and [t for r, _, t in one if r == 1] == [*range(len([1 for r, _, _ in one if r == 1]))]
    updates = rows.where("step % 17 = 3").withColumn("version", F.when(F.col("step") % 5 != 0, F.col("step")))
    one, two = (sorted(map(tuple, trajectory.asof_version(rows, updates, chunk=c).collect()), key=str) for c in (11, 10**6))
    assert one == two


def test_area_of_runs_is_that_of_cells(spark):
    rng = np.random.default_rng(6)
    points = [(0, 0, t, int(i), float(x), 0.0, float(z)) for t in range(3) for i, (x, z) in enumerate(rng.uniform(0, 10, (30, 2)))]
    rows = spark.createDataFrame(points, "run long, episode long, t int, particle_id long, x double, y double, z double")
    got = {r.t: r.n_cells for r in particles.covered_area(rows, 1.1, 20).collect()}
    for t in range(3):
        x, z = np.array([(p[4], p[6]) for p in points if p[2] == t]).T
        ends = [[np.clip(np.rint((v - v.min() + s) / ((v.max() - v.min()) / 20)), 0, 20).astype(int) for s in (-1.1, 1.1)] for v in (x, z)]
        cells = {min(i * 20 + j, 399) for a, b, c, d in zip(*ends[0], *ends[1]) for i in range(a, b + 1) for j in range(c, d + 1)}
        assert got[t] == len(cells)


def test_losses_are_finite_far_out(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    a, b = F.lit(800.0), F.lit(-800.0)
    assert one(preference.preference_loss(F.lit(0), b, a)) == 1600 and one(preference.preference_loss(F.lit(0), a, b)) == 0
    assert one(preference.soft_loss(preference.soft_target(F.lit(1)), a, b)) == 1600 and one(preference.soft_loss(preference.soft_target(F.lit(-1)), a, b)) == 800
    assert one(preference.match_probability(F.lit(0.0), F.lit(np.log(3.0).item()))) == pytest.approx(0.75)


def test_bins_are_those_of_the_edges(spark):
    diffs = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.9, 0.95, 1.0]
    log = spark.createDataFrame([(d, 0.0) for d in diffs], "score_1 double, score_2 double")
    got = {r.score_1: (r.bin, r.centre) for r in audit.assign_bins(log, 10).collect()}
    edges = np.linspace(0.0, 1.0, 11)
    for d in diffs:
        place = min(max(int(np.searchsorted(edges, d, side="right")) - 1, 0), 9)
        assert got[d] == (place, pytest.approx((edges[place] + edges[place + 1]) / 2))


def test_schedules(spark):
    rows = spark.createDataFrame([(float(s),) for s in (0, 50, 99, 100)], "step double")
    size = lambda kind: [r.x for r in rows.select(pairs.scheduled_size(40, F.col("step"), 100, kind).alias("x")).collect()]
    assert (size("constant"), size("linear"), size("growing")) == ([40] * 4, [40, 20, 0, 0], [39, 78, 2000, 4000])


def test_neighbours_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    got = {r.id: r.distance for r in select.knn_distance(rows.where("id < 20"), rows, 4, blocks=(4, 7)).collect()}
    assert [got[i] for i in range(20)] == pytest.approx(np.sort(d[:20], axis=1)[:, 4].tolist())
    near = {r.id: r.neighbour for r in select.nearest_neighbour(rows.where("id < 20"), rows.where("id >= 20"), blocks=(4, 7)).collect()}
    assert [near[i] for i in range(20)] == (d[:20, 20:].argmin(axis=1) + 20).tolist()


def test_linear_members_are_the_likeliest(spark):
    rng = np.random.default_rng(2)
    phi = rng.normal(size=(200, 3))
    label = (phi @ [1.0, -2.0, 0.5] + rng.logistic(size=200) > 0).astype(int)
    rows = spark.createDataFrame([(i, p.tolist(), int(y)) for i, (p, y) in enumerate(zip(phi, label))], "pair_id long, phi array<double>, label int")
    for margin in (None, 0.1):
        weights = reward.fit_preference(rows, members=1, margin=margin)[0]
        share = np.array([r.weight for r in reward.bagged(rows, 0, 0).orderBy("pair_id").collect()])
        y = label if margin is None else label * 0.8 + 0.1
        w = np.zeros(3)
        for _ in range(50):  # Newton's steps on the same penalised likelihood
            p = 1 / (1 + np.exp(-phi @ w))
            w += np.linalg.solve((phi * (share * p * (1 - p) / share.sum())[:, None]).T @ phi + 1e-4 * np.eye(3), phi.T @ (share * (y - p)) / share.sum() - 1e-4 * w)
        assert weights == pytest.approx(w, abs=1e-3)


def test_idle_runs_give_their_open_episode(spark):
    folder, state, out = (scratch(spark, x) for x in ("in", "state", "out"))
    hour = lambda i, run, step, h, done: (run, step, f"2024-01-01 {h:02d}:00:00", 1.0, done)
    parts = [[hour(0, 0, 1, 0, True), hour(0, 0, 0, 0, False), hour(0, 1, 0, 0, False)], [hour(0, 0, 2, 9, False)], [hour(0, 0, 3, 20, True)], [hour(0, 0, 4, 21, True)]]
    schema = "run long, step long, ts timestamp, reward double, done boolean"
    for part in parts:
        rows = spark.createDataFrame(part, "run long, step long, ts string, reward double, done boolean")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.stream_episodes(spark.readStream.schema(schema).parquet(folder), idle_ms=4 * 3_600_000)
        with streams.keyed_state(spark):
            begun = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        begun.awaitTermination()
    got = sorted((r.run, r.episode, r.reward, r.length, r.ended) for r in spark.read.parquet(out).collect())
    assert (0, 0, 2.0, 2, True) in got and (1, 0, 1.0, 1, False) in got


def test_sliding_meters_and_run_once(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 2.0, 1), ("2024-01-01 00:50:00", "a", 4.0, 1)], "ts string, key string, value double, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((str(r.start)[11:16], r.value) for r in streams.stream_meters(rows, "1 hour", "30 minutes").collect())
    assert got == [("00:00", 3.0), ("00:30", 4.0), ("23:30", 2.0)]
    folder = scratch(spark, "in")
    rows.write.parquet(folder)
    moments = streams.stream_moments(spark.readStream.schema(rows.schema).parquet(folder).select("key", "value"))
    last = streams.run_once(moments, "moments_once", scratch(spark, "state"), "update").collect()
    assert [(r.key, r.n, r["mean"], r.m2) for r in last] == [("a", 2, 3.0, 2.0)]


def test_every_goal_has_its_statement(spark):
    kinds = {(r.env, r.kind) for r in prompts.prompt_table(spark).collect()}
    assert {e for e, k in kinds if k == "statement"} == set(prompts.GOALS)


def test_plans_deal_runs_out(spark):
    from segmentry.plans.registry import QUERIES

    for name in ("W1_assemble_episodes", "J10_asof_version"):  # windows over rows are by chunk; those by run alone are over totals of chunks
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        by_run = [x for x in plan.splitlines() if "Window [" in x and "_chunk" not in x.split("], [")[1]]
        assert all("_chunk" in x for x in by_run), name


def test_episodes_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(r), int(i), bool(d)) for i, (r, d) in enumerate(zip(rng.integers(0, 3, 300), rng.random(300) < 0.2))], "run long, step long, done boolean")
    one, two = (sorted(map(tuple, trajectory.assemble_episodes(rows, chunk=c).select("run", "step", "episode", "t").collect())) for c in (7, 10**6))
    assert one == two


def test_asof(spark):
    steps = spark.createDataFrame([(0, i) for i in range(6)], "run long, step long")
    updates = spark.createDataFrame([(0, 2, 10), (0, 4, 20)], "run long, step long, version long")
    assert [r.version for r in trajectory.asof_version(steps, updates).orderBy("step").collect()] == [None, None, 10, 10, 20, 20]


def test_filters(spark):
    rows = spark.createDataFrame([(-1, False), (-1, True), (1, False), (0, True)], "label int, useful boolean")
    assert (pairs.good_pairs(rows).count(), pairs.loggable_pairs(rows).count()) == (1, 3)


def test_moving_average(spark):
    curve = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([0, 1, 1, 0, 1])], "run long, step long, value double")
    assert [r.smooth for r in metrics.moving_average(curve, 3).orderBy("step").collect()] == pytest.approx([0, 1, 2 / 3, 2 / 3, 2 / 3])
    assert [r.smooth for r in metrics.moving_average(curve, 9).orderBy("step").collect()] == [0, 1, 1, 0, 1]
    assert [r.smooth for r in metrics.moving_average(curve, 1).orderBy("step").collect()] == [0, 1, 1, 0, 1]


def test_trailing_windows_cross_chunks(spark):
    """Chunks of any length, nulls and runs without a name give what one window over each run gives."""
    rng = random.Random(5)
    runs = {0: 37, 1: 1, 2: 12, None: 9}
    rows = [(run, step * 3, None if rng.random() < 0.1 else float(rng.randrange(50))) for run, n in runs.items() for step in range(n)] + [(4, None, 1.0), (4, 0, 3.0)]
    curve = spark.createDataFrame(rows, "run long, episode long, true_reward double")

    def plain(w, value):
        out = {}
        for run in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == run), key=lambda r: -1 if r[1] is None else r[1])
            for i, (_, at, x) in enumerate(own):
                out[run, at] = value(i, x, [y for _, _, y in own[max(0, i - w + 1) : i + 1] if y is not None])
        return out

    for w in (2, 5, 10):
        for chunk in (1, 4, 7, 100):
            smooth = {(r.run, r.episode): r.smooth for r in metrics.moving_average(curve, w, "true_reward", "episode", chunk=chunk).collect()}
            assert smooth == pytest.approx(plain(w, lambda i, x, seen: x if i < w - 1 else sum(seen) / len(seen) if seen else None))
            limits = {(r.run, r.episode): r.threshold for r in metrics.teacher_thresholds(curve, 5, 50, 0.5, n=w, chunk=chunk).collect()}
            assert limits == pytest.approx(plain(w, lambda i, x, seen: sum(seen) / min(i + 2, w) * 0.05 if seen else None))
    assert metrics.moving_average(curve.limit(0), 3, "true_reward", "episode").count() == 0


def test_ema(spark):
    rows = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0)], "run long, step long, value double")
    assert [r.normalised for r in metrics.ema_normalise(rows, 0.5).orderBy("step").collect()] == pytest.approx([1.0, 1.176697], abs=1e-5)


def test_merged_moments_are_global(spark):
    x = np.random.default_rng(1).normal(3, 2, 200)
    rows = spark.createDataFrame([(int(i % 7), float(v)) for i, v in enumerate(x)], "b long, v double")
    got = metrics.merge_moments(rows, "b", "v", (0.0, 0.0, 0.0)).first()
    assert (got["n"], got["mean"], got["var"]) == pytest.approx((200, x.mean(), x.var()))


def test_eval_log(spark):
    raw = spark.createDataFrame([(str(i), v) for i, v in enumerate(["55", "1.0", "0.4", "-0.2", "x"])], "step string, success_rate string")
    assert [r.success_rate for r in logs.clean_eval_log(raw).orderBy("step").collect()] == pytest.approx([0.55, 1.0, 0.4, 0.0])
    with pytest.raises(ValueError):
        logs.clean_eval_log(raw.drop("step"))


def test_query_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ground_truth_score_1,ground_truth_score_2,vlm_predicted_label\n1,2,1.0\n,2,1\nx,2,0\n1,2,abc\nnan,2,0\n3,1,-1\n")
    rows = logs.read_query_log(spark, str(tmp_path / "a.csv")).collect()
    assert sorted(r.vlm_predicted_label for r in rows) == [-1, 1]


def test_fits_recover_the_order(spark):
    rng = np.random.default_rng(2)
    w, phi = np.array([1.0, -2.0, 0.5]), rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(i, p.tolist(), int(p @ w > 0)) for i, p in enumerate(phi)], "pair_id long, phi array<double>, label int")
    for weights in reward.fit_preference(rows) + reward.fit_preference(rows, margin=0.1):
        assert (np.sign(phi @ weights) == np.sign(phi @ w)).mean() > 0.95
    net_rows = rows.select(F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("seg_1"), F.array("phi").alias("seg_2"), "label")
    _, losses = reward.fit_network(net_rows, Network.random([3, 6, 1], 0), 8, 0.05)
    assert losses[-1] < losses[0]


def test_network_gradient():
    net, x = Network.random([3, 5, 1], 3), np.random.default_rng(0).normal(size=(4, 3))
    _, held, slope = net.forward(x)
    grads, (w, _) = net.backward(held, slope, np.ones(4)), net.layers[0]
    w[1, 2] += 1e-6
    up = net(x).sum()
    w[1, 2] -= 2e-6
    assert grads[0][1, 2] == pytest.approx((up - net(x).sum()) / 2e-6, rel=1e-4)


def test_plans_have_no_product(spark):
    from segmentry.plans.registry import QUERIES

    for name in ("J1_sample_pairs", "A6_segment_returns", "K1_knn_distance"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["K2_disagreement"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_two_stage_pool_is_of_candidates(spark):
    rng = np.random.default_rng(3)
    preds = [(i, m, float(a), float(b)) for i in range(200) for m, (a, b) in enumerate(rng.uniform(0, 4, (3, 2)))]
    table = spark.createDataFrame(preds, "id long, member int, r1 double, r2 double")
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)], "id long, vec array<double>")
    candidates, labelled = vectors.where("id >= 4"), vectors.where("id < 4")
    spread = {i: round(float(np.std([round(1 / (1 + np.exp(b - a)), 9) for j, _, a, b in preds if j == i])), 6) for i in range(4, 40)}
    pool = sorted(spread, key=lambda i: (-spread[i], i))[:18]
    want = select.k_center(candidates.where(F.col("id").isin(pool)), labelled, 18).collect()
    assert select.two_stage_select(table, candidates, labelled, 18, key="id").collect() == want and len(want) == 18


def test_budget_runs_over_chunks_and_moments_keep_no_batches(spark):
    asked = [i % 3 for i in range(50)]
    rows = spark.createDataFrame(list(enumerate(asked)), "round long, requested long")
    got = pairs.apply_budget(rows, 30, chunk=7).orderBy("round").collect()
    assert [(r.granted, r.used) for r in got] == [(max(0, min(n, 30 - sum(asked[:i]))), min(30, sum(asked[: i + 1]))) for i, n in enumerate(asked)]
    moments = metrics.merge_moments(spark.range(1000).selectExpr("id div 10 as b", "cast(id as double) as v"), "b", "v", (5.0, 2.0, 10.0))
    assert "collect_list" not in moments._jdf.queryExecution().toString()
    x = np.arange(1000.0)
    mean = (50 + x.sum()) / 1010
    var = (10 * (2 + (5 - mean) ** 2) + ((x - mean) ** 2).sum()) / 1010
    assert tuple(moments.first()) == pytest.approx((1010, mean, var))


def plain_ema(x, alpha, centred=True):
    mean, var, out = 0.0, 1.0, []
    for v in x:
        mean = (1 - alpha) * mean + alpha * v
        var = (1 - alpha) * var + alpha * (v - mean) ** 2
        out.append(((v - mean) if centred else v) / (var**0.5 + 1e-8))
    return out


@pytest.mark.parametrize("alpha, most", [(0.001, 7), (0.001, 10_000), (0.3, 10_000), (0.9, 10_000), (1.0, 5), (0.02, 50), (1e-9, 20)])
def test_ema_as_a_scan_is_step_by_step(spark, alpha, most):
    """Runs over many chunks, over chunks of chunks, with weights that vanish inside a chunk and with such that don't."""
    rng = np.random.default_rng(3)
    runs = {0: rng.normal(50, 3, 1500), 1: np.concatenate((rng.normal(-1e6, 1, 400), np.zeros(500), [1e-3])), 2: [4.0], 3: np.full(90, 2.0)}
    rows = spark.createDataFrame([(r, 3 * i + 5, float(v)) for r, x in runs.items() for i, v in enumerate(x)] + [(3, 6, None), (4, 0, None)], "run long, step long, value double").repartition(5)
    for centred in (True, False):
        got = metrics.ema_normalise(rows, alpha, centred=centred, most=most).collect()
        assert {(r.run, r.step) for r in got if r.normalised is None} == {(3, 6), (4, 0)} and len(got) == rows.count()
        for run, x in runs.items():
            own = [r.normalised for r in sorted(got, key=lambda r: r.step) if r.run == run and r.normalised is not None]
            assert own == pytest.approx(plain_ema(x, alpha, centred), rel=1e-6, abs=1e-6)  # where a value is next to its mean, their difference is what rounding left


def test_ema_of_vectors_is_by_dimension(spark):
    x = np.random.default_rng(4).normal(2, 5, (300, 3))
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)] + [(0, 1000, None), (0, 1001, []), (0, 1002, [1.0, None])], "run long, step long, value array<double>")
    got = sorted(metrics.ema_normalise(rows, 0.05, most=11).collect(), key=lambda r: r.step)
    assert [r.normalised for r in got[300:]] == [None] * 3
    for k in range(3):
        assert [r.normalised[k] for r in got[:300]] == pytest.approx(plain_ema(x[:, k], 0.05))
    assert [r.value for r in got[:300]] == x.tolist()


def test_no_run_of_the_normaliser_is_one_task(spark):
    rows = spark.range(1).selectExpr("id run", "id step", "cast(id as double) value")
    plan = metrics.ema_normalise(rows, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning(run" in line:
            assert "_chunk" in line.partition("hashpartitioning")[2].partition(")")[0]


def fed(spark, parts, watermark="1 hour", idle_ms=10**12, schema="run long, step long, ts timestamp, reward double, done boolean"):
    """What stream_episodes wrote of parts (run, step, hour, reward, done), a batch each."""
    folder, state, out = (scratch(spark, x) for x in ("in", "state", "out"))
    for part in parts:
        rows = spark.createDataFrame([(r, s, None if h is None else 3600.0 * h, x, d) for r, s, h, x, d in part], "run long, step long, at double, reward double, done boolean")
        rows.select("run", "step", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")).alias("ts"), "reward", "done").coalesce(1).write.mode("append").parquet(folder)
        stream = streams.stream_episodes(spark.readStream.schema(schema).parquet(folder), watermark, idle_ms)
        with streams.keyed_state(spark):
            begun = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        begun.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


BEAT = [(-1, 0, 9_000.0, 0.0, False)]


def test_late_steps_join_their_episodes(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = fed(spark, [[(0, 1, 0.1, 1.0, False)], [(0, 3, 0.3, 2.0, True)], [(0, 2, 0.2, 100.0, False), (0, 4, 0.4, 1.0, True)], BEAT])
    assert got == [(0, 0, 103.0, 3, True), (0, 1, 1.0, 1, True)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stream_of_shuffled_steps_is_the_batch(spark):
    rng = np.random.default_rng(7)
    steps = [(int(r), i, i / 60, float(rng.integers(0, 9)), bool(rng.random() < 0.1)) for i, r in enumerate(rng.integers(0, 4, 600))]
    arrival = np.argsort([s[2] + rng.uniform(0, 3) for s in steps])
    parts = [[steps[j] for j in arrival[k : k + 100]] for k in range(0, 600, 100)]
    parts[2].append((0, 9_999, None, 5.0, True))  # without a time
    parts[5] += [(1, 10_000, 11.0, None, None)]
    parts[5].append((2, -1, -900.0, 7.0, True))  # later than the watermark allows
    got = fed(spark, [*parts, BEAT], "3 hours", 10**9)
    rows = spark.createDataFrame([*steps, (1, 10_000, 11.0, 0.0, False)], "run long, step long, ts double, reward double, done boolean")
    whole = trajectory.assemble_episodes(rows).groupBy("run", "episode").agg(F.sum("reward").alias("reward"), F.count("*").alias("n"), F.bool_or("done").alias("ended"))
    assert [g for g in got if g[0] >= 0] == sorted(tuple(r) for r in whole.collect())


def test_a_batch_that_runs_again_adds_nothing(spark):
    store = streams.LabelStore(spark, scratch(spark, "store"), "pair_id long, label int")
    assert store.read().count() == 0
    rows = spark.createDataFrame([(1, 0), (2, 1)], "pair_id long, label int")

    def die():
        raise KeyError

    with pytest.raises(KeyError):
        store.append(rows, 0, die)
    assert store.read().count() == 0 and store.append(rows, 0) and not store.append(rows, 0) and store.append(rows, 12)
    other = streams.LabelStore(spark, store.folder, store.schema, "another stream")
    assert other.append(rows, 0)
    store.clean()
    assert sorted(map(tuple, store.read().collect())) == [(1, 0), (1, 0), (2, 1), (2, 1)] and set(store.ledger()) == {0, 12}


def test_moments_of_a_stream_stay_in_spark(spark):
    values = spark.readStream.format("rate").load().selectExpr("value % 3 key", "value")
    plan = streams.stream_moments(values)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", None), (None, 3.0)], "key string, value double")
    assert sorted(map(str, map(tuple, streams.stream_moments(rows).collect()))) == ["('a', 2, 3.0, 2.0)", "('b', 0, 0.0, 0.0)", "(None, 1, 3.0, 0.0)"]


def clustered(rng, centres, n, spread):
    return (rng.normal(0, 10, (centres, 6))[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, 6))).round(3)


@pytest.mark.parametrize("pivots, block, spread", [(16, 9000, 0.1), (16, 20, 0.1), (1, 7, 5.0), (64, 9000, 20.0)])
def test_nearest_by_an_index_are_exact(spark, pivots, block, spread):
    rng = np.random.default_rng(9)
    v = clustered(rng, 12, 500, spread)
    v[40:60] = v[3]  # ties
    frame = lambda ids: spark.createDataFrame([(int(i), v[i].tolist()) for i in ids], "id long, vec array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    got = {r.id: r.distance for r in select.knn_distance(frame(range(90)), frame(range(500)), 6, blocks=(25, block), pivots=pivots).collect()}
    assert got == {i: np.sort(d[i])[6] for i in range(90)}
    near = {r.id: (r.neighbour, r.distance) for r in select.nearest_neighbour(frame(range(200, 500)), frame(range(200)), blocks=(25, block), pivots=pivots).collect()}
    assert near == {i: (int(d[i, :200].argmin()), d[i, :200].min()) for i in range(200, 500)}


def test_an_index_compares_few_pairs_of_clusters(spark):
    v = clustered(np.random.default_rng(10), 20, 2000, 0.05)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    index = select.metric_index(rows, pivots=60)
    _, visits = select._near(rows.where("id % 10 = 0"), index, 6, 1024, "id", "vec")
    assert index.cells["n"].sum() == 2000 and select.compared_pairs(visits, index) < 0.15 * 200 * 2000


def test_neighbours_where_there_are_few(spark):
    points, none = vectors(spark, [0, 5]), vectors(spark, [0]).limit(0)
    assert sorted((r.id, r.distance) for r in select.knn_distance(points, points, 5).collect()) == [(0, None), (1, None)]
    assert select.nearest_neighbour(points, none).count() == 0 and select.nearest_neighbour(none, points).count() == 0


def test_network_fit_is_that_of_numpy_step_by_step(spark):
    rng = np.random.default_rng(12)
    segments = [(rng.normal(size=(int(rng.integers(1, 4)), 3)), rng.normal(size=(int(rng.integers(1, 4)), 3))) for _ in range(70)]
    labels = [int(b.sum() > a.sum()) for a, b in segments]
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), k) for (a, b), k in zip(segments, labels)] + [(None, [[1.0, 2.0, 3.0]], 1), ([[1.0, 2.0, 3.0]], [], 0), ([[1.0] * 3], [[2.0] * 3], -1)], "seg_1 array<array<double>>, seg_2 array<array<double>>, label int")
    start = Network.random([3, 5, 1], 4)
    net, losses = Network([(w.copy(), b.copy()) for w, b in start.layers], start.end, start.slope), []
    m = [np.zeros_like(p) for p in net.flat()]
    v = [np.zeros_like(p) for p in net.flat()]
    for step in range(1, 13):
        loss, grads = 0.0, [np.zeros_like(p) for p in net.flat()]
        for (a, b), k in zip(segments, labels):
            one, two = net(a).sum(), net(b).sum()
            sign = 1 if k else -1
            loss += np.log1p(np.exp(-sign * (two - one))) / len(labels)
            out = -sign / (1 + np.exp(sign * (two - one))) / len(labels)
            for x, g in ((a, -out), (b, out)):
                _, held, slope = net.forward(x)
                grads = [p + q for p, q in zip(grads, net.backward(held, slope, np.full(len(x), g)))]
        losses.append(loss)
        for i, (p, g) in enumerate(zip(net.flat(), grads)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    for tasks in (1, 3):
        got, found = reward.fit_network(rows, start, 12, 0.05, tasks=tasks)
        assert found == pytest.approx(losses) and found[-1] < found[0]
        for p, q in zip(got.flat(), net.flat()):
            assert p == pytest.approx(q, rel=1e-6, abs=1e-9)
    folder = scratch(spark, "state")
    _, begun = reward.fit_network(rows, start, 7, 0.05, tasks=2, save_every=5, folder=folder)
    got, found = reward.fit_network(rows.limit(0), start, 7, 0.05, tasks=2, folder=folder)  # nothing is left to do, and no pair is asked for
    assert found == begun == pytest.approx(losses[:7])
    got, found = reward.fit_network(rows, start, 12, 0.05, tasks=2, folder=folder)
    assert found[:7] == begun and found == pytest.approx(losses) and got.flat()[0] == pytest.approx(net.flat()[0], rel=1e-6, abs=1e-9)
    assert reward.fit_network(rows.limit(0), start, 3)[1] == []


class Counting:
    """Answers with the pair's number, fails once on every third pair, and is gone after so many requests; each request leaves a file."""

    def __init__(self, folder, life):
        self.folder, self.life = folder, life

    def ask(self, prompt, images):
        import os
        import uuid

        self.life -= 1
        if self.life < 0:
            raise RuntimeError("gone")
        first = not [x for x in os.listdir(self.folder) if x.startswith(f"{prompt}-")]
        open(f"{self.folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
        if int(prompt) % 3 == 0 and first:
            raise label.ClientError
        return "1"


def test_no_pair_is_asked_about_twice(spark, tmp_path):
    pairs = spark.range(1, 41).selectExpr("id pair_id", "cast(id as string) query", "'' summary", "cast('' as binary) image_1", "cast('' as binary) image_2")
    seen, folder = str(tmp_path), scratch(spark, "ledger")
    how = {"two_step": False, "pause": 0.0}
    with pytest.raises(Exception, match="gone"):
        label.label_with_ledger(pairs, lambda: Counting(seen, 17), folder, 1, **how)
    known = {r.pair_id for r in label.Ledger(folder).read(spark).collect()}
    assert 10 < len(known) < 20
    got = label.label_with_ledger(pairs, lambda: Counting(seen, 1000), folder, 3, every=4, **how).collect()
    assert sorted((r.pair_id, r.reply, r.label) for r in got) == [(i, "1", 1) for i in range(1, 41)]
    asked = [int(p.name.partition("-")[0]) for p in tmp_path.iterdir()]
    assert all(asked.count(i) == (2 if i % 3 == 0 else 1) for i in range(1, 41))
    assert {r.pair_id: r.tries for r in got} == {i: asked.count(i) for i in range(1, 41)}
    label.label_with_ledger(pairs, lambda: Counting(seen, 0), folder, 2, **how).collect()  # nothing is left to ask


def test_a_task_that_runs_again_knows_what_was_told(spark):
    ledger = label.Ledger(scratch(spark, "ledger"))
    ledger.write("run", 3, [(7, "0", 1), (8, None, 5)])
    ledger.write("run", 3, [(9, "1\n", 2)])
    ledger.write("run", 4, [(8, "é", 1)])
    assert (ledger.told("run", 3), ledger.told("run", 5), ledger.told("other", 3)) == ({7, 8, 9}, set(), set())
    assert sorted(map(tuple, ledger.read(spark).collect())) == [(7, "0", 1), (8, "é", 6), (9, "1\n", 2)]


def test_requests_are_paced_and_faults_are_not_tried_again():
    import time

    class Once:
        n = 0

        def ask(self, prompt, images):
            self.n += 1
            if prompt == "fault":
                raise TypeError
            if prompt == "never":
                raise TimeoutError
            return "0"

    client = Once()
    asker = label.Asker(client, 3, 0.0, 0.05)
    began = time.monotonic()
    assert [asker.ask("x", []) for _ in range(4)] == [("0", 1)] * 4 and time.monotonic() - began >= 0.15
    assert asker.ask("never", []) == (None, 3) and client.n == 7
    with pytest.raises(TypeError):
        asker.ask("fault", [])
    assert client.n == 8


def test_only_partitions_that_change_are_written_again(spark):
    path = scratch(spark, "store")
    rows = spark.createDataFrame([(i, i % 4, [float(i)], 2.0 * i if i % 4 < 2 else 0.0) for i in range(40)], "step long, run long, sa array<double>, reward double")
    rows.write.partitionBy("run").parquet(path)
    there = lambda: {str(p.relative_to(path.removeprefix("file:"))) for p in __import__("pathlib").Path(path.removeprefix("file:")).rglob("*.parquet")}
    before, twice = there(), [reward.linear_member(np.array([2.0]))]
    assert sorted(tuple(r) for r in reward.relabel_store(spark, path, twice, ["run"], where=F.col("run") < 3).collect()) == [(2, 10, 10)]
    assert {n for n in before if not n.startswith("run=2")} == {n for n in there() if not n.startswith("run=2")} and before != there()
    assert {(r.step, r.run, r.reward) for r in spark.read.parquet(path).collect()} == {(i, i % 4, 2.0 * i if i % 4 < 3 else 0.0) for i in range(40)}
    again = there()
    assert reward.relabel_store(spark, path, twice, ["run"], where=F.col("run") < 3).count() == 0 and there() == again


def test_steps_with_several_boxes(spark):
    points = spark.createDataFrame([(0, 0, 0, i, float(i), 0.0, 0.0) for i in range(10)], "run long, episode long, t int, particle_id long, x double, y double, z double")
    bounds = [(0, 0, 0, b, 0.0, hi, -1.0, 1.0, -1.0, 1.0) for b, hi in (("small", 2.0), ("large", 7.0))]
    boxes = spark.createDataFrame(bounds, "run long, episode long, t int, box string, x_lo double, x_hi double, y_lo double, y_hi double, z_lo double, z_hi double")
    assert sorted((r.box, r.n_inside, r.n) for r in particles.count_in_box(points, boxes).collect()) == [("large", 8, 10), ("small", 3, 10)]
    assert particles.count_in_box(points, boxes.where("box = 'small'").drop("box")).first()["n"] == 10


def test_top_rows_of_any_number(spark):
    rng = np.random.default_rng(13)
    values = np.concatenate((rng.normal(size=1500).round(3), np.full(2500, 0.5), rng.normal(size=500)))  # more than half are ties
    rows = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(values)] + [(9_000, None), (9_001, float("nan"))], "k long, v double")
    want = sorted(range(len(values)), key=lambda i: (-values[i], i))
    for n in (0, 1, 30, 700, 2250, 4400, 4499, 4500, 9000):
        for one_task in (0, 10_000):
            assert sorted(r.k for r in select.top_rows(rows, n, "v", "k", one_task).collect()) == sorted(want[:n])


def test_top_rows_rank_the_border_alone(spark, monkeypatch):
    rows = spark.range(100_000).selectExpr("id k", "cast(id * 7919 % 100003 as double) v")
    ranked, index = [], select.dense_index
    monkeypatch.setattr(select, "dense_index", lambda some, *how: ranked.append(some.count()) or index(some, *how))
    assert select.top_rows(rows, 50_000, "v", "k").count() == 50_000 and 0 < ranked[0] < 4_000
