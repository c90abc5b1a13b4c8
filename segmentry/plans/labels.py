"""Queries of the reply, prompt, preference, audit and log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentry.functions import draws, preference, prompts, replies, rewards, vectors
from segmentry.operators import audit, label
from segmentry.operators import pairs as P
from segmentry.plans import views as V
from segmentry.plans.views import EMB, LOG, PAIRS, query, u
from segmentry.sources import logs

# Replies that reach every branch of the parsers, one of them after each text.
SUFFIXES = ["-1", "0", "1", "0.8", "unsure", "<think>1</think> 0", "Image 1", "0-1", "10", "I am not sure", "both look the same", "2", "", "1\n0", "<think>0\n</think>\n1", "0.25\nas it seems"]
_LIST = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in SUFFIXES) + "]"
REPLIES = f"""rep AS (SELECT conv_id * 100 + turn AS pair_id, CASE WHEN turn % 3 = 0 THEN text || ' ' ELSE '' END || ({_LIST})[CAST(floor({u('suffix', 'conv_id * 100 + turn')} * {len(SUFFIXES)}) AS BIGINT) + 1] AS reply FROM conversations)"""
WHITE = "' ' || chr(9) || chr(10) || chr(12) || chr(11) || chr(13)"
CLEAN = f"cl AS (SELECT *, trim(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), {WHITE}) AS c, split_part(trim(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), {WHITE}), chr(10), 1) AS l FROM rep)"
PREFER = """CASE WHEN regexp_matches(c, '(^|[^0-9])-1([^0-9]|$)') THEN -1 WHEN regexp_matches(c, '\\b0\\b') THEN 0 WHEN regexp_matches(c, '\\b1\\b') THEN 1
  WHEN regexp_matches(lower(l), 'uncertain|unsure|not sure|can''t tell|cannot tell|no difference|equal|tie|both|neither') OR contains(l, '-1') THEN -1 WHEN contains(l, '0') THEN 0 WHEN contains(l, '1') THEN 1 ELSE -1 END"""


def reply_rows(spark, d):
    pair = F.col("conv_id") * 100 + F.col("turn")
    tail = F.element_at(F.array(*map(F.lit, SUFFIXES)), (draws.index("suffix", len(SUFFIXES), pair) + 1).cast("int"))
    head = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" "))).otherwise("")
    return V.table(spark, d, "conversations").select(pair.alias("pair_id"), F.concat(head, tail).alias("reply"))


def _parsed(name, f):
    return lambda spark, d: reply_rows(spark, d).select("pair_id", f(F.col("reply")).alias(name))


query("F1_strip_think", f"WITH {REPLIES}, {CLEAN} SELECT pair_id, c AS reply FROM cl")(_parsed("reply", replies.strip_think))
query("F2_parse_preference", f"WITH {REPLIES}, {CLEAN} SELECT pair_id, {PREFER} AS label FROM cl")(_parsed("label", replies.parse_preference))
query("F3_parse_single", f"WITH {REPLIES} SELECT pair_id, CASE WHEN contains(reply, '-1') THEN -1 WHEN contains(reply, '0') THEN 0 WHEN contains(reply, '1') THEN 1 ELSE -1 END AS label FROM rep")(_parsed("label", replies.parse_single))


@query("F4_parse_int", f"""WITH {REPLIES}, s AS (SELECT pair_id, trim(reply, {WHITE}) AS c FROM rep), n AS (SELECT pair_id, TRY_CAST(trim(split_part(c, chr(10), 1), {WHITE}) AS INT) AS f, TRY_CAST(trim(split_part(c, chr(10), -1), {WHITE}) AS INT) AS e, trim(split_part(c, chr(10), 1), {WHITE}) AS fs, trim(split_part(c, chr(10), -1), {WHITE}) AS es FROM s)
SELECT pair_id, CASE WHEN f IN (0, 1) AND fs NOT LIKE '%.%' THEN f ELSE -1 END AS first, CASE WHEN e IN (0, 1) AND es NOT LIKE '%.%' THEN e ELSE -1 END AS last FROM n""")
def _(spark, d):
    return reply_rows(spark, d).select("pair_id", replies.parse_int(F.col("reply"), "first").alias("first"), replies.parse_int(F.col("reply"), "last").alias("last"))


@query("F5_parse_score", f"WITH {REPLIES}, s AS (SELECT pair_id, TRY_CAST(trim(split_part(trim(reply, {WHITE}), chr(10), 1), {WHITE}) AS DOUBLE) AS v FROM rep) SELECT pair_id, CASE WHEN v <> -1 AND NOT isnan(v) AND NOT isinf(v) THEN v * 2 - 1 END AS score FROM s")
def _(spark, d):
    return reply_rows(spark, d).select("pair_id", replies.parse_score(F.col("reply")).alias("score"))


_ENVS = list(prompts.GOALS)
_QUOTED = lambda xs: "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"
_TEMPLATES = lambda kind: _QUOTED([prompts.TEMPLATES[kind].replace("{goal}", g) for g in prompts.GOALS.values()])


def _with_env(rows):
    return rows.withColumn("env", F.element_at(F.array(*map(F.lit, _ENVS)), (F.col("pair_id") % len(_ENVS) + 1).cast("int")))


@query("J3_prompt_lookup", f"WITH {REPLIES} SELECT pair_id, ({_QUOTED(_ENVS)})[pair_id % {len(_ENVS)} + 1] AS env, ({_TEMPLATES('query')})[pair_id % {len(_ENVS)} + 1] AS prompt FROM rep")
def _(spark, d):
    return label.with_prompts(_with_env(reply_rows(spark, d)), prompts.prompt_table(spark), "query").select("pair_id", "env", "prompt")


@query("J3_goal_statements", f"WITH {REPLIES} SELECT pair_id, ({_QUOTED(list(prompts.STATEMENTS.values()))})[pair_id % {len(_ENVS)} + 1] AS statement FROM rep")
def _(spark, d):
    return label.with_prompts(_with_env(reply_rows(spark, d)), prompts.prompt_table(spark), "statement", "statement").select("pair_id", "statement")


@query("F6_render_prompt", f"WITH {REPLIES} SELECT pair_id, replace(({_TEMPLATES('summary')})[pair_id % {len(_ENVS)} + 1], '{{reply}}', reply) || ' Be brief.' AS prompt FROM rep")
def _(spark, d):
    rows = label.with_prompts(_with_env(reply_rows(spark, d)), prompts.prompt_table(spark), "summary", "template")
    return rows.select("pair_id", prompts.render(F.col("template"), F.col("reply"), brief=True).alias("prompt"))


@query("F7_chat_payload", f"""WITH {EMB} SELECT id, '{{"messages":[{{"role":"user","content":[{{"type":"image","image":"data:image/png;base64,' || base64(encode('frame ' || id)) || '"}},{{"type":"text","text":"Query ' || id || '"}}]}}],"max_tokens":512,"temperature":0.0}}' AS payload FROM emb""")
def _(spark, d):
    image = F.concat(F.lit("frame "), F.col("id").cast("string")).cast("binary")
    return V.embeddings(spark, d).select("id", prompts.chat_payload(F.concat(F.lit("Query "), F.col("id").cast("string")), [image]).alias("payload"))


COS = f"""{EMB}, g AS (SELECT vec AS goal FROM emb WHERE id = 0), c AS (SELECT id, round(list_dot_product(vec, goal) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(goal, goal))), 6) AS score FROM emb, g)"""


@query("F8_embedding_preference", f"WITH {COS} SELECT a.id, a.score, round(2 * a.score - 1, 6) AS reward, CASE WHEN a.score > b.score THEN 0 WHEN a.score < b.score THEN 1 ELSE -1 END AS label FROM c a JOIN c b ON b.id = a.id // 2")
def _(spark, d):
    rows = V.embeddings(spark, d)
    goal = rows.where("id = 0").select(F.col("vec").alias("goal"))  # one row
    scored = rows.join(F.broadcast(goal)).select("id", F.round(vectors.cosine(F.col("vec"), F.col("goal")), 6).alias("score"))
    other = scored.select((F.col("id")).alias("o"), F.col("score").alias("other"))
    met = scored.withColumn("o", F.floor(F.col("id") / 2)).join(other, "o")
    return met.select("id", "score", F.round(2 * F.col("score") - 1, 6).alias("reward"), preference.embedding_label(F.col("score"), F.col("other")).alias("label"))


@query("F8_match_preference", f"WITH {EMB}, p AS (SELECT id, exp(10 * vec[2]) / (exp(10 * vec[1]) + exp(10 * vec[2])) AS p FROM emb) SELECT a.id, round(a.p, 6) AS p, CASE WHEN round(a.p, 6) > round(b.p, 6) THEN 0 WHEN round(a.p, 6) < round(b.p, 6) THEN 1 ELSE -1 END AS label FROM p a JOIN p b ON b.id = a.id // 2")
def _(spark, d):
    """Two numbers of each vector as the logits of an image-text match."""
    p = F.round(preference.match_probability(F.col("vec")[0] * 10, F.col("vec")[1] * 10), 6)
    rows = V.embeddings(spark, d).select("id", p.alias("p"))
    other = rows.select(F.col("id").alias("o"), F.col("p").alias("q"))
    return rows.withColumn("o", F.floor(F.col("id") / 2)).join(other, "o").select("id", "p", preference.embedding_label(F.col("p"), F.col("q")).alias("label"))


_R = "(sum_1 / 20000) AS r1, (sum_2 / 20000) AS r2"


def _segment_rewards(spark, d):
    return P.pair_returns(V.returns(spark, d)).withColumn("r1", F.col("sum_1") / 20000).withColumn("r2", F.col("sum_2") / 20000)


@query("F9_bradley_terry", f"WITH {PAIRS}, r AS (SELECT pair_id, {_R} FROM pr), p AS (SELECT pair_id, 1 / (1 + exp(r2 - r1)) AS p, 1 / (1 + exp(r1 - r2)) AS q FROM r) SELECT pair_id, round(p, 6) AS p, round(abs(p * ln(p) + q * ln(q)), 6) AS entropy FROM p")
def _(spark, d):
    a, b = F.col("r1"), F.col("r2")
    return _segment_rewards(spark, d).select("pair_id", F.round(preference.bt_probability(a, b), 6).alias("p"), F.round(preference.bt_entropy(a, b), 6).alias("entropy"))


@query("F11_targets_and_losses", f"""WITH {PAIRS}, r AS (SELECT pair_id, {_R}, CAST(pair_id % 3 - 1 AS INT) AS label FROM pr), t AS (SELECT *, CASE WHEN label = -1 THEN 0.5 ELSE label * 0.8 + 0.1 END AS y FROM r)
SELECT pair_id, round(y, 6) AS target, round(-(1 - y) * (r1 - l) - y * (r2 - l), 6) AS soft, CASE label WHEN 0 THEN round(l - r1, 6) WHEN 1 THEN round(l - r2, 6) END AS hard, round((r1 - r2) * (r1 - r2), 6) AS squared
FROM (SELECT *, greatest(r1, r2) + ln(exp(r1 - greatest(r1, r2)) + exp(r2 - greatest(r1, r2))) AS l FROM t)""")
def _(spark, d):
    rows = _segment_rewards(spark, d).withColumn("label", (F.col("pair_id") % 3 - 1).cast("int"))
    a, b, y = F.col("r1"), F.col("r2"), F.col("label")
    target = preference.soft_target(y, 0.1)
    hard = F.when(y >= 0, F.round(preference.preference_loss(y, a, b), 6))
    return rows.select("pair_id", F.round(target[1], 6).alias("target"), F.round(preference.soft_loss(target, a, b), 6).alias("soft"), hard.alias("hard"), F.round(preference.score_loss(a, b), 6).alias("squared"))


_X = "x AS (SELECT event_id AS step, round(value / 100, 4) + 0.0000314159 AS x FROM events)"
_D = "greatest(0.2 - x, x - 0.6) / 0.5"
_FALLS = {
    "gaussian": f"exp(-0.5 * pow({_D} * sqrt(-2 * ln(0.1)), 2))", "hyperbolic": f"1 / cosh({_D} * acosh(10.0))", "long_tail": f"1 / (pow({_D} * 3, 2) + 1)", "reciprocal": f"1 / ({_D} * 9 + 1)",
    "cosine": f"CASE WHEN {_D} * acos(-0.8) / pi() < 1 THEN (1 + cos({_D} * acos(-0.8))) / 2 ELSE 0 END", "linear": f"CASE WHEN {_D} * 0.9 < 1 THEN 1 - {_D} * 0.9 ELSE 0 END",
    "quadratic": f"CASE WHEN {_D} * sqrt(0.9) < 1 THEN 1 - pow({_D}, 2) * 0.9 ELSE 0 END", "tanh_squared": f"1 - pow(tanh({_D} * atanh(sqrt(0.9))), 2)",
}


def _xs(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("step"), (F.round(F.col("value") / 100, 4) + 0.0000314159).alias("x"))


@query("F12_tolerance", f"WITH {_X} SELECT step, " + ", ".join(f"round(CASE WHEN x BETWEEN 0.2 AND 0.6 THEN 1 ELSE {sql} END, 6) AS {name}" for name, sql in _FALLS.items()) + " FROM x")
def _(spark, d):
    return _xs(spark, d).select("step", *(F.round(rewards.tolerance(F.col("x"), (0.2, 0.6), 0.5, s), 6).alias(s) for s in rewards.SIGMOIDS))


@query("F13_tolerance_products", f"""WITH {_X}, y AS (SELECT step, x, least(x, 1.0) AS a, (step % 11) / 10.0 AS b FROM x)
SELECT step, round(1 - CASE WHEN x BETWEEN 0.2 AND 0.6 THEN 1 WHEN {_D} < 1 THEN 1 - {_D} ELSE 0 END, 6) AS inverse, round(CASE WHEN a + b - a * b > 0 THEN a * b / (a + b - a * b) ELSE 0 END, 6) AS hamacher,
  round(CASE WHEN x BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 THEN x * (1 - b) * 0.5 ELSE 1 END, 6) AS prism FROM y""")
def _(spark, d):
    x, a, b = F.col("x"), F.least("x", F.lit(1.0)), (F.col("step") % 11) / F.lit(10.0)
    prism = rewards.rect_prism_tolerance([x, b, F.lit(0.5)], [0.0, 1.0, 0.0], [1.0, 0.0, 1.0])
    return _xs(spark, d).select("step", F.round(rewards.inverse_tolerance(x, (0.2, 0.6), 0.5), 6).alias("inverse"), F.round(rewards.hamacher(a, b), 6).alias("hamacher"), F.round(prism, 6).alias("prism"))


@query("F15_distance_reward", f"WITH {EMB}, g AS (SELECT vec AS goal FROM emb WHERE id = 0), e AS (SELECT id, round(list_distance(vec, goal), 6) AS d FROM emb, g) SELECT id, -d AS reward, -CASE WHEN d > 1.4 THEN 1.0 ELSE 0.0 END AS sparse, CASE WHEN d < 1.4 THEN 0.0 ELSE -1.0 END AS reached FROM e")
def _(spark, d):
    rows = V.embeddings(spark, d)
    goal = rows.where("id = 0").select(F.col("vec").alias("goal"))  # one row
    a, g = F.col("vec"), F.col("goal")
    return rows.join(F.broadcast(goal)).select("id", F.round(rewards.distance_reward(a, g), 6).alias("reward"), rewards.distance_reward(a, g, 1.4).alias("sparse"), rewards.goal_reached(a, g, 1.4).alias("reached"))


@query("F16_quantise", f"""WITH {EMB}, p AS (SELECT id, list_transform(vec, lambda v: CAST(floor((v + 1) * 127) AS INT)) AS px FROM emb), s AS (SELECT id, list_transform(px, lambda p: floor(p / 8.0) / 32.0 - 0.5) AS q FROM p)
SELECT id, list_sum(q) AS total, CAST(list_sum(list_transform(q, lambda v: greatest(0, least(255, CAST(floor((v + 0.5) * 32) AS INT) * 8)))) AS BIGINT) AS back FROM s""")
def _(spark, d):
    px = F.transform("vec", lambda v: F.floor((v + 1) * 127).cast("int"))
    rows = V.embeddings(spark, d).select("id", rewards.quantise(px, 5).alias("q"))
    back = F.aggregate(rewards.dequantise(F.col("q"), 5), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", vectors.total(F.col("q")).alias("total"), back.alias("back"))


_M = rewards.camera_matrix((0.3, -0.5, 0.0), (1.0, 2.0, 3.0))


def _unproject_sql() -> str:
    import math

    import numpy as np

    focal, inv = 100 / (2 * math.tan(math.radians(45) / 2)), np.linalg.inv(_M)
    cam = [f"((u - 50) * z / {focal!r})", f"((v - 40) * z / {focal!r})", "z"]
    out = [" + ".join([f"{float(r[i])!r} * {c}" for i, c in enumerate(cam)] + [f"({float(r[3])!r})"]) for r in inv[:3]]
    return "WITH p AS (SELECT event_id AS step, event_id % 100 AS u, event_id % 80 AS v, value / 10 AS z FROM events) SELECT step, " + ", ".join(f"round({e}, 4) + 0.0 AS {n}" for e, n in zip(out, "xyz")) + " FROM p"


@query("F17_unproject", _unproject_sql())
def _(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("step"), (F.col("event_id") % 100).alias("u"), (F.col("event_id") % 80).alias("v"), (F.col("value") / 10).alias("z"))
    world = rewards.unproject(F.col("u"), F.col("v"), F.col("z"), 80, 100, _M, 45.0)
    return rows.select("step", *((F.round(c, 4) + 0.0).alias(n) for c, n in zip(world, "xyz")))


@query("A7_label_accuracy", f"""WITH {LOG}, k AS (SELECT train_iter, label <> -1 AND pair_id % 5 <> 0 AS kept, label = CASE WHEN score_1 < score_2 THEN 1 ELSE 0 END AS ok FROM log)
SELECT train_iter, count(*) FILTER (kept) AS n, round(coalesce(avg(CAST(ok AS DOUBLE)) FILTER (kept), 0), 6) AS accuracy FROM k GROUP BY ROLLUP (train_iter)""")
def _(spark, d):
    rows = V.score_log(spark, d).withColumn("useful", F.col("pair_id") % 5 != 0).withColumn("rational_label", preference.rational_label(F.col("score_1"), F.col("score_2")))
    return audit.label_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


BINS = f"""{LOG}, d AS (SELECT *, abs(score_1 - score_2) AS diff FROM log), m AS (SELECT CASE WHEN max(diff) > 0 THEN max(diff) ELSE 1 END AS top FROM d), b AS (SELECT pair_id, label, score_1, score_2, CAST(least(len(list_filter(range(0, 10), lambda i: i * (top / 10) <= diff)), 10) - 1 AS INT) AS bin FROM d, m)"""


@query("J8_assign_bins", f"WITH {BINS} SELECT pair_id, bin FROM b")
def _(spark, d):
    return audit.assign_bins(V.score_log(spark, d), 10).select("pair_id", "bin")


@query("A8_difficulty_histogram", f"""WITH {PAIRS}, l AS (SELECT pair_id, abs(sum_1 - sum_2) AS diff, sum_1, sum_2, CASE WHEN reply IS NULL THEN -1 ELSE {PREFER} END AS label FROM pr LEFT JOIN (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS i, reply, c, l FROM (WITH {REPLIES}, {CLEAN} SELECT * FROM cl)) q ON q.i = pr.pair_id % (SELECT count(*) FROM conversations)),
m AS (SELECT CASE WHEN max(diff) > 0 THEN max(diff) ELSE 1 END AS top FROM l), b AS (SELECT CAST(least(len(list_filter(range(0, 10), lambda i: i * (top / 10) <= diff)), 10) - 1 AS INT) AS bin, CASE WHEN label = -1 THEN 'n' WHEN label = 0 AND sum_1 > sum_2 OR label = 1 AND sum_2 > sum_1 THEN 'c' ELSE 'i' END AS cat FROM l, m),
e AS (SELECT CAST(unnest(range(0, 10)) AS INT) AS bin)
SELECT bin, count(cat) AS n, round(coalesce(100.0 * count(*) FILTER (cat = 'c') / nullif(count(cat), 0), 0), 6) AS correct, round(coalesce(100.0 * count(*) FILTER (cat = 'i') / nullif(count(cat), 0), 0), 6) AS incorrect,
  round(coalesce(100.0 * count(*) FILTER (cat = 'n') / nullif(count(cat), 0), 0), 6) AS no_preference FROM e LEFT JOIN b USING (bin) GROUP BY bin""")
def flagship(spark, d):
    """From steps to the histogram: trajectories, pairs, returns, replies parsed to labels, accuracy by difficulty."""
    from segmentry.operators.trajectory import dense_index

    pairs = P.pair_returns(V.returns(spark, d))
    answers = dense_index(reply_rows(spark, d), ["pair_id"], "i").select("i", replies.parse_preference(F.col("reply")).alias("label"))
    n = max(1, V.table(spark, d, "conversations").count())
    met = pairs.withColumn("i", F.col("pair_id") % n).join(answers, "i", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    table = audit.difficulty_histogram(met, 10, s1="sum_1", s2="sum_2")
    return table.select("bin", "n", *(F.round(c, 6).alias(c) for c in audit.CATEGORIES))


TEXTLOG = """t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'nan' WHEN o_orderkey % 23 = 0 THEN 'text' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS a, CAST(o_custkey AS VARCHAR) AS b,
  CASE WHEN o_orderkey % 29 = 0 THEN 'abc' WHEN o_orderkey % 3 = 0 THEN '1.0' ELSE CAST(o_orderkey % 3 - 1 AS VARCHAR) END AS l FROM orders)"""


def _text_log(spark, d):
    k = F.col("o_orderkey")
    a = F.when(k % 17 == 0, "").when(k % 19 == 0, "nan").when(k % 23 == 0, "text").otherwise((k % 1000).cast("string"))
    lab = F.when(k % 29 == 0, "abc").when(k % 3 == 0, "1.0").otherwise((k % 3 - 1).cast("string"))
    return V.table(spark, d, "orders").select(k.alias("k"), a.alias("ground_truth_score_1"), F.col("o_custkey").cast("string").alias("ground_truth_score_2"), lab.alias("vlm_predicted_label"), F.lit("1.5").alias("timestamp"), k.cast("string").alias("train_iter"))


@query("S1_read_query_log", f"""WITH {TEXTLOG}, n AS (SELECT k, TRY_CAST(a AS DOUBLE) AS a, TRY_CAST(b AS DOUBLE) AS b, TRY_CAST(l AS DOUBLE) AS l FROM t)
SELECT a AS ground_truth_score_1, b AS ground_truth_score_2, CAST(l AS INT) AS vlm_predicted_label, CAST(k AS INT) AS train_iter FROM n WHERE a IS NOT NULL AND NOT isnan(a) AND b IS NOT NULL AND l IS NOT NULL""")
def _(spark, d):
    """The log written as CSV files and read back."""
    path = V.scratch(spark, "csv")
    _text_log(spark, d).drop("k").write.option("header", True).csv(path)
    return logs.read_query_log(spark, path).drop("timestamp")


@query("S2_read_eval_log", f"""WITH {TEXTLOG}, n AS (SELECT k, TRY_CAST(a AS DOUBLE) / 10 AS r FROM t WHERE a NOT IN ('', 'nan', 'text')) SELECT CAST(k AS DOUBLE) AS step, greatest(0.0, least(1.0, CASE WHEN r > 1 THEN r / 100 ELSE r END)) AS success_rate FROM n""")
def _(spark, d):
    a = F.col("ground_truth_score_1")
    rate = F.when(a.isin("", "nan", "text"), a).otherwise((a.try_cast("double") / 10).cast("string"))
    path = V.scratch(spark, "csv")
    _text_log(spark, d).select(F.col("k").cast("string").alias("step"), rate.alias("success_rate")).write.option("header", True).csv(path)
    return logs.read_eval_log(spark, path)


@query("S3_write_query_log", f"WITH {LOG} SELECT train_iter, count(*) AS n, sum(score_1) AS total FROM log GROUP BY train_iter")
def _(spark, d):
    """The log in two appended batches, read back."""
    path = V.scratch(spark, "log")
    rows = V.score_log(spark, d).select(F.col("score_1").alias("ground_truth_score_1"), F.col("score_2").alias("ground_truth_score_2"), F.col("label").alias("vlm_predicted_label"), F.lit(0.0).alias("timestamp"), "train_iter")
    for half in ("train_iter < 5", "train_iter >= 5"):
        logs.write_query_log(rows.where(half), path)
    return spark.read.parquet(path).groupBy("train_iter").agg(F.count("*").alias("n"), F.sum("ground_truth_score_1").alias("total"))


@query("S4_label_batches", f"WITH {LOG}, e AS (SELECT 'env' || (pair_id % 3) AS env, train_iter, label FROM log) SELECT env, dense_rank() OVER (PARTITION BY env ORDER BY train_iter) AS round, count(*) AS n, CAST(sum(label) AS BIGINT) AS total FROM e GROUP BY env, train_iter")
def _(spark, d):
    path = V.scratch(spark, "batches")
    logs.write_label_batches(V.score_log(spark, d).withColumn("env", F.concat(F.lit("env"), (F.col("pair_id") % 3).cast("string"))), path)
    rounds = logs.read_label_batches(spark, path).groupBy("env", "round").agg(F.count("*").alias("n"), F.sum("label").alias("total"))
    return rounds.withColumn("round", F.col("round").cast("long"))


@query("S4_stream_label_batches", f"WITH {LOG}, e AS (SELECT 'env' || (pair_id % 3) AS env, train_iter, label FROM log) SELECT env, train_iter, count(*) AS n, CAST(sum(label) AS BIGINT) AS total FROM e GROUP BY env, train_iter")
def _(spark, d):
    """The same batches as a stream, whose rows are appended to a table."""
    path, out, state = (V.scratch(spark, f"batches-{x}") for x in ("in", "out", "state"))
    rows = V.score_log(spark, d).withColumn("env", F.concat(F.lit("env"), (F.col("pair_id") % 3).cast("string")))
    logs.write_label_batches(rows.repartition("env", "train_iter"), path)
    stream = logs.stream_label_batches(spark, path, "pair_id long, label int, env string, train_iter int", files=16)
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("env", "train_iter").agg(F.count("*").alias("n"), F.sum("label").alias("total"))


@query("S5_read_frames", f"WITH {EMB} SELECT CAST(id AS INT) AS number, 8 AS h, 8 AS w, list_aggregate(list_transform(vec, lambda v: printf('%02X', CAST(floor((v + 1) * 127) AS INT))), 'string_agg', '') AS pixels FROM emb")
def _(spark, d):
    """Each vector as an 8 x 8 grey PNG file, read back by the image source."""
    data = F.unhex(F.concat_ws("", F.transform("vec", lambda v: F.lpad(F.hex(F.floor((v + 1) * 127).cast("int")), 2, "0"))))
    frame = F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), data.alias("data"))
    name = F.concat(F.lit("first_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".png"))
    path = V.scratch(spark, "frames")
    logs.write_frames(V.embeddings(spark, d).select(name.alias("name"), frame.alias("frame")), path)
    return logs.read_frames(spark, path).select("number", "frame.h", "frame.w", F.hex("frame.data").alias("pixels"))


@query("S5_frame_keys", r"""WITH f AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/a/' || CASE WHEN event_id % 4 = 0 THEN 'first' ELSE 'second' END || '_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.png' ELSE '/b/step' || lpad(CAST(event_id AS VARCHAR), 7, '0') || '_episode' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '_1.png' END AS p FROM events)
SELECT event_id, nullif(regexp_extract(p, '(first|second)_', 1), '') AS side, TRY_CAST(regexp_extract(p, '(first|second)_(\d+)', 2) AS INT) AS number, TRY_CAST(regexp_extract(p, 'step(\d+)', 1) AS INT) AS step, TRY_CAST(regexp_extract(p, 'episode(\d+)', 1) AS INT) AS episode FROM f""")
def _(spark, d):
    e = F.col("event_id")
    one = F.concat(F.lit("/a/"), F.when(e % 4 == 0, "first").otherwise("second"), F.lit("_"), F.lpad(e.cast("string"), 6, "0"), F.lit(".png"))
    two = F.concat(F.lit("/b/step"), F.lpad(e.cast("string"), 7, "0"), F.lit("_episode"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lit("_1.png"))
    rows = V.table(spark, d, "events").select("event_id", F.when(e % 2 == 0, one).otherwise(two).alias("path"))
    return rows.select("event_id", *logs.frame_keys(F.col("path"))).drop("success")
