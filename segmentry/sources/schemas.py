"""Schemas of the tables that jobs exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame

FRAME = "struct<h: int, w: int, c: int, data: binary>"
STEP_KEYS = "run_id string, env string, episode bigint, t int, step bigint"
TRANSITIONS = f"{STEP_KEYS}, obs array<float>, action array<float>, reward double, next_obs array<float>, done boolean, done_no_max boolean, info map<string,double>, frame {FRAME}"
QUERY_LOG = "ground_truth_score_1 double, ground_truth_score_2 double, vlm_predicted_label int, timestamp double, train_iter int"
METRICS = "run_id string, split string, key string, step bigint, value double, n bigint"
SEGMENT = "struct<run_id: string, episode: bigint, start: int, len: int, sa: array<array<float>>, r: array<double>>"
PREFERENCES = f"pair_id bigint, env string, train_iter int, arrival bigint, seg1 {SEGMENT}, seg2 {SEGMENT}, rational_label int, label int, score double, useful boolean"
PARTICLES = "run_id string, episode bigint, t int, particle_id bigint, x double, y double, z double"
TASKS = "env string, rand_vec array<double>, split string"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
