"""Frames: (h, w, c, data) structs changed by chains of numpy operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.operators.kernels import apply_ops

FRAME = "h int, w int, c int, data binary"


def transform_frames(frames: DataFrame, ops: list[tuple], frame: str = "frame") -> DataFrame:
    """frames with the operations applied in turn: flip, crop a b c d, stride n, resize h w, left, right, reverse_channels, crop_to_colour low high size."""

    @F.pandas_udf(FRAME)
    def change(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data in zip(f["h"], f["w"], f["c"], f["data"]):
            image = apply_ops(np.frombuffer(data, np.uint8).reshape(h, w, c), ops)
            out.append((*image.shape, image.tobytes()))
        return pd.DataFrame(out, columns=["h", "w", "c", "data"])

    return frames.withColumn(frame, change(F.col(frame)))


def side_by_side(one: Column, two: Column) -> Column:
    """One frame of two of the same height."""

    @F.pandas_udf(FRAME)
    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x, y in zip(a.itertuples(index=False), b.itertuples(index=False)):
            image = np.concatenate([np.frombuffer(f.data, np.uint8).reshape(f.h, f.w, f.c) for f in (x, y)], axis=1)
            out.append((*image.shape, image.tobytes()))
        return pd.DataFrame(out, columns=["h", "w", "c", "data"])

    return join(one, two)


def to_tensor(frame: Column) -> Column:
    """Channels first, as floats from 0 to 1, flattened."""

    @F.pandas_udf("array<float>")
    def change(f: pd.DataFrame) -> pd.Series:
        return pd.Series([(np.frombuffer(d, np.uint8).reshape(h, w, c).transpose(2, 0, 1).ravel() / np.float32(255)).astype(np.float32) for h, w, c, d in zip(f["h"], f["w"], f["c"], f["data"])])

    return change(frame)
