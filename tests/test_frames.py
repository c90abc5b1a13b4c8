import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from segmentry.operators import frames, kernels, label
from segmentry.sources import logs


def png(image):
    h, w, _ = image.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in image)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image(h=6, w=8, c=3):
    return np.random.default_rng(0).integers(0, 256, (h, w, c), dtype=np.uint8)


def rows_of(spark, x):
    return spark.createDataFrame([(1, (*x.shape, bytearray(x.tobytes())))], "id long, frame struct<h: int, w: int, c: int, data: binary>")


def array(frame):
    return np.frombuffer(bytes(frame["data"]), np.uint8).reshape(frame["h"], frame["w"], frame["c"])


def test_read_frames(spark, tmp_path):
    x = image()
    for name in ("first_000012.png", "step0004000_episode03_1.png"):
        (tmp_path / name).write_bytes(png(x))
    rows = {r["side"]: r for r in frames.transform_frames(logs.read_frames(spark, str(tmp_path)), [("reverse_channels",)]).collect()}
    assert rows["first"]["number"] == 12 and (rows[None]["step"], rows[None]["episode"], rows[None]["success"]) == (4000, 3, 1)
    assert all((array(r["frame"]) == x).all() for r in rows.values())


def test_transforms(spark):
    x = image()
    rows = rows_of(spark, x)
    for ops, want in (
        ([("flip",)], x[::-1]),
        ([("crop", 1, 5, 2, 6), ("stride", 2)], x[1:5:2, 2:6:2]),
        ([("left",)], x[:, :4]),
        ([("resize", 6, 8)], x),
    ):
        assert (array(frames.transform_frames(rows, ops).first()["frame"]) == want).all()
    both = rows.withColumn("frame", frames.side_by_side(F.col("frame"), F.col("frame")))
    assert (array(frames.transform_frames(both, [("right",)]).first()["frame"]) == x).all()
    assert rows.select(frames.to_tensor(F.col("frame")).alias("t")).first()["t"] == pytest.approx((x.transpose(2, 0, 1) / 255).ravel(), abs=1e-6)


def test_crop_to_colour():
    x = np.zeros((20, 20, 3), np.uint8)
    x[12:14, 3:5] = (0, 200, 0)
    assert kernels.crop_to_colour(x, (0, 100, 0), (50, 255, 50), 6).shape == (6, 6, 3)
    assert (kernels.crop_to_colour(x, (0, 100, 0), (50, 255, 50), 6) == (0, 200, 0)).all(axis=2).sum() == 4
    assert kernels.resize(np.full((4, 4, 1), 9, np.uint8), 7, 3).tolist() == np.full((7, 3, 1), 9).tolist()


class Failing:
    def ask(self, prompt, images):
        if prompt == "bad":
            raise ConnectionError
        return "1" if images else f"so: {prompt}"


def test_labelling_survives_failures(spark):
    pairs = spark.createDataFrame([(0, "bad"), (1, "good")], "pair_id long, query string").selectExpr("pair_id", "query", "'{reply}' summary", "binary('a') image_1", "binary('b') image_2")
    got = {r.pair_id: (r.reply, r.label) for r in label.label_pairs(pairs, Failing, 2, tries=2, pause=0.0).collect()}
    assert got == {0: (None, -1), 1: ("so: 1", 1)}
