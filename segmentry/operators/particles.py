"""Particle states: distances to goals, counts in boxes, folds, covered area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.sources.shared import sized

STEP = ["run", "episode", "t"]


def _apart(ax: str, ay: str, az: str, bx: str, by: str, bz: str):
    return F.sqrt(sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in ((ax, bx), (ay, by), (az, bz))), F.lit(0.0)))


def goal_distance(particles: DataFrame, goal: DataFrame) -> DataFrame:
    """(step, mean_distance, reward): mean distance to each particle's goal; the reward is -10 times it. The goal has a row a particle id and is broadcast if those are few enough."""
    met = particles.join(sized(goal), "particle_id")
    mean = met.groupBy(*STEP).agg(F.avg(_apart("x", "y", "z", "gx", "gy", "gz")).alias("mean_distance"))
    return mean.withColumn("reward", F.col("mean_distance") * -10)


def count_in_box(particles: DataFrame, boxes: DataFrame) -> DataFrame:
    """(step, box, n_inside, n): particles inside a step's box, of all. Bounds belong to the box. A step may have several boxes, told apart by a column `box`; without it boxes are a row a step."""
    keys = [*STEP, *(["box"] if "box" in boxes.columns else [])]
    met = particles.join(boxes, STEP)
    inside = F.col("x").between(F.col("x_lo"), F.col("x_hi")) & F.col("y").between(F.col("y_lo"), F.col("y_hi")) & F.col("z").between(F.col("z_lo"), F.col("z_hi"))
    return met.groupBy(*keys).agg(F.count(F.when(inside, 1)).alias("n_inside"), F.count("*").alias("n"))


def fill_share(particles: DataFrame, target: tuple[float, ...], excluded: tuple[float, ...], amount: float = 1.0) -> DataFrame:
    """(step, share, deviation): the share of particles in the target box and not in the excluded one, and how far it is from an amount. Boxes are six numbers."""

    def inside(box: tuple[float, ...]):
        return F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]) & F.col("z").between(box[4], box[5])

    share = F.avg((inside(target) & ~inside(excluded)).cast("double"))
    return particles.groupBy(*STEP).agg(share.alias("share")).withColumn("deviation", F.abs(F.col("share") - amount))


def fold_distance(particles: DataFrame, mapping: DataFrame) -> DataFrame:
    """(step, fold, moved, reward): mean distance of mirrored points a and b, mean way of the points b from the first step; reward is -(fold + 1.2 moved)."""
    pos = particles.select(*STEP, "particle_id", "x", "y", "z")
    a = pos.join(sized(mapping), F.col("particle_id") == F.col("a")).drop("particle_id", "a")
    b = pos.withColumnsRenamed({"particle_id": "b", "x": "bx", "y": "by", "z": "bz"})
    first = pos.where("t = 0").select("run", "episode", F.col("particle_id").alias("b"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("z").alias("fz"))
    met = a.join(b, [*STEP, "b"]).join(first, ["run", "episode", "b"])
    out = met.groupBy(*STEP).agg(F.avg(_apart("x", "y", "z", "bx", "by", "bz")).alias("fold"), F.avg(_apart("bx", "by", "bz", "fx", "fy", "fz")).alias("moved"))
    return out.withColumn("reward", -(F.col("fold") + F.col("moved") * 1.2))


def covered_area(particles: DataFrame, radius: float, cells: int = 100) -> DataFrame:
    """(step, n_cells, area): each particle marks the cells within its radius on a grid over the step's extent; area is that of distinct cells.

    Ends are rounded half to even and clipped. Cells are numbered x * cells + y, as ends may be `cells`; the last number closes the grid.
    """
    edge = particles.groupBy(*STEP).agg(F.min("x").alias("x0"), F.min("z").alias("z0"), ((F.max("x") - F.min("x")) / cells).alias("dx"), ((F.max("z") - F.min("z")) / cells).alias("dz"))
    met = particles.join(edge, STEP).where("dx > 0 and dz > 0")
    low = lambda c, o, d: F.greatest(F.bround((F.col(c) - F.col(o) - radius) / F.col(d)), F.lit(0.0)).cast("int")
    high = lambda c, o, d: F.least(F.bround((F.col(c) - F.col(o) + radius) / F.col(d)), F.lit(float(cells))).cast("int")
    spans = met.select(*STEP, "dx", "dz", low("x", "x0", "dx").alias("xl"), high("x", "x0", "dx").alias("xh"), low("z", "z0", "dz").alias("zl"), high("z", "z0", "dz").alias("zh")).distinct()
    # A particle is a run of cells in each row i; runs are merged, not their cells. A cell past a row's end is the first of the next row, past the last row the grid's last.
    rows = spans.withColumn("i", F.explode(F.sequence("xl", "xh")))
    run = lambda i, a, b: F.struct(i.cast("int").alias("i"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    i, end, corner = F.col("i"), F.lit(cells - 1), run(F.lit(cells - 1), F.lit(cells - 1), F.lit(cells - 1))
    own = F.when(i == cells, corner).otherwise(run(i, F.col("zl"), F.least("zh", end)))
    past = F.when((i < cells) & (F.col("zh") == cells), F.when(i == end, corner).otherwise(run(i + 1, F.lit(0), F.lit(0))))
    runs = rows.select(*STEP, "dx", "dz", F.explode(F.array_compact(F.array(own, past))).alias("r")).select(*STEP, "dx", "dz", "r.i", "r.a", "r.b").where("a <= b").distinct()
    reached = F.max("b").over(Window.partitionBy(*STEP, "i").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a") - 1, F.coalesce(reached, F.lit(-1))))
    counted = runs.withColumn("fresh", fresh).groupBy(*STEP, "dx", "dz").agg(F.sum("fresh").alias("n_cells"))
    return counted.select(*STEP, "n_cells", (F.col("n_cells") * F.col("dx") * F.col("dz")).alias("area"))
