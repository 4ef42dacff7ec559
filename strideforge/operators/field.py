"""Pressure field over the foot: inverse-distance weights of the six sensors, applied to averaged readings."""

import numpy as np
from pyspark.sql import functions as F

from strideforge.schemas import CENTRES_MM, CHANNELS, LENGTH_MM, WIDTH_MM


# The outline's vertices, in units of its own box.
OUTLINE = [
    (0.30, 0.02), (0.20, 0.08), (0.16, 0.20), (0.18, 0.34), (0.22, 0.48), (0.20, 0.62), (0.18, 0.76), (0.20, 0.88),
    (0.28, 0.96), (0.42, 0.99), (0.58, 0.99), (0.72, 0.96), (0.80, 0.88), (0.82, 0.76), (0.80, 0.62), (0.80, 0.48),
    (0.82, 0.34), (0.80, 0.20), (0.72, 0.08), (0.58, 0.02),
]


def foot_mask(x, y, outline=OUTLINE):
    """Whether points of the unit box lie inside the outline stretched to that box (number of edges crossed is odd)."""
    v = np.array(outline)
    v = (v - v.min(0)) / np.ptp(v, axis=0)
    inside = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(v, np.roll(v, -1, 0)):
        if y1 != y2:
            across = (y1 > y) != (y2 > y)
            inside ^= across & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def weights(spark, power=2.0, length=LENGTH_MM, width=WIDTH_MM):
    """One row per cell of a grid of about 1 mm (24,934 cells): gx, gy, inside, w0..w5; a cell on a sensor takes it alone."""
    nx, ny = round(width), round(length)
    gy, gx = (g.ravel() for g in np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij"))
    x, y = gx / (nx - 1), gy / (ny - 1)
    d = np.sqrt(np.stack([(x * width / length - a / length) ** 2 + (y - b / length) ** 2 for a, b in CENTRES_MM], 1))
    hit = d < 1e-9
    w = 1 / np.where(hit, 1, d) ** power
    w[hit.any(1)] = 0
    w[hit] = 1
    w /= w.sum(1, keepdims=True)
    inside = foot_mask(x, y)
    rows = [(int(a), int(b), bool(m), *map(float, v)) for a, b, m, v in zip(gx, gy, inside, w)]
    return spark.createDataFrame(rows, "gx int, gy int, inside boolean, " + ", ".join(f"w{i} double" for i in range(len(CENTRES_MM))))


def mean_field(frames, grid, by, max_keys=10_000):
    """Mean pressure of each cell per key: the field is linear, so readings are averaged first; null outside the foot.

    Every key gives a row for each cell of the grid, so more than max_keys keys are refused (None: any number).
    """
    means = frames.groupBy(*by).agg(*[F.avg(c).alias(c) for c in CHANNELS])
    if max_keys is not None and means.limit(max_keys + 1).count() > max_keys:
        raise ValueError(f"more than {max_keys} keys; each gives a row for every cell of the grid")
    value = sum((F.col(f"w{i}") * F.col(c) for i, c in enumerate(CHANNELS)), F.lit(0.0))
    return means.join(F.broadcast(grid)).select(*by, "gx", "gy", F.when(F.col("inside"), value).alias("value"))  # grid: a fixed size
