"""Measurements on pictures.

Two forms: masks as a pixel relation (id, y, x, v), measured by DataFrame aggregates; and whole
pictures, measured by one Arrow function per batch that emits a row of measures and an array of
defects.  A picture is a bounded unit of work, so pictures only need to be spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lerp
from . import kernels as K

# Colour limits, sizes and margins of the detectors.
BLUE_OVER_RED, MARK_SATURATION, MARK_VALUE = 120, 0.75, 120
LEAF_L, LEAF_B, LEAF_RATIO, LEAF_A = 45, 6, 1.5, 20
TAPE_L, TAPE_A, TAPE_B, TAPE_LONG, TAPE_AREA = 170, (-8, 6), 8, 6, 0.004
FLOOR_L, FLOOR_B, FLOOR_LONG, FLOOR_KEEP = 150, 25, 4, 0.2
GREEN_A, GREEN_B, WHITE_L, WHITE_C, BLACK_L, BLACK_SHAPE = 3, 5, 45, 3, 18, 2.5
SPECK, AROUND, SPECK_A, SPECK_MIN, BORDER = 6, 26, 2.0, 12, 20
HOLE_MARGIN, HOLE_LIGHT, THIN, THIN_LEFT, TEAR = 6.0, 15.0, 3, 4, 0.25
PROFILE_BINS, END_SHARE = 60, 0.18


# ---------------------------------------------------------------- pixel relations


def pixels(df: DataFrame, id_col: str, values: str, width: int) -> DataFrame:
    """(id, y, x, v) of arrays read row by row."""
    p = df.select(F.col(id_col).alias("id"), F.posexplode(values).alias("_k", "v"))
    return p.select("id", F.floor(F.col("_k") / width).cast("int").alias("y"), (F.col("_k") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def mask_metrics(on: DataFrame, height: int, width: int) -> DataFrame:
    """(id, area, coverage, box, touches) of masks given by their pixels."""
    m = on.groupBy("id").agg(F.count(F.lit(1)).alias("area"), *[f(c).alias(n) for f, c, n in ((F.min, "y", "y0"), (F.max, "y", "y1"), (F.min, "x", "x0"), (F.max, "x", "x1"))])
    return m.select("id", "area", (F.col("area") / (height * width)).alias("coverage"), "y0", "y1", "x0", "x1", (F.col("area") / ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))).alias("fill"),
                    ((F.col("y0") == 0) | (F.col("x0") == 0) | (F.col("y1") == height - 1) | (F.col("x1") == width - 1)).alias("touches"))


def _moments(places: Column) -> Column:
    """(a, c, b): sums of squares of x and of y and of their products about the means, by running means in the order of ``places``."""

    def step(m, p):
        n = m["n"] + 1.0
        mx, my = m["mx"] + (p["x"] - m["mx"]) / n, m["my"] + (p["y"] - m["my"]) / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), (m["a"] + (p["x"] - mx) * (p["x"] - m["mx"])).alias("a"), (m["c"] + (p["y"] - my) * (p["y"] - m["my"])).alias("c"),
                        (m["b"] + (p["y"] - m["my"]) * (p["x"] - mx)).alias("b"))

    return F.aggregate(places, F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mx", "my", "a", "c", "b")]), step)


def axes(on: DataFrame) -> DataFrame:
    """(id, n, mx, my, ex, ey): centroid and the main axis, its y not negative, from the sample covariance in closed form.

    A mask that spreads alike both ways has no main axis but for the last bit of its variances, so these
    are summed row by row, left to right, however the pixels are dealt over tasks: the places of a
    picture's mask are gathered.
    """
    places = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("y", "x")])))
    m = on.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), places.alias("_p")).where("n > 1")
    m = m.withColumn("_m", _moments(F.col("_p"))).select("id", "n", "mx", "my", *[(F.col("_m")[c] / (F.col("n") - 1)).alias(c) for c in ("a", "c", "b")])
    half = (F.col("a") - F.col("c")) / 2
    m = m.withColumn("l", (F.col("a") + F.col("c")) / 2 + F.sqrt(half * half + F.col("b") * F.col("b")))
    flat = F.abs("b") < 1e-12
    vx = F.when(flat, F.when(F.col("a") >= F.col("c"), 1.0).otherwise(0.0)).otherwise(F.col("b"))
    vy = F.when(flat, F.when(F.col("a") >= F.col("c"), 0.0).otherwise(1.0)).otherwise(F.col("l") - F.col("a"))
    m = m.withColumn("vx", vx).withColumn("vy", vy).withColumn("_n", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).withColumn("_s", F.when(F.col("vy") < 0, -1.0).otherwise(1.0))
    return m.select("id", "n", "mx", "my", (F.col("_s") * F.col("vx") / F.col("_n")).alias("ex"), (F.col("_s") * F.col("vy") / F.col("_n")).alias("ey"))


def in_frame(on: DataFrame, frame: DataFrame) -> DataFrame:
    """Pixels with their place along (t) and across (s) the axis; the crossing direction is (-ey, ex)."""
    j = on.join(frame, "id")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return j.withColumn("t", dx * F.col("ex") + dy * F.col("ey")).withColumn("s", -dx * F.col("ey") + dy * F.col("ex")).select(*on.columns, "t", "s")


def width_profile(framed: DataFrame, bins: int = PROFILE_BINS, least: int = 3) -> DataFrame:
    """(id, bin, n, width): extent across the axis in equal steps along it; 0 with too few pixels."""
    span = framed.groupBy("id").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    k = F.floor((F.col("t") - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0.0)) * bins)
    k = F.least(F.greatest(F.coalesce(k, F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int")
    out = framed.join(span, "id").withColumn("bin", k).groupBy("id", "bin").agg(F.count(F.lit(1)).alias("n"), (F.max("s") - F.min("s")).alias("w"))
    return out.select("id", "bin", "n", F.when(F.col("n") > least, F.col("w")).otherwise(0.0).alias("width"))


def bands(length: Column, inches: Column, tape: Column) -> dict[str, Column]:
    """Tip, base and vein margins in pixels, growing with the leaf's length in inches (half way if unknown)."""
    u = F.coalesce(lerp(inches, 14.7, 0.0, 16.9, 1.0), F.lit(0.5))
    return {"tip": (0.035 + u * 0.085) * length, "base": (0.085 + u * 0.091) * length, "vein": 0.6 * tape}


def zone(t: Column, s: Column, first: Column, last: Column, tip: Column, base: Column, vein: Column) -> Column:
    """Base, tip, vein, left or right: the first that holds."""
    return F.when(t > last - base, "base").when(t < first + tip, "tip").when(F.abs(s) < vein / 2, "vein").when(s > 0, "left").otherwise("right")


def region_stats(on: DataFrame, value: str = "v", least: int = 1) -> DataFrame:
    """(id, n, mean, sd, dark, light): moments and the shares 1.5 deviations off; null with too few pixels."""
    m = on.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) + 1e-6).alias("sd"))
    j = on.join(m, "id").groupBy("id", "n", "mean", "sd").agg(F.avg((F.col(value) < F.col("mean") - 1.5 * F.col("sd")).cast("double")).alias("dark"), F.avg((F.col(value) > F.col("mean") + 1.5 * F.col("sd")).cast("double")).alias("light"))
    return j.select("id", "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("mean", "sd", "dark", "light")])


def shoelace(points: Column) -> Column:
    """Area of a closed contour, an array of (x, y) in order."""
    nxt = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)) / 2


def net_area(outer: Column, holes: Column) -> Column:
    """Area of a contour less its holes."""
    return shoelace(outer) - F.aggregate(F.transform(holes, shoelace), F.lit(0.0), lambda a, x: a + x)


def components(df: DataFrame, id_col: str, mask: str, height: int, width: int, least: int = 1) -> DataFrame:
    """(id, part, area, cy, cx) of the 8-connected parts of masks given as arrays of booleans."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if m is None:
                    continue
                for k, p in enumerate(K.parts(np.array([bool(v) for v in m]).reshape(height, width), least)):
                    for c, v in zip(out, (i, k + 1, p.shape[1], float(p[0].mean()), float(p[1].mean()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64())], names=["id", "part", "area", "cy", "cx"])

    return df.select(F.col(id_col).alias("id"), F.col(mask).alias("m")).mapInArrow(run, f"id {kind}, part long, area long, cy double, cx double")


def neighbours(on: DataFrame, height: int, width: int) -> DataFrame:
    """(id, y, x, n): for every pixel beside or in a mask, how many of the 3 x 3 around it (itself too) are in the mask.

    Dilation is n >= 1, erosion n = the cells of the 3 x 3 inside the frame.
    """
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    hit = on.select("id", F.explode(steps).alias("d"), "y", "x").select("id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    return hit.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy("id", "y", "x").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- whole pictures


def marker_mask(rgb: np.ndarray) -> np.ndarray:
    """Saturated blue: a pen's mark."""
    c = rgb.astype(np.int64)
    top, low = c.max(axis=2), c.min(axis=2)
    saturation = np.where(top > 0, (top - low) / np.maximum(top, 1), 0)
    return (c[..., 2] - c[..., 0] > BLUE_OVER_RED) & (saturation > MARK_SATURATION) & (top > MARK_VALUE)


def _elongation(p: np.ndarray) -> tuple[float, float]:
    """Ratio of a part's axes, and the angle of the longer one in degrees."""
    if p.shape[1] < 3:
        return 0.0, 0.0
    val, vec = np.linalg.eigh(np.cov(np.stack([p[1], p[0]]).astype(float)))
    return (float(np.sqrt(val[1] / val[0])) if val[0] > 1e-6 else 0.0), float(np.degrees(np.arctan2(vec[1, 1], vec[0, 1])))


def tape_like(lab: np.ndarray) -> np.ndarray:
    return (lab[..., 0] > TAPE_L) & (lab[..., 1] > TAPE_A[0]) & (lab[..., 1] < TAPE_A[1]) & (lab[..., 2] < TAPE_B)


def find_tape(rgb: np.ndarray) -> dict:
    """The measuring tape: the largest long, light and neutral part.  state: ok, ambiguous or none."""
    m = K.opened(K.closed(tape_like(K.to_lab(rgb)), 12), max(1, min(rgb.shape[:2]) // 500))
    found = []
    for p in K.parts(m, int(np.ceil(TAPE_AREA * m.size))):
        ratio, angle = _elongation(p)
        if ratio >= TAPE_LONG:
            found.append((p.shape[1], ratio, angle, p))
    if not found:
        return {"state": "none", "angle": None, "ratio": None, "pixels": None}
    found.sort(key=lambda f: (-f[0], -f[1]))
    rival = len(found) > 1 and found[1][0] > 0.6 * found[0][0] and abs((found[1][2] - found[0][2] + 90) % 180 - 90) > 12
    return {"state": "ambiguous" if rival else "ok", "angle": found[0][2], "ratio": found[0][1], "pixels": found[0][3]}


def leaf_mask(rgb: np.ndarray, lab: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(mask, mask before filling, candidates, share of the candidates' area left out).

    A warm seed without tape; of its parts the one with the largest area times fill, a dark long strip
    (floor) only if no other is comparable; then grown into barely warm pixels that touch it, where
    'barely' lies just above the background of the picture itself; then filled.
    """
    lab = K.to_lab(rgb) if lab is None else lab
    light, a, b = np.moveaxis(lab, 2, 0)
    plain = ~tape_like(lab)
    warm = (b > LEAF_RATIO * a) & (a < LEAF_A) & (light > LEAF_L) & plain
    seed = warm & (b > LEAF_B) | marker_mask(rgb)
    r = max(1, min(rgb.shape[:2]) // 400)
    found = K.parts(K.closed(K.opened(seed, r), r))
    none = np.zeros(seed.shape, bool)
    if not found:
        return none, none, 0, 0.0
    area = np.array([p.shape[1] for p in found], float)
    sides = np.array([[np.ptp(p[0]) + 1, np.ptp(p[1]) + 1] for p in found], float)
    score = area * area / sides.prod(axis=1)
    floor = np.array([light[tuple(p)].mean() < FLOOR_L and b[tuple(p)].mean() < FLOOR_B for p in found]) & (sides.max(axis=1) / sides.min(axis=1) > FLOOR_LONG)
    if floor.any() and (~floor).any() and score[~floor].max() >= FLOOR_KEEP * score[floor].max():
        score[floor] = 0
    pick = none.copy()
    pick[tuple(found[int(score.argmax())])] = True
    rest = float(1 - pick.sum() / area.sum())
    away = ~K.dilate(seed, 15)
    barely = float(np.clip(np.percentile(b[away], 99) + 1, 0, LEAF_B)) if away.sum() > 5000 else 0.0
    grown = K.label8(K.closed(warm & (b > barely) | pick, r))
    touched = np.unique(grown[pick])
    raw = np.isin(grown, touched[touched > 0])
    return K.filled(raw), raw, len(found), rest


def reference_colours(lab: np.ndarray, edge: np.ndarray, r: int) -> dict:
    """Typical colours by signed distance from the outline (negative inside): ``off`` from r to 3 r outside it, ``own`` deeper than r inside.

    ``spread`` is the deviation of b over the latter.  A band of under 200 pixels gives way to all of its side.
    """
    inside = edge < 0

    def typical(band, side):
        chosen = band if np.count_nonzero(band) >= 200 else side
        return lab[chosen]

    off, own = typical((edge > r) & (edge <= 3 * r), ~inside), typical(edge < -r, inside)
    return {"off": np.median(off, axis=0) if len(off) else np.zeros(3), "own": np.median(own, axis=0), "spread": float(np.std(own[:, 2]))}


def signed_edge(mask: np.ndarray) -> np.ndarray:
    """Distance from the mask outside it, and less the distance from what is outside it inside."""
    return np.where(mask, -K.distance_to(~mask), K.distance_to(mask))


def colour_distance(lab: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distance in Lab with lightness at half weight."""
    d = lab - to
    return np.sqrt((d[..., 0] / 2) ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2)


def keep_thick(mask: np.ndarray, thin: float = THIN, left: int = THIN_LEFT) -> np.ndarray:
    """Parts of which an erosion leaves something: threads go."""
    core = K.erode(mask, thin)
    lab = K.label8(mask)
    count = np.bincount(lab[core], minlength=lab.max() + 1)
    good = np.flatnonzero(count >= left)
    return np.isin(lab, good[good > 0])


def holes_and_tears(rgb: np.ndarray, mask: np.ndarray, tape: float | None = None, explained: np.ndarray | None = None, true_only: bool = False, spread: float = 0.0, lab: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Holes: inside the leaf, nearer in colour to the background than to the leaf, cooler, neither glare nor mark.

    ``explained`` pixels belong to other defects; ``true_only`` keeps parts whose core has the
    background's colour; ``spread`` asks for that many robust deviations off the leaf's colour.
    Tears: what closing the leaf's outline adds.
    """
    if not mask.any():
        return mask.copy(), mask.copy()
    lab = K.to_lab(rgb) if lab is None else lab
    side = np.sqrt(mask.sum())
    r = max(2, int(0.02 * side))
    colours = reference_colours(lab, signed_edge(mask), r)
    off, own, sd = colours["off"], colours["own"], colours["spread"]
    mark = K.dilate(marker_mask(rgb), max(2, r // 2))
    d_own = colour_distance(lab, own)
    cool = lab[..., 2] < own[2] - np.clip(sd, HOLE_MARGIN, 15)
    cand = mask & (colour_distance(lab, off) < d_own) & cool & (lab[..., 0] < own[0] + HOLE_LIGHT) & ~mark
    if explained is not None:
        cand &= ~explained
    if spread > 0:
        inside = d_own[K.erode(mask, r) if K.erode(mask, r).sum() >= 200 else mask]
        mid = np.median(inside)
        cand &= d_own > mid + spread * 1.4826 * np.median(np.abs(inside - mid))
    cand = keep_thick(K.closed(K.opened(cand, 1), max(1, r // 3)))
    if true_only:
        lab8, keep = K.label8(cand), np.zeros_like(cand)
        for k in range(1, lab8.max() + 1):
            part = lab8 == k
            core = K.erode(part, 1)
            if core.sum() >= 12:
                c = np.median(lab[core], axis=0)
                if colour_distance(c, off) < colour_distance(c, own):
                    keep |= part
        cand = keep
    reach = max(3, int(TEAR * tape)) if tape else max(3, int(0.05 * side))
    return cand, K.closed(mask, reach) & ~mask & ~mark


def stains(rgb: np.ndarray, mask: np.ndarray, holes: np.ndarray | None = None, lab: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Green against the leaf, white and black against their surroundings (black ones also round valleys).

    The surroundings' medians are exact, and only taken where their bounds leave it open.
    """
    lab = np.stack([K.median_around(c, 3) for c in np.moveaxis(K.to_lab(rgb) if lab is None else lab, 2, 0)], axis=2)
    light, a, b = np.moveaxis(lab, 2, 0)
    chroma = np.hypot(a, b)
    if not mask.any():
        return {k: mask.copy() for k in ("green", "white", "black")}
    size = max(31, int(0.04 * max(mask.shape))) | 1
    low, high = K.median_between(light, size)
    g = K.gaussian(light, 2.0)
    gy, gx = np.gradient(g)
    (yy, yx), (_, xx) = np.gradient(gy), np.gradient(gx)
    mean, det = (xx + yy) / 2, xx * yy - yx * yx
    root = np.sqrt(np.maximum(0, mean * mean - det))
    one, two = mean + root, mean - root
    valley = (one > 0) & (two > 0) & (np.maximum(abs(one), abs(two)) / (np.minimum(abs(one), abs(two)) + 1e-6) < BLACK_SHAPE)

    def settled(maybe, values, test):
        """The pixels of ``maybe`` whose value passes against the median around it."""
        out = np.zeros_like(maybe)
        out[maybe] = test(values[maybe], K.median_at(values, size, maybe))
        return out

    white = settled(mask & (light > low + WHITE_L), light, lambda v, m: v > m + WHITE_L)
    found = {
        "green": mask & (a < np.median(a[mask]) - GREEN_A) & (b > GREEN_B),
        "white": settled(white, chroma, lambda v, m: v < m - WHITE_C),
        "black": settled(mask & valley & (light < high - BLACK_L), light, lambda v, m: v < m - BLACK_L),
    }
    free = ~holes if holes is not None else np.ones_like(mask)
    return {k: K.closed(K.opened(m & free, 3), 3) for k, m in found.items()}


def box_of(mask: np.ndarray, margin: int) -> tuple[slice, slice]:
    """The part of the picture that holds the mask and ``margin`` pixels around it."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return slice(max(0, ys[0] - margin), ys[-1] + margin + 1), slice(max(0, xs[0] - margin), xs[-1] + margin + 1)


SWEAT = ("sud_frac", "sud_n", "sud_dens", "sud_verdor_p95", "sud_verdor_med")


def greenness(lab: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """How much greener each pixel of the leaf is than its surroundings, at the size of specks."""
    flat = np.where(mask, lab[..., 1], np.median(lab[..., 1][mask]))
    return K.gaussian(flat, AROUND / 2) - K.gaussian(flat, SPECK / 2)


def specks_in(greener: np.ndarray, mask: np.ndarray, where: np.ndarray, limit: float) -> dict[str, float]:
    """Measures of the specks over ``limit`` in one region of the leaf (none in an empty one)."""
    area = float(where.sum())
    if not area:
        return dict.fromkeys(SWEAT, 0.0)
    specks = K.opened((greener > limit) & mask, 1) & where
    n = len(K.parts(specks, SPECK_MIN))
    return dict(zip(SWEAT, (float(specks.sum()) / area, float(n), 1e6 * n / area, float(np.percentile(greener[where], 95)), float(np.median(greener[where])))))


def away_from_border(mask: np.ndarray, border: int) -> np.ndarray:
    """The leaf without its border; a tiny leaf whole."""
    inner = K.erode(mask, border)
    return inner if inner.sum() >= 500 else mask


def sweat(rgb: np.ndarray, mask: np.ndarray, border: int = BORDER, limit: float = SPECK_A, greener: np.ndarray | None = None) -> dict[str, float]:
    """Specks greener than their surroundings, counted away from the leaf's border (a tiny leaf: everywhere)."""
    if not mask.any():
        return dict.fromkeys(SWEAT, 0.0)
    return specks_in(greenness(K.to_lab(rgb), mask) if greener is None else greener, mask, away_from_border(mask, border), limit)


def sweat_by_deviation(rgb: np.ndarray, mask: np.ndarray, border: int = BORDER, steps: tuple[int, ...] = (3, 4, 5), greener: np.ndarray | None = None) -> dict[str, float]:
    """The same measures with the limit at 3, 4 and 5 robust deviations (1.4826 MAD) over the leaf's median."""
    names = [f"{m}_k{k}" for k in steps for m in SWEAT]
    if not mask.any():
        return dict.fromkeys(names, 0.0)
    greener, where = greenness(K.to_lab(rgb), mask) if greener is None else greener, away_from_border(mask, border)
    mid = np.median(greener[where])
    mad = 1.4826 * np.median(np.abs(greener[where] - mid))
    return dict(zip(names, (v for k in steps for v in specks_in(greener, mask, where, mid + k * mad).values())))


def sweat_by_side(rgb: np.ndarray, mask: np.ndarray, border: int = BORDER, limit: float = SPECK_A, greener: np.ndarray | None = None) -> dict[str, float | None]:
    """Specks of the halves on either side of the vein: each measure left and right, its asymmetry and the ratio of the greater to the lesser."""
    out: dict[str, float | None] = {}
    if greener is None and mask.any():
        greener = greenness(K.to_lab(rgb), mask)
    side = vein_side(mask) if mask.any() else None
    where = away_from_border(mask, border)
    left, right = (specks_in(greener, mask, where & (side == v), limit) if mask.any() else dict.fromkeys(SWEAT, 0.0) for v in (1, -1))
    for m in SWEAT:
        a, b = left[m], right[m]
        out |= {f"{m}_left": a, f"{m}_right": b, f"{m}_asym": (a - b) / (a + b + 1e-6), f"{m}_ratio": max(a, b) / min(a, b) if min(a, b) > 0 else None}
    return out


def axis_of(xs: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """The main axis of points (its y not negative) in closed form, as ``axes`` has it for relations."""
    (a, b), (_, c) = np.cov(np.stack([xs, ys]))
    if abs(b) < 1e-12:
        return (1.0, 0.0) if a >= c else (0.0, 1.0)
    long = (a + c) / 2 + np.hypot((a - c) / 2, b)
    size = np.hypot(b, long - a) * (-1 if long < a else 1)
    return float(b / size), float((long - a) / size)


def extents(t: np.ndarray, s: np.ndarray, bins: int = PROFILE_BINS, least: int = 3) -> np.ndarray:
    """How far s reaches in equal steps of t; 0 in a step with too few points."""
    step = np.minimum(bins - 1, np.floor((t - t.min()) * (bins / max(1e-9, np.ptp(t))))).astype(int)
    order = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[order], np.arange(bins + 1))
    return np.array([np.ptp(s[order[a:b]]) if b - a > least else 0.0 for a, b in zip(cuts, cuts[1:])])


def leaf_frame(mask: np.ndarray) -> dict:
    """Axis frame of a mask: places t and s of its pixels, widths in 60 steps, the blade's extent and the base end.

    The blade is where the leaf has ``END_SHARE`` of its greatest width; the longer of the narrow ends
    beyond it is the base (the stalk's end).
    """
    ys, xs = np.nonzero(mask)
    dx, dy = xs - xs.mean(), ys - ys.mean()
    ex, ey = axis_of(dx, dy)
    t, s = dx * ex + dy * ey, dy * ex - dx * ey
    width = extents(t, s)
    blade = np.flatnonzero(width >= END_SHARE * width.max())
    before, after = int(blade[0]), PROFILE_BINS - 1 - int(blade[-1])
    step = np.ptp(t) / PROFILE_BINS
    return {
        "axis": np.array([ex, ey]), "t": t, "s": s, "ys": ys, "xs": xs, "width": width, "margin": abs(before - after),
        "first": t.min() + before * step, "last": t.max() - after * step, "base_first": before > after,
    }


def vein_line(t: np.ndarray, s: np.ndarray, bins: int = PROFILE_BINS, window: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The mid-line between the two edges: its s in equal steps of t, gaps interpolated, smoothed by a running median; and each point's step."""
    step = np.clip(((t - t.min()) / max(1e-9, np.ptp(t)) * bins).astype(int), 0, bins - 1)
    order = np.lexsort((s, step))
    known, begin = np.unique(step[order], return_index=True)
    last = np.r_[begin[1:], len(order)] - 1
    mid = np.interp(np.arange(bins), known, (s[order[begin]] + s[order[last]]) / 2)
    around = np.pad(mid, window // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(around, window), axis=1), step


def vein_side(mask: np.ndarray) -> np.ndarray:
    """1 on the left of the vein's line, -1 on its right, 0 off the leaf."""
    f = leaf_frame(mask)
    line, step = vein_line(f["t"], f["s"])
    out = np.zeros(mask.shape, dtype=np.int8)
    out[f["ys"], f["xs"]] = np.where(f["s"] > line[step], 1, -1)
    return out


COLOUR = ("mean_l", "sd_l", "mean_a", "mean_b", "sd_b", "dark", "green", "glare", "energy")


def colour_measures(lab: np.ndarray, energy: np.ndarray, where: np.ndarray, least: int = 200) -> dict[str, float | None]:
    """Nine measures of a region's colour; unknown with under ``least`` pixels.

    Means and deviations, the shares darker, greener and lighter than the mean by 1.5 deviations, and
    the mean gradient of the lightness.
    """
    if np.count_nonzero(where) < least:
        return dict.fromkeys(COLOUR)
    light, a, b = (c[where] for c in np.moveaxis(lab, 2, 0))
    far = lambda v, sign: float((sign * (v - v.mean()) > 1.5 * (v.std() + 1e-6)).mean())
    return dict(zip(COLOUR, (float(light.mean()), float(light.std() + 1e-6), float(a.mean()), float(b.mean()), float(b.std()), far(light, -1), far(a, -1), far(light, 1), float(energy[where].mean()))))


def tip_widths(frame: dict, inch: float, places: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0)) -> dict[str, float | None]:
    """Width in inches at distances from the tip; unknown with under 20 pixels there.  ``inch``: inches per pixel."""
    out = {}
    for d in places:
        near = np.abs(frame["t"] - (frame["first"] + d / inch)) <= max(2.0, 0.06 / inch)
        out[f"punta_{d:g}"] = float(np.ptp(frame["s"][near])) * inch if near.sum() >= 20 else None
    return out


def bites(mask: np.ndarray, frame: dict, tip: float, base: float, least: int, thick: float) -> list[tuple[np.ndarray, float]]:
    """Parts missing from the convex outline between tip and base, with how deep they reach."""
    outline = K.hull(mask)
    gone = outline & ~mask
    y, x = np.nonzero(gone)
    centre = np.array([frame["xs"].mean(), frame["ys"].mean()])
    t = (np.stack([x, y], axis=1) - centre) @ frame["axis"]
    out = (t > frame["last"] - base) | (t < frame["first"] + tip)
    gone[y[out], x[out]] = False
    depth = K.distance_to(~outline)
    core = K.distance_to(~gone)
    return [(p, float(depth[tuple(p)].max())) for p in K.parts(gone, least) if core[tuple(p)].max() * 2 >= thick]


TIPS = ("punta_0.25", "punta_0.5", "punta_1", "punta_2")
MEASURES = (
    "area", "coverage", "solidity", "touches", "mark_share", "left_out", *COLOUR, *SWEAT, *(f"{m}_k{k}" for k in (3, 4, 5) for m in SWEAT),
    *(f"{m}_{n}" for m in SWEAT for n in ("left", "right", "asym", "ratio")), *(f"{side}_{m}" for side in ("left", "right") for m in COLOUR),
    "n_holes", "n_tears", "n_bites", "base_margin", "tape", "inch", "length_in", "width_in", "area_in2", *TIPS, "vein_asym", "tilt",
)
DEFECT = "struct<kind:string,zone:string,area:bigint,t:double,s:double,depth:double>"


def measure(rgb: np.ndarray, tape: float | None = None, tape_inches: float = 1.0) -> tuple[dict, list[dict]]:
    """All measures of one picture, and its defects with their zones.

    ``tape``: the measuring tape's width in pixels if known, else what the picture shows of it; with
    it lengths are in inches too (``tape_inches`` is its width).  Without a tape the zones grow with
    the leaf's length, and measures in inches are unknown.
    """
    lab = K.to_lab(rgb)
    mask, _, _, rest = leaf_mask(rgb, lab)
    out = dict.fromkeys(MEASURES, None) | {"area": float(mask.sum()), "coverage": float(mask.mean()), "left_out": rest}
    if mask.sum() < 200:
        return out, []
    if tape is None:
        from .scale import tape_scale

        tape = tape_scale(rgb, lab)["width"]
    frame = leaf_frame(mask)
    length = frame["last"] - frame["first"]
    inch = tape_inches / tape if tape else None
    u = 0.5 if inch is None else float(np.clip((length * inch - 14.7) / (16.9 - 14.7), 0, 1))
    tip, base, vein = (0.035 + u * 0.085) * length, (0.085 + u * 0.091) * length, 0.6 * (tape or 0.05 * length)
    if frame["base_first"]:  # the base lies at the far end
        frame["axis"], frame["t"], frame["s"] = -frame["axis"], -frame["t"], -frame["s"]
        frame["first"], frame["last"] = -frame["last"], -frame["first"]
    spots = stains(rgb, mask, lab=lab)
    holes, tears = holes_and_tears(rgb, mask, tape, explained=spots["green"] | spots["white"], lab=lab)
    centre = np.array([frame["xs"].mean(), frame["ys"].mean()])
    across = np.array([-frame["axis"][1], frame["axis"][0]])
    defects = []
    chewed = bites(mask, frame, tip, base, 100, 0.02 * max(mask.shape))
    groups = [("hole", [(p, 0.0) for p in K.parts(holes, 25)]), ("tear", [(p, 0.0) for p in K.parts(tears, 25)]), ("bite", chewed), *[(k, [(p, 0.0) for p in K.parts(m, 60)]) for k, m in spots.items()]]
    for kind, found in groups:
        for p, depth in found:
            d = np.array([p[1].mean(), p[0].mean()]) - centre
            t, s = float(d @ frame["axis"]), float(d @ across)
            place = "base" if t > frame["last"] - base else "tip" if t < frame["first"] + tip else "vein" if abs(s) < vein / 2 else "left" if s > 0 else "right"
            defects.append({"kind": kind, "zone": place, "area": int(p.shape[1]), "t": t, "s": s, "depth": depth})
    energy, side, greener = K.gradient_energy(lab[..., 0]), vein_side(mask), greenness(lab, mask)
    halves = {"left": side == 1, "right": side == -1}
    box = box_of(mask, 2)  # specks lie on the leaf: what is far from it need not be looked at
    near = rgb[box], mask[box]
    out |= {
        "solidity": float(mask.sum() / K.hull(mask).sum()), "touches": float(mask[0].any() or mask[-1].any() or mask[:, 0].any() or mask[:, -1].any()), "mark_share": float(marker_mask(rgb)[mask].mean()),
        **colour_measures(lab, energy, mask), **{f"{k}_{m}": v for k, half in halves.items() for m, v in colour_measures(lab, energy, half).items()},
        **sweat(*near, greener=greener[box]), **sweat_by_deviation(*near, greener=greener[box]), **sweat_by_side(*near, greener=greener[box]), "base_margin": float(frame["margin"]),
        **{f"n_{k}s": float(sum(d["kind"] == k for d in defects)) for k in ("hole", "tear", "bite")},
        "tape": tape, "tilt": float(np.degrees(np.arctan2(frame["axis"][1], frame["axis"][0]))), "vein_asym": vein_asymmetry(lab[..., 0], mask),
    }
    if inch is not None:
        out |= {"inch": inch, "length_in": float(length) * inch, "width_in": float(frame["width"].max()) * inch, "area_in2": float(mask.sum()) * inch * inch, **tip_widths(frame, inch)}
    return out, defects


def measure_pictures(images: DataFrame, tape: str | None = None) -> DataFrame:
    """(path, measures, defects, error) of decoded pictures (path, h, w, rgb); a failure is a row with its reason.

    ``tape``: a column with the tape's width in pixels; unknown ones are measured.
    """
    schema = "path string, " + ", ".join(f"`{m}` double" for m in MEASURES) + f", defects array<{DEFECT}>, error string"
    slim = images.select("path", "h", "w", "rgb", (F.col(tape).cast("double") if tape else F.lit(None).cast("double")).alias("tape"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                row = dict.fromkeys(("path", *MEASURES, "defects", "error"))
                row["path"] = r["path"]
                try:
                    m, row["defects"] = measure(np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3), r["tape"])
                    row |= m
                except Exception as e:  # routed to review with its reason, never dropped
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=TARGET)

    struct = pa.struct([("kind", pa.string()), ("zone", pa.string()), ("area", pa.int64()), ("t", pa.float64()), ("s", pa.float64()), ("depth", pa.float64())])
    TARGET = pa.schema([("path", pa.string()), *[(m, pa.float64()) for m in MEASURES], ("defects", pa.list_(struct)), ("error", pa.string())])
    return slim.mapInArrow(run, schema)


def vein_asymmetry(light: np.ndarray, mask: np.ndarray) -> float:
    """Share of strong ridges left of the axis less that on the right; mirrored pictures change its sign."""
    box = box_of(mask, 32)  # farther than a ridge's window reaches
    light, mask = light[box], mask[box]
    frame = leaf_frame(mask)
    r = K.ridge(light)[frame["ys"], frame["xs"]]
    strong = r >= np.percentile(r, 90)
    left = frame["s"] > 0
    share = lambda side: float(strong[side].mean()) if side.any() else 0.0
    return share(left) - share(~left)
