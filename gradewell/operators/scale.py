"""How large a pixel is: the measuring tape in a picture, its marks and width, and masks at another resolution."""

from __future__ import annotations

import numpy as np

from . import kernels as K
from .raster import TAPE_AREA, TAPE_LONG, axis_of, extents, tape_like

PERIODS = np.arange(4.0, 120.0, 0.5)  # pixels between two marks that are tried


def comb(places: np.ndarray, periods: np.ndarray = PERIODS) -> tuple[float, float]:
    """The period that places follow best, and how strongly (0 to 1): the length of their mean phase; twice the period while that is nearly as strong."""
    if len(places) < 4:
        return 0.0, 0.0
    phase = np.exp(2j * np.pi * places[None, :] / periods[:, None])
    strength = np.abs(phase.mean(axis=1))
    best = int(strength.argmax())
    while 2 * periods[best] <= periods[-1]:  # a fraction of the period fits all places too
        double = int(np.abs(periods - 2 * periods[best]).argmin())
        if strength[double] < 0.85 * strength[best]:
            break
        best = double
    return float(periods[best]), float(strength[best])


def variation(widths: np.ndarray) -> float:
    """Deviation of positive widths over their mean; 1 if there are none."""
    some = widths[widths > 0]
    return float(some.std() / some.mean()) if len(some) else 1.0


def tape_marks(light: np.ndarray, part: np.ndarray) -> dict:
    """Width of a strip, its variation along it, and the dark marks across it: places, period and strength.

    ``part``: (ys, xs).  A mark is a run of steps along the strip that are darker than half way from
    its typical to its darkest lightness.
    """
    ys, xs = part
    dx, dy = xs - xs.mean(), ys - ys.mean()
    ex, ey = axis_of(dx, dy)
    t, s = dx * ex + dy * ey, dy * ex - dx * ey
    steps = max(8, int(np.ptp(t)) + 1)
    widths = extents(t, s, bins=max(8, steps // 8))
    place = np.minimum(steps - 1, ((t - t.min()) / max(1e-9, np.ptp(t)) * steps).astype(int))
    count = np.bincount(place, minlength=steps)
    shade = np.interp(np.arange(steps), np.flatnonzero(count), (np.bincount(place, weights=light[ys, xs], minlength=steps)[count > 0] / count[count > 0]))
    typical, darkest = np.median(shade), np.percentile(shade, 2)
    dark = np.r_[False, shade < (typical + darkest) / 2, False] if typical - darkest > 2 else np.zeros(steps + 2, bool)
    turns = np.flatnonzero(dark[1:] != dark[:-1])
    marks = (turns[::2] + turns[1::2] - 1) / 2
    period, strength = comb(marks)
    some = widths[widths > 0]
    return {"width": float(np.median(some)) if len(some) else 0.0, "cv": variation(widths), "marks": marks, "period": period, "strength": strength}


def tape_scale(rgb: np.ndarray, lab: np.ndarray | None = None) -> dict:
    """The strip that most looks like a measuring tape: score = strength of its marks / (1 + variation of its width).

    ``state``: ok, ambiguous (another one scores over 0.9 of it) or none; ``width`` in pixels is
    unknown unless it is ok.
    """
    lab = K.to_lab(rgb) if lab is None else lab
    like = tape_like(lab)
    solid = K.closed(like, 12)  # marks belong to the strip that they cross
    solid = K.opened(solid, max(1, min(rgb.shape[:2]) // 500))
    found = []
    for p in K.parts(solid, int(np.ceil(TAPE_AREA * solid.size))):
        val = np.linalg.eigvalsh(np.cov(p.astype(float)))
        if val[0] > 1e-6 and np.sqrt(val[1] / val[0]) >= TAPE_LONG:
            m = tape_marks(lab[..., 0], p)
            found.append(m | {"score": m["strength"] / (1 + m["cv"]), "pixels": p})
    found.sort(key=lambda m: (-m["score"], -m["pixels"].shape[1]))
    if not found:
        return {"state": "none", "width": None, "score": 0.0, "period": None}
    clear = len(found) == 1 or found[1]["score"] <= 0.9 * found[0]["score"]
    return found[0] | {"state": "ok" if clear else "ambiguous", "width": found[0]["width"] if clear and found[0]["width"] > 0 else None}


def rescaled(width: float | None, side_measured: int, side_now: int) -> float | None:
    """A tape's width in pixels of the picture at another resolution; unknown stays unknown."""
    return None if not width or width <= 0 else width * side_now / side_measured


def inches(pixels: float, tape: float | None, tape_inches: float = 1.0) -> float | None:
    """A length in inches by the tape beside it."""
    return pixels * tape_inches / tape if tape else None


def round_diameter(area: float, inch: float) -> float:
    """Diameter in millimetres of the disc with that area in pixels."""
    return 2 * float(np.sqrt(area / np.pi)) * inch * 25.4


def finer_mask(mask: np.ndarray, height: int, width: int, shave: float | None = None) -> np.ndarray:
    """A mask at a higher resolution: the nearest pixel, less the steps that this makes at the outline.

    ``shave``: how much of the outline goes, in pixels of the result; else half a pixel of the mask.
    """
    ys = np.minimum((np.arange(height) + 0.5) * mask.shape[0] / height, mask.shape[0] - 1).astype(int)
    xs = np.minimum((np.arange(width) + 0.5) * mask.shape[1] / width, mask.shape[1] - 1).astype(int)
    big = mask[np.ix_(ys, xs)]
    return K.erode(big, max(height / mask.shape[0], width / mask.shape[1]) / 2 if shave is None else shave)
