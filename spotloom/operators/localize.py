"""From stacks to spots: each picture is a row, and a batch of pictures a call, so any number of videos spreads evenly.

Pictures do not depend on each other once the stack's range is known, so one aggregation (the range) and one pass over
pictures make a table of spots. image.py has the same steps as joins and aggregations of pixels, for pictures too large
for a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators import graph
from spotloom.operators.image import gauss_psf
from spotloom.schemas import LOC


#: Videos whose ranges, some tens of bytes each, are broadcast.
FEW_VIDEOS = 200_000


@dataclass(frozen=True)
class Options:
    """Window of detection, factor of the threshold, reach of maxima, rounds with spots taken out, and border seed.

    smooth is how often the ring around a spot that was taken out is smoothed (the usual 2 may blur a faint neighbour away).
    """

    window: int = 7
    alpha: float = 1.0
    shift: int = 1
    deflations: int = 0
    seed: int = 42
    smooth: int = 0


def windows(window: int) -> tuple[tuple[int, float], list[tuple[int, float]]]:
    """The window (odd, 5 at least) with its radius, and the three around it that later rounds look with."""
    w = max(5, window)
    w += 1 - w % 2
    sized = [(s, (s // 2) / 2.0) for s in (w - 2, w, w + 2)]
    return sized[1], sized


def bordered(picture: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """A picture within a border of noise, drawn block by block from the mean and spread of what lies beside each block.

    The top, right, bottom and left strips are filled in this order from the strip inward of each, so the corners take
    from strips filled before them. Then the inner blocks of each strip are drawn anew from the mean of the two blocks
    along it, which lie in the strip itself at the top and left, and inward of it on the right and at the bottom.
    """
    h, w = picture.shape
    out = np.zeros((h + 2 * width, w + 2 * width))
    out[width : width + h, width : width + w] = picture
    top, bottom, left, right = out[:width], out[-width:], out[:, :width].T, out[:, -width:].T
    below, above = out[width : 2 * width], out[-2 * width : -width]
    after, before = out[:, width : 2 * width].T, out[:, -2 * width : -width].T

    def draw(block: np.ndarray, like: np.ndarray) -> None:
        block[:] = rng.normal(like.mean(), like.std(), block.shape)

    for strip, beside, end in ((top, below, -width), (right, before, -width), (bottom, above, None), (left, after, None)):
        stop = strip.shape[1] + (end or 0)
        for at in range(0, stop, width):
            part = slice(at, min(stop, at + width))
            draw(strip[:, part], beside[:, part])
    for strip, source in ((top, top), (right, before), (bottom, above), (left, left)):
        long = strip.shape[1]
        for at in list(range(0, long, width))[1:-1]:
            size = min(width, long - at - width)
            draw(strip[:, at : at + width], (source[:, at - size : at] + source[:, at + width : at + width + size]) / 2)
    return out


def smooth_ring(picture: np.ndarray, box: tuple[slice, slice], reach: int = 2, rounds: int = 2) -> None:
    """Sets each pixel on the ring of a box to the mean around it, one after the other, so that later ones see earlier ones."""
    rows, cols = (range(s.start, s.stop) for s in box)
    ring = [(r, c) for c in cols for r in (rows[0], rows[-1])] + [(r, c) for r in rows for c in (cols[0], cols[-1])]
    for r, c in ring * rounds:
        picture[r, c] = picture[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1].mean()


def background(picture: np.ndarray, rounds: int = 3, clip: float = 3.0) -> tuple[float, float]:
    """Mean and spread of the pixels around the mode, in hundredths of the greatest, as image.background has them."""
    top = picture.max()
    level = np.floor(np.round(picture / top * 100, 9)).astype(int).ravel() if top > 0 else np.zeros(picture.size, int)
    n = np.bincount(level, minlength=101).astype(float)
    value, bins = np.arange(len(n)) / 100, max(1, int(level.max()))
    on = np.ones(len(n), bool)
    for _ in range(rounds):
        m = np.where(on, n, 0)
        if m.sum() == 0:
            return 0.0, 0.0
        mode = int(np.bincount(np.minimum(np.arange(len(n)), bins - 1), m).argmax()) * 0.01 + 0.005
        sd = np.sqrt(max(0.0, (m * value**2).sum() / m.sum() - ((m * value).sum() / m.sum()) ** 2))
        on = (value > mode - clip * sd) & (value < mode + clip * sd)
    m = np.where(on, n, 0)
    if m.sum() == 0:
        return 0.0, 0.0
    mean = (m * value).sum() / m.sum()
    return float(mean), float(np.sqrt(max(0.0, (m * value**2).sum() / m.sum() - mean**2)))


def scores(wide: np.ndarray, border: int, shape: tuple[int, int], window: int, radius: float, mean: float) -> np.ndarray:
    """The log likelihood ratio of a spot at each pixel of the picture inside its border."""
    g = np.array([v for *_, v in gauss_psf(window, radius)]).reshape(window, window)
    g -= g.mean()
    big, n, a = (g * g).sum(), window * window, border - window // 2
    crops = np.lib.stride_tricks.sliding_window_view(wide[a : a + shape[0] + window - 1, a : a + shape[1] + window - 1], (window, window))
    fit = np.maximum(0.0, np.einsum("rcij,ij->rc", crops, g) / big)
    base = n * mean * mean - n * mean
    ratio = fit * fit * big / (base if abs(base) >= 1e-12 else 1e-12)
    return n / 2 * np.log(1 - np.where(ratio >= 1, 1 - 1e-7, ratio))


def maxima(score: np.ndarray, limit: float, window: int, shift: int) -> list[tuple[int, int]]:
    """Pixels above the limit that are the greatest within shift, best first; each keeps others out of its half window."""
    padded = np.pad(score, shift, constant_values=-np.inf)
    around = np.lib.stride_tricks.sliding_window_view(padded, (2 * shift + 1,) * 2).max((2, 3))
    at = np.argwhere((score > limit) & (score == around))
    free, half, found = np.ones(score.shape, bool), window // 2, []
    for r, c in at[np.argsort(-score[tuple(at.T)], kind="stable")]:
        if free[r, c]:
            found.append((int(r), int(c)))
            free[max(0, r - half) : r + half, max(0, c - half) : c + half] = False
    return found


def regions(score: np.ndarray, limit: float, window: int, shift: int) -> list[tuple[int, int]]:
    """Pixels above the limit that are the greatest within shift (half the window if 0), from the top, twice over.

    Each takes the pixels within its reach out, so what they hid may be found after it.
    """
    reach, left, found = shift or window // 2, np.where(score > limit, score, 0.0), []
    for _ in range(2):
        for r, c in np.argwhere(left):
            around = left[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1]
            if left[r, c] > 0 and left[r, c] == around.max():
                found.append((int(r), int(c)))
                around[:] = 0
    return found


def fit(patches: np.ndarray, mean: float, repeat: int = 5) -> list[tuple[np.ndarray, np.ndarray, float] | None]:
    """Centre, covariance and amplitude of a spot in each patch above its background; None where no spot fits.

    Weighted least squares of log intensity on a quadratic, with the squares of the model before as weights, until the
    coefficients of a patch rest. All patches are solved together, each as a system of six equations. nan is no pixel.
    Patches where no spot fits are lowered once more and tried again, one time more often.
    """
    low = _lowered(patches, mean)
    found = _solved(low, repeat)
    if failed := [i for i, spot in enumerate(found) if spot is None]:
        for i, spot in zip(failed, _solved(_lowered(low[failed], mean), repeat + 1), strict=True):
            found[i] = spot
    return found


def _lowered(patches: np.ndarray, mean: float) -> np.ndarray:
    """Patches less the background, raised so that their least pixel is just positive."""
    v = patches - mean
    return v - np.nanmin(v, (1, 2), keepdims=True) + 0.01


def _solved(patches: np.ndarray, repeat: int) -> list[tuple[np.ndarray, np.ndarray, float] | None]:
    half = patches.shape[1] // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1].reshape(2, -1).astype(float)
    design = np.stack([x * x, x, y * y, y, x * y, np.ones_like(x)], 1)
    products = (design[:, :, None] * design[:, None, :]).reshape(len(x), 36)
    v = patches.reshape(len(patches), -1)
    there = ~np.isnan(v)  # pixels beyond the picture weigh nothing
    v = np.where(there, v, 1.0)
    target, w = np.log(v), np.where(there, v * v, 0.0)
    coef, moving = np.full((len(v), 6), np.nan), np.ones(len(v), bool)
    for _ in range(repeat):
        inverse = np.linalg.pinv((w[moving] @ products).reshape(-1, 6, 6), rcond=1e-12, hermitian=True)
        new = np.einsum("nij,nj->ni", inverse, (w[moving] * target[moving]) @ design)
        rest = np.isclose(new, coef[moving], rtol=1e-7, atol=0).all(1)
        coef[moving] = new
        w[moving] = np.where(there[moving], np.exp(np.clip(2 * (new @ design.T), -50, 50)), 0.0)
        moving[moving] = ~rest
        if not moving.any():
            break
    return [_spot(c, half) for c in coef]


def _spot(coef: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    a, b, c, d, e, f = coef
    h = np.array([[-2 * a, -e], [-e, -2 * c]])
    if not (h[0, 0] > 0 and (det := h[0, 0] * h[1, 1] - e * e) > 1e-12):
        return None
    cov = np.array([[h[1, 1], e], [e, h[0, 0]]]) / det
    centre = cov @ (b, d)
    if max(cov[0, 0], cov[1, 1]) > 3 * (2 * half + 1) or np.abs(centre).max() > half + 1:
        return None
    return centre, cov, float(np.exp(np.clip(f + 0.5 * (b * centre[0] + d * centre[1]), -50, 50)))


def _bell(window: int, centre: np.ndarray, cov: np.ndarray, amp: float) -> np.ndarray:
    half = window // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    p, dx, dy = np.linalg.inv(cov), x - centre[0], y - centre[1]
    return amp * np.exp(-0.5 * (p[0, 0] * dx * dx + 2 * p[0, 1] * dx * dy + p[1, 1] * dy * dy))


def find_spots(picture: np.ndarray, options: Options, frame: int = 0) -> tuple[list[dict], np.ndarray]:
    """Spots of a picture scaled to [0, 1], and what is left of it with them taken out.

    The first round looks with one window; each further one with three, the largest first, for what the rounds before,
    whose spots are taken out down to the background, have hidden. The border depends on the frame's number alone, not on
    frames before it.
    """
    (first, radius), several = windows(options.window)
    border = 2 * (first + 4)
    mean, sd = background(picture)
    limit = options.alpha * (max(1.0, 2 * sd * sd / mean**2) if sd > 0 and mean != 0 else 1.0)
    wide = bordered(picture, border, np.random.default_rng([options.seed, frame]))
    h, w = picture.shape
    out: list[dict] = []
    for n in range(1 + options.deflations):
        looks = reversed(several) if n else [(first, radius)]
        maps = [(window, scores(wide, border, (h, w), window, rad, mean) * (several[0][0] ** 2 / window**2 if n else 1.0)) for window, rad in looks]
        for window, score in maps:
            half = window // 2
            peaks = (regions if n else maxima)(score, limit, window, options.shift)
            box = lambda r, c: (slice(r + border - half, r + border + half + 1), slice(c + border - half, c + border + half + 1))  # noqa: E731, B023
            fits = fit(np.array([wide[box(r, c)] for r, c in peaks]), mean) if peaks else []
            taken = []
            for (r, c), got in zip(peaks, fits, strict=True):
                if got is None or not (-1 < r + got[0][1] < h and -1 < c + got[0][0] < w):
                    continue
                centre, cov, amp = got
                bell = _bell(window, centre, cov, amp)
                rho = cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])
                at = {"x": float(np.clip(c + centre[0], 0, w - 1)), "y": float(np.clip(r + centre[1], 0, h - 1))}
                taken.append((box(r, c), bell))
                out.append(at | {"xvar": cov[0, 0], "yvar": cov[1, 1], "rho": rho, "norm_cst": amp, "intensity": float(bell[half, half]), "window_size": window})
            if n < options.deflations:
                for at, bell in taken:
                    wide[at] = np.maximum(wide[at] - bell, mean)
                    smooth_ring(wide, at, rounds=options.smooth)
    left = picture.copy()
    for s in out:
        _take_out(left, s)
    return out, left


def _take_out(picture: np.ndarray, s: dict) -> None:
    half, r, c = s["window_size"] // 2, round(s["y"]), round(s["x"])
    r0, r1, c0, c1 = max(0, r - half), min(picture.shape[0], r + half + 1), max(0, c - half), min(picture.shape[1], c + half + 1)
    cross = s["rho"] * np.sqrt(s["xvar"] * s["yvar"])
    bell = _bell(s["window_size"], np.array([s["x"] - c, s["y"] - r]), np.array([[s["xvar"], cross], [cross, s["yvar"]]]), s["norm_cst"])
    picture[r0:r1, c0:c1] -= bell[r0 - r + half : r1 - r + half, c0 - c + half : c1 - c + half]


def annulus(picture: np.ndarray, left: np.ndarray, s: dict, inner: float = 3.0, outer: int = 6, least: int = 10) -> tuple[float, float, float]:
    """Median and variance of what is left around a spot, and its flux above the median; nan with too few pixels."""
    r, c = int(np.floor(s["y"] + 0.5)), int(np.floor(s["x"] + 0.5))
    h, w = picture.shape
    y, x = np.mgrid[max(0, r - outer) : min(h, r + outer + 1), max(0, c - outer) : min(w, c + outer + 1)]
    ring = left[y, x][(y - r) ** 2 + (x - c) ** 2 > inner * inner]
    if len(ring) < least:
        return (float("nan"),) * 3
    half, mid = s["window_size"] // 2, float(np.median(ring))
    core = picture[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1]
    return mid, float(ring.var()), float(core.sum() - core.size * mid)


def localize(frames: DataFrame, options: Options | None = None) -> DataFrame:
    """Spots (the localization schema) of all pictures; background and flux are in the pictures' own units.

    Pictures without pixels give no spots. The range of each stack is the only thing pictures share, a row a video.
    """
    options = options or Options()
    ends = frames.groupBy("video").agg(F.min(F.array_min("pixels")).alias("lo"), F.max(F.array_max("pixels")).alias("hi"))
    ends = graph.cut_lineage(ends)  # found once, and counted: with so few videos no picture is shuffled
    if ends.count() <= FEW_VIDEOS:
        ends = F.broadcast(ends)
    rows = frames.select("video", "frame", "height", "width", "pixels").where(F.size("pixels") > 0).join(ends, "video")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.itertuples():
                raw = np.asarray(p.pixels, float).reshape(p.height, p.width)
                scaled = (raw - p.lo) / (p.hi - p.lo) if p.hi > p.lo else raw
                top = scaled.max()
                unit = (raw.max() - p.lo) if top > 0 else 1.0
                scaled = scaled / top if top > 0 else scaled
                found, left = find_spots(scaled, options, int(p.frame))
                for i, s in enumerate(found):
                    mid, var, flux = annulus(scaled, left, s)
                    out.append({"video": p.video, "frame": p.frame, "spot_idx": i, "z": 0.0, **s, "bg_median": mid * unit + p.lo, "bg_var": var * unit**2, "integrated_flux": flux * unit})
            yield pd.DataFrame(out, columns=[f.name for f in LOC])

    return rows.mapInPandas(run, LOC)
