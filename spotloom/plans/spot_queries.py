"""Queries on spots, graphs, pictures, ratios and regions, each with its SQL where there is one."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.functions import cauchy as C
from spotloom.functions import geometry as G
from spotloom.operators import classify, diffusion, graph, image, linking
from spotloom.operators.quantiles import quantiles
from spotloom.plans import adapters as A

SHAPES = [{"type": "rect", "x1": 60.0, "y1": 35.0, "x2": 90.0, "y2": 65.0, "angle": 15.0}, {"type": "ellipse", "cx": 100.0, "cy": 50.0, "rx": 40.0, "ry": 25.0, "angle": 30.0}]
THRESHOLD, HORIZON = 2.0, 3
RHO = (0.5, 0.1, 0.2)


def _edges(s, d):
    return graph.candidate_edges(A.loc(s, d), THRESHOLD, HORIZON)


def _norm(s, d):
    return image.normalise(image.pixels(A.frames(s, d)))


def _scan(s, d):
    """H by state and stride. Trajectories have a point a day at most, of 30 days, so strides end at 14."""
    return diffusion.grid_scan(A.traces(s, d), 14)


def _table(s, d):
    """The scan's rows for which the model's bounds are known."""
    return _scan(s, d).where("h between 0.05 and 0.95").select("state", "delta", "h", "n")


def _medians(s, d):
    ratios, by = diffusion.stride_ratios(A.traces(s, d), 3), ["delta", "axis", "state"]
    n = ratios.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(quantiles(ratios, "ratio", by, median=0.5), by).select(*by, "n", F.round("median", 4).alias("median"))


def _gauss(s, d):
    px = image.pixels(A.frames(s, d)).withColumn("v", F.exp("v"))
    peaks = image.local_maxima(px, 2, "v")
    spots = peaks.select("video", "frame", (F.col("r") * 8 + F.col("c")).alias("spot_idx"), "r", "c")
    return image.fit_gaussians(px, spots, 5)


def _peaks(s, d):
    """The greatest pixels within one of each other, as spots."""
    return image.local_maxima(image.pixels(A.frames(s, d)), 1, "v").select("video", "frame", (F.col("r") * 8 + F.col("c")).alias("spot_idx"), "r", "c")


def _recomputed(s, d):
    """Background and flux of the greatest pixels, taken for spots without any, from the raw pictures."""
    spots = schemas.conform(_peaks(s, d).select("video", "frame", "spot_idx", F.col("c").alias("x"), F.col("r").alias("y"), F.lit(5).alias("window_size")), schemas.LOC)
    out = image.recomputed_background(A.frames(s, d), spots)
    return out.select("frame", "spot_idx", F.round("bg_median", 5).alias("bg_median"), F.round("bg_var", 5).alias("bg_var"), F.round("integrated_flux", 4).alias("integrated_flux"))


#: A plot of 100 by 50 pixels, and shapes drawn on it, which overlap.
PLOT, BOUNDS = (100, 50), (0.0, 200.0, 0.0, 100.0)
DRAWN = [{"type": "rect", "x1": 30.0, "y1": 17.0, "x2": 45.0, "y2": 33.0, "angle": 15.0}, {"type": "ellipse", "cx": 50.0, "cy": 25.0, "rx": 20.0, "ry": 12.0, "angle": 30.0}, {"type": "line", "p1": [0.0, 22.0], "p2": [99.0, 30.0]}]


#: Lines that divide the plane of H and log10 K, in pixels of a plot of 100 by 100.
GATE = [[(50, 0), (50, 99)], [(0, 40), (99, 48)]]


def _classes(s, d, strict=False):
    return classify.roi_classes(A.traces(s, d), DRAWN, BOUNDS, *PLOT, strict)


QUERIES = {
    "frame_spine": lambda s, d: graph.frame_spine(A.loc(s, d)),
    "mean_particles": lambda s, d: graph.mean_particles(A.loc(s, d)).select("video", F.round("mean_particles", 6).alias("mean_particles"), "frames"),
    "next_available_frame": lambda s, d: graph.next_available_frame(A.loc(s, d)),
    "adjacent_pairs": lambda s, d: graph.adjacent_pairs(A.loc(s, d)).select("video", "frame", "src_idx", "dst_frame", "dst_idx", G.rounded(F.col("d"), 4).alias("d")),
    "candidate_edges": lambda s, d: _edges(s, d).select("video", "src_frame", "src_idx", "dst_frame", "dst_idx", "gap", F.round("jump_d", 4).alias("jump_d")),
    "candidate_edges_grid": lambda s, d: graph.candidate_edges(A.loc(s, d), THRESHOLD, HORIZON, True).groupBy("video", "gap").agg(F.count(F.lit(1)).alias("n")),
    "orphans": lambda s, d: graph.orphans(A.loc(s, d), _edges(s, d)),
    "terminal_nodes": lambda s, d: graph.terminal_nodes(A.loc(s, d), _edges(s, d)),
    "terminal_among_free": lambda s, d: graph.terminal_among_free(A.loc(s, d), _edges(s, d), graph.nearest_successors(_edges(s, d))),
    "ancestors": lambda s, d: graph.ancestors(_edges(s, d), A.loc(s, d)),
    "without_matched": lambda s, d: graph.without(_edges(s, d), graph.nearest_successors(_edges(s, d).where("gap = 0")), A.loc(s, d), THRESHOLD).withColumn("jump_d", F.round("jump_d", 4)),
    "two_hop_bypass": lambda s, d: graph.bypass_edges(_edges(s, d), A.loc(s, d).select("video", "frame", "spot_idx"), A.loc(s, d), THRESHOLD).select("video", "src_frame", "src_idx", "dst_frame", "dst_idx", F.round("jump_d", 4).alias("jump_d")),
    "components": lambda s, d: graph.components(A.loc(s, d), _edges(s, d)),
    "jump_law": lambda s, d: graph.jump_law(graph.adjacent_pairs(A.loc(s, d))).select("bin", F.round("density", 6).alias("density")),
    "jump_law_few": lambda s, d: graph.jump_law(_edges(s, d), "jump_d").select("bin", F.round("density", 6).alias("density")),
    "on_plot": lambda s, d: classify.on_plot(A.traces(s, d)).select("video", "traj_idx", "frame", F.round("px", 4).alias("px"), F.round("py", 4).alias("py")),
    "emp_pdf": lambda s, d: graph.empirical_pdf(graph.adjacent_pairs(A.loc(s, d))).select("bin", "n", F.round("density", 6).alias("density")),
    "jump_threshold": lambda s, d: graph.jump_threshold_of(A.loc(s, d), "x").select(F.round("threshold", 3).alias("threshold")),
    "greedy_matches": lambda s, d: linking.greedy_matches(A.loc(s, d)),
    "link_trajectories": lambda s, d: linking.link(A.loc(s, d), THRESHOLD, HORIZON),
    "frame_minmax_norm": lambda s, d: _norm(s, d).select("frame", "r", "c", F.round("v", 5).alias("v")),
    "quantised": lambda s, d: image.quantised(_norm(s, d)).select("frame", "r", "c", "ival"),
    "background_sigma_clip": lambda s, d: image.background(_norm(s, d)).select("frame", "n", "s1", "s2"),
    "detection_threshold": lambda s, d: image.threshold(image.background(_norm(s, d))).select("frame", F.round("threshold", 5).alias("threshold")),
    "likelihood_scores": lambda s, d: image.likelihood(_norm(s, d), image.background(_norm(s, d)), 5, 1.0).select("frame", "r", "c", F.round("score", 4).alias("score")),
    "local_max": lambda s, d: image.local_maxima(image.pixels(A.frames(s, d)), 1, "v").select("frame", "r", "c", F.round("v", 5).alias("v")),
    "nms_detect": lambda s, d: image.suppress(image.local_maxima(image.likelihood(_norm(s, d), image.background(_norm(s, d)), 3, 1.0)).where("score > 0.05")),
    "gaussian_fit": _gauss,
    "annulus_stats": lambda s, d: image.annulus_stats(image.pixels(A.frames(s, d)), _peaks(s, d)).select("frame", "spot_idx", F.round("bg_median", 5).alias("bg_median"), F.round("bg_var", 5).alias("bg_var"), F.round("integrated_flux", 4).alias("integrated_flux")),
    "recomputed_background": _recomputed,
    "density_raster": lambda s, d: image.density_raster(A.loc(s, d), 10.0).select("video", "r", "c", F.round("density", 4).alias("density")),
    "kde_log_k": lambda s, d: image.kde_1d(A.diffusion(s, d).where("K > 0").withColumn("lk", F.log10("K")), "lk").select("id", F.round("density", 5).alias("density")),
    "ratio_multi_delta": _medians,
    "ratio_counts": lambda s, d: diffusion.ratio_counts(A.traces(s, d), 8),
    "h_grid_mle": lambda s, d: diffusion.h_grid(diffusion.stride_ratios(A.traces(s, d), 2), most=2).select("state", "delta", F.round("h", 4).alias("h"), F.round("ll", 2).alias("ll"), "n"),
    "h_fit": lambda s, d: diffusion.h_fit(diffusion.stride_ratios(A.traces(s, d), 4)),
    "snr_by_state": lambda s, d: diffusion.snr_by_state(A.traces(s, d), 0.2).select("state", F.round(F.col("msd1") + 1e-9, 3).alias("msd1"), "floor", F.round("snr", 2).alias("snr")),
    "rho_gamma_table": lambda s, d: _table(s, d).select("state", "h", "delta", F.round(C.rho(F.col("h"), F.col("delta").cast("double"), *RHO), 6).alias("rho"), F.round(C.gamma(C.rho(F.col("h"), F.col("delta").cast("double"), *RHO)), 6).alias("gamma"), F.round(C.rho_free(F.col("h")), 6).alias("free")),
    "n_eff_from_variance": lambda s, d: _scan(s, d).where("h between 0.05 and 0.95").select("state", "delta", F.round(C.n_eff_from_variance(F.col("se") ** 2, F.col("h"), F.col("delta").cast("double"), *RHO), 3).alias("n_eff")),
    "crlb_table": lambda s, d: _table(s, d).select("state", "h", "delta", F.round(C.sigma_crlb(C.fisher_h(F.col("h"), F.col("delta").cast("double"), *RHO), F.col("n")), 4).alias("se")),
    "trust_bands": lambda s, d: diffusion.trust(_table(s, d), *RHO, 0.05).select("state", "h", "delta", F.round("spread", 4).alias("spread"), "trusted"),
    "precision_map": lambda s, d: diffusion.precision_map(_table(s, d).select("state", "h", "delta"), *RHO).select("state", "h", "delta", "i", F.round("n_eff", 3).alias("n_eff"), F.round("se", 4).alias("se")),
    "z_pairs": lambda s, d: diffusion.z_pairs(_scan(s, d)).select("state", "d1", "d2", F.round("z", 3).alias("z"), F.round("p", 5).alias("p")),
    "bh_fdr": lambda s, d: diffusion.z_summary(diffusion.z_pairs(_scan(s, d))).select("state", "pairs", "over2", "over3", F.round("max_z", 3).alias("max_z"), "significant", F.round("p_cut", 5).alias("p_cut")),
    "delta_drift": lambda s, d: diffusion.delta_drift(_scan(s, d)).select("state", F.round("max_z", 3).alias("max_z"), F.round("max_drift", 6).alias("max_drift"), "at_delta", "over2", "over3", "n"),
    "trusted_strides": lambda s, d: diffusion.trusted_by_all(diffusion.trust(_scan(s, d).where("h between 0.05 and 0.95"), *RHO, 0.05)),
    "roi_rect_ellipse": lambda s, d: classify.roi_by_mean(A.traces(s, d), SHAPES),
    "roi_classes": lambda s, d: _classes(s, d),
    "roi_classes_strict": lambda s, d: _classes(s, d, True),
    "roi_strict": lambda s, d: classify.roi_strict(A.traces(s, d), SHAPES),
    "region_stats": lambda s, d: (lambda x: x.select("roi", "n", *[F.round(c, 4).alias(c) for c in x.columns if c not in ("roi", "n")]))(classify.region_stats(_classes(s, d).join(A.diffusion(s, d), ["video", "traj_idx"], "left"), "roi")),
    "region_semi_join": lambda s, d: classify.members(A.traces(s, d), _classes(s, d), "roi", 0).select("video", "traj_idx", "frame"),
    "hk_gate": lambda s, d: classify.gate(A.diffusion(s, d), F.col("H") * 100, (F.log10("K") + 2) * 25, classify.wall_grid(GATE, 100, 100), "K").select("video", "traj_idx", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("H", "K")], "region"),
}

_L = "with " + A.LOC_SQL
_NEXT = _L + ", nx as (select video, frame, lead(frame) over (partition by video order by frame) as next_frame from (select distinct video, frame from loc))"
_PAIRS = _NEXT + """, ap as (select a.video, a.frame, a.spot_idx as src_idx, b.frame as dst_frame, b.spot_idx as dst_idx, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as d, b.x - a.x as dx
  from loc a join nx on a.video = nx.video and a.frame = nx.frame join loc b on b.video = a.video and b.frame = nx.next_frame)"""
_E = _L + f""", e as (select a.video, a.frame as src_frame, a.spot_idx as src_idx, b.frame as dst_frame, b.spot_idx as dst_idx, b.frame - a.frame - 1 as gap, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as jump_d
  from loc a join loc b on a.video = b.video and b.frame between a.frame + 1 and a.frame + {1 + HORIZON} and sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < {THRESHOLD})"""
_NEAR = """, near as (select distinct video, dst_frame as frame, dst_idx as spot_idx from (select * from e{} qualify row_number() over (partition by video, src_frame, src_idx order by round(jump_d, 6), dst_frame, dst_idx) = 1))"""
_LAW = """, h as (select cast(least(floor({1} / (20.0::double / 39)), 38) as integer) as bin, count(*) as n from {0} where {1} between 0 and 20 group by 1), k as (select count({1}) as k from {0}),
  dn as (select bin, n / (sum(n) over () * (20.0::double / 39)) as density from h), b as (select cast(i as integer) as bin from range(39) t(i))
  select bin, round(case when k < 1000 then (exp(-bin * (20.0::double / 39)) - exp(-(bin + 1) * (20.0::double / 39))) / (20.0::double / 39) else coalesce(density, 0) end, 6) as density from b left join dn using (bin), k"""
_F = "with " + A.FRAMES_SQL + ", px as (select frame, pos // 8 as r, pos % 8 as c, v from fr)"
_N = _F + """, en as (select min(v) as lo, max(v) as hi from px), g as (select frame, r, c, (v - lo) / (hi - lo) as g from px, en), nm as (select frame, r, c, g / max(g) over (partition by frame) as v from g)"""
_Q = _N + ", qu as (select frame, r, c, cast(floor(round(v / max(v) over (partition by frame) * 100, 9)) as integer) as ival from nm)"
_BG = _Q + ", b0 as (select frame, ival, count(*) as n, true as keep, least(ival, greatest(max(ival) over (partition by frame), 1) - 1) as bin from qu group by frame, ival)"
for _i in range(3):
    _BG += f""", m{_i} as (select *, sum(case when keep then n else 0 end) over (partition by frame, bin) as bn, sum(case when keep then n else 0 end) over (partition by frame) as tn,
  sum(case when keep then n * ival / 100.0::double else 0 end) over (partition by frame) as t1, sum(case when keep then n * (ival / 100.0::double) * (ival / 100.0::double) else 0 end) over (partition by frame) as t2 from b{_i}),
 o{_i} as (select *, first_value(bin) over (partition by frame order by bn desc, bin) * 0.01::double + 0.005::double as mode, sqrt(greatest(0, t2 / tn - (t1 / tn) * (t1 / tn))) as sd from m{_i}),
 b{_i + 1} as (select frame, ival, n, bin, ival / 100.0::double > mode - 3 * sd and ival / 100.0::double < mode + 3 * sd as keep from o{_i})"""
_BG += """, bg as (select frame, cast(sum(n) as bigint) as n, cast(sum(n * ival) as bigint) as s1, cast(sum(n * ival * ival) as bigint) as s2 from b3 where keep group by 1),
 bs as (select *, s1 / n::double / 100 as mu, sqrt(greatest(0, s2 / n::double / 10000 - (s1 / n::double / 100) ** 2)) as sd from bg)"""
_PSF = image.gauss_psf(5, 1.0)
_MG = sum(g for _, _, g in _PSF) / 25
_GG = sum((g - _MG) ** 2 for _, _, g in _PSF)
_VALUES = ", ".join(f"({i}, {j}, {g - _MG!r}::double)" for i, j, g in _PSF)


def _sql_rho(h, d, r=RHO[0], k=RHO[1], s=RHO[2]):
    a = f"(2 * ({h}) + 2)"
    one = f"(pow({d} + {r}, {a}) + pow(abs({d} - {r}), {a}) - 2 * pow({d}, {a}))"
    two = f"(pow(2 * {d} + {r}, {a}) + pow(abs(2 * {d} - {r}), {a}) - 2 * pow(2 * {d}, {a}))"
    sc = f"({r * r} * (2 * ({h}) + 1) * (2 * ({h}) + 2))"
    jv, jc = f"(({one} - 2 * pow({r}, {a})) / {sc})", f"(({two} - 2 * {one} + 2 * pow({r}, {a})) / {sc})"
    return f"(({k} * {jc} - {s * s!r}) / (2 * ({k} * {jv} + {s * s!r})))"


_H = "h::double"
_SLOPE = f"(({_sql_rho('h + 1e-5', 'delta::double')} - {_sql_rho('h - 1e-5', 'delta::double')}) / 2e-5)"
_SE = f"1 / sqrt({_SLOPE} * {_SLOPE} / (2 * (1 - pow({_sql_rho('h', 'delta::double')}, 2)) * (1 - pow({_sql_rho('h', 'delta::double')}, 2))) * n)"
_NOISE = f"(({_sql_rho('h', 'delta::double', s=(RHO[2] ** 2 + 1e-6) ** 0.5)} - {_sql_rho('h', 'delta::double', s=(RHO[2] ** 2 - 1e-6) ** 0.5)}) / 2e-6)"
_TR = "with " + A.TRACES_SQL


def _sql_label(x, y):
    out = "-1"
    for i, s in reversed(list(enumerate(SHAPES))):
        t = math.radians(s["angle"])
        cx, cy = ((s["x1"] + s["x2"]) / 2, (s["y1"] + s["y2"]) / 2) if s["type"] == "rect" else (s["cx"], s["cy"])
        u, v = f"(({x} - {cx}) * cos({t!r}) + ({y} - {cy}) * sin({t!r}))", f"(({y} - {cy}) * cos({t!r}) - ({x} - {cx}) * sin({t!r}))"
        test = f"abs({u}) <= {abs(s['x2'] - s['x1']) / 2} and abs({v}) <= {abs(s['y2'] - s['y1']) / 2}" if s["type"] == "rect" else f"({u} / {s['rx']}) ** 2 + ({v} / {s['ry']}) ** 2 <= 1"
        out = f"case when {test} then {i} else {out} end"
    return out


_ROI = _TR + f", ce as (select video, traj_idx, avg(x) as cx, avg(y) as cy from tr group by 1, 2), ro as (select video, traj_idx, {_sql_label('cx', 'cy')} as roi from ce)"
_RATIO = _TR + ", ra as (" + " union all ".join(
    f"select state, {n} as delta, '{c}' as axis, (lead({c}, {2 * n}) over w - lead({c}, {n}) over w) / nullif(lead({c}, {n}) over w - {c}, 0) as ratio from tr window w as (partition by video, traj_idx order by frame)" for n in range(1, 15) for c in "xy"
) + ")"
_LL = _RATIO + """, g as (select 0.02 + i * (0.96::double / 48) as h from range(49) t(i)),
  ll as (select state, delta, h, sum(0.5 * ln(1 - p * p) - ln(pi()) - ln((ratio - p) * (ratio - p) + 1 - p * p)) as ll, count(*) as n from (select *, (pow(2, 2 * h) - 2) / 2 as p from ra, g where ratio is not null) group by 1, 2, 3)"""
_FREE = "(pow(2, 2 * ({0}) - 1) - 1)"
_SLOPE_FREE = f"(({_FREE.format('h + 1e-5')} - {_FREE.format('h - 1e-5')}) / 2e-5)"
_SC = _LL + f""", s0 as (select state, delta, max_by(h, ll) as h, max(n) as n from ll group by 1, 2 having max(n) >= 30),
  sc as (select *, 1 / sqrt({_SLOPE_FREE} * {_SLOPE_FREE} / (2 * (1 - pow({_FREE.format("h")}, 2)) * (1 - pow({_FREE.format("h")}, 2))) * n) as se from s0),
  z as (select a.state, a.delta as d1, b.delta as d2, (a.h - b.h) / sqrt(a.se * a.se + b.se * b.se) as z from sc a join sc b on a.state = b.state and a.delta < b.delta)"""
_TB = _SC + ", tb as (select state, delta, h, n from sc where h between 0.05 and 0.95)"
_TAIL = repr(diffusion.ERFC[-1])
for _c in reversed(diffusion.ERFC[:-1]):
    _TAIL = f"({_TAIL} * t + {_c!r}::double)"
_ZP = _SC + f", zt as (select *, abs(z) / sqrt(2) as a, 1 / (1 + 0.5::double * abs(z) / sqrt(2)) as t from z), zp as (select state, d1, d2, z, t * exp({_TAIL} - a * a) as p from zt)"

_GRID = classify.shape_grid(DRAWN, *PLOT).ravel().tolist()


def _sql_part(x, y):
    at = lambda v, a, b, n: f"cast(greatest(0, least({n - 1}, round_even(({v} - {a}) / ({b} - {a}) * {n}, 0))) as integer)"
    return f"{_GRID}[{at(y, *BOUNDS[2:], PLOT[1])} * {PLOT[0]} + {at(x, *BOUNDS[:2], PLOT[0])} + 1]"


_RC = _TR + f""", ce as (select video, traj_idx, avg(x) as cx, avg(y) as cy from tr group by 1, 2), l0 as (select *, {_sql_part("cx", "cy")} as l from ce),
  cl as (select video, traj_idx, cx, l from l0), p0 as (select video, traj_idx, x, {_sql_part("x", "y")} as l from tr),
  st as (select video, traj_idx, avg(x) as cx, case when min(l) = max(l) then min(l) else -1 end as l from p0 group by 1, 2)"""
_CLASSES = _RC.replace("{", "{{").replace("}", "}}") + ", rk as (select l, dense_rank() over (order by avg(cx), l) - 1 as rank from {0} where l >= 0 group by 1) select video, traj_idx, cast(coalesce(rank, {0}.l) as integer) as roi from {0} left join rk using (l)"

SQL = {
    "frame_spine": _L + """, en as (select video, min(frame) as a, max(frame) as b from loc group by 1), sp as (select video, cast(unnest(range(a, b + 1)) as integer) as frame from en)
  select video, frame, count(loc.x) as n from sp left join loc using (video, frame) group by 1, 2""",
    "mean_particles": _L + " select video, round(count(*) / (max(frame) - min(frame) + 1)::double, 6) as mean_particles, cast(max(frame) - min(frame) + 1 as bigint) as frames from loc group by 1",
    "next_available_frame": _NEXT + " select * from nx",
    "adjacent_pairs": _PAIRS + " select video, frame, src_idx, dst_frame, dst_idx, round(d, 4) as d from ap",
    "candidate_edges": _E + " select video, src_frame, src_idx, dst_frame, dst_idx, gap, round(jump_d, 4) as jump_d from e",
    "candidate_edges_grid": _E + " select video, gap, count(*) as n from e group by 1, 2",
    "orphans": _E + " select video, frame, spot_idx from loc except (select video, src_frame, src_idx from e union select video, dst_frame, dst_idx from e)",
    "terminal_nodes": _E + " select video, frame, spot_idx from loc except select video, src_frame, src_idx from e",
    "terminal_among_free": _E + _NEAR.format("") + """ select video, frame, spot_idx from loc
  except select video, src_frame, src_idx from e where not exists (select 1 from near where near.video = e.video and near.frame = e.dst_frame and near.spot_idx = e.dst_idx)""",
    "ancestors": _E.replace("with ", "with recursive ", 1) + """, up as (select video, dst_frame as frame, dst_idx as spot_idx, src_frame as a_frame, src_idx as a_idx from e
  union select up.video, frame, spot_idx, src_frame, src_idx from up join e on up.video = e.video and up.a_frame = e.dst_frame and up.a_idx = e.dst_idx)
  select *, cast(row_number() over (partition by video, frame, spot_idx order by a_frame desc, a_idx desc) as integer) as rank from up""",
    "without_matched": _E.replace("with ", "with recursive ", 1) + _NEAR.format(" where gap = 0") + f""", wo as (select e.video, src_frame, src_idx, dst_frame, dst_idx, jump_d from e anti join near on near.video = e.video and near.frame = src_frame and near.spot_idx = src_idx
  union select w.video, w.src_frame, w.src_idx, e.dst_frame, e.dst_idx, sqrt((v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y)) from wo w join near on near.video = w.video and near.frame = w.dst_frame and near.spot_idx = w.dst_idx
  join e on e.video = w.video and e.src_frame = w.dst_frame and e.src_idx = w.dst_idx join loc u on u.video = w.video and u.frame = w.src_frame and u.spot_idx = w.src_idx
  join loc v on v.video = e.video and v.frame = e.dst_frame and v.spot_idx = e.dst_idx where sqrt((v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y)) < {THRESHOLD})
  select distinct video, src_frame, src_idx, dst_frame, dst_idx, round(jump_d, 4) as jump_d from wo anti join near on near.video = wo.video and near.frame = dst_frame and near.spot_idx = dst_idx""",
    "two_hop_bypass": _E + f""" select distinct a.video, a.src_frame, a.src_idx, b.dst_frame, b.dst_idx, round(sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2), 4) as jump_d
  from e a join e b on a.video = b.video and a.dst_frame = b.src_frame and a.dst_idx = b.src_idx
  join loc u on u.video = a.video and u.frame = a.src_frame and u.spot_idx = a.src_idx join loc v on v.video = b.video and v.frame = b.dst_frame and v.spot_idx = b.dst_idx
  where sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2) < {THRESHOLD}""",
    "components": _E.replace("with ", "with recursive ", 1) + """, n2 as (select video, src_frame::bigint * 2147483648 + src_idx as u, dst_frame::bigint * 2147483648 + dst_idx as v from e),
  bo as (select * from n2 union select video, v, u from n2), re as (select video, u, v from bo union select re.video, re.u, bo.v from re join bo on re.video = bo.video and re.v = bo.u)
  select loc.video, loc.frame, spot_idx, least(loc.frame::bigint * 2147483648 + spot_idx, coalesce(m, loc.frame::bigint * 2147483648 + spot_idx)) as component
  from loc left join (select video, u, min(v) as m from re group by 1, 2) q on q.video = loc.video and q.u = loc.frame::bigint * 2147483648 + spot_idx""",
    "jump_law": _PAIRS + _LAW.format("ap", "d"),
    "jump_law_few": _E + _LAW.format("e", "jump_d"),
    "on_plot": _TR + """, en as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from tr), w as (select *, greatest(hx - lx + 2 * greatest((hx - lx) * 0.05::double, 1), hy - ly + 2 * greatest((hy - ly) * 0.05::double, 1)) / 2 as h from en)
  select video, traj_idx, frame, round((x - ((lx + hx) / 2 - h)) / (2 * h) * 1000, 4) as px, round((y - ((ly + hy) / 2 - h)) / (2 * h) * 1000, 4) as py from tr, w""",
    "emp_pdf": _PAIRS + ", h as (select cast(least(floor(d / (20.0::double / 39)), 38) as integer) as bin, count(*) as n from ap where d between 0 and 20 group by 1) select bin, n, round(n / (sum(n) over () * (20.0::double / 39)), 6) as density from h",
    "jump_threshold": _PAIRS + ", q as (select quantile_cont(dx, 0.025) as lo, quantile_cont(dx, 0.975) as hi from ap) select round(greatest(5.0, 2.5 * stddev_pop(dx)), 3) as threshold from ap, q where dx between lo and hi",
    "frame_minmax_norm": _N + " select frame, r, c, round(v, 5) as v from nm",
    "quantised": _Q + " select * from qu",
    "background_sigma_clip": _BG + " select frame, n, s1, s2 from bg",
    "detection_threshold": _BG + " select frame, round(case when sd > 0 and mu <> 0 then greatest(1.0, 2 * sd * sd / (mu * mu)) else 1 end, 5) as threshold from bs",
    "likelihood_scores": _BG + f""", ps(dr, dc, g) as (values {_VALUES}), li as (select frame, r - dr as r, c - dc as c, sum(v * g) as vg from nm, ps group by 1, 2, 3 having count(*) = 25),
  pr as (select li.frame, r, c, pow(greatest(0, vg / {_GG!r}), 2) * {_GG!r} / (case when abs(25 * mu * mu - 25 * mu) < 1e-12 then 1e-12 else 25 * mu * mu - 25 * mu end) as ratio from li join bs using (frame))
  select frame, r, c, round(12.5 * ln(1 - case when ratio >= 1 then 1 - 1e-7 else ratio end), 4) as score from pr""",
    "local_max": _F + " select a.frame, a.r, a.c, round(a.v, 5) as v from px a join px b on a.frame = b.frame and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.frame, a.r, a.c, a.v having a.v = max(b.v)",
    "annulus_stats": _F + """, sp as (select a.frame, a.r * 8 + a.c as spot_idx, a.r as r0, a.c as c0 from px a join px b on a.frame = b.frame and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.frame, a.r, a.c, a.v having a.v = max(b.v)),
  m as (select frame, spot_idx, v, (r - r0) ** 2 + (c - c0) ** 2 > 9 as ring, abs(r - r0) <= 3 and abs(c - c0) <= 3 as core from px join sp using (frame) where abs(r - r0) <= 6 and abs(c - c0) <= 6)
  select frame, spot_idx, round(median(v) filter (ring), 5) as bg_median, round(var_pop(v) filter (ring), 5) as bg_var, round(sum(v) filter (core) - count(*) filter (core) * (median(v) filter (ring)), 4) as integrated_flux from m group by 1, 2 having count(*) filter (ring) >= 10""",
    "recomputed_background": _F + """, sp as (select a.frame, a.r * 8 + a.c as spot_idx, a.r as r0, a.c as c0 from px a join px b on a.frame = b.frame and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.frame, a.r, a.c, a.v having a.v = max(b.v)),
  m as (select frame, spot_idx, v, (r - r0) ** 2 + (c - c0) ** 2 > 9 as ring, abs(r - r0) <= 2 and abs(c - c0) <= 2 as core from px join sp using (frame) where abs(r - r0) <= 6 and abs(c - c0) <= 6),
  st as (select frame, spot_idx, median(v) filter (ring) as mid, var_pop(v) filter (ring) as var, sum(v) filter (core) as s, count(*) filter (core) as n from m group by 1, 2 having count(*) filter (ring) >= 10)
  select frame, spot_idx, round(mid, 5) as bg_median, round(var, 5) as bg_var, round(s - n * mid, 4) as integrated_flux from sp left join st using (frame, spot_idx)""",
    "density_raster": _L + ", o as (select unnest([-1, 0, 1]) as d) select video, cast(floor(y / 10) + a.d as bigint) as r, cast(floor(x / 10) + b.d as bigint) as c, round(sum(exp(-(a.d * a.d + b.d * b.d) / 2.0::double)), 4) as density from loc, o a, o b group by 1, 2, 3",
    "kde_log_k": "with " + A.EVENTS_SQL + ", " + A.DIFFUSION_SQL + """, l as (select log10(K) as lk from df where K > 0), s as (select stddev_samp(lk) * pow(count(*), -0.2) as bw, count(*) as n, min(lk) as lo, max(lk) as hi from l)
  select cast(i as integer) as id, round(sum(exp(-0.5 * pow((lo + i * ((hi - lo) / 199) - lk) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())), 5) as density from l, s, range(200) t(i) group by 1""",
    "ratio_multi_delta": _RATIO + " select delta, axis, state, count(*) as n, round(median(ratio), 4) as median from ra where ratio is not null and delta <= 3 group by 1, 2, 3",
    "ratio_counts": _TR + " select cast(d as integer) as delta, cast(sum(2 * greatest(t - 2 * d, 0)) as bigint) as n from (select count(*) as t from tr group by video, traj_idx), range(1, 9) q(d) group by 1",
    "h_grid_mle": _LL + """
  select state, delta, round(max_by(h, ll), 4) as h, round(max(ll), 2) as ll, max(n) as n from ll where delta <= 2 group by 1, 2 having max(n) >= 5""",
    "snr_by_state": _TR + """, q as (select state, pow(lead(x) over w - x, 2) as x2, pow(lead(y) over w - y, 2) as y2 from tr window w as (partition by video, traj_idx order by frame))
  select state, round((avg(x2) + avg(y2)) / 2 + 1e-9, 3) as msd1, 0.08000000000000002::double as floor, round((avg(x2) + avg(y2)) / 2 / 0.08, 2) as snr from q where x2 is not null group by 1""",
    "rho_gamma_table": _TB + f" select state, h, delta, round({_sql_rho('h', 'delta::double')}, 6) as rho, round(sqrt(1 - pow({_sql_rho('h', 'delta::double')}, 2)), 6) as gamma, round(pow(2, 2 * h - 1) - 1, 6) as free from tb",
    "n_eff_from_variance": _SC + f" select state, delta, round(1 / (se * se / ({_SE} * {_SE} * n)), 3) as n_eff from sc where h between 0.05 and 0.95",
    "crlb_table": _TB + f" select state, h, delta, round({_SE}, 4) as se from tb",
    "trust_bands": _TB + f" select state, h, delta, round(abs({_NOISE} / {_SLOPE}) * {RHO[2] ** 2!r}, 4) as spread, {_SE} <= 0.05 and abs({_NOISE} / {_SLOPE}) * {RHO[2] ** 2!r} <= 0.05 as trusted from tb",
    "precision_map": _TB + ", pm as (select state, h, delta, cast(i as integer) as i, pow(10::double, 1 + i * (4::double / 119)) as n from tb, range(120) q(i))" + f" select state, h, delta, i, round(n, 3) as n_eff, round({_SE}, 4) as se from pm",
    "z_pairs": _ZP + " select state, d1, d2, round(z, 3) as z, round(p, 5) as p from zp",
    "bh_fdr": _ZP + """, r as (select *, row_number() over (partition by state order by p) as r, count(*) over (partition by state) as m from zp),
  c as (select *, coalesce(r <= max(case when p <= 0.05 * r / m then r end) over (partition by state), false) as rejected from r)
  select state, count(*) as pairs, count(*) filter (abs(z) > 2) as over2, count(*) filter (abs(z) > 3) as over3, round(max_by(z, abs(z)), 3) as max_z, count(*) filter (rejected) as significant, round(coalesce(max(p) filter (rejected), 0), 5) as p_cut from c group by 1""",
    "delta_drift": _SC + """, s as (select state, delta, h - lag(h) over w as dh, sqrt(pow(lag(se) over w, 2) + se * se) as f from sc window w as (partition by state order by delta)), q as (select *, abs(dh) / f as z from s where dh is not null and f > 0)
  select state, round(max(z), 3) as max_z, round(max_by(dh, z), 6) as max_drift, max_by(delta, z) as at_delta, count(*) filter (z > 2) as over2, count(*) filter (z > 3) as over3, count(*) as n from q group by 1""",
    "trusted_strides": _SC + f" select delta, bool_and({_SE} <= 0.05 and abs({_NOISE} / {_SLOPE}) * {RHO[2] ** 2!r} <= 0.05) as trusted from sc where h between 0.05 and 0.95 group by 1",
    "hk_gate": "with " + A.EVENTS_SQL + ", " + A.DIFFUSION_SQL + f""", p as (select *, cast(floor((log10(K) + 2) * 25) as integer) as gy, cast(floor(H * 100) as integer) as gx from df),
  l as (select *, case when gx between 0 and 99 and gy between 0 and 99 then {classify.wall_grid(GATE, 100, 100).ravel().tolist()}[gy * 100 + gx + 1] end as l from p),
  r as (select l, dense_rank() over (order by avg(K)) - 1 as region from l where l is not null group by 1) select video, traj_idx, round(H + 1e-9, 6) as H, round(K + 1e-9, 6) as K, cast(region as integer) as region from l left join r using (l)""",
    "roi_classes": _CLASSES.format("cl"),
    "roi_classes_strict": _CLASSES.format("st"),
    "roi_rect_ellipse": _ROI + " select * from ro",
    "roi_strict": _TR + f", p as (select video, traj_idx, {_sql_label('x', 'y')} as l from tr) select video, traj_idx, case when min(l) = max(l) then min(l) else -1 end as roi from p group by 1, 2",
    "region_stats": "with ro as (" + _CLASSES.format("cl") + "), " + A.EVENTS_SQL + ", " + A.DIFFUSION_SQL + " select roi, count(*) as n, " + ", ".join(f"round({f}({c}), 4) as {n}_{c.lower()}" for c in "HK" for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + ", round(100.0 * count(*) / sum(count(*)) over (), 4) as percent from ro left join df using (video, traj_idx) group by 1",
    "region_semi_join": "with ro as (" + _CLASSES.format("cl") + "), " + A.TRACES_SQL + " select video, traj_idx, frame from tr join ro using (video, traj_idx) where roi = 0",
}
