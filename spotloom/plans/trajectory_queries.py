"""Queries of trajectory analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.operators import trajectory as T
from spotloom.plans import adapters as A

R = 4
#: Added before rounding where means of short decimals end in a five, so that both engines round up.
TIE = 1e-9


def _runs(spark, d):
    return T.state_runs(A.traces(spark, d))


def _summary(spark, d):
    return T.run_summary(_runs(spark, d), A.diffusion(spark, d))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


QUERIES = {
    "traj_steps": lambda s, d: rounded(T.steps(_runs(s, d)).select("video", "traj_idx", "run", "frame", "dframe", "dx", "dy", "jump"), "dx", "dy", "jump"),
    "traj_state_runs": lambda s, d: T.state_runs(A.traces(s, d), 2, 50).groupBy("video", "traj_idx", "run", "state").agg(F.count(F.lit(1)).alias("points"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")),
    "traj_min_points": lambda s, d: T.min_points(A.traces(s, d), 10).groupBy("video", "traj_idx").agg(F.count(F.lit(1)).alias("points")),
    "origin_shift": lambda s, d: rounded(T.origin_shift(_runs(s, d), 0.16, 0.01).select("video", "traj_idx", "frame", "rx", "ry", "t"), "rx", "ry", "t"),
    "traj_summary": lambda s, d: rounded(_summary(s, d).select("video", "traj_idx", "run", "state", "mean_jump", "duration", "points", "H", "K"), "mean_jump", "duration", "H", "K"),
    "state_summary": lambda s, d: rounded(T.state_summary(_summary(s, d)), "mean_jump", "mean_duration", "mean_h", "median_h", "mean_k", "median_k"),
    "population_share": lambda s, d: rounded(T.population_share(_summary(s, d)), "percent"),
    "turn_angle": lambda s, d: T.angles(_runs(s, d)).select("video", "traj_idx", "run", "frame", F.round("angle", 3).alias("angle"), F.round("polar", 3).alias("polar")),
    "turn_angle_strict": lambda s, d: T.angles(_runs(s, d), True).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("angle"), 3).alias("mean_angle")),
    "disp_1d": lambda s, d: rounded(T.displacements_1d(_runs(s, d)).select("video", "traj_idx", "frame", "axis", "d"), "d"),
    "ratio_1d": lambda s, d: rounded(T.ratios_1d(_runs(s, d)).select("video", "traj_idx", "frame", "axis", "r"), "r"),
    "ratio_1d_strict": lambda s, d: T.ratios_1d(_runs(s, d), True).groupBy("state", "axis").agg(F.count(F.lit(1)).alias("n")),
    "jump_hist": lambda s, d: rounded(T.histogram(T.kept_steps(_runs(s, d)), "jump", 50, ["state"]), "share"),
    "duration_hist": lambda s, d: rounded(T.histogram(_summary(s, d), "duration", 200, ["state"]), "share"),
    "polar_rose": lambda s, d: rounded(T.histogram(T.angles(_runs(s, d)).withColumn("polar", F.round("polar", 6)), "polar", 36, ["state"], ends=(0.0, 360.0)), "share"),
    "log_k_hist": lambda s, d: T.geometric_histogram(A.diffusion(s, d), "K", 20, ["video"]).select("video", "bin", "n"),
    "density_1d": lambda s, d: T.histogram(T.displacements_1d(_runs(s, d)), "d", 80, ["axis"], True).select("axis", "bin", "n", F.round("share", 7).alias("share")),
    "ea_sd": lambda s, d: T.ea_sd(_runs(s, d)).select("state", F.col("t").cast("int").alias("t"), F.round(F.col("mean") + TIE, 3).alias("mean"), F.round(F.col("std") + TIE, 3).alias("std"), "n"),
    "ea_sd_strict": lambda s, d: T.ea_sd(_runs(s, d), 1.0, True).select("state", "t", F.round(F.col("mean") + TIE, 3).alias("mean"), "n"),
    "ta_ea_sd": lambda s, d: T.ta_ea_sd(_runs(s, d)).select("state", "lag", F.round(F.col("mean") + TIE, 3).alias("mean"), F.round(F.col("std") + TIE, 3).alias("std"), "n"),
    "pooled_msd_sem": lambda s, d: T.pooled_msd(A.traces(s, d)).select("lag", F.round(F.col("msd") + TIE, 3).alias("msd"), F.round(F.col("sem") + TIE, 3).alias("sem"), "n"),
    "max_duration": lambda s, d: T.max_duration(A.traces(s, d)),
    "centroids": lambda s, d: T.centroids(A.traces(s, d)).withColumns({c: F.round(F.col(c) + TIE, R) for c in ("cx", "cy")}),
    "state_rank_by_k": lambda s, d: rounded(T.state_rank(T.with_diffusion(A.traces(s, d), A.diffusion(s, d)).where("K is not null")), "mean_k"),
    "merge_offset": lambda s, d: T.merge_offset(A.traces(s, d)).groupBy("video", "traj_idx", "merged_idx").agg(F.count(F.lit(1)).alias("points")),
    "traces_left_diffusion": lambda s, d: rounded(T.with_diffusion(A.traces(s, d), A.diffusion(s, d)).select("video", "traj_idx", "frame", "state", "H", "K"), "H", "K"),
    "jump_percentiles": lambda s, d: rounded(T.percentiles(T.kept_steps(_runs(s, d)), "jump", 0.025, 0.5, 0.975, 0.99), "p0_025", "p0_5", "p0_975", "p0_99"),
    "distinct_trajectories": lambda s, d: A.traces(s, d).groupBy("video").agg(F.countDistinct("traj_idx").alias("n")),
    "viz_value": lambda s, d: _summary(s, d).select("video", "traj_idx", "run", F.round(T.viz_value(None, False, 3), R).alias("value")),
}

_P = "with " + A.TRACES_SQL
_RUNS = (
    _P
    + """, r0 as (select *, case when state <> lag(state) over w then 1 else 0 end as new from tr window w as (partition by video, traj_idx order by frame)),
r as (select video, traj_idx, frame, x, y, state, cast(sum(new) over (partition by video, traj_idx order by frame) as integer) as run from r0)"""
)
_STEPS = (
    _RUNS
    + """, s0 as (select *, frame - lag(frame) over w as dframe, x - lag(x) over w as dx, y - lag(y) over w as dy from r window w as (partition by video, traj_idx, run order by frame)),
s as (select *, sqrt(dx * dx + dy * dy) as jump from s0 where dframe is not null), k as (select * from s where dframe = 1),
p as (select *, lag(dx) over w as pdx, lag(dy) over w as pdy, lag(frame) over w as pframe from k window w as (partition by video, traj_idx, run order by frame) qualify pdx is not null)"""
)
_ANGLES = (
    _STEPS
    + """, c as (select *, coalesce(pdx / nullif(sqrt(pdx * pdx + pdy * pdy), 0), 0) * coalesce(dx / nullif(sqrt(dx * dx + dy * dy), 0), 0)
  + coalesce(pdy / nullif(sqrt(pdx * pdx + pdy * pdy), 0), 0) * coalesce(dy / nullif(sqrt(dx * dx + dy * dy), 0), 0) as cs from p),
a as (select *, 180 - degrees(acos(greatest(-1.0, least(1.0, cs)))) as angle, ((degrees(atan2(pdx * dy - pdy * dx, pdx * dx + pdy * dy)) % 360) + 360) % 360 as polar from c)"""
)
_SUMMARY = _STEPS + ", " + A.DIFFUSION_SQL + """, su as (select r.video, r.traj_idx, r.run, r.state, avg(case when k.dframe = 1 then k.jump end) as mean_jump,
  cast(max(r.frame) - min(r.frame) as double) as duration, count(*) as points from r left join k using (video, traj_idx, run, frame) group by 1, 2, 3, 4),
sm as (select su.*, df.H, df.K from su left join df using (video, traj_idx))"""
_RATIOS = _STEPS + ", q as (select video, traj_idx, run, state, frame, pframe, 'x' as axis, dx / nullif(pdx, 0) as r from p union all select video, traj_idx, run, state, frame, pframe, 'y', dy / nullif(pdy, 0) from p)"
_D1 = _STEPS + ", d as (select video, traj_idx, state, frame, 'x' as axis, dx as d from k union all select video, traj_idx, state, frame, 'y', dy from k)"


def _hist(frm, col, bins, by, ends=None):
    said = f"select min({col})::double as lo, max({col})::double as hi from {frm}" if ends is None else f"select {ends[0]}::double as lo, {ends[1]}::double as hi"
    return f"en as ({said}), h as (select {by}, cast(least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1}) as integer) as bin, count(*) as n, any_value((hi - lo) / {bins}) as w from {frm}, en where {col} is not null group by 1, 2)"


_SHARE = "select state, bin, n, round(100.0 * n / sum(n) over (partition by state), 4) as share from h"
_SHIFT = _RUNS + """, o as (select *, x - first_value(x) over w as rx, y - first_value(y) over w as ry, frame - first_value(frame) over w as t, row_number() over w - 1 as pos,
  max(frame) over (partition by video, traj_idx, run) - min(frame) over (partition by video, traj_idx, run) as last from r window w as (partition by video, traj_idx, run order by frame))"""

SQL = {
    "traj_steps": _STEPS + " select video, traj_idx, run, frame, dframe, round(dx, 4) as dx, round(dy, 4) as dy, round(jump, 4) as jump from s",
    "traj_state_runs": _RUNS + " select video, traj_idx, run, state, count(*) as points, min(frame) as first_frame, max(frame) as last_frame from r group by 1, 2, 3, 4 having count(*) between 2 and 50",
    "traj_min_points": _P + " select video, traj_idx, count(*) as points from tr group by 1, 2 having count(*) >= 10",
    "origin_shift": _SHIFT + " select video, traj_idx, frame, round(rx * 0.16, 4) as rx, round(ry * 0.16, 4) as ry, round(t * cast(0.01 as double), 4) as t from o",
    "traj_summary": _SUMMARY + " select video, traj_idx, run, state, round(mean_jump, 4) as mean_jump, round(duration, 4) as duration, points, round(H, 4) as H, round(K, 4) as K from sm",
    "state_summary": _SUMMARY
    + """ select video, state, count(*) as n, round(avg(mean_jump), 4) as mean_jump, round(avg(duration), 4) as mean_duration, round(avg(H), 4) as mean_h, round(median(H), 4) as median_h,
  round(avg(K), 4) as mean_k, round(median(K), 4) as median_k from sm group by 1, 2""",
    "population_share": _SUMMARY + " select video, state, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by video), 4) as percent from sm group by 1, 2",
    "turn_angle": _ANGLES + " select video, traj_idx, run, frame, round(angle, 3) as angle, round(polar, 3) as polar from a",
    "turn_angle_strict": _ANGLES + " select state, count(*) as n, round(avg(angle), 3) as mean_angle from a where frame = pframe + 1 group by 1",
    "disp_1d": _D1 + " select video, traj_idx, frame, axis, round(d, 4) as d from d",
    "ratio_1d": _RATIOS + " select video, traj_idx, frame, axis, round(r, 4) as r from q where r is not null",
    "ratio_1d_strict": _RATIOS + " select state, axis, count(*) as n from q where r is not null and frame = pframe + 1 group by 1, 2",
    "jump_hist": _STEPS + ", " + _hist("k", "jump", 50, "state") + _SHARE.replace("select", " select", 1),
    "duration_hist": _SUMMARY + ", " + _hist("sm", "duration", 200, "state") + " " + _SHARE,
    "polar_rose": _ANGLES + ", a2 as (select state, round(polar, 6) as polar from a), " + _hist("a2", "polar", 36, "state", (0, 360)) + " " + _SHARE,
    "log_k_hist": _P + ", " + A.DIFFUSION_SQL + """, e as (select min(K) as lo, max(K) as hi from df where K > 0)
  select video, cast(least(floor(ln(K / lo) / ln(hi / lo) * 20), 19) as integer) as bin, count(*) as n from df, e where K > 0 group by 1, 2""",
    "density_1d": _D1 + ", " + _hist("d", "d", 80, "axis") + " select axis, bin, n, round(n / (sum(n) over (partition by axis) * w), 7) as share from h",
    "ea_sd": _SHIFT + """, g as (select video, traj_idx, run, list(t) as there from o group by 1, 2, 3),
  q as (select state, pos as t, (rx * rx + ry * ry) / 4 as sd from o join g using (video, traj_idx, run) where pos < last and list_contains(there, pos))
  select state, cast(t as integer) as t, round(avg(sd) + 1e-9, 3) as mean, round(stddev_pop(sd) + 1e-9, 3) as std, count(*) as n from q group by 1, 2""",
    "ea_sd_strict": _SHIFT + " select state, cast(t as integer) as t, round(avg((rx * rx + ry * ry) / 4) + 1e-9, 3) as mean, count(*) as n from o group by 1, 2",
    "ta_ea_sd": _RUNS + """, n as (select *, row_number() over (partition by video, traj_idx, run order by frame) as pos from r),
  q as (select a.video, a.traj_idx, a.run, a.state, b.frame - a.frame as lag, avg(((b.x - a.x) ** 2 + (b.y - a.y) ** 2) / 4) as sd from n a join n b
    on a.video = b.video and a.traj_idx = b.traj_idx and a.run = b.run and b.pos > a.pos and b.frame - a.frame = b.pos - a.pos group by 1, 2, 3, 4, 5)
  select state, lag, round(avg(sd) + 1e-9, 3) as mean, round(stddev_pop(sd) + 1e-9, 3) as std, count(*) as n from q group by 1, 2""",
    "pooled_msd_sem": _P
    + ", q as ("
    + " union all ".join(f"select {n} as lag, (lead({c}, {n}) over (partition by video, traj_idx order by frame) - {c}) ** 2 as sd from tr" for n in range(1, 6) for c in "xy")
    + ") select lag, round(avg(sd) + 1e-9, 3) as msd, round(stddev_samp(sd) / sqrt(count(*)) + 1e-9, 3) as sem, count(*) as n from q where sd is not null group by 1",
    "max_duration": _P + " select max(d) as max_duration from (select max(frame) - min(frame) as d from tr group by video, traj_idx)",
    "centroids": _P + " select video, traj_idx, round(avg(x) + 1e-9, 4) as cx, round(avg(y) + 1e-9, 4) as cy, count(*) as points from tr group by 1, 2",
    "state_rank_by_k": _P + ", " + A.DIFFUSION_SQL + " select state, cast(dense_rank() over (order by avg(K)) - 1 as integer) as rank, round(avg(K), 4) as mean_k from tr join df using (video, traj_idx) group by 1",
    "merge_offset": _P + """, v as (select video, max(traj_idx) + 1 as size from tr group by 1), o as (select video, coalesce(sum(size) over (order by video rows between unbounded preceding and 1 preceding), 0) as o from v)
  select video, traj_idx, cast(traj_idx + o as bigint) as merged_idx, count(*) as points from tr join o using (video) group by 1, 2, 3""",
    "traces_left_diffusion": _P + ", " + A.DIFFUSION_SQL + " select video, traj_idx, frame, state, round(H, 4) as H, round(K, 4) as K from tr left join df using (video, traj_idx)",
    "jump_percentiles": _STEPS + " select round(quantile_cont(jump, 0.025), 4) as p0_025, round(quantile_cont(jump, 0.5), 4) as p0_5, round(quantile_cont(jump, 0.975), 4) as p0_975, round(quantile_cont(jump, 0.99), 4) as p0_99 from k",
    "distinct_trajectories": _P + " select video, count(distinct traj_idx) as n from tr group by 1",
    "viz_value": _SUMMARY + " select video, traj_idx, run, case when points >= 3 then round(log10(greatest(K, 1e-20)), 4) end as value from sm",
}
