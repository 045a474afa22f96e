"""Queries of localization, jump laws, densities and fits, each with its SQL where there is one."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spotloom.functions import cauchy as C
from spotloom.functions import lookup, tracking
from spotloom.operators import estimators, graph, linking, localize, mixtures, postprocess
from spotloom.operators import features as X
from spotloom.operators import trajectory as T
from spotloom.operators.quantiles import quantiles
from spotloom.plans import adapters as A
from spotloom.plans import feature_queries, spot_queries
from spotloom.sources import pictures, tables

#: A law of jumps for lookups: an exponential one with a mean of four.
LAW = [math.exp(-i / 8) / 4 for i in range(lookup.JUMP_BINS)]
AXIS = [-1.0, 0.0, 0.5, 1.0, 2.5]


def _runs(s, d):
    return T.state_runs(A.traces(s, d))


def _pairs(s, d):
    return graph.adjacent_pairs(A.loc(s, d))


def _spread(s, d):
    """H of every trajectory and its ends rounded outwards to twentieths."""
    h = A.diffusion(s, d)
    ends = h.agg((F.floor(F.min("H") * 20) / 20).alias("low"), (F.ceil(F.max("H") * 20) / 20).alias("high"))
    return ends.join(F.broadcast(quantiles(h, "H", [], p2_5=0.025, p97_5=0.975))).select("low", "high", F.round("p2_5", 6).alias("p2_5"), F.round("p97_5", 6).alias("p97_5"))  # a row each


def _roi(s, d):
    roi = spot_queries._classes(s, d, True).join(A.diffusion(s, d), ["video", "traj_idx"], "left")
    return roi.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("H"), 4).alias("mean_h"), F.round(F.avg("K"), 4).alias("mean_k"))


#: Exponent of the costs of steps.
ALPHA = 0.8


def _costs(s, d):
    """The log density of each jump given the one before, and whether it is abnormal."""
    w = T.by_frame()
    back = lambda c, n=1: F.col(c) - F.lag(c, n).over(w) if n == 1 else F.lag(c, 1).over(w) - F.lag(c, 2).over(w)
    t = A.traces(s, d).select("video", "traj_idx", "frame", *[back(c, n).alias(f"{c}{n}") for c in ("x", "y", "frame") for n in (1, 2)]).where("frame2 is not null")
    cost, odd = tracking.step_cost((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), F.lit(ALPHA), F.col("frame2") - 1, F.col("frame1") - 1)
    return t.select("video", "traj_idx", "frame", F.round(cost, 3).alias("log_density"), odd.alias("abnormal"))


def _paths(s, d, part):
    """Pieces of trajectories of ten days; those of odd tens also begin with the last node of the ten before."""
    t = A.traces(s, d).withColumn("ten", F.floor(F.col("frame") / 10))
    node = F.concat_ws(":", "traj_idx", "frame")
    own = t.select("video", "traj_idx", "ten", "frame", node.alias("node"))
    if part:
        last = own.groupBy("video", "traj_idx", (F.col("ten") + 1).alias("ten")).agg(F.max("frame").alias("frame"))
        own = own.unionByName(last.select("video", "traj_idx", "ten", "frame", F.concat_ws(":", "traj_idx", "frame").alias("node")))
    own = own.where(F.col("ten") % 2 == part)
    return own.groupBy("video", F.concat_ws("-", "traj_idx", "ten").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "node"))), lambda x: x["node"]).alias("nodes"))


QUERIES = {
    "trim_jumps": lambda s, d: mixtures.trim_jumps(_pairs(s, d)).groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.greatest(F.abs("dx"), F.abs("dy"))), 4).alias("most")),
    "jump_density_lookup": lambda s, d: _pairs(s, d).select("video", "frame", "src_idx", "dst_idx", lookup.rounded_log_jump_density(F.col("d"), LAW, 4).alias("log_density")),
    "quantile_axis_lookup": lambda s, d: A.diffusion(s, d).select("video", "traj_idx", lookup.beyond(AXIS, F.col("K")).alias("at")),
    "trajectory_colours": lambda s, d: A.traces(s, d).select("video", "traj_idx").distinct().withColumn("colour", tracking.colour(F.col("traj_idx"))),
    "segments": lambda s, d: pictures.segments(A.traces(s, d)).select("video", "traj_idx", "frame", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")]),
    "viz_range": _spread,
    "roi_stats": _roi,
    "densities": lambda s, d: T.displacements_1d(_runs(s, d)).select("video", "traj_idx", "frame", "axis", F.round(C.gaussian_pdf(F.col("d"), 0.0, 30.0) * 1000, 5).alias("normal"), F.round(C.cauchy_pdf(F.col("d"), -0.1, 20.0) * 1000, 5).alias("cauchy")),
    "thompson": lambda s, d: A.traces(s, d).where("x > 0").select("video", "traj_idx", "frame", F.round(C.thompson(1.3, 0.16, F.col("x"), 2.0), 4).alias("error")),
    "pooled_sigma": lambda s, d: estimators.pooled_sigma(A.traces(s, d).where("x > 0").withColumn("sigma_loc", C.thompson(1.3, 0.16, F.col("x"), 2.0))).select("video", F.round("median", 4).alias("median"), F.round("rms", 4).alias("rms")),
    "k_network": lambda s, d: X.k_feature(A.traces(s, d)).select("video", "traj_idx", F.round(lookup.k_of(F.col("k_feature"), F.col("n"), lookup.Affine(0.75, -0.4)), 4).alias("log_k")),
    "split_hops": lambda s, d: postprocess.split_hops(A.traces(s, d).withColumn("place", F.col("state"))).groupBy("video", "traj_idx").agg(F.countDistinct("part").alias("parts")),
    "step_costs": _costs,
    "prev_next": lambda s, d: graph.match_paths(_paths(s, d, 0), _paths(s, d, 1)),
    "shared_frames": lambda s, d: graph.shared_frames(A.loc(s, d)),
    "batches": lambda s, d: tables.union_batches([A.loc(s, d).where("frame < 360"), A.loc(s, d).where("frame >= 360").withColumn("frame", F.col("frame") - 360)], [360, 360]).select("video", "frame", "spot_idx"),
    "k_fit": lambda s, d: s.createDataFrame([estimators.fit_k(A.traces(s, d), 0.5) or (None, None)], "K double, H double"),
    "localize": lambda s, d: localize.localize(A.rendered(s, d)),
    "localize_rounds": lambda s, d: localize.localize(A.rendered(s, d), localize.Options(deflations=1, smooth=2)),
    "sigma_loc": lambda s, d: estimators.sigma_loc(localize.localize(A.rendered(s, d))).select("video", "frame", "spot_idx", "sigma_loc"),
    "place_labels": lambda s, d: postprocess.place_labels(A.traces(s, d)).select("video", "traj_idx", "frame", "place"),
    "greedy_jump_threshold": lambda s, d: s.createDataFrame([(mixtures.gmm_jump_threshold(graph.cut_lineage(mixtures.trim_jumps(graph.cut_lineage(linking.greedy_matches_with_parts(A.loc(s, d)).select("dx", "dy"))))),)], "threshold double"),
    "displacement_fit": lambda s, d: estimators.displacement_histogram_fit(_runs(s, d)),
    "ratio_fit": lambda s, d: estimators.ratio_histogram_fit(_runs(s, d)),
    "multi_delta_scan": lambda s, d: estimators.multi_delta_scan(A.traces(s, d)),
    "noise_sensitivity": lambda s, d: estimators.sensitivity(estimators.multi_delta_scan(A.traces(s, d)), 0.1, 0.2, 0.5),
}

_P = "with " + A.TRACES_SQL
_RUNS = _P + """, r0 as (select *, case when state <> lag(state) over w then 1 else 0 end as new from tr window w as (partition by video, traj_idx order by frame)),
r as (select video, traj_idx, frame, x, y, cast(sum(new) over (partition by video, traj_idx order by frame) as integer) as run from r0),
s as (select *, frame - lag(frame) over w as df, x - lag(x) over w as dx, y - lag(y) over w as dy from r window w as (partition by video, traj_idx, run order by frame)),
d as (select video, traj_idx, frame, 'x' as axis, dx as d from s where df = 1 union all select video, traj_idx, frame, 'y', dy from s where df = 1)"""
_PAIRS = "with " + A.LOC_SQL + """, nx as (select video, frame, lead(frame) over (partition by video order by frame) as nf from (select distinct video, frame from loc)),
ap as (select a.video, a.frame, a.spot_idx as src_idx, b.spot_idx as dst_idx, b.x - a.x as dx, b.y - a.y as dy from loc a join nx using (video, frame) join loc b on a.video = b.video and nx.nf = b.frame)"""
_TRIM = "{1} as (select {0}.* from {0}, (select greatest(4 * (stddev_pop(dx) + stddev_pop(dy)) / 2, 10) as m from {0}) where abs(dx) < m and abs(dy) < m)"


def _sql_costs():
    """The cost of steps written out: both parts pushed from zero, their ratio drawn to what is expected, a Cauchy law of it."""
    spread = lambda g: f"(pow(2.0 * ({g} + 1.0), a) - 2 * pow({g} + 1.0, a))"
    decades = lambda v: f"greatest(0, least(2, -log10(abs({v}))))"
    push = lambda v: f"({v} + case when {v} < 0 then -{tracking.PUSH} else {tracking.PUSH} end)"
    ratio = lambda c: f"(n{c} / d{c} + (rho * r - n{c} / d{c}) * pow(least(sqrt({decades('n' + c)} + 2 * {decades('d' + c)}) / 2, 1), 1::double / 3))"
    law = lambda c: f"-ln(pi() * s * (pow(q{c} - rho * r, 2) / (s * s * r) + r))"
    return (
        _P + f""", u as (select video, traj_idx, frame, x - lag(x) over w as x1, lag(x) over w - lag(x, 2) over w as x2, y - lag(y) over w as y1, lag(y) over w - lag(y, 2) over w as y2, frame - lag(frame) over w - 1 as g1, lag(frame) over w - lag(frame, 2) over w - 1 as g2, {ALPHA}::double as a from tr window w as (partition by video, traj_idx order by frame)),
  k as (select *, pow(2, a - 1) - 1 as rho, sqrt({spread("g1")} / {spread("g2")}) as r, {push("x1")} as nx, {push("x2")} as dx, {push("y1")} as ny, {push("y2")} as dy from u where x2 is not null),
  l as (select *, sqrt(1 - rho * rho) * r as s, {ratio("x")} as qx, {ratio("y")} as qy from k)
  select video, traj_idx, frame, round({law("x")} {law("y")}, 3) as log_density, abs(qx - rho * r) > {tracking.ABNORMAL} * s or abs(qy - rho * r) > {tracking.ABNORMAL} * s as abnormal from l"""
    )


_COSTS = _sql_costs()

SQL = {
    "pooled_sigma": _P + ", e as (select video, sqrt((1.3::double * 1.3 + 0.16::double * 0.16 / 12) / x + 8 * pi() * pow(1.3::double, 4) * 4 / (0.16::double * 0.16 * x * x)) as s from tr where x > 0) select video, round(median(s), 4) as median, round(sqrt(avg(s * s)), 4) as rms from e group by 1",
    "k_network": "select video, traj_idx, round(case when n < 2 then 0.5 else k * 0.75 - 0.4 end, 4) as log_k from (" + feature_queries.SQL["k_feature"].replace("round(case when f > 0 then log10(f) else 0.5 end, 4) as k_feature", "case when f > 0 then log10(f) else 0.5 end as k") + ")",
    "split_hops": _P + """, o as (select *, sqrt(pow(x - avg(x) over p, 2) + pow(y - avg(y) over p, 2)) as d, coalesce(cast(state <> lag(state) over w as integer), 0) as c from tr window p as (partition by video, traj_idx, state), w as (partition by video, traj_idx order by frame)),
  g as (select video, traj_idx, max(m) as m from (select video, traj_idx, state, avg(d) as m from o group by 1, 2, 3) group by 1, 2), v as (select video, avg(cast(m < 1 as double)) > 0.8 as cut from g group by 1)
  select video, traj_idx, case when any_value(cut) then 1 + sum(c) else 1 end::bigint as parts from o join v using (video) group by 1, 2""",
    "step_costs": _COSTS,
    "prev_next": _P + """, o as (select video, traj_idx, frame // 10 as ten, frame, traj_idx || ':' || frame as node from tr),
  p as (select video, traj_idx || '-' || ten as path, max_by(node, frame) as last from o where ten % 2 = 0 group by 1, 2 having count(*) > 1),
  n as (select video, traj_idx, ten, node from o where ten % 2 = 1 union all select video, traj_idx, ten + 1, max_by(node, frame) from o group by video, traj_idx, ten having (ten + 1) % 2 = 1),
  m as (select n.video, n.traj_idx || '-' || n.ten as path, min(p.path) as prev from n left join p on p.video = n.video and p.last = n.node group by 1, 2) select video, path, prev from m""",
    "shared_frames": "with " + A.LOC_SQL + " select frame from loc group by 1 having count(distinct video) = (select count(distinct video) from loc)",
    "batches": "with " + A.LOC_SQL + " select video, frame, spot_idx from loc",
    "trim_jumps": _PAIRS + ", " + _TRIM.format("ap", "a1") + ", " + _TRIM.format("a1", "a2") + " select video, count(*) as n, round(max(greatest(abs(dx), abs(dy))), 4) as most from a2 where abs(dx) < 10 and abs(dy) < 10 group by 1",
    "jump_density_lookup": _PAIRS + f" select video, frame, src_idx, dst_idx, round(ln(exp(-least(floor(sqrt(dx * dx + dy * dy) / 20 * 40), 38) / 8) / 4 + 1e-7), 4) as log_density from ap",
    "quantile_axis_lookup": "with " + A.EVENTS_SQL + ", " + A.DIFFUSION_SQL + " select video, traj_idx, cast(case when K < -1 then 0 when K < 0 then 1 when K < 0.5 then 2 when K < 1 then 3 else 4 end as integer) as at from df",
    "trajectory_colours": _P + f""", m0 as (select distinct video, traj_idx, (traj_idx::uhugeint + {tracking.MIX_ADD}) % {1 << 64}::uhugeint as x from tr),
  m1 as (select video, traj_idx, (xor(x, x >> {tracking.MIX_ROUNDS[0][0]}) * {tracking.MIX_ROUNDS[0][1]}::uhugeint) % {1 << 64}::uhugeint as x from m0),
  m2 as (select video, traj_idx, (xor(x, x >> {tracking.MIX_ROUNDS[1][0]}) * {tracking.MIX_ROUNDS[1][1]}::uhugeint) % {1 << 64}::uhugeint as x from m1),
  m3 as (select video, traj_idx, (xor(x, x >> {tracking.MIX_LAST}) % 16777216)::integer as b from m2)
  select video, traj_idx, (b & 255) * 65536 + ((b >> 8) & 255) * 256 + ((b >> 16) & 255) as colour from m3""",
    "segments": _P + ", q as (select video, traj_idx, frame, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from tr window w as (partition by video, traj_idx order by frame)) select video, traj_idx, frame, round(x1, 4) as x1, round(y1, 4) as y1, round(x2, 4) as x2, round(y2, 4) as y2 from q where x2 is not null",
    "viz_range": "with " + A.EVENTS_SQL + ", " + A.DIFFUSION_SQL + " select floor(min(H) * 20) / 20 as low, ceil(max(H) * 20) / 20 as high, round(quantile_cont(H, 0.025), 6) as p2_5, round(quantile_cont(H, 0.975), 6) as p97_5 from df",
    "roi_stats": f"select roi, count(*) as n, round(avg(H), 4) as mean_h, round(avg(K), 4) as mean_k from ({spot_queries.SQL['roi_classes_strict']}) left join (with {A.EVENTS_SQL}, {A.DIFFUSION_SQL} select * from df) using (video, traj_idx) group by 1",
    "densities": _RUNS + f" select video, traj_idx, frame, axis, round(1000 * exp(-0.5 * pow(d / 30.0::double, 2)) / (30.0::double * sqrt(2 * pi())), 5) as normal, round(1000 / (pi() * 20.0::double * (1 + pow((d + 0.1::double) / 20.0::double, 2))), 5) as cauchy from d",
    "thompson": _P + " select video, traj_idx, frame, round(sqrt((1.3::double * 1.3 + 0.16::double * 0.16 / 12) / x + 8 * pi() * pow(1.3::double, 4) * 4 / (0.16::double * 0.16 * x * x)), 4) as error from tr where x > 0",
}
