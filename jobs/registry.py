"""The jobs as queries over the given tables, with SQL for what they leave behind.

Each runs its job twice into a new folder of the cluster's shared one, leaves the files, and returns the output as read
back after the second run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import compare, recordings
from spotloom.operators.graph import new_folder
from spotloom.plans import adapters as A

#: Added before rounding, so that both engines round fives up.
TIE = 1e-9


def _folder(spark: SparkSession, name: str) -> str:
    return f"{new_folder(spark)}/{name}"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + TIE, 4) for c in columns})


def job1_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _folder(spark, "job1")
    for _ in range(2):
        recordings.update(spark, recordings.load(), f"{sf_dir}/events*.parquet", f"{where}/out", f"{where}/checkpoint")
    return _rounded(recordings.read_report(spark, f"{where}/out"), "mean_jump", "mean_duration", "percent")


JOB1_SQL = f"""with {A.EVENTS_SQL},
pt as (select strftime(cast(ts as date), '%Y-%m-%d') as day, video, user_id, cast(hour as integer) as frame, x, y, cast(state as integer) as state from (select ev.*, e.ts from ev join events e using (event_id))
  qualify row_number() over (partition by day, user_id, hour order by event_id) = 1),
r0 as (select *, case when state <> lag(state) over w then 1 else 0 end as new from pt window w as (partition by day, user_id order by frame)),
r as (select *, sum(new) over (partition by day, user_id order by frame) as run from r0),
s as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as jump from r window w as (partition by day, user_id, run order by frame)),
u as (select day, video, user_id, run, state, count(*) as points, max(frame) - min(frame) as duration, count(jump) as steps, sum(jump) as jumps from s group by all)
select day, video, state, count(distinct user_id) as particles, count(*) as runs, cast(sum(points) as bigint) as points, cast(sum(steps) as bigint) as steps,
  round(sum(jumps) / sum(steps) + {TIE}, 4) as mean_jump, round(avg(duration) + {TIE}, 4) as mean_duration, round(100.0 * count(*) / sum(count(*)) over (partition by day, video) + {TIE}, 4) as percent
from u group by day, video, state"""


def job2_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _folder(spark, "job2")
    for _ in range(2):
        compare.compare(spark, compare.load(), f"{sf_dir}/conversations.parquet", where)
    return _rounded(compare.read_report(spark, where), "value")


JOB2_SQL = f"""with p as (select role as video, conv_id, turn, min((coalesce(length(text), 0), coalesce(length(text) - length(replace(text, ' ', '')), 0))) as place from conversations
  where role is not null and conv_id is not null and turn is not null group by 1, 2, 3),
o as (select video, conv_id, place[1] as x, place[2] as y, row_number() over (partition by video, conv_id order by turn) as n from p),
d as (select b.video, b.n - a.n as lag, sqrt(pow((b.x - a.x) * 0.001::double, 2) + pow((b.y - a.y) * 0.001::double, 2)) as jump from o a join o b on a.video = b.video and a.conv_id = b.conv_id and b.n - a.n between 1 and 5),
j as (select video, jump from d where lag = 1),
e as (select min(jump) as lo, max(jump) as hi from j),
h as (select video, least(floor((jump - lo) / ((hi - lo) / 40)), 39) as bin, count(*) as n from j, e group by 1, 2),
m as (select video, count(*) as n, avg(jump) as mean, quantile_cont(jump, 0.025) as q0, quantile_cont(jump, 0.5) as q1, quantile_cont(jump, 0.975) as q2 from j group by 1),
c as (select video, lag, count(*) as n, avg(jump * jump) as mean, stddev_samp(jump * jump) as sd from d group by 1, 2),
z as (select video, count(distinct conv_id) as n0, count(*) as n1 from o group by 1),
a as (select 'jumps' as section, video, bin::double as item, n, 100.0 * n / sum(n) over (partition by video) as value from h
union all select 'percentiles', video, unnest([2.5, 50, 97.5])::double, n, unnest([q0, q1, q2]) from m
union all select 'msd', video, lag, n, mean from c union all select 'sem', video, lag, n, sd / sqrt(n) from c where n > 1
union all select 'size', z.video, unnest([0, 1]), unnest([n0, n1]), m.mean from z left join m on z.video = m.video)
select item, n, round(value + {TIE}, 4) as value, section, video from a"""


QUERIES = {"job1_recordings": job1_recordings, "job2_compare": job2_compare}
SQL = {"job1_recordings": JOB1_SQL, "job2_compare": JOB2_SQL}
