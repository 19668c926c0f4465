"""Rate, error, novelty and decay detectors over events: the batch forms of the streaming operators.

All run on event time. Windows trail each row; keys partition them, so a busy key costs one sorted
partition and nothing is held for all keys at once. Thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import severity as sev
from tidemark.plans.folds import fold_groups
from tidemark.plans.tables import table

DAY = 86_400


def entries(events: DataFrame) -> DataFrame:
    """Events as access-log entries."""
    status = F.when(F.col("event_type") == "error", 500).when(F.col("value") > 100, 404).otherwise(200)
    method = F.when(F.col("event_type").isin("signup", "purchase"), "POST").otherwise("GET")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"), method.alias("method"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), F.get_json_object("props", "$.k")).alias("path"), status.alias("status"), "user_id", "event_type", "value",
    )


ENTRIES_SQL = """entries as (select event_id, ts, epoch_us(ts) as us, '10.0.0.' || user_id as ip, case when event_type in ('signup', 'purchase') then 'POST' else 'GET' end as method,
  '/' || event_type || '/' || json_extract_string(props, '$.k') as path, case when event_type = 'error' then 500 when value > 100 then 404 else 200 end as status, user_id, event_type, value from events)"""


def log(spark, sf_dir) -> DataFrame:
    return entries(table(spark, sf_dir, "events"))


def trailing(key: str, seconds: int):
    return Window.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000, 0)


def level(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")


def status_levels(spark, sf_dir):
    return log(spark, sf_dir).groupBy(level(F.col("status")).alias("level"), "method").agg(F.count(F.lit(1)).alias("n"))


def rates(rows: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """``rows`` (us) with n, the rows of their key in the last ``seconds``, and rate: n over the span from first to last."""
    w = trailing(key, seconds)
    e = rows.withColumns({"n": F.count(F.lit(1)).over(w), "_span": F.col("us") - F.min("us").over(w)})
    rate = F.when(F.col("_span") == 0, F.col("n").cast("double")).otherwise(F.col("n") / (F.col("_span") / 1e6))
    return e.withColumn("rate", F.round(rate, 9)).drop("_span")


def error_shares(rows: DataFrame, key: str, seconds: int = 60, least: int = 20, share: float = 0.4) -> DataFrame:
    """Rows (status) with more than ``least`` requests of their key in the last ``seconds``, more than ``share`` of them errors."""
    w = trailing(key, seconds)
    e = rows.withColumns({"total": F.count(F.lit(1)).over(w), "errors": F.count_if(F.col("status") >= 400).over(w)})
    return e.where((F.col("total") > least) & (F.col("errors") > share * F.col("total")))


def repeated(rows: DataFrame, key: str, seconds: int = 60, least: int = 20) -> DataFrame:
    """Rows that are at least the ``least``-th of their key in the last ``seconds``: hits."""
    return rows.withColumn("hits", F.count(F.lit(1)).over(trailing(key, seconds))).where(F.col("hits") >= least)


def distinct_in_window(rows: DataFrame, key: str, value: str, seconds: int = 60, least: int = 30) -> DataFrame:
    """Rows whose key has at least ``least`` different values in the last ``seconds``: n_values.

    A value counts where it is the newest of its kind: a row adds one until the next row with its key and
    value, so the distinct count is a running sum over starts and ends and no set is held.
    """
    same = Window.partitionBy(key, value).orderBy("us")
    span = seconds * 1_000_000
    placed = rows.withColumn("_next", F.lead("us").over(same))
    ends = F.least(F.coalesce("_next", F.col("us") + span + 1), F.col("us") + span + 1)
    changes = placed.select(key, F.col("us").alias("_at"), F.lit(1).alias("_d")).unionByName(placed.select(key, ends.alias("_at"), F.lit(-1).alias("_d"))).groupBy(key, "_at").agg(F.sum("_d").alias("_d"))
    running = changes.withColumn("n_values", F.sum("_d").over(Window.partitionBy(key).orderBy("_at"))).select(key, F.col("_at").alias("us"), "n_values")
    return rows.join(running, [key, "us"]).where(F.col("n_values") >= least)


def trailing_counts(rows: DataFrame, key: str, seconds: int, counted: dict[str, Column]) -> DataFrame:
    """``rows`` (us) with the columns ``counted``: how many rows of their key in the last ``seconds`` meet each condition.

    A key's time is cut into spans of ``seconds``. Inside one a row adds where it stands; what the span before held is there at
    the start and leaves row by row as its time is up. Counts are running sums: no window is read again for each row, and
    a key has a task for each span. Rows without time count those of their key without one.
    """
    length = seconds * 1_000_000
    ones = {c: F.coalesce(met.cast("int"), F.lit(0)) for c, met in counted.items()}
    own = rows.withColumns({**{f"_{c}": one for c, one in ones.items()}, "_start": F.col("us") - F.pmod("us", F.lit(length)), "_at": F.col("us"), "_own": F.lit(True)})
    later = own.where("us is not null").select(key, (F.col("_start") + length).alias("_start"), "us", *[f"_{c}" for c in counted])
    leaving = later.select(key, "_start", (F.col("us") + length + 1).alias("_at"), *[(-F.col(f"_{c}")).alias(f"_{c}") for c in counted])
    before = later.groupBy(key, "_start").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in counted]).withColumn("_at", F.col("_start"))
    changes = own.unionByName(leaving, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)
    so_far = Window.partitionBy(key, "_start").orderBy("_at")
    return changes.withColumns({c: F.sum(f"_{c}").over(so_far) for c in counted}).where("_own").select(*rows.columns, *counted)


def trailing_rates(spark, sf_dir):
    """Events of a user in the last day: count and rate."""
    return rates(log(spark, sf_dir), "ip", DAY).select("event_id", "ip", "n", "rate")


def error_spikes(spark, sf_dir):
    """More than 40 % errors among more than three requests of a user in a day."""
    return error_shares(log(spark, sf_dir), "ip", DAY, 3, 0.4).select("event_id", "ip", "total", "errors")


def brute_force(spark, sf_dir):
    """At least three posts of a user in a day."""
    return repeated(log(spark, sf_dir).where("method = 'POST'"), "ip", DAY, 3).select("event_id", "ip", "hits")


def scanner_sweeps(spark, sf_dir):
    """At least five distinct paths of a user in a day."""
    e = log(spark, sf_dir).where("path is not null")
    return distinct_in_window(e, "ip", "path", DAY, 5).select("event_id", "ip", F.col("n_values").alias("paths"))


def tumbling_sweeps(spark, sf_dir):
    """Distinct paths of a user in each calendar day."""
    e = log(spark, sf_dir).groupBy("ip", F.to_date("ts").alias("day")).agg(F.countDistinct("path").alias("paths"), F.count(F.lit(1)).alias("n"))
    return e.where("paths >= 4").select("ip", F.date_format("day", "yyyy-MM-dd").alias("day"), "paths", "n")


PROBES = ["/error/1", "/view/2", "/click/3"]


def injection_probes(spark, sf_dir):
    """One row for each literal that a path contains."""
    literals = F.explode(F.array(*map(F.lit, PROBES)))
    return log(spark, sf_dir).select("event_id", "ip", "path", literals.alias("probe")).where(F.lower("path").contains(F.col("probe"))).select("event_id", "ip", "probe")


def previous_values(spark, sf_dir):
    """Each event against the user's one before: improving, regressing, stable or first."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = log(spark, sf_dir).withColumn("before", F.lag("value").over(w))
    trend = F.when(F.col("before").isNull(), "first").when(F.col("value") > F.col("before"), "improving").when(F.col("value") < F.col("before"), "regressing").otherwise("stable")
    return e.select("event_id", "before", trend.alias("trend"))


def first_seen(spark, sf_dir):
    """The first event of each (user, type) is new."""
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    return log(spark, sf_dir).withColumn("nth", F.row_number().over(w)).where("nth = 1").select("event_id", "user_id", "event_type")


def silences(spark, sf_dir):
    """Gaps of more than two days after at least five events of a user."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = log(spark, sf_dir).withColumn("nth", F.row_number().over(w).cast("long")).withColumn("next", F.lead("us").over(w))
    return e.where(f"nth >= 5 and next - us > {2 * DAY} * 1000000L").select("event_id", "user_id", "nth", (F.col("next") - F.col("us")).alias("gap_us"))


def newest_of_user(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    return log(spark, sf_dir).withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("user_id", "event_id", F.col("nth").cast("long").alias("nth"))


def ttl_dedup(spark, sf_dir):
    """Of events with one (user, type) within six hours of the one before, only the first of a run passes."""
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    e = log(spark, sf_dir).withColumn("before", F.lag("us").over(w))
    return e.where(f"before is null or us - before > {6 * 3600} * 1000000L").select("event_id", "user_id", "event_type")


def sessions(spark, sf_dir):
    """Runs of a user's events with gaps of at most half a day."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = log(spark, sf_dir).withColumn("new", (F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(10**15)) > DAY // 2 * 1_000_000).cast("long")).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), (F.max("us") - F.min("us")).alias("length_us"))


def ewma_state(rows: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.1) -> DataFrame:
    """Exponentially weighted mean and variance of each key's values, folded in order."""

    def step(state, value):
        if state is None:
            return 1, value, 0.0
        n, mean, variance = state
        d = value - mean
        return n + 1, mean + alpha * d, (1 - alpha) * (variance + alpha * d * d)

    return fold_groups(rows, keys, order, [value], lambda: None, step, lambda s: [s], "n long, mean double, variance double")


def ewma(spark, sf_dir):
    s = ewma_state(log(spark, sf_dir), ["user_id"], ["us", "event_id"], "value")
    return s.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


EWMA_SQL = f"""with recursive {ENTRIES_SQL}, o as (select user_id, value, row_number() over (partition by user_id order by us, event_id) as r from entries),
w as (select user_id, r, value as mean, 0.0::double as m2 from o where r = 1
  union all select o.user_id, o.r, w.mean + 0.1::double * (o.value - w.mean), (1 - 0.1::double) * (w.m2 + 0.1::double * (o.value - w.mean) * (o.value - w.mean)) from w join o on o.user_id = w.user_id and o.r = w.r + 1)
select user_id, r as n, round(mean, 6) as mean, round(m2, 4) as variance from w qualify row_number() over (partition by user_id order by r desc) = 1"""


def decayed_scores(rows: DataFrame, keys: list[str], order: list[str], us: str, points: str, ttl_us: int = 3_600_000_000) -> DataFrame:
    """Last and highest score of each key: points that decay linearly to nothing over ``ttl_us`` of silence."""

    def step(state, now, points):
        if state is None:
            return now, points, points
        last, score, peak = state
        score = score * max(0.0, 1.0 - (now - last) / float(ttl_us)) + points
        return now, score, max(peak, score)

    return fold_groups(rows, keys, order, [us, points], lambda: None, step, lambda s: [s[1:]], "score double, peak double")


def watch_scores(spark, sf_dir):
    """Points of a user's findings, decaying over five days of silence; with escalation."""
    points = F.when(F.col("event_type") == "error", sev.WATCH_POINTS["brute_force"]).when(F.col("event_type") == "view", sev.WATCH_POINTS["error_spike"]).otherwise(sev.WATCH_POINTS["rate_spike"])
    s = decayed_scores(log(spark, sf_dir).withColumn("points", points.cast("double")), ["ip"], ["us", "event_id"], "us", "points", 5 * DAY * 1_000_000)
    state = F.when(F.col("peak") >= 100, "critical").when(F.col("peak") >= 50, "high").otherwise("none")
    return s.select("ip", F.round("score", 6).alias("score"), F.round("peak", 6).alias("peak"), state.alias("escalation"))


WATCH_SQL = f"""with recursive {ENTRIES_SQL}, o as (select ip, us, (case event_type when 'error' then 40 when 'view' then 5 else 10 end)::double as p, row_number() over (partition by ip order by us, event_id) as r from entries),
w as (select ip, r, us, p as score, p as peak from o where r = 1
  union all select o.ip, o.r, o.us, w.score * greatest(0.0::double, 1.0::double - (o.us - w.us) / {float(5 * DAY * 1_000_000)!r}::double) + o.p, greatest(w.peak, w.score * greatest(0.0::double, 1.0::double - (o.us - w.us) / {float(5 * DAY * 1_000_000)!r}::double) + o.p) from w join o on o.ip = w.ip and o.r = w.r + 1)
select ip, round(score, 6) as score, round(peak, 6) as peak, case when peak >= 100 then 'critical' when peak >= 50 then 'high' else 'none' end as escalation from w qualify row_number() over (partition by ip order by r desc) = 1"""


def reputation(spark, sf_dir):
    """Distinct sources that report an address; levels at 1, 3 and 5, blocking from 3."""
    e = log(spark, sf_dir).where("status >= 400").groupBy("ip").agg(F.countDistinct("event_type").alias("kinds"), F.countDistinct("path").alias("lists_hit"))
    threat = F.when(F.col("lists_hit") >= 5, "critical").when(F.col("lists_hit") >= 3, "high").otherwise("low")
    return e.select("ip", "kinds", "lists_hit", (F.col("lists_hit") >= 3).alias("blocked"), threat.alias("threat"))


def digest_batches(spark, sf_dir):
    """Six-hour digests of what is not urgent."""
    e = log(spark, sf_dir).where("status < 500")
    start = F.window("ts", "6 hours")["start"]
    return e.groupBy(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def rate_limited(spark, sf_dir):
    """Events beyond the second of a user in an hour are dropped; what passes is counted."""
    w = Window.partitionBy("user_id", "hour").orderBy("us", "event_id")
    e = log(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3_600_000_000)).withColumn("nth", F.row_number().over(w))
    return e.groupBy("user_id").agg(F.count_if(F.col("nth") <= 2).alias("passed"), F.count_if(F.col("nth") > 2).alias("dropped"))


def unacknowledged(spark, sf_dir):
    """Errors with no later event of the same user within a day need escalation."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = log(spark, sf_dir).withColumn("next", F.lead("us").over(w))
    return e.where(f"status >= 500 and (next is null or next - us > {DAY} * 1000000L)").select("event_id", "user_id")


def outliers(spark, sf_dir):
    """A user's last value more than 1.5 sample deviations from the mean of its positive values."""
    e = log(spark, sf_dir).groupBy("user_id").agg(F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("mean"), F.stddev_samp(F.when(F.col("value") > 0, F.col("value"))).alias("sd"), F.count_if(F.col("value") > 0).alias("n"), F.max_by("value", F.struct("us", "event_id")).alias("last"))
    return e.where("n >= 3 and sd > 0").withColumn("z", F.round((F.col("last") - F.col("mean")) / F.col("sd"), 6)).where("abs(z) > 1.5").select("user_id", "n", "last", "z")


def _q(body: str) -> str:
    return f"with {ENTRIES_SQL} {body}"


_RANGE = "over (partition by ip order by us range between 86400000000 preceding and current row)"
_ORDER = "over (partition by user_id order by us, event_id)"
QUERIES = {
    "status_levels": (status_levels, _q("select case when status >= 500 then 'ERROR' when status >= 400 then 'WARNING' else 'INFO' end as level, method, count(*) as n from entries group by all")),
    "trailing_rates": (trailing_rates, _q(f"select event_id, ip, n, round(case when span = 0 then n::double else n / (span / 1e6::double) end, 9) as rate from (select event_id, ip, count(*) {_RANGE} as n, us - min(us) {_RANGE} as span from entries)")),
    "error_spikes": (error_spikes, _q(f"select event_id, ip, total, errors from (select event_id, ip, count(*) {_RANGE} as total, count(*) filter (status >= 400) {_RANGE} as errors from entries) where total > 3 and errors * 10 > total * 4")),
    "brute_force": (brute_force, _q(f"select event_id, ip, hits from (select event_id, ip, count(*) {_RANGE} as hits from entries where method = 'POST') where hits >= 3")),
    "scanner_sweeps": (scanner_sweeps, _q(f"select event_id, ip, paths from (select event_id, ip, count(distinct path) {_RANGE} as paths from entries) where paths >= 5")),
    "tumbling_sweeps": (tumbling_sweeps, _q("select ip, strftime(ts, '%Y-%m-%d') as day, count(distinct path) as paths, count(*) as n from entries group by 1, 2 having count(distinct path) >= 4")),
    "injection_probes": (injection_probes, _q("select event_id, ip, probe from entries, (select unnest(['/error/1', '/view/2', '/click/3']) as probe) where contains(lower(path), probe)")),
    "previous_values": (previous_values, _q(f"select event_id, before, case when before is null then 'first' when value > before then 'improving' when value < before then 'regressing' else 'stable' end as trend from (select *, lag(value) {_ORDER} as before from entries)")),
    "first_seen": (first_seen, _q("select event_id, user_id, event_type from entries qualify row_number() over (partition by user_id, event_type order by us, event_id) = 1")),
    "silences": (silences, _q(f"select event_id, user_id, nth, next - us as gap_us from (select *, row_number() {_ORDER} as nth, lead(us) {_ORDER} as next from entries) where nth >= 5 and next - us > 172800000000")),
    "newest_of_user": (newest_of_user, _q("select user_id, event_id, row_number() over (partition by user_id order by us desc, event_id desc) as nth from entries qualify nth <= 3")),
    "ttl_dedup": (ttl_dedup, _q("select event_id, user_id, event_type from (select *, lag(us) over (partition by user_id, event_type order by us, event_id) as before from entries) where before is null or us - before > 21600000000")),
    "sessions": (sessions, _q(f"select user_id, session, count(*) as n, min(event_id) as first_event, max(us) - min(us) as length_us from (select *, sum(new) {_ORDER} as session from (select *, (coalesce(us - lag(us) {_ORDER}, 1000000000000000) > 43200000000)::bigint as new from entries)) group by user_id, session").replace("select user_id, session,", "select user_id, session::bigint as session,")),
    "ewma": (ewma, EWMA_SQL),
    "watch_scores": (watch_scores, WATCH_SQL),
    "reputation": (reputation, _q("select ip, kinds, lists_hit, lists_hit >= 3 as blocked, case when lists_hit >= 5 then 'critical' when lists_hit >= 3 then 'high' else 'low' end as threat from (select ip, count(distinct event_type) as kinds, count(distinct path) as lists_hit from entries where status >= 400 group by ip)")),
    "digest_batches": (digest_batches, _q("select strftime(time_bucket(interval '6 hours', ts, timestamp '2024-01-01'), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from entries where status < 500 group by 1, 2")),
    "rate_limited": (rate_limited, _q("select user_id, count(*) filter (nth <= 2) as passed, count(*) filter (nth > 2) as dropped from (select user_id, row_number() over (partition by user_id, us // 3600000000 order by us, event_id) as nth from entries) group by user_id")),
    "unacknowledged": (unacknowledged, _q(f"select event_id, user_id from (select *, lead(us) {_ORDER} as next from entries) where status >= 500 and (next is null or next - us > 86400000000)")),
    "value_outliers": (outliers, _q("select user_id, n, last, round((last - mean) / sd, 6) as z from (select user_id, avg(value) filter (value > 0) as mean, stddev_samp(value) filter (value > 0) as sd, count(*) filter (value > 0) as n, arg_max(value, (us, event_id)) as last from entries group by user_id) where n >= 3 and sd > 0 and abs(round((last - mean) / sd, 6)) > 1.5")),
}
