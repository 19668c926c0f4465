"""Keyed operators with timers on event time: escalation, sliding limits and triage of sources.

A timer fires when the watermark passes it, so a replay of the same rows gives the same results whatever the
batches; state is typed, bounded for a key, and removed by a last timer. Rows of a key are taken in order of
time inside a batch; rows later than the watermark are dropped by Spark before they come here.

Defined cases: rows with a null time are skipped; rows with a null key share one state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ESCALATED = ("critical", "high")


def _timed(rows: DataFrame) -> DataFrame:
    """``rows`` that have a time, with ``_us``: the time as a number, which no time zone changes."""
    return rows.where("ts is not null").withColumn("_us", F.unix_micros("ts"))


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("_us", kind="stable")


def _later(state: GroupState, seconds: float) -> None:
    """A timer at a time in seconds, or as soon as possible if that has passed."""
    state.setTimeoutTimestamp(max(math.ceil(seconds * 1000), state.getCurrentWatermarkMs() + 1))


def escalations(alerts: DataFrame, *, wait: float = 1800, keep: float = 72 * 3600) -> DataFrame:
    """(alert_id, fired, due) of each critical or high alert that nobody acknowledges within ``wait`` seconds, once.

    ``alerts``: alert_id, ts with a watermark, severity, acked. The first row that is no acknowledgement fires the
    alert. An acknowledgement in time silences it, a later one does not undo the escalation; what is known of an
    alert goes ``keep`` seconds after it fired.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fired, acked, told = state.get if state.exists else (None, None, False)
        out = []

        def due(now: float) -> None:
            nonlocal told
            if fired is not None and not told and now >= fired + wait and (acked is None or acked >= fired + wait):
                told = True
                out.append((key[0], round(fired * 1e6), round((fired + wait) * 1e6)))

        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() / 1000
            due(now)
            if fired is None or now >= fired + keep:
                state.remove()
            else:
                state.update((fired, acked, told))
                _later(state, fired + keep)
        else:
            for us, severity, ack in _in_order(batches)[["_us", "severity", "acked"]].itertuples(index=False):
                at = us / 1e6
                due(at)
                if ack:
                    acked = at if acked is None else min(acked, at)
                elif fired is None and severity in ESCALATED:
                    fired = at
            base = fired if fired is not None else acked
            if base is not None:
                state.update((fired, acked, told))
                settled = fired is None or told or acked is not None and acked < fired + wait
                _later(state, base + (keep if settled else wait))
        yield pd.DataFrame(out, columns=["alert_id", "fired", "due"])

    found = _timed(alerts).groupBy("alert_id").applyInPandasWithState(update, "alert_id string, fired long, due long", "fired double, acked double, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("alert_id", F.timestamp_micros("fired").alias("fired"), F.timestamp_micros("due").alias("due"))


def limited(rows: DataFrame, key: str, *, most: int = 200, seconds: float = 1.0) -> DataFrame:
    """Rows of which fewer than ``most`` of their key passed in the ``seconds`` before; the others go.

    ``rows``: ``key`` and ts with a watermark, other columns stay. State: the last ``most`` times of a key.
    """
    timed, span = _timed(rows), round(seconds * 1e6)

    def update(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        ordered, passed = _in_order(batches), []
        for now in ordered["_us"].tolist():
            times = [t for t in times if t >= now - span]
            passed.append(len(times) < most)
            if passed[-1]:
                times.append(now)
        if times:
            state.update((times,))
            _later(state, times[-1] / 1e6 + seconds)
        elif state.exists:
            state.remove()
        yield ordered[passed] if len(ordered) else ordered

    return timed.groupBy(key).applyInPandasWithState(update, timed.schema, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout).drop("_us")


TRIAGE_STATE = "n long, last double, mean double, var double, seen array<string>, spike double, deviation double, novelty double, quiet boolean"


def triage(events: DataFrame, *, alpha: float = 0.2, warm: int = 5, spike: float = 10.0, deviations: float = 3.0, cooldown: float = 30.0, silence: float = 300.0, forget: float = 86_400.0) -> DataFrame:
    """(source, ts, kind, value): what is unusual about sources of events (source, technique, ts with a watermark).

    A source's rate is one over the gap since its last event, with an exponential mean and variance. Of a source with
    ``warm`` events: rate_spike, more than ``spike`` times the mean; deviation, more than ``deviations`` standard deviations
    from it; novelty, a technique that the source never had; each kind once in ``cooldown`` seconds. silence: ``silence`` seconds
    after the last event of such a source, once until it speaks again. A source is forgotten after ``forget`` seconds.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, mean, var, seen, *told, quiet = state.get if state.exists else (0, 0.0, 0.0, 0.0, [], -1e18, -1e18, -1e18, False)
        seen, out = list(seen), []

        def silent(now: float) -> None:
            nonlocal quiet
            if n >= warm and not quiet and now - last > silence:
                quiet = True
                out.append((key[0], round((last + silence) * 1e6), "silence", float(n)))

        def report(k: int, kind: str, at: float, value: float) -> None:
            if at - told[k] >= cooldown:
                told[k] = at
                out.append((key[0], round(at * 1e6), kind, round(value, 6)))

        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() / 1000
            silent(now)
            if now >= last + forget:
                state.remove()
            else:
                state.update((n, last, mean, var, seen, *told, quiet))
                _later(state, last + forget)
        else:
            for us, technique in _in_order(batches)[["_us", "technique"]].itertuples(index=False):
                at = us / 1e6
                silent(at)
                rate = 1.0 / max(at - last, 1e-3) if n else 0.0
                if n >= warm:
                    if mean > 0 and rate > spike * mean:
                        report(0, "rate_spike", at, rate / mean)
                    if var > 0 and abs(rate - mean) > deviations * math.sqrt(var):
                        report(1, "deviation", at, (rate - mean) / math.sqrt(var))
                    if technique is not None and technique != "unknown" and technique not in seen:
                        report(2, "novelty", at, float(n))
                if n == 1:
                    mean = rate
                elif n > 1:
                    step = rate - mean
                    mean, var = mean + alpha * step, (1 - alpha) * (var + alpha * step * step)
                if technique is not None and technique not in seen:
                    seen.append(technique)
                n, last, quiet = n + 1, max(last, at) if n else at, False
            if n:
                state.update((n, last, mean, var, seen, *told, quiet))
                _later(state, last + (silence + 0.001 if n >= warm else forget))
        yield pd.DataFrame(out, columns=["source", "us", "kind", "value"]).astype({"kind": "object"})

    found = _timed(events).groupBy("source").applyInPandasWithState(update, "source string, us long, kind string, value double", TRIAGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("source", F.timestamp_micros("us").alias("ts"), "kind", "value")
