"""Token buckets against a plain run, wherever the cuts fall."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st

from docketry.operators import throttle as TH

LIMITS = {"create": (2, 5), "get": (10, 20)}
START = dt.datetime(2024, 1, 1)


def plain(rows, limits):
    """(event_id, route, us) to the throttled ids."""
    state, out = {}, set()
    for event, route, us in sorted(rows, key=lambda r: (r[2], r[0])):
        rate, burst = limits[route]
        tokens, last = state.get(route, (burst * TH.TOKEN, us))
        tokens = min(burst * TH.TOKEN, tokens + rate * (us - last))
        if tokens >= TH.TOKEN:
            tokens -= TH.TOKEN
        else:
            out.add(event)
        state[route] = tokens, us
    return out


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.integers(0, 900_000), min_size=1, max_size=40), st.integers(1, 12), st.integers(1, 6), st.integers(1, 5),
    st.lists(st.integers(0, 6_000_000), min_size=1, max_size=5),
)
def test_functions_compose(gaps, rate, burst, cuts, starts):
    """Any cut of a run of requests gives the function of the whole run."""
    full, us = burst * TH.TOKEN, []
    for g in gaps:
        us.append((us[-1] if us else 0) + g)
    whole = TH._effect(us, rate, full)
    size = -(-len(us) // cuts)
    parts = [us[k : k + size] for k in range(0, len(us), size)]
    joined = TH._effect(parts[0], rate, full)
    for before, part in zip(parts, parts[1:]):
        joined.refill(rate * (part[0] - before[-1]))
        joined = joined.then(TH._effect(part, rate, full))
    for x in {*(s % (full + 1) for s in starts), 0, full, *whole.starts, *(s - 1 for s in whole.starts[1:])}:
        _, left = TH._judge(x, us[0], us, rate, full)
        assert whole.at(x) == joined.at(x) == left


@pytest.mark.parametrize("route", list(LIMITS))
@pytest.mark.parametrize("load", [0.5, 0.95, 1.0, 1.05, 3.0])
def test_functions_stay_short(route, load):
    """Below, at and above the limit, a function has a few pieces for each token of the burst."""
    rng, (rate, burst) = random.Random(load), LIMITS[route]
    effect, most = TH.Effect(burst * TH.TOKEN), 0
    for _ in range(3000):
        effect.refill(rate * int(rng.expovariate(rate * load) * TH.TOKEN))
        effect.take()
        most = max(most, len(effect.starts))
    assert most <= 3 * burst + 6


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_hot_route_over_many_partitions(spark, parts, monkeypatch):
    monkeypatch.setattr(TH, "FAN_OUT", 3)
    rng, rows = random.Random(parts), []
    for event in range(3000):
        route = "create" if rng.random() < 0.7 else "get"
        rows.append((event, route, int(rng.random() ** 2 * 900_000_000) // (1 if event % 3 else 1_000_000) * (1 if event % 3 else 1_000_000)))
    table = [(e, r, START + dt.timedelta(microseconds=us), "x") for e, r, us in rows]
    table += [(5000, None, START, "x"), (5001, "other", START, "x"), (5002, "get", None, "x")]
    df = spark.createDataFrame(table, "event_id long, route string, ts timestamp, row string").repartition(5)
    out = TH.throttle(df, LIMITS, parts=parts)
    assert out.columns == [*df.columns, "throttled"]
    got = out.collect()
    assert len(got) == len(table)
    assert {r.event_id for r in got if r.throttled} == plain(rows, LIMITS)


def test_empty_log(spark):
    df = spark.createDataFrame([], "event_id long, route string, ts timestamp")
    assert TH.throttle(df, LIMITS).count() == 0
