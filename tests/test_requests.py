"""Lives and rates of requests against a replay in order, with one hot key, ties and pauses; and against the streams."""

import datetime as dt
import random
from collections import deque

import pytest

import __spark_entry__ as entry
from tomeflow.operators import requests as rq

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def log(seed, n):
    """Nearly all requests are of one key, some at the same time, some after long pauses; some rows are repeated or lack a key."""
    rng, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0, 0, 0.5, 1, 3, 3, 10, 10, 59.5, 60, 61, 400])
        rows.append((rng.choice(["hot"] * 9 + ["cold"]), rng.randrange(10**6), START + dt.timedelta(seconds=at)))
    return [*rows, *rows[:5], (None, 1, START), ("hot", 2, None)]


def ordered(rows):
    keyed = {}
    for key, id_, ts in {r for r in rows if r[0] is not None and r[2] is not None}:
        keyed.setdefault(key, []).append((round((ts - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds() * 1e6), id_))
    return {k: sorted(v) for k, v in keyed.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, ts timestamp")


@pytest.mark.parametrize("seconds", [10, 60, 200])
def test_lives_as_replayed(spark, seconds):
    rows, want = log(seconds, 400), []
    for key, asked in ordered(rows).items():
        last = None
        for us, id_ in asked:
            miss = last is None or us >= last + seconds * 1_000_000
            last = us if miss else last
            want.append((key, id_, us, "miss" if miss else "hit"))
    assert sorted(map(tuple, rq.first_in_life(table(spark, rows), seconds).collect())) == sorted(want)


@pytest.mark.parametrize(("limit", "seconds"), [(1, 10), (3, 60), (5, 30)])
def test_rates_as_replayed(spark, limit, seconds):
    rows, want = log(limit, 400), []
    for key, asked in ordered(rows).items():
        times = deque()
        for us, id_ in asked:
            while times and times[0] <= us - seconds * 1_000_000:
                times.popleft()
            ok = len(times) < limit
            if ok:
                times.append(us)
            want.append((key, id_, us, "accepted" if ok else "rejected", limit - len(times)))
    assert sorted(map(tuple, rq.rate_verdicts(table(spark, rows), limit, seconds).collect())) == sorted(want)


def test_a_key_without_a_pause_is_one_chain(spark):
    rows = [("hot", i, START + dt.timedelta(seconds=i)) for i in range(3000)]
    got = rq.first_in_life(table(spark, rows), 7).where("verdict = 'miss'").orderBy("id").collect()
    assert [r.id for r in got] == list(range(0, 3000, 7))


def test_no_requests(spark):
    assert rq.first_in_life(table(spark, []), 5).count() == 0 and rq.rate_verdicts(table(spark, []), 1, 5).count() == 0


@pytest.mark.parametrize(("batch", "stream"), [("first_in_life", "streamed_first_in_ttl"), ("rate_verdicts", "streamed_rate_limit")])
def test_batch_is_the_stream(spark, batch, stream):
    run = lambda name: entry.queries()[name](spark, "/root/testdata/sf0.001").select("key", "id", "us", "verdict")
    a, b = sorted(map(tuple, run(batch).collect())), sorted(map(tuple, run(stream).collect()))
    assert [r for r in a if r[3] != "hit"] == b
