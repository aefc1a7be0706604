"""Switches and seen keys over several runs from one checkpoint."""

import datetime as dt
import os
import random

import pytest

from quillgraph.streaming import keyed

START = dt.datetime(2024, 1, 1)
IDLE = dt.timedelta(minutes=10)
SCHEMA = "ts timestamp, who string, note int"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """A stream of a folder, and a function that puts rows there as a file."""
    folder, count = tmp_path / "in", iter(range(100))
    folder.mkdir()

    def put(*rows):
        k = next(count)
        spark.createDataFrame([(t, w, k) for t, w in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"made-{k}"))
        (part,) = (tmp_path / f"made-{k}").glob("part-*.parquet")
        part.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)

    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)), put


def uses(events, idle, until):
    """Runs of events that are over before `until`."""
    out = []
    for who in {w for _, w in events if w is not None}:
        run = []
        for t in [*sorted(t for t, w in events if w == who and t is not None), None]:
            if run and (t is None or t - run[-1] >= idle):
                if run[-1] + idle <= until:
                    out.append((who, run[0], run[-1] + idle, len(run), len(run) % 2 == 1))
                run = []
            run.append(t)
    return sorted(out)


def test_switches_over_two_runs(feed, tmp_path):
    stream, put = feed
    rows = keyed.idle_switches(stream, "who", IDLE, "5 minutes")
    first = [(at(0), "a"), (at(3), "a"), (at(20), "a"), (at(1), "b"), (None, "a"), (at(2), None), (at(30), "c")]
    put(*first)
    got = sorted(tuple(r) for r in keyed.run_into(rows, str(tmp_path), "switches").collect())
    assert got == uses(first, IDLE, at(25)) == [("a", at(0), at(13), 2, False), ("b", at(1), at(11), 1, True)]
    second = [(at(29), "a"), (at(39), "a"), (at(100), "c")]  # a's third use goes on: 29 is less than 10 after 20, 39 is not
    put(*second)
    got = sorted(tuple(r) for r in keyed.run_into(rows, str(tmp_path), "switches").collect())
    assert got == uses(first + second, IDLE, at(95))
    assert ("a", at(20), at(39), 2, False) in got and ("a", at(39), at(49), 1, True) in got and not any(r[0] == "c" and r[2] > at(95) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_switches_in_any_order(feed, tmp_path, seed):
    """Files whose events lie apart by less than the stream may be late."""
    stream, put = feed
    rng = random.Random(seed)
    events = [(at(rng.randint(0, 600) / 2), rng.choice("abcdef")) for _ in range(150)]
    events.sort(key=lambda e: e[0] + dt.timedelta(minutes=rng.randint(0, 30)))
    for k in range(0, 150, 40):
        put(*events[k:k + 40])
    got = keyed.run_into(keyed.idle_switches(stream, "who", IDLE, "60 minutes"), str(tmp_path), "switches")
    assert sorted(tuple(r) for r in got.collect()) == uses(events, IDLE, max(e[0] for e in events) - dt.timedelta(minutes=60))


def test_runs_merge():
    rng = random.Random(3)
    for _ in range(200):
        touches, runs = [rng.randint(0, 100) for _ in range(rng.randint(1, 30))], []
        for t in touches:
            keyed.added(runs, t, t, 1, 5)
        want = []
        for t in sorted(touches):
            if want and t - want[-1][1] < 5:
                want[-1] = (want[-1][0], t, want[-1][2] + 1)
            else:
                want.append((t, t, 1))
        assert runs == want


def test_seen_keys_expire(feed, tmp_path):
    stream, put = feed
    rows = keyed.seen_for(stream, "who", dt.timedelta(hours=1), "10 minutes")
    run = lambda: sorted(tuple(r) for r in keyed.run_into(rows, str(tmp_path), "seen").collect())
    put((at(5), "a"), (at(2), "a"), (at(40), "b"))
    assert run() == [("a", at(2)), ("b", at(40))]
    put((at(60), "a"), (at(76), "c"))  # the watermark is at 30, then at 66: a is forgotten at 62, b at 100
    assert run() == [("a", at(2)), ("b", at(40)), ("c", at(76))]
    put((at(80), "a"), (at(81), "b"))
    assert run() == [("a", at(2)), ("a", at(80)), ("b", at(40)), ("c", at(76))]


def test_provider_is_set_for_the_start_only(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    with keyed.rocks_state(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKS
    assert spark.conf.get(keyed.PROVIDER, None) == before
