"""The table of counts: closed eras, replays, crashes and what a report has to read."""

import os
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest

import prequenta as q
from prequenta.sources import counts as counts_module
from prequenta.sources.counts import CountTable

MODELS = ("pretrained", "cold")


def batch_rows(batch, seed=0):
    rng = random.Random(batch * 7 + seed)
    return [(m, p, a, rng.randint(1, 9)) for m in MODELS for p in (0, 1) for a in (0, 1) if rng.random() < 0.8]


def frame(spark, rows):
    return spark.createDataFrame(rows, "model string, predicted int, actual int, n bigint")


def fill(spark, table, batches):
    rows = [(b, *r) for b in batches for r in batch_rows(b)]
    table.write_batches(spark.createDataFrame(rows, "batch_id bigint, model string, predicted int, actual int, n bigint"))


def stored(spark, table):
    return Counter((r["batch_id"], r["model"], r["predicted"], r["actual"], r["n"]) for r in table.read(spark).collect())


def expected(batches):
    return Counter((b, *r) for b in batches for r in batch_rows(b))


def totals_of(rows):
    out = Counter()
    for (_, m, p, a, n), times in rows.items():
        out[m, p, a] += n * times
    return out


def totals(spark, table):
    return Counter({(r["model"], r["predicted"], r["actual"]): r["n"] for r in table.totals(spark).collect()})


@pytest.fixture
def table(tmp_path):
    return CountTable(f"{tmp_path}/counts", batches_per_era=4)


def folders(table):
    return sorted(n for n in os.listdir(table.path) if n.startswith("era="))


def test_no_table_yet(spark, table):
    assert table.read(spark).count() == 0 and table.totals(spark).count() == 0
    counts, before = table.newest(spark, 5)
    assert counts.count() == 0 and before.count() == 0
    assert table.close_before(spark, 100) == -1


def test_closing_changes_no_count(spark, table):
    batches = [b for b in range(15) if b not in (5, 6)]  # empty batches leave nothing
    fill(spark, table, batches)
    before = stored(spark, table)
    assert before == expected(batches)
    assert table.close_before(spark, 14) == 2
    assert stored(spark, table) == before and totals(spark, table) == totals_of(before)
    assert folders(table) == ["era=2", "era=3"]  # the last closed one stays for readers that have listed it
    assert table.close_before(spark, 14) == 2 and sorted(table.closed(spark)) == [0, 1, 2]
    for folder in table.closed(spark).values():
        assert len([f for f in os.listdir(f"{folder}/batches") if f.endswith(".parquet")]) == 1


def test_an_era_without_batches(spark, table):
    fill(spark, table, [0, 1, 13])
    assert table.close_before(spark, 16) == 3
    assert stored(spark, table) == expected([0, 1, 13]) and sorted(table.closed(spark)) == [0, 3]


def test_replayed_batch_before_and_after_its_era_is_closed(spark, table):
    fill(spark, table, range(5))
    table.write(frame(spark, batch_rows(3)), 3)
    assert stored(spark, table) == expected(range(5))
    table.close_before(spark, 4)
    # A driver that was thought dead writes a batch of the closed era again, and one that never was.
    table.write(frame(spark, batch_rows(3)), 3)
    table.write(frame(spark, batch_rows(2, seed=1)), 2)
    assert stored(spark, table) == expected(range(5)) and totals(spark, table) == totals_of(expected(range(5)))
    fill(spark, table, range(5, 9))
    table.close_before(spark, 8)
    assert stored(spark, table) == expected(range(9))


def test_crash_between_rewrite_and_commit(spark, table, monkeypatch):
    fill(spark, table, range(9))
    monkeypatch.setattr(counts_module, "create_marker", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.close_before(spark, 8)
    assert os.path.exists(f"{table.path}-closed/era=0")  # written, and nothing refers to it
    assert stored(spark, table) == expected(range(9)) and folders(table) == ["era=0", "era=1", "era=2"]
    monkeypatch.undo()
    assert table.close_before(spark, 8) == 1
    assert stored(spark, table) == expected(range(9)) and totals(spark, table) == totals_of(expected(range(9)))


def test_crash_between_commit_and_removal(spark, table, monkeypatch):
    fill(spark, table, range(9))
    with monkeypatch.context() as m:
        m.setattr(counts_module, "drop_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        assert table.close(spark, 0)
        with pytest.raises(RuntimeError, match="lost"):
            table.close(spark, 1)
    assert stored(spark, table) == expected(range(9))
    fill(spark, table, range(9, 13))
    assert table.close_before(spark, 12) == 2 and folders(table) == ["era=2", "era=3"]
    assert stored(spark, table) == expected(range(13))


def test_two_drivers_close_the_same_era(spark, table, monkeypatch):
    fill(spark, table, range(5))
    commit = counts_module.create_marker

    def other_first(session, path):
        monkeypatch.setattr(counts_module, "create_marker", commit)
        assert table.close(session, 0)
        commit(session, path)

    monkeypatch.setattr(counts_module, "create_marker", other_first)
    assert table.close(spark, 0)
    assert len(os.listdir(f"{table.path}-closed/era=0")) == 2
    assert stored(spark, table) == expected(range(5)) and totals(spark, table) == totals_of(expected(range(5)))


@pytest.mark.parametrize("when", ["listed first", "listed last"])
def test_a_batch_that_is_being_replaced_is_not_lost(spark, table, monkeypatch, when):
    """A listing that misses a batch, before or after the rewrite, publishes nothing."""
    fill(spark, table, range(5))
    whole, calls = CountTable._batches_of, []

    def listed(self, session, era):
        calls.append(era)
        found = whole(self, session, era)
        return found - {2} if len(calls) == (1 if when == "listed first" else 2) else found

    monkeypatch.setattr(CountTable, "_batches_of", listed)
    assert not table.close(spark, 0)
    assert table.closed(spark) == {} and os.listdir(f"{table.path}-closed/era=0") == []
    monkeypatch.undo()
    assert table.close_before(spark, 4) == 0 and stored(spark, table) == expected(range(5))


@pytest.mark.parametrize("n", [1, 3, 6, 50])
@pytest.mark.parametrize("closed", [True, False])
def test_newest_points_equal_those_of_the_whole_history(spark, table, n, closed):
    fill(spark, table, range(19))
    if closed:
        table.close_before(spark, 18)
    want = sorted(map(tuple, q.last_points(q.running_accuracy(table.read(spark).drop("at")), n).collect()))
    counts, before = table.newest(spark, n)
    got = q.last_points(q.running_accuracy(counts.drop("at"), before=before), n)
    assert [(s, m, b, round(a, 12)) for s, m, b, a in want] == sorted((s, m, b, round(a, 12)) for s, m, b, a in map(tuple, got.collect()))


def test_newest_reads_only_the_eras_it_needs(spark, table):
    fill(spark, table, range(19))
    table.close_before(spark, 18)
    counts, before = table.newest(spark, 5)
    assert {int(e) for f in counts.inputFiles() for e in re.findall("era=([0-9]+)", f)} == {3, 4}
    assert [re.findall("era=([0-9]+)/attempt=[^/]+/([a-z]+)/", f)[0] for f in before.inputFiles()] == [("2", "totals")]


def test_a_model_that_stopped_takes_the_walk_back(spark, table):
    fill(spark, table, range(12))
    old = [(b, "gone", 1, 1, 2) for b in (0, 1)]
    rows = [(b, *r) for b in (0, 1) for r in batch_rows(b)] + old
    table.write_batches(spark.createDataFrame(rows, "batch_id bigint, model string, predicted int, actual int, n bigint"))
    table.close_before(spark, 11)
    counts, before = table.newest(spark, 2)
    points = q.last_points(q.running_accuracy(counts.drop("at"), before=before), 2)
    assert {r["batch_id"] for r in points.where("model = 'gone'").collect()} == {0, 1}


START = datetime(2024, 1, 1)


def minutes(x):
    return START + timedelta(minutes=x)


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_as_of_equals_brute_force(spark, block):
    rng = random.Random(3)
    points = [(b, m, rng.random(), minutes(rng.choice([-30, -5, 0, 1, 10, 10, 25, 47, 60, 61, 600]) + b)) for m in MODELS for b in range(9)]
    points += [(99, "late", 0.5, minutes(24))] + [(7, "untimed", 0.1, None)]
    series = spark.createDataFrame(points, "batch_id bigint, model string, accuracy double, at timestamp")
    got = {(r["tick"], r["model"]): (r["at"], r["batch_id"], r["accuracy"]) for r in q.as_of(series, START, timedelta(minutes=12), 8, block).collect()}
    for model in (*MODELS, "late", "untimed"):
        for tick in range(8):
            now = minutes(12 * tick)
            seen = [(at, b, a) for b, m, a, at in points if m == model and at is not None and at <= now]
            want = max(seen)[1:] if seen else (None, None)
            assert got.pop((tick, model)) == (now, *want)
    assert not got


def test_as_of_needs_a_grid(spark):
    series = spark.createDataFrame([], "batch_id bigint, model string, accuracy double, at timestamp")
    assert q.as_of(series, START, timedelta(1), 3).count() == 0
    for step, n in ((timedelta(0), 3), (timedelta(1), 0)):
        with pytest.raises(ValueError, match="grid"):
            q.as_of(series, START, step, n)


def test_commit_times_pass_into_the_series(spark, table):
    for b in range(3):
        table.write(frame(spark, batch_rows(b)), b, minutes(b))
    table.close_before(spark, 4)
    series = q.running_accuracy(table.read(spark))
    assert {(r["batch_id"], r["at"]) for r in series.collect()} == {(b, minutes(b)) for b in range(3)}
