import os
import time

import numpy as np
import pytest

import prequenta as q
from prequenta.sources.text import stream_lines
from prequenta.sources.topic import message_lines
from prequenta.streaming import prequential
from prequenta.streaming.prequential import TestThenTrain
from replica import as_lines, counts, descend, sample

ONLINE = dict(iterations=50, step=0.1, reg=0.0, tol=0.001)
WARM = q.Model.of("pretrained", [0.4, 0.9, 0.1])
COLD = q.cold_model(n_features=3)


def put(folder, name, lines):
    """One file per micro-batch, in an order the file source cannot mistake."""
    path = os.path.join(folder, name)
    hidden = os.path.join(folder, f".{name}")
    with open(hidden, "w") as f:
        f.writelines(line + "\n" for line in lines)
    stamp = time.time() - 10_000 + int(name) * 10
    os.utime(hidden, (stamp, stamp))
    os.rename(hidden, path)


def stream(spark, incoming, run, models=(WARM, COLD), **options):
    source = stream_lines(spark, str(incoming), 1)
    q.run_prequential(source, models, run, n_features=3, available_now=True, **options).awaitTermination(300)


def as_dict(spark, run):
    got = {}
    for r in q.read_counts(spark, run).collect():
        got.setdefault((r["batch_id"], r["model"]), {})[r["predicted"], r["actual"]] = r["n"]
    return got


def replay(batches, train=True):
    """Counts per batch and the weights after each, test before train."""
    expected, weights, after = {}, {"pretrained": WARM.weights, "cold": COLD.weights}, []
    for b, (x, y) in enumerate(batches):
        for name, w in weights.items():
            expected[b, name] = counts(x, y, w)
        if train:
            weights = {name: descend(x, y, w, **ONLINE) for name, w in weights.items()}
        after.append(dict(weights))
    return expected, after


@pytest.fixture(scope="module")
def batches():
    rng = np.random.default_rng(11)
    return [sample(rng, n) for n in (60, 1, 40, 80)]


@pytest.fixture
def incoming(tmp_path, batches):
    folder = tmp_path / "incoming"
    folder.mkdir()
    for b, (x, y) in enumerate(batches):
        put(folder, str(b), as_lines(x, y))
    return folder


def test_every_batch_is_tested_before_it_trains(spark, tmp_path, incoming, batches):
    run = q.open_run(spark, f"{tmp_path}/out")
    stream(spark, incoming, run)
    expected, after = replay(batches)
    assert as_dict(spark, run) == expected
    assert expected[0, "cold"].keys() == {(0, 0), (0, 1)}
    for b, weights in enumerate(after):
        stored = q.load_models(spark, f"{run.models}/era=0", before=b + 1)
        for name, w in weights.items():
            assert np.allclose(stored[name].weights, w, atol=1e-9) and stored[name].version == b


def test_fixed_models(spark, tmp_path, incoming, batches):
    run = q.open_run(spark, f"{tmp_path}/out")
    stream(spark, incoming, run, train=False)
    assert as_dict(spark, run) == replay(batches, train=False)[0]
    assert not os.path.exists(run.models)


def test_restart_continues_and_reset_starts_over(spark, tmp_path, incoming, batches):
    out = f"{tmp_path}/out"
    run = q.open_run(spark, out)
    stream(spark, incoming, run)
    rng = np.random.default_rng(12)
    more = sample(rng, 30)
    put(incoming, "5", as_lines(*more))
    assert q.open_run(spark, out) == run
    stream(spark, incoming, run)
    assert as_dict(spark, run) == replay([*batches, more])[0]

    fresh = q.open_run(spark, out, reset=True)
    assert fresh != run and q.open_run(spark, out) == fresh
    assert as_dict(spark, fresh) == {}
    assert as_dict(spark, run) == replay([*batches, more])[0]


def test_replayed_batch_replaces_itself(spark, tmp_path, batches):
    run = q.open_run(spark, f"{tmp_path}/out")
    frames = [spark.createDataFrame([(line,) for line in as_lines(x, y)], "value string") for x, y in batches[:3]]
    work = TestThenTrain(run, [WARM, COLD], n_features=3)
    for b, frame in enumerate(frames):
        work(frame, b)
    counted, models = as_dict(spark, run), q.load_models(spark, f"{run.models}/era=0")
    work(frames[2], 2)
    assert as_dict(spark, run) == counted and q.load_models(spark, f"{run.models}/era=0") == models
    restarted = TestThenTrain(run, [WARM, COLD], n_features=3)
    restarted(frames[2], 2)
    assert as_dict(spark, run) == counted and q.load_models(spark, f"{run.models}/era=0") == models


def test_crash_between_counts_and_models(spark, tmp_path, incoming, batches, monkeypatch):
    import prequenta.streaming.prequential as streaming

    run = q.open_run(spark, f"{tmp_path}/out")
    save, calls = streaming.save_models, []

    def fail_once(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return save(*args, **kwargs)

    monkeypatch.setattr(streaming, "save_models", fail_once)
    with pytest.raises(Exception, match="lost"):
        stream(spark, incoming, run)
    stream(spark, incoming, run)
    assert as_dict(spark, run) == replay(batches)[0]


def test_state_is_found_across_eras(spark, tmp_path, batches):
    run = q.open_run(spark, f"{tmp_path}/out")
    x, y = batches[0]
    frame = spark.createDataFrame([(line,) for line in as_lines(x, y)], "value string")
    TestThenTrain(run, [WARM], n_features=3)(frame, 998)
    before = TestThenTrain(run, [WARM], n_features=3).models_before(spark, 2500)
    assert before["pretrained"].version == 998
    assert TestThenTrain(run, [WARM], n_features=3).models_before(spark, 998) == {"pretrained": WARM}


def test_empty_batch_leaves_no_trace(spark, tmp_path, batches):
    folder = tmp_path / "incoming"
    folder.mkdir()
    put(folder, "0", as_lines(*batches[0]))
    put(folder, "1", [])
    put(folder, "2", as_lines(*batches[2]))
    run = q.open_run(spark, f"{tmp_path}/out")
    stream(spark, folder, run)
    first, third = batches[0], batches[2]
    expected, _ = replay([first, third])
    got = as_dict(spark, run)
    assert [v for _, v in sorted(got.items())] == [v for _, v in sorted(expected.items())]
    versions = {r["version"] for r in spark.read.parquet(f"{run.models}/era=0").collect()}
    assert len(versions) == 2


@pytest.mark.parametrize("bad", ["1,0,1,0", "1,x,1,1"])
def test_bad_line_stops_the_stream(spark, tmp_path, bad):
    folder = tmp_path / "incoming"
    folder.mkdir()
    put(folder, "0", ["1,0,1,1", bad])
    run = q.open_run(spark, f"{tmp_path}/out")
    with pytest.raises(Exception, match="neither -1 nor 1|no integer"):
        stream(spark, folder, run)
    assert as_dict(spark, run) == {}


def test_processing_time_trigger(spark, tmp_path, incoming, batches):
    run = q.open_run(spark, f"{tmp_path}/out")
    query = q.run_prequential(
        stream_lines(spark, str(incoming), 1), [COLD], run, n_features=3, train=False, interval="1 second"
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {b for b, _ in as_dict(spark, run)} == {0, 1, 2, 3}


def test_message_body_becomes_the_line(spark):
    messages = spark.createDataFrame([(b"k", b"1,2,1"), (None, "é,1".encode())], "key binary, value binary")
    assert [r["value"] for r in message_lines(messages).collect()] == ["1,2,1", "é,1"]


def test_stored_models_are_looked_up_once_without_training(tmp_path, lines, monkeypatch):
    calls = []
    monkeypatch.setattr(prequential, "load_models", lambda *a, **k: calls.append(a) or {})
    work = TestThenTrain(
        prequential.Run(f"{tmp_path}/run"), [q.cold_model(n_features=3)], train=False, n_features=3
    )
    for batch in (5000, 5001, 5002):
        work(lines("1,0,1,1"), batch)
    assert len(calls) == 6  # one per era, once


def test_eras_are_closed_while_the_stream_goes_on(spark, tmp_path, incoming, batches):
    run = q.open_run(spark, f"{tmp_path}/out", batches_per_era=2)
    stream(spark, incoming, run)
    assert as_dict(spark, run) == replay(batches)[0] and sorted(run.count_table.closed(spark)) == [0]
    again = q.open_run(spark, f"{tmp_path}/out", batches_per_era=99)
    assert again == run and again.batches_per_era == 2  # a run keeps its own
    put(incoming, "5", as_lines(*batches[2]))
    stream(spark, incoming, again)
    assert as_dict(spark, run) == replay([*batches, batches[2]])[0] and sorted(run.count_table.closed(spark)) == [0, 1]
    whole = {(r["model"], r["predicted"], r["actual"]): r["n"] for r in q.read_totals(spark, run).collect()}
    sums = {}
    for (_, m), cells in replay([*batches, batches[2]])[0].items():
        for (p, a), n in cells.items():
            sums[m, p, a] = sums.get((m, p, a), 0) + n
    assert whole == sums
    points = q.newest_points(spark, run, 2).collect()
    assert {(r["model"], r["batch_id"]) for r in points} == {(m, b) for m in ("cold", "pretrained") for b in (3, 4)}


def test_crash_while_an_era_is_closed(spark, tmp_path, incoming, batches, monkeypatch):
    from prequenta.sources import counts as counts_module

    run = q.open_run(spark, f"{tmp_path}/out", batches_per_era=1)
    create, calls = counts_module.create_marker, []

    def fail_once(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return create(*args)

    monkeypatch.setattr(counts_module, "create_marker", fail_once)
    with pytest.raises(Exception, match="lost"):
        stream(spark, incoming, run)
    stream(spark, incoming, run)
    assert as_dict(spark, run) == replay(batches)[0] and sorted(run.count_table.closed(spark)) == [0, 1, 2]


def test_commit_times_of_a_clock(spark, tmp_path, incoming):
    from datetime import datetime

    run = q.open_run(spark, f"{tmp_path}/out")
    stream(spark, incoming, run, train=False, clock=lambda batch: datetime(2024, 1, 1 + batch))
    times = {(r["batch_id"], r["at"].day) for r in q.read_counts(spark, run, times=True).collect()}
    assert times == {(b, b + 1) for b in range(4)}


def rejected(spark, run):
    return sorted((r["batch_id"], r["line"], r["reject_reason"]) for r in q.read_rejects(spark, run).collect())


def test_rejects_are_kept_and_the_stream_goes_on(spark, tmp_path, batches):
    folder = tmp_path / "incoming"
    folder.mkdir()
    put(folder, "0", [*as_lines(*batches[0]), "1,x,1,1", "1,0"])
    put(folder, "1", ["", "1,0,1,0"])  # nothing but rejects
    put(folder, "2", as_lines(*batches[2]))
    run = q.open_run(spark, f"{tmp_path}/out")
    assert rejected(spark, run) == []
    stream(spark, folder, run, mode="permissive")
    want = replay([batches[0], batches[2]])[0]
    got = as_dict(spark, run)
    assert {b for b, _ in got} == {0, 2}
    assert [v for _, v in sorted(got.items())] == [v for _, v in sorted(want.items())]
    assert rejected(spark, run) == [
        (0, "1,0", "cells in line: 2"),
        (0, "1,x,1,1", "a cell is no integer"),
        (1, "", "cells in line: 1"),
        (1, "1,0,1,0", "label is neither -1 nor 1: 0"),
    ]
    versions = {r["version"] for r in spark.read.parquet(f"{run.models}/era=0").collect()}
    assert versions == {0, 2}


@pytest.mark.parametrize("place", ["write_rejects", "save_models"])
def test_replayed_rejects_replace_themselves(spark, tmp_path, batches, monkeypatch, place):
    folder = tmp_path / "incoming"
    folder.mkdir()
    for b in range(2):
        put(folder, str(b), [*as_lines(*batches[b]), f"bad {b}"])
    run = q.open_run(spark, f"{tmp_path}/out")
    whole, calls = getattr(prequential, place), []

    def fail_after(*args, **kwargs):
        done = whole(*args, **kwargs)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return done

    monkeypatch.setattr(prequential, place, fail_after)
    with pytest.raises(Exception, match="lost"):
        stream(spark, folder, run, mode="permissive")
    stream(spark, folder, run, mode="permissive")
    assert as_dict(spark, run) == replay(batches[:2])[0]
    assert [(b, line) for b, line, _ in rejected(spark, run)] == [(0, "bad 0"), (1, "bad 1")]


def test_a_batch_that_runs_again_without_rejects_leaves_none(spark, tmp_path, lines):
    run = q.open_run(spark, f"{tmp_path}/out")
    work = TestThenTrain(run, [COLD], n_features=3, mode="permissive", train=False)
    work(lines("1,0,1,1", "bad"), 0)
    assert len(rejected(spark, run)) == 1
    work(lines("1,0,1,1"), 0)
    assert rejected(spark, run) == []


def test_progress_of_every_batch(spark, tmp_path, incoming, batches):
    run = q.open_run(spark, f"{tmp_path}/out")
    assert q.read_progress(spark, run).count() == 0
    stream(spark, incoming, run, train=False, progress=True)
    got = {r["batch_id"]: r for r in q.read_progress(spark, run).collect()}
    assert {b: r["input_rows"] for b, r in got.items()} == {b: len(y) for b, (_, y) in enumerate(batches)}
    assert all(r["duration_ms"] > 0 and r["started"] is not None for r in got.values())
    # A second query goes on in the same table, and a query without the option adds nothing.
    put(incoming, "5", as_lines(*batches[0]))
    stream(spark, incoming, run, train=False, progress=True)
    put(incoming, "6", as_lines(*batches[0]))
    stream(spark, incoming, run, train=False)
    assert {r["batch_id"] for r in q.read_progress(spark, run).collect()} == {0, 1, 2, 3, 4}


def test_intercept_is_learned_from_batch_to_batch(spark, tmp_path, incoming, batches):
    warm = q.Model.of("pretrained", [0.4, 0.9, 0.1], 0.5)
    run = q.open_run(spark, f"{tmp_path}/out")
    stream(spark, incoming, run, models=(warm, COLD))
    w, expected = [*warm.weights, warm.intercept], {}
    for b, (x, y) in enumerate(batches):
        ones = np.c_[x, np.ones(len(x))]
        expected[b] = counts(ones, y, w)
        w = descend(ones, y, w, **ONLINE)
    got = as_dict(spark, run)
    assert {b: got[b, "pretrained"] for b in expected} == expected
    assert {k: v for k, v in got.items() if k[1] == "cold"} == {k: v for k, v in replay(batches)[0].items() if k[1] == "cold"}
    last = q.load_models(spark, f"{run.models}/era=0")["pretrained"]
    assert np.allclose([*last.weights, last.intercept], w, atol=1e-9)
