import datetime as dt
import random

import pytest

from docfathom.operators import jobs as job_ops
from docfathom.schemas import CORRUPT, INGEST_REQUEST
from docfathom.sources import messages

START = dt.datetime(2024, 1, 1)


def greedy(times, window):
    taken = []
    for at in sorted(times):
        if not taken or at >= taken[-1] + window:
            taken.append(at)
    return taken


def job_frame(spark, rows):
    return spark.createDataFrame(rows, "document_id string, ts timestamp")


def accepted(df):
    return sorted((r.document_id, r.ts) for r in df.collect())


def test_dedup_by_hand(spark):
    minutes = [0, 1, 4, 6, 7, 11]
    rows = [("d", START + dt.timedelta(minutes=m)) for m in minutes] + [("e", START)]
    kept = accepted(job_ops.dedup_jobs(job_frame(spark, rows)))
    assert kept == [("d", START + dt.timedelta(minutes=m)) for m in (0, 6, 11)] + [("e", START)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_ids_in_pieces_equal_step_by_step(spark, seed):
    rng = random.Random(seed)
    window = dt.timedelta(seconds=10)
    rows = []
    # Dense, sparse and bursty ids; pieces are 240 seconds long.
    for name, n, span in (("dense", 900, 2000), ("sparse", 60, 6000), ("few", 5, 9000)):
        rows += [(name, START + dt.timedelta(milliseconds=rng.randrange(span * 1000))) for _ in range(n)]
    rows += [("grid", START + dt.timedelta(seconds=s)) for s in range(700)]
    for burst in range(8):
        first = rng.randrange(5000)
        rows += [("burst", START + dt.timedelta(seconds=first + s / 3)) for s in range(60)]
    rows += rows[::5]
    want = []
    for name in sorted({r[0] for r in rows}):
        want += [(name, at) for at in greedy([r[1] for r in rows if r[0] == name], window)]
    frame = job_frame(spark, rows)
    assert accepted(job_ops.dedup_jobs(frame, window="10 seconds")) == want
    assert accepted(job_ops.dedup_jobs(frame, window="10 seconds", hot_jobs=50)) == want
    assert accepted(job_ops.dedup_jobs(frame, window="10 seconds", hot_jobs=1)) == want


def test_fifo_positions(spark):
    rng = random.Random(4)
    rows = [
        (n, "ab"[n % 3 == 0], START + dt.timedelta(minutes=rng.randrange(600))) for n in range(200)
    ]
    frame = spark.createDataFrame(rows, "event_id long, tenant_id string, ts timestamp")
    got = {r.event_id: r.position for r in job_ops.tenant_fifo(frame).collect()}
    for tenant in "ab":
        order = sorted((at, n) for n, t, at in rows if t == tenant)
        assert [got[n] for _, n in order] == list(range(1, len(order) + 1))


def test_bad_messages_are_kept(spark, tmp_path):
    bodies = ['{"document_id":"1","tenant_id":"a"}', '{"document_id":"2","ten', "", "[1,2]"]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    parsed = {r.body: r for r in messages.parse_jobs(frame, "body").collect()}
    assert parsed[bodies[0]].is_valid and parsed[bodies[0]].tenant_id == "a"
    assert not parsed[bodies[1]].is_valid
    (tmp_path / "in.json").write_text(
        '{"document_id":"1","text":"x","metadata":{"a":"\\"q\\""}}\n{"document_id":"2","te\n'
    )
    rows = messages.read_messages(spark, str(tmp_path), INGEST_REQUEST).collect()
    assert [r.metadata for r in rows if r[CORRUPT] is None] == [{"a": '"q"'}]
    assert [r[CORRUPT] for r in rows if r[CORRUPT]] == ['{"document_id":"2","te']


def test_emitted_jobs_can_be_parsed(spark, tmp_path):
    frame = spark.createDataFrame([("1", "a"), ('q"2', "b")], "document_id string, tenant_id string")
    emitted = messages.emit_jobs(frame)
    parsed = messages.parse_jobs(emitted, "message")
    assert {(r.document_id, r.tenant_id, r.is_valid) for r in parsed.collect()} == {
        ("1", "a", True), ('q"2', "b", True),
    }
    assert {r.dedup_id for r in emitted.collect()} == {"1", 'q"2'}
    for _ in range(2):
        messages.write_jobs(frame, str(tmp_path / "jobs"))
    assert spark.read.json(str(tmp_path / "jobs")).count() == 2


def test_a_window_has_to_have_a_length(spark):
    with pytest.raises(ValueError):
        job_ops.dedup_jobs(spark.createDataFrame([], "document_id string, ts timestamp"), window="0 seconds")
