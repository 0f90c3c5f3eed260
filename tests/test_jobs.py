"""Jobs as a stateful stream: attempts, timers, and a restart from the checkpoint."""

import json
import os

from lodestone.streaming import jobs


def write(path, number, events):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"content_hash": h, "kind": k, "result": r, "at": f"2024-01-01T{t}.000Z"} | ({} if h else {"content_hash": None})) for h, k, r, t in events]
    file = path / f"{number:03d}.json"
    file.write_text("\n".join(lines))
    os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))  # files are taken in order of their time


BATCHES = [
    [("a", "submitted", None, "00:00:00"), ("b", "submitted", None, "00:00:01"), ("c", "submitted", None, "00:00:02"), ("a", "result", "ok", "00:01:00"), (None, "submitted", None, "00:00:03"), ("x", "result", "ok", "00:00:05")],
    [("a", "submitted", None, "00:02:00"), ("b", "result", "MemoryError", "00:03:00"), ("b", "result", "ValueError", "00:04:00"), ("b", "submitted", None, "00:04:30"), ("g", "submitted", None, "00:04:00")],
    [("b", "result", "OSError", "00:05:00"), ("d", "submitted", None, "00:20:00"), ("g", "result", "ok", "00:15:00")],
    [("b", "submitted", None, "00:21:00"), ("d", "result", "ok", "00:22:00")],
    [("e", "submitted", None, "01:30:00")],
    [("f", "submitted", None, "01:31:00")],
]


def run(spark, path, out, checkpoint):
    own = jobs.with_rocks(spark)
    steps = jobs.job_steps(jobs.event_stream(own, str(path)))
    steps.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out)).awaitTermination(120)
    return sorted((r["content_hash"], str(r["at"])[11:], r["step"], r["status"], r["attempt"], r["reused"], r["error"]) for r in own.read.schema(jobs.STEPS).parquet(str(out)).collect())


def test_steps_and_restart(spark, tmp_path):
    for n, events in enumerate(BATCHES):
        write(tmp_path / "all", n, events)
    whole = run(spark, tmp_path / "all", tmp_path / "out", tmp_path / "check")
    of = lambda h: [r[2:] for r in whole if r[0] == h]
    assert of("a") == [("submitted", "queued", 0, False, None), ("result", "parsed", 1, False, None), ("submitted", "parsed", 1, True, None)]
    first = [("submitted", "queued", 0, False, None), ("result", "parsing", 1, False, "MemoryError"), ("result", "parsing", 2, False, "ValueError"), ("submitted", "parsing", 3, False, None), ("result", "failed", 3, False, "OSError")]
    assert of("b")[:5] == first and of("b")[5] == ("submitted", "queued", 0, False, None)
    late = [r for r in whole if r[0] == "c"]
    assert [r[2:5] for r in late][:2] == [("submitted", "queued", 0), ("result", "parsing", 1)] and late[1][1] == "00:10:02" and late[1][6] == "Timeout"
    assert [r[3] for r in late][-1] == "failed" and [r[4] for r in late] == [0, 1, 2, 3]
    assert of("g") == [("submitted", "queued", 0, False, None), ("result", "parsing", 1, False, "Timeout"), ("result", "parsed", 2, False, None)]
    assert of("d")[-1] == ("result", "parsed", 1, False, None) and of("x") == []

    for n, events in enumerate(BATCHES):  # the same files, a stream that is stopped and started again after each
        write(tmp_path / "parts", n, events)
        parts = run(spark, tmp_path / "parts", tmp_path / "out2", tmp_path / "check2")
    assert parts == whole
    assert run(spark, tmp_path / "parts", tmp_path / "out2", tmp_path / "check2") == whole
