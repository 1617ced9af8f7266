"""Line numbers, partial logs, streams that are stopped and go on, alarms on streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from granary.sources import jsonl, partial
from granary.sources.lines import numbered_lines
from granary.streaming import alarms, resume

ME = {"arm": "tuned", "seeds": [1, 2], "model": {"name": "m", "revision": None}, "libraries": {"a": "1"}}


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(3))
def test_line_numbers_are_a_plain_readers(spark, tmp_path, small_parts, seed):
    rng = random.Random(seed)
    want = set()
    for name in ("a", "b", "c"):
        path = tmp_path / f"{name}.txt"
        data = b"".join(rng.choice([b"", b"  ", b'{"x":1}', b"torn {", "é".encode() * rng.randint(1, 300), b"y" * rng.randint(1, 2000)]) + rng.choice([b"\n", b"\r\n", b"\n", b"\r"]) for _ in range(120))
        path.write_bytes(data + rng.choice([b"", b"last"]))
        with path.open(encoding="utf-8") as f:
            want |= {(name, i, line.rstrip("\n")) for i, line in enumerate(f, 1)}
    got = numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    assert {(r.file.rsplit("/", 1)[1][0], r.line, r.value) for r in got.collect()} == want


def test_many_parts_are_joined_and_not_broadcast(spark, tmp_path, small_parts, monkeypatch):
    from granary.sources import lines

    monkeypatch.setattr(lines, "BROADCAST_PARTS", 1)
    (tmp_path / "a.txt").write_text("\n".join(str(i) for i in range(1, 2001)))
    got = numbered_lines(spark, str(tmp_path), line_feed_only=True)
    assert {(r.line, r.value, r.ended) for r in got.collect()} == {(i, str(i), i < 2000) for i in range(1, 2001)}


def example(i, **more):
    said = lambda role: {"role": role, "content": f"{role} {i}", "name": None, "reasoning": None}
    return {"id": f"row-{i}", "version": "1.1", "task": "tool_routing", "domain": "career", "messages": [said("user"), said("assistant")], "variation_axes": {"domain": "career"}} | more


def test_rejects_have_their_lines(spark, tmp_path, small_parts):
    text, bad = [], {}
    for i in range(1, 61):
        if i % 7 == 0:
            text.append("")
        elif i % 5 == 0:
            text.append(json.dumps(example(i))[:50])
            bad[i] = ["not_json"]
        elif i % 11 == 0:
            text.append(json.dumps(example("!", surplus=1)))
            bad[i] = ["bad_id", "unknown_field:surplus"]
        else:
            text.append(json.dumps(example(i)))
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(text).encode())
    good, rejects = jsonl.load_examples(spark, str(tmp_path))
    assert {r.line: sorted(r.errors) for r in rejects.collect()} == bad
    assert {r.line for r in good.collect()} == {i for i in range(1, 61) if i % 7 and i not in bad}
    assert [r.line for r in jsonl.head(good, 3).collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="line 5:"):
        jsonl.scan_json(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="'line': "):
        jsonl.load_strict(spark, str(tmp_path))


def generation(i, key=None):
    return json.dumps({"seed": 1, "example_id": f"e{i % 5 if key is None else key}", "text": f"t{i}"})


def test_logs_are_refused(spark, tmp_path, small_parts):
    head, many = partial.header(ME), [generation(i) for i in range(200)]
    other = partial.header(ME | {"seeds": [3], "extra": 1, "libraries": {"a": "1"}})
    logs = {
        "fine": "\n".join([head, *many]) + "\n",
        "torn": "\n".join([head, *many, '{"seed": 1, "exam']),
        "torn-but-whole": "\n".join([head, *many, generation(999, 0)]),  # without its end it counts for nothing
        "only-header": head + "\n",
        "no-header": head,
        "empty-line": "\n" + generation(1) + "\n",
        "unreadable": head[:40] + "\n" + generation(1) + "\n",
        "another-kind": partial.header(ME, kind="x") + "\n",
        "another-version": partial.header(ME, version=2) + "\n",
        "other": other + "\n" + "\n".join(many) + "\n",
        "damaged": "\n".join([head, *many[:100], '{"seed": 1, ', *many[100:]]) + "\n",
        "blank": "\n".join([head, many[0], "", many[1]]) + "\n",
        "no-seed": "\n".join([head, '{"example_id": "e"}']) + "\n",
    }
    for name, text in logs.items():
        (tmp_path / name).write_text(text)
    lines = partial.scan(spark, str(tmp_path))
    judged = partial.judge(lines, ME)
    got = {r.file.rsplit("/", 1)[1]: r for r in judged.collect()}
    want = {"fine": "ok", "torn": "ok", "torn-but-whole": "ok", "only-header": "ok", "no-header": "no_header", "empty-line": "unreadable_header", "unreadable": "unreadable_header", "another-kind": "not_a_log", "another-version": "not_a_log", "other": "other_identity", "damaged": "damaged", "blank": "damaged", "no-seed": "damaged"}
    assert {k: r.verdict for k, r in got.items()} == want and set(want.values()) == set(partial.VERDICTS)
    assert {k for k, r in got.items() if r.torn} == {"torn", "torn-but-whole", "no-header"}
    assert got["other"].differs_in == ["extra", "seeds"] and not got["damaged"].differs_in
    assert {k: r.line for k, r in got.items() if r.line} == {"damaged": 102, "blank": 3, "no-seed": 2}
    rows = partial.records(lines, judged).collect()
    for name in ("fine", "torn", "torn-but-whole"):
        assert {r.example_id: r.text for r in rows if r.file.endswith("/" + name)} == {f"e{i}": f"t{195 + i}" for i in range(5)}
    assert {r.file.rsplit("/", 1)[1] for r in rows} == {"fine", "torn", "torn-but-whole"}
    assert partial.load(spark, str(tmp_path / "torn"), ME).count() == 5
    with pytest.raises(partial.LogRefused, match="differs in extra, seeds"):
        partial.load(spark, str(tmp_path / "other"), ME)
    with pytest.raises(partial.LogRefused, match="damaged in line 102"):
        partial.load(spark, str(tmp_path / "damaged"), ME)


def test_a_stopped_stream_goes_on(spark, tmp_path):
    folder, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "checkpoint")
    folder.mkdir()
    put = lambda name, numbers: (folder / name).write_text("\n".join(map(generation, numbers)) + "\n")
    run = lambda **more: resume.record(resume.generation_lines(spark, str(folder)), log, ME, checkpoint, **more).awaitTermination(120)
    have = lambda: {r.example_id: (r.text, r.given) for r in resume.recorded(spark, log, ME).collect()}
    put("a.jsonl", range(7))
    run()
    assert have() == {"e0": ("t5", 2), "e1": ("t6", 2), "e2": ("t2", 1), "e3": ("t3", 1), "e4": ("t4", 1)}

    def die(number):
        raise RuntimeError("the machine is gone")

    put("b.jsonl", [12, 13])
    with pytest.raises(Exception, match="the machine is gone"):  # written, not committed
        run(on_batch=die)
    put("c.jsonl", [20])
    run()  # first the batch that was written already
    after = {"e0": ("t20", 3), "e1": ("t6", 2), "e2": ("t12", 2), "e3": ("t13", 2), "e4": ("t4", 1)}
    assert have() == after
    run()
    assert have() == after
    with pytest.raises(partial.LogRefused, match="differs in seeds"):
        resume.record(resume.generation_lines(spark, str(folder)), log, ME | {"seeds": []}, checkpoint)
    with pytest.raises(partial.LogRefused, match="other_identity"):
        resume.recorded(spark, log, {"arm": "base"})
    with pytest.raises(Exception, match="another stream"):  # its batches would be numbered from 0 again
        resume.record(resume.generation_lines(spark, str(folder)), log, ME, str(tmp_path / "fresh")).awaitTermination(120)
    assert have() == after

    asked = []

    def generate(rows):
        asked.extend(sorted(r.example_id for r in rows.collect()))
        none = {c: F.lit(None).cast(k) for c, k in (("reasoning", "string"), ("prompt_tokens", "int"), ("completion_tokens", "int"), ("finish_reason", "string"), ("latency_seconds", "double"))}
        return rows.withColumn("text", F.concat(F.lit("made "), "example_id")).withColumns(none)

    requests = spark.createDataFrame([(1, "e0"), (1, "e9"), (2, "e0")], "seed int, example_id string")
    out = {(r.seed, r.example_id): (r.text, r.replayed) for r in resume.resumed(requests, resume.recorded(spark, log, ME), generate).collect()}
    assert out == {(1, "e0"): ("t20", True), (1, "e9"): ("made e9", False), (2, "e0"): ("made e0", False)} and asked == ["e0", "e9"]


def test_a_log_without_records(spark, tmp_path):
    resume.start(spark, str(tmp_path / "log"), ME)
    resume.start(spark, str(tmp_path / "log"), ME)
    assert resume.recorded(spark, str(tmp_path / "log"), ME).count() == 0
    with pytest.raises(partial.LogRefused, match="no_header"):
        resume.recorded(spark, str(tmp_path / "nothing"), ME)


def test_alarms_once_a_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    kind = "experiment_id string, step long, memory double"
    runs = [
        [("a", 1, 0.5), ("a", 2, 0.95), ("a", 3, 0.99), ("b", 1, 0.2), ("c", 5, None), (None, 1, 2.0)],
        [("a", 4, 0.97), ("b", 2, 0.91), ("b", 3, 0.96), ("b", 5, 0.93), ("c", 6, 0.92)],
        [("b", 1, 0.99), ("c", 7, 0.920001), ("d", 9, 0.95), ("d", 8, 0.93), ("d", 8, 0.94)],
    ]
    for i, rows in enumerate(runs):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("experiment_id", "step", "memory"), r, strict=True))) for r in rows) + "\n")
        found = alarms.memory_alarms(spark.readStream.schema(kind).json(str(folder)), 0.92)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2, 0.95), ("b", 3, 0.96), ("c", 7, 0.920001), ("d", 8, 0.94)}


def test_an_idle_run_is_forgotten(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.json").write_text(json.dumps({"experiment_id": "a", "step": i, "memory": 1.0}) + "\n")
        found = alarms.memory_alarms(spark.readStream.schema("experiment_id string, step long, memory double").json(str(folder)), 0.5, idle="1 second")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        time.sleep(1.5)
        (folder / f"{i}-nothing.json").write_text(json.dumps({"experiment_id": "b", "step": i, "memory": 0.1}) + "\n")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert {r.step for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0, 1}
