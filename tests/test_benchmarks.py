"""Sealed releases, references, batches of one padded length, bundles."""

import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.operators import batching, benchmarks
from granary.sources import jsonl


def seal(folder, names):
    hashes = {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in names}
    (folder / "RELEASE.lock").write_text(json.dumps({"all_file_hashes": hashes, "version": 3}))
    return hashes


def test_a_changed_byte_is_refused(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "train.jsonl").write_bytes(b"\x00\xff binary\r\n" * 1000)
    (tmp_path / "manifest.json").write_text("{}")
    (tmp_path / "notes.txt").write_text("not sealed")
    hashes = seal(tmp_path, ["data/train.jsonl", "manifest.json"])
    link = ""
    for n in sorted(hashes):
        link = hashlib.sha256(f"{link}{n}:{hashes[n]}".encode()).hexdigest()
    assert benchmarks.verify_release(spark, str(tmp_path)) == link == benchmarks.verify_release(spark, f"file://{tmp_path}")
    whole = (tmp_path / "data" / "train.jsonl").read_bytes()
    (tmp_path / "data" / "train.jsonl").write_bytes(whole[:500] + b"x" + whole[501:])
    with pytest.raises(benchmarks.ReleaseBroken, match="data/train.jsonl: .* != ") as e:
        benchmarks.verify_release(spark, str(tmp_path))
    assert [f for f, _ in e.value.mismatches] == ["data/train.jsonl"]
    (tmp_path / "manifest.json").unlink()
    with pytest.raises(benchmarks.ReleaseBroken, match="manifest.json: missing"):
        benchmarks.verify_release(spark, str(tmp_path))
    with pytest.raises(Exception, match="(?i)path"):
        benchmarks.verify_release(spark, str(tmp_path / "data"))


def test_references_keep_kinds_and_unknown_keys(spark):
    answers = ['{"ranking":["a",2],"deciding_factor":"x","confident":1,"next_step":null,"reasons":{"a":"b"},"more":[1]}', '{"ranking":[],"label":"y","confident":true,"reasons":["no"]}', '["ranking"]', "no", '{"a":1}', None]
    rows = spark.createDataFrame([(i, "t", [("user", "q"), ("assistant", a)]) for i, a in enumerate(answers)] + [(9, "t", [])], "id long, task string, messages array<struct<role:string,content:string>>")
    good, bad = benchmarks.build(rows, "g")
    got = {r.id: r for r in good.select("id", "messages", "reference.ranking", "reference.label", "reference.confident", "reference.next_step", F.to_json("reference.reasons").alias("reasons"), "reference.options", F.to_json("reference.answer").alias("answer")).collect()}
    assert set(got) == {0, 1} and [m.role for m in got[0].messages] == ["user"]
    assert (got[0].ranking, got[0].label, got[0].confident, got[0].next_step, got[0].reasons, got[0].options) == (["a", "2"], "x", None, None, '{"a":"b"}', ["x", "y"])
    assert (got[1].ranking, got[1].label, got[1].confident, got[1].reasons) == ([], "y", True, None) and '"more":[1]' in got[0].answer
    assert {r.id: r.problem for r in bad.collect()} == {2: "not_json", 3: "not_json", 4: "no_ranking", 5: "not_json", 9: "not_json"}


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(benchmarks, "MOST_OPTIONS", 3)
    rows = spark.range(4).select("id", F.lit("t").alias("task"), F.array(F.struct(F.lit("u").alias("role"), F.lit("q").alias("content")), F.struct(F.lit("a").alias("role"), F.concat(F.lit('{"ranking":[],"label":"'), "id", F.lit('"}')).alias("content"))).alias("messages"))
    with pytest.raises(ValueError, match="more than 3 labels"):
        benchmarks.build(rows, "g")


def test_batches_never_mix_lengths(spark):
    rows = [(1, f"e{i:03}", list(range(1, 1 + (i * 7) % 23)) if i % 9 else None) for i in range(200)] + [(2, f"h{i}", [5] * 12) for i in range(100)]
    df = spark.createDataFrame(rows, "seed int, example_id string, ids array<int>").withColumn("padded", F.lit("clash"))

    def echo(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, mask = b.column("ids").to_pylist(), b.column("attention_mask").to_pylist()
        assert len({len(x) for x in ids}) == 1 and 0 < len(ids) <= 8
        return pa.RecordBatch.from_arrays([pa.array([",".join(str(x) for x, m in zip(i, k, strict=True) if m) for i, k in zip(ids, mask, strict=True)]), pa.array([len(ids)] * len(ids)), pa.array([i[-1] for i in ids])], ["text", "rows", "last"])

    out = batching.generate_batches(df, echo, "text string, rows long, last long", size=8, pad=-1)
    got = {(r.seed, r.example_id): r for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["seed", "example_id", "padded", "text", "rows", "last"]
    for seed, name, ids in rows:
        r = got[seed, name]
        n = len(ids or [])
        assert r.text == ",".join(map(str, ids or [])) and r.padded == max(8, -(-n // 8) * 8) and (r.last == -1 if n < r.padded else True)
    assert sum(r.rows == 8 for r in got.values()) > 150
    assert batching.generate_batches(df.filter("false"), echo, "text string, rows long, last long").count() == 0
    with pytest.raises(Exception, match="backend gave"):
        batching.generate_batches(df, lambda b: b.slice(0, 0), "text string, rows long, last long").collect()


def test_bundles(spark, tmp_path):
    said = lambda role: {"role": role, "content": "x", "name": None, "reasoning": None}
    row = lambda i, **more: {"id": f"row-{i}", "version": "1.1", "task": "tool_routing", "domain": "career", "messages": [said("user"), said("assistant")], "variation_axes": {"domain": "career"}, "metadata": {"source": "synthetic", "quality_status": "reviewed"}} | more
    put = lambda name, rows: (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    put("train.jsonl", [row(1), row(2), row(3, metadata={"source": "synthetic", "quality_status": "draft"}), row(4, task="workspace_reasoning"), row(5, metadata={"source": "expert_authored", "quality_status": "reviewed"})])
    put("val.jsonl", [row(6), "", "{torn"])
    load = lambda **more: jsonl.load_bundle(spark, str(tmp_path), **more)
    b = load(strict=False, filters=jsonl.Filters())
    assert b.manifest is None and b.counts == {"train": 4, "validation": 1} and [(r.split, r.line, r.errors) for r in b.rejects.collect()] == [("validation", 3, ["not_json"])]
    assert load(strict=False).counts == {"train": 5, "validation": 1}
    ids = lambda f: {r.id for r in load(strict=False, filters=f).rows.collect()}
    assert ids(jsonl.Filters(tasks=["tool_routing"], excluded_sources=["expert_authored"])) == {"row-1", "row-2", "row-6"}
    assert ids(jsonl.Filters(allow_unreviewed=True, max_examples=3)) == {"row-1", "row-2", "row-3", "row-6"}
    for more, message in ((dict(strict=True), "'line': 3"), (dict(strict=False, require_manifest=True), "no manifest"), (dict(strict=False, required=("test",)), "missing splits"), (dict(strict=False, filters=jsonl.Filters(domains=["x"])), "empty splits")):
        with pytest.raises(ValueError, match=message):
            load(**more)
    put("manifest.json", [{"version": "v7", "contains_private_data": True}])
    with pytest.warns(UserWarning, match="v7 holds private data"):
        assert load(strict=False, require_manifest=True).manifest.version == "v7"
    put("test.jsonl", [row(1)])
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="row-1.*test.*train"):
        load(strict=False)
