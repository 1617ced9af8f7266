"""Values worked out by hand, logs as streams, and what raises."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import draws as D
from granary.functions import extract as E
from granary.functions import metrics as M
from granary.functions import text as X
from granary.operators import bootstrap as B
from granary.operators import leakage as L
from granary.operators import results as S2
from granary.operators import splits as S
from granary.plans import catalog
from granary.sources import jsonl
from granary.streaming import logs


def test_ndcg_by_hand(spark):
    got = spark.range(1).select(M.ndcg(F.lit(["c", "b", "a"]), F.lit(["a", "b", "c"]))).first()[0]
    log3 = math.log2(3)
    assert got == pytest.approx((1 + 2 / log3 + 1.5) / (3 + 2 / log3 + 0.5))


@pytest.mark.parametrize(
    ("low", "high", "margin", "want"),
    [
        (0.0001, 0.0001, 0.05, "better"),
        (0.00004, 0.3, 0.05, "inconclusive"),  # rounds to zero
        (-0.4, -0.00006, 0.05, "worse"),
        (-0.4, -0.00004, 0.05, "inconclusive"),
        (0.0, 0.0, 0.0, "equivalent"),
        (-0.05, 0.05, 0.05, "equivalent"),  # the margin itself counts
        (-0.05, 0.0501, 0.05, "inconclusive"),
        (-0.05004, 0.05004, 0.05, "equivalent"),  # rounded to four places first
        (0.4, 0.9, 1.0, "better"),  # better goes before equivalent
    ],
)
def test_primary_verdict(spark, low, high, margin, want):
    assert spark.range(1).select(B.primary_verdict(F.lit(low), F.lit(high), margin)).first()[0] == want
    assert spark.range(1).select(B.primary_verdict(F.lit(low), F.lit(high), margin, F.lit(False))).first()[0] == "inconclusive"


def test_compare_has_a_row_for_every_category(spark):
    """More categories than any limit, a null one, and one that is named as the row of all pairs."""
    rows = spark.range(7200).select((F.col("id") % 1200).cast("string").alias("task"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("group_id"), (F.col("id") % 3 / 3.0).alias("base"), (F.col("id") % 5 / 5.0).alias("tuned"))
    rows = rows.withColumn("task", F.when(F.col("task") == "7", None).when(F.col("task") == "8", "overall").otherwise(F.col("task")))
    got = {(r.overall, r.task): r for r in B.compare(rows, iterations=20).collect()}
    assert len(got) == 1201 and got[True, "overall"].n == 7200 and got[False, "overall"].n == got[False, None].n == 6
    whole = B.paired_cluster_bootstrap(rows, iterations=20).first()
    assert [got[True, "overall"][c] for c in ("clusters", "ci_low", "ci_high", "p_value")] == pytest.approx([whole[c] for c in ("clusters", "ci_low", "ci_high", "p_value")])
    one = B.paired_cluster_bootstrap(rows.filter("task = '9'"), iterations=20).first()
    assert [got[False, "9"][c] for c in ("n", "clusters", "observed", "ci_low", "ci_high")] == pytest.approx([one[c] for c in ("n", "clusters", "observed", "ci_low", "ci_high")])
    few = B.compare(rows.filter("group_id < 'c3'"), iterations=20).filter("overall").first()
    assert not few.estimable and few.ci_low is None and few.primary == "inconclusive"
    assert B.compare(rows.filter("false"), iterations=20).collect() == []


def test_cluster_bootstrap(spark):
    rows = spark.createDataFrame([(f"c{i % 6}", float(i % 5)) for i in range(12)], "g string, v double")
    r = B.cluster_bootstrap(rows, F.col("v"), "g", iterations=100).first()
    assert r.estimable and r.clusters == 6 and r.n == 12 and r.ci_low <= r.observed <= r.ci_high
    few = B.cluster_bootstrap(rows.filter("g < 'c3'"), F.col("v"), "g", iterations=100).first()
    assert not few.estimable and few.ci_low is None
    gain = rows.select("g", F.lit(1.0).alias("v"))
    assert B.cluster_bootstrap(gain, F.col("v"), "g", iterations=100).first().p_value == 0


def test_text_forms(spark):
    d = spark.createDataFrame([("Ünï, The 42 cats!",), ("the",), (None,)], "t string")
    assert [r[0] for r in d.select(X.normalize_text(F.col("t"))).collect()] == ["uni the 0 cats", "the", None]
    assert [r[0] for r in d.select(X.normalize_answer(F.col("t"))).collect()] == ["uni 42 cats", "the", None]


def test_leakage_gate(spark):
    schema = "id string, split string, ord long, text string, family string, entities string"
    rows = spark.createDataFrame([("a", "train", 1, "one two three", "f", "e"), ("b", "test", 2, "one two three", "g", "x"), ("c", "train", 3, "", None, None)], schema)
    found = L.exact_duplicates(rows)
    assert [(r.left_id, r.right_id) for r in found.collect()] == [("a", "b")]
    with pytest.raises(ValueError, match="1 findings"):
        L.enforce(found)
    assert L.enforce(found, "none") == 0
    assert L.exact_duplicates(rows.filter("false")).count() == 0


def test_splits(spark):
    rows = spark.range(200).select("id", (F.col("id") % 20).cast("string").alias("group_id"))
    out = S.split_rows(rows, S.SplitConfig("group"))
    S.verify(out, F.col("group_id"), 200)
    with pytest.raises(ValueError, match="two splits"):
        S.verify(S.split_rows(rows, S.SplitConfig("random")), F.col("group_id"))
    with pytest.raises(ValueError, match="add up"):
        S.SplitConfig("group", train=0.9)


def test_lines_and_stream(spark, tmp_path):
    rows = [{"seed": 1, "example_id": f"e{i % 3}", "text": f"t{i}"} for i in range(5)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    r = jsonl.load_report(spark, str(source)).first()
    assert (r.total, r.blank, r.parsed, r.failed) == (7, 1, 5, 1)
    (source / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    once = logs.once(logs.generation_stream(spark, str(source)))
    for _ in range(2):  # the second run finds nothing new
        logs.append(once, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_near_duplicates_of_many_copies(spark):
    """Copies are not expanded into pairs: classes pair by their first rows, members come from the stars; a text repeated in two splits is found across them."""
    words = " ".join(a + b + c for a in "bdgk" for b in "aeiou" for c in "lmnr")
    rows = [(f"a{i}", "train" if i % 2 else "test", i, words) for i in range(300)] + [(f"b{i}", "train", 1000 + i, words.replace("gun ", "other ")) for i in range(300)] + [("n", "train", 5000, None), ("e", "test", 5001, ""), ("x", "test", 5002, "quite another text")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id string, split string, ord long, text string, family string, entities string")
    near = L.near_duplicates(df).collect()
    assert [(r.left_id, r.right_id) for r in near] == [("a0", "b0")] and near[0].similarity > 0.85
    star = L.normalized_duplicates(df.withColumn("text", F.when(F.col("ord") % 3 == 0, F.concat("text", F.lit(" !"))).otherwise(F.col("text"))))
    assert star.select("right_id").distinct().count() == star.count()
    assert L.cross_split(L.exact_duplicates(df)).count() == 150


def test_results_payloads_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "arm0", "t", 0.5, "yes"), ("e2", "arm0", "t", 1.0, None), ("e1", "arm1", "t", 0.25, "no")], "example_id string, arm string, task string, score double, response string")
    key = lambda r: (r.example_id, r.arm, r.score, r.response)
    back = S2.payload_rows(S2.payloads(rows))
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, rows.collect()), key=str)
    assert all(r.response is None for r in S2.payload_rows(S2.payloads(rows, responses=False)).collect())
    path = tmp_path / "eval_arm0.json"
    path.write_text(S2.payloads(rows).filter("arm = 'arm0'").first().value)
    assert S2.load_results(spark, str(tmp_path / "eval_*.json")).count() == 2
    path.write_text("{}")
    with pytest.raises(Exception, match="not a results payload"):
        S2.load_results(spark, str(tmp_path / "eval_*.json")).collect()
    S2.save_results(rows, str(tmp_path / "saved"), responses=False)
    assert "response" not in spark.read.json(str(tmp_path / "saved")).columns
    with pytest.raises(Exception, match="(?i)exists"):
        S2.save_results(rows, str(tmp_path / "saved"))


def test_prepare_dataset_and_splits(spark, tmp_path):
    message = lambda role, content: {"role": role, "content": content, "name": None, "reasoning": None}
    row = lambda i: {"id": f"row-{i}", "version": "1.1", "task": "tool_routing", "domain": "career", "messages": [message("user", f"q{i}"), message("assistant", f"a{i}")], "variation_axes": {"domain": "career"}}
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "train.jsonl").write_text("\n".join(json.dumps(row(i)) for i in range(5)) + "\n" + json.dumps(row(9) | {"surplus": 1}) + "\n")
    (raw / "dev.jsonl").write_text(json.dumps(row(7)) + "\n")
    (raw / "val.jsonl").write_text(json.dumps(row(8)) + "\n")
    found = jsonl.discover_splits(spark, str(raw))
    assert {k: v.rsplit("/", 1)[1] for k, v in found.items()} == {"train": "train.jsonl", "validation": "val.jsonl"}
    m = jsonl.prepare(spark, str(raw / "train.jsonl"), str(tmp_path / "v1"), "v1").first()
    assert (m.version, m.example_count, m.rejected, m.task_distribution, m.domain_distribution) == ("v1", 5, 1, {"tool_routing": 5}, {"career": 5})
    assert jsonl.load_strict(spark, str(tmp_path / "v1" / "data")).count() == 5
    with pytest.raises(Exception, match="(?i)exists"):
        jsonl.prepare(spark, str(raw / "train.jsonl"), str(tmp_path / "v1"), "v1")
    assert set(jsonl.emit_schemas()) >= {"example", "record"}
    for i in range(2):
        jsonl.emit_events(spark.createDataFrame([("x", "step", i)], "experiment_id string, event string, loss int"), str(tmp_path / "events"))
    events = jsonl.read_events(spark, str(tmp_path / "events")).collect()
    assert len(events) == 2 and all(e.ts > 0 and e.iso_time and e.event == "step" for e in events)


def test_large_files_are_named(spark, tmp_path):
    from granary.sources import files

    (tmp_path / "a.txt").write_text("mail: someone@host.example\n")
    (tmp_path / "b.txt").write_text("x" * 5000)
    got = {(r.path.rsplit("/", 1)[1], r.line, r.pattern, r.found) for r in files.scan_folder(spark, str(tmp_path), most=1000).collect()}
    assert got == {("a.txt", 1, "email_address", "someon…"), ("b.txt", 0, "not_scanned", "5000")}


def test_holdout_of_many_values(spark):
    """Held-out values are joined, in the order of their rank, however many there are."""
    rows = spark.range(4000).select("id", (F.col("id") % 2000).cast("string").alias("domain"))
    out = S.split_rows(rows, S.SplitConfig("domain_holdout"))
    assert out.columns == ["id", "domain", "split"] and out.filter("split = 'test'").count() == 600
    S.verify(out, expected=4000)
    assert out.groupBy("domain").agg(F.bool_and(F.col("split") == "test").alias("all"), F.bool_or(F.col("split") == "test").alias("any")).filter("all <> any").count() == 0
    with pytest.raises(ValueError, match="do not occur"):
        S.split_rows(rows, S.SplitConfig("domain_holdout", holdout_values=("nothing",)))


def test_draws_are_looked_up_where_they_are_made(spark, monkeypatch):
    """Units beyond one broadcast: the same estimates slice by slice, by number of value or by value, and draws are never shuffled."""
    n, rounds = 40_000, 3
    units = spark.range(n).select(F.col("id").alias("g"), (F.col("id") % 5 / 4.0).alias("total"), (F.col("id") % 3 + 1).alias("size"))
    want = {r.b: r.e for r in units.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("b", B.draw(F.col("b"), F.col("g"), F.lit(n).cast("long"), 42).alias("g")).join(units, "g").groupBy("b").agg((F.sum("total") / F.sum("size")).alias("e")).collect()}
    for room, values in ((32 << 20, 4096), (2 * B.BLOCK, 4096), (16 * B.BLOCK, 1)):
        monkeypatch.setattr(B, "BROADCAST_BYTES", room)
        monkeypatch.setattr(B, "MOST_VALUES", values)
        got = B._resampled(units, n, rounds, 42)
        assert "hashpartitioning(g" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.b: round(r.estimate, 9) for r in got.collect()} == {b: round(e, 9) for b, e in want.items()}


def test_shingle_count_without_shingles(spark):
    """The count equals the number of shingles, for narrow and wide characters, and no shingle is made."""
    texts = ["", "abc", "abcde", "abcdef", "aaaaaaaaaa", "ab" * 40, "über straße über straße", "𝔸𝔹𝔸𝔹𝔸𝔹𝔸𝔹c", "日本語のテキスト日本語のテキスト", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(F.size(X.shingles(F.col("t"))).alias("a"), X.shingle_count(F.col("t")).alias("b")).collect()
    assert [r.b for r in rows] == [r.a for r in rows] and rows[3].b == 2
    assert "array_distinct" not in catalog.f03_shingle_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_token_f1_of_long_texts(spark):
    """The same as token_f1(), null as empty; f27 shuffles each text once a side and no row a token."""
    rows = [("a b b c", "b b d"), ("", ""), ("a", ""), (None, "a"), ("x y", "y x"), ("a a a", "a"), ("p", "q")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(M.token_f1(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("x"), M.token_f1_long("a", "b").alias("y")).collect()
    assert [round(r.x, 12) for r in got] == [round(r.y, 12) for r in got]
    assert "Generate" not in catalog.f27_token_f1(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_claims_and_answers_keep_their_forms(spark):
    """What is looked for first changes nothing; answers that are one plain word take no pattern, and response norms are made only where they are asked for."""
    texts = ["On May 5 Anna Berg paid $5 and €7,50 for 12%", "no claims", "see Ref-12, SOURCE a1", "The", "AN", "The 9 the", "Äpfel_1", "a an the", "x_1", "word\n", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (E.NUMBER, E.DATE, E.CURRENCY)]
    names = F.filter(F.regexp_extract_all("t", F.lit(E.PROPER_NOUN), F.lit(0)), lambda x: ~x.isin(*E.STARTERS))
    rows = df.select(
        E.extract_claims(F.col("t")).alias("c"), F.array_sort(F.array_distinct(F.concat(*plain, names))).alias("d"), E.extract_citations(F.col("t")).alias("r"), F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(E.CITATION), F.lit(1)))).alias("s"), X.normalize_answer(F.col("t")).alias("n")
    ).collect()
    assert [(r.c, r.r) for r in rows] == [(r.d, r.s) for r in rows] and "$5" in rows[0].c and rows[2].r == ["12", "a1"]
    assert [r.n for r in rows] == ["on may 5 anna berg paid 5 and 7 50 for 12", "no claims", "see ref 12 source a1", "the", "an", "9", "apfel_1", "a an the", "x_1", "word", "", None]
    assert "A-Za-z0-9_" in df.select(X.normalize_answer(F.col("t")))._jdf.queryExecution().analyzed().toString()


def test_sketches_keep_alike_sets_apart_from_others(spark):
    """Sets at the threshold agree in enough bits, sets of half that likeness do not, and pairs are judged by it before any text is joined to them."""
    agree = lambda a, b: L.SKETCH - sum(int(x).bit_count() for x in (L._sketch(a) ^ L._sketch(b)).view(np.uint64))
    for seed in range(20):
        x = np.random.default_rng(seed).integers(0, 2**63, 1600, dtype=np.uint64)
        assert agree(x[:1480], x[120:]) >= L.agreeing(0.85) > agree(x[:1100], x[700:1600])
    rows = spark.createDataFrame([("a", "train", 0, "some words that stand here twice, nearly alike in all", None, None), ("b", "test", 1, "some words that stand here twice, nearly alike in all of", None, None)], "id string, split string, ord long, text string, family string, entities string")
    found = L.near_duplicates(rows)
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString() and [(r.left_id, r.right_id) for r in found.collect()] == [("a", "b")]


def test_draws_of_a_piece_are_hashed_together(spark):
    """Numbers equal those of SHA-256 where digits, pieces and words of a message end; no draw is a row, and a total that is null counts by its size alone."""
    for seed, b, low, high, n in ((42, 0, 0, 25_000, 25_000), (42, 1999, 8_995_000, 9_003_000, 9_003_000), (-7, 3, 10**12 + 5, 10**12 + 15_000, 10**13), (2**62, 10**6, 99_000, 130_100, 3), (1, 12, 5, 120, 77)):
        got = np.concatenate(list(D.drawn(seed, b, low, high, n)))
        assert got.tolist() == [int(hashlib.sha256(f"{seed}:{b}:{s}".encode()).hexdigest()[:15], 16) % n for s in range(low, high)]
    for length in range(1, 48):  # every place of the tail in its words
        assert int(D.heads(b"7" * length, D.tails(41, 44, 5), 5)[1]) == int(hashlib.sha256(b"7" * length + b"00042").hexdigest()[:15], 16)
    units = spark.range(5000).select(F.col("id").alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") / 64.0).alias("total"), (F.col("id") % 3 + 1).alias("size"))
    slots = spark.range(2).withColumnRenamed("id", "b").crossJoin(spark.range(5000)).select("b", B.draw(F.col("b"), F.col("id"), F.lit(5000).cast("long"), 42).alias("g"))
    want = {r.b: r.e for r in slots.join(units, "g").groupBy("b").agg((F.sum("total") / F.sum("size")).alias("e")).collect()}
    found = B._resampled(units, 5000, 2, 42)
    assert "sha2(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.b: r.estimate for r in found.collect()} == pytest.approx(want)
    assert [r.estimate for r in B._resampled(units.withColumn("total", F.lit(None).cast("double")), 5000, 2, 42).collect()] == [None, None]


def test_near_duplicates_in_cells(spark, monkeypatch):
    """Every pair of many near copies is found however small the cells, buckets are shuffled once for both sides, and no text is joined to a pair."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(120)]
    rows = [(f"a{i:02d}", "train" if i % 2 else "test", i, " ".join(words[:i] + ["zz" + "klmnopqrst"[i % 10] * 3] + words[i:]), None, None) for i in range(24)] + [("c", "test", 99, " ".join(words[:60]), None, None)]
    df = spark.createDataFrame(rows, "id string, split string, ord long, text string, family string, entities string")
    sets = {r.id: set(r.g) for r in df.select("id", X.shingles(X.normalize_text(F.col("text"))).alias("g")).collect()}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.85}
    assert len(want) == 276
    for cell in (1 << 20, 1500):
        monkeypatch.setattr(L, "CELL", cell)
        found = L.near_duplicates(df)
        assert {(r.left_id, r.right_id): r.similarity for r in found.collect()} == pytest.approx(want)
    plan = found._jdf.queryExecution().toString()
    assert "ReusedExchange" in plan and "x.norm" not in plan
    cells = L._cells(spark.range(1, 24).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), spark.range(24).select(F.col("id").alias("rid"), F.lit(500).alias("n")))
    assert cells.count() == 23 and 1 < cells.select("cell").distinct().count() <= 23
    many = L._cells(spark.range(1, 2000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), spark.range(2000).select(F.col("id").alias("rid"), F.lit(0).alias("n")))
    assert many.count() == 1999 and many.select("cell").distinct().count() == 8  # short texts are many, whatever their grams
