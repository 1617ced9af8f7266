"""A query over the driver's tables for each operator, with its SQL where SQL can say it. Columns are scalars; doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversations as C
from ..functions import metrics as M
from ..functions import text as X
from ..operators import bootstrap as B
from ..operators import coverage as V
from ..operators import evaluation as E
from ..operators import leakage as L
from ..operators import orderstats
from ..operators import registry as R
from ..operators import splits as S
from ..operators import validation as Q
from ..operators.graders import NDCG_WEIGHT
from ..sources import files
from ..sources.scratch import stored
from . import bindings
from .bindings import RANKS, RECORDS, TEXTS, rank_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def norm_sql(t: str) -> str:
    low = f"replace(lower(strip_accents({t})), 'ß', 'ss')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({low}, '\d+', '0', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def answer_sql(t: str) -> str:
    low = f"replace(lower(strip_accents({t})), 'ß', 'ss')"
    clean = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    bare = clean(rf"regexp_replace({low}, '\b(a|an|the)\b', ' ', 'g')")
    return f"CASE WHEN {bare} = '' THEN {clean(low)} ELSE {bare} END"


# texts


@query(f"SELECT doc_id, sha256({norm_sql('text')}) AS norm FROM documents")
def f01_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("norm"))


@query(f"SELECT doc_id, sha256({answer_sql('text')}) AS norm FROM documents")
def f02_normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.normalize_answer(F.col("text")), 256).alias("norm"))


@query(f"WITH n AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 5 THEN len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) WHEN t <> '' THEN 1 ELSE 0 END AS n FROM n")
def f03_shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.shingle_count(X.normalize_text(F.col("text"))).alias("n"))


@query(f"SELECT doc_id, {rank_sql('CAST(doc_id AS VARCHAR)', 42)} AS rank FROM documents")
def f08_stable_rank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.stable_rank(F.col("doc_id").cast("string"), 42).alias("rank"))


@query(r"SELECT doc_id, CAST(floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE) AS BIGINT) + 1 AS tokens FROM documents")
def f09_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.approximate_token_count(F.col("text")).cast("long").alias("tokens"))


def _scan_sql() -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in X.SENSITIVE.items())
    return f"SELECT pattern, count(*) AS n FROM (SELECT unnest([{hits}]) AS pattern FROM documents) WHERE pattern IS NOT NULL GROUP BY pattern"


@query(_scan_sql())
def f10_sensitive_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(X.sensitive_content(F.col("text"))).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id")
def f12_conversation_hash(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.conversations(spark, sf).select("conv_id", C.content_hash(F.col("messages")).alias("hash"))


@query(
    """WITH m AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS fa, min(turn) OVER (PARTITION BY conv_id) AS f0 FROM conversations)
SELECT conv_id, max(CASE WHEN turn = f0 AND role = 'system' THEN length(text) END)::BIGINT AS system_chars, count(*) FILTER (role = 'assistant') AS targets, count(*) FILTER (fa IS NULL OR turn < fa) AS prompt_turns FROM m GROUP BY conv_id"""
)
def f15_prompt_parts(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    return bindings.conversations(spark, sf).select("conv_id", F.length(C.system_prompt(m)).cast("long").alias("system_chars"), F.size(C.assistant_targets(m)).cast("long").alias("targets"), F.size(C.prompt_messages(m)).cast("long").alias("prompt_turns"))


@query("SELECT event_id, CAST(floor(abs(value)) AS BIGINT) % 3 * 86400 + CAST(floor(abs(value)) AS BIGINT) % 24 * 3600 + CAST(event_id % 60 AS BIGINT) * 60 + 7 AS seconds FROM events")
def f35_retry_after(spark: SparkSession, sf: str) -> DataFrame:
    v = F.floor(F.abs("value"))
    message = F.concat(F.lit("Quota reached, try again in "), F.when(v % 3 > 0, F.concat((v % 3).cast("string"), F.lit(" days, "))).otherwise(""), (v % 24).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(":07."))
    return table(spark, sf, "events").select("event_id", X.retry_after(message).alias("seconds"))


@query(
    "WITH p AS (SELECT l.doc_id, l.text AS a, r.text AS b, CAST(least(length(l.text), length(r.text)) AS BIGINT) AS n FROM documents l JOIN documents r ON r.doc_id = l.doc_id + 1) SELECT doc_id, CASE WHEN a = b THEN NULL ELSE coalesce((SELECT min(i) - 1 FROM range(1, n + 1) g(i) WHERE substr(a, i, 1) <> substr(b, i, 1)), n) END AS at FROM p"
)
def f37_first_difference(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select("doc_id", X.first_difference(F.col("a"), F.col("b")).alias("at"))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").alias("a")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")


@query("SELECT doc_id, '<redacted len=' || length(text) || ' sha256=' || substr(sha256(text), 1, 12) || '>' AS shown FROM documents")
def f39_redact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.redact(F.col("text")).alias("shown"))


@query("SELECT page_id, sha1('blob ' || strlen(html) || chr(0) || html) AS sha1 FROM pages")
def f46_git_blob(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.git_blob_sha1(F.encode("html", "UTF-8")).alias("sha1"))


@query("SELECT l_returnflag AS flag, max((l_partkey + 7) // 8 * 8) AS padded FROM lineitem GROUP BY 1")
def f44_padded_length(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.max(X.padded_length(F.col("l_partkey"))).alias("padded"))


def _lines_sql() -> str:
    patterns = ", ".join(f"['{n}', '{p}']" for n, p in X.SENSITIVE.items())
    return f"""WITH h AS (SELECT page_id, CAST(i AS INT) AS line, x, unnest([{patterns}]) AS p
  FROM (SELECT page_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages)))
SELECT page_id, line, p[1] AS pattern, left(regexp_extract(x, p[2]), 6) || '…' AS found FROM h WHERE regexp_matches(x, p[2])"""


@query(_lines_sql())
def s22_content_scan(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan_content(table(spark, sf, "pages"), "html", ["page_id"])


# filters and validation


@query(
    "WITH e AS (SELECT d.doc_id, lang, source, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'reviewed' ELSE 'draft' END AS st FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id AS id, lang AS domain FROM e WHERE lang IN ('en', 'fr') AND st = 'reviewed' AND source <> 'src0' ORDER BY doc_id LIMIT 100"
)
def p01_filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = bindings.examples(spark, sf).withColumn("domain", F.col("axes")["domain"]).withColumn("n_messages", F.lit(2))
    return Q.apply_filters(rows, domains=["en", "fr"], excluded_sources=["src0"], max_examples=100).select("id", "domain")


@query(
    """WITH m AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS fa, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS fu FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, max(n) AS n, max(fa) AS fa, max(fu) AS fu, max_by(role, turn) AS l, bool_or(role = 'system' AND i > 1) AS s, bool_or(role = 'assistant' AND before = 'assistant') AS t, bool_or(trim(text) = '') AS e FROM m GROUP BY conv_id),
x AS (SELECT conv_id, unnest([CASE WHEN n < 2 THEN 'too_few_messages' END, CASE WHEN fa IS NULL THEN 'no_assistant' END, CASE WHEN fa IS NOT NULL AND l <> 'assistant' THEN 'last_not_assistant' END, CASE WHEN s THEN 'system_not_first' END, CASE WHEN fa IS NOT NULL AND (fu IS NULL OR fu > fa) THEN 'no_user_before_assistant' END, CASE WHEN t THEN 'consecutive_assistants' END, CASE WHEN e THEN 'empty_content' END]) AS code FROM c)
SELECT code, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY code"""
)
def p02_conversation_shape(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.conversations(spark, sf).select(F.explode(C.shape_errors(F.col("messages"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _validate_sql() -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in X.SENSITIVE.items())
    hold = " OR ".join(f"regexp_matches(text, '{p}')" for p in X.PLACEHOLDERS)
    facts = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in X.FACT_HINTS)
    return rf"""WITH e AS (SELECT d.doc_id, text, source, CASE WHEN d.doc_id % 10 = 0 THEN '2.0' ELSE '1.1' END AS version, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'reviewed' ELSE 'draft' END AS st FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'warning' AS severity, 'unexpected_schema_version' AS code, version AS subject, count(*) AS n_affected FROM e WHERE version = '2.0' GROUP BY version
UNION ALL SELECT 'warning', 'unreviewed_examples', '', count(*) FROM e WHERE st <> 'reviewed' HAVING count(*) > 0
UNION ALL SELECT 'error', 'rejected_examples_present', '', count(*) FROM e WHERE st = 'rejected' HAVING count(*) > 0
UNION ALL SELECT 'error', 'placeholder_content', '', count(*) FROM e WHERE {hold} HAVING count(*) > 0
UNION ALL SELECT 'warning', 'possible_fact_memorization', '', count(*) FROM e WHERE {facts} HAVING count(*) > 0
UNION ALL SELECT 'info', 'unregistered_variation_axes', 'shelf', count(*) FROM e HAVING count(*) > 0
UNION ALL SELECT 'warning', 'examples_exceed_max_tokens', '', count(*) FROM e WHERE floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE) + 1 > 2048 HAVING count(*) > 0
UNION ALL SELECT 'error', 'possible_sensitive_content', p, count(*) FROM (SELECT unnest([{hits}]) AS p FROM e) WHERE p IS NOT NULL GROUP BY p
UNION ALL SELECT 'warning', 'constant_variation_axis', 'format', count(*) FROM e HAVING count(*) >= 4
UNION ALL SELECT 'warning', 'mixed_schema_versions', '', count(*) FROM e HAVING count(DISTINCT version) > 1"""


@query(_validate_sql())
def p05_validation_findings(spark: SparkSession, sf: str) -> DataFrame:
    return Q.validate(bindings.examples(spark, sf), max_tokens=2048).select("severity", "code", "subject", "n_affected")


@query("SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def j08_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("all").alias("split"))
    return Q.duplicate_ids(rows).select("id", "n")


# leakage


def _star_sql(key: str, kind: str, where: str = "true") -> str:
    return f"""WITH {TEXTS}, k AS (SELECT *, {key} AS k FROM txt WHERE {where}), f AS (SELECT k, min(ord) AS o FROM k GROUP BY k HAVING count(*) > 1)
SELECT '{kind}' AS kind, a.id AS left_id, b.id AS right_id, a.split AS left_split, b.split AS right_split FROM f JOIN k a ON a.k = f.k AND a.ord = f.o JOIN k b ON b.k = f.k AND b.ord > f.o"""


SHOWN = ["kind", "left_id", "right_id", "left_split", "right_split"]


@query("SELECT 'id_collision' AS kind, CAST(doc_id AS VARCHAR) AS left_id, CAST(doc_id AS VARCHAR) AS right_id, 'a' AS left_split, 'b' AS right_split FROM documents WHERE doc_id % 3 = 0")
def j05a_id_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every row against the rows of a second copy that keeps every third id."""
    rows = bindings.texts(spark, sf).filter("split <> 'evaluation'")
    again = rows.filter("ord % 3 = 0").withColumn("ord", F.col("ord") + 10**13).withColumn("split", F.lit("b"))
    return L.id_collisions(rows.withColumn("split", F.lit("a")).union(again)).select(*SHOWN)


@query(_star_sql("sha256(text)", "exact_duplicate"))
def j05b_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return L.exact_duplicates(bindings.texts(spark, sf)).select(*SHOWN)


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """Texts, and every third of them once more with punctuation around it, in another split."""
    rows = bindings.texts(spark, sf)
    again = rows.filter("ord % 3 = 0").select(F.concat(F.lit("v"), "id").alias("id"), F.lit("variant").alias("split"), (F.col("ord") + 10**13).alias("ord"), F.concat(F.lit("** "), "text", F.lit(" !")).alias("text"), "family", "entities")
    return rows.union(again)


_NORMALIZED = f"""WITH {TEXTS}, a AS (SELECT id, split, ord, text FROM txt UNION ALL SELECT 'v' || id, 'variant', ord + 10000000000000, '** ' || text || ' !' FROM txt WHERE ord % 3 = 0), k AS (SELECT *, {norm_sql('text')} AS nk FROM a),
ef AS (SELECT text, min(ord) AS o FROM k GROUP BY text HAVING count(*) > 1),
ex AS (SELECT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM ef JOIN k a ON a.text = ef.text AND a.ord = o JOIN k b ON b.text = ef.text AND b.ord > o),
nf AS (SELECT nk, min(ord) AS o FROM k GROUP BY nk HAVING count(*) > 1)"""


@query(
    _NORMALIZED
    + """ SELECT 'normalized_duplicate' AS kind, a.id AS left_id, b.id AS right_id, a.split AS left_split, b.split AS right_split FROM nf JOIN k a ON a.nk = nf.nk AND a.ord = o JOIN k b ON b.nk = nf.nk AND b.ord > o
WHERE NOT EXISTS (SELECT 1 FROM ex WHERE x = least(a.id, b.id) AND y = greatest(a.id, b.id))"""
)
def j05c_normalized_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return L.normalized_duplicates(_variants(spark, sf)).select(*SHOWN)


@query(
    f"""WITH {TEXTS}, k AS (SELECT *, {norm_sql('text')} AS nk FROM txt), f AS (SELECT nk, min(ord) AS ord, arg_min(id, ord) AS id FROM k WHERE nk IS NOT NULL GROUP BY nk),
s AS (SELECT id, ord, CASE WHEN length(nk) > 5 THEN list_distinct(list_transform(range(1, length(nk) - 3), lambda i: substr(nk, i, 5))) WHEN nk <> '' THEN [nk] ELSE [] END AS g FROM f),
u AS (SELECT id, ord, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.id AS i, b.id AS j, a.n + b.n AS t, count(*) AS m FROM u a JOIN u b ON a.x = b.x AND a.ord < b.ord AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY ALL)
SELECT i AS left_id, j AS right_id, round(m / (t - m), 6) AS similarity FROM c WHERE m / (t - m) >= 0.85"""
)
def j05d_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of classes of equal normalised texts, each by its first row; the classes' members are what j05b and j05c list."""
    return L.near_duplicates(bindings.texts(spark, sf)).select("left_id", "right_id", *six("similarity"))


@query(
    f"""WITH {TEXTS}, f AS (SELECT family, split, arg_min(id, ord) AS id FROM txt WHERE family IS NOT NULL GROUP BY family, split), h AS (SELECT *, first_value(split) OVER w AS hs, first_value(id) OVER w AS hi FROM f WINDOW w AS (PARTITION BY family ORDER BY split))
SELECT 'scenario_repeat' AS kind, hi AS left_id, id AS right_id, hs AS left_split, split AS right_split FROM h WHERE split <> hs"""
)
def j05e_scenario_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return L.scenario_repeats(bindings.texts(spark, sf)).select(*SHOWN)


@query(
    f"""WITH {TEXTS}, t AS (SELECT entities, arg_min(id, ord) AS l FROM txt WHERE split = 'train' AND entities IS NOT NULL GROUP BY entities)
SELECT 'entity_leak' AS kind, l AS left_id, id AS right_id, 'train' AS left_split, split AS right_split FROM txt JOIN t USING (entities) WHERE split <> 'train'"""
)
def j05f_entity_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return L.entity_leaks(bindings.texts(spark, sf)).select(*SHOWN)


@query(
    f"""WITH {TEXTS}, e AS (SELECT *, min(ord) OVER (PARTITION BY text) AS o FROM txt), d AS (SELECT a.split AS l, b.split AS r FROM e b JOIN e a ON a.ord = b.o AND b.ord > b.o)
SELECT k AS kind, CASE WHEN k = 'exact_duplicate' THEN (SELECT count(*) FROM d) ELSE 0 END AS n, CASE WHEN k = 'exact_duplicate' THEN (SELECT count(*) FROM d WHERE l <> r) ELSE 0 END AS n_cross_split FROM (SELECT unnest({list(L.KINDS)}) AS k)"""
)
def a19_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.kind_counts(L.exact_duplicates(bindings.texts(spark, sf)))


# joins of runs


@query(f"WITH {RECORDS} SELECT example_id, group_id, subset, score FROM rec")
def j01_annotate(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf)
    index = rec.select(F.col("example_id").alias("id"), "task", "group_id", "subset")
    return R.annotate(rec, index).select("example_id", "group_id", "subset", "score")


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf)
    return E.paired(rec, rec.withColumn("score", F.col("tuned")))


@query(f"WITH {RECORDS} SELECT example_id, task, base, tuned FROM rec")
def j03_paired_arms(spark: SparkSession, sf: str) -> DataFrame:
    return _arms(spark, sf).select("example_id", "task", "base", "tuned")


@query(f"WITH {RECORDS} SELECT count(*) AS common, count(*) FILTER (example_id % 11 = 0) AS differ FROM rec")
def j04_benchmark_identity(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf).withColumn("reference_decision", F.lit(None).cast("string"))
    other = rec.withColumn("reference_decision", F.when(F.col("example_id") % 11 == 0, "changed"))
    return R.same_benchmark(rec, other)


@query(
    "WITH l AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 4 <> 0) SELECT status, count(*) AS n FROM (SELECT CASE WHEN r.k IS NULL THEN 'missing' WHEN l.k IS NULL THEN 'extra' WHEN l.p <> r.p THEN 'size' ELSE 'same' END AS status FROM l FULL JOIN r ON l.k = r.k) GROUP BY status"
)
def j09_file_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("bytes"), F.lit("x").alias("sha256"))
    right = o.filter("path % 4 <> 0").withColumn("bytes", F.col("bytes") + F.when(F.col("path") % 7 == 0, 1).otherwise(0))
    return files.compare_files(o.filter("path % 5 <> 0"), right).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS example_id, CASE WHEN event_id % 3 = 0 THEN 'logged' ELSE 'made' END AS text, event_id % 3 = 0 AS replayed FROM events")
def j11_replay(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.lit(1).alias("seed"), F.col("event_id").alias("example_id"))
    log = rows.filter("example_id % 3 = 0").withColumn("text", F.lit("logged"))
    return R.replay(rows, log, F.lit("made")).select("example_id", "text", "replayed")


# aggregations


def _summary_sql(v: str) -> str:
    m = f"CASE WHEN count({v}) > 1 THEN 1.96 * coalesce(stddev_samp({v}), 0) / sqrt(count({v})) ELSE 0 END"
    return f"count({v}) AS n, round(avg({v}), 6) AS mean, round(coalesce(stddev_samp({v}), 0), 6) AS std, min({v}) AS minimum, max({v}) AS maximum, round(avg({v}) - {m}, 6) AS ci_low, round(avg({v}) + {m}, 6) AS ci_high"


@query(f"WITH {RECORDS} SELECT task, {_summary_sql('score')} FROM rec GROUP BY task")
def a01_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.summarize(bindings.records(spark, sf), by=["task"]).select("task", "n", *six("mean", "std"), "minimum", "maximum", *six("ci_low", "ci_high"))


_PAIRS = "p AS (SELECT CASE WHEN l_quantity > 40 THEN 'A' WHEN l_quantity > 20 THEN 'N' ELSE 'R' END AS reference, l_returnflag AS predicted FROM lineitem)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") > 40, "A").when(F.col("l_quantity") > 20, "N").otherwise("R").alias("reference"), F.col("l_returnflag").alias("predicted"))


_CLASSES = f"""WITH {_PAIRS}, s AS (SELECT label, count(*) FILTER (reference = label AND predicted = label) AS tp, count(*) FILTER (reference <> label AND predicted = label) AS fp, count(*) FILTER (reference = label AND predicted <> label) AS fn
  FROM p, (SELECT DISTINCT unnest([reference, predicted]) AS label FROM p) GROUP BY label),
c AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM s),
d AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM c)"""


@query(f"{_CLASSES} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM d")
def a03_class_scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.class_scores(_pairs(spark, sf)).select("label", "support", *six("precision", "recall", "f1"))


@query(f"{_CLASSES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1) FILTER (support > 0), 6) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM d")
def a03_classification(spark: SparkSession, sf: str) -> DataFrame:
    return E.classification_scores(_pairs(spark, sf)).select(*six("accuracy", "macro_f1", "micro_f1"))


@query(f"WITH {_PAIRS} SELECT reference, predicted, count(*) AS n FROM p GROUP BY ALL")
def a03_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(_pairs(spark, sf))


@query("SELECT 'lang' AS axis, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def a04_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return V.marginal_counts(table(spark, sf, "documents"), ["lang", "source"])


@query(
    r"""WITH t AS (SELECT floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE) + 1 AS v FROM documents), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM t)
SELECT max(n) AS n, round(avg(v), 6) AS mean, median(v) AS median, min(v) AS min, max(v) AS max, max(CASE WHEN i = CASE WHEN n >= 20 THEN CAST(floor(n * 0.95::DOUBLE) AS BIGINT) ELSE n END THEN v END) AS p95 FROM r"""
)
def a04_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(X.approximate_token_count(F.col("text")).alias("v"))
    return V.length_stats(rows, "v").select("n", *six("mean"), "median", "min", "max", "p95")


@query("WITH c AS (SELECT 'lang' AS axis, lang AS v, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source) SELECT axis, count(v) AS distinct_values, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS missing, round(max(n) / min(n), 6) AS imbalance, count(v) = 1 AS constant FROM c GROUP BY axis")
def a05_axis_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return V.axis_coverage(table(spark, sf, "documents"), ["lang", "source"]).select("axis", "distinct_values", "missing", *six("imbalance"), "constant")


@query(
    """WITH d AS (SELECT lang, source, CASE WHEN n_chars < 1000 THEN 's' WHEN n_chars < 5000 THEN 'm' ELSE 'l' END AS size FROM documents), g AS (SELECT * FROM (SELECT DISTINCT lang FROM d), (SELECT DISTINCT source FROM d), (SELECT DISTINCT size FROM d))
SELECT lang, source, size, count(d.lang) AS n, CASE WHEN count(d.lang) = 0 THEN 'empty' WHEN count(d.lang) < 3 THEN 'thin' ELSE 'covered' END AS state FROM g LEFT JOIN d USING (lang, source, size) GROUP BY ALL"""
)
def a06_joint_cells(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("n_chars") < 1000, "s").when(F.col("n_chars") < 5000, "m").otherwise("l")
    return V.joint_cells(table(spark, sf, "documents").withColumn("size", size), ["lang", "source", "size"])


@query(
    "WITH a AS (SELECT count(DISTINCT l_partkey)::DECIMAL(38,0) AS p, count(DISTINCT l_suppkey)::DECIMAL(38,0) AS s, count(DISTINCT l_returnflag)::DECIMAL(38,0) AS m, count(DISTINCT l_shipdate)::DECIMAL(38,0) AS d FROM lineitem), c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag, l_shipdate) "
    "SELECT CAST(p * s * m * d AS VARCHAR) AS possible, (SELECT count(*) FROM c) AS observed, (SELECT count(*) FILTER (n < 3) FROM c) AS thin, (SELECT count(*) FILTER (n >= 3) FROM c) AS covered, CAST(p * s * m * d - (SELECT count(*) FROM c) AS VARCHAR) AS empty FROM a"
)
def a06_cell_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of four axes of lineitem, billions of them at larger factors."""
    out = V.cell_summary(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"])
    return out.select(F.col("possible").cast("string").alias("possible"), "observed", "thin", "covered", F.col("empty").cast("string").alias("empty"))


@query(
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(n) AS n, round(avg(v), 4) AS mean, max(CASE WHEN i = greatest(1, least(n, round_even(n * 0.01::DOUBLE + 0.5, 0))) THEN v END) AS p01, max(CASE WHEN i = greatest(1, least(n, round_even(n * 0.999::DOUBLE + 0.5, 0))) THEN v END) AS p999, max(v) AS max FROM r GROUP BY l_returnflag"""
)
def a14_price_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of prices, nearly all of them different, by return flag."""
    found = E.distribution(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], {"p01": 0.01, "p999": 0.999})
    return found.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), "p01", "p999", "max")


_EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS g, event_type AS d, event_id AS o, 'h' || hour(ts) AS k FROM events), ct AS (SELECT g, d, count(*) AS c, min(o) AS f FROM ev GROUP BY g, d), mj AS (SELECT g, arg_max(d, (c, -f)) AS majority, sum(c)::BIGINT AS n, max(c) AS m, count(*) AS dd FROM ct GROUP BY g)"


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("group_id"), F.col("event_type").alias("decision"), F.col("event_id").alias("ord"), F.concat(F.lit("h"), F.hour("ts")).alias("perturbation_kind"))


@query(f"WITH {_EVENTS} SELECT g AS group_id, majority, n, dd AS distinct, round(m / n, 6) AS share, dd = 1 AS consistent FROM mj WHERE n >= 2")
def a07_consistency_groups(spark: SparkSession, sf: str) -> DataFrame:
    return E.consistency_groups(_decisions(spark, sf), reference=None).select("group_id", "majority", "n", "distinct", *six("share"), "consistent")


@query(f"WITH {_EVENTS} SELECT count(*) AS groups, round(avg(CASE WHEN dd = 1 THEN 1.0 ELSE 0.0 END), 6) AS agreement_rate, round(avg(m / n), 6) AS mean_majority_share FROM mj WHERE n >= 2")
def a08_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return E.consistency(E.consistency_groups(_decisions(spark, sf), reference=None)).select("groups", *six("agreement_rate", "mean_majority_share"))


@query(f"WITH {_EVENTS} SELECT k AS kind, count(*) AS flips FROM ev JOIN mj USING (g) WHERE n >= 2 AND d <> majority GROUP BY k")
def a08_flips(spark: SparkSession, sf: str) -> DataFrame:
    rows = _decisions(spark, sf)
    return E.flips(rows, E.consistency_groups(rows, reference=None))


@query(f"WITH {_EVENTS} SELECT g AS group_id, majority, n, round(m / n, 6) AS share FROM mj")
def w03_majority(spark: SparkSession, sf: str) -> DataFrame:
    return E.majority(_decisions(spark, sf), "group_id", "decision", "ord").select("group_id", "majority", "n", *six("share"))


@query(
    f"""WITH {RECORDS}, i AS (SELECT avg(score) FILTER (split_tag = 'in_distribution') AS a, avg(score) FILTER (split_tag = 'ood') AS b, count(*) FILTER (split_tag = 'in_distribution') AS n_in, count(*) FILTER (split_tag = 'ood') AS n_ood FROM rec)
SELECT n_in, n_ood, round(a, 6) AS in_score, round(b, 6) AS ood_score, round(a - b, 6) AS gap, round((a - b) / a, 6) AS relative_gap, (SELECT ood_shift FROM rec WHERE split_tag = 'ood' GROUP BY ood_shift ORDER BY avg(score), ood_shift LIMIT 1) AS worst_shift FROM i"""
)
def a09_ood(spark: SparkSession, sf: str) -> DataFrame:
    return E.ood_report(bindings.records(spark, sf)).select("n_in", "n_ood", *six("in_score", "ood_score", "gap", "relative_gap"), "worst_shift")


@query(f"WITH {RECORDS} SELECT ood_shift, count(*) AS n, round(avg(score), 6) AS mean, round((SELECT avg(score) FROM rec WHERE split_tag = 'in_distribution') - avg(score), 6) AS gap FROM rec WHERE split_tag = 'ood' GROUP BY ood_shift")
def a09_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return E.shifts(bindings.records(spark, sf)).select("ood_shift", "n", *six("mean", "gap"))


@query(f"WITH {RECORDS} SELECT task, count(*) AS n, round(avg(base), 6) AS base, round(avg(tuned), 6) AS tuned, round(avg(tuned) - avg(base), 6) AS delta, (avg(tuned) - avg(base)) / avg(base) < -0.01 AS regressed FROM rec GROUP BY ROLLUP (task)")
def a11_capability(spark: SparkSession, sf: str) -> DataFrame:
    return E.capability_delta(_arms(spark, sf)).select("task", "n", *six("base", "tuned", "delta"), "regressed")


@query(f"WITH {RECORDS} SELECT task, subset, count(*) AS n, round(avg(score), 6) AS mean FROM rec GROUP BY GROUPING SETS ((), (task), (subset), (subset, task)) HAVING grouping(subset) = 1 OR subset IS NOT NULL")
def a12_corrected_block(spark: SparkSession, sf: str) -> DataFrame:
    return E.corrected_block(bindings.records(spark, sf)).select("task", "subset", "n", *six("mean"))


@query(
    """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(avg(v), 6) AS mean, max(CASE WHEN i = greatest(1, least(n, round_even(n * 0.5::DOUBLE + 0.5, 0))) THEN v END) AS p50, max(CASE WHEN i = greatest(1, least(n, round_even(n * 0.95::DOUBLE + 0.5, 0))) THEN v END) AS p95, max(v) AS max FROM r GROUP BY event_type"""
)
def a14_generation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return E.distribution(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", "n", *six("mean"), "p50", "p95", "max")


#: The hash tree over rows r of l: lists by as many digits as the number of rows asks for (up to four here), then sixteen at a time.
_TREE = (
    "e AS (SELECT sha256(h || ':' || n) AS h FROM (SELECT sha256(r) AS h, count(*) AS n FROM l GROUP BY 1)), k AS (SELECT CASE WHEN count(*) <= 1024 THEN 0 WHEN count(*) <= 16384 THEN 1 WHEN count(*) <= 262144 THEN 2 WHEN count(*) <= 4194304 THEN 3 ELSE 4 END AS d FROM e), "
    "t4 AS (SELECT left(h, d) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e, k GROUP BY ALL), "
    + ", ".join(f"t{i} AS (SELECT left(p, {i}) AS p, CASE WHEN max(len(p)) > {i} THEN sha256(string_agg(p || ':' || h, '' ORDER BY p)) ELSE max(h) END AS h FROM t{i + 1} GROUP BY 1)" for i in (3, 2, 1, 0))
    + " SELECT h AS sha256 FROM t0"
)


@query(f"""WITH l AS (SELECT DISTINCT '["' || doc_id || '","' || lang || '","' || source || '"]' AS r FROM documents), {_TREE}""")
def a15_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return R.targets_fingerprint(table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.col("lang").alias("task"), F.col("source").alias("reference_decision")))


@query(f"WITH l AS (SELECT lang || ':' || doc_id || ':' || sha256(text) AS r FROM documents), {_TREE}")
def a16_dataset_hash(spark: SparkSession, sf: str) -> DataFrame:
    return R.dataset_hash(table(spark, sf, "documents"), F.sha2("text", 256), "lang", "doc_id")


@query(f"WITH l AS (SELECT l_orderkey % 9 || ':' || l_partkey AS r FROM lineitem), {_TREE}")
def a16_repeated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of a table with repeated rows, as a tree of more than one level."""
    return orderstats.tree_hash(table(spark, sf, "lineitem").select(F.concat_ws(":", F.col("l_orderkey") % 9, "l_partkey").alias("row")), "row")


@query("SELECT o_orderstatus AS status, o_orderpriority AS model_family, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a20_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("model_family")))


@query("SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def a21_phase_medians(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.median("value").alias("median"))


@query("SELECT count(*) AS groups, count(*) FILTER (n = 1) AS singletons FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def a25_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.group_counts(table(spark, sf, "orders"), F.col("o_custkey"))


# windows and top-k


@query("SELECT axis, value, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY n DESC, value) AS place FROM (SELECT 'lang' AS axis, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source)) WHERE place <= 5")
def w09_top_values(spark: SparkSession, sf: str) -> DataFrame:
    return V.top_values(table(spark, sf, "documents"), ["lang", "source"]).select("axis", "value", "n", "place")


@query("SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang")
def w02_most_common(spark: SparkSession, sf: str) -> DataFrame:
    return V.most_common(table(spark, sf, "documents"), "lang", "doc_id")


@query("SELECT o_custkey, o_orderkey, o_orderkey % 50 = 0 OR (o_orderstatus <> 'P' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderkey DESC) <= 3) AS kept FROM orders")
def w06_prune(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return files.keep_newest(o, "o_orderkey", 3, F.col("o_orderstatus") != "P", F.col("o_orderkey") % 50 == 0, ["o_custkey"]).select("o_custkey", "o_orderkey", "kept")


@query("WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS task, o_orderkey % 3 <> 0 AS confident FROM orders), s AS (SELECT id FROM e QUALIFY row_number() OVER (PARTITION BY task ORDER BY id) <= 1 UNION (SELECT id FROM e WHERE NOT confident ORDER BY id LIMIT 2)) SELECT id FROM s")
def p09_suite(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), (F.col("o_orderkey") % 3 != 0).alias("confident"))
    return R.select_suite(e).select("id")


@query(f"WITH v AS (SELECT source AS v, count(*) AS n, {rank_sql('source', 42)} AS r FROM documents GROUP BY source), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY r, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM v) SELECT v AS value FROM b WHERE before < greatest(1, floor(total * 0.15::DOUBLE))")
def w01_holdout_values(spark: SparkSession, sf: str) -> DataFrame:
    return S.held_out(table(spark, sf, "documents"), C.holdout_value(F.col("source")), S.SplitConfig("domain_holdout"))


# splits


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id AS id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM d")
def d01_random_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_rows(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), S.SplitConfig("random"))


@query(f"WITH d AS (SELECT doc_id, {rank_sql('source', 42)} AS r FROM documents) SELECT doc_id AS id, CASE WHEN r < 0.7::DOUBLE THEN 'train' WHEN r < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM d")
def d02_group_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"))
    return S.split_rows(rows, S.SplitConfig("group")).select("id", "split")


@query(
    f"""WITH v AS (SELECT source AS v, count(*) AS n, {rank_sql('source', 42)} AS r FROM documents GROUP BY source), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY r, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM v), h AS (SELECT v FROM b WHERE before < greatest(1, floor(total * 0.15::DOUBLE))),
d AS (SELECT doc_id, source, {rank_sql("CAST(doc_id AS VARCHAR)", 42)} AS r FROM documents)
SELECT doc_id AS id, CASE WHEN source IN (SELECT v FROM h) THEN 'test' WHEN r < 0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE) THEN 'train' WHEN r < 0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE) + 0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM d"""
)
def d03_domain_holdout(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("domain"))
    return S.split_rows(rows, S.SplitConfig("domain_holdout")).select("id", "split")


@query(f"WITH d AS (SELECT {rank_sql('source', 42)} AS r FROM documents) SELECT count(*) FILTER (r < 0.7::DOUBLE) AS train, count(*) FILTER (r >= 0.7::DOUBLE AND r < 0.7::DOUBLE + 0.15::DOUBLE) AS validation, count(*) FILTER (r >= 0.7::DOUBLE + 0.15::DOUBLE) AS test, count(*) AS total FROM d")
def a27_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_counts(d02_group_split(spark, sf))


# scores of answers and rankings


@query(f"WITH p AS (SELECT l.doc_id, {answer_sql('l.text')} AS a, {answer_sql('r.text')} AS b FROM documents l JOIN documents r ON r.doc_id = l.doc_id + 1) SELECT doc_id, CAST(a = b AS INT)::DOUBLE AS exact FROM p")
def f26_exact(spark: SparkSession, sf: str) -> DataFrame:
    norm = lambda c: X.normalize_answer(F.col(c))
    return _neighbours(spark, sf).select("doc_id", M.exact_match(norm("a"), norm("b")).alias("exact"))


@query(
    f"""WITH p AS (SELECT l.doc_id, {answer_sql('l.text')} AS a, {answer_sql('r.text')} AS b FROM documents l JOIN documents r ON r.doc_id = l.doc_id + 1),
t AS (SELECT doc_id, 'a' AS side, unnest(string_split(a, ' ')) AS w FROM p UNION ALL SELECT doc_id, 'b', unnest(string_split(b, ' ')) FROM p),
c AS (SELECT doc_id, w, count(*) FILTER (side = 'a') AS x, count(*) FILTER (side = 'b') AS y FROM t WHERE w <> '' GROUP BY doc_id, w)
SELECT doc_id, round(CASE WHEN sum(x) = 0 OR sum(y) = 0 THEN CASE WHEN sum(x) = sum(y) THEN 1 ELSE 0 END ELSE 2 * sum(least(x, y)) / (sum(x) + sum(y)) END, 6) AS f1 FROM c GROUP BY doc_id"""
)
def f27_token_f1(spark: SparkSession, sf: str) -> DataFrame:
    norms = stored(table(spark, sf, "documents").select("doc_id", X.normalize_answer(F.col("text")).alias("a")), "norms")  # read twice; a pair's texts are shuffled once each
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), norms.count() // 10_000)
    after = norms.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    pairs = norms.repartition(tasks, "doc_id").join(after.repartition(tasks, "doc_id"), "doc_id")
    return pairs.select("doc_id", M.token_f1_long("a", "b").alias("f1")).select("doc_id", *six("f1"))


@query(
    f"""WITH {RANKS}, t AS (SELECT l_orderkey, count(*) FILTER (pr <= 3) AS p, count(*) FILTER (rr <= 2) AS r, count(*) FILTER (pr <= 3 AND rr <= 2) AS c FROM rk GROUP BY 1)
SELECT l_orderkey, round(c / p, 6) AS precision, round(c / r, 6) AS recall, round(2 * c / (p + r), 6) AS f1 FROM t"""
)
def f28_set_f1(spark: SparkSession, sf: str) -> DataFrame:
    s = bindings.rankings(spark, sf).select("l_orderkey", M.set_scores(F.slice("predicted", 1, 3), F.slice("reference", 1, 2)).alias("s"))
    return s.select("l_orderkey", "s.*").select("l_orderkey", *six("precision", "recall", "f1"))


@query(f"WITH {RANKS} SELECT l_orderkey, round(sum((n - rr + 1) / log2(pr + 1)) / sum((n - rr + 1) / log2(rr + 1)), 6) AS ndcg FROM rk GROUP BY 1")
def f29_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.rankings(spark, sf).select("l_orderkey", M.ndcg(F.col("predicted"), F.col("reference")).alias("ndcg")).select("l_orderkey", *six("ndcg"))


@query(f"WITH {RANKS} SELECT a.l_orderkey, round((sum(sign((a.pr - b.pr) * (a.rr - b.rr))) / count(*) + 1) / 2, 6) AS tau FROM rk a JOIN rk b ON a.l_orderkey = b.l_orderkey AND a.rr < b.rr GROUP BY 1")
def f30_kendall(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.rankings(spark, sf).select("l_orderkey", M.kendall_tau(F.col("predicted"), F.col("reference")).alias("tau")).select("l_orderkey", *six("tau"))


@query(f"WITH {RANKS} SELECT l_orderkey, round(greatest(0, 1 - sum(abs(pr - rr)) / (max(n) * max(n) // 2)), 6) AS footrule FROM rk GROUP BY 1")
def f31_footrule(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.rankings(spark, sf).select("l_orderkey", M.footrule(F.col("predicted"), F.col("reference")).alias("footrule")).select("l_orderkey", *six("footrule"))


@query(f"WITH {RANKS} SELECT l_orderkey, max(CASE WHEN pr = 1 AND rr = 1 THEN 1 ELSE 0 END)::DOUBLE AS top_1 FROM rk GROUP BY 1")
def f26_top_1(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.rankings(spark, sf).select("l_orderkey", M.top_1(F.col("predicted"), F.col("reference")).alias("top_1"))


# resampling


def _bootstrap_sql(cluster: str, value: str, source: str, b: int, seed: int = 42) -> str:
    draw = f"CAST('0x' || substr(sha256('{seed}:' || b || ':' || s), 1, 15) AS BIGINT) % n"
    return f"""WITH {RECORDS}, u AS (SELECT row_number() OVER (ORDER BY sha256(c), c) - 1 AS g, t, z FROM (SELECT CAST({cluster} AS VARCHAR) AS c, sum({value}) AS t, count(*) AS z FROM {source} GROUP BY 1)), k AS (SELECT count(*) AS n FROM u),
d AS (SELECT b, {draw} AS g FROM range({b}) x(b), k, range(n) y(s)), e AS (SELECT b, sum(t) / sum(z) AS est FROM d JOIN u USING (g) GROUP BY b), r AS (SELECT est, row_number() OVER (ORDER BY est) - 1 AS i FROM e), o AS (SELECT sum(t) / sum(z) AS ob, sum(z) AS n, count(*) AS clusters FROM u)
SELECT n::BIGINT AS n, clusters, round(ob, 6) AS observed, round(max(CASE WHEN i = {int(0.025 * b)} THEN est END), 6) AS ci_low, round(max(CASE WHEN i = {min(int(0.975 * b), b - 1)} THEN est END), 6) AS ci_high, least(1.0::DOUBLE, 2 * CASE WHEN ob >= 0 THEN count(*) FILTER (est <= 0) ELSE count(*) FILTER (est >= 0) END / {b}) AS p_value FROM r, o GROUP BY n, clusters, ob"""


BOOT = ["n", "clusters", "observed", "ci_low", "ci_high", "p_value"]


def _boot(df: DataFrame) -> DataFrame:
    return df.select("n", "clusters", *six("observed", "ci_low", "ci_high"), "p_value")


@query(_bootstrap_sql("example_id", "tuned - base", "rec", 2000))
def r01_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Paired differences, each drawn by itself."""
    return _boot(B.paired_bootstrap(_arms(spark, sf)))


@query(_bootstrap_sql("group_id", "score", "rec", 2000))
def r02_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return _boot(B.cluster_bootstrap(bindings.records(spark, sf), F.col("score"), "group_id"))


@query(_bootstrap_sql("group_id", "tuned - base", "rec", 2000))
def r03_paired_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return _boot(B.paired_cluster_bootstrap(_arms(spark, sf)))


def compare_sql(select: str, b: int = 2000, seed: int = 42) -> str:
    """What compare() finds, for a SELECT over its rows."""
    low, high = int(0.025 * b), min(int(0.975 * b), b - 1)
    return f"""WITH {RECORDS}, w AS (SELECT true AS overall, 'overall' AS task, group_id, base, tuned FROM rec UNION ALL SELECT false, task, group_id, base, tuned FROM rec),
p AS (SELECT overall, task, group_id AS c, sum(tuned - base) AS t, count(*) AS z, sum(base) AS sb, sum(tuned) AS st FROM w GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY overall, task ORDER BY sha256(c), c) - 1 AS g, count(*) OVER (PARTITION BY overall, task) AS k FROM p),
h AS (SELECT overall, task, sum(z)::BIGINT AS n, count(*) AS clusters, sum(sb) / sum(z) AS base, sum(st) / sum(z) AS tuned, sum(t) / sum(z) AS ob FROM p GROUP BY ALL),
d AS (SELECT overall, task, b, CAST('0x' || substr(sha256('{seed}:' || b || ':' || g), 1, 15) AS BIGINT) % k AS g FROM u, range({b}) x(b)),
e AS (SELECT d.overall, d.task, b, sum(t) / sum(z) AS est FROM d JOIN u ON d.overall = u.overall AND d.task = u.task AND d.g = u.g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY overall, task ORDER BY est) - 1 AS i FROM e),
f AS (SELECT overall, task, max(CASE WHEN i = {low} THEN est END) AS ci_low, max(CASE WHEN i = {high} THEN est END) AS ci_high, count(*) FILTER (est <= 0) AS below, count(*) FILTER (est >= 0) AS above FROM r GROUP BY ALL),
o AS (SELECT h.*, ci_low, ci_high, least(1.0::DOUBLE, 2 * CASE WHEN ob >= 0 THEN below ELSE above END / {b}) AS p_value FROM h JOIN f USING (overall, task)),
v AS (SELECT *, CASE WHEN abs(tuned - base) < 0.01 THEN 'no change' ELSE CASE WHEN tuned > base THEN 'improved' ELSE 'regressed' END || CASE WHEN p_value < 0.05 THEN '' ELSE ' (not significant)' END END AS verdict,
  CASE WHEN round_even(ci_low, 4) > 0 THEN 'better' WHEN round_even(ci_high, 4) < 0 THEN 'worse' WHEN round_even(ci_low, 4) >= -0.02 AND round_even(ci_high, 4) <= 0.02 THEN 'equivalent' ELSE 'inconclusive' END AS prim FROM o)
SELECT {select} FROM v"""


# extraction and graders


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer and a reference for every ranked order, for one of the six graders by turns."""
    k = F.col("l_orderkey")
    listed, even = F.to_json("predicted"), k % 2 == 0
    label = F.when(even, "scope").otherwise("deadline")
    said = {
        "exact_match": F.when(even, "The  Scope!").otherwise("deadline"),
        "classification": F.concat(F.lit("It is the "), label, F.lit(".")),
        "set_match": F.to_json(F.slice("predicted", 1, 3)),
        "ranking": F.concat(F.lit("```json\n{\"ranking\": "), listed, F.lit("}\n```")),
        "policy": F.concat(F.lit("{\"ranking\": "), listed, F.lit(", \"decided_by\": \""), label, F.lit("\", \"confident\": "), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("}")),
        "heuristic_rubric": F.concat(F.lit("You should "), F.when(even, "obviously ").otherwise(""), F.lit("start with point one [evidence-7].")),
    }
    grader = F.element_at(F.array(*[F.lit(g) for g in said]), (k % 6 + 1).cast("int"))
    answer = F.element_at(F.array(*said.values()), (k % 6 + 1).cast("int"))
    reference = F.struct(F.lit("scope").alias("text"), F.lit("scope").alias("label"), F.array(F.lit("deadline"), F.lit("scope")).alias("options"), F.slice("reference", 1, 2).alias("items"), F.col("reference").alias("ranking"), F.lit(True).alias("confident"), F.array(F.lit("point one"), F.lit("point two")).alias("required_points"), F.array(F.lit("never")).alias("forbidden_points"), F.array(F.lit("evidence-7")).alias("evidence_ids"), F.lit(None).cast("string").alias("expected_decision"))
    return bindings.rankings(spark, sf).select(k.alias("id"), answer.alias("response"), grader.alias("grader"), reference.alias("reference"))


_GRADES = f"""WITH {RANKS}, s AS (
  SELECT l_orderkey AS id, sum((n - rr + 1) / log2(pr + 1)) / sum((n - rr + 1) / log2(rr + 1)) AS ndcg, max(CASE WHEN pr = 1 AND rr = 1 THEN 1.0 ELSE 0.0 END) AS top,
    count(*) FILTER (pr <= 3) AS p, count(*) FILTER (rr <= 2) AS r, count(*) FILTER (pr <= 3 AND rr <= 2) AS c FROM rk GROUP BY 1
), b AS (SELECT *, {{w}}::DOUBLE * ndcg + (1 - {{w}}::DOUBLE) * top AS blend, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END AS even FROM s)
SELECT id, ['exact_match', 'classification', 'set_match', 'ranking', 'policy', 'heuristic_rubric'][(id % 6 + 1)::INT] AS grader, round(CASE id % 6 WHEN 0 THEN even WHEN 1 THEN even WHEN 2 THEN 2 * c / (p + r) WHEN 3 THEN blend WHEN 4 THEN (blend + even + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) / 3 ELSE 0.8 - 0.068 * even END, 6) AS score, false AS parse_failed FROM b"""


@query(_GRADES.format(w=NDCG_WEIGHT))
def g_graders(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.graders import grade

    return grade(_answers(spark, sf)).select("id", "grader", *six("score"), "parse_failed")


@query()
def f33_faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.extract import faithfulness

    empty = F.array().cast("array<string>")
    d = _neighbours(spark, sf).select("doc_id", faithfulness(F.col("a"), F.col("b"), empty, empty).alias("f"))
    return d.select("doc_id", "f.*").select("doc_id", *six("evidence_coverage", "citation_precision", "unsupported_claim_rate", "score"))
