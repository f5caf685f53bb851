"""Queries of the run lifecycle over orders as runs and line items as findings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.jobs import adapters as A
from lakeaudit.jobs.register import query
from lakeaudit.operators import lifecycle as L
from lakeaudit.operators import pages

A.view("coverage", "SELECT DISTINCT l_orderkey AS run_id, concat('src/f', CAST((l_partkey + l_linenumber) % 23 AS VARCHAR), '.py') AS path, CASE WHEN l_linestatus = 'O' THEN 'source' ELSE 'secrets' END AS family FROM lineitem")
A.view("pairs", "SELECT c.run_id, arg_max(b.run_id, (b.completed_at, b.run_id)) AS baseline_run_id FROM runs c JOIN runs b ON c.project_id = b.project_id AND c.fingerprint_version = b.fingerprint_version AND b.status = 'completed' AND b.completed_at < c.started_at AND list_has_any(c.families, b.families) GROUP BY c.run_id", "runs")
A.view(
    "diff",
    """SELECT p.run_id, f.run_id AS observation_run_id, f.fingerprint_version, f.fingerprint, f.rule_id, f.severity, f.category, f.path, CASE WHEN EXISTS (FROM findings b WHERE b.run_id = p.baseline_run_id AND b.fingerprint = f.fingerprint) THEN 'unchanged' ELSE 'new' END AS diff_status FROM pairs p JOIN findings f USING (run_id)
  UNION ALL SELECT p.run_id, p.baseline_run_id, f.fingerprint_version, f.fingerprint, f.rule_id, f.severity, f.category, f.path, CASE WHEN EXISTS (FROM coverage c WHERE c.run_id = p.run_id AND c.path = f.path AND c.family = f.category) THEN 'resolved' ELSE 'notEvaluated' END FROM pairs p JOIN findings f ON f.run_id = p.baseline_run_id WHERE NOT EXISTS (FROM findings c WHERE c.run_id = p.run_id AND c.fingerprint = f.fingerprint)""",
    "pairs", "findings", "coverage",
)
_REVIEWS = """event_id AS id, user_id % 20 AS project_id, concat('fp', CAST(user_id AS STRING)) AS fingerprint, CASE WHEN event_id % 3 = 0 THEN 'projectPolicy' ELSE 'local' END AS origin, CASE event_type WHEN 'click' THEN 'candidate' WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'falsePositive' ELSE 'confirmed' END AS state, ts AS updated_at,
  CASE WHEN event_id % 4 = 0 THEN CAST('2020-01-01 00:00:00' AS TIMESTAMP) END AS expires_at, CASE WHEN event_id % 5 = 0 THEN ts END AS superseded_at"""
A.view("reviews", f"SELECT {_REVIEWS.replace('AS STRING', 'AS VARCHAR')} FROM events")


def _coverage(spark, sf_dir) -> DataFrame:
    return A.project(spark, sf_dir, "lineitem", "l_orderkey AS run_id, concat('src/f', CAST((l_partkey + l_linenumber) % 23 AS STRING), '.py') AS path, CASE WHEN l_linestatus = 'O' THEN 'source' ELSE 'secrets' END AS family")


def _diff(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs = A.runs(spark, sf_dir)
    pairs = L.latest_compatible_baseline(runs)
    return runs, pairs, L.compare_runs(pairs, A.findings(spark, sf_dir), _coverage(spark, sf_dir))


def _reviews(spark, sf_dir) -> DataFrame:
    return A.project(spark, sf_dir, "events", _REVIEWS)


@query("latest_run_per_target", A.oracle("SELECT project_id, run_id, completed_at FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, run_id DESC) = 1", "runs"))
def latest_run_per_target(spark, sf_dir) -> DataFrame:
    return L.latest_run_per_target(A.runs(spark, sf_dir).where(F.col("status") == "completed")).select("project_id", "run_id", "completed_at")


@query("latest_compatible_baseline", A.oracle("SELECT * FROM pairs", "pairs"))
def latest_compatible_baseline(spark, sf_dir) -> DataFrame:
    return L.latest_compatible_baseline(A.runs(spark, sf_dir))


@query("compare_runs", A.oracle("SELECT run_id, observation_run_id, fingerprint, diff_status, count(*) AS n FROM diff GROUP BY ALL", "diff"))
def compare_runs(spark, sf_dir) -> DataFrame:
    return _diff(spark, sf_dir)[2].groupBy("run_id", "observation_run_id", "fingerprint", "diff_status").agg(F.count("*").alias("n"))


# Packs that a run held, by its parts; the hashes of a tenth of them go by the line's status.
_PACKS = "l_orderkey AS run_id, concat('pack', CAST(l_partkey % 7 % 3 AS STRING)) AS pack_id, CASE WHEN l_suppkey % 10 = 0 THEN l_linestatus ELSE 'same' END AS hash"
A.view("packs", f"SELECT {_PACKS.replace('AS STRING', 'AS VARCHAR')} FROM lineitem")


@query("compare_runs_packs", A.oracle("""WITH held AS (SELECT run_id, pack_id, list(DISTINCT hash ORDER BY hash) AS hashes FROM packs GROUP BY ALL), seen AS (SELECT d.run_id, d.observation_run_id, 'pack' || (CAST(substr(rule_id, 6) AS BIGINT) % 3) AS pack_id, diff_status FROM diff d)
  SELECT s.run_id, s.observation_run_id, s.pack_id, CASE WHEN diff_status = 'resolved' AND NOT coalesce(a.hashes = b.hashes, FALSE) THEN 'notEvaluated' ELSE diff_status END AS diff_status, count(*) AS n FROM seen s LEFT JOIN held a ON a.run_id = s.run_id AND a.pack_id = s.pack_id LEFT JOIN held b ON b.run_id = s.observation_run_id AND b.pack_id = s.pack_id GROUP BY ALL""", "diff", "packs"))  # fmt: skip
def compare_runs_packs(spark, sf_dir) -> DataFrame:
    """As compare_runs, with rules that belong to packs."""
    packed = A.findings(spark, sf_dir).withColumn("rule_id", F.concat(F.lit("pack"), F.substring("rule_id", 6, 20).cast("long") % 3, F.lit("/"), "rule_id"))
    diff = L.compare_runs(L.latest_compatible_baseline(A.runs(spark, sf_dir)), packed, _coverage(spark, sf_dir), A.project(spark, sf_dir, "lineitem", _PACKS))
    return diff.groupBy("run_id", "observation_run_id", F.split("rule_id", "/")[0].alias("pack_id"), "diff_status").agg(F.count("*").alias("n"))


@query("refused_pairs", A.oracle("""SELECT * FROM (SELECT p.run_id, p.baseline_run_id, CASE WHEN c.run_id IS NULL OR b.run_id IS NULL THEN 'missing run' WHEN c.status <> 'completed' OR b.status <> 'completed' THEN 'not completed' WHEN c.project_id <> b.project_id THEN 'another project' WHEN NOT b.completed_at < c.started_at THEN 'baseline not prior' WHEN NOT list_has_any(c.families, b.families) THEN 'no family in common' END AS problem
  FROM (SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey ELSE o_orderkey + 1 END AS baseline_run_id FROM orders UNION ALL SELECT run_id, baseline_run_id FROM pairs) p LEFT JOIN runs c ON c.run_id = p.run_id LEFT JOIN runs b ON b.run_id = p.baseline_run_id) WHERE problem IS NOT NULL""", "runs", "pairs"))  # fmt: skip
def refused_pairs(spark, sf_dir) -> DataFrame:
    """Each run asked against itself or the next one, and against its baseline."""
    runs = A.runs(spark, sf_dir)
    asked = A.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey ELSE o_orderkey + 1 END AS baseline_run_id")
    return L.refused_pairs(asked.unionByName(L.latest_compatible_baseline(runs)), runs)


@query("run_history", A.oracle("""SELECT run_id, project_id, baseline_run_id, CASE WHEN status = 'completed' THEN coalesce(total, 0) ELSE 0 END AS total, CASE WHEN status = 'completed' THEN coalesce(new, 0) ELSE 0 END AS new, CASE WHEN status = 'completed' THEN coalesce(resolved, 0) ELSE 0 END AS resolved,
  CASE WHEN status = 'completed' THEN coalesce(critical, 0) ELSE 0 END AS critical, CASE WHEN status = 'completed' THEN coalesce(high, 0) ELSE 0 END AS high FROM runs LEFT JOIN (SELECT run_id, count(*) FILTER (diff_status IN ('new', 'unchanged')) AS total, count(*) FILTER (diff_status = 'new') AS new, count(*) FILTER (diff_status = 'resolved') AS resolved,
  count(*) FILTER (diff_status IN ('new', 'unchanged') AND severity = 'critical') AS critical, count(*) FILTER (diff_status IN ('new', 'unchanged') AND severity = 'high') AS high FROM diff GROUP BY run_id) USING (run_id) LEFT JOIN pairs USING (run_id)""", "diff", "runs"))  # fmt: skip
def run_history(spark, sf_dir) -> DataFrame:
    runs, pairs, diff = _diff(spark, sf_dir)
    return L.run_history(pairs, runs, diff)


@query("compare_reports", A.oracle("""SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.fingerprint, b.fingerprint) AS fingerprint, coalesce(a.line, b.line) AS line, CASE WHEN b.rule_id IS NULL THEN 'introduced' WHEN a.rule_id IS NULL THEN 'no_longer_observed' ELSE 'unchanged' END AS status
  FROM (SELECT DISTINCT rule_id, fingerprint, line FROM findings WHERE seen_at >= TIMESTAMP '1996-01-01') a FULL JOIN (SELECT DISTINCT rule_id, fingerprint, line FROM findings WHERE seen_at < TIMESTAMP '1996-01-01') b USING (rule_id, fingerprint, line)""", "findings"))  # fmt: skip
def compare_reports(spark, sf_dir) -> DataFrame:
    f = A.findings(spark, sf_dir)
    new = F.col("seen_at") >= F.lit("1996-01-01").cast("timestamp")
    return L.compare_reports(f.where(new), f.where(~new), ["rule_id", "fingerprint", "line"])


@query("latest_observations", A.oracle("SELECT project_id, fingerprint, run_id, severity FROM findings JOIN runs USING (run_id) WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY completed_at DESC, run_id DESC, number, severity) = 1", "findings", "runs"))
def latest_observations(spark, sf_dir) -> DataFrame:
    return L.latest_observations(A.findings(spark, sf_dir), A.runs(spark, sf_dir)).select("project_id", "fingerprint", "run_id", "severity")


@query("active_review", A.oracle("SELECT project_id, fingerprint, id, state, origin FROM reviews WHERE superseded_at IS NULL AND state <> 'candidate' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-06-01') QUALIFY row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY origin = 'local' DESC, updated_at DESC, id DESC) = 1", "reviews"))
def active_review(spark, sf_dir) -> DataFrame:
    return L.active_review(_reviews(spark, sf_dir), F.lit("2024-06-01").cast("timestamp")).select("project_id", "fingerprint", "id", "state", "origin")


@query("review_timeline", A.oracle("""SELECT id, fingerprint, origin, state, updated_at, lead(updated_at) OVER (PARTITION BY project_id, fingerprint, origin ORDER BY updated_at, id) AS superseded_at FROM (SELECT *, lag(state) OVER (PARTITION BY project_id, fingerprint, origin ORDER BY updated_at, id) AS before FROM reviews)
  WHERE NOT (origin = 'projectPolicy' AND coalesce(before = state, state = 'candidate'))""", "reviews"))  # fmt: skip
def review_timeline(spark, sf_dir) -> DataFrame:
    return L.review_timeline(_reviews(spark, sf_dir).drop("superseded_at")).select("id", "fingerprint", "origin", "state", "updated_at", "superseded_at")


@query("retention", A.oracle("""SELECT run_id, young AND (row_number() OVER (PARTITION BY project_id, young ORDER BY protected DESC, completed_at DESC, run_id DESC) <= 3 OR protected) AS keep FROM
  (SELECT *, run_id % 50 = 0 AS protected, completed_at >= TIMESTAMP '1998-08-02' - INTERVAL 900 DAY OR run_id % 50 = 0 AS young FROM runs WHERE status = 'completed')""", "runs"))  # fmt: skip
def retention(spark, sf_dir) -> DataFrame:
    return L.retention(A.runs(spark, sf_dir).withColumn("protected", F.col("run_id") % 50 == 0), F.lit("1998-08-02").cast("timestamp"), 3, 900)


_VIEW = "CASE WHEN diff_status = 'resolved' THEN 'resolved' WHEN rule_id = 'rule-1' THEN 'otherScopes' WHEN rule_id IN ('rule-2', 'rule-3') THEN 'closed' ELSE 'open' END"


def _projection(spark, sf_dir) -> DataFrame:
    scope = F.when(F.col("rule_id") == "rule-1", "test").otherwise("production")
    state = F.when(F.col("rule_id") == "rule-2", "accepted").when(F.col("rule_id") == "rule-3", "falsePositive").otherwise("confirmed")
    return _diff(spark, sf_dir)[2].withColumn("view", L.finding_view(scope, state, F.col("diff_status")))


@query("finding_view", A.oracle(f"SELECT {_VIEW} AS view, rule_id, count(*) AS n FROM diff GROUP BY ALL", "diff"))
def finding_view(spark, sf_dir) -> DataFrame:
    return _projection(spark, sf_dir).groupBy("view", "rule_id").agg(F.count("*").alias("n"))


@query("view_diff_counts", A.oracle(f"SELECT run_id, view, diff_status, count(*) AS n FROM (SELECT *, {_VIEW} AS view FROM diff) GROUP BY CUBE (run_id, view, diff_status) HAVING run_id IS NOT NULL", "diff"))
def view_diff_counts(spark, sf_dir) -> DataFrame:
    return L.view_diff_counts(_projection(spark, sf_dir))


_RANKED = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"


@query("findings_page", A.oracle(f"SELECT run_id, number, severity, path, line FROM findings WHERE category = 'secrets' AND {_RANKED} >= 3 AND contains(lower(rule_id || chr(10) || path), 'f1') ORDER BY {_RANKED} DESC, path, line, run_id, number LIMIT 100 OFFSET 200", "findings"))
def findings_page(spark, sf_dir) -> DataFrame:
    return L.findings_page(A.findings(spark, sf_dir), "severity", 200, 100, "medium", "secrets", "F1").select("run_id", "number", "severity", "path", "line")


@query("page_totals", A.oracle("SELECT count(*) AS total, count(*) FILTER (severity = 'high' AND rule_id <> 'rule-1' AND path IN ('src/f1.py', 'src/f2.py') AND contains(lower(rule_id || chr(10) || fingerprint), '2')) AS filtered FROM findings", "findings"))
def page_totals(spark, sf_dir) -> DataFrame:
    f = A.findings(spark, sf_dir).withColumns({"scope": F.when(F.col("rule_id") == "rule-1", "test").otherwise("production")})
    return L.page_totals(f, severity="High", scopes=("production",), paths=("src/f1.py", "src/f2.py"), text="2", fields=("rule_id", "fingerprint"))


@query("keyset_page", A.oracle("SELECT run_id, number, severity FROM findings WHERE (run_id, number) > (5000, 2) ORDER BY run_id, number LIMIT 100", "findings"))
def keyset_page(spark, sf_dir) -> DataFrame:
    return L.keyset_page(A.findings(spark, sf_dir), (5000, 2), ["run_id", "number"], 100).select("run_id", "number", "severity")


@query("triage_order", A.oracle(f"SELECT run_id, number, rule_id, severity FROM findings ORDER BY rule_id = 'rule-4' DESC, {_RANKED} DESC, path, line, run_id, number LIMIT 200", "findings"))
def triage_order(spark, sf_dir) -> DataFrame:
    return L.triage_order(A.findings(spark, sf_dir).withColumn("exploited", F.col("rule_id") == "rule-4"), 200).select("run_id", "number", "rule_id", "severity")


@query("severity_gate", A.oracle("SELECT run_id, count(*) FILTER (severity IN ('critical', 'high') AND rule_id <> 'rule-2') AS breaching, count(*) FILTER (severity IN ('critical', 'high') AND rule_id <> 'rule-2') > 0 AS failed FROM findings GROUP BY run_id", "findings"))
def severity_gate(spark, sf_dir) -> DataFrame:
    return L.severity_gate(A.findings(spark, sf_dir), ["run_id"], "high", F.col("rule_id") == "rule-2")


@query("latest_covering_snapshot", A.oracle("SELECT project_id, run_id FROM runs WHERE list_has_all(families, ['secrets']) AND completed_at < TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, run_id DESC) = 1", "runs"))
def latest_covering_snapshot(spark, sf_dir) -> DataFrame:
    snapshots = A.runs(spark, sf_dir).select("project_id", F.col("run_id").alias("snapshot_id"), F.col("families").alias("keys"), F.col("completed_at").alias("taken_at"))
    return L.latest_covering_snapshot(snapshots, ["secrets"], F.lit("1997-01-01").cast("timestamp")).select("project_id", F.col("snapshot_id").alias("run_id"))


@query("latest_covering_snapshots", A.oracle("""WITH s AS (SELECT run_id, project_id % 40 AS project_id, completed_at, list_concat(families, ['k' || (run_id % 5), 'm' || (run_id % 7)]) AS keys FROM runs), q AS (SELECT o_orderkey AS request_id, o_custkey % 40 AS project_id, CASE o_orderkey % 4 WHEN 0 THEN ['secrets'] WHEN 1 THEN ['k' || (o_orderkey % 6), 'source'] WHEN 2 THEN ['k' || (o_orderkey % 5), 'm' || (o_orderkey % 7), 'secrets'] ELSE ['m' || (o_orderkey % 8), 'source', 'secrets'] END AS wanted, o_orderdate AS before FROM orders)
  SELECT request_id, q.project_id, arg_max(run_id, (completed_at, run_id)) AS snapshot_id FROM q JOIN s ON q.project_id = s.project_id AND completed_at < before AND list_has_all(keys, wanted) GROUP BY ALL""", "runs"))  # fmt: skip
def latest_covering_snapshots(spark, sf_dir) -> DataFrame:
    """Orders as requests of several sets of keys against runs as snapshots."""
    k = lambda letter, by, n: F.concat(F.lit(letter), (F.col(by) % n).cast("string"))
    snapshots = A.runs(spark, sf_dir).select((F.col("project_id") % 40).alias("project_id"), F.col("run_id").alias("snapshot_id"), F.concat("families", F.array(k("k", "run_id", 5), k("m", "run_id", 7))).alias("keys"), F.col("completed_at").alias("taken_at"))
    o, kind = A.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    wanted = F.when(kind == 0, F.array(F.lit("secrets"))).when(kind == 1, F.array(k("k", "o_orderkey", 6), F.lit("source"))).when(kind == 2, F.array(k("k", "o_orderkey", 5), k("m", "o_orderkey", 7), F.lit("secrets"))).otherwise(F.array(k("m", "o_orderkey", 8), F.lit("source"), F.lit("secrets")))
    return L.latest_covering_snapshots(snapshots, o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 40).alias("project_id"), wanted.alias("wanted"), F.col("o_orderdate").alias("before")))


@query("ranked_page", A.oracle(f"SELECT run_id, number, severity, path, line, (SELECT count(*) FROM findings) AS total FROM findings ORDER BY {_RANKED} DESC, path, line, run_id, number LIMIT 50 OFFSET (SELECT count(*) * 9 // 10 FROM findings)", "findings"))
def ranked_page(spark, sf_dir) -> DataFrame:
    """A deep page, nine tenths down, of findings that are stored by rank."""
    folder, order = f"{A.shared_folder(spark)}/ranked-{uuid.uuid4().hex}", L.page_order("severity")
    pages.write_ranked(A.findings(spark, sf_dir).select("run_id", "number", "severity", "path", "line"), order, folder, 5_000)
    ranked = pages.Ranked(spark, folder, order)
    return ranked.page(ranked.total * 9 // 10, 50).withColumn("total", F.lit(ranked.total).cast("long"))


@query("union_missing", A.oracle("SELECT fingerprint, rule_id, path, line FROM (SELECT DISTINCT fingerprint, rule_id, path, line FROM findings WHERE seen_at >= TIMESTAMP '1996-01-01') UNION ALL SELECT fingerprint, rule_id, path, line FROM (SELECT DISTINCT fingerprint, rule_id, path, line FROM findings WHERE seen_at < TIMESTAMP '1996-01-01') b WHERE NOT EXISTS (FROM findings c WHERE seen_at >= TIMESTAMP '1996-01-01' AND c.fingerprint = b.fingerprint AND c.line = b.line)", "findings"))
def union_missing(spark, sf_dir) -> DataFrame:
    f, new = A.findings(spark, sf_dir), F.col("seen_at") >= F.lit("1996-01-01").cast("timestamp")
    own = lambda x: x.select("fingerprint", "rule_id", "path", "line").distinct()
    return L.union_missing(own(f.where(new)), own(f.where(~new)), ["fingerprint", "line"])


@query("reconcile_ids", "SELECT id, 'unsolicited' AS problem FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) UNION ALL SELECT l_partkey, 'conflicting' FROM lineitem GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT p_partkey, 'unevaluated' FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def reconcile_ids(spark, sf_dir) -> DataFrame:
    expected = A.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"))
    return L.reconcile_ids(expected, A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")))


@query("finding_blobs", "SELECT l_orderkey AS finding_id, l_partkey AS blob_id, p_name AS blob FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey WHERE o_orderstatus = 'F'")
def finding_blobs(spark, sf_dir) -> DataFrame:
    findings = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("finding_id"))
    links = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_partkey").alias("blob_id"))
    blobs = A.table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("blob_id"), F.col("p_name").alias("blob"))
    return L.finding_blobs(findings, links, blobs).select("finding_id", "blob_id", "blob")


_SUPPRESSED = [(1, "rule-1", "src/**", "suppressed"), (2, "rule-1", "f1?.py", "accepted"), (3, "rule-2", "/other/*.py", "suppressed"), (4, "rule-3", "*.py", "falsePositive")]


@query("apply_finding_policy", A.oracle("""SELECT run_id, number, path, coalesce(l.state, e.state, CASE WHEN rule_id = 'rule-1' AND regexp_matches(path, '/f1.\\.py$') THEN 'accepted' WHEN rule_id = 'rule-1' THEN 'suppressed' WHEN rule_id = 'rule-3' THEN 'falsePositive' END, 'candidate') AS state, CASE WHEN l.state IS NOT NULL THEN 'local' WHEN e.state IS NOT NULL OR rule_id IN ('rule-1', 'rule-3') THEN 'projectPolicy' END AS origin FROM findings JOIN runs USING (run_id)
  LEFT JOIN (SELECT c_custkey AS project_id, 'fp' || (c_custkey % 23) AS fingerprint, 'confirmed' AS state FROM customer WHERE c_custkey % 2 = 0) l USING (project_id, fingerprint) LEFT JOIN (SELECT 'fp' || (s_suppkey % 9) AS fingerprint, arg_min('state' || (s_suppkey % 5), s_suppkey) AS state FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1) e USING (fingerprint)""", "findings", "runs"))  # fmt: skip
def apply_finding_policy(spark, sf_dir) -> DataFrame:
    f = A.findings(spark, sf_dir).join(A.runs(spark, sf_dir).select("run_id", "project_id"), "run_id")
    reviews = A.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS project_id", "concat('fp', c_custkey % 23) AS fingerprint", "'confirmed' AS state")
    entries = A.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS position", "concat('fp', s_suppkey % 9) AS fingerprint", "concat('state', s_suppkey % 5) AS state", "CASE WHEN s_suppkey % 4 = 0 THEN timestamp '2020-01-01' END AS expires_at")
    return L.apply_finding_policy(f, reviews, entries, _SUPPRESSED, F.lit("2024-01-01").cast("timestamp")).select("run_id", "number", "path", "state", "origin")
