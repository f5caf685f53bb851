"""Queries of advisory matching over line items as an inventory and parts as advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions import versions as V
from lakeaudit.jobs import adapters as A
from lakeaudit.jobs.register import query
from lakeaudit.operators import advisories as D

# Plain versions as lists of numbers: they order alike in all families.
_P = lambda c: f"list_transform(string_split({c}, '.'), lambda x: CAST(x AS BIGINT))"
_QUERYABLE = "NOT coalesce(local_workspace, FALSE) AND coalesce(source, 'registry') NOT IN ('git', 'local', 'url')"
A.view("triples", f"SELECT DISTINCT ecosystem, name, version FROM dependencies WHERE {_QUERYABLE}", "dependencies")
_NORM = lambda e, n: f"CASE split_part({e}, ':', 1) WHEN 'PyPI' THEN translate(lower({n}), '_.', '--') WHEN 'npm' THEN lower({n}) ELSE {n} END"
A.view(
    "matched",
    f"""SELECT DISTINCT d.ecosystem, d.name, d.version, a.id AS advisory_id, 'affected' AS verdict FROM triples d JOIN advisories a ON {_NORM('d.ecosystem', 'd.name')} = {_NORM('a.ecosystem', 'a.package')} AND split_part(d.ecosystem, ':', 1) = a.ecosystem
  WHERE a.withdrawn IS NULL AND {_P('d.version')} >= {_P('a.introduced')} AND {_P('d.version')} < {_P('a.fixed')}""",
    "triples", "advisories",
)


def advisories(spark, sf_dir) -> DataFrame:
    return _ranged(A.advisories(spark, sf_dir))


def _ranged(a: DataFrame) -> DataFrame:
    """The advisories with ranges as OSV writes them; an introduced 0.0.0 is written as 0."""
    event = lambda **k: F.struct(*(k.get(n, F.lit(None).cast("string")).alias(n) for n in ("introduced", "fixed", "last_affected", "limit")))
    start = F.when(F.col("introduced") == "0.0.0", "0").otherwise(F.col("introduced"))
    events = F.array(event(introduced=start), event(fixed=F.col("fixed")))
    kind = F.when(F.col("ecosystem") == "npm", "SEMVER").otherwise("ECOSYSTEM")
    return a.withColumn("aliases", F.array("alias")).withColumn("versions", F.array().cast("array<string>")).withColumn("ranges", F.array(F.struct(kind.alias("type"), events.alias("events"))))


def _matches(spark, sf_dir) -> DataFrame:
    return D.match_advisories(A.dependencies(spark, sf_dir), advisories(spark, sf_dir))


@query("match_advisories", A.oracle("SELECT * FROM matched", "matched"))
def match_advisories(spark, sf_dir) -> DataFrame:
    return _matches(spark, sf_dir)


# Versions of every kind: prereleases, and texts that have no place. Their order is that of [major, minor, patch, release or not, candidate].
_ANY_DEPS = """CASE WHEN o_orderkey % 2 = 0 THEN 'npm' ELSE 'crates.io' END AS ecosystem, concat('lib-', CAST(o_orderkey % 200 AS STRING)) AS name, CASE WHEN o_custkey % 7 = 0 THEN concat('nightly-', CAST(o_custkey % 3 AS STRING)) WHEN o_custkey % 3 = 0 THEN concat(CAST(o_custkey % 7 AS STRING), '.', CAST(o_custkey % 10 AS STRING), '.0-rc.', CAST(o_custkey % 13 AS STRING)) ELSE concat(CAST(o_custkey % 7 AS STRING), '.', CAST(o_custkey % 10 AS STRING), '.0') END AS version"""
_ANY_FIXED = "CASE WHEN p_partkey % 11 = 0 THEN 'soon' WHEN p_size % 3 = 0 THEN concat(fixed, '-rc.', CAST(p_partkey % 13 AS STRING)) ELSE fixed END"
A.view("any_deps", f"SELECT DISTINCT {_ANY_DEPS.replace('AS STRING', 'AS VARCHAR')}, CASE WHEN o_custkey % 7 <> 0 THEN [o_custkey % 7, o_custkey % 10, 0, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 13 ELSE 0 END] END AS place FROM orders")
A.view(
    "any_advisories",
    f"SELECT a.*, {_ANY_FIXED.replace('AS STRING', 'AS VARCHAR')} AS any_fixed, list_concat({_P('introduced')}, CAST([1, 0] AS BIGINT[])) AS low, CASE WHEN p_partkey % 11 <> 0 THEN list_concat({_P('fixed')}, CAST([CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN p_size % 3 = 0 THEN p_partkey % 13 ELSE 0 END] AS BIGINT[])) END AS high FROM advisories a JOIN part ON id = 'ADV-' || p_partkey",
    "advisories",
)
A.view(
    "any_matched",
    """SELECT DISTINCT d.ecosystem, d.name, d.version, a.id AS advisory_id, CASE WHEN d.place IS NULL OR a.high IS NULL THEN 'undetermined' ELSE 'affected' END AS verdict FROM any_deps d JOIN any_advisories a ON a.ecosystem = d.ecosystem AND a.package = d.name
  WHERE a.withdrawn IS NULL AND (d.place IS NULL OR a.high IS NULL OR ((introduced = '0.0.0' OR d.place >= a.low) AND d.place < a.high))""",
    "any_deps", "any_advisories",
)


def any_advisories(spark, sf_dir) -> DataFrame:
    """The advisories, some fixed by a prerelease and some by a version without a place."""
    own = A.project(spark, sf_dir, "part", f"*, {A.ADVISORIES}").withColumn("fixed", F.expr(_ANY_FIXED))
    return _ranged(own)


def _any_deps(spark, sf_dir) -> DataFrame:
    return A.project(spark, sf_dir, "orders", _ANY_DEPS).withColumns({"source": F.lit(None).cast("string"), "local_workspace": F.lit(False)})


@query("match_any_versions", A.oracle("SELECT * FROM any_matched", "any_matched"))
def match_any_versions(spark, sf_dir) -> DataFrame:
    return D.match_advisories(_any_deps(spark, sf_dir), any_advisories(spark, sf_dir))


@query("match_notes", A.oracle("""SELECT count(*) FILTER (verdict = 'affected') AS affected, count(*) FILTER (verdict = 'undetermined') AS undetermined, array_to_string(list(DISTINCT ecosystem || '/' || name || '@' || version ORDER BY ecosystem || '/' || name || '@' || version) FILTER (verdict = 'undetermined')[:5], ',') AS examples,
  (SELECT count(*) FROM any_advisories a WHERE withdrawn IS NOT NULL AND EXISTS (FROM any_deps d WHERE d.ecosystem = a.ecosystem AND d.name = a.package)) AS withdrawn, (SELECT count(*) FROM any_advisories a WHERE withdrawn IS NULL AND CAST(substr(id, 5) AS BIGINT) % 6 = 0 AND EXISTS (FROM any_deps d WHERE d.ecosystem = a.ecosystem AND d.name = a.package)) AS git_ranges FROM any_matched""", "any_matched"))  # fmt: skip
def match_notes(spark, sf_dir) -> DataFrame:
    deps, adv = _any_deps(spark, sf_dir), any_advisories(spark, sf_dir)
    git = F.when(F.substring("id", 5, 20).cast("long") % 6 == 0, F.array(F.struct(F.lit("GIT").alias("type"), F.col("ranges")[0]["events"].alias("events"))))
    adv = adv.withColumn("ranges", F.concat("ranges", F.coalesce(git, F.slice("ranges", 1, 0))))
    return D.match_notes(D.match_advisories(deps, adv)).join(F.broadcast(D.skipped_evidence(deps, adv)))


@query("range_verdict", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN 'undetermined' WHEN CAST(l_quantity AS INT) < 20 AND CAST(l_quantity AS INT) >= l_linenumber THEN 'affected' ELSE 'not_affected' END AS verdict FROM lineitem")
def range_verdict(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    version = F.when(F.col("l_partkey") % 10 == 0, F.lit("not a version")).otherwise(F.concat(q, F.lit(".0.0")))
    events = F.to_json(F.array(F.struct(F.lit("20.0.0").alias("fixed"), F.lit(None).cast("string").alias("introduced")), F.struct(F.lit(None).cast("string").alias("fixed"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0.0")).alias("introduced"))))
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.range_verdict(F.lit("semver"), version, events).alias("verdict"))


@query("compare_versions", "SELECT p_partkey, CASE WHEN (p_size % 7, p_partkey % 5) < (p_partkey % 6, p_size % 4) THEN -1 WHEN (p_size % 7, p_partkey % 5) = (p_partkey % 6, p_size % 4) THEN 0 ELSE 1 END AS ordering FROM part")
def compare_versions(spark, sf_dir) -> DataFrame:
    v = lambda a, b: F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("0"))
    family = F.element_at(F.array(*map(F.lit, V.FAMILIES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select("p_partkey", V.compare_versions(family, v(F.col("p_size") % 7, F.col("p_partkey") % 5), v(F.col("p_partkey") % 6, F.col("p_size") % 4)).alias("ordering"))


@query("version_satisfies", "SELECT p_partkey, ((p_size % 7, p_partkey % 5) >= (1, 2) AND (p_size % 7, p_partkey % 5) < (2, 0)) OR (p_size % 7 >= 4 AND (p_size % 7, p_partkey % 5) <> (5, 1)) AS ok FROM part")
def version_satisfies(spark, sf_dir) -> DataFrame:
    v = F.concat_ws(".", (F.col("p_size") % 7).cast("string"), (F.col("p_partkey") % 5).cast("string"), F.lit("0"))
    return A.table(spark, sf_dir, "part").select("p_partkey", V.version_satisfies(v, "^1.2 || >=4, !=5.1.0").alias("ok"))


@query("classify_change", "SELECT p_partkey, CASE WHEN p_size % 7 <> p_partkey % 6 THEN 'major' WHEN p_partkey % 5 <> p_size % 4 THEN 'minor' ELSE 'unknown' END AS change FROM part")
def classify_change(spark, sf_dir) -> DataFrame:
    v = lambda a, b: F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("0"))
    return A.table(spark, sf_dir, "part").select("p_partkey", V.classify_change(v(F.col("p_size") % 7, F.col("p_partkey") % 5), v(F.col("p_partkey") % 6, F.col("p_size") % 4)).alias("change"))


@query("missing_coverage", A.oracle("SELECT DISTINCT ecosystem FROM triples WHERE ecosystem <> 'npm' AND split_part(ecosystem, ':', 1) NOT IN (SELECT ecosystem FROM advisories WHERE ecosystem <> 'PyPI')", "triples", "advisories"))
def missing_coverage(spark, sf_dir) -> DataFrame:
    return D.missing_coverage(A.dependencies(spark, sf_dir), A.advisories(spark, sf_dir).where("ecosystem <> 'PyPI'"))


@query("advisory_db_counts", A.oracle("SELECT count(DISTINCT id) AS advisories, count(DISTINCT (ecosystem, package)) AS packages FROM advisories", "advisories"))
def advisory_db_counts(spark, sf_dir) -> DataFrame:
    return D.advisory_db_counts(A.advisories(spark, sf_dir))


@query("queryable", A.oracle(f"SELECT ecosystem, name, version, count(*) AS n FROM dependencies WHERE {_QUERYABLE} GROUP BY ALL", "dependencies"))
def queryable(spark, sf_dir) -> DataFrame:
    return D.queryable(A.dependencies(spark, sf_dir)).groupBy(*D.TRIPLE).agg(F.count("*").alias("n"))


@query("dedupe_dependencies", A.oracle("SELECT ecosystem, name, version, min(run_id) AS run_id FROM dependencies GROUP BY ALL", "dependencies"))
def dedupe_dependencies(spark, sf_dir) -> DataFrame:
    return D.dedupe_dependencies(A.dependencies(spark, sf_dir), ["run_id"]).select(*D.TRIPLE, "run_id")


def _feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = A.table(spark, sf_dir, "customer")
    cve = F.concat(F.lit("CVE-2024-"), (F.col("c_custkey") % 1000 + 1000).cast("string"))
    kev = c.where("c_custkey % 7 = 0").select(cve.alias("cve"), (F.col("c_custkey") % 2 == 0).alias("ransomware"))
    epss = c.where("c_custkey % 3 = 0").select(cve.alias("cve"), (F.col("c_acctbal") / 10000).alias("epss"))
    return kev, epss, c.where("c_custkey % 11 = 0").select(cve.alias("cve"))


@query("enrich_exploit", """WITH c AS (SELECT 'CVE-2024-' || (c_custkey % 1000 + 1000) AS cve, * FROM customer), v AS (SELECT 'ADV-' || p_partkey AS id, 'CVE-2024-' || (p_partkey % 1300 + 1000) AS cve FROM part)
  SELECT id, cve, cve IN (SELECT cve FROM c WHERE c_custkey % 7 = 0) AS known_exploited, coalesce((SELECT max(c_custkey % 2 = 0) FROM c WHERE c_custkey % 7 = 0 AND c.cve = v.cve), FALSE) AS ransomware, (SELECT max(c_acctbal / 10000) FROM c WHERE c_custkey % 3 = 0 AND c.cve = v.cve) AS epss, cve IN (SELECT cve FROM c WHERE c_custkey % 11 = 0) AS public_exploit FROM v""")  # fmt: skip
def enrich_exploit(spark, sf_dir) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    vulns = p.select(F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.lit("GHSA-x"), F.concat(F.lit("CVE-2024-"), (F.col("p_partkey") % 1300 + 1000).cast("string"))).alias("aliases"))
    return D.enrich_exploit(vulns, *_feeds(spark, sf_dir)).select("id", "cve", "known_exploited", "ransomware", "epss", "public_exploit")


@query("enrich_cwe", "SELECT l_orderkey, l_linenumber, 'CWE-' || (l_partkey % 40) AS cwe, coalesce(n, 0) AS exploited_cves, coalesce(n, 0) > 0 AS exploited FROM lineitem LEFT JOIN (SELECT w, count(DISTINCT c_custkey) AS n FROM (SELECT c_custkey, unnest([c_custkey % 30, c_nationkey]) AS w FROM customer) GROUP BY w) ON w = l_partkey % 40")
def enrich_cwe(spark, sf_dir) -> DataFrame:
    cwe = lambda c: F.concat(F.lit("CWE-"), c.cast("string"))
    kev = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cve"), F.array(cwe(F.col("c_custkey") % 30), cwe(F.col("c_nationkey"))).alias("cwes"))
    return D.enrich_cwe(A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cwe(F.col("l_partkey") % 40).alias("cwe")), kev)


_USAGE = {"npm": r"(?:^|\s)(th[a-z]+) ", "PyPI": r"(?:^|\s)(en[a-z]+)\."}


@query("usage_index", A.oracle("SELECT ecosystem, project_id, name, count(DISTINCT path) AS files, min(path) AS first_path FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS ecosystem, project_id, path, unnest(list_distinct(regexp_extract_all(content, '{p}', 1))) AS name FROM corpus" for e, p in _USAGE.items()) + ") GROUP BY ALL", "corpus"))
def usage_index(spark, sf_dir) -> DataFrame:
    return D.usage_index(A.corpus(spark, sf_dir), _USAGE)


_IMPORTED = "concat('th', substr(p_name, 1, 2)) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'Go' ELSE 'npm' END AS ecosystem, concat('src', CAST(p_partkey % 20 AS STRING)) AS project_id, p_partkey AS vuln_id"


@query("direct_usage", A.oracle(f"WITH used AS (SELECT DISTINCT project_id, unnest(list_distinct(regexp_extract_all(content, '{_USAGE['npm']}', 1))) AS name FROM corpus) SELECT vuln_id, v.ecosystem, CASE WHEN v.ecosystem = 'Go' THEN NULL ELSE u.name IS NOT NULL END AS used FROM (SELECT {_IMPORTED.replace('AS STRING', 'AS VARCHAR')} FROM part UNION ALL SELECT 'the', 'npm', source, doc_id FROM documents UNION ALL SELECT 'zzzz', 'npm', source, -doc_id FROM documents) v LEFT JOIN used u USING (project_id, name)", "corpus"))
def direct_usage(spark, sf_dir) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    asked = A.project(spark, sf_dir, "part", _IMPORTED).unionByName(docs.selectExpr("'the' AS name", "'npm' AS ecosystem", "source AS project_id", "doc_id AS vuln_id")).unionByName(docs.selectExpr("'zzzz' AS name", "'npm' AS ecosystem", "source AS project_id", "-doc_id AS vuln_id"))
    return D.direct_usage(asked, D.usage_index(A.corpus(spark, sf_dir), _USAGE), ["npm", "PyPI"]).select("vuln_id", "ecosystem", "used")


# A source of several languages for each part, and what it may import: each line is read as each language.
_SOURCE = """concat('p', CAST(p_partkey % 50 AS STRING)) AS project_id, concat('f', CAST(p_partkey AS STRING)) AS path, p_size % 7 AS k,
    concat('import x from "@Scope/lib-', CAST(p_size % 7 AS STRING), '/deep"; require("./own"); ', chr(10), 'from Lib', CAST(p_size % 5 AS STRING), '_X.sub import y', chr(10), 'use my_crate', CAST(p_size % 3 AS STRING), '::z; use crate::a;', chr(10), 'import "host.example/m', CAST(p_size % 2 AS STRING), '/v2"', chr(10)) AS content"""
_IMPORTS = " UNION ALL ".join(
    f"SELECT '{e}' AS ecosystem, 'p' || (p_partkey % 50) AS project_id, 'f' || p_partkey AS path, {n} AS name FROM part"
    for e, n in (("npm", "'@scope/lib-' || (p_size % 7)"), ("PyPI", "'lib' || (p_size % 5) || '_x'"), ("crates.io", "'my_crate' || (p_size % 3)"), ("Go", "unnest(['host.example', 'host.example/m' || (p_size % 2), 'host.example/m' || (p_size % 2) || '/v2'])"), ("npm", "'host.example'"), ("PyPI", "'x'"))
)


@query("import_usage", f"SELECT ecosystem, project_id, name, count(DISTINCT path) AS files, min(path) AS first_path FROM ({_IMPORTS}) GROUP BY ALL")
def import_usage(spark, sf_dir) -> DataFrame:
    return D.usage_index(A.project(spark, sf_dir, "part", _SOURCE))


@query("referenced_functions", A.oracle("""WITH w AS (SELECT DISTINCT 'src' || (doc_id % 20) AS project_id, regexp_extract(text, '[a-z]{7,}') AS fn FROM documents) SELECT DISTINCT w.project_id, fn AS function FROM w JOIN corpus c ON c.project_id = w.project_id AND contains(content, fn) WHERE fn <> ''""", "corpus"))
def referenced_functions(spark, sf_dir) -> DataFrame:
    """The first long word of every document as a function that some project is asked for."""
    wanted = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("project_id"), F.regexp_extract("text", "[a-z]{7,}", 0).alias("function"))
    return D.referenced_functions(wanted, A.corpus(spark, sf_dir))


# Advisories are named by their id or an alias of it, packages by their coordinates or a purl; some claims name no package, some another's advisory.
_CLAIMED = "concat('LIB-', CAST(o_orderkey % 200 AS STRING), '@', CAST(o_custkey % 7 + 1 AS STRING), '.', CAST(o_custkey % 10 AS STRING), '.0')"
_CLAIMS = f"o_orderkey AS record_id, concat('doc', CAST(o_custkey % 10 AS STRING)) AS document, concat(CASE WHEN o_orderkey % 5 = 0 THEN 'GHSA-' ELSE 'ADV-' END, CAST(o_orderkey % 2000 AS STRING)) AS vulnerability_id, CASE WHEN o_orderstatus = 'F' THEN 'affected' ELSE 'not_affected' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('pkg:npm/', {_CLAIMED}) ELSE concat('npm:', {_CLAIMED}) END AS subject"
A.view("claims", f"SELECT {_CLAIMS.replace('AS STRING', 'AS VARCHAR')} FROM orders")


@query("vex_suggestions", A.oracle(f"""WITH known AS (SELECT *, unnest([advisory_id, 'GHSA-' || substr(advisory_id, 5)]) AS vuln FROM matched),
  hits AS (SELECT DISTINCT c.*, k.advisory_id, k.ecosystem, k.name, k.version FROM claims c JOIN known k ON lower(c.vulnerability_id) = lower(k.vuln) AND lower(c.subject) IN (lower(k.ecosystem || ':' || k.name || '@' || k.version), lower('pkg:' || k.ecosystem || '/' || k.name || '@' || k.version)) WHERE document <> 'doc3')
  SELECT record_id, document, 'suggested' AS outcome, NULL AS reason, advisory_id, ecosystem, name, version FROM hits WHERE status = 'not_affected'
  UNION ALL SELECT record_id, document, 'unmapped', CASE WHEN subject IS NULL THEN '{D.NO_SUBJECT}' ELSE '{D.NO_MATCH}' END, NULL, NULL, NULL, NULL FROM claims WHERE document <> 'doc3' AND record_id NOT IN (SELECT record_id FROM hits)
  UNION ALL SELECT record_id, document, 'untrusted', NULL, NULL, NULL, NULL, NULL FROM claims WHERE document = 'doc3'""", "claims", "matched"))  # fmt: skip
def vex_suggestions(spark, sf_dir) -> DataFrame:
    claims = A.project(spark, sf_dir, "orders", _CLAIMS).withColumn("subject_ids", F.array_compact(F.array("subject")))
    grants = claims.select("document").distinct().where("document <> 'doc3'")
    return D.vex_suggestions(claims, grants, _matches(spark, sf_dir).withColumn("aliases", F.array(F.concat(F.lit("GHSA-"), F.substring("advisory_id", 5, 20)))))


@query("advisory_decision", A.oracle("""SELECT m.ecosystem, m.name, m.version, m.advisory_id, CASE WHEN live.state IS NOT NULL THEN live.state WHEN late THEN 'expired' END AS decision FROM matched m LEFT JOIN
  (SELECT m2.ecosystem, m2.name, m2.version, m2.advisory_id, arg_max(e.state, e.position) FILTER (e.position % 3 <> 0) AS state, bool_or(e.position % 3 = 0) AS late FROM matched m2 JOIN entries e ON lower(e.vuln) = lower(m2.advisory_id) AND (e.version IS NULL OR e.version = m2.version) GROUP BY ALL) live USING (ecosystem, name, version, advisory_id)""".replace("FROM matched m LEFT", "FROM matched m LEFT"), "matched").replace("WITH ", "WITH entries AS (SELECT s_suppkey AS position, 'adv-' || (s_suppkey % 60 + 1) AS vuln, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 7 + 1) || '.' || (s_suppkey % 10) || '.0' END AS version, 'state' || (s_suppkey % 4) AS state FROM supplier), ", 1))  # fmt: skip
def advisory_decision(spark, sf_dir) -> DataFrame:
    s = A.table(spark, sf_dir, "supplier")
    entries = s.selectExpr("s_suppkey AS position", "concat('adv-', s_suppkey % 60 + 1) AS vuln", "cast(null as string) AS ecosystem", "cast(null as string) AS package", "CASE WHEN s_suppkey % 2 = 0 THEN concat(s_suppkey % 7 + 1, '.', s_suppkey % 10, '.0') END AS version", "concat('state', s_suppkey % 4) AS state", "CASE WHEN s_suppkey % 3 = 0 THEN timestamp '2020-01-01' END AS expires_at")
    vulns = _matches(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>"))
    return D.advisory_decision(vulns, entries, F.lit("2024-01-01").cast("timestamp")).select(*D.TRIPLE, "advisory_id", "decision")


@query("new_advisories_vs_baseline", A.oracle("SELECT ecosystem, name, version, advisory_id FROM matched WHERE CAST(substr(advisory_id, 5) AS BIGINT) % 3 <> 0", "matched"))
def new_advisories_vs_baseline(spark, sf_dir) -> DataFrame:
    m = _matches(spark, sf_dir)
    return D.new_advisories_vs_baseline(m, m.where(F.substring("advisory_id", 5, 20).cast("long") % 3 == 0))


@query("baseline_problems", A.oracle("SELECT * FROM (SELECT DISTINCT project_id AS baseline_id, CASE project_id % 5 WHEN 4 THEN 'not a complete report' WHEN 1 THEN 'counts disagree' WHEN 2 THEN 'counts disagree' WHEN 3 THEN 'query counts disagree' ELSE CASE WHEN project_id % 10 = 5 THEN 'advisory outside the inventory' END END AS problem FROM dependencies) WHERE problem IS NOT NULL", "dependencies"))
def baseline_problems(spark, sf_dir) -> DataFrame:
    """Each project's inventory as a baseline whose summary is off by one, in a way that its id tells."""
    deps = A.dependencies(spark, sf_dir).withColumn("baseline_id", F.col("project_id"))
    own = deps.select("baseline_id", *D.TRIPLE, "lockfile").distinct()
    vulns = own.withColumn("version", F.when(F.col("baseline_id") % 10 == 5, "0").otherwise(F.col("version"))).withColumn("advisory_id", F.lit("ADV-1"))
    off = lambda k: (F.col("baseline_id") % 5 == k).cast("long")
    kept = (F.col("source") != "git") & ~F.col("local_workspace")
    triple = F.struct(*D.TRIPLE)
    counts = deps.groupBy("baseline_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(kept, triple)).alias("q"), F.countDistinct(*D.TRIPLE, "lockfile").alias("v"))
    coverage = F.when(F.col("baseline_id") % 5 == 4, "partial").otherwise("complete")
    told = counts.select("baseline_id", F.lit(1).alias("schema_version"), F.lit("dependencies").alias("kind"), coverage.alias("advisory_coverage"), (F.col("n") + off(1)).alias("packages_found"), (F.col("q") + off(3)).alias("packages_queried"), (F.col("v") + off(2)).alias("vulnerabilities_found"))
    return D.baseline_problems(told, deps, vulns)


A.view("reported", "SELECT DISTINCT run_id, ecosystem, name, version, 'CVE-2024-' || (run_id % 300) AS reported_id FROM dependencies", "dependencies")


A.view("unreported", """SELECT DISTINCT d.run_id, m.* FROM dependencies d JOIN matched m USING (ecosystem, name, version) JOIN advisories a ON a.id = m.advisory_id WHERE NOT EXISTS (FROM reported r WHERE r.run_id = d.run_id AND r.ecosystem = m.ecosystem AND r.name = m.name AND r.version = m.version AND r.reported_id IN (m.advisory_id, a.alias))""", "matched", "reported")


def _reported(spark, sf_dir) -> DataFrame:
    return A.dependencies(spark, sf_dir).select("run_id", *D.TRIPLE, F.concat(F.lit("CVE-2024-"), (F.col("run_id") % 300).cast("string")).alias("reported_id")).distinct()


@query("monitor", A.oracle("SELECT * FROM unreported", "unreported"))
def monitor(spark, sf_dir) -> DataFrame:
    return D.monitor(A.dependencies(spark, sf_dir), advisories(spark, sf_dir), _reported(spark, sf_dir))


@query("monitor_runs", A.oracle(f"""SELECT run_id, components, coalesce(affected, 0) AS affected, 0 AS undetermined, coverage_error FROM (SELECT run_id, count(DISTINCT (ecosystem, name, version)) AS components, min(ecosystem) FILTER (split_part(ecosystem, ':', 1) = 'crates.io') AS coverage_error FROM dependencies WHERE {_QUERYABLE} GROUP BY run_id)
  LEFT JOIN (SELECT run_id, count(*) AS affected FROM unreported WHERE ecosystem <> 'crates.io' GROUP BY run_id) USING (run_id)""", "unreported", "dependencies"))  # fmt: skip
def monitor_runs(spark, sf_dir) -> DataFrame:
    deps, adv = A.dependencies(spark, sf_dir), advisories(spark, sf_dir).where("ecosystem <> 'crates.io'")
    return D.monitor_runs(deps, adv, D.monitor_counts(deps, adv, _reported(spark, sf_dir)))


# Releases in npm's and PyPI's orders, with prereleases, epochs and texts that have no place; the oracle orders them by the numbers they are made of.
_RELEASES = """CASE WHEN p_partkey % 3 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, CASE WHEN p_partkey % 3 = 0 THEN concat('Lib_', CAST((p_partkey * 4 + 1) % 200 AS STRING)) ELSE concat('lib-', CAST(p_partkey % 200 AS STRING)) END AS name,
    CASE WHEN p_partkey % 37 = 0 THEN concat('nightly-', CAST(p_size AS STRING)) WHEN p_partkey % 3 = 0 THEN concat(CASE WHEN p_partkey % 7 = 0 THEN '1!' ELSE '' END, CAST(p_size % 8 AS STRING), '.', CAST(p_partkey % 10 AS STRING), '.0', CASE WHEN p_size % 4 = 0 THEN concat('rc', CAST(p_partkey % 13 AS STRING)) ELSE '' END) ELSE concat(CAST(p_size % 8 AS STRING), '.', CAST(p_partkey % 10 AS STRING), '.0', CASE WHEN p_size % 4 = 0 THEN concat('-rc.', CAST(p_partkey % 13 AS STRING)) ELSE '' END) END AS version,
    p_size % 5 = 0 AS is_default, p_size % 11 = 0 AS deprecated"""
A.view(
    "releases",
    f"SELECT {_RELEASES.replace('AS STRING', 'AS VARCHAR')}, TIMESTAMP '2020-01-01' + to_days(CAST(p_partkey % 1000 AS INT)) AS published_at, CASE WHEN p_partkey % 37 <> 0 THEN [CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 = 0 THEN 1 ELSE 0 END, p_size % 8, p_partkey % 10, 0, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN p_size % 4 = 0 THEN p_partkey % 13 ELSE 0 END] END AS place, CASE WHEN p_partkey % 37 <> 0 AND NOT (p_partkey % 3 = 0 AND (p_partkey % 7 = 0)) THEN p_size % 8 END AS major FROM part",
)
_INSTALLED = "CASE WHEN s_suppkey % 3 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, CASE WHEN s_suppkey % 3 = 0 THEN concat('Lib_', CAST((s_suppkey * 4 + 1) % 200 AS STRING)) ELSE concat('lib-', CAST(s_suppkey % 200 AS STRING)) END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'main' WHEN s_suppkey % 3 = 0 THEN concat('1!', CAST(s_suppkey % 8 AS STRING), '.1.0rc', CAST(s_suppkey % 9 AS STRING)) ELSE concat(CAST(s_suppkey % 8 AS STRING), '.1.0-rc.', CAST(s_suppkey % 9 AS STRING)) END AS version"
A.view(
    "placed",
    f"""SELECT DISTINCT ecosystem, name, version, [0, {_P('version')}[1], {_P('version')}[2], 0, 1, 0] AS place, {_P('version')}[1] AS major FROM dependencies
  UNION ALL SELECT DISTINCT {_INSTALLED.replace('AS STRING', 'AS VARCHAR')}, CASE WHEN s_suppkey % 5 <> 0 THEN [CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END, s_suppkey % 8, 1, 0, 0, s_suppkey % 9] END, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 THEN s_suppkey % 8 END FROM supplier""",
    "dependencies",
)
A.view(
    "released",
    """SELECT d.ecosystem, d.name, d.version, e.published_at, e.deprecated, p.default_version, p.newest_at, CASE WHEN d.place IS NOT NULL THEN (SELECT count(*) FROM releases r WHERE r.ecosystem = d.ecosystem AND r.name = d.name AND r.place > d.place) END AS newer, greatest(0, p.default_major - d.major) + CASE WHEN d.major IS NULL THEN NULL ELSE 0 END + CASE WHEN p.default_major IS NULL THEN NULL ELSE 0 END AS majors_behind FROM placed d
  LEFT JOIN (SELECT ecosystem, name, version, min(published_at) AS published_at, max(deprecated) AS deprecated FROM releases GROUP BY ALL) e USING (ecosystem, name, version) LEFT JOIN (SELECT ecosystem, name, max(version) FILTER (is_default) AS default_version, arg_max(major, version) FILTER (is_default AND major IS NOT NULL AND version = dv) AS default_major, max(published_at) AS newest_at FROM (SELECT *, max(version) FILTER (is_default) OVER (PARTITION BY ecosystem, name) AS dv FROM releases) GROUP BY ALL) p USING (ecosystem, name)""",
    "placed", "releases",
)


def releases(spark, sf_dir) -> DataFrame:
    return A.project(spark, sf_dir, "part", f"{_RELEASES}, timestamp '2020-01-01' + make_dt_interval(cast(p_partkey % 1000 as int)) AS published_at")


@query("release_facts", A.oracle("SELECT * FROM released", "released"))
def release_facts(spark, sf_dir) -> DataFrame:
    own = A.dependencies(spark, sf_dir).select(*D.TRIPLE).unionByName(A.project(spark, sf_dir, "supplier", _INSTALLED))
    return D.release_facts(own, releases(spark, sf_dir))


@query("os_advisory_keys", "SELECT s_suppkey, CASE WHEN d = 'Debian' THEN 'src-' || (s_suppkey % 9) ELSE s_name END AS filed_name, unnest(CASE WHEN d = 'Red Hat' THEN ['Red Hat:9:appstream', 'Red Hat:9:baseos'] ELSE [d || ':9'] END) AS ecosystem FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'Debian' WHEN 1 THEN 'Alpine' ELSE 'Red Hat' END AS d FROM supplier)")
def os_advisory_keys(spark, sf_dir) -> DataFrame:
    p = A.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN 'Debian' WHEN 1 THEN 'Alpine' ELSE 'Red Hat' END AS distro", "'9' AS release", "s_name AS name", "concat('src-', s_suppkey % 9) AS source_name")
    return D.os_advisory_keys(p, {"Red Hat": ["appstream", "baseos"]}, ["Debian"]).select("s_suppkey", "filed_name", "ecosystem")


@query("advisory_policy_inputs", A.oracle("SELECT run_id, d.ecosystem, d.name, d.version, d.lockfile, count(*) AS n, coalesce(any_value(array_to_string(v.ids, ',')), '') AS advisories FROM dependencies d LEFT JOIN (SELECT ecosystem, name, version, list(advisory_id ORDER BY advisory_id) AS ids FROM matched GROUP BY ALL) v ON v.ecosystem = d.ecosystem AND v.name = d.name AND v.version = d.version AND d.lockfile = 'lock1' WHERE NOT coalesce(local_workspace, FALSE) GROUP BY ALL", "dependencies", "matched"))
def advisory_policy_inputs(spark, sf_dir) -> DataFrame:
    # Occurrences are counted before they get their advisories, whose lists are then never shuffled, and dealt out once for both, by package version.
    deps = A.dependencies(spark, sf_dir).select("run_id", *D.TRIPLE, "lockfile", "local_workspace").repartition(*D.TRIPLE).groupBy("run_id", *D.TRIPLE, "lockfile", F.coalesce("local_workspace", F.lit(False)).alias("local_workspace")).agg(F.count("*").alias("n"))
    out = D.advisory_policy_inputs(deps, _matches(spark, sf_dir).withColumn("lockfile", F.lit("lock1")))
    return out.select("run_id", *D.TRIPLE, "lockfile", "n", F.array_join("advisories", ",").alias("advisories"))


@query("upgrade_groups", A.oracle(f"""WITH v AS (SELECT m.*, a.low, a.high, a.introduced, a.any_fixed FROM any_matched m JOIN any_advisories a ON a.id = m.advisory_id),
  g AS (SELECT ecosystem, name, version, count(*) AS advisories, bool_and(verdict = 'affected') AS certain FROM v GROUP BY ALL), f AS (SELECT DISTINCT v.ecosystem, v.name, v.version, v.any_fixed AS fix, v.high AS fix_place FROM v JOIN any_deps d USING (ecosystem, name, version) WHERE v.high > d.place),
  ok AS (SELECT f.* FROM f JOIN g USING (ecosystem, name, version) WHERE certain AND NOT EXISTS (FROM v WHERE v.ecosystem = f.ecosystem AND v.name = f.name AND v.version = f.version AND (v.introduced = '0.0.0' OR f.fix_place >= v.low) AND f.fix_place < v.high)),
  best AS (SELECT ecosystem, name, version, arg_min(fix, fix_place) AS candidate, min(fix_place) AS place FROM ok GROUP BY ALL)
  SELECT ecosystem, name, version, advisories, candidate, CASE WHEN candidate IS NULL THEN NULL WHEN b.place[1] <> d.place[1] THEN 'major' WHEN b.place[2] <> d.place[2] THEN 'minor' ELSE 'patch' END AS change FROM g LEFT JOIN best b USING (ecosystem, name, version) JOIN any_deps d USING (ecosystem, name, version)""", "any_matched"))  # fmt: skip
def upgrade_groups(spark, sf_dir) -> DataFrame:
    adv = any_advisories(spark, sf_dir)
    met = D.match_advisories(_any_deps(spark, sf_dir), adv).withColumn("lockfile", F.lit("l"))
    return D.upgrade_groups(met, adv.select(F.col("id").alias("advisory_id"), "ranges")).drop("lockfile")
