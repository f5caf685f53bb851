"""Queries of scoring, compliance, dependency paths, templates and binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.jobs import adapters as A
from lakeaudit.jobs.register import query
from lakeaudit.operators import quality as Q
from lakeaudit.operators import templates as M

_SCORES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


@query("score_suite", f"""WITH e AS (SELECT DISTINCT o_orderkey // 4 AS target, 'rule-' || (o_custkey % 7) AS rule_id, 1 + o_custkey % 2 AS minimum FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_orderkey // 4, o_custkey % 7 ORDER BY o_custkey % 2) = 1), a AS (SELECT DISTINCT o_orderkey // 4 AS target, 'rule-' || (o_custkey % 7) AS rule_id FROM orders WHERE o_orderstatus = 'P' AND (o_orderkey // 4, 'rule-' || (o_custkey % 7)) NOT IN (SELECT (target, rule_id) FROM e)),
  h AS (SELECT l_orderkey // 4 AS target, 'rule-' || (l_partkey % 9) AS rule_id, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT coalesce(w.rule_id, h.rule_id) AS rule_id, wanted, minimum, coalesce(n, 0) AS n FROM (SELECT *, TRUE AS wanted FROM e UNION ALL SELECT *, NULL, FALSE FROM a) w FULL JOIN h ON w.target = h.target AND w.rule_id = h.rule_id)
  SELECT rule_id, tp, fn, fp + CASE WHEN covered > 0 THEN collateral ELSE 0 END AS fp, collateral, {_SCORES.replace('fp', '(fp + CASE WHEN covered > 0 THEN collateral ELSE 0 END)')} FROM (SELECT rule_id, count(*) FILTER (wanted AND n >= minimum) AS tp, count(*) FILTER (wanted AND n < minimum) AS fn, count(*) FILTER (NOT wanted AND n > 0) AS fp, coalesce(sum(n) FILTER (wanted IS NULL), 0) AS collateral, count(wanted) AS covered FROM x GROUP BY rule_id)""")  # fmt: skip
def score_suite(spark, sf_dir) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").selectExpr("o_orderkey div 4 AS target", "concat('rule-', o_custkey % 7) AS rule_id", "cast(1 + o_custkey % 2 as int) AS minimum", "o_orderstatus AS s")
    e = o.where("s = 'F'").groupBy("target", "rule_id").agg(F.min("minimum").alias("minimum"))
    a = o.where("s = 'P'").select("target", "rule_id").distinct().join(e, ["target", "rule_id"], "left_anti")
    h = A.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 4 AS target", "concat('rule-', l_partkey % 9) AS rule_id")
    return Q.score_suite(e, a, h)


@query("score_labelled", f"""WITH x AS (SELECT lang AS category, quality = 0 AS vulnerable, lang <> 'es' AS covered, contains(text, '!!') OR contains(text, '***') AS hit FROM labels JOIN documents USING (doc_id)), g AS (SELECT covered, category, count(*) FILTER (vulnerable AND hit) AS tp, count(*) FILTER (NOT vulnerable AND hit) AS fp, count(*) FILTER (vulnerable AND NOT hit) AS fn, count(*) FILTER (NOT vulnerable AND NOT hit) AS tn FROM x GROUP BY GROUPING SETS ((covered, category), (covered)))
  SELECT *, {_SCORES}, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(round(tp / nullif(tp + fn, 0), 6) - round(fp / nullif(fp + tn, 0), 6), 6) AS youden FROM g""")  # fmt: skip
def score_labelled(spark, sf_dir) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    cases = A.table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), (F.col("quality") == 0).alias("vulnerable"), (F.col("lang") != "es").alias("covered"))
    return Q.score_labelled(cases, docs.where(F.contains("text", F.lit("!!")) | F.contains("text", F.lit("***"))).select(F.col("doc_id").alias("case_id")))


@query("judge_observations", """WITH e AS (SELECT o_custkey AS target, o_orderkey % 5 AS identity, count(*) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), a AS (SELECT l_suppkey AS target, CASE WHEN l_partkey % 8 = 7 THEN 0 ELSE l_partkey % 8 END AS identity, count(*) AS g FROM lineitem GROUP BY ALL)
  SELECT target, sum(least(coalesce(c, 0), coalesce(g, 0))) AS tp, sum(greatest(0, coalesce(c, 0) - coalesce(g, 0))) AS fn, sum(greatest(0, coalesce(g, 0) - coalesce(c, 0))) AS fp FROM e FULL JOIN a USING (target, identity) GROUP BY target""")  # fmt: skip
def judge_observations(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("target"), F.expr("o_orderkey % 5").alias("identity")).agg(F.count("*").alias("count"))
    a = A.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS target", "l_partkey % 8 AS identity")
    v = a.select("target").distinct().selectExpr("target", "bigint(7) AS variant", "bigint(0) AS identity")
    return Q.judge_observations(e, a, v)


def _quality(spark, sf_dir, where: str) -> DataFrame:
    return A.table(spark, sf_dir, "customer").where(where).groupBy(F.col("c_mktsegment").alias("category")).agg(F.floor(F.count("*") / 1000).alias("cases"), F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 6).alias("precision"), F.round(F.avg((F.col("c_nationkey") > 4).cast("double")), 6).alias("recall"))


_QUALITY = "SELECT c_mktsegment AS category, floor(count(*) / 1000) AS cases, round(avg(CAST(c_acctbal > 0 AS DOUBLE)), 6) AS precision, round(avg(CAST(c_nationkey > 4 AS DOUBLE)), 6) AS recall FROM customer WHERE {} GROUP BY ALL"


@query("compare_quality", f"""WITH n AS ({_QUALITY.format("c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING'")}), b AS ({_QUALITY.format("c_custkey % 2 = 1 AND c_mktsegment <> 'MACHINERY'")})
  SELECT category, round(coalesce(n.precision, 0) - coalesce(b.precision, 0), 6) AS precision_delta, round(coalesce(n.recall, 0) - coalesce(b.recall, 0), 6) AS recall_delta, CASE WHEN n.cases IS NULL THEN 'coverage-lost' WHEN b.cases IS NULL OR n.cases <> b.cases THEN 'population-changed' WHEN round(coalesce(n.precision, 0) - coalesce(b.precision, 0), 6) < -0.01 OR round(coalesce(n.recall, 0) - coalesce(b.recall, 0), 6) < -0.01 THEN 'regressed' ELSE 'passed' END AS status FROM n FULL JOIN b USING (category)""")  # fmt: skip
def compare_quality(spark, sf_dir) -> DataFrame:
    return Q.compare_quality(_quality(spark, sf_dir, "c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING'"), _quality(spark, sf_dir, "c_custkey % 2 = 1 AND c_mktsegment <> 'MACHINERY'"), 0.01)


_CONTROLS = [("C1", [[r"/tests/.*\.py$"], [r"/docs/"]], False), ("C2", [[r"/workflows/"], [r"\.rb$"]], False), ("C3", [[r"\.rb$"]], False), ("C4", [[r"/src/"]], True)]
_COMPLY = """WITH g(control_id, grp, n_groups, manual, pattern) AS (VALUES ('C1', 0, 2, FALSE, '/tests/.*\\.py$'), ('C1', 1, 2, FALSE, '/docs/'), ('C2', 0, 2, FALSE, '/workflows/'), ('C2', 1, 2, FALSE, '\\.rb$'), ('C3', 0, 1, FALSE, '\\.rb$'), ('C4', 0, 1, TRUE, '/src/')),
  m AS (SELECT control_id, grp, n_groups, manual, path FROM g LEFT JOIN corpus ON regexp_matches(path, pattern)), assessed AS (SELECT control_id, n_groups AS groups, count(DISTINCT grp) FILTER (path IS NOT NULL) AS matched, array_to_string(list(DISTINCT path ORDER BY path) FILTER (path IS NOT NULL)[:5], ',') AS evidence, manual FROM m GROUP BY control_id, n_groups, manual)"""


def _assessed(spark, sf_dir) -> DataFrame:
    controls = spark.createDataFrame(_CONTROLS, "control_id string, file_groups array<array<string>>, manual boolean")
    return Q.compliance_assess(controls, A.corpus(spark, sf_dir))


@query("compliance_assess", A.oracle(_COMPLY + " SELECT control_id, groups, matched, CASE WHEN manual THEN 'manualReview' WHEN matched = groups THEN 'supported' WHEN matched > 0 THEN 'partial' ELSE 'gap' END AS status, nullif(evidence, '') AS evidence FROM assessed", "corpus"))
def compliance_assess(spark, sf_dir) -> DataFrame:
    return _assessed(spark, sf_dir).select("control_id", "groups", "matched", "status", "evidence")


@query("compliance_summary", A.oracle(_COMPLY + ", s AS (SELECT CASE WHEN manual THEN 'manualReview' WHEN matched = groups THEN 'supported' WHEN matched > 0 THEN 'partial' ELSE 'gap' END AS status FROM assessed) SELECT supported, partial, gap, manual, least(100, floor((100 * supported + 50 * partial) / (supported + partial + gap))) AS score FROM (SELECT count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'gap') AS gap, count(*) FILTER (status = 'manualReview') AS manual FROM s)", "corpus"))
def compliance_summary(spark, sf_dir) -> DataFrame:
    return Q.compliance_summary(_assessed(spark, sf_dir))


A.view("dep_edges", "SELECT DISTINCT l_orderkey AS project, l_linenumber AS parent, l_linenumber + 1 + l_partkey % 2 AS child FROM lineitem")


def _dep_edges(spark, sf_dir) -> DataFrame:
    """The edges, made once: roots, nodes, chains and gaps all read them."""
    return A.cut(A.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS project", "bigint(l_linenumber) AS parent", "l_linenumber + 1 + l_partkey % 2 AS child").distinct())


@query("dependency_paths", A.oracle("""WITH RECURSIVE walk AS (SELECT project, CAST(min(parent) AS BIGINT) AS node, 0 AS depth, [CAST(min(parent) AS BIGINT)] AS chain FROM dep_edges GROUP BY project UNION ALL SELECT w.project, CAST(e.child AS BIGINT), w.depth + 1, list_append(w.chain, CAST(e.child AS BIGINT)) FROM walk w JOIN dep_edges e ON e.project = w.project AND e.parent = w.node WHERE NOT list_contains(w.chain, e.child))
  SELECT project, node, depth, array_to_string(chain, '/') AS chain FROM walk""", "dep_edges").replace("WITH dep_edges", "WITH RECURSIVE dep_edges", 1).replace(", RECURSIVE walk", ", walk"))  # fmt: skip
def dependency_paths(spark, sf_dir) -> DataFrame:
    """Every line item is an edge of its order's graph, from its line to one of the next two; the order's first line is the root."""
    edges = _dep_edges(spark, sf_dir)
    roots = edges.groupBy("project").agg(F.min("parent").alias("node"))
    return Q.dependency_paths(edges, roots, A.cut, max_paths=1_000_000).select("project", "node", "depth", F.array_join(F.col("chain").cast("array<string>"), "/").alias("chain"))


@query("path_status", A.oracle("""WITH first AS (SELECT project, min(parent) AS root FROM dep_edges GROUP BY ALL), walk AS (SELECT project, CAST(root AS BIGINT) AS node, 0 AS depth FROM first WHERE project % 7 <> 0 UNION ALL SELECT w.project, CAST(e.child AS BIGINT), w.depth + 1 FROM walk w JOIN dep_edges e ON e.project = w.project AND e.parent = w.node WHERE w.depth < 4),
  have AS (SELECT project, node, count(*) AS paths FROM walk GROUP BY ALL), deep AS (SELECT DISTINCT w.project FROM walk w JOIN dep_edges e ON e.project = w.project AND e.parent = w.node WHERE w.depth = 4), nodes AS (SELECT project, parent AS node FROM dep_edges UNION SELECT project, child FROM dep_edges)
  SELECT n.project, n.node, n.node = 3 AS own, coalesce(paths, 0) AS paths, CASE WHEN d.project IS NOT NULL THEN 'depth' END AS gap, CASE WHEN n.project % 7 = 0 THEN 'unavailable' WHEN paths > 0 AND d.project IS NOT NULL THEN 'partial' WHEN paths > 0 OR n.node = 3 THEN 'available' ELSE 'partial' END AS status
  FROM nodes n LEFT JOIN have h ON h.project = n.project AND h.node = n.node LEFT JOIN deep d ON d.project = n.project""", "dep_edges").replace("WITH dep_edges", "WITH RECURSIVE dep_edges", 1))  # fmt: skip
def path_status(spark, sf_dir) -> DataFrame:
    """The graphs of dependency_paths to a depth of 4; one order in seven has no roots."""
    edges = _dep_edges(spark, sf_dir)
    roots = edges.groupBy("project").agg(F.min("parent").alias("node")).where("project % 7 <> 0")
    nodes = edges.select("project", F.col("parent").alias("node")).unionByName(edges.select("project", F.col("child").alias("node"))).distinct().withColumn("own", F.col("node") == 3)
    paths = Q.dependency_paths(edges, roots, A.cut, max_depth=4, max_paths=1_000_000)
    return Q.path_status(nodes, edges, roots, paths, max_depth=4, max_paths=1_000_000)


TEMPLATES = [
    M.Template("has-article", (M.Matcher("word", ("<article>",)), M.Matcher("word", ('class="ad"',), negative=True)), "info"),
    M.Template("french-page", (M.Matcher("regex", (r'lang="fr"',)), M.Matcher("word", ("<h1>", "<nav>"), every=True), M.Matcher("size", (1,), negative=True, internal=True)), "low", every=True),
    M.Template("secure-host", (M.Matcher("regex", ("^https",), part="url"), M.Matcher("word", ("x",), part="headers", negative=True)), "medium"),
    M.Template("raw-bytes", (M.Matcher("binary", ("3c6e61763e",)),), "high"),
]


def _pages(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body"))


@query("match_templates", """SELECT page_id, 'has-article' AS template_id, 'info' AS severity, concat_ws(',', CASE WHEN contains(html, '<article>') THEN '0' END, CASE WHEN NOT contains(html, 'class="ad"') THEN '1' END) AS matched FROM pages WHERE contains(html, '<article>') OR NOT contains(html, 'class="ad"')
  UNION ALL SELECT page_id, 'french-page', 'low', '0,1' FROM pages WHERE contains(html, 'lang="fr"') AND contains(html, '<h1>') AND contains(html, '<nav>') UNION ALL SELECT page_id, 'secure-host', 'medium', '0' FROM pages WHERE url LIKE 'https%' UNION ALL SELECT page_id, 'raw-bytes', 'high', '0' FROM pages WHERE contains(html, '<nav>')""")  # fmt: skip
def match_templates(spark, sf_dir) -> DataFrame:
    return M.match_templates(_pages(spark, sf_dir), TEMPLATES, "page_id")


@query("extract_values", """SELECT DISTINCT page_id, 'host' AS name, regexp_extract(url, '://([a-z.]+)', 1) AS value FROM pages UNION ALL SELECT DISTINCT page_id, 'link', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages""")
def extract_values(spark, sf_dir) -> DataFrame:
    return M.extract_values(_pages(spark, sf_dir), {"host": ("url", "://([a-z.]+)", 1), "link": ("body", 'href="([^"]*)"', 1)}, "page_id")


@query("select_templates", "SELECT p_partkey AS template_id, CASE WHEN p_size % 5 = 0 THEN 'denial of service' WHEN p_size % 3 = 0 THEN 'excluded tag' WHEN NOT (p_size % 2 = 0) THEN 'no selected tag' WHEN p_brand = 'Brand#11' THEN 'severity not selected' END AS reason FROM part")
def select_templates(spark, sf_dir) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("p_size") % 5 == 0, "dos"), F.when(F.col("p_size") % 3 == 0, "fuzz"), F.when(F.col("p_size") % 2 == 0, "web")))
    t = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("template_id"), tags.alias("tags"), F.when(F.col("p_brand") == "Brand#11", "info").otherwise("high").alias("severity"))
    return M.select_templates(t, ["web"], ["high"], (), ["fuzz"])


@query("accepts_file", A.oracle("SELECT path, octet_length(encode(content)) <= 2000 AS by_default, octet_length(encode(content)) <= 5242880 AND (ends_with(path, '.py') OR ends_with(path, '.go')) AS by_list FROM corpus", "corpus"))
def accepts_file(spark, sf_dir) -> DataFrame:
    size = F.octet_length("content")
    return A.corpus(spark, sf_dir).select("path", M.accepts_file(F.col("path"), size, max_size=2000).alias("by_default"), M.accepts_file(F.col("path"), size, (".py", ".go")).alias("by_list"))


@query("dsl_functions", """SELECT c_custkey, contains(c_name, '1') AND contains(c_name, '2') AS all_, contains(c_name, '7') OR contains(c_name, '8') AS any_, octet_length(encode(c_name)) AS n, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256, base64(encode(c_name)) AS b64, lower(to_hex(encode(c_name))) AS hex, lower(to_hex(c_custkey)) AS dec_hex, reverse(c_name) AS rev,
  regexp_matches(c_name, '[13579]$') AS odd, replace(c_name, '0', '_') AS repl, regexp_replace(c_name, '0+', '', 'g') AS rx, upper(c_name) AS up, trim(c_name, 'C0') AS tr, CASE WHEN starts_with(c_name, 'Cust') THEN c_name[5:] ELSE c_name END AS pre, TRY_CAST(c_mktsegment AS DOUBLE) AS num, concat_ws('-', c_name, c_mktsegment) AS joined, url_encode(c_mktsegment) AS url FROM customer""")  # fmt: skip
def dsl_functions(spark, sf_dir) -> DataFrame:
    d, n, s, lit = M.dsl_column, F.col("c_name"), F.col("c_mktsegment"), F.lit
    return A.table(spark, sf_dir, "customer").select(
        "c_custkey", d("contains_all", n, lit("1"), lit("2")).alias("all_"), d("contains_any", n, lit("7"), lit("8")).alias("any_"), d("len", n).alias("n"), d("md5", n).alias("md5"), d("sha1", n).alias("sha1"), d("sha256", n).alias("sha256"), d("base64", n).alias("b64"), d("hex_encode", n).alias("hex"), d("dec_to_hex", F.col("c_custkey")).alias("dec_hex"), d("reverse", n).alias("rev"),
        d("regex", "[13579]$", n).alias("odd"), d("replace", n, lit("0"), lit("_")).alias("repl"), d("replace_regex", n, "0+", "").alias("rx"), d("to_upper", n).alias("up"), d("trim", n, "C0").alias("tr"), d("trim_prefix", n, "Cust").alias("pre"), d("to_number", s).alias("num"), d("join", "-", n, s).alias("joined"), d("url_encode", s).alias("url"),
    )


@query("extract_strings", "SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[\\t -~]{4,}'), chr(10)) AS strings FROM documents")
def extract_strings(spark, sf_dir) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return M.extract_strings(docs, "doc_id")


_SIGNATURES = [("tokenlib", "token = ", r'token = "([0-9a-f]{4})', ("24be",)), ("apache", "Apache License", r"Version ([0-9.]+[0-9])", ())]


@query("detect_components", A.oracle("""SELECT path, 'tokenlib' AS product, unnest(CASE WHEN len(v) > 0 THEN v ELSE [NULL] END) AS version FROM (SELECT path, list_filter(list_distinct(regexp_extract_all(content, 'token = "([0-9a-f]{4})', 1)), lambda x: x <> '24be') AS v FROM corpus WHERE contains(content, 'token = '))
  UNION ALL SELECT path, 'apache', unnest(CASE WHEN len(v) > 0 THEN v ELSE [NULL] END) FROM (SELECT path, list_distinct(regexp_extract_all(content, 'Version ([0-9.]+[0-9])', 1)) AS v FROM corpus WHERE contains(content, 'Apache License'))""", "corpus"))  # fmt: skip
def detect_components(spark, sf_dir) -> DataFrame:
    return M.detect_components(A.corpus(spark, sf_dir).select("path", F.col("content").alias("strings")), _SIGNATURES)


_BYTES = [M.BytePattern("tokenlib", "74 6f 6b 65 6e 20 3d 20 22 (?? ?? ?? ??)"), M.BytePattern("apache", "4c 69 63 65 6e 73 65 [1-4] 56 65 72 73 69 6f 6e 20 (3? 2e 3?)"), M.BytePattern("number", "(3? 3?) 2e 20 [0-6] 54 68")]


@query("byte_versions", A.oracle("""SELECT DISTINCT path, product, trim(version) AS version FROM (SELECT path, 'tokenlib' AS product, unnest(regexp_extract_all(content, 'token = "([ -~]{4})', 1)) AS version FROM corpus UNION ALL SELECT path, 'apache', unnest(regexp_extract_all(content, '(?s)License[\\x00-\\x7f]{1,4}?Version ([0-?]\\.[0-?])', 1)) FROM corpus
  UNION ALL SELECT path, 'number', unnest(regexp_extract_all(content, '(?s)([0-?][0-?])\\. [\\x00-\\x7f]{0,6}?Th', 1)) FROM corpus) WHERE trim(version) <> ''""", "corpus"))  # fmt: skip
def byte_versions(spark, sf_dir) -> DataFrame:
    return M.byte_versions(A.corpus(spark, sf_dir).select("path", F.encode("content", "utf-8").alias("content")), _BYTES)


@query("detect_components_by_bytes", A.oracle("""WITH s AS (SELECT path, regexp_extract_all(content, 'Version ([0-9.]+[0-9])', 1) AS v, regexp_extract_all(content, 'token = "([ -~]{4})', 1) AS t, contains(content, 'Apache License') AS a, contains(content, 'token = ') AS k FROM corpus), x AS (SELECT path, 'apache' AS product, list_distinct(v) AS versions FROM s WHERE a UNION ALL SELECT path, 'tokenlib', list_filter(list_distinct(t), lambda x: x <> '24be') FROM s WHERE k)
  SELECT path, product, unnest(CASE WHEN len(versions) > 0 THEN versions ELSE [NULL] END) AS version FROM x""", "corpus"))  # fmt: skip
def detect_components_by_bytes(spark, sf_dir) -> DataFrame:
    c = A.corpus(spark, sf_dir)
    own = [(product, pattern, version if product == "apache" else "(?!)()", ignored) for product, pattern, version, ignored in _SIGNATURES]
    return M.detect_components(c.select("path", F.col("content").alias("strings")), own, M.byte_versions(c.select("path", F.encode("content", "utf-8").alias("content")), _BYTES[:1]))


@query("fold_components", "SELECT lower(p_brand) AS product, p_size AS version, count(DISTINCT p_name) AS paths, max(p_retailprice) AS confidence, arg_min(p_type, p_name || p_type) FILTER (p_partkey % 3 = 0) AS vendor FROM part GROUP BY 1, 2")
def fold_components(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("product"), F.col("p_size").alias("version"), F.col("p_name").alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("").alias("vendor"), F.col("p_retailprice").alias("confidence"))
    return M.fold_components(d)


@query("merge_scanner_results", "SELECT lower(p_brand) AS product, p_size AS version, p_partkey % 30 AS cve, max(p_partkey % 5) AS severity_rank, coalesce(min(p_type) FILTER (p_partkey % 2 = 0 AND p_size % 3 > 0), min(p_type) FILTER (p_partkey % 2 = 1)) AS summary FROM part GROUP BY 1, 2, 3")
def merge_scanner_results(spark, sf_dir) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    cols = [F.col("p_brand").alias("product"), F.col("p_size").alias("version"), (F.col("p_partkey") % 30).alias("cve"), (F.col("p_partkey") % 5).alias("severity_rank")]
    return M.merge_scanner_results([p.where("p_partkey % 2 = 0").select(*cols, F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("summary")), p.where("p_partkey % 2 = 1").select(*cols, F.col("p_type").alias("summary"))])


@query("attach_cves", "SELECT component, cve, max(severity_rank) AS severity_rank, count(*) AS n FROM (SELECT DISTINCT p_size AS component, p_partkey % 20 AS cve, p_partkey % 5 AS severity_rank FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT p_size, p_partkey % 20, p_partkey % 5 FROM part p WHERE p_partkey % 2 = 1 AND NOT EXISTS (FROM part q WHERE q.p_partkey % 2 = 0 AND q.p_size = p.p_size AND q.p_partkey % 20 = p.p_partkey % 20)) GROUP BY ALL")
def attach_cves(spark, sf_dir) -> DataFrame:
    p = A.table(spark, sf_dir, "part").selectExpr("p_size AS component", "p_partkey % 20 AS cve", "p_partkey % 5 AS severity_rank", "p_partkey % 2 AS half").distinct()
    out = M.attach_cves(p.where("half = 0").drop("half"), p.where("half = 1").drop("half"))
    return out.groupBy("component", "cve").agg(F.max("severity_rank").alias("severity_rank"), F.count("*").alias("n"))


@query("supersede_layers", """WITH d AS (SELECT DISTINCT l_partkey AS layer, l_linenumber % 2 AS root, l_suppkey % 3 AS kind FROM lineitem), s AS (SELECT DISTINCT o_custkey AS image, o_orderkey % 12 AS position, o_orderkey // 8 AS layer FROM orders)
  SELECT layer, root, kind FROM d WHERE NOT EXISTS (SELECT 1 FROM (SELECT bool_and(EXISTS (SELECT 1 FROM s s2 JOIN d d2 ON d2.layer = s2.layer WHERE s2.image = s1.image AND d2.root = d.root AND d2.kind = d.kind AND s2.position > s1.position)) AS gone FROM s s1 WHERE s1.layer = d.layer) WHERE gone)""")  # fmt: skip
def supersede_layers(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS layer", "l_linenumber % 2 AS root", "l_suppkey % 3 AS kind").distinct()
    s = A.table(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey % 12 AS position", "o_orderkey div 8 AS layer").distinct()
    return M.supersede_layers(d, s).select("layer", "root", "kind")
