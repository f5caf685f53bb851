"""Queries of the parsers over files that Spark writes out of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.jobs import adapters as A
from lakeaudit.jobs.register import query
from lakeaudit.operators import scan as C
from lakeaudit.sinks import reports as R
from lakeaudit.sources import readers as S


def _files(spark, sf_dir, path: str, entry: str, sep: str) -> DataFrame:
    """A file per part size, with an entry per part."""
    lines = A.table(spark, sf_dir, "part").select("p_size", F.struct("p_partkey", F.expr(entry).alias("e")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), sep)
    return lines.groupBy("p_size").agg(text.alias("content")).select(F.concat(F.lit("img"), F.col("p_size").cast("string"), F.lit(path)).alias("path"), "content")


@query("inventory_from_os_packages", "SELECT 'img' || p_size || '/var/lib/dpkg/status' AS path, 'Debian' AS ecosystem, 'pkg' || p_partkey AS name, '1.' || p_size || '-2' AS version, CASE WHEN p_partkey % 3 = 0 THEN 'src' || (p_partkey % 7) END AS source_name FROM part WHERE p_partkey % 5 <> 0")
def inventory_from_os_packages(spark, sf_dir) -> DataFrame:
    entry = "concat('Package: pkg', p_partkey, '\nStatus: ', if(p_partkey % 5 = 0, 'deinstall ok config-files', 'install ok installed'), if(p_partkey % 3 = 0, concat('\nSource: src', p_partkey % 7, ' (1.0)'), ''), '\nVersion: 1.', p_size, '-2')"
    return S.inventory_from_os_packages(_files(spark, sf_dir, "/var/lib/dpkg/status", entry, "\n\n"))


#: Kind of file: name, ecosystem, name of a package, an entry, what is put between entries, before and after them.
_LOCKS = (
    ("package-lock.json", "npm", "pkg", """concat('"node_modules/pkg', p_partkey, '":{"version":"1.', p_size, '"}')""", ",", '{"packages":{"":{"version":"0"},', "}}"), ("Pipfile.lock", "PyPI", "pkg", """concat('"pkg', p_partkey, '":{"version":"==1.', p_size, '"}')""", ",", '{"default":{', '},"develop":{}}'),
    ("composer.lock", "Packagist", "v/pkg", """concat('{"name":"v/pkg', p_partkey, '","version":"1.', p_size, '"}')""", ",", '{"packages":[', "]}"), ("packages.lock.json", "NuGet", "pkg", """concat('"pkg', p_partkey, '":{"type":"Direct","resolved":"1.', p_size, '"}')""", ",", '{"dependencies":{"net8":{"own":{"type":"Project"},', "}}}"),
    ("Cargo.lock", "crates.io", "pkg", """concat('[[package]]\nname = "pkg', p_partkey, '"\nversion = "1.', p_size, '"\nsource = "registry+x"\n')""", "\n", "version = 3\n\n", ""), ("requirements.txt", "PyPI", "pkg", "concat('pkg', p_partkey, ' == 1.', p_size, '  # via x')", "\n", "# top\n", ""),
    ("gradle.lockfile", "Maven", "g:pkg", "concat('g:pkg', p_partkey, ':1.', p_size, '=compile')", "\n", "# top\n", "\nempty="), ("old/package-lock.json", "npm", "pkg", """concat('"pkg', p_partkey, '":{"version":"1.', p_size, '","dependencies":{}}')""", ",", '{"lockfileVersion":1,"dependencies":{', "}}"),
)


@query("inventory_from_lockfiles", " UNION ALL ".join(f"SELECT 'img' || p_size || '/{name}' AS path, '{eco}' AS ecosystem, '{own}' || p_partkey AS name, '1.' || p_size AS version, 'registry' AS source FROM part WHERE p_partkey % 8 = {i}" for i, (name, eco, own, *_) in enumerate(_LOCKS)))
def inventory_from_lockfiles(spark, sf_dir) -> DataFrame:
    """A lockfile of each kind for each size of parts."""
    pick = lambda k: F.element_at(F.array(*(F.lit(lock[k]) for lock in _LOCKS)), F.col("kind") + 1)
    entry = F.coalesce(*(F.when(F.col("kind") == i, F.expr(lock[3].replace("\n", "\\n"))) for i, lock in enumerate(_LOCKS)))
    lines = A.table(spark, sf_dir, "part").withColumn("kind", (F.col("p_partkey") % 8).cast("int")).select("p_size", "kind", F.struct("p_partkey", entry.alias("e")).alias("x"))
    files = lines.groupBy("p_size", "kind").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("entries"))
    text = F.coalesce(*(F.when(F.col("kind") == i, F.concat(F.lit(lock[5]), F.array_join("entries", lock[4]), F.lit(lock[6]))) for i, lock in enumerate(_LOCKS)))
    return S.inventory_from_lockfiles(files.select(F.concat(F.lit("img"), F.col("p_size").cast("string"), F.lit("/"), pick(0)).alias("path"), text.alias("content")))


@query("exploit_index", "SELECT DISTINCT 'CVE-2024-' || (p_partkey % 400 + 1000) AS cve FROM part UNION SELECT DISTINCT 'CVE-2023-' || (p_size + 20000) FROM part")
def exploit_index(spark, sf_dir) -> DataFrame:
    lines = A.table(spark, sf_dir, "part").selectExpr("concat(p_partkey, ',\"', p_name, '\",cve-2024-', p_partkey % 400 + 1000, ';CVE-2023-', p_size + 20000, ',CVE-x') AS value")
    return S.cve_ids(lines)


@query("latest_advisories", A.oracle("SELECT max(p_partkey) AS newest, 'A' || (p_partkey % 50) AS id, CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem FROM part GROUP BY 2, 3"))
def latest_advisories(spark, sf_dir) -> DataFrame:
    rows = A.table(spark, sf_dir, "part").selectExpr("p_partkey AS newest", "concat('A', p_partkey % 50) AS id", "CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem", "'x' AS package", "timestamp_seconds(p_partkey) AS modified", "array(named_struct('type', 'SEMVER')) AS ranges")
    return S.latest_advisories(rows).select("newest", "id", "ecosystem")


@query("language_of", A.oracle("SELECT language, count(*) AS files FROM corpus GROUP BY ALL", "corpus"))
def language_of(spark, sf_dir) -> DataFrame:
    return A.corpus(spark, sf_dir).groupBy(S.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


def _folder(spark) -> str:
    return f"{A.shared_folder(spark)}/source-{uuid.uuid4().hex}"


def _json_files(spark, sf_dir, table: str, by: str, item: str, whole: str) -> str:
    """A folder of JSON files, one for each value of by, that hold whole (over ``by`` and ``items``) of the rows' items."""
    rows = A.table(spark, sf_dir, table).selectExpr(f"{by} AS by", f"{item} AS item").groupBy("by").agg(F.array_sort(F.collect_list("item")).alias("items"))
    folder = _folder(spark)
    rows.repartition(16, "by").selectExpr(f"to_json({whole}) AS value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


@query("read_corpus", "SELECT sum(octet_length(encode(coalesce(text, ''))) + 1) AS bytes, 'text' AS language, count(DISTINCT source) AS sources FROM documents")
def read_corpus(spark, sf_dir) -> DataFrame:
    folder = _folder(spark)
    A.table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(folder)
    files = S.read_corpus(spark, folder, "p", max_bytes=1 << 30)
    return files.groupBy("language").agg(F.sum(F.octet_length("content")).alias("bytes"), F.countDistinct(F.nullif(F.regexp_extract("path", "source=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("sources"))


@query("read_kev", "SELECT 'CVE-2024-' || c_custkey AS cve, c_custkey % 3 = 0 AS ransomware, 'CWE-' || c_nationkey AS cwe FROM customer")
def read_kev(spark, sf_dir) -> DataFrame:
    item = "named_struct('cveID', concat(' cve-2024-', c_custkey), 'knownRansomwareCampaignUse', if(c_custkey % 3 = 0, 'Known', if(c_custkey % 3 = 1, 'Unknown', null)), 'cwes', array(concat('CWE-', c_nationkey)))"
    return S.read_kev(spark, _json_files(spark, sf_dir, "customer", "c_nationkey", item, "named_struct('count', size(items), 'vulnerabilities', items)")).select("cve", "ransomware", F.col("cwes")[0].alias("cwe"))


@query("read_epss", "SELECT 'CVE-2024-' || c_custkey AS cve, c_custkey / 1000.0 AS epss, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0 END AS epss_percentile FROM customer WHERE c_custkey % 7 > 0")
def read_epss(spark, sf_dir) -> DataFrame:
    item = "named_struct('cve', concat('cve-2024-', c_custkey), 'epss', if(c_custkey % 7 = 0, 'n/a', cast(c_custkey / 1000.0 AS string)), 'percentile', if(c_custkey % 2 = 0, '0.5', null))"
    return S.read_epss(spark, _json_files(spark, sf_dir, "customer", "c_nationkey", item, "named_struct('data', items)"))


@query("read_release_index", "SELECT 'npm' AS ecosystem, 'lib-' || p_size AS name, p_partkey || '.0.0' AS version, CASE WHEN p_partkey % 4 > 0 THEN TIMESTAMP '2020-01-01' + to_days(CAST(p_partkey % 900 AS INT)) END AS published_at, p_partkey % 5 = 0 AS is_default, p_partkey % 6 = 0 AS deprecated FROM part")
def read_release_index(spark, sf_dir) -> DataFrame:
    item = "named_struct('versionKey', named_struct('version', concat(p_partkey, '.0.0')), 'publishedAt', if(p_partkey % 4 = 0, 'soon', concat(date_add(date'2020-01-01', cast(p_partkey % 900 AS int)), 'T00:00:00Z')), 'isDefault', if(p_partkey % 5 = 0, true, null), 'isDeprecated', p_partkey % 6 = 0)"
    folder = _json_files(spark, sf_dir, "part", "p_size", item, "named_struct('packageKey', named_struct('system', 'npm', 'name', concat('lib-', by)), 'versions', items)")
    return S.read_release_index(spark, folder).drop("deprecated_reason")


@query("read_exploit_index", "SELECT DISTINCT 'CVE-2024-' || (c_custkey + 1000) AS cve FROM customer")
def read_exploit_index(spark, sf_dir) -> DataFrame:
    folder = _folder(spark)
    A.table(spark, sf_dir, "customer").selectExpr("concat(c_custkey, ',x,\"cve-2024-', c_custkey + 1000, ';CVE-1\"') AS value").write.text(folder)
    return S.read_exploit_index(spark, folder)


@query("read_sbom", """SELECT CASE WHEN p_size % 2 = 0 THEN 'spdx' ELSE 'cyclonedx' END AS format, 'part' || p_partkey AS name, '1.' || p_size AS version, CASE WHEN p_partkey % 3 = 0 THEN 'pkg:x/' || p_partkey ELSE 'part' || p_partkey || chr(0) || '1.' || p_size END AS key, lag('r' || p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey) AS needs FROM part""")
def read_sbom(spark, sf_dir) -> DataFrame:
    """Every second size an SPDX document; in CycloneDX ones each component holds the next, to the depth of the document."""
    rows = A.table(spark, sf_dir, "part").selectExpr("p_size", "p_partkey", "lag(p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey) AS before")
    purl = "if(p_partkey % 3 = 0, concat('pkg:x/', p_partkey), null)"
    each = rows.selectExpr("p_size", f"struct(p_partkey, before, concat('r', p_partkey) AS ref, concat('part', p_partkey) AS name, {purl} AS purl) AS x").groupBy("p_size").agg(F.array_sort(F.collect_list("x")).alias("x"))
    edges = "filter(transform(x, c -> struct(c.ref AS {0}, {1} AS {2}, c.before AS b)), c -> c.b IS NOT NULL)"
    spdx = each.where("p_size % 2 = 0").selectExpr("to_json(named_struct('spdxVersion', 'SPDX-2.3', 'packages', transform(x, c -> named_struct('SPDXID', c.ref, 'name', c.name, 'versionInfo', concat('1.', p_size), 'externalRefs', if(c.purl IS NULL, null, array(named_struct('referenceType', 'purl', 'referenceLocator', c.purl))))), 'relationships', transform(" + edges.format("spdxElementId", "concat('r', c.before)", "relatedSpdxElement") + ", e -> named_struct('spdxElementId', e.spdxElementId, 'relationshipType', 'DEPENDS_ON', 'relatedSpdxElement', e.relatedSpdxElement)))) AS value")
    # A component's text ends open, so that the next one lies inside it.
    opened = "array_join(transform(x, c -> concat('{\"bom-ref\":\"', c.ref, '\",\"name\":\"', c.name, '\",\"version\":\"1.', p_size, '\",', if(c.purl IS NULL, '', concat('\"purl\":\"', c.purl, '\",')), '\"components\":[')), '')"
    deps = "to_json(transform(" + edges.format("ref", "array(concat('r', c.before))", "dependsOn") + ", e -> named_struct('ref', e.ref, 'dependsOn', e.dependsOn)))"
    cyclone = each.where("p_size % 2 = 1").selectExpr(f"concat('{{\"bomFormat\":\"CycloneDX\",\"components\":[', {opened}, repeat(']}}', size(x)), '],\"dependencies\":', {deps}, '}}') AS value")
    folder = _folder(spark)
    spdx.unionByName(cyclone).repartition(16).write.option("maxRecordsPerFile", 1).text(folder)
    return S.read_sbom(spark, folder).select("format", "name", "version", "key", F.col("depends_on")[0].alias("needs"))


@query("read_claims", "SELECT CASE WHEN o_custkey % 3 = 2 THEN 'scanner-result' ELSE 'vex-statement' END AS kind, CASE WHEN o_custkey % 3 < 2 THEN 'CVE-' || o_orderkey END AS vulnerability_id, CASE WHEN o_custkey % 3 = 2 THEN 'rule' || o_orderkey END AS rule_id, CASE WHEN o_custkey % 3 = 2 THEN 'error' WHEN o_orderkey % 4 = 0 THEN 'not_affected' ELSE 'affected' END AS status, o_custkey % 3 = 2 OR o_orderkey % 4 > 0 OR o_orderkey % 8 = 0 AS mapped, count(*) AS n FROM orders GROUP BY ALL")
def read_claims(spark, sf_dir) -> DataFrame:
    reason = "if(o_orderkey % 8 = 0, 'not reachable', null)"
    item = f"""named_struct('id', o_orderkey, 'vex', named_struct('vulnerability', named_struct('name', concat('CVE-', o_orderkey)), 'products', array(named_struct('@id', 'pkg:a@1')), 'status', if(o_orderkey % 4 = 0, 'not_affected', 'affected'), 'justification', {reason}),
      'cdx', named_struct('id', concat('CVE-', o_orderkey), 'affects', array(named_struct('ref', 'r1')), 'analysis', named_struct('state', if(o_orderkey % 4 = 0, 'false_positive', 'exploitable'), 'detail', {reason})), 'sarif', named_struct('ruleId', concat('rule', o_orderkey), 'level', 'error', 'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', 'a.py'))))))"""
    whole = "named_struct('statements', if(by % 3 = 0, transform(items, i -> i.vex), null), 'vulnerabilities', if(by % 3 = 1, transform(items, i -> i.cdx), null), 'runs', if(by % 3 = 2, array(named_struct('tool', named_struct('driver', named_struct('name', 't')), 'results', transform(items, i -> i.sarif))), null))"
    rows = A.table(spark, sf_dir, "orders").selectExpr("o_custkey % 300 AS by", f"{item} AS item").groupBy("by").agg(F.collect_list("item").alias("items"))
    folder = _folder(spark)
    rows.repartition(16, "by").selectExpr(f"to_json({whole}) AS value").write.option("maxRecordsPerFile", 1).text(folder)
    return S.read_claims(spark, folder).groupBy("kind", "vulnerability_id", "rule_id", "status", "mapped").agg(F.count("*").alias("n"))


@query("write_run", A.oracle("SELECT rule_id, category, count(*) AS n, CASE WHEN category = 'secrets' AND rule_id = 'rule-1' THEN 'again' ELSE 'once' END AS written FROM findings GROUP BY ALL", "findings"))
def write_run(spark, sf_dir) -> DataFrame:
    """All findings by rule and category, then one of these written again."""
    folder, f = _folder(spark), A.findings(spark, sf_dir).select("rule_id", "category", "run_id", F.lit("once").alias("written"))
    R.write_run(f, folder, ("rule_id", "category"))
    R.write_run(f.where("category = 'secrets' AND rule_id = 'rule-1'").withColumn("written", F.lit("again")), folder, ("rule_id", "category"))
    return spark.read.parquet(folder).groupBy("rule_id", "category", "written").agg(F.count("*").alias("n"))


_RULES = "CASE WHEN p_partkey % 50 = 0 THEN ' ' WHEN p_partkey % 9 = 0 THEN 'twice' ELSE concat('r', CAST(p_partkey AS STRING)) END AS rule_id, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 8 = 0 THEN NULL ELSE p_name END AS pattern, CASE WHEN p_size % 5 = 0 THEN 'odd' ELSE 'High' END AS severity"


@query("validate_rules", f"WITH r AS (SELECT {_RULES.replace('AS STRING', 'AS VARCHAR')} FROM part) SELECT rule_id, 'repeated id' AS problem FROM r GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT rule_id, 'blank id' FROM r WHERE trim(rule_id) = '' UNION ALL SELECT rule_id, 'blank pattern' FROM r WHERE coalesce(pattern, '') = '' UNION ALL SELECT rule_id, 'unknown severity' FROM r WHERE severity = 'odd' UNION ALL SELECT '*', 'too many rules' FROM r HAVING count(*) > 100")
def validate_rules(spark, sf_dir) -> DataFrame:
    return C.validate_rules(A.project(spark, sf_dir, "part", _RULES), most=100)
