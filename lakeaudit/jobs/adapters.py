"""The audit tables as views of the test tables: corpus, runs, findings, inventory, advisories and so on.

Each has a Spark form, a function of (spark, sf_dir), and the same in SQL, so that a query's oracle starts from the same
rows. ``oracle(query, *views)`` puts the views that a query names before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.functions.session import cut, shared_folder, shuffled  # noqa: F401  for the queries

DIRS = ("src", "tests", "vendor", "docs", "fixtures", "workflows", "dist", "lib")
LANGUAGES = {"en": ("python", ".py"), "fr": ("javascript", ".js"), "de": ("java", ".java"), "es": ("go", ".go")}

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (sql, needs)


def oracle(query: str, *names: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        for x in VIEWS[n][1]:
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    own = query.strip()
    if not order:
        return own
    ctes = ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in order)
    if own[:5].upper() == "WITH ":
        return f"WITH {ctes}, {own[5:]}"
    return f"WITH {ctes} {own}"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, path, language, content of each document as a source file."""
    return corpus_of(table(spark, sf_dir, "documents"))


def corpus_of(d: DataFrame) -> DataFrame:
    pick = lambda k, other: F.coalesce(F.create_map(*(F.lit(x) for lang, v in LANGUAGES.items() for x in (lang, v[k])))[F.col("lang")], F.lit(other))
    folder = F.element_at(F.array(*map(F.lit, DIRS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select(F.col("source").alias("project_id"), F.concat("source", F.lit("/"), folder, F.lit("/"), F.col("doc_id").cast("string"), pick(1, ".txt")).alias("path"), pick(0, "text").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


_CASE = lambda k, other: "CASE lang " + " ".join(f"WHEN '{x}' THEN '{v[k]}'" for x, v in LANGUAGES.items()) + f" ELSE '{other}' END"
view("corpus", f"SELECT source AS project_id, source || '/' || [{', '.join(repr(d) for d in DIRS)}][doc_id % 8 + 1] || '/' || doc_id || {_CASE(1, '.txt')} AS path, {_CASE(0, 'text')} AS language, coalesce(text, '') AS content FROM documents")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan run per order: project is the customer, two families by priority, failed where the status is P."""
    o = table(spark, sf_dir, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("completed_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.lit(1).alias("fingerprint_version"), F.when(level <= 2, F.array(F.lit("source"), F.lit("secrets"))).when(level <= 4, F.array(F.lit("secrets"))).otherwise(F.array(F.lit("source"))).alias("families"),
    )


view(
    "runs",
    """SELECT o_orderkey AS run_id, o_custkey AS project_id, o_orderdate AS started_at, o_orderdate + INTERVAL 1 HOUR AS completed_at,
    CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, 1 AS fingerprint_version,
    CASE WHEN CAST(substring(o_orderpriority, 1, 1) AS INT) <= 2 THEN ['source', 'secrets'] WHEN CAST(substring(o_orderpriority, 1, 1) AS INT) <= 4 THEN ['secrets'] ELSE ['source'] END AS families FROM orders""",
)

SEVERITY = "CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 15 THEN 'medium' WHEN l_quantity > 5 THEN 'low' ELSE 'info' END"
_FINDINGS = f"""l_orderkey AS run_id, concat('fp', CAST(l_partkey % 23 AS STRING)) AS fingerprint, 1 AS fingerprint_version, CASE WHEN l_returnflag = 'R' THEN 'secrets' ELSE 'source' END AS category,
    concat('rule-', CAST(l_partkey % 7 AS STRING)) AS rule_id, {SEVERITY} AS severity, concat('src/f', CAST(l_partkey % 23 AS STRING), '.py') AS path, CAST(l_suppkey % 100 AS BIGINT) + 1 AS line, l_linenumber AS number, l_shipdate AS seen_at"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per line item of its order's run; the fingerprint repeats over runs."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(_FINDINGS))


def _split(columns: str) -> list[str]:
    """A select list at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [x.strip() for x in [*out, columns[start:]]]


def project(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    """A select list that Spark and the oracle read alike, over a test table."""
    return table(spark, sf_dir, name).selectExpr(*_split(columns))


view("findings", f"SELECT {_FINDINGS.replace('AS STRING', 'AS VARCHAR')} FROM lineitem")

_DEPS = """l_orderkey AS run_id, l_suppkey % 50 AS project_id, CASE l_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'crates.io' ELSE 'Debian:12' END AS ecosystem,
    CASE WHEN l_partkey % 4 = 1 THEN concat('Lib_', CAST(l_partkey % 200 AS STRING)) ELSE concat('lib-', CAST(l_partkey % 200 AS STRING)) END AS name, concat(CAST(l_linenumber AS STRING), '.', CAST(CAST(l_quantity AS INT) % 10 AS STRING), '.0') AS version,
    concat('lock', CAST(l_linenumber % 2 AS STRING)) AS lockfile, CASE l_partkey % 9 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0-only' WHEN 3 THEN 'MIT OR GPL-3.0-only' WHEN 4 THEN 'MPL-2.0' WHEN 5 THEN 'MIT AND LGPL-3.0-only' WHEN 6 THEN 'Proprietary' WHEN 7 THEN NULL ELSE 'BSD-3-Clause' END AS license,
    CASE WHEN l_partkey % 17 = 0 THEN 'git' ELSE 'registry' END AS source, l_partkey % 29 = 0 AS local_workspace, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'A' END AS direct"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir, "lineitem", _DEPS)


view("dependencies", f"SELECT {_DEPS.replace('AS STRING', 'AS VARCHAR')} FROM lineitem")

ADVISORIES = """concat('ADV-', CAST(p_partkey AS STRING)) AS id, CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'crates.io' ELSE 'Debian' END AS ecosystem, concat(CASE WHEN p_partkey % 4 = 1 THEN 'lib.' ELSE 'lib-' END, CAST(p_partkey % 400 AS STRING)) AS package,
    concat('CVE-2024-', CAST(p_partkey % 300 AS STRING)) AS alias, CASE WHEN p_partkey % 31 = 0 THEN '2024-01-01' END AS withdrawn, concat(CAST(p_size % 3 AS STRING), '.0.0') AS introduced, concat(CAST(p_size % 3 + 1 + p_size % 4 AS STRING), '.', CAST(p_size % 10 AS STRING), '.0') AS fixed,
    CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity"""


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir, "part", ADVISORIES)


view("advisories", f"SELECT {ADVISORIES.replace('AS STRING', 'AS VARCHAR')} FROM part")
