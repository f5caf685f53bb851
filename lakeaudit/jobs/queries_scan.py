"""Queries of the scan operators over the documents as source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions import text as T
from lakeaudit.jobs import adapters as A
from lakeaudit.jobs.register import query
from lakeaudit.operators import scan as S
from lakeaudit.operators import scan_cache
from lakeaudit.operators.rules import SOURCE_RULES, TABLE


def _applies(r: S.Rule) -> str:
    out = ["TRUE"]
    if r.languages:
        out.append(f"language IN ({', '.join(repr(x) for x in r.languages)})")
    if r.extensions:
        out.append("(" + " OR ".join(f"ends_with(lower(path), '{e}')" for e in r.extensions) + ")")
    return " AND ".join(out)


def _group(r: S.Rule) -> int:
    return 1 if "(" in r.pattern.replace("(?:", "") else 0


_HITS = " UNION ALL ".join(
    f"SELECT project_id, path, '{r.rule_id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, generate_subscripts(m, 1) AS nth, unnest(m) AS match_text FROM (SELECT project_id, path, regexp_extract_all(content, '{r.pattern}', {_group(r)}) AS m FROM corpus WHERE {_applies(r)})"
    for r in S.RULES
)
A.view("hits", _HITS, "corpus")
_EXCLUDED = " OR ".join(f"(rule_id = '{r.rule_id}' AND regexp_matches(match_text, '{r.excluded}'))" for r in S.RULES if r.excluded)
A.view("kept_hits", f"SELECT * FROM hits WHERE NOT ({_EXCLUDED})", "hits")
_BYTES = "len(list_filter(string_split({0}, ''), lambda x: x = c)) / strlen({0})"
_HELD = f"coalesce(list_aggregate(list_transform(list_filter(list_distinct(string_split({{0}}, '')), lambda c: strlen(c) = 1), lambda c: -{_BYTES} * log2({_BYTES})), 'sum'), 0)"


@query("applicable_rules", A.oracle(" UNION ALL ".join(f"SELECT project_id, '{r.rule_id}' AS rule_id, count(*) AS files FROM corpus WHERE {_applies(r)} GROUP BY ALL" for r in S.RULES), "corpus"))
def applicable_rules(spark, sf_dir) -> DataFrame:
    return S.applicable_rules(A.corpus(spark, sf_dir)).groupBy("project_id", "rule_id").agg(F.count("*").alias("files"))


@query("match_texts", A.oracle("SELECT project_id, path, rule_id, nth, match_text FROM hits", "hits"))
def match_texts(spark, sf_dir) -> DataFrame:
    return S.match_texts(A.corpus(spark, sf_dir)).select("project_id", "path", "rule_id", F.col("nth").cast("long").alias("nth"), "match_text")


@query("scan_rules", A.oracle("SELECT project_id, path, rule_id, match_text, count(*) AS n FROM hits GROUP BY ALL", "hits"))
def scan_rules(spark, sf_dir) -> DataFrame:
    return S.scan_rules(A.corpus(spark, sf_dir)).groupBy("project_id", "path", "rule_id", "match_text").agg(F.count("*").alias("n"))


@query("drop_excluded_matches", A.oracle("SELECT project_id, path, rule_id, nth, match_text FROM kept_hits", "kept_hits"))
def drop_excluded_matches(spark, sf_dir) -> DataFrame:
    return S.drop_excluded(match_texts(spark, sf_dir))


_FIRST = """SELECT project_id, path, rule_id, severity, category, match_text, strpos(content, match_text) AS pos, content FROM kept_hits JOIN corpus USING (project_id, path) WHERE nth = 1"""


@query("locate", A.oracle("""SELECT project_id, path, rule_id, octet_length(encode(content[:pos - 1])) AS "offset", length(content[:pos - 1]) - length(replace(content[:pos - 1], chr(10), '')) + 1 AS line,
  octet_length(encode(string_split(content[:pos - 1], chr(10))[-1])) + 1 AS col FROM (SELECT project_id, path, rule_id, strpos(content, match_text) AS pos, content FROM hits JOIN corpus USING (project_id, path) WHERE nth = 1 AND rule_id = 'email-address')""", "hits"))  # fmt: skip
def locate(spark, sf_dir) -> DataFrame:
    hits = S.scan_rules(A.corpus(spark, sf_dir), tuple(r for r in S.RULES if r.rule_id == "email-address"))
    first = hits.groupBy("project_id", "path", "rule_id").agg(F.min(F.struct("offset", "line", "col")).alias("x"))
    return first.select("project_id", "path", "rule_id", "x.*")


@query("drop_superseded", A.oracle("SELECT project_id, rule_id, count(*) AS n FROM (FROM kept_hits k WHERE NOT (rule_id = 'assigned-string' AND EXISTS (FROM kept_hits p WHERE p.rule_id = 'hardcoded-token' AND p.project_id = k.project_id AND p.path = k.path AND p.match_text = k.match_text))) GROUP BY ALL", "kept_hits"))
def drop_superseded(spark, sf_dir) -> DataFrame:
    return S.drop_superseded(S.drop_excluded(S.scan_rules(A.corpus(spark, sf_dir)))).groupBy("project_id", "rule_id").agg(F.count("*").alias("n"))


_FLOORS = " AND ".join(f"(rule_id <> '{r.rule_id}' OR entropy >= {r.min_entropy})" for r in S.SECRET_RULES if r.min_entropy is not None)


@query("scan_secrets", A.oracle(f"SELECT * FROM (SELECT project_id, path, rule_id, match_text, round({_HELD.format('match_text')}, 6) AS entropy FROM kept_hits WHERE category = 'secrets') WHERE ({_FLOORS}) AND NOT regexp_matches(match_text, '{T.PLACEHOLDER}')", "kept_hits"))
def scan_secrets(spark, sf_dir) -> DataFrame:
    return S.secret_values(S.drop_excluded(S.match_texts(A.corpus(spark, sf_dir), S.SECRET_RULES))).select("project_id", "path", "rule_id", "match_text", "entropy")


@query("shannon_entropy", f"SELECT c_custkey, round({_HELD.format('c_name')}, 6) AS entropy, round({_HELD.format('c_name')}, 6) >= 3.5 AS high FROM customer")
def shannon_entropy(spark, sf_dir) -> DataFrame:
    e = F.round(T.shannon_entropy(F.col("c_name")), 6)
    return A.table(spark, sf_dir, "customer").select("c_custkey", e.alias("entropy"), (e >= 3.5).alias("high"))


@query("redact", A.oracle("""SELECT path, rule_id, list_reduce(list_prepend(match_text, coalesce(v, [])), lambda a, x: replace(a, x, '[redacted]'))[:240] AS match_text FROM kept_hits LEFT JOIN
  (SELECT path, list(match_text ORDER BY length(match_text) DESC, match_text) AS v FROM (SELECT DISTINCT path, match_text FROM kept_hits WHERE category = 'secrets') GROUP BY path) USING (path)""", "kept_hits"))  # fmt: skip
def redact(spark, sf_dir) -> DataFrame:
    return S.redact(S.drop_excluded(S.scan_rules(A.corpus(spark, sf_dir)))).select("path", "rule_id", "match_text")


@query("classify_path", A.oracle("""SELECT path, CASE split_part(path, '/', 2) WHEN 'vendor' THEN 'vendored' WHEN 'fixtures' THEN 'fixture' WHEN 'tests' THEN 'test' WHEN 'dist' THEN 'generated' WHEN 'docs' THEN 'documentation' ELSE 'production' END AS scope,
  CASE split_part(path, '/', 2) WHEN 'vendor' THEN 'vendored-directory' WHEN 'fixtures' THEN 'fixture-directory' WHEN 'tests' THEN 'test-name' WHEN 'dist' THEN 'generated-directory' WHEN 'docs' THEN 'documentation-directory' ELSE 'production-default' END AS reason FROM corpus""", "corpus"))  # fmt: skip
def classify_path(spark, sf_dir) -> DataFrame:
    x = T.classify_path(F.col("path"))
    return A.corpus(spark, sf_dir).select("path", x["scope"].alias("scope"), x["reason"].alias("reason"))


def _sha(fields: list[str]) -> str:
    return "sha256(" + " || ".join(f"unhex(lpad(lower(to_hex(octet_length(encode({f})))), 16, '0')) || encode({f})" for f in fields) + ")"


@query("fingerprint", A.oracle(f"""SELECT path, rule_id, nth, CASE WHEN k = 1 THEN base ELSE base || ':' || (k - 1) END AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY project_id, base ORDER BY path, rule_id, nth) AS k
  FROM (SELECT project_id, path, rule_id, nth, {_sha(["'1'", "category", "rule_id", "path", "trim(match_text)"])} AS base FROM kept_hits))""", "kept_hits"))  # fmt: skip
def fingerprint(spark, sf_dir) -> DataFrame:
    category = F.create_map(*(F.lit(x) for r in S.RULES for x in (r.rule_id, r.category)))
    hits = S.drop_excluded(match_texts(spark, sf_dir)).withColumn("category", category[F.col("rule_id")]).withColumn("context", F.col("match_text"))
    return S.fingerprint(hits, ["project_id"], ["path", "rule_id", "nth"]).select("path", "rule_id", "nth", "fingerprint")


@query("canonical_context", A.oracle("SELECT path, array_to_string(list_transform(string_split(trim(content, chr(10) || ' '), chr(10)), lambda r: trim(r)), chr(10)) AS context FROM corpus", "corpus"))
def canonical_context(spark, sf_dir) -> DataFrame:
    numbered = F.array_join(F.transform(F.split("content", "\n"), lambda r, i: F.concat(F.lpad((i + 1).cast("string"), 5, " "), F.lit(" │ "), r)), "\r\n")
    return A.corpus(spark, sf_dir).select("path", T.canonical_context(numbered).alias("context"))


@query("scan_distinct_content", A.oracle("SELECT project_id, path, rule_id, count(*) AS n FROM hits WHERE rule_id <> 'long-number' GROUP BY ALL", "hits"))
def scan_distinct_content(spark, sf_dir) -> DataFrame:
    rules = tuple(r for r in S.RULES if not r.extensions)
    return S.scan_distinct_content(A.corpus(spark, sf_dir), lambda c: S.match_texts(c, rules)).groupBy("project_id", "path", "rule_id").agg(F.count("*").alias("n"))


_PLANTED = ", ".join(f"({2 * i + k}, $p${text}$p$, '{(t[1] or ('text',))[0]}')" for i, t in enumerate(TABLE) for k, text in enumerate(t[6:8]))
A.view("planted", f"SELECT doc_id, v.language, coalesce(text, '') || chr(10) || v.line || chr(10) AS content FROM documents JOIN (VALUES {_PLANTED}) v(n, line, language) ON doc_id % {2 * len(TABLE)} = v.n")


@query("scan_source_rules", A.oracle(" UNION ALL ".join(f"SELECT doc_id, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(content, $p${r.pattern}$p$)) AS m FROM planted WHERE {_applies(r)}) GROUP BY ALL" for r in SOURCE_RULES), "planted"))
def scan_source_rules(spark, sf_dir) -> DataFrame:
    """The documents as files of many languages, each with a line that a rule finds or nearly finds."""
    lines = F.array(*(F.struct(F.lit(text).alias("line"), F.lit((t[1] or ("text",))[0]).alias("language")) for t in TABLE for text in t[6:8]))
    docs = A.table(spark, sf_dir, "documents").withColumn("x", F.element_at(lines, (F.col("doc_id") % (2 * len(TABLE)) + 1).cast("int")))
    files = docs.select(F.col("doc_id").alias("project_id"), F.col("doc_id").cast("string").alias("path"), "x.language", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("x.line"), F.lit("\n")).alias("content"))
    return S.scan_rules(files, SOURCE_RULES).groupBy(F.col("project_id").alias("doc_id"), "rule_id", "severity").agg(F.count("*").alias("n"))


@query("scan_cached", A.oracle("SELECT project_id, path, rule_id, match_text, count(*) AS n FROM hits GROUP BY ALL", "hits"))
def scan_cached(spark, sf_dir) -> DataFrame:
    """The second of two runs: the first has seen the files of some languages, and files of the others with their contents."""
    c, rules = A.corpus(spark, sf_dir), scan_cache.rules_hash(S.RULES)
    seen = scan_cache.scan_cached(c.where("language IN ('python', 'java')"), S.match_texts, rules)[1]
    hits, _ = scan_cache.scan_cached(c, S.match_texts, rules, seen)
    return hits.groupBy("project_id", "path", "rule_id", "match_text").agg(F.count("*").alias("n"))


@query("dedupe_revisions", A.oracle("SELECT project_id, rule_id, path, match_text, min(nth) AS nth FROM hits GROUP BY ALL", "hits"))
def dedupe_revisions(spark, sf_dir) -> DataFrame:
    return S.dedupe_revisions(match_texts(spark, sf_dir).withColumnRenamed("nth", "k"), ["k"]).select("project_id", "rule_id", "path", "match_text", F.col("k").alias("nth"))


@query("cap_per_file", A.oracle("SELECT project_id, path, count(*) AS found, count(*) > 10 AS over FROM hits GROUP BY ALL", "hits"))
def cap_per_file(spark, sf_dir) -> DataFrame:
    kept, over = S.cap_per_file(match_texts(spark, sf_dir), 10)
    return kept.groupBy("project_id", "path").agg(F.count("*").alias("found")).withColumn("over", F.lit(False)).unionByName(over.withColumn("over", F.lit(True)))


@query("apply_budget", A.oracle("""SELECT project_id, path, bytes, truncated FROM (SELECT *, max(CASE WHEN nth <= 30 AND bytes <= 60000 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id) = 1 AS truncated FROM (SELECT project_id, path,
  row_number() OVER w AS nth, sum(octet_length(encode(content))) OVER (w ROWS UNBOUNDED PRECEDING) AS bytes FROM corpus WINDOW w AS (PARTITION BY project_id ORDER BY path))) WHERE nth <= 30 AND bytes <= 60000""", "corpus"))  # fmt: skip
def apply_budget(spark, sf_dir) -> DataFrame:
    blobs = A.corpus(spark, sf_dir).select("project_id", "path", F.octet_length("content").alias("size"))
    return S.apply_budget(blobs, "project_id", ["path"], "size", 30, 60_000).select("project_id", "path", "bytes", "truncated")


_SEVERITIES = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))


@query("scan_summary", A.oracle(f"SELECT project_id, rule_id, severity, count(*) AS n, count(DISTINCT path) AS files FROM kept_hits GROUP BY ALL", "kept_hits"))
def scan_summary(spark, sf_dir) -> DataFrame:
    """The flagship: the whole scan, without false matches, by rule and severity."""
    hits = S.with_scope(S.drop_excluded(S.scan_rules(A.corpus(spark, sf_dir))))
    return hits.groupBy("project_id", "rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query("severity_summary", A.oracle(f"SELECT project_id, count(*) AS total, {_SEVERITIES}, count(*) FILTER (category = 'secrets') AS secrets, count(DISTINCT rule_id) AS n_rules FROM kept_hits GROUP BY ALL", "kept_hits"))
def severity_summary(spark, sf_dir) -> DataFrame:
    hits = S.drop_excluded(S.scan_rules(A.corpus(spark, sf_dir)))
    return S.scan_summary(hits, ["project_id"]).withColumn("n_rules", F.size("rules_fired").cast("long")).drop("rules_fired")


