"""Report documents: a row per run with its document as text, or a row per line; writing is df.write.text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str, by: tuple[str, ...] = ("project_id", "run_id")) -> None:
    """Persist rows by project and run; writing a run again replaces that run alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _document(df: DataFrame, run: str, order: list[str], item: Column, wrap) -> DataFrame:
    """run, document: the items of a run in order, in one JSON text. A run's items are gathered: reports are of one run's size."""
    rows = df.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("_item")))).alias("_rows"))
    return rows.select(run, F.to_json(wrap(F.transform("_rows", lambda r: r["_item"]))).alias("document"))


_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}


def _map(col: str, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.lower(col) == k, v).otherwise(out)
    return out


def export_sarif(findings: DataFrame, tool: str, run: str = "run_id") -> DataFrame:
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1).cast("long"), F.col("line").cast("long")).alias("startLine")).alias("region")).alias("physicalLocation"))
    item = F.struct(F.col("rule_id").alias("ruleId"), _map("severity", _LEVEL, "none").alias("level"), F.struct(F.col("rule_id").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    driver = F.struct(F.struct(F.lit(tool).alias("name")).alias("driver"))
    return _document(findings, run, ["path", "line", "rule_id", "fingerprint"], item, lambda rows: F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), rows.alias("results"))).alias("runs")))


def export_cyclonedx(components: DataFrame, run: str = "run_id") -> DataFrame:
    item = F.struct(F.lit("library").alias("type"), F.col("name"), F.col("version"), F.col("purl"), F.when(F.col("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("name")).alias("license")))).alias("licenses"))
    return _document(components, run, ["name", "version"], item, lambda rows: F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), rows.alias("components")))


def export_spdx(components: DataFrame, run: str = "run_id") -> DataFrame:
    ident = F.concat(F.lit("SPDXRef-"), F.substring(F.sha2(F.concat_ws("\x00", "name", "version"), 256), 1, 16))
    item = F.struct(ident.alias("SPDXID"), F.col("name"), F.col("version").alias("versionInfo"), F.coalesce("license", F.lit("NOASSERTION")).alias("licenseDeclared"))
    return _document(components, run, ["name", "version"], item, lambda rows: F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), rows.alias("packages")))


def openvex_statements(vulns: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """vulns with status: affected, or not_affected where the decision is falsePositive; accepted and suppressed ones stay affected with a note."""
    x = vulns.join(decisions, keys, "left")
    status = F.when(F.col("decision") == "falsePositive", "not_affected").otherwise("affected")
    return x.withColumn("status", status).withColumn("note", F.when(F.col("decision").isin("accepted", "suppressed"), F.concat(F.lit("decision: "), "decision")))


def export_openvex(statements: DataFrame, run: str = "run_id") -> DataFrame:
    item = F.struct(F.struct(F.col("advisory_id").alias("name")).alias("vulnerability"), F.array(F.struct(F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version").alias("@id"))).alias("products"), "status", F.col("note").alias("action_statement"))
    return _document(statements, run, ["advisory_id", "ecosystem", "name", "version"], item, lambda rows: F.struct(F.lit("https://openvex.dev/ns/v0.2.0").alias("@context"), rows.alias("statements")))


def csv_cell(col: Column) -> Column:
    """Quoted only where it holds a comma, a quote or a line break; quotes are doubled."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


#: Headers and priorities of the trackers' imports.
TICKETS = {
    "github": (("title", "body", "labels"), {"critical": "priority:critical", "high": "priority:high", "medium": "priority:medium", "low": "priority:low"}),
    "jira": (("Summary", "Description", "Priority", "Labels"), {"critical": "Highest", "high": "High", "medium": "Medium", "low": "Low"}),
}


def ticket_lines(findings: DataFrame, kind: str) -> DataFrame:
    """line: a cell-quoted row per finding. The header is ticket_header(kind); lines end with CR LF."""
    _, priorities = TICKETS[kind]
    title, body, priority = F.concat_ws(" in ", "rule_id", "path"), F.concat_ws(":", "path", F.col("line").cast("string")), _map("severity", priorities, "priority:info" if kind == "github" else "Lowest")
    cells = [title, body, priority] if kind == "github" else [title, body, priority, F.col("category")]
    return findings.select(F.concat_ws(",", *map(csv_cell, cells)).alias("line"))


def ticket_header(kind: str) -> str:
    return ",".join(TICKETS[kind][0])


def write_ticket_csv(findings: DataFrame, kind: str, path: str) -> None:
    """Header and rows as text parts; files with fewer rows than findings are an error."""
    lines = ticket_lines(findings, kind)
    head = findings.sparkSession.createDataFrame([(ticket_header(kind),)], "line string")
    head.coalesce(1).write.option("lineSep", "\r\n").mode("overwrite").text(f"{path}/header")
    lines.write.option("lineSep", "\r\n").mode("overwrite").text(f"{path}/rows")
    if findings.sparkSession.read.text(f"{path}/rows", lineSep="\r\n").count() < findings.count():  # a quoted cell may hold a break
        raise ValueError("a finding has no row")


#: Grades of code-quality reports by severity; others are info.
_GRADES = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor"}


def _quality_id(*parts: Column) -> Column:
    """The hash of an entry's parts, each ended by a zero byte; a part that is null is empty."""
    return F.sha2(F.concat(*(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit("\x00")) for c in parts)), 256)


def code_quality(findings: DataFrame, dismissed: Column | None = None) -> DataFrame:
    """fingerprint, severity, path, line, check_name of code-quality entries. Dismissed findings are left out, as the format has no state for them."""
    shown = findings if dismissed is None else findings.where(~F.coalesce(dismissed, F.lit(False)))
    ident = _quality_id(F.col("rule_id"), F.col("path"), F.col("line"), F.col("fingerprint"))
    return shown.select(ident.alias("fingerprint"), _map("severity", _GRADES, "info").alias("severity"), "path", F.greatest(F.lit(1), F.col("line")).cast("long").alias("line"), F.col("rule_id").alias("check_name"))


def code_quality_advisories(vulns: DataFrame, dismissed: Column) -> DataFrame:
    """The same entries for open advisories, on the first line of their lockfile. vulns: triple, lockfile, advisory_id, severity."""
    ident = _quality_id(F.lit("advisory"), F.col("advisory_id"), F.col("ecosystem"), F.col("name"), F.col("version"), F.col("lockfile"))
    shown = vulns.where(~F.coalesce(dismissed, F.lit(False)))
    return shown.select(ident.alias("fingerprint"), _map("severity", _GRADES, "info").alias("severity"), F.col("lockfile").alias("path"), F.lit(1).cast("long").alias("line"), F.col("advisory_id").alias("check_name"))
