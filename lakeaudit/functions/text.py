"""Scalar functions over columns: entropy, placeholders, paths, fingerprints, severity ranks. Built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory and file names that name a scope.
VENDORED = ("node_modules", "vendor", "third_party", "thirdparty", "external", "site-packages", "bower_components", "pods")
FIXTURES = ("fixtures", "fixture", "testdata")
TESTS = ("test", "tests", "spec", "specs", "__tests__")
GENERATED = ("dist", "build", "target", "out", "generated", ".next")
DOCS = ("docs", "doc", "examples", "example", "samples")
MANIFEST_DIRS = ("k8s", "kubernetes", "helm", "charts", "manifests", "infra", "infrastructure", "deploy")
MANIFESTS = "deployment|statefulset|daemonset|service|ingress|pod|job|cronjob|configmap|networkpolicy"
INFRASTRUCTURE = r"^(nginx\.conf|httpd\.conf|apache2\.conf|dockerfile.*|docker-compose\.ya?ml|\.htaccess|sshd_config|pg_hba\.conf|my\.cnf|.*\.tf|.*\.tfvars)$"

# Severities and their ranks in policies, source findings and reports.
POLICY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SOURCE_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2}
REPORT_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

PLACEHOLDER = r"(?i)^(?:change_?me|example|placeholder|dummy|test|todo|none|null|x{4,}|\*{3,}|your[a-z0-9_-]*|<[^>]*>|\$\{[^}]*\})"


def rank(col: Column | str, ranks: dict[str, int], other: int = 0) -> Column:
    """A severity's rank, whatever its case."""
    low = F.lower(F.col(col) if isinstance(col, str) else col)
    out = F.lit(other)
    for name, n in ranks.items():
        out = F.when(low == name, n).otherwise(out)
    return out


def shannon_entropy(col: Column) -> Column:
    """Bits per byte of a string, -sum p log2 p over its ASCII bytes, each p a share of all its UTF-8 bytes; 0 for an empty one.

    The bytes are sorted and counted in one pass over them.
    """
    n = F.octet_length(col)
    held = F.array_sort(F.filter(F.regexp_extract_all(F.hex(F.encode(col, "utf-8")), F.lit(".."), F.lit(0)), lambda x: x < "80"))
    bits = lambda run: F.when(run > 0, -run / n * F.log2(run / n)).otherwise(F.lit(0.0))
    step = lambda acc, x: F.when(acc["byte"] == x, F.struct(x.alias("byte"), (acc["run"] + 1).alias("run"), acc["bits"].alias("bits"))).otherwise(
        F.struct(x.alias("byte"), F.lit(1).alias("run"), (acc["bits"] + bits(acc["run"])).alias("bits"))
    )
    start = F.struct(F.lit("").alias("byte"), F.lit(0).alias("run"), F.lit(0.0).alias("bits"))
    return F.when(n > 0, F.aggregate(held, start, step, lambda acc: acc["bits"] + bits(acc["run"]))).otherwise(0.0)


def is_placeholder(col: Column) -> Column:
    return col.rlike(PLACEHOLDER)


def path_parts(col: Column) -> Column:
    """Lower-case segments, without empty ones and single dots."""
    return F.filter(F.split(F.lower(F.translate(col, "\\", "/")), "/"), lambda p: (p != "") & (p != "."))


def classify_path(col: Column) -> Column:
    """struct(scope, reason) of a path. The first rule that holds decides."""
    parts = path_parts(col)
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    has = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    base = F.regexp_replace(F.regexp_replace(name, r"\.ya?ml$", ""), r"^\.+", "")
    manifest = name.rlike(r"\.ya?ml$") & ((base == "gitlab-ci") | F.coalesce(F.element_at(folders, -1) == "workflows", F.lit(False)) | has(MANIFEST_DIRS) | base.rlike(f"^(?:{MANIFESTS})$|^(?:{MANIFESTS})-|-(?:{MANIFESTS})$"))
    answer = lambda scope, reason: F.struct(F.lit(scope).alias("scope"), F.lit(reason).alias("reason"))
    unknown = (F.size(parts) == 0) | F.array_contains(parts, "..")
    folders_safe = F.size(parts) > 1
    return (
        F.when(col.isNull() | unknown, answer("unknown", "unknown-path"))
        .when(name.rlike(INFRASTRUCTURE) | (folders_safe & manifest), answer("infrastructure", "infrastructure-file"))
        .when(folders_safe & has(VENDORED), answer("vendored", "vendored-directory"))
        .when(folders_safe & has(FIXTURES), answer("fixture", "fixture-directory"))
        .when((folders_safe & has(TESTS)) | name.rlike(r"\.test\.|\.spec\.|^test_|_test\.go$|_tests?\.rs$"), answer("test", "test-name"))
        .when(name.rlike(r"\.min\.js$|\.pb\.go$"), answer("generated", "generated-file-name"))
        .when(folders_safe & has(GENERATED), answer("generated", "generated-directory"))
        .when(folders_safe & has(DOCS), answer("documentation", "documentation-directory"))
        .otherwise(answer("production", "production-default"))
    )


def canonical_context(col: Column) -> Column:
    """Line feeds only, no line-number gutter, each line and the whole trimmed."""
    rows = F.split(F.replace(col, F.lit("\r\n"), F.lit("\n")), "\n")
    bare = F.transform(rows, lambda r: F.regexp_replace(F.regexp_replace(r, r"^(?=[ ]*[0-9])[ 0-9]+ │ ", ""), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(bare, "\n"), r"^\s+|\s+$", "")


def length_prefixed_sha256(*cols: Column) -> Column:
    """sha256 over the fields, each after its length in bytes as eight bytes, high first."""
    out = []
    for c in cols:
        out += [F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0")), F.encode(c, "utf-8")]
    return F.sha2(F.concat(*out), 256)


def fingerprint_base(version: int, category: Column, rule: Column, path: Column, context: Column) -> Column:
    return length_prefixed_sha256(F.lit(str(version)), category, rule, F.translate(path, "\\", "/"), canonical_context(context))
