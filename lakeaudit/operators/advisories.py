"""Advisories against inventories: matching with verdicts, coverage, enrichment, usage, claims, decisions, upgrades.

Packages are matched as distinct (ecosystem, name, version) triples and joined back to their occurrences. A verdict that
can't be decided is undetermined and kept, never dropped. Version work runs in Arrow batches over distinct inputs.
"""

from __future__ import annotations

import json
from functools import lru_cache

try:
    import ahocorasick
except ImportError:  # then every name is looked for on its own
    ahocorasick = None
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StringType, StructType

from lakeaudit.functions import versions as V
from lakeaudit.functions.session import cut, shuffled

TRIPLE = ["ecosystem", "name", "version"]
CVE = r"^CVE-[0-9]{4}-[0-9]{4,}$"


@lru_cache(maxsize=100_000)
def _events(text: str) -> list[dict]:
    return json.loads(text)


@lru_cache(maxsize=500_000)
def _verdict(family: str | None, version: str, events: str | None) -> str:
    return V.AFFECTED if events is None else V.range_verdict(family, version, _events(events))


@F.pandas_udf(StringType())
def range_verdict(family: pd.Series, version: pd.Series, events: pd.Series) -> pd.Series:
    return pd.Series([_verdict(f, v, e) for f, v, e in zip(family, version, events, strict=True)])


def base_ecosystem(col: Column) -> Column:
    return F.split(col, ":")[0]


def ecosystem_within(scope: Column, ecosystem: Column) -> Column:
    """The same ecosystem, or a bare distribution name and one of its releases."""
    return (scope == ecosystem) | (~F.contains(scope, F.lit(":")) & F.startswith(ecosystem, F.concat(scope, F.lit(":"))))


def dedupe_dependencies(deps: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*TRIPLE).orderBy(*order)
    return deps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def queryable(deps: DataFrame) -> DataFrame:
    """Registry packages with a name and a version; a null source is a registry's."""
    named = (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("version", F.lit(""))) != "")
    return deps.where(named & F.col("ecosystem").isNotNull() & ~F.coalesce("local_workspace", F.lit(False)) & ~F.coalesce("source", F.lit("registry")).isin("git", "local", "url"))


_SPANS = StructType().add("exact", BooleanType()).add("unplaced", StringType()).add("spans", ArrayType(StructType().add("lo", BinaryType()).add("hi", BinaryType()).add("verdict", StringType())))


@lru_cache(maxsize=100_000)
def _range_spans(family: str | None, events: str):
    return V.range_spans(family, _events(events))


@F.pandas_udf(_SPANS)
def range_spans(family: pd.Series, events: pd.Series) -> pd.DataFrame:
    """A range's spans of order keys, once for all versions (see versions.range_spans); not exact where there are none."""
    found = [_range_spans(f, e) for f, e in zip(family, events, strict=True)]
    spans = [[{"lo": lo, "hi": hi, "verdict": v} for lo, hi, v in x[1]] if x else [] for x in found]
    return pd.DataFrame({"exact": [x is not None for x in found], "unplaced": [x[0] if x else None for x in found], "spans": spans}, columns=["exact", "unplaced", "spans"])


def _scopes(ecosystem: Column, own: bool) -> Column:
    """What an ecosystem is looked up by, so that an inventory's and an advisory's meet once if one is the other or its bare distribution.

    A release meets itself and the bare name; a bare name meets itself and all of its releases.
    """
    base = base_ecosystem(ecosystem)
    return F.when(ecosystem == base, F.array(base, F.concat(base, F.lit(":*"))) if own else F.array(base)).otherwise(F.array(ecosystem, base) if own else F.array(ecosystem, F.concat(base, F.lit(":*"))))


def swept(versions: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """spans (by, lo, hi, and payload) joined with the versions (by, key, and payload) whose key lies from lo to before hi.

    Versions and boundaries of a group are put in one order, in which a boundary's place is the number of distinct keys
    before it. A span is then a run of whole numbers, and each number in it joins the versions of that place: work goes
    with versions, boundaries and matches, and no pair that doesn't match is made. Matches are dealt by group and place,
    so a group with many isn't one task; a group's distinct keys and boundaries are sorted in one, and may spill.
    """
    payload = [c for c in spans.columns if c not in (*by, "lo", "hi")]
    ends = spans.select(*by, F.explode(F.array("lo", "hi")).alias("key"), F.lit(0).alias("is_key"), F.struct("lo", "hi", *payload).alias("span"))
    keys = versions.select(*by, "key").distinct().withColumns({"is_key": F.lit(1), "span": F.lit(None).cast(ends.schema["span"].dataType)})
    # A boundary comes before the version with its key.
    order = Window.partitionBy(*by).orderBy("key", "is_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = keys.unionByName(ends).withColumn("place", F.sum("is_key").over(order))
    runs = placed.where("is_key = 0").groupBy(*by, "span").agg(F.min("place").alias("a"), F.max("place").alias("b")).where(F.col("a") < F.col("b"))
    hits = runs.select(*by, *(F.col(f"span.{c}").alias(c) for c in payload), F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("place"))
    found = hits.join(shuffled(placed.where("is_key = 1").select(*by, "place", "key")), [*by, "place"]).drop("place")
    return found.join(shuffled(versions), [*by, "key"])


def match_advisories(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """ecosystem, name, version, advisory_id, verdict (affected or undetermined), for distinct triples of deps.

    advisories: id, ecosystem, package, withdrawn, versions, ranges (type, events). Withdrawn ones never match and GIT
    ranges are skipped. An advisory that matches by several records gives one row, affected before undetermined.

    A range becomes spans of order keys once, and versions meet spans by a sweep in that order (swept). Versions without
    a place meet only ranges that leave them undetermined or affect every version. Versions and ranges whose order keys can't
    say it all, some of Maven's, are compared one by one. No side is broadcast, as advisories and versions may both be many.
    """
    by = ["pkg", "scope", "family"]
    adv = advisories.where(F.col("withdrawn").isNull()).select(F.col("id").alias("advisory_id"), "ecosystem", V.normalize_package(F.col("ecosystem"), F.col("package")).alias("pkg"), "versions", "ranges")
    adv = adv.withColumn("scope", F.explode(_scopes(F.col("ecosystem"), False)))
    listed = adv.select("pkg", "scope", "advisory_id", F.explode("versions").alias("version"))
    ranged = adv.select("pkg", "scope", "ecosystem", "advisory_id", F.explode(F.filter("ranges", lambda r: r["type"] != "GIT")).alias("range"))
    family = F.when(F.col("range.type") == "SEMVER", "semver").otherwise(F.coalesce(V.ecosystem_family(F.col("ecosystem")), F.lit("")))
    ranged = ranged.select("pkg", "scope", "advisory_id", family.alias("family"), F.to_json("range.events").alias("events")).distinct()
    ranged = cut(ranged.withColumn("x", range_spans(F.nullif("family", F.lit("")), "events")))  # several joins read it
    triples = queryable(deps).select(*TRIPLE).distinct().withColumn("pkg", V.normalize_package(F.col("ecosystem"), F.col("name"))).withColumn("scope", F.explode(_scopes(F.col("ecosystem"), True)))
    # Versions of packages without a range need no key.
    own = triples.withColumn("family", F.explode(F.array_distinct(F.array(F.lit("semver"), F.coalesce(V.ecosystem_family(F.col("ecosystem")), F.lit(""))))))
    own = cut(own.join(shuffled(ranged.select(*by).distinct()), by, "left_semi").withColumn("key", V.version_key("family", "version")))
    exact, verdict = F.col("x.exact"), [*TRIPLE, "advisory_id", "verdict"]
    spans = ranged.where(exact).select(*by, "advisory_id", F.explode("x.spans").alias("s")).select(*by, "advisory_id", "s.lo", "s.hi", "s.verdict")
    found = swept(own.where(F.col("key").isNotNull()), spans, by).select(*verdict)
    unkeyed = own.where(F.col("key").isNull()).withColumn("placed", F.when(F.col("family") == "", False).otherwise(V.orderable("family", "version")))
    loose = unkeyed.where(~F.col("placed")).join(shuffled(ranged.where(exact & F.col("x.unplaced").isNotNull()).select(*by, "advisory_id", F.col("x.unplaced").alias("verdict"))), by).select(*verdict)
    sure = triples.join(shuffled(listed), ["pkg", "scope", "version"]).withColumn("verdict", F.lit(V.AFFECTED)).select(*verdict)
    one = own.join(shuffled(ranged.where(~exact).select(*by, "advisory_id", "events")), by).select(*TRIPLE, "advisory_id", "family", "events")
    one = one.unionByName(unkeyed.where("placed").join(shuffled(ranged.where(exact).select(*by, "advisory_id", "events")), by).select(*TRIPLE, "advisory_id", "family", "events"))
    one = one.withColumn("verdict", range_verdict("family", "version", "events")).where(F.col("verdict") != V.NOT_AFFECTED).select(*verdict)
    return found.unionByName(loose).unionByName(sure).unionByName(one).groupBy(*TRIPLE, "advisory_id").agg(F.min("verdict").alias("verdict"))  # affected sorts first


def match_notes(matches: DataFrame, examples: int = 5) -> DataFrame:
    """Counts of verdicts, and the first undetermined packages in order."""
    open_ = F.col("verdict") == V.UNDETERMINED
    label = F.concat_ws("@", F.concat_ws("/", "ecosystem", "name"), "version")
    first = matches.where(open_).select(label.alias("label")).distinct().orderBy("label").limit(examples)
    counts = matches.agg(F.count_if(~open_).alias("affected"), F.count_if(open_).alias("undetermined"))
    return counts.join(F.broadcast(first.agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("examples"))))  # one row each


def skipped_evidence(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """withdrawn, git_ranges: withdrawn advisories of packages that the inventory has, and GIT ranges that its matching skips."""
    own = queryable(deps).select(V.normalize_package(F.col("ecosystem"), F.col("name")).alias("pkg"), base_ecosystem(F.col("ecosystem")).alias("base")).distinct()
    adv = advisories.select("id", V.normalize_package(F.col("ecosystem"), F.col("package")).alias("pkg"), base_ecosystem(F.col("ecosystem")).alias("base"), "withdrawn", "ranges").join(shuffled(own), ["pkg", "base"], "left_semi")
    git = F.size(F.filter("ranges", lambda r: r["type"] == "GIT"))
    return adv.agg(F.countDistinct(F.when(F.col("withdrawn").isNotNull(), F.col("id"))).alias("withdrawn"), F.coalesce(F.sum(F.when(F.col("withdrawn").isNull(), git)), F.lit(0)).alias("git_ranges"))


def missing_coverage(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Ecosystems that are asked for and that the database has nothing of: an error, not a clean result."""
    asked = queryable(deps).select("ecosystem").distinct().withColumn("base", base_ecosystem(F.col("ecosystem")))
    held = advisories.select(F.col("ecosystem").alias("held")).distinct().withColumn("base", base_ecosystem(F.col("held")))
    within = ecosystem_within(F.col("held"), F.col("ecosystem")) | ecosystem_within(F.col("ecosystem"), F.col("held"))
    return asked.join(held, (asked["base"] == held["base"]) & within, "left_anti").select("ecosystem")


def advisory_db_counts(advisories: DataFrame) -> DataFrame:
    return advisories.agg(F.countDistinct("id").alias("advisories"), F.countDistinct("ecosystem", "package").alias("packages"))


def first_cve(id_col: Column, aliases: Column) -> Column:
    return F.get(F.filter(F.concat(F.array(id_col), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: x.rlike(CVE)), F.lit(0))


def enrich_exploit(vulns: DataFrame, kev: DataFrame, epss: DataFrame, poc: DataFrame) -> DataFrame:
    """vulns (id, aliases) with known_exploited, ransomware, epss, epss_percentile, public_exploit by their first CVE; absent is false or null.

    A CVE that a feed repeats counts once: ransomware if any row says so, and the row of the highest epss.
    """
    v = vulns.withColumn("cve", first_cve(F.col("id"), F.col("aliases")))
    kev = kev.groupBy("cve").agg(F.bool_or("ransomware").alias("ransomware"))
    scores = [c for c in epss.columns if c != "cve"]
    epss = epss.groupBy("cve").agg(F.max(F.struct(*scores)).alias("_e")).select("cve", *(F.col(f"_e.{c}").alias(c) for c in scores))
    x = v.join(kev.select("cve", F.lit(True).alias("known_exploited"), "ransomware"), "cve", "left").join(epss, "cve", "left").join(poc.select("cve", F.lit(True).alias("public_exploit")).distinct(), "cve", "left")
    return x.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("known_exploited", "ransomware", "public_exploit")})


def enrich_cwe(findings: DataFrame, kev: DataFrame) -> DataFrame:
    """findings with the number of exploited CVEs of their weakness."""
    per = kev.select("cve", F.explode("cwes").alias("cwe")).groupBy("cwe").agg(F.countDistinct("cve").alias("exploited_cves"))
    return findings.join(per, "cwe", "left").withColumn("exploited_cves", F.coalesce("exploited_cves", F.lit(0))).withColumn("exploited", F.col("exploited_cves") > 0)


#: The ecosystems whose imports name packages, and words of their languages that name none.
MAPPED = ["npm", "PyPI", "crates.io", "Go", "RubyGems", "Packagist"]
_NO_MODULE = ["stdlib", "toolchain"]  # of Go: imported by path, or not at all
_NO_CRATE = ["crate", "self", "super"]


def canonical_name(ecosystem: Column, name: Column) -> Column:
    """A package's name as imports spell it; null where the ecosystem's imports name no packages."""
    low = F.lower(name)
    spelt = F.when(ecosystem == "npm", low).when(ecosystem.isin("PyPI", "crates.io", "RubyGems"), F.translate(low, "-", "_"))
    return spelt.when(ecosystem == "Go", name).when(ecosystem == "Packagist", F.translate(low, "/", "\\"))


def canonical_names(ecosystem: Column, name: Column) -> Column:
    """The spellings by which a package can be imported, the full one first: ``vendor/vendor`` of Packagist owns the bare vendor, too."""
    full = canonical_name(ecosystem, name)
    parts = F.split(full, r"\\", 2)
    twin = (ecosystem == "Packagist") & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == F.get(parts, F.lit(1)))
    return F.when(full.isNotNull(), F.when(twin, F.array(full, F.get(parts, F.lit(0)))).otherwise(F.array(full)))


def _found(content: Column, *patterns: str) -> Column:
    return F.flatten(F.array(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns)))


def _leading(paths: Column, separator: str) -> Column:
    """Every path and every part of it that ends before a separator: a module is imported as itself or by what is under it."""
    parts = lambda p: F.split(p, "\\Q" + separator + "\\E")
    return F.flatten(F.transform(paths, lambda p: F.transform(F.sequence(F.lit(1), F.size(parts(p))), lambda n: F.array_join(F.slice(parts(p), F.lit(1), n), separator))))


def import_names(content: Column) -> dict[str, Column]:
    """Per mapped ecosystem, the canonical names (an array) that a source's imports may mean. Relative imports name none."""
    quoted = lambda words: rf"\b{words}[\"']([^\"']+)[\"']"
    modules = F.filter(_found(content, quoted(r"(?:from|import|require)\s+"), quoted(r"(?:import|require)\s*\(\s*")), lambda m: ~m.rlike("^[./]"))
    npm = F.transform(modules, lambda m: F.lower(F.regexp_extract(m, "^(@[^/]+/[^/]+|[^@/][^/]*)", 1)))
    under = lambda names: F.transform(names, lambda n: F.translate(F.lower(n), "-", "_"))
    blocks = F.transform(_found(content, r"(?s)\bimport\s*\(([^)]*)\)"), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1)))
    return {
        "npm": npm, "PyPI": under(_found(content, r"(?m)^\s*import\s+(\w+)", r"(?m)^\s*from\s+(\w+)[\w.]*\s+import")), "crates.io": F.array_except(under(_found(content, r"(?m)^\s*(?:use|extern\s+crate)\s+([a-zA-Z_]\w*)")), F.array(*map(F.lit, _NO_CRATE))),
        "Go": _leading(F.concat(_found(content, r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.flatten(blocks)), "/"), "RubyGems": under(F.transform(_found(content, quoted(r"(?:require|gem)\s+")), lambda g: F.split(g, "/")[0])),
        "Packagist": _leading(F.transform(_found(content, r"\buse\s+\\?([A-Za-z_][\w\\]*)\s*;"), F.lower), "\\"),
    }


def usage_index(corpus: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """ecosystem, project_id, name, files, first_path: packages that sources import, by canonical name.

    Imports are those of the mapped ecosystems' languages, or what patterns (group 1 by ecosystem) find.
    """
    names = import_names(F.col("content")) if patterns is None else {e: F.regexp_extract_all("content", F.lit(p), F.lit(1)) for e, p in patterns.items()}
    found = F.concat(*(F.transform(F.array_distinct(F.filter(own, lambda n: n != "")), _named(e)) for e, own in names.items()))
    # A path's names are brought together before they are dealt out, so that none is counted twice and no task holds every pair of a name and a path.
    per = corpus.select("project_id", "path", found.alias("names")).groupBy("project_id", "path").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    refs = per.select("project_id", "path", F.explode("names").alias("x")).select("project_id", "path", "x.*")
    return refs.groupBy("ecosystem", "project_id", "name").agg(F.count("path").alias("files"), F.min("path").alias("first_path"))


def _named(ecosystem: str):
    return lambda name: F.struct(F.lit(ecosystem).alias("ecosystem"), name.alias("name"))


def direct_usage(vulns: DataFrame, usage: DataFrame, mapped: list[str] | None = None, incomplete: DataFrame | None = None) -> DataFrame:
    """vulns with files, first_path and used: true, false, or null where it can't be told.

    That is where imports of the ecosystem aren't mapped, for Go's standard library and toolchain, and where nothing is
    found in a project whose index is incomplete. usage holds canonical names; a package's first spelling that has a use counts.
    """
    told = F.when(~((F.col("ecosystem") == "Go") & F.col("name").isin(*_NO_MODULE)), canonical_names(F.col("ecosystem"), F.col("name")))
    x = vulns.withColumn("_names", told)
    for i in (0, 1):
        own = usage.select("ecosystem", "project_id", F.col("name").alias(f"_k{i}"), F.struct("files", "first_path").alias(f"_u{i}"))
        x = x.withColumn(f"_k{i}", F.get("_names", F.lit(i))).join(own, ["ecosystem", "project_id", f"_k{i}"], "left")
    x = x.withColumn("_u", F.coalesce("_u0", "_u1")).withColumns({"files": F.col("_u.files"), "first_path": F.col("_u.first_path")})
    known = F.col("ecosystem").isin(*(mapped or MAPPED)) & F.col("_names").isNotNull()
    if incomplete is not None:
        x = x.join(incomplete.select("project_id", F.lit(True).alias("_part")).distinct(), "project_id", "left")
        known &= F.col("_part").isNull() | F.col("files").isNotNull()
    return x.withColumn("used", F.when(known, F.col("files").isNotNull())).drop("_names", "_k0", "_k1", "_u0", "_u1", "_u", "_part")


def referenced_functions(functions: DataFrame, corpus: DataFrame, most: int = 200_000) -> DataFrame:
    """project_id, function: affected functions (project_id, function) that occur literally in the project's sources; blank ones don't.

    Every task builds one automaton over the distinct names and reads its contents once, where they lie; what it finds, a
    few names a content, is joined with the projects that asked. More than ``most`` names are looked for in several passes.
    """
    wanted = functions.select("project_id", F.trim("function").alias("function")).where(F.col("function") != "").distinct()
    names = cut(wanted.select("function").distinct())
    passes = max(1, -(-names.count() // most))
    kind = corpus.schema["project_id"].dataType.simpleString()
    sources, found = corpus.select("project_id", "content"), None
    for k in range(passes):
        own = tuple(r[0] for r in names.where(F.pmod(F.xxhash64("function"), F.lit(passes)) == k).collect())  # about most names, never all of many
        hits = sources.mapInArrow(_finder(own), f"project_id {kind}, function string")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct().join(wanted, ["project_id", "function"], "left_semi")


def _finder(names: tuple[str, ...]):
    """For mapInArrow: the names that occur in each content, each once a batch and project."""

    def run(batches):
        find = _all_of(names)
        for batch in batches:
            pairs = {}
            for project, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = content.as_py()
                if text:
                    pairs |= dict.fromkeys((project, name) for name in find(text))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], batch.column(0).type), pa.array([n for _, n in pairs], pa.string())], ["project_id", "function"])

    return run


def _all_of(names: tuple[str, ...]):
    if not names or ahocorasick is None:
        return lambda text: {n for n in names if n in text}
    automaton = ahocorasick.Automaton()
    for n in names:
        automaton.add_word(n, n)
    automaton.make_automaton()
    return lambda text: {n for _, n in automaton.iter(text)}


#: Why a trusted claim is unmapped.
NO_SUBJECT, NO_MATCH = "no subject identity", "no local vulnerability with this advisory and exact package identity"


def vex_suggestions(claims: DataFrame, grants: DataFrame, vulns: DataFrame) -> DataFrame:
    """record_id, document, outcome, reason, advisory_id and triple: what trusted documents' claims say of the inventory's advisories.

    suggested: a not_affected claim, with each match that it names; unmapped: a claim of any status that names none, and why;
    untrusted: every claim of a document without a grant. A match is named by its id or an alias and by one of the claim's
    subject_ids, a purl (pkg:ecosystem/name@version) or ecosystem:name@version, never by name alone; all in any case, trimmed.
    """
    plain = lambda c: F.lower(F.btrim(c, F.lit(" \t\r\n")))
    claim, none = ["document", "record_id"], F.lit(None).cast("string")
    trusted = claims.join(grants, "document", "left_semi")
    ids = F.concat(F.array("advisory_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = vulns.select(*TRIPLE, "advisory_id", F.explode(F.array_distinct(F.transform(ids, plain))).alias("vuln"), F.lower(F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version")).alias("subject"))
    # A purl is written as coordinates; a subject is also taken as it is.
    forms = F.flatten(F.transform("subject_ids", lambda s: F.array(plain(s), F.regexp_replace(plain(s), "^pkg:([^/]*)/", "$1:"))))
    asked = trusted.select(*claim, "status", plain(F.col("vulnerability_id")).alias("vuln"), F.explode(F.array_distinct(forms)).alias("subject"))
    hits = asked.join(shuffled(known), ["vuln", "subject"]).select(*claim, "status", "advisory_id", *TRIPLE).distinct()
    suggested = hits.where(F.col("status") == "not_affected").select(*claim, F.lit("suggested").alias("outcome"), none.alias("reason"), "advisory_id", *TRIPLE)
    without = lambda df, outcome, reason: df.select(*claim, F.lit(outcome).alias("outcome"), reason.alias("reason"), *(none.alias(c) for c in ("advisory_id", *TRIPLE)))
    why = F.when(F.coalesce(F.size("subject_ids"), F.lit(0)) <= 0, NO_SUBJECT).otherwise(NO_MATCH)
    unmapped = without(trusted.join(shuffled(hits), claim, "left_anti"), "unmapped", why)
    return suggested.unionByName(unmapped).unionByName(without(claims.join(grants, "document", "left_anti"), "untrusted", none))


def advisory_decision(vulns: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """vulns with decision: the last unexpired matching entry's state, ``expired`` where only expired ones match, else null.

    entries: position, vuln, and ecosystem, package, version that are null where they hold for all, state, expires_at.
    """
    fits = lambda col, e: F.col(e).isNull() | (F.col(col) == F.col(e))
    e = entries.select("position", F.lower("vuln").alias("vuln"), F.col("ecosystem").alias("e_ecosystem"), F.col("package").alias("e_package"), F.col("version").alias("e_version"), "state", "expires_at")
    keyed = vulns.withColumn("vuln", F.explode(F.array_distinct(F.transform(F.concat(F.array("advisory_id"), "aliases"), F.lower))))
    met = keyed.join(shuffled(e), "vuln").where(fits("ecosystem", "e_ecosystem") & fits("name", "e_package") & fits("version", "e_version"))
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    won = met.groupBy(*TRIPLE, "advisory_id").agg(F.max(F.when(live, F.struct("position", "state"))).alias("live"), F.count_if(~live).alias("late"))
    won = won.select(*TRIPLE, "advisory_id", F.coalesce("live.state", F.when(F.col("late") > 0, "expired")).alias("decision"))
    return vulns.join(shuffled(won), [*TRIPLE, "advisory_id"], "left")


def baseline_problems(summaries: DataFrame, deps: DataFrame, vulns: DataFrame) -> DataFrame:
    """baseline_id, problem: baselines that aren't whole, with the first reason.

    summaries: baseline_id, schema_version, kind, advisory_coverage, packages_found, packages_queried, vulnerabilities_found.
    deps and vulns: baseline_id, triple, lockfile, and advisory_id of vulns. Counts must agree with the rows, names be there,
    and every advisory name a row of the inventory.
    """
    keys = [*TRIPLE, "lockfile"]
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    any_blank = lambda cols: F.greatest(*(blank(c).cast("int") for c in cols))
    local = F.coalesce("local_workspace", F.lit(False)) & F.col("ecosystem").isin("Go", "npm")  # workspace members may have no version
    per = deps.groupBy("baseline_id").agg(F.count("*").alias("n_deps"), F.max(F.greatest(any_blank(["ecosystem", "name", "lockfile"]), (blank("version") & ~local).cast("int"))).alias("unnamed"))
    asked = queryable(deps).select("baseline_id", *TRIPLE).distinct().groupBy("baseline_id").agg(F.count("*").alias("n_asked"))
    inventory = deps.select("baseline_id", *keys, F.lit(False).alias("_out")).distinct()
    found = vulns.join(inventory, ["baseline_id", *keys], "left").groupBy("baseline_id").agg(F.count("*").alias("n_vulns"), F.max(F.greatest(any_blank([*keys, "advisory_id"]), F.coalesce("_out", F.lit(True)).cast("int"))).alias("outside"))
    x = summaries.join(per, "baseline_id", "left").join(asked, "baseline_id", "left").join(found, "baseline_id", "left").fillna(0, ["n_deps", "unnamed", "n_asked", "n_vulns", "outside"])
    whole = (F.col("schema_version") == 1) & (F.col("kind") == "dependencies") & (F.col("advisory_coverage") == "complete")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    tests = [
        ("not a complete report", ~F.coalesce(whole, F.lit(False))), ("counts disagree", differs("packages_found", "n_deps") | differs("vulnerabilities_found", "n_vulns")), ("query counts disagree", differs("packages_queried", "n_asked")),
        ("unnamed inventory row", F.col("unnamed") > 0), ("advisory outside the inventory", F.col("outside") > 0),
    ]
    return x.select("baseline_id", F.coalesce(*(F.when(test, name) for name, test in tests)).alias("problem")).where(F.col("problem").isNotNull())


def new_advisories_vs_baseline(vulns: DataFrame, baseline: DataFrame) -> DataFrame:
    """Advisories of a package version that the baseline doesn't have, wherever it is locked. A baseline with baseline_problems is none."""
    keys = [*TRIPLE, "advisory_id"]
    return vulns.select(*keys).distinct().join(shuffled(baseline.select(*keys)), keys, "left_anti")


def monitor(inventories: DataFrame, advisories: DataFrame, reported: DataFrame) -> DataFrame:
    """run_id, triple, advisory_id, verdict: matches of stored inventories whose id and aliases were all unreported for the run's component.

    reported: run_id, ecosystem, name, version, reported_id. advisories also has aliases. Matches are made once for each
    distinct package version; a run's component carries the ids reported for it that its package's advisories bear, so that
    where there are none, as of most, no match is tested. Rows go with run components times their matches.
    """
    known_by = _known_by(match_advisories(inventories, advisories), advisories)
    there = told_components(inventories, advisories, reported)
    return there.join(shuffled(known_by), TRIPLE).where(F.col("told").isNull() | ~F.arrays_overlap("ids", "told")).select("run_id", *TRIPLE, "advisory_id", "verdict")


def told_components(inventories: DataFrame, advisories: DataFrame, reported: DataFrame) -> DataFrame:
    """run_id, triple, told: the runs' components with the ids reported for them that advisories of their package bear, null where there are none.

    To these advisories, components of a version with equal told are alike.
    """
    told = _borne(reported, advisories).groupBy("run_id", *TRIPLE).agg(F.array_sort(F.collect_set("reported_id")).alias("told"))
    return inventories.select("run_id", *TRIPLE).distinct().join(told.hint("shuffle_hash"), ["run_id", *TRIPLE], "left")  # the few are hashed, the many not sorted


def _borne(reported: DataFrame, advisories: DataFrame) -> DataFrame:
    """The rows of reported whose id some advisory of the package, in any release of its ecosystem, has as its own or as an alias; no other can strike out a match."""
    of = lambda name: [V.normalize_package(F.col("ecosystem"), F.col(name)).alias("_pkg"), base_ecosystem(F.col("ecosystem")).alias("_base")]
    ids = F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))
    borne = advisories.select(*of("package"), F.explode(F.array_distinct(ids)).alias("reported_id"))
    return reported.select("*", *of("name")).join(borne.distinct().hint("shuffle_hash"), ["_pkg", "_base", "reported_id"], "left_semi").select(*reported.columns)


def _known_by(matches: DataFrame, advisories: DataFrame) -> DataFrame:
    """matches with ids: the advisory's own and its aliases."""
    aliases = advisories.select(F.col("id").alias("advisory_id"), F.explode("aliases").alias("alias")).groupBy("advisory_id").agg(F.collect_set("alias").alias("aliases"))
    return matches.join(shuffled(aliases), "advisory_id", "left").select(*TRIPLE, "advisory_id", "verdict", F.concat(F.array("advisory_id"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("ids"))


def _told(inventories: DataFrame, reported: DataFrame) -> DataFrame:
    """run_id, triple, told: the runs' components with the ids that were reported of them, in order."""
    # In a union, so that the runs' components and what was reported of them meet in one shuffle.
    told = reported.select("run_id", *TRIPLE, F.col("reported_id").alias("told")).where(F.col("told").isNotNull())
    both = inventories.select("run_id", *TRIPLE).withColumn("told", F.lit(None).cast("string")).unionByName(told)
    return both.groupBy("run_id", *TRIPLE).agg(F.array_sort(F.collect_set("told")).alias("told"), F.count_if(F.col("told").isNull()).alias("held")).where(F.col("held") > 0)


def monitor_counts(inventories: DataFrame, advisories: DataFrame, reported: DataFrame) -> DataFrame:
    """run_id, affected, undetermined: the numbers of rows that monitor finds, without a row for each run and match.

    A package version's matches are counted once, and those that its reported ids strike out once for each distinct set of
    them; a run's component adds the difference. Runs without a match have no row.
    """
    matches = match_advisories(inventories, advisories)
    there, numbers = _told(inventories, reported), {"affected": F.count_if(F.col("verdict") == V.AFFECTED), "undetermined": F.count_if(F.col("verdict") == V.UNDETERMINED)}
    all_ = matches.groupBy(*TRIPLE).agg(*(n.alias(c) for c, n in numbers.items()))
    sets = there.select(*TRIPLE, "told").distinct()
    named = _known_by(matches, advisories).select(*TRIPLE, "advisory_id", "verdict", F.explode(F.array_distinct("ids")).alias("id"))
    struck = sets.select(*TRIPLE, "told", F.explode("told").alias("id")).join(shuffled(named), [*TRIPLE, "id"]).select(*TRIPLE, "told", "advisory_id", "verdict").distinct()
    struck = struck.groupBy(*TRIPLE, "told").agg(*(n.alias(f"_{c}") for c, n in numbers.items()))
    left = sets.join(shuffled(all_), TRIPLE).join(shuffled(struck), [*TRIPLE, "told"], "left").fillna(0, [f"_{c}" for c in numbers])
    left = left.select(*TRIPLE, "told", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in numbers))
    return there.join(shuffled(left), [*TRIPLE, "told"]).groupBy("run_id").agg(*(F.sum(c).alias(c) for c in numbers))


def monitor_runs(inventories: DataFrame, advisories: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each run of the inventories: components, affected, undetermined (of what monitor found, or its monitor_counts) and coverage_error.

    coverage_error: the first ecosystem, in order, that the run asks for and the database has nothing of. Its counts then say nothing.
    """
    per = queryable(inventories).groupBy("run_id").agg(F.countDistinct(*TRIPLE).alias("components"))
    counts = found if "verdict" not in found.columns else found.groupBy("run_id").agg(F.count_if(F.col("verdict") == V.AFFECTED).alias("affected"), F.count_if(F.col("verdict") == V.UNDETERMINED).alias("undetermined"))
    lacking = queryable(inventories).select("run_id", "ecosystem").distinct().join(missing_coverage(inventories, advisories), "ecosystem", "left_semi").groupBy("run_id").agg(F.min("ecosystem").alias("coverage_error"))
    return per.join(shuffled(counts), "run_id", "left").join(shuffled(lacking), "run_id", "left").fillna(0, ["affected", "undetermined"])


def release_facts(deps: DataFrame, releases: DataFrame) -> DataFrame:
    """Per distinct triple: its release's date and deprecation, the default version, the newest date, releases above it, majors behind.

    releases: ecosystem, name, version, published_at, is_default, deprecated. Versions are ordered by their ecosystem's
    family; newer is null where the installed one has no place there, majors_behind where it or the default has no leading
    major. Of several defaults the greatest text counts. Go's leading v doesn't matter for which release is the installed one.

    Each distinct version gets its order key once, and Spark ranks a package's versions by it in a window, which may spill.
    """
    go = lambda e, v: F.when(F.col(e) == "Go", F.regexp_replace(v, "^v+", "")).otherwise(F.col(v))
    own = deps.select(*TRIPLE).distinct()
    versions = own.withColumns({"installed": F.lit(True), "releases": F.lit(0).cast("long")}).unionByName(releases.groupBy(*TRIPLE).agg(F.count("*").alias("releases")).withColumn("installed", F.lit(False)))
    versions = versions.groupBy(*TRIPLE).agg(F.bool_or("installed").alias("installed"), F.sum("releases").alias("releases"))
    family = V.ecosystem_family(F.col("ecosystem"))
    versions = versions.withColumn("key", F.when(family.isNotNull(), V.version_key(F.coalesce(family, F.lit("")), "version")))
    above = Window.partitionBy("ecosystem", "name").orderBy(F.desc("key")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beside = Window.partitionBy("ecosystem", "name", "key")
    ranked = versions.withColumn("newer", F.when(F.col("key").isNotNull(), F.sum("releases").over(above) - F.sum("releases").over(beside))).where("installed").select(*TRIPLE, "newer")
    per = releases.groupBy("ecosystem", "name").agg(F.max("published_at").alias("newest_at"), F.max(F.when(F.col("is_default"), F.col("version"))).alias("default_version"))
    exact = releases.groupBy("ecosystem", "name", go("ecosystem", "version").alias("_v")).agg(F.min("published_at").alias("published_at"), F.max("deprecated").alias("deprecated"))
    out = ranked.withColumn("_v", go("ecosystem", "version")).join(exact, ["ecosystem", "name", "_v"], "left").join(per, ["ecosystem", "name"], "left")
    behind = F.greatest(F.lit(0).cast("long"), V.leading_major(F.col("default_version")) - V.leading_major(F.col("version")))
    known = V.leading_major(F.col("default_version")).isNotNull() & V.leading_major(F.col("version")).isNotNull()
    return out.select(*TRIPLE, "published_at", "deprecated", "default_version", "newest_at", "newer", F.when(known, behind).alias("majors_behind"))


def os_advisory_keys(packages: DataFrame, streams: dict[str, list[str]], by_source: list[str]) -> DataFrame:
    """packages (distro, release, name, source_name) with the advisory ecosystems and the name they are filed under."""
    eco = F.concat_ws(":", "distro", "release")
    many = F.coalesce(F.create_map(*(x for k, v in streams.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("distro")], F.array(F.lit("")))
    names = F.transform(many, lambda s: F.when(s == "", eco).otherwise(F.concat_ws(":", eco, s)))
    filed = F.when(F.col("distro").isin(*by_source), F.coalesce("source_name", "name")).otherwise(F.col("name"))
    return packages.withColumn("filed_name", filed).withColumn("ecosystem", F.explode(names))


def advisory_policy_inputs(deps: DataFrame, vulns: DataFrame) -> DataFrame:
    """Occurrences, workspace members aside, with the sorted advisory ids of exactly their package, version and lockfile."""
    keys = [*TRIPLE, "lockfile"]
    per = vulns.groupBy(*keys).agg(F.array_sort(F.collect_set("advisory_id")).alias("advisories"))
    return deps.where(~F.coalesce("local_workspace", F.lit(False))).join(shuffled(per), keys, "left").withColumn("advisories", F.coalesce("advisories", F.array().cast("array<string>")))


@F.pandas_udf(StructType().add("candidate", "string").add("change", "string"))
def _upgrade(ecosystem: pd.Series, version: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    found = [V.lowest_fix(e, v, [_events(x) for x in own]) for e, v, own in zip(ecosystem, version, ranges, strict=True)]
    return pd.DataFrame({"candidate": found, "change": [V.first_change(v, f) if f else None for v, f in zip(version, found, strict=True)]}, dtype=object)


def upgrade_groups(vulns: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """The groups' keys, advisories, candidate, change: the lowest fixed version above the installed one that no advisory of the group affects.

    vulns: triple, lockfile, advisory_id, ranges (type, events), and install_path, workspace, entry_point where they are known.
    Order and verdicts are the ecosystem's. A fix that any advisory leaves undetermined is no candidate; a group whose version
    has no place, or that an advisory doesn't affect for certain, has none. Of a package version's advisories those of equal
    ranges are held once. advisories (advisory_id, ranges) may hold the ranges instead of vulns: they are then written out once each.
    """
    keys = [*TRIPLE, "lockfile", *(c for c in ("install_path", "workspace", "entry_point") if c in vulns.columns)]
    text = F.to_json(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranges"))))).alias("_range")
    if advisories is None:
        per = vulns.groupBy(*keys, "advisory_id").agg(text)
    else:
        per = vulns.select(*keys, "advisory_id").distinct().join(shuffled(advisories.groupBy("advisory_id").agg(text)), "advisory_id")
    alike = per.groupBy(*keys, "_range").agg(F.count("*").alias("n"))
    groups = alike.groupBy(*keys).agg(F.sum("n").alias("advisories"), F.array_sort(F.collect_list("_range")).alias("_ranges"))
    return groups.withColumn("_x", _upgrade("ecosystem", "version", "_ranges")).select(*keys, "advisories", "_x.candidate", "_x.change")
