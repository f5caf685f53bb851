"""Readers: corpora of files, advisory and exploit feeds, release indexes, lockfiles, package databases, SBOMs, claims.

Schemas are declared; nothing is inferred. A feed that is malformed fails rather than losing records; of many files, a broken one is a row that says so.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Languages by file name and by extension.
BY_NAME = {"dockerfile": "dockerfile", "makefile": "make", "gemfile": "ruby", "rakefile": "ruby", "jenkinsfile": "groovy"}
BY_EXTENSION = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cs": "csharp", "kt": "kotlin", "swift": "swift", "sh": "shell", "yml": "yaml", "yaml": "yaml", "json": "json", "tf": "terraform", "sql": "sql", "html": "html", "xml": "xml"}


def language_of(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    lookup = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    workflow = F.when(F.lower(path).rlike(r"/?\.github/workflows/[^/]+\.ya?ml$"), "workflow")
    return F.coalesce(lookup(BY_NAME)[name], workflow, lookup(BY_EXTENSION)[F.substring_index(name, ".", -1)], F.lit("text"))


def read_corpus(spark: SparkSession, path: str, project: str, max_bytes: int = 5 << 20) -> DataFrame:
    """project_id, path, language, content of the text files under path: larger ones, and those with a zero byte in the first 8 KiB, are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    text = raw.where(~F.contains(head, F.lit("\x00")))
    return text.select(F.lit(project).alias("project_id"), "path", language_of(F.col("path")).alias("language"), F.try_validate_utf8(F.col("content").cast("string")).alias("valid"), F.col("content").cast("string").alias("content")).withColumn("content", F.coalesce("valid", F.make_valid_utf8("content"))).drop("valid")


EVENTS = "array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>"
ADVISORY = f"id string, modified string, withdrawn string, aliases array<string>, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:{EVENTS}>>,versions:array<string>>>"


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """One OSV record per file, whose name is the record's id: a row per affected package, the last modified record of each id and package."""
    raw = spark.read.schema(ADVISORY).option("multiLine", "true").option("mode", "FAILFAST").json(path, pathGlobFilter="*.json").withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    raw = raw.withColumn("id", F.when(F.col("id") == F.col("_file"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("record id is not its file's name: "), "_file"))))
    rows = raw.select("id", F.try_to_timestamp("modified").alias("modified"), "withdrawn", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.explode("affected").alias("a"))
    rows = rows.select("id", "modified", "withdrawn", "aliases", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"), F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"), F.coalesce("a.ranges", F.array().cast(f"array<struct<type:string,events:{EVENTS}>>")).alias("ranges"))
    return latest_advisories(rows)


def latest_advisories(rows: DataFrame) -> DataFrame:
    newest = Window.partitionBy("id", "ecosystem", "package").orderBy(F.desc("modified"), F.desc(F.to_json("ranges")))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """cve, ransomware (only where it is literally known), cwes."""
    raw = spark.read.schema("vulnerabilities array<struct<cveID:string,knownRansomwareCampaignUse:string,cwes:array<string>>>").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    v = raw.select(F.explode("vulnerabilities").alias("v"))
    return v.select(F.upper(F.trim("v.cveID")).alias("cve"), F.coalesce(F.lower("v.knownRansomwareCampaignUse") == "known", F.lit(False)).alias("ransomware"), F.coalesce("v.cwes", F.array().cast("array<string>")).alias("cwes"))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """cve, epss, epss_percentile: scores are texts; a row without a score goes, a missing percentile is 0."""
    raw = spark.read.schema("data array<struct<cve:string,epss:string,percentile:string>>").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    d = raw.select(F.explode("data").alias("d"))
    return d.select(F.upper("d.cve").alias("cve"), F.col("d.epss").try_cast("double").alias("epss"), F.coalesce(F.col("d.percentile").try_cast("double"), F.lit(0.0)).alias("epss_percentile")).where(F.col("epss").isNotNull())


def cve_ids(lines: DataFrame, col: str = "value") -> DataFrame:
    """The distinct CVE ids in any field of ragged lines."""
    return lines.select(F.explode(F.regexp_extract_all(F.upper(col), F.lit("CVE-[0-9]{4}-[0-9]{4,}"), F.lit(0))).alias("cve")).distinct()


def read_exploit_index(spark: SparkSession, path: str) -> DataFrame:
    """The CVE ids of an index. One without a header is an error: no ids would read as no exploits."""
    if not spark.read.option("header", "true").csv(path).columns:
        raise ValueError(f"{path}: no header")
    return cve_ids(spark.read.text(path))


def read_release_index(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, name, version, published_at, is_default, deprecated, deprecated_reason (300 characters at most)."""
    schema = "packageKey struct<system:string,name:string>, versions array<struct<versionKey:struct<version:string>,publishedAt:string,isDefault:boolean,isDeprecated:boolean,deprecatedReason:string>>"
    v = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(F.col("packageKey.system").alias("ecosystem"), F.col("packageKey.name").alias("name"), F.explode("versions").alias("v"))
    return v.select("ecosystem", "name", F.col("v.versionKey.version").alias("version"), F.try_to_timestamp("v.publishedAt").alias("published_at"), F.coalesce("v.isDefault", F.lit(False)).alias("is_default"), F.coalesce("v.isDeprecated", F.lit(False)).alias("deprecated"), F.substring("v.deprecatedReason", 1, 300).alias("deprecated_reason"))


def inventory_from_os_packages(corpus: DataFrame) -> DataFrame:
    """path, ecosystem, name, version, source_name of dpkg status and apk installed files; only installed dpkg packages count."""
    stanza = lambda df, e: df.select("path", F.lit(e).alias("ecosystem"), F.explode(F.split("content", r"\n[ \t]*\n")).alias("s"))
    get = lambda key: F.nullif(F.regexp_extract("s", rf"(?m)^{key}:[ ]*(.*?)[ ]*$", 1), F.lit(""))
    deb = stanza(corpus.where(F.col("path").rlike(r"(?:^|/)dpkg/status(?:\.d/[^/]+)?$")), "Debian").where(F.coalesce(get("Status"), F.lit("install ok installed")) == "install ok installed")
    deb = deb.select("path", "ecosystem", get("Package").alias("name"), get("Version").alias("version"), F.regexp_replace(get("Source"), r"\s*\(.*$", "").alias("source_name"))
    apk = stanza(corpus.where(F.col("path").rlike(r"(?:^|/)apk/db/installed$")), "Alpine").select("path", "ecosystem", get("P").alias("name"), get("V").alias("version"), get("o").alias("source_name"))
    return deb.unionByName(apk).where(F.col("name").isNotNull() & F.col("version").isNotNull())


_ENTRIES = "array<struct<ecosystem:string,name:string,version:string,source:string>>"
_REQUIREMENT = r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*===?\s*([^\s;#\\]+)"
_GRADLE = r"^([^#:=\s]+:[^:=\s]+):([^=\s]+)="


def _entry(ecosystem: str, name: Column, version: Column, source: Column | None = None) -> Column:
    return F.struct(F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), (F.lit("registry") if source is None else source).alias("source"))


def _npm(content: Column) -> Column:
    """The packages of the newer form."""
    j = F.from_json(content, "packages map<string,struct<version:string,link:boolean,resolved:string>>")
    placed = F.filter(F.map_entries(j["packages"]), lambda e: F.contains(e["key"], F.lit("node_modules/")) & ~F.coalesce(e["value"]["link"], F.lit(False)))
    return F.transform(placed, lambda e: _entry("npm", F.regexp_extract(e["key"], r"node_modules/((?:@[^/]+/)?[^/]+)$", 1), e["value"]["version"], F.when(e["value"]["resolved"].rlike("^git"), "git").otherwise("registry")))


def _pipfile(content: Column) -> Column:
    j = F.from_json(content, "default map<string,struct<version:string,git:string>>, develop map<string,struct<version:string,git:string>>")
    both = F.concat(*(F.coalesce(F.map_entries(j[x]), F.array().cast("array<struct<key:string,value:struct<version:string,git:string>>>")) for x in ("default", "develop")))
    return F.transform(both, lambda e: _entry("PyPI", e["key"], F.regexp_replace(e["value"]["version"], "^==", ""), F.when(e["value"]["git"].isNotNull(), "git").otherwise("registry")))


def _composer(content: Column) -> Column:
    kind = "array<struct<name:string,version:string>>"
    j = F.from_json(content, f"packages {kind}, `packages-dev` {kind}")
    both = F.concat(*(F.coalesce(j[x], F.array().cast(kind)) for x in ("packages", "packages-dev")))
    return F.transform(both, lambda e: _entry("Packagist", e["name"], e["version"]))


def _nuget(content: Column) -> Column:
    j = F.from_json(content, "dependencies map<string,map<string,struct<type:string,resolved:string>>>")
    each = F.flatten(F.transform(F.map_values(j["dependencies"]), lambda d: F.map_entries(d)))
    return F.transform(F.filter(each, lambda e: F.coalesce(e["value"]["type"], F.lit("")) != "Project"), lambda e: _entry("NuGet", e["key"], e["value"]["resolved"]))


def _cargo(content: Column) -> Column:
    def one(block: Column) -> Column:
        key = lambda k: F.nullif(F.regexp_extract(block, rf'(?m)^{k} = "([^"]*)"', 1), F.lit(""))
        return _entry("crates.io", key("name"), key("version"), F.when(key("source").isNull(), "local").when(F.startswith(key("source"), F.lit("git+")), "git").otherwise("registry"))

    return F.transform(F.split(content, r"\[\[package\]\]"), one)


def _by_line(ecosystem: str, pattern: str):
    return lambda content: F.transform(F.split(content, r"\r?\n"), lambda row: _entry(ecosystem, F.nullif(F.regexp_extract(row, pattern, 1), F.lit("")), F.regexp_extract(row, pattern, 2)))


#: File names, as patterns, and what reads their contents.
LOCKFILES = (
    (r"^package-lock\.json$", _npm), (r"^Pipfile\.lock$", _pipfile), (r"^composer\.lock$", _composer), (r"^packages\.lock\.json$", _nuget), (r"^Cargo\.lock$", _cargo), (r"^requirements.*\.txt$", _by_line("PyPI", _REQUIREMENT)), (r"^gradle\.lockfile$", _by_line("Maven", _GRADLE)),
)


def inventory_from_lockfiles(corpus: DataFrame) -> DataFrame:
    """path, ecosystem, name, version, source of the lockfiles that a corpus holds, by file name, each once a file. A broken one has no rows (broken_lockfiles).

    The corpus is read once: a file's name chooses what reads its content, in its own row, and nothing is shuffled. Only
    old npm files, nested to any depth, go to Python.
    """
    name = F.substring_index("path", "/", -1)
    files = corpus.select("path", "content", name.alias("_name")).where(F.col("_name").rlike("|".join(pattern for pattern, _ in LOCKFILES)))
    npm = F.col("_name").rlike(LOCKFILES[0][0])
    # An old one has no packages, which a look at the text settles for nearly all.
    files = files.withColumn("_old", _npm_v1(F.when(npm & F.contains("content", F.lit('"dependencies"')), F.col("content"))))
    read = F.lit(None).cast(_ENTRIES)
    for pattern, entries in LOCKFILES:
        read = F.when(F.col("_name").rlike(pattern), entries(F.col("content")).cast(_ENTRIES)).otherwise(read)
    none = F.array().cast(_ENTRIES)
    every = F.array_distinct(F.concat(F.coalesce(read, none), F.coalesce("_old", none)))
    out = files.select("path", F.explode(every).alias("x")).select("path", "x.*")
    return out.where(F.col("name").isNotNull() & (F.col("name") != "") & F.col("version").isNotNull())


@F.pandas_udf(ArrayType(StructType().add("ecosystem", "string").add("name", "string").add("version", "string").add("source", "string")))
def _npm_v1(contents: pd.Series) -> pd.Series:
    """The old form nests dependencies to any depth, which a fixed schema can't hold."""
    return pd.Series([_old_npm(c) for c in contents], dtype=object)


def _old_npm(content: str | None) -> list[dict] | None:
    try:
        doc = json.loads(content) if content else None
    except ValueError:
        return None  # broken_lockfiles tells of it
    if not isinstance(doc, dict) or "packages" in doc:
        return None
    rows, stack = [], [doc.get("dependencies") or {}]
    while stack:
        for name, d in stack.pop().items():
            version = str(d.get("version") or "")
            rows.append({"ecosystem": "npm", "name": name, "version": version, "source": "git" if version.startswith(("git", "github:")) else "registry"})
            stack.append(d.get("dependencies") or {})
    return rows


_blank = re.compile(r"[ \t\n\r]*").match


def _json(text: str):
    """json.loads for documents of any depth: it recurses, so those too deep for it are read with a stack. A ValueError tells of no JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep_json(text)


def _deep_json(text: str):
    value, i = _deep_value(text, _blank(text, 0).end())
    if i < len(text):
        raise ValueError(f"more text at {i}")
    return value


def _deep_value(text: str, i: int):
    """The value at i, and where the next text is."""
    scalar, after = json.JSONDecoder().raw_decode, lambda i: _blank(text, i).end()
    around = []  # the open containers, each with the key under which its current item goes

    def key(i):
        name, i = scalar(text, i) if text[i : i + 1] == '"' else (None, i)
        i = after(i)
        if name is None or text[i : i + 1] != ":":
            raise ValueError(f"no key at {i}")
        return name, after(i + 1)

    while True:
        c = text[i : i + 1]
        if c and c in "[{":
            value, i = [] if c == "[" else {}, after(i + 1)
            if text[i : i + 1] != ("]" if c == "[" else "}"):
                name, i = key(i) if c == "{" else (None, i)
                around.append((value, name))
                continue
            i += 1
        else:
            value, i = scalar(text, i)
        while True:  # a value is whole: it goes into what is around it, which may be whole then, too
            i = after(i)
            if not around:
                return value, i
            held, name = around.pop()
            if isinstance(held, list):
                held.append(value)
            else:
                held[name] = value
            c = text[i : i + 1]
            if c == ",":
                i = after(i + 1)
                name, i = key(i) if isinstance(held, dict) else (None, i)
                around.append((held, name))
                break
            if c != ("]" if isinstance(held, list) else "}"):
                raise ValueError(f"no end at {i}")
            value, i = held, i + 1


_decode = json.JSONDecoder().raw_decode


def _value(text: str, i: int):
    try:
        return _decode(text, i)
    except RecursionError:
        return _deep_value(text, i)


class _Held:
    """An array that stays in its text: every time it is gone through, its items are read one by one.

    kept: None, or the keys of an item's arrays that are read with it while its other ones stay in the text.
    """

    def __init__(self, text: str, start: int, kept: tuple[str, ...] | None = None):
        self.text, self.start, self.kept, self.end = text, start, kept, None

    def __iter__(self):
        text, i = self.text, _blank(self.text, self.start + 1).end()
        more = text[i : i + 1] != "]"
        while more:
            value, i = _value(text, i) if self.kept is None else _open(text, i, {}, self.kept)
            yield value
            i = _blank(text, i).end()
            more = text[i : i + 1] == ","
            if more:
                i = _blank(text, i + 1).end()
            elif text[i : i + 1] != "]":
                raise ValueError(f"no end at {i}")
        self.end = i + 1


def _open(text: str, i: int, inside: dict[str, tuple[str, ...]], kept: tuple[str, ...] = ()):
    """The value at i and its end. An array stays in the text (_Held), as do those of an object but for the kept ones; a ValueError tells of no JSON.

    inside: by key, what is kept of the items of an array, whose other arrays stay in the text, too.
    """

    def held(name):
        value = _Held(text, i, inside.get(name))
        for _ in value:  # to its end: only then is it known to be JSON
            pass
        return value, value.end

    after = lambda i: _blank(text, i).end()
    if text[i : i + 1] == "[":
        return held(None)
    if text[i : i + 1] != "{":
        return _value(text, i)
    found, i = {}, after(i + 1)
    more = text[i : i + 1] != "}"
    while more:
        if text[i : i + 1] != '"':
            raise ValueError(f"no key at {i}")
        name, i = _decode(text, i)
        i = after(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no key at {i}")
        i = after(i + 1)
        found[name], i = held(name) if text[i : i + 1] == "[" and name not in kept else _value(text, i)
        i = after(i)
        more = text[i : i + 1] == ","
        if more:
            i = after(i + 1)
        elif text[i : i + 1] != "}":
            raise ValueError(f"no end at {i}")
    return found, i + 1


def _open_json(text: str, inside: dict[str, tuple[str, ...]]):
    """_json of a document whose arrays stay in the text, so that one item of them is in memory at a time."""
    value, i = _open(text, _blank(text, 0).end(), inside)
    if _blank(text, i).end() < len(text):
        raise ValueError(f"more text at {i}")
    return value


def _texts(value) -> str | None:
    return value if isinstance(value, str) and value.strip() else None


def _listed(value):
    if isinstance(value, _Held):
        return (x for x in value if isinstance(x, dict))
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _cyclonedx(doc: dict):
    """(ref, name, version, purl, depends_on) of the root and of components nested to any depth."""
    depends: dict[str, set] = {}
    for d in _listed(doc.get("dependencies")):
        depends.setdefault(d.get("ref"), set()).update(x for x in d.get("dependsOn") or [] if isinstance(x, str))
    root = (doc.get("metadata") or {}).get("component")
    stack = [_listed(doc.get("components")), [root] if isinstance(root, dict) else []]
    while stack:
        for c in stack.pop():
            yield _texts(c.get("bom-ref")), _texts(c.get("name")), _texts(c.get("version")), _texts(c.get("purl")), depends.get(c.get("bom-ref"))
            stack.append(_listed(c.get("components")))


def _spdx(doc: dict):
    """The same of an SPDX document's packages: DEPENDS_ON, and DEPENDENCY_OF turned round."""
    depends: dict[str, set] = {}
    for r in _listed(doc.get("relationships")):
        a, b = r.get("spdxElementId"), r.get("relatedSpdxElement")
        if r.get("relationshipType") == "DEPENDENCY_OF":
            a, b = b, a
        elif r.get("relationshipType") != "DEPENDS_ON":
            continue
        depends.setdefault(a, set()).add(b)
    for x in _listed(doc.get("packages")):
        purl = next((r.get("referenceLocator") for r in _listed(x.get("externalRefs")) if r.get("referenceType") == "purl"), None)
        yield _texts(x.get("SPDXID")), _texts(x.get("name")), _texts(x.get("versionInfo")), _texts(purl), depends.get(x.get("SPDXID"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """document (its place) and content, a row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("document"), F.col("value").alias("content"))


def _sliced(walk, schema: pa.Schema, rows: int = 10_000):
    """For mapInArrow: what walk gives of (document, content) pairs, in slices, so that a worker holds one document and one slice beside its batch."""

    def run(batches):
        pairs = ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for batch in batches for k in range(batch.num_rows))
        found = walk(pairs)
        while part := list(islice(found, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return run


_SBOM = pa.schema([(c, pa.string()) for c in ("document", "format", "ref", "name", "version", "purl")] + [("depends_on", pa.list_(pa.string())), ("error", pa.string())])
_CLAIM = pa.schema([("document", pa.string()), ("n", pa.int32()), *((c, pa.string()) for c in ("kind", "producer", "rule_id", "vulnerability_id")), ("subject_ids", pa.list_(pa.string())), ("status", pa.string()), ("summary", pa.string()), ("mapped", pa.bool_())])
SBOM = "document string, format string, ref string, name string, version string, purl string, depends_on array<string>, error string"


def read_sbom(spark: SparkSession, path: str) -> DataFrame:
    """document, format, ref, key, name, version, purl, depends_on, error of CycloneDX and SPDX files.

    The key is the purl, else lower name and version. A reference that two components share makes its relations unusable, so
    it has none. A file of another form, or that is no JSON, is a row with an error and nothing else; the others are read.
    """

    def walk(documents):
        for document, content in documents:
            try:
                doc = _json(content or "")
            except ValueError:
                doc = None
            kind = "cyclonedx" if isinstance(doc, dict) and ("components" in doc or doc.get("bomFormat") == "CycloneDX") else "spdx" if isinstance(doc, dict) and isinstance(doc.get("packages"), list) else None
            if kind is None:
                yield document, None, None, None, None, None, None, "no JSON" if doc is None else "neither CycloneDX nor SPDX"
                continue
            walked = _cyclonedx if kind == "cyclonedx" else _spdx
            times = Counter(x[0] for x in walked(doc))
            for ref, name, version, purl, d in walked(doc):
                yield document, kind, ref, name, version, purl, sorted(d) if d and times[ref] == 1 else None, None if name else "no name"

    key = F.coalesce("purl", F.concat(F.lower("name"), F.lit("\x00"), F.lower(F.coalesce("version", F.lit("")))))
    return _documents(spark, path).mapInArrow(_sliced(walk, _SBOM), SBOM).withColumn("key", key)


STATES = {"exploitable": "affected", "in_triage": "under_investigation", "resolved": "fixed", "resolved_with_pedigree": "fixed", "not_affected": "not_affected", "false_positive": "not_affected"}  # fixed values
CLAIM = "document string, n int, kind string, producer string, rule_id string, vulnerability_id string, subject_ids array<string>, status string, summary string, mapped boolean"


def _openvex(doc: dict):
    for s in _listed(doc.get("statements")):
        products = s.get("products") if isinstance(s.get("products"), list) else []
        ids = [p["@id"] for p in _listed(products) if _texts(p.get("@id"))]
        status, why = s.get("status"), _texts(s.get("impact_statement")) or _texts(s.get("status_notes"))
        name, reason = (s.get("vulnerability") or {}).get("name") if isinstance(s.get("vulnerability"), dict) else None, _texts(s.get("justification"))
        mapped = bool(_texts(name)) and status in set(STATES.values()) and bool(ids) and len(ids) == len(products) and (status != "not_affected" or bool(why or reason))
        yield "vex-statement", "OpenVEX document", None, _texts(name), ids, _texts(status), why or reason, mapped


def _cyclonedx_vex(doc: dict):
    for v in _listed(doc.get("vulnerabilities")):
        analysis = v.get("analysis") if isinstance(v.get("analysis"), dict) else {}
        ids, status = [a["ref"] for a in _listed(v.get("affects")) if _texts(a.get("ref"))], STATES.get(analysis.get("state"))
        why = _texts(analysis.get("detail")) or _texts(analysis.get("justification"))
        yield "vex-statement", "CycloneDX document", None, _texts(v.get("id")), ids, status, why, bool(_texts(v.get("id")) and status and ids and (status != "not_affected" or why))


def _sarif(doc: dict):
    for run in _listed(doc.get("runs")):
        driver = (run.get("tool") or {}).get("driver") or {}
        version = _texts(driver.get("semanticVersion")) or _texts(driver.get("version"))
        producer = _texts(driver.get("name")) and (f"{driver['name']}@{version}" if version else driver["name"])
        for r in _listed(run.get("results")):
            places = [(x.get("physicalLocation") or {}).get("artifactLocation") or {} for x in _listed(r.get("locations"))]
            uris = [p["uri"] for p in places if _texts(p.get("uri"))]
            rule, text = _texts(r.get("ruleId")) or _texts((r.get("rule") or {}).get("id")), _texts((r.get("message") or {}).get("text"))
            yield "scanner-result", producer, rule, None, uris, _texts(r.get("level")) or "warning", text, bool(producer and rule and uris)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """record_id, document, kind, producer, rule_id, vulnerability_id, subject_ids, status, summary, mapped of OpenVEX, CycloneDX VEX and SARIF files.

    Claims are never trusted by themselves. A VEX statement is mapped if its status is known, all its products have ids and a
    not_affected one has a reason; a SARIF result if its tool, rule and place are named. A file of another form is one row that isn't mapped.
    A worker holds a document as its text, and its claims one at a time.
    """

    def walk(documents):
        for document, content in documents:
            try:
                doc = _open_json(content or "", {"runs": ("tool",)})
            except ValueError:
                doc = None
            doc, n = doc if isinstance(doc, dict) else {}, -1
            for n, claim in enumerate(chain(_openvex(doc), _cyclonedx_vex(doc), _sarif(doc))):
                yield document, n, *claim
            if n < 0:
                yield document, 0, "unreadable", None, None, None, [], None, None, False

    return _documents(spark, path).mapInArrow(_sliced(walk, _CLAIM), CLAIM).select(F.concat_ws("#", "document", "n").alias("record_id"), "*").drop("n")


def broken_lockfiles(corpus: DataFrame) -> DataFrame:
    """path, problem of JSON lockfiles that don't parse; inventory_from_lockfiles has no rows of them."""
    name = F.substring_index("path", "/", -1)
    own = corpus.where(name.isin("package-lock.json", "Pipfile.lock", "composer.lock", "packages.lock.json"))
    return own.where(F.try_parse_json("content").isNull()).select("path", F.lit("no JSON").alias("problem"))
