"""Matchers and extractors over stored responses, the expression functions they use, and strings of binaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.versions import version_satisfies


@dataclass(frozen=True)
class Matcher:
    kind: str  #: word, regex, binary, size, status or expression
    values: tuple = ()
    part: str = "body"
    every: bool = False  #: all values, else any
    negative: bool = False
    internal: bool = False  #: takes part in the verdict but isn't reported


@dataclass(frozen=True)
class Template:
    template_id: str
    matchers: tuple[Matcher, ...]
    severity: str = "info"
    tags: tuple[str, ...] = ()
    every: bool = False


def matcher_column(m: Matcher, columns: list[str]) -> Column:
    """Whether a matcher holds; a part that is missing doesn't match, even when negative."""
    if m.kind == "expression":
        return F.coalesce(m.values[0], F.lit(False))
    if m.part not in columns:
        return F.lit(False)
    col = F.col(m.part)
    each = {
        "word": lambda v: F.contains(col, F.lit(v)), "regex": lambda v: col.rlike(v), "binary": lambda v: F.contains(F.lower(F.hex(F.encode(col, "utf-8"))), F.lit(v.lower())),
        "size": lambda v: F.octet_length(col) == v, "status": lambda v: col == v,
    }[m.kind]
    tests = [each(v) for v in m.values]
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if m.every else (out | t)
    return F.coalesce((~out if m.negative else out) & col.isNotNull(), F.lit(False))


def match_templates(responses: DataFrame, templates: list[Template], id_col: str) -> DataFrame:
    """id, template_id, severity, matched: the reported matchers' positions. One projection holds all templates, then rows come out."""
    found = []
    for t in templates:
        cols = [matcher_column(m, responses.columns) for m in t.matchers]
        whole = cols[0]
        for c in cols[1:]:
            whole = (whole & c) if t.every else (whole | c)
        shown = F.array_compact(F.array(*(F.when(c, F.lit(i)) for i, (m, c) in enumerate(zip(t.matchers, cols, strict=True)) if not m.internal)))
        found.append(F.when(whole, F.struct(F.lit(t.template_id).alias("template_id"), F.lit(t.severity).alias("severity"), F.concat_ws(",", shown.cast("array<string>")).alias("matched"))))
    return responses.select(id_col, F.explode(F.array_compact(F.array(*found))).alias("x")).select(id_col, "x.*")


def extract_values(responses: DataFrame, extractors: dict[str, tuple[str, str, int]], id_col: str) -> DataFrame:
    """id, name, value: distinct values in order of each named (part, pattern, group)."""
    pick = lambda name, part, pattern, group: F.transform(F.array_distinct(F.regexp_extract_all(F.col(part), F.lit(pattern), F.lit(group))), lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))
    return responses.select(id_col, F.explode(F.concat(*(pick(n, *e) for n, e in extractors.items()))).alias("x")).select(id_col, "x.*")


def select_templates(templates: DataFrame, tags: list[str] = (), severities: list[str] = (), ids: list[str] = (), not_tags: list[str] = ()) -> DataFrame:
    """template_id, reason: null for those that run, else why not. Denial of service never runs."""
    has = lambda names: F.arrays_overlap("tags", F.array(*map(F.lit, names)))
    reason = F.when(has(["dos"]), "denial of service")
    if not_tags:
        reason = reason.when(has(not_tags), "excluded tag")
    if ids:
        reason = reason.when(~F.col("template_id").isin(*ids), "id not selected")
    if tags:
        reason = reason.when(~has(tags), "no selected tag")
    if severities:
        reason = reason.when(~F.col("severity").isin(*severities), "severity not selected")
    return templates.select("template_id", reason.alias("reason"))


#: Extensions that a file rule doesn't read unless it lists them.
DENIED = (".3g2", ".7z", ".apk", ".avi", ".bmp", ".css", ".deb", ".dmg", ".doc", ".exe", ".flv", ".gif", ".gz", ".ico", ".iso", ".jar", ".jpeg", ".jpg", ".mp3", ".mp4", ".ogg", ".otf", ".pdf", ".png", ".rar", ".rpm", ".svg", ".swf", ".tar", ".tif", ".ttf", ".wav", ".woff", ".xls", ".zip")


def accepts_file(path: Column, size: Column, allowed: tuple[str, ...] = (), max_size: int = 5 << 20) -> Column:
    """Whether a file rule reads a file: its list, or all but the denied endings, up to a size."""
    ends = lambda names: F.lower(path).rlike("(?:" + "|".join(map(re.escape, names)) + ")$")
    open_ = ends(allowed) if allowed and "all" not in allowed else ~ends(DENIED) if not allowed else F.lit(True)
    return open_ & (size <= max_size)


#: The functions of matcher expressions, by name, over columns. Arguments are columns; patterns and constraints are texts.
FUNCTIONS = {
    "contains": lambda s, x: F.contains(s, x), "contains_all": lambda s, *xs: F.greatest(*(~F.contains(s, x) for x in xs)) == F.lit(False) if len(xs) > 1 else F.contains(s, xs[0]),
    "contains_any": lambda s, *xs: F.greatest(*(F.contains(s, x) for x in xs)) if len(xs) > 1 else F.contains(s, xs[0]),
    "starts_with": lambda s, x: F.startswith(s, x), "ends_with": lambda s, x: F.endswith(s, x),
    "line_starts_with": lambda s, x: s.rlike("(?m)^" + re.escape(x)), "line_ends_with": lambda s, x: s.rlike("(?m)" + re.escape(x) + "$"),
    "equals_any": lambda s, *xs: s.isin(*xs), "len": lambda s: F.octet_length(s), "md5": lambda s: F.md5(s.cast("binary")), "sha1": lambda s: F.sha1(s.cast("binary")),
    "sha256": lambda s: F.sha2(s.cast("binary"), 256), "sha512": lambda s: F.sha2(s.cast("binary"), 512), "base64": lambda s: F.base64(s.cast("binary")), "base64_decode": lambda s: F.unbase64(s).cast("string"),
    "hex_encode": lambda s: F.lower(F.hex(s.cast("binary"))), "hex_decode": lambda s: F.unhex(s).cast("string"), "bin_to_dec": lambda s: F.conv(s, 2, 10), "hex_to_dec": lambda s: F.conv(s, 16, 10),
    "oct_to_dec": lambda s: F.conv(s, 8, 10), "dec_to_hex": lambda n: F.lower(F.hex(n.cast("long"))), "concat": lambda *xs: F.concat(*xs), "join": lambda sep, *xs: F.concat_ws(sep, *xs),
    "repeat": lambda s, n: F.repeat(s, n), "reverse": lambda s: F.reverse(s), "regex": lambda p, s: s.rlike(p), "regex_any": lambda p, *xs: F.greatest(*(x.rlike(p) for x in xs)) if len(xs) > 1 else xs[0].rlike(p),
    "regex_all": lambda p, *xs: F.least(*(x.rlike(p) for x in xs)) if len(xs) > 1 else xs[0].rlike(p), "replace": lambda s, a, b: F.replace(s, a, b), "replace_regex": lambda s, p, b: F.regexp_replace(s, p, b),
    "to_lower": lambda s: F.lower(s), "to_upper": lambda s: F.upper(s), "trim": lambda s, chars: F.regexp_replace(s, f"^[{re.escape(chars)}]+|[{re.escape(chars)}]+$", ""),
    "trim_left": lambda s, chars: F.regexp_replace(s, f"^[{re.escape(chars)}]+", ""), "trim_right": lambda s, chars: F.regexp_replace(s, f"[{re.escape(chars)}]+$", ""), "trim_space": lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    "trim_prefix": lambda s, x: F.regexp_replace(s, "^" + re.escape(x), ""), "trim_suffix": lambda s, x: F.regexp_replace(s, re.escape(x) + "$", ""), "url_encode": lambda s: F.url_encode(s), "url_decode": lambda s: F.url_decode(s),
    "to_number": lambda s: s.try_cast("double"), "to_string": lambda s: s.cast("string"), "compare_versions": lambda v, *c: version_satisfies(v, ",".join(c)),
}


def dsl_column(name: str, *args) -> Column:
    """A function of the expression language as a column."""
    return FUNCTIONS[name](*args)


def extract_strings(binaries: DataFrame, id_col: str, content: str = "content", least: int = 4) -> DataFrame:
    """id, strings: printable ASCII runs, and UTF-16LE ones without their zero bytes, joined by line feeds."""
    raw = F.decode(F.col(content), "ISO-8859-1")
    ascii_ = F.regexp_extract_all(raw, F.lit(rf"[\t -~]{{{least},}}"), F.lit(0))
    wide = F.transform(F.regexp_extract_all(raw, F.lit(rf"(?:[\t -~]\x00){{{least},}}"), F.lit(0)), lambda s: F.replace(s, F.lit("\x00"), F.lit("")))
    return binaries.select(id_col, F.array_join(F.concat(ascii_, wide), "\n").alias("strings"))


@dataclass(frozen=True)
class BytePattern:
    """Bytes that carry a product's version: hex bytes, ``??`` for any one, ``3?`` or ``?3`` for a fixed half, ``[2-8]`` for a gap, brackets about the version.

    The version is the captured bytes as text where all are printable, else their numbers with dots between.
    """

    product: str
    pattern: str


class ByteMatcher:
    """Finds a BytePattern by its longest fixed run: only where that stands are the parts before and after it compared."""

    TOKEN = re.compile(r"\s*(?:(\[)\s*(\d+)\s*-\s*(\d+)\s*\]|([()])|([0-9A-Fa-f?]{2}))")

    def __init__(self, pattern: str):
        parts: list[tuple[bytes, bytes | None, int]] = []  # regular expression, the byte if fixed, longest length
        at = 0
        while at < len(pattern.rstrip()):
            m = self.TOKEN.match(pattern, at)
            if not m:
                raise ValueError(f"bad byte pattern: {pattern[at:]}")
            at = m.end()
            if m[1]:
                if int(m[2]) > int(m[3]):
                    raise ValueError(f"bad gap: {m[0]}")
                parts.append((b".{%d,%d}?" % (int(m[2]), int(m[3])), None, int(m[3])))
            elif m[4]:
                parts.append((m[4].encode(), None, 0))
            elif "?" not in m[5]:
                raw = bytes.fromhex(m[5])
                parts.append((re.escape(raw), raw, 1))
            else:
                held = bytes(x for x in range(256) if all(c in ("?", h) for c, h in zip(m[5].lower(), f"{x:02x}", strict=True)))
                parts.append((b"." if len(held) == 256 else b"[" + b"".join(b"\\x%02x" % x for x in held) + b"]", None, 1))
        runs, start = [], 0
        for i, (_, raw, _) in enumerate([*parts, (b"", None, 0)]):
            if raw is None:
                runs.append((i - start, start))
                start = i + 1
        n, first = max(runs, key=lambda r: r[0])
        if not n:
            raise ValueError("a byte pattern needs a fixed byte")
        join = lambda some: b"".join(p[0] for p in some)
        if join(parts).count(b"(") != 1:
            raise ValueError("a byte pattern needs one version in brackets")
        self.anchor = b"".join(p[1] for p in parts[first : first + n])
        self.reach = sum(p[2] for p in parts[:first])
        self.whole = re.compile(join(parts), re.S)
        self.exact = all(not p[0].endswith(b"}?") for p in parts[:first])

    def versions(self, raw: bytes) -> list[str]:
        out, at = [], raw.find(self.anchor)
        while at >= 0:
            for start in range(max(0, at - self.reach), at + 1) if not self.exact else [at - self.reach]:
                m = self.whole.match(raw, start) if start >= 0 else None
                if m:
                    version = m[1].decode("ascii") if all(32 <= x < 127 for x in m[1]) else ".".join(map(str, m[1]))
                    if version.strip() and version.strip() not in out:
                        out.append(version.strip())
            at = raw.find(self.anchor, at + 1)
        return out


def byte_versions(files: DataFrame, patterns: list[BytePattern], content: str = "content") -> DataFrame:
    """path, product, version (each once) of what byte patterns find in a BINARY column. Null contents have none. One pass, no shuffle."""

    def run(batches):
        matchers = [(p.product, ByteMatcher(p.pattern)) for p in patterns]
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one content at a time
                view = raw.as_py() or b""
                rows += dict.fromkeys((path, product, v) for product, m in matchers if m.anchor in view for v in m.versions(view))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "product", "version"])

    [ByteMatcher(p.pattern) for p in patterns]  # a bad one fails here, not in a task
    return files.select("path", content).mapInArrow(run, "path string, product string, version string")


def detect_components(files: DataFrame, signatures: list[tuple[str, str, str, tuple[str, ...]]], by_bytes: DataFrame | None = None) -> DataFrame:
    """path, product, version: files whose strings or name a signature finds; a row per distinct version, or a null one.

    signatures: product, pattern of the content or name, version pattern (group 1), ignored versions. by_bytes: versions that
    byte_versions found; they count only for products that a signature found in the file, as bytes don't tell what it is.
    """
    found = []
    for product, pattern, version, ignored in signatures:
        seen = F.array_distinct(F.regexp_extract_all("strings", F.lit(version), F.lit(1)))
        seen = F.array_except(seen, F.array(*map(F.lit, ignored)).cast("array<string>"))
        rows = F.transform(F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit(None).cast("string"))), _of(product))
        hit = F.col("strings").rlike(pattern) | F.substring_index("path", "/", -1).rlike(pattern)
        found.append(F.when(hit, rows).otherwise(F.array().cast("array<struct<product:string,version:string>>")))
    out = files.select("path", F.explode(F.concat(*found)).alias("x")).select("path", "x.*")
    if by_bytes is None:
        return out
    ignored = F.lit(False)
    for product, _, _, own in signatures:
        ignored |= (F.col("product") == product) & F.col("version").isin(*own)
    known = out.select("path", "product").distinct()
    both = out.unionByName(by_bytes.where(~ignored).join(known, ["path", "product"], "left_semi")).groupBy("path", "product").agg(F.collect_set("version").alias("versions"))
    return both.select("path", "product", F.explode(F.when(F.size("versions") > 0, F.array_sort("versions")).otherwise(F.array(F.lit(None).cast("string")))).alias("version"))


def _of(product: str):
    return lambda v: F.struct(F.lit(product).alias("product"), v.alias("version"))


def fold_components(detections: DataFrame) -> DataFrame:
    """Per (lower product, version): number of paths, the first non-empty vendor by path, the best source."""
    named = F.when(F.coalesce("vendor", F.lit("")) != "", F.struct("path", "vendor"))
    return detections.groupBy(F.lower("product").alias("product"), "version").agg(F.countDistinct("path").alias("paths"), F.min(named).alias("_v"), F.max("confidence").alias("confidence")).withColumn("vendor", F.col("_v.vendor")).drop("_v")


def merge_scanner_results(results: list[DataFrame]) -> DataFrame:
    """The union of scanners' (product, version, cve, severity_rank, summary) rows: one per CVE, missing fields filled in order, the higher severity."""
    whole = None
    for i, r in enumerate(results):
        own = r.withColumn("_order", F.lit(i))
        whole = own if whole is None else whole.unionByName(own)
    first = F.min(F.when(F.col("summary").isNotNull(), F.struct("_order", "summary")))
    return whole.groupBy(F.lower("product").alias("product"), "version", "cve").agg(F.max("severity_rank").alias("severity_rank"), first.alias("_s")).withColumn("summary", F.col("_s.summary")).drop("_s")


def attach_cves(components: DataFrame, found: DataFrame) -> DataFrame:
    """component, cve, severity_rank: the components' own, and those found that they lack."""
    return components.unionByName(found.join(components.select("component", "cve"), ["component", "cve"], "left_anti").dropDuplicates(["component", "cve"]))


def supersede_layers(detections: DataFrame, stacks: DataFrame) -> DataFrame:
    """Detections but those of a database that every image using their layer replaces in a later layer.

    detections: layer, root, kind, and others. stacks: image, position, layer.
    """
    own = detections.select("layer", "root", "kind").distinct()
    placed = own.join(stacks, "layer")
    last = placed.groupBy("image", "root", "kind").agg(F.max("position").alias("last"))
    kept = placed.join(last, ["image", "root", "kind"]).groupBy("layer", "root", "kind").agg(F.bool_and(F.col("last") > F.col("position")).alias("gone")).where("gone")
    return detections.join(kept, ["layer", "root", "kind"], "left_anti")
