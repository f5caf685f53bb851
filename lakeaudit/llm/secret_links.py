"""Secret scan that links the parts of a credential: access identifiers, secrets and endpoints.

A pass over the texts finds parts. Strong ones are reported as they are:
  assign  a password, secret, token or API key with a value of 8 characters or more
  access  ``AKIA`` and capitals or digits, 16 characters or more
  hex     32 or more of 0-9a-f
Weak ones are reported only where complementary parts lie within ``reach`` code points in the same scope (the text
between blank lines):
  key       a run of 20 or more base64 characters with a digit and letters of both cases: needs an identifier or endpoint
  ident     a user, client, account or access key id with its value: needs a secret
  endpoint  a URL: needs an identifier and a secret
Identifiers are access and ident, secrets are assign, hex and key. A weak part that overlaps a strong one is no part.

The link is an interval join in sorted order: inside a document's scope, the nearest end before a part and the nearest
start after it, for each role, tell whether a complementary part is in reach. So a scope with many parts costs a sort,
not its pairs.

Offsets are code points, ends exclusive. Null text: an empty one, with no spans and the hash of the empty string.
Repeated rows, and rows with equal or null ids, are scanned each on their own.
An empty table gives no rows. A very long text is read whole, as a slice of its own, in one pass by each pattern;
other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.llm.spark import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
IDENT = re.compile(r"""(?:user(?:_?name|_?id)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
KINDS = ("assign", "access", "hex", "key", "ident", "endpoint")
BASE = 3  #: so many of KINDS are strong
ROLES = {"identifier": (1, 4), "secret": (0, 2, 3), "endpoint": (5,)}


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """(scope, index in KINDS, start, end) of each part of a text."""
    joined = "=" in text or ":" in text
    strong = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if joined else []
    strong += [(1, *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    strong += [(2, *m.span()) for m in HEX.finditer(text)]
    weak = [(3, *m.span()) for m in KEY.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    weak += [(4, *m.span()) for m in IDENT.finditer(text)] if joined else []
    weak += [(5, *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not strong and len(weak) < 2:
        return []  # nothing is linked with itself
    found = []
    by_start = sorted([(s, e, k) for k, s, e in strong] + [(s, e, k) for k, s, e in weak])
    covered = sorted((s, e) for _, s, e in strong)
    starts, furthest = [s for s, _ in covered], list(accumulate((e for _, e in covered), max, initial=0))
    breaks = [m.end() for m in BLANK.finditer(text)]
    scope = 0
    for s, e, k in by_start:
        while scope < len(breaks) and breaks[scope] <= s:
            scope += 1
        if k < BASE or furthest[bisect_left(starts, e)] <= s:  # the furthest end of strong parts that start before e
            found.append((scope, k, s, e))
    return found


def scan(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A row for each part, and one without a kind, but with the id, for each document."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for rid, own, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                rows.append((rid, own.as_py(), None, None, None, None))
                rows += [(rid, None, *p) for p in parts(text.as_py() or "")]
                if len(rows) > 50_000:
                    yield _batch(rows, batch.column(1).type)
                    rows = []
            yield _batch(rows, batch.column(1).type)

    return docs.select("rid", id_col, text_col).mapInArrow(run, f"rid long, id {id_type.simpleString()}, scope long, kind int, start long, end long")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64())
    cols = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rid", "id", "scope", "kind", "start", "end"])


def link(found: DataFrame, reach: int = 200) -> DataFrame:
    """found without the weak parts that no complementary part is in reach of."""
    scope = Window.partitionBy("rid", "scope")
    left = scope.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    right = scope.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    x = found
    for role, kinds in ROLES.items():
        own = F.col("kind").isin(*kinds)
        x = x.withColumn(f"{role}_left", F.max(F.when(own, F.col("end"))).over(left)).withColumn(f"{role}_right", F.min(F.when(own, F.col("start"))).over(right))
    near = {role: F.coalesce(F.col("start") - F.col(f"{role}_left") <= reach, F.lit(False)) | F.coalesce(F.col(f"{role}_right") - F.col("end") <= reach, F.lit(False)) for role in ROLES}
    kept = F.col("kind").isNull() | (F.col("kind") < BASE)
    kept |= (F.col("kind") == 3) & (near["identifier"] | near["endpoint"])
    kept |= (F.col("kind") == 4) & near["secret"]
    kept |= (F.col("kind") == 5) & near["identifier"] & near["secret"]
    return x.where(kept).select(*found.columns)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """docs needs rid, an id that no two rows share. A row per document: rid, id, spans (array of start, kind, end in order)."""
    found = link(scan(docs, id_col, text_col).repartition("rid"), reach)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return found.groupBy("rid").agg(F.max("id").alias("id"), F.array_sort(F.collect_list(span)).alias("spans"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with rid. The ids follow the partitions of the files read, so a task that is run again gives the same."""
    return docs.withColumn("rid", F.monotonically_increasing_id())


def redact(docs: DataFrame, mark: str = "[REDACTED]", reach: int = 200) -> DataFrame:
    """docs with every reported span of text replaced by mark, and n_chars (where it is there) counted anew."""
    own = docs.withColumn("_rid", F.monotonically_increasing_id())
    hits = secrets(own.select(F.col("_rid").alias("rid"), "text"), "rid", "text", reach).where(F.size("spans") > 0)
    joined = own.join(hits.select(F.col("rid").alias("_rid"), F.col("spans").alias("_spans")), "_rid", "left")
    # Spans are cut from the left: acc holds the text so far and the end of the last span; overlapping ones give one mark.
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at"))
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))))
    out = joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)


def op1_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(numbered(table(spark, sf_dir, "documents").select("doc_id", "text")))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda col: F.concat_ws(",", F.transform(col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _spans_sql(kind: int, pattern: str, keep: str) -> str:
    """Spans of a pattern's leftmost matches: what lies between them gives their places."""
    text, gaps = "regexp_extract_all(text, $p${0}$p$)", "list_transform(regexp_split_to_array(text, $p${0}$p$), lambda x: length(x))"
    return f"""SELECT doc_id, {kind} AS kind, list_sum(g[:i]) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS s, m[i] AS hit FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {text.format(pattern)} AS m, {gaps.format(pattern)} AS g FROM d)) WHERE {keep}"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
strong AS ({_spans_sql(0, "(?i)" + ASSIGN.pattern, "length(regexp_extract(m[i], $p$(?i)" + ASSIGN.pattern + "$p$, 2)) >= 8")} UNION ALL {_spans_sql(1, ACCESS.pattern, "TRUE")} UNION ALL {_spans_sql(2, HEX.pattern, "TRUE")}),
loose AS ({_spans_sql(3, KEY.pattern[KEY.pattern.index(")") + 1:], "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]')")} UNION ALL {_spans_sql(4, "(?i)" + IDENT.pattern, "TRUE")} UNION ALL {_spans_sql(5, ENDPOINT.pattern, "TRUE")}),
st AS (SELECT doc_id, kind, s, s + length(hit) AS e FROM strong),
wk AS (SELECT doc_id, kind, s, s + length(hit) AS e FROM loose w WHERE NOT EXISTS (FROM st WHERE st.doc_id = w.doc_id AND st.s < w.s + length(hit) AND st.e > w.s)),
breaks AS (SELECT doc_id, s + length(hit) AS at_end FROM ({_spans_sql(9, BLANK.pattern, "TRUE")})),
parts AS (SELECT *, (SELECT count(*) FROM breaks b WHERE b.doc_id = x.doc_id AND at_end <= s) AS scope, CASE WHEN kind IN (1, 4) THEN 'i' WHEN kind = 5 THEN 'e' ELSE 's' END AS role, row_number() OVER () AS id FROM (FROM st UNION ALL FROM wk) x),
near AS (SELECT a.id, bool_or(b.role = 'i') AS ni, bool_or(b.role = 's') AS ns, bool_or(b.role = 'e') AS ne FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND a.scope = b.scope AND a.id <> b.id AND greatest(b.s - a.e, a.s - b.e) <= 200 GROUP BY a.id),
kept AS (SELECT doc_id, kind, s, ['assign', 'access', 'hex', 'key', 'ident', 'endpoint'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM parts LEFT JOIN near USING (id) WHERE kind < 3 OR (kind = 3 AND (ni OR ne)) OR (kind = 4 AND ns) OR (kind = 5 AND ni AND ns)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
