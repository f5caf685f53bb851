"""Runs over time: baselines, diffs, latest rows, reviews, retention, views and pages.

Joins carry keys; payload columns ride along only on the side that is returned. "First" and "last" always go by an
explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeaudit.functions import text as T
from lakeaudit.functions.session import shuffled

KEY = ["fingerprint_version", "fingerprint"]


def top_one(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def latest_run_per_target(runs: DataFrame, target: str = "project_id", updated: str = "completed_at") -> DataFrame:
    return top_one(runs, [target], [F.desc(updated), F.desc("run_id")])


def latest_compatible_baseline(runs: DataFrame) -> DataFrame:
    """run_id, baseline_run_id: for each run, the latest completed one of its project and fingerprint version that had
    finished before it started and shares a scanner family (an as-of join).

    Starts and ends of a (project, fingerprint version, family) are put in order of time, and each start takes the latest
    end before it: a sort, not pairs of runs. A start comes before an end of the same time, as a baseline must be earlier.
    """
    keys = ["project_id", "fingerprint_version", "family"]
    # A run is shuffled once, by its project, and gives its families' starts and ends where it then lies.
    own = runs.select("project_id", "fingerprint_version", "run_id", "started_at", "completed_at", "status", "families").repartition("project_id").withColumn("family", F.explode("families"))
    end = F.struct("completed_at", "run_id")
    done = F.when(F.col("status") == "completed", end)
    times = F.array(F.struct(F.col("started_at").alias("at"), F.lit(0).alias("kind"), F.when(F.lit(False), end).alias("end")), F.struct(F.col("completed_at").alias("at"), F.lit(1).alias("kind"), done.alias("end")))
    times = own.select(*keys, "run_id", F.explode(times).alias("t")).select(*keys, "run_id", "t.*").where((F.col("kind") == 0) | F.col("end").isNotNull())
    so_far = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = times.withColumn("last", F.max("end").over(so_far)).where((F.col("kind") == 0) & F.col("last").isNotNull())
    return met.groupBy("run_id").agg(F.max("last").alias("x")).select("run_id", F.col("x.run_id").alias("baseline_run_id"))


def refused_pairs(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, baseline_run_id, problem: pairs that may not be compared, with the first reason.

    A side is missing, a side isn't completed, another project, another fingerprint version, a baseline that hadn't finished
    before the run started, no scanner family in common.
    """
    side = lambda prefix, run: runs.select(F.col("run_id").alias(run), F.struct("project_id", "fingerprint_version", "started_at", "completed_at", "status", "families").alias(prefix))
    x = pairs.select("run_id", "baseline_run_id").join(side("c", "run_id"), "run_id", "left").join(side("b", "baseline_run_id"), "baseline_run_id", "left")
    open_ = lambda k: (F.col(f"{k}.status") != "completed") | F.col(f"{k}.completed_at").isNull()
    tests = [
        ("missing run", F.col("c").isNull() | F.col("b").isNull()), ("not completed", open_("c") | open_("b")), ("another project", ~F.col("c.project_id").eqNullSafe(F.col("b.project_id"))),
        ("another fingerprint version", ~F.col("c.fingerprint_version").eqNullSafe(F.col("b.fingerprint_version"))), ("baseline not prior", ~F.coalesce(F.col("b.completed_at") < F.col("c.started_at"), F.lit(False))),
        ("no family in common", ~F.coalesce(F.arrays_overlap("c.families", "b.families"), F.lit(False))),
    ]
    problem = F.coalesce(*(F.when(test, name) for name, test in tests))
    return x.select("run_id", "baseline_run_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def compare_runs(pairs: DataFrame, findings: DataFrame, coverage: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """Each pair's (run_id, baseline_run_id) findings with diff_status. Leave refused_pairs out of pairs.

    new: not in the baseline. unchanged: in both. A baseline finding that is gone is resolved where the run covered its
    path and family, else notEvaluated. coverage: run_id, path, family. A rule id of a pack is ``pack/rule``: its finding is
    resolved only if both runs held the pack with the same hashes. packs: run_id, pack_id, hash; without packs none is held.
    Rows: run_id, observation_run_id, key, rule_id, severity, category, path, diff_status.
    """
    payload = ["rule_id", "severity", "category", "path"]
    in_pack, finding, cover, pack = F.contains("rule_id", F.lit("/")), F.col("_kind") == 0, F.col("_kind") == 1, F.col("_kind") == 2
    # A finding takes part as its own run's and as the baseline's of others. What a run is judged by (both sides' findings,
    # its coverage, both sides' packs) is brought together by one shuffle, and put in order there, where it may spill.
    roles = pairs.select("run_id", "baseline_run_id", F.explode(F.array(F.struct(F.col("run_id").alias("observation_run_id"), F.lit(True).alias("now")), F.struct(F.col("baseline_run_id").alias("observation_run_id"), F.lit(False).alias("now")))).alias("role")).select("run_id", "baseline_run_id", "role.*")
    sides = findings.select(F.col("run_id").alias("observation_run_id"), *KEY, *payload, F.lit(0).alias("_kind"))
    if packs is not None:
        held = packs.groupBy(F.col("run_id").alias("observation_run_id"), "pack_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
        sides = sides.withColumn("pack_id", F.when(in_pack, F.split("rule_id", "/")[0])).unionByName(held.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    seen = coverage.select("run_id", "path", F.col("family").alias("category"), F.lit(1).alias("_kind"))
    x = sides.join(shuffled(roles), "observation_run_id").unionByName(seen, allowMissingColumns=True).repartition("run_id")
    there = Window.partitionBy("run_id", *KEY)
    x = x.withColumn("_side", F.when(finding, F.col("now"))).withColumns({"held": F.max("_side").over(there), "before": ~F.min("_side").over(there)}).where(~finding | F.col("now") | ~F.col("held"))
    covered = F.max(cover).over(Window.partitionBy("run_id", "path", "category"))
    x = x.withColumn("covered", covered & F.col("path").isNotNull() & F.col("category").isNotNull())
    same = F.lit(False)
    if packs is not None:
        hashes = lambda now: F.max(F.when(pack & (F.col("now") == now), F.col("hashes"))).over(Window.partitionBy("run_id", "baseline_run_id", "pack_id"))
        x = x.withColumns({"_now": hashes(True), "_then": hashes(False)})
        same = F.coalesce(F.col("pack_id").isNotNull() & (F.size("_now") > 0) & (F.col("_now") == F.col("_then")), F.lit(False))
    status = F.when(F.col("now"), F.when(F.col("before"), "unchanged").otherwise("new")).when(F.col("covered") & (~in_pack | same), "resolved").otherwise("notEvaluated")
    return x.where(finding).select("run_id", "observation_run_id", *KEY, *payload, status.alias("diff_status"))


def compare_reports(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: introduced, unchanged or no_longer_observed; says nothing of coverage."""
    now, then = current.select(*keys).distinct(), baseline.select(*keys).distinct()
    tag = lambda df, s: df.withColumn("status", F.lit(s))
    return tag(now.join(then, keys, "left_anti"), "introduced").unionByName(tag(now.join(then, keys, "left_semi"), "unchanged")).unionByName(tag(then.join(now, keys, "left_anti"), "no_longer_observed"))


def latest_observations(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest finding of each (project, key) over completed runs; ties by run id."""
    done = runs.where(F.col("status") == "completed").select("run_id", "project_id", "completed_at")
    return top_one(findings.join(done, "run_id"), ["project_id", *KEY], [F.desc("completed_at"), F.desc("run_id"), F.asc("number"), F.asc("severity")])


def active_review(reviews: DataFrame, now: Column) -> DataFrame:
    """The review in force of each (project, key): not superseded, not candidate, unexpired; local before projectPolicy, then the newest."""
    live = reviews.where(F.col("superseded_at").isNull() & (F.col("state") != "candidate") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return top_one(live, ["project_id", "fingerprint"], [F.when(F.col("origin") == "local", 0).otherwise(1).asc(), F.desc("updated_at"), F.desc("id")])


def review_timeline(events: DataFrame) -> DataFrame:
    """events: id, project_id, fingerprint, origin, state, updated_at. Those that change something, each superseded by the next of its origin."""
    w = Window.partitionBy("project_id", "fingerprint", "origin").orderBy("updated_at", "id")
    before = F.lag("state").over(w)
    policy = F.col("origin") == "projectPolicy"
    same = policy & F.coalesce(before == F.col("state"), F.col("state") == "candidate")
    return events.withColumn("_skip", same).where(~F.col("_skip")).drop("_skip").withColumn("superseded_at", F.lead("updated_at").over(w))


def retention(runs: DataFrame, now: Column, max_runs: int = 20, max_age_days: int = 90) -> DataFrame:
    """run_id, keep: completed runs past the age go, then all but the newest of each project; a protected run stays and uses a slot."""
    done = runs.where(F.col("status") == "completed")
    young = (F.col("completed_at") >= now - F.make_dt_interval(F.lit(max_age_days))) | F.col("protected")
    w = Window.partitionBy("project_id", "young").orderBy(F.desc("protected"), F.desc("completed_at"), F.desc("run_id"))
    return done.withColumn("young", young).withColumn("n", F.row_number().over(w)).select("run_id", (F.col("young") & ((F.col("n") <= max_runs) | F.col("protected"))).alias("keep"))


def finding_view(scope: Column, state: Column, diff: Column) -> Column:
    """resolved, otherScopes, closed or open."""
    return F.when(diff == "resolved", "resolved").when(~scope.isin("production", "infrastructure", "unknown"), "otherScopes").when(state.isin("falsePositive", "accepted", "suppressed", "fixed"), "closed").otherwise("open")


def view_diff_counts(projection: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts by view and diff status per run, with the totals of each (cube)."""
    per = projection.where(F.col(run).isNotNull()).groupBy(run, "view", "diff_status").agg(F.count("*").alias("n"))
    # A run's totals add up its few counts where these lie together; a cube would shuffle every row once for each of its sets.
    none = lambda c: F.lit(None).cast(per.schema[c].dataType)
    part = lambda k, view, status: F.struct(F.lit(k).alias("k"), view.alias("view"), status.alias("diff_status"))
    v, d = F.col("view"), F.col("diff_status")
    sets = F.array(part(0, v, d), part(1, v, none("diff_status")), part(2, none("view"), d), part(3, none("view"), none("diff_status")))
    return per.repartition(run).select(run, F.explode(sets).alias("x"), "n").select(run, "x.*", "n").groupBy(run, "k", "view", "diff_status").agg(F.sum("n").alias("n")).drop("k")


def page_filter(findings: DataFrame, severity_at_least: str | None = None, category: str | None = None, text: str | None = None, fields: tuple[str, ...] = ("rule_id", "path"), severity: str | None = None, view: str | None = None, new_only: bool = False, scopes: tuple[str, ...] = (), languages: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> DataFrame:
    """The findings that a page shows: by least or exact severity, category, view, diff status, scope, language, path set and a text in any of fields."""
    x = findings
    if severity_at_least:
        x = x.where(T.rank("severity", T.SOURCE_RANK, 1) >= T.SOURCE_RANK.get(severity_at_least, 1))
    if severity:
        x = x.where(F.lower("severity") == severity.lower())
    if new_only:
        x = x.where(F.col("diff_status") == "new")
    for column, wanted in (("category", (category,) if category else ()), ("view", (view,) if view else ()), ("scope", scopes), ("language", languages), ("path", paths)):
        if wanted:
            x = x.where(F.col(column).isin(*wanted))
    if text:
        x = x.where(F.lower(F.concat_ws("\n", *fields)).contains(text.lower()))
    return x


def findings_page(findings: DataFrame, sort: str, offset: int, limit: int, severity_at_least: str | None = None, category: str | None = None, text: str | None = None, fields: tuple[str, ...] = ("rule_id", "path"), **more) -> DataFrame:
    """A page of the filtered findings. An offset is a sort of all before it: use keyset_page for deep pages."""
    x = page_filter(findings, severity_at_least, category, text, fields, **more)
    return x.orderBy(*page_order(sort)).offset(offset).limit(limit)


def page_totals(findings: DataFrame, **filters) -> DataFrame:
    """total, filtered: how many findings there are, and how many the filters leave."""
    return findings.agg(F.count("*").alias("total")).join(F.broadcast(page_filter(findings, **filters).agg(F.count("*").alias("filtered"))))  # one row each


def page_order(sort: str) -> list[Column]:
    worst = F.desc(T.rank("severity", T.SOURCE_RANK, 1))
    ties = [F.asc("path"), F.asc("line"), F.asc("run_id"), F.asc("number")]
    return {"severity": [worst, *ties], "file": ties, "rule": [F.asc("rule_id"), *ties]}[sort]


def keyset_page(findings: DataFrame, after: tuple, keys: list[str], limit: int) -> DataFrame:
    """The next rows in order of keys after the given ones: a filter and a top-k, whatever the depth."""
    return findings.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(findings.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)))).orderBy(*keys).limit(limit)


def triage_order(findings: DataFrame, limit: int) -> DataFrame:
    """Exploited weaknesses first, then severity, path and line: the first rows."""
    return findings.orderBy(F.desc("exploited"), F.desc(T.rank("severity", T.SOURCE_RANK, 1)), "path", "line", "run_id", "number").limit(limit)


def run_history(pairs: DataFrame, runs: DataFrame, diff: DataFrame) -> DataFrame:
    """Per run: total, new, resolved and counts by severity of what it observed; zeros where it isn't completed."""
    now = F.col("diff_status").isin("new", "unchanged")
    per = diff.groupBy("run_id").agg(F.count_if(now).alias("total"), F.count_if(F.col("diff_status") == "new").alias("new"), F.count_if(F.col("diff_status") == "resolved").alias("resolved"), F.count_if(now & (F.col("severity") == "critical")).alias("critical"), F.count_if(now & (F.col("severity") == "high")).alias("high"))
    done = F.col("status") == "completed"
    cols = [F.when(done, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in ("total", "new", "resolved", "critical", "high")]
    return runs.join(per, "run_id", "left").join(pairs, "run_id", "left").select("run_id", "project_id", "baseline_run_id", *cols)


def severity_gate(findings: DataFrame, keys: list[str], threshold: str, dismissed: Column | None = None) -> DataFrame:
    """keys, breaching, failed: findings at the threshold or worse that aren't dismissed."""
    open_ = ~dismissed if dismissed is not None else F.lit(True)
    at = T.rank("severity", T.POLICY_RANK) >= T.POLICY_RANK[threshold]
    return findings.groupBy(*keys).agg(F.count_if(open_ & at).alias("breaching")).withColumn("failed", F.col("breaching") > 0)


def latest_covering_snapshot(snapshots: DataFrame, wanted: list[str], before: Column) -> DataFrame:
    """The newest snapshot of each project whose keys hold all wanted ones."""
    covers = F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col("keys"))) == 0
    return top_one(snapshots.where(covers & (F.col("taken_at") < before)), ["project_id"], [F.desc("taken_at"), F.desc("snapshot_id")])


def latest_covering_snapshots(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (request_id, project_id, wanted, before): the newest snapshot of its project, taken before, whose keys hold all wanted ones.

    Sets meet sets: each distinct set that a project's requests want looks up the distinct sets of its snapshots by the
    rarest of its keys alone, by how many of those hold it, and only these are compared whole. A snapshot is then an offer to the
    wanted sets that it covers, and requests and offers of a set are put in order of time, where each request takes the
    last offer before it: a sort, not pairs of requests and snapshots. A request that wants nothing, or a key that no snapshot
    has, gets none, nor does one with a null among its keys. snapshots: project_id, snapshot_id, keys, taken_at.
    """
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    taken = snapshots.where(F.col("taken_at").isNotNull()).select("project_id", as_set("keys").alias("keys"), F.struct("taken_at", "snapshot_id").alias("offer"))
    asked = requests.where((F.size("wanted") > 0) & ~F.exists("wanted", lambda k: k.isNull())).select("request_id", "project_id", as_set("wanted").alias("wanted"), "before")
    index = taken.select("project_id", "keys").distinct().withColumn("key", F.explode("keys"))
    held = index.groupBy("project_id", "key").agg(F.count("*").alias("n"))
    each = asked.select("project_id", "wanted").distinct().withColumn("key", F.explode("wanted")).join(held, ["project_id", "key"], "left")
    rarest = each.groupBy("project_id", "wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("x")).where(F.col("x.n") > 0)
    covers = rarest.select("project_id", "wanted", F.col("x.key").alias("key")).join(index, ["project_id", "key"]).where(F.size(F.array_except("wanted", "keys")) == 0).select("project_id", "wanted", "keys")
    offers = taken.join(covers, ["project_id", "keys"]).select("project_id", "wanted", F.col("offer.taken_at").alias("at"), F.lit(1).alias("kind"), "offer")
    starts = asked.select("project_id", "wanted", F.col("before").alias("at"), F.lit(0).alias("kind"), "request_id")
    # A request comes before an offer of the same time, as a snapshot must be earlier.
    so_far = Window.partitionBy("project_id", "wanted").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(offers, allowMissingColumns=True).withColumn("last", F.max("offer").over(so_far)).where((F.col("kind") == 0) & F.col("last").isNotNull())
    return met.groupBy("request_id", "project_id").agg(F.max("last").alias("x")).select("request_id", "project_id", "x.snapshot_id")


def union_missing(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and the baseline's that have no current one."""
    return current.unionByName(baseline.join(current.select(*keys), keys, "left_anti"))


def reconcile_ids(expected: DataFrame, observed: DataFrame, key: str = "id") -> DataFrame:
    """id, problem: unsolicited (not expected), conflicting (observed twice), unevaluated (not observed)."""
    tag = lambda df, s: df.select(key, F.lit(s).alias("problem"))
    twice = observed.groupBy(key).count().where(F.col("count") > 1)
    return tag(observed.join(expected, key, "left_anti").distinct(), "unsolicited").unionByName(tag(twice, "conflicting")).unionByName(tag(expected.join(observed, key, "left_anti").distinct(), "unevaluated"))


def finding_blobs(findings: DataFrame, links: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each finding's linked blobs; a link whose blob is missing keeps a null one."""
    return findings.join(links, "finding_id").join(blobs, "blob_id", "left")


def glob_regex(pattern: str) -> str:
    """A gitignore-style pattern as a regular expression over whole paths: one with an inner slash starts at the root, ``**`` crosses folders, a folder holds what is under it."""
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c
            i += 1
    start = "^" if pattern.startswith("/") or "/" in pattern.rstrip("/") else "(?:^|.*/)"
    return f"{start}{out}(?:/.*)?$"


def apply_finding_policy(findings: DataFrame, reviews: DataFrame, entries: DataFrame, suppressions: list[tuple[int, str, str, str]], now: Column) -> DataFrame:
    """findings with state and origin: the local active review, else the first unexpired entry of the fingerprint, else the last suppression of the rule whose pattern finds the path, else candidate.

    reviews: project_id, fingerprint, state (local and active). entries: position, fingerprint, state, expires_at.
    suppressions: position, rule_id, path pattern, state; unexpired ones, as the policy file lists them.
    """
    live = entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    first = live.groupBy("fingerprint").agg(F.min_by("state", "position").alias("_entry"))
    last = F.lit(None).cast("string")
    for _, rule, pattern, state in sorted(suppressions):
        last = F.when((F.col("rule_id") == rule) & F.col("path").rlike(glob_regex(pattern)), state).otherwise(last)
    x = findings.join(reviews.select("project_id", "fingerprint", F.col("state").alias("_local")), ["project_id", "fingerprint"], "left").join(first, "fingerprint", "left").withColumn("_last", last)
    origin = F.when(F.col("_local").isNotNull(), "local").when(F.coalesce("_entry", "_last").isNotNull(), "projectPolicy")
    return x.withColumn("state", F.coalesce("_local", "_entry", "_last", F.lit("candidate"))).withColumn("origin", origin).drop("_local", "_entry", "_last")
