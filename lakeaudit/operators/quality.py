"""Scores of detectors against labelled data. A ratio without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_GROUPS = 10_000  #: of a compliance profile's pattern groups, which are broadcast


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b != 0, a / b), 6)


def with_scores(df: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def score_suite(expected: DataFrame, absent: DataFrame, hits: DataFrame) -> DataFrame:
    """Per rule: tp, fn over targets' expected minimums, fp over targets where the rule must not fire, collateral, scores.

    expected: target, rule_id, minimum. absent: target, rule_id. hits: target, rule_id. A hit on a target that neither
    expects nor forbids its rule is collateral; it counts as fp only for rules that the suite covers.
    """
    n = hits.groupBy("target", "rule_id").agg(F.count("*").alias("n"))
    want = expected.withColumn("wanted", F.lit(True)).unionByName(absent.withColumn("minimum", F.lit(None).cast("int")).withColumn("wanted", F.lit(False)), allowMissingColumns=True)
    x = want.join(n, ["target", "rule_id"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    met = F.col("wanted") & (F.col("n") >= F.col("minimum"))
    per = x.groupBy("rule_id").agg(
        F.count_if(met).alias("tp"), F.count_if(F.col("wanted") & ~met).alias("fn"), F.count_if(~F.col("wanted") & (F.col("n") > 0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("wanted").isNull(), F.col("n"))), F.lit(0)).alias("collateral"), F.count(F.col("wanted")).alias("covered"),
    )
    per = per.withColumn("fp", F.col("fp") + F.when(F.col("covered") > 0, F.col("collateral")).otherwise(0))
    return with_scores(per.drop("covered"))


def score_labelled(cases: DataFrame, flagged: DataFrame, key: str = "case_id") -> DataFrame:
    """cases: key, category, vulnerable, covered. Per category, and in total per covered (category null): the confusion matrix, precision, recall, fpr, youden."""
    x = cases.join(flagged.select(key, F.lit(True).alias("hit")).distinct(), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    cell = lambda v, h: F.count_if((F.col("vulnerable") == v) & (F.col("hit") == h))
    per = x.rollup("covered", "category").agg(F.grouping_id().alias("g"), cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(False, False).alias("tn")).where(F.col("g") < 3).drop("g")
    out = with_scores(per).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    return out.withColumn("youden", F.round(F.col("recall") - F.col("fpr"), 6))


def judge_observations(expected: DataFrame, actual: DataFrame, variants: DataFrame) -> DataFrame:
    """Per target, as multisets: tp = sum of min(actual, expected), fn = shortfall, fp = surplus, after variants are mapped to their identity.

    expected: target, identity, count. actual: target, identity. variants: target, variant, identity.
    """
    v = variants.select("target", F.col("variant").alias("identity"), F.col("identity").alias("mapped"))
    got = actual.join(v, ["target", "identity"], "left").groupBy("target", F.coalesce("mapped", "identity").alias("identity")).agg(F.count("*").alias("got"))
    x = expected.join(got, ["target", "identity"], "full_outer").fillna(0, ["count", "got"])
    return x.groupBy("target").agg(F.sum(F.least("count", "got")).alias("tp"), F.sum(F.greatest(F.lit(0), F.col("count") - F.col("got"))).alias("fn"), F.sum(F.greatest(F.lit(0), F.col("got") - F.col("count"))).alias("fp"))


def compare_quality(current: DataFrame, baseline: DataFrame, most_lost: float) -> DataFrame:
    """Per category: deltas of precision and recall, and passed, regressed, coverage-lost or population-changed."""
    b = baseline.select("category", *(F.col(c).alias(f"b_{c}") for c in ("cases", "precision", "recall")))
    x = b.join(current.select("category", "cases", "precision", "recall"), "category", "full_outer")
    dp, dr = (F.round(F.coalesce(c, F.lit(0.0)) - F.coalesce(F.col(f"b_{n}"), F.lit(0.0)), 6) for n, c in (("precision", F.col("precision")), ("recall", F.col("recall"))))
    status = F.when(F.col("cases").isNull(), "coverage-lost").when(F.col("b_cases").isNull() | (F.col("cases") != F.col("b_cases")), "population-changed").when((dp < -most_lost) | (dr < -most_lost), "regressed").otherwise("passed")
    return x.select("category", dp.alias("precision_delta"), dr.alias("recall_delta"), status.alias("status"))


def compliance_assess(controls: DataFrame, files: DataFrame, evidence: int = 5) -> DataFrame:
    """Per control: groups, matched, status and the first evidence paths, each from the controls' own groups.

    controls: control_id, file_groups (arrays of patterns as regular expressions), manual. A group is matched by any file
    that one of its patterns finds; distinct paths are tested once. A manual control is manualReview.
    """
    each = controls.select("control_id", F.posexplode("file_groups").alias("group", "patterns"))
    paths = files.select("path").distinct()
    # The patterns of a profile are few, as counted, so each path is tested against all of them as it streams by.
    if each.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of patterns: assess the controls in parts")
    met = paths.join(F.broadcast(each), F.exists("patterns", lambda p: F.rlike(F.col("path"), p)))
    # A control's first paths are kept by each task before they are brought together.
    first = met.select("control_id", "path").distinct().withColumn("n", F.row_number().over(Window.partitionBy("control_id").orderBy("path"))).where(F.col("n") <= evidence)
    shown = first.groupBy("control_id").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("evidence"))
    done = met.groupBy("control_id").agg(F.countDistinct("group").alias("matched")).join(shown, "control_id")
    out = controls.select("control_id", F.size("file_groups").alias("groups"), "manual").join(done, "control_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    status = F.when(F.col("manual"), "manualReview").when(F.col("matched") == F.col("groups"), "supported").when(F.col("matched") > 0, "partial").otherwise("gap")
    return out.withColumn("status", status)


def compliance_summary(assessed: DataFrame) -> DataFrame:
    """Counts by status and the score: (100 * supported + 50 * partial) div assessable, 100 at most."""
    n = lambda s: F.count_if(F.col("status") == s)
    x = assessed.agg(n("supported").alias("supported"), n("partial").alias("partial"), n("gap").alias("gap"), n("manualReview").alias("manual"))
    can = F.col("supported") + F.col("partial") + F.col("gap")
    return x.withColumn("score", F.when(can > 0, F.least(F.lit(100), F.floor((100 * F.col("supported") + 50 * F.col("partial")) / can))))


def dependency_paths(edges: DataFrame, roots: DataFrame, checkpoint, max_depth: int = 64, max_paths: int = 32, cut_every: int = 4) -> DataFrame:
    """project, node, depth, chain: from every root, the shortest chains to each node, max_paths of them, without cycles.

    edges: project, parent, child. roots: project, node. A level joins the frontier with the edges, which are written once
    for all levels; a node that has its paths takes no longer ones. checkpoint cuts the lineage every few levels.

    A node has at most as many chains of a length as edges lead to it times the most chains of a node one shorter. While
    these sum up to no more than max_paths, no node can have too many, and none are counted.
    """
    frontier = roots.select("project", "node", F.lit(0).alias("depth"), F.array("node").alias("chain")).distinct()
    found, out = frontier, checkpoint(edges.select("project", F.col("parent").alias("node"), "child"))
    into = out.groupBy("project", "child").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one row
    longest = most = 1
    for depth in range(1, max_depth + 1):
        longest *= into
        most += longest
        step = frontier.join(out, ["project", "node"]).where(~F.array_contains("chain", F.col("child")))
        step = step.select("project", F.col("child").alias("node"), F.lit(depth).alias("depth"), F.concat("chain", F.array("child")).alias("chain"))
        if most > max_paths:
            held = found.groupBy("project", "node").agg(F.count("*").alias("held"))
            w = Window.partitionBy("project", "node").orderBy(F.array_join("chain", "/"))
            step = step.join(held, ["project", "node"], "left").withColumn("n", F.row_number().over(w)).where(F.col("n") + F.coalesce("held", F.lit(0)) <= max_paths).drop("n", "held")
        step = checkpoint(step)
        if step.isEmpty():
            break
        found = found.unionByName(step)
        if depth % cut_every == 0:
            found = checkpoint(found)
        frontier = step
    return found


def path_status(nodes: DataFrame, edges: DataFrame, roots: DataFrame, paths: DataFrame, max_depth: int = 64, max_paths: int = 32) -> DataFrame:
    """nodes with paths (their number), gap and status, from what dependency_paths found with the same limits.

    unavailable: the project has no roots. partial: no root reaches the node, or something of its project was cut, as gap
    says (cycle, depth or paths), so that more chains may exist. available: it has chains and nothing was cut, or it is the
    project's own code (column own), which needs none.

    Every chain found is extended once by its node's edges, so a project's cut ones are counted by one join.
    """
    reached = roots.select("project", "node").distinct()
    further = paths.join(edges.select("project", F.col("parent").alias("node"), "child"), ["project", "node"])
    back = F.array_contains("chain", F.col("child"))
    cuts = further.groupBy("project").agg(F.bool_or(back).alias("cycle"), F.bool_or(~back & (F.col("depth") >= max_depth)).alias("deep"))
    offered = further.where(~back & (F.col("depth") < max_depth)).select("project", F.col("child").alias("node")).unionByName(reached).groupBy("project", "node").agg(F.count("*").alias("n"))
    many = offered.groupBy("project").agg((F.max("n") > max_paths).alias("many"))
    gap = F.when(F.col("cycle"), "cycle").when(F.col("deep"), "depth").when(F.col("many"), "paths")
    have = paths.groupBy("project", "node").agg(F.count("*").alias("paths"))
    rooted = roots.select("project", F.lit(True).alias("rooted")).distinct()
    x = nodes.join(have, ["project", "node"], "left").join(rooted, "project", "left").join(cuts, "project", "left").join(many, "project", "left").fillna(0, ["paths"])
    status = F.when(F.col("rooted").isNull(), "unavailable").when(F.col("paths") > 0, F.when(gap.isNull(), "available").otherwise("partial")).when(F.col("own"), "available").otherwise("partial")
    return x.select(*nodes.columns, "paths", gap.alias("gap"), status.alias("status"))
