"""What must hold at any size: plans that pass no table through the driver, work that goes with the input, documents of any depth."""

import json
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeaudit.jobs.registry import QUERIES
from lakeaudit.operators import advisories as D
from lakeaudit.operators import composition as C
from lakeaudit.operators import lifecycle as L
from lakeaudit.operators import pages
from lakeaudit.sources import readers

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@tables
@pytest.mark.parametrize("name", ["match_advisories", "match_any_versions", "new_advisories_vs_baseline", "vex_suggestions", "upgrade_groups", "component_advisories", "code_quality_advisories", "advisory_decision", "advisory_policy_inputs", "monitor", "monitor_runs"])
def test_advisories_are_not_broadcast(spark, name):
    """The estimate of these small tables would broadcast every side; a side of millions of rows would do so by the size of its files."""
    found = plan(QUERIES[name](spark, SF))
    few = {"document", "base", "ecosystem"}  # trusted documents and ecosystems
    keys = [set(re.findall(r"(\w+)#", k)) for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", found)]
    assert "SortMergeJoin" in found and all(k <= few for k in keys), found


@tables
def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda folder: sorted(map(tuple, QUERIES["stream_scan"](spark, folder).collect()))
    assert rows(str(tmp_path)) == rows(SF) != []


def test_sboms_of_any_depth(spark, tmp_path):
    n = 30_000
    nested = "".join(f'{{"bom-ref":"r{i}","name":"n{i}","version":"1","components":[' for i in range(n)) + "]}" * n
    (tmp_path / "deep.json").write_text(f'{{"bomFormat":"CycloneDX","components":[{nested}],"dependencies":[{{"ref":"r1","dependsOn":["r0"]}}]}}')
    (tmp_path / "open.json").write_text("[" * n)
    got = readers.read_sbom(spark, str(tmp_path))
    assert got.where("error IS NULL").select("ref").distinct().count() == n and got.where("error = 'no JSON'").count() == 1
    assert [r.depends_on for r in got.where("ref = 'r1'").collect()] == [["r0"]]


def test_json_by_a_stack_is_json():
    r = random.Random(5)
    make = lambda d: r.choice([1, -2.5e3, True, None, "é\\n\"x", ""]) if d == 0 else [make(r.randrange(d)) for _ in range(r.randrange(4))] if r.random() < 0.5 else {r.choice("abc"): make(r.randrange(d)) for _ in range(r.randrange(4))}
    for _ in range(500):
        text = json.dumps(make(5), indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        assert readers._deep_json(text) == json.loads(text)
        k = r.randrange(len(text))
        for bad in (text[:k], text[:k] + r.choice("{}[],:x") + text[k:]):
            try:
                want = json.loads(bad)
            except ValueError:
                with pytest.raises(ValueError):
                    readers._deep_json(bad)
            else:
                assert readers._deep_json(bad) == want


def test_claims_leave_a_worker_in_slices():
    taken = []

    def walk(documents):
        for document, _ in documents:
            for n in range(5):
                taken.append(n)
                yield document, n, "vex-statement", None, None, f"CVE-{n}", ["a"], None, None, True

    batch = pa.RecordBatch.from_arrays([pa.array(["d", "e"]), pa.array(["", ""])], ["document", "content"])
    parts = readers._sliced(walk, readers._CLAIM, 2)(iter([batch]))
    assert next(parts).num_rows == 2 and len(taken) == 2 and [p.num_rows for p in parts] == [2, 2, 2, 2]


def test_covering_snapshots_pair_no_requests(spark):
    """Requests of one project and set, and as many snapshots that cover it: they meet by a sort."""
    at = "timestamp_seconds(id * 10 + {})"
    snaps = spark.range(20_000).selectExpr("'p' AS project_id", "id AS snapshot_id", "array('a', 'b') AS keys", at.format(0) + " AS taken_at")
    asks = spark.range(20_000).selectExpr("id AS request_id", "'p' AS project_id", "array('a') AS wanted", at.format(0) + " AS before")
    got = L.latest_covering_snapshots(snaps, asks)
    assert not re.search(r"Join \[[^\]]*request_id", plan(got))
    assert got.count() == 19_999 and got.where("snapshot_id <> request_id - 1").count() == 0


def test_ranges_are_many_and_tasks_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "MOST_PARTS", 3)
    order, rows = [F.asc("a")], list(range(5_000))
    pages.write_ranked(spark.createDataFrame([(i,) for i in rows], "a int").repartition(5), order, str(tmp_path), per=100)
    ranked = pages.Ranked(spark, str(tmp_path), order)
    assert ranked.total == 5_000 and 50 <= len(ranked.ranges) <= 53 and len(os.listdir(tmp_path / "rows" / f"_range={ranked.ranges[0]}")) <= 2
    for offset in (0, 99, 1_666, 3_333, 4_990):
        assert [r.a for r in ranked.page(offset, 30).collect()] == rows[offset : offset + 30]
        assert len(ranked.page(offset, 30).inputFiles()) <= 2


def test_usage_holds_no_pairs_of_names_and_paths(spark):
    corpus = spark.createDataFrame([("p", "a.py", "import x\nimport y"), ("p", "a.py", "import x"), ("p", "b.py", "import x"), ("p", "c.py", "")], "project_id string, path string, content string")
    got = D.usage_index(corpus)
    assert {(r.name, r.files, r.first_path) for r in got.where("ecosystem = 'PyPI'").collect()} == {("x", 2, "a.py"), ("y", 1, "a.py")}
    assert not re.search(r"keys=\[ecosystem#\d+, project_id#\d+, name#\d+, path#", plan(got))


def test_totals_of_views_are_a_cube_without_its_shuffle(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, None]), r.choice(["open", "closed", None]), r.choice(["new", "resolved", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "run_id int, view string, diff_status string")
    got, want = L.view_diff_counts(df), df.cube("run_id", "view", "diff_status").agg(F.count("*").alias("n")).where("run_id IS NOT NULL")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and "Expand" not in plan(got)


def test_sites_and_advisories_are_not_paired(spark):
    """One version at many sites with many advisories: counts as component_advisories has them, from rows that go with sites and advisories."""
    r = random.Random(3)
    sites = [(p, "npm", f"n{r.randrange(4)}", "1", r.choice([True, False, None])) for p in range(30) for _ in range(3)]
    vulns = [("npm", f"n{r.randrange(3)}", "1", f"A{r.randrange(9)}", r.choice(["low", "critical", None])) for _ in range(40)]
    s = spark.createDataFrame(sites, "project_id int, ecosystem string, name string, version string, dismissed boolean")
    v = spark.createDataFrame(vulns, "ecosystem string, name string, version string, advisory_id string, severity string")
    got, want = C.site_advisories(s, v), C.component_advisories(s.join(v, ["ecosystem", "name", "version"]))
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


@tables
@pytest.mark.parametrize("name", ["component_advisories", "rank_components", "composition_report", "composition_summary", "portfolio_components"])
def test_advisories_of_components_are_counted_by_version(spark, name):
    found = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*project_id#[^\]]*advisory_id#", found), found


def _inventory(spark):
    """Runs whose components have aliases, some of them reported, and advisories without a place."""
    r = random.Random(8)
    deps = [(run, "npm", f"n{r.randrange(3)}", f"{r.randrange(4)}.0.0", None, False) for run in range(12) for _ in range(4)]
    adv = [(f"A{i}", "npm", f"n{i % 3}", None, [f"C{i % 4}", f"D{i % 5}"], [], [("SEMVER", [("0", None, None, None), (None, r.choice(["2.0.0", "3.0.0", "soon"]), None, None)])]) for i in range(20)]
    told = [(run, e, n, v, r.choice(["A1", "C2", "C3", "D1", None])) for run, e, n, v, *_ in deps for _ in range(r.randrange(3))]
    event = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
    return (
        spark.createDataFrame(deps, "run_id int, ecosystem string, name string, version string, source string, local_workspace boolean"),
        spark.createDataFrame(adv, f"id string, ecosystem string, package string, withdrawn string, aliases array<string>, versions array<string>, ranges array<struct<type:string,events:array<{event}>>>"),
        spark.createDataFrame(told, "run_id int, ecosystem string, name string, version string, reported_id string"),
    )


def test_runs_are_counted_without_their_matches(spark):
    deps, adv, told = _inventory(spark)
    found, counts = D.monitor(deps, adv, told), D.monitor_counts(deps, adv, told)
    got, want = (sorted(map(tuple, D.monitor_runs(deps, adv, x).collect())) for x in (counts, found))
    assert got == want and any(r[2] for r in got) and any(r[3] for r in got)
    # No join of runs' components has a row for each match: the run is only joined with counts.
    assert not re.search(r"Project \[[^\]]*run_id#[^\]]*advisory_id#", counts._jdf.queryExecution().optimizedPlan().toString())


def test_equal_ranges_are_held_once(spark):
    deps, adv, _ = _inventory(spark)
    met, own = D.match_advisories(deps, adv).withColumn("lockfile", F.lit("l")), adv.select(F.col("id").alias("advisory_id"), "ranges")
    got, want = D.upgrade_groups(met, own), D.upgrade_groups(met.join(own, "advisory_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != [] and any(r.candidate for r in got.collect())
    event = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
    ranges = [("ECOSYSTEM", [("0", None, None, None), (None, "2.0.0", None, None)])]
    many = spark.createDataFrame([("npm", "n", "1.0.0", "l", f"A{i}", ranges) for i in range(50)], f"ecosystem string, name string, version string, lockfile string, advisory_id string, ranges array<struct<type:string,events:array<{event}>>>")
    x = D.upgrade_groups(many)
    assert [(r.advisories, r.candidate) for r in x.collect()] == [(50, "2.0.0")]
    assert re.search(r"Aggregate \[[^\]]*_range#", x._jdf.queryExecution().optimizedPlan().toString())


@tables
def test_advisory_lists_are_not_shuffled(spark):
    """No aggregate above the join that brings the lists."""
    found = QUERIES["advisory_policy_inputs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in found[: found.index("Join LeftOuter")]


def test_paths_are_counted_only_where_there_may_be_too_many(spark):
    from lakeaudit.operators import quality as Q

    r, cuts = random.Random(2), []
    edges = sorted({(p, a, b) for p in range(5) for _ in range(14) for a, b in [(r.randrange(6), r.randrange(6))] if a != b})
    e, roots = spark.createDataFrame(edges, "project int, parent int, child int"), spark.createDataFrame([(p, 0) for p in range(5)], "project int, node int")

    def walk(most):
        level, have, out = [(p, 0, (0,)) for p in range(5)], {}, []
        while level:
            kept = []
            for p, n, c in sorted(level, key=lambda x: (x[0], x[1], "/".join(map(str, x[2])))):
                if have.get((p, n), 0) < most:
                    have[p, n] = have.get((p, n), 0) + 1
                    kept.append((p, n, c))
            out += kept
            level = [(p, b, (*c, b)) for p, n, c in kept for q, a, b in edges if (q, a) == (p, n) and b not in c]
        return sorted(out)

    def cut(df):
        cuts.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    for most in (1, 3, 32, 10**9):
        cuts.clear()
        got = sorted((x.project, x.node, tuple(x.chain)) for x in Q.dependency_paths(e, roots, cut, max_paths=most).collect())
        assert got == walk(most)
    assert not any("Window" in c for c in cuts)  # of 10**9


@tables
@pytest.mark.parametrize("name, scans", [("compare_runs", 3), ("compare_runs_packs", 4)])
def test_run_diffs_are_made_once(spark, name, scans):
    """Each table is read once, and after findings, coverage and packs meet by run nothing is shuffled."""
    found = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = found[: found.index("Exchange hashpartitioning")]
    assert found.count("FileScan") == scans and "Window" in above and "Join" not in above and "Union" in found, found


def test_run_diffs_equal_brute_force(spark):
    r = random.Random(11)
    pick = lambda *x: r.choice(x)
    pairs = [(run, run + 1) for run in range(12)] + [(20, 3), (21, 99)]
    f = [(pick(*range(14), 20, 21), pick(1, 2), pick("a", "b", "c", None), pick("q/r", "p/r", "r", None), "low", pick("source", "secrets", None), pick("x", "y", None)) for _ in range(300)]
    cover = [(pick(*range(14), 20, None), pick("x", "y", None), pick("source", "secrets", None)) for _ in range(300)]
    held = [(pick(*range(14)), pick("q", "p", None), pick("h1", "h2", None)) for _ in range(50)]
    kinds = "run_id int, fingerprint_version int, fingerprint string, rule_id string, severity string, category string, path string"
    findings, p = spark.createDataFrame(f, kinds), spark.createDataFrame(pairs, "run_id int, baseline_run_id int")
    coverage, packs = spark.createDataFrame(cover, "run_id int, path string, family string"), spark.createDataFrame(held, "run_id int, pack_id string, hash string")
    hashes = lambda run, rule: {h for a, k, h in held if a == run and k == rule.split("/")[0] and h} if (run, rule.split("/")[0]) in {x[:2] for x in held} else None
    for use in (False, True):
        want = []
        for run, base in pairs:
            now, then = ({x[1:3] for x in f if x[0] == side} for side in (run, base))
            want += [(run, *x, "unchanged" if x[1:3] in then else "new") for x in f if x[0] == run]
            for x in f:
                if x[0] == base and x[1:3] not in now:
                    rule, ok = x[3], x[6] is not None and x[5] is not None and (run, x[6], x[5]) in cover
                    same = rule is not None and ("/" not in rule or (use and bool(hashes(run, rule)) and hashes(run, rule) == hashes(base, rule)))
                    want.append((run, *x, "resolved" if ok and same else "notEvaluated"))
        got = L.compare_runs(p, findings, coverage, *([packs] if use else []))
        assert got.columns == ["run_id", "observation_run_id", "fingerprint_version", "fingerprint", "rule_id", "severity", "category", "path", "diff_status"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and {x[-1] for x in want} == {"new", "unchanged", "resolved", "notEvaluated"}


def _opened(value):
    """What an open document holds, read whole."""
    if isinstance(value, readers._Held):
        value = list(value)
    return [_opened(x) for x in value] if isinstance(value, list) else {k: _opened(x) for k, x in value.items()} if isinstance(value, dict) else value


def test_claims_are_read_one_at_a_time_from_the_text(monkeypatch):
    r = random.Random(6)
    make = lambda d: r.choice([1, -2.5e3, True, None, "é\\n\"x", ""]) if d == 0 else [make(r.randrange(d)) for _ in range(r.randrange(4))] if r.random() < 0.5 else {r.choice(["runs", "results", "tool", "a"]): make(r.randrange(d)) for _ in range(r.randrange(4))}
    for _ in range(500):
        text = json.dumps(make(5), indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        k = r.randrange(len(text))
        for own in (text, text[:k], text[:k] + r.choice("{}[],:x") + text[k:]):
            try:
                want = json.loads(own)
            except ValueError:
                with pytest.raises(ValueError):
                    readers._open_json(own, {"runs": ("tool",)})
            else:
                assert _opened(readers._open_json(own, {"runs": ("tool",)})) == want
    # The longest text that is read at once is a claim, not a document of many; deep ones are read, too.
    longest, decode = [0], readers._decode

    def measured(text, i):
        value, end = decode(text, i)
        longest[0] = max(longest[0], end - i)
        return value, end

    monkeypatch.setattr(readers, "_decode", measured)
    result = {"ruleId": "R", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}}}]}
    docs = [{"statements": [{"vulnerability": {"name": f"CVE-{i}"}, "status": "fixed", "products": [{"@id": "p"}]} for i in range(1_000)]}, {"runs": [{"results": [result] * 1_000, "tool": {"driver": {"name": "T"}}}] * 2}]
    for doc, walk in zip(docs, (readers._openvex, readers._sarif), strict=True):
        want = list(walk(doc))
        assert list(walk(readers._open_json(json.dumps(doc), {"runs": ("tool",)}))) == want and len(want) >= 1_000 and all(x[-1] for x in want)
    assert 0 < longest[0] < 200
    deep = '{"statements": [' + "[" * 30_000 + "]" * 30_000 + ', {"status": "fixed"}]}'
    assert [x[5] for x in readers._openvex(readers._open_json(deep, {}))] == ["fixed"]


@tables
def test_notes_broadcast_no_packages(spark):
    """Packages of an inventory may be many; what is broadcast is one row."""
    found = plan(QUERIES["match_notes"](spark, SF))
    assert "BroadcastHashJoin" not in found and "SortMergeJoin" in found, found


def test_only_ids_that_can_strike_out_are_tested(spark):
    """Of what was reported, only ids that a package's advisories bear reach the matches; the rows are those of a test of every pair."""
    deps, adv, told = _inventory(spark)
    other = deps.select("run_id", "ecosystem", "name", "version", F.concat(F.lit("X"), F.col("run_id").cast("string")).alias("reported_id"))
    other = other.unionByName(other.withColumn("reported_id", F.concat(F.lit("A"), F.substring("name", 2, 1).cast("int") + 1)))  # of another package's advisory
    got = D.monitor(deps, adv, told.unionByName(other))
    plain = D.match_advisories(deps, adv).join(adv.select(F.col("id").alias("advisory_id"), "aliases"), "advisory_id")
    held = {tuple(r) for r in told.unionByName(other).where("reported_id IS NOT NULL").collect()}
    keys = {(r.run_id, r.ecosystem, r.name, r.version) for r in deps.collect()}
    want = [(*k, m.advisory_id, m.verdict) for m in plain.collect() for k in keys if k[1:] == (m.ecosystem, m.name, m.version) and not any((*k, i) in held for i in [m.advisory_id, *m.aliases])]
    assert sorted(map(tuple, got.collect())) == sorted(want) != []
    borne = {(a.package, i) for a in adv.collect() for i in [a.id, *a.aliases]}
    every = sorted((tuple(r) for r in told.unionByName(other).collect() if (r.name, r.reported_id) in borne), key=str)
    assert sorted(map(tuple, D._borne(told.unionByName(other), adv).collect()), key=str) == every and len(every) < told.count()
    assert "isnull(told" in got._jdf.queryExecution().optimizedPlan().toString()


@tables
def test_every_component_is_ranked(spark):
    from lakeaudit.jobs import queries_composition as QC

    x = QUERIES["rank_components"](spark, SF)
    rows, every = x.collect(), QC._per_component(spark, SF).select(*x.columns)
    assert sorted(rows) == sorted(every.collect()) and len(rows) > 200
    assert [tuple(r) for r in rows] == sorted(map(tuple, rows), key=lambda r: (r[5] is None, -(r[5] or 0), -r[4], *r[:4]))
    assert "rangepartitioning" in x._jdf.queryExecution().executedPlan().toString()


@tables
def test_occurrences_are_dealt_out_once(spark):
    """Line items are shuffled once for their counts and their lists: between the join and their table lies one exchange."""
    found = QUERIES["advisory_policy_inputs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = found[: found.index("== Initial Plan ==")].splitlines() if "== Initial Plan ==" in found else found.splitlines()
    left = lines[next(i for i, x in enumerate(lines) if "SortMergeJoin" in x and "LeftOuter" in x) + 1 :]
    left = left[: next(i for i, x in enumerate(left) if "FileScan" in x)]
    assert sum("Exchange" in x for x in left) == 1 and any("Aggregate" in x for x in left), found


@tables
def test_a_stream_reports_for_components_that_are_alike_once(spark, monkeypatch):
    """What the stream writes is far less than the runs' rows, and its second run adds nothing."""
    from lakeaudit.jobs import queries_reports as QR

    wrote, run = [], QR.U.stream_monitor

    def counted(advisories, inventory, reported, write, checkpoint):
        def counting(d):
            before = reported().count()
            write(d)
            wrote.append(reported().count() - before)

        return run(advisories, inventory, reported, counting, checkpoint)

    monkeypatch.setattr(QR.U, "stream_monitor", counted)
    folder = SF.replace("sf0.001", "sf0.01")
    rows, want = QR.stream_monitor(spark, folder), QUERIES["monitor"](spark, folder).drop("verdict")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.select(*rows.columns).collect())) != []
    assert len(wrote) == 2 and wrote[1] == 0 and 0 < 2 * wrote[0] < rows.count()
