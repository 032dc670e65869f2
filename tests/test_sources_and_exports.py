import io
import json
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators import deobfuscation, taint
from riskloom.plans import exports
from riskloom.sources import advisories, archives, traces
from riskloom.streaming import indicators as stream_indicators
from riskloom.streaming import releases


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_advisories(spark):
    a = {
        "id": "MAL-1", "summary": "bad", "details": "runs eval( and contacts http://x.example/a", "modified": "2025", "references": [{"type": "WEB", "url": "u"}],
        "affected": [
            {"package": {"name": "p", "ecosystem": "npm"}, "versions": ["1.0", "1.1"], "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0"}]}]},
            {"package": {"name": "q", "ecosystem": "npm"}}, {"versions": ["1"]},
        ],
    }
    b = {"id": "GHSA-1", "summary": "a typosquatting package", "affected": [{"package": {"name": "r", "ecosystem": "PyPI"}}]}
    c = {"id": "GHSA-2", "summary": "overflow", "affected": [{"package": {"name": "s", "ecosystem": "PyPI"}}]}
    rows = {r.package: r for r in advisories.parse_advisories(texts(spark, json.dumps(a), json.dumps(b), json.dumps(c), "{", None)).collect()}
    assert set(rows) == {"p", "q", "r"}
    assert rows["p"].version_glob == "1.0,1.1,2.0" and rows["q"].version_glob == "*" and rows["r"].attack_type == "typosquatting"
    assert rows["p"].code_indicators == ["eval("] and rows["p"].network_indicators == ["http://x.example/a"] and rows["p"].references_ == ["u"]


def test_rank_and_network_feeds(spark):
    listed = advisories.parse_rank_list(texts(spark, json.dumps({"rows": [{"project": "B", "download_count": 9}, {"project": "a", "download_count": 5}]})), "PyPI", "s", 1)
    assert [(r.package, r["rank"]) for r in listed.collect()] == [("b", 1)]
    ranked = advisories.parse_rank_map(texts(spark, '{"x": 1, "y": 3, "z": 3}'), "npm", "s")
    assert {r.package: r["rank"] for r in ranked.collect()} == {"y": 1, "z": 2, "x": 3}
    urls = advisories.parse_url_feed(texts(spark, "# c", '1,2024,"http://EX.com/a,b",online,x,malware,t,l,r', "1,2", '2,2024,http://ex.com/c,online,x,malware,t,l,r'))
    assert {(r.indicator, r.kind) for r in urls.collect()} == {("http://EX.com/a,b", "url"), ("http://ex.com/c", "url"), ("ex.com", "domain")}
    addresses = advisories.parse_address_feed(texts(spark, '[{"ip_address": "1.2.3.4", "port": 80}, {"malware": "m"}]'))
    assert [tuple(r) for r in addresses.collect()] == [("1.2.3.4", "ip", "?:80", "feodo")]


def test_registry_changes_and_titles(spark):
    pypi = {"info": {"name": "p", "version": "2"}, "releases": {"1": [{"packagetype": "bdist_wheel", "url": "w"}, {"packagetype": "sdist", "url": "s"}], "2": []}}
    assert {(r.version, r.archive_url) for r in advisories.parse_registry(texts(spark, json.dumps(pypi)), "PyPI").collect()} == {("1", "s"), ("2", None)}
    npm = {"name": "n", "dist-tags": {"latest": "1.0.0"}, "versions": {"1.0.0": {"dist": {"tarball": "t"}}}}
    assert [(r.package, r.archive_url, r.latest) for r in advisories.parse_registry(texts(spark, json.dumps(npm)), "npm").collect()] == [("n", "t", "1.0.0")]
    rows = [("p", "1", "create", 5), ("p", "1", "add source file x", 4), ("p", None, "create", 6), ("q", "1", "remove", 7)]
    df = spark.createDataFrame(rows, "package string, version string, action string, serial bigint")
    assert [tuple(r) for r in advisories.parse_changes(df).collect()] == [("p", "1", 4)]
    titles = advisories.parse_titles(spark.createDataFrame([("a b 1.0",), ("x",), (None,)], "title string"))
    assert [(r.package, r.version) for r in titles.collect()] == [("a b", "1.0")]


def test_techniques(spark):
    o = {"type": "attack-pattern", "name": "n", "description": "steals a credential", "kill_chain_phases": [{"phase_name": "execution"}], "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}]}
    bundle = json.dumps({"objects": [o, {**o, "revoked": True}, {**o, "kill_chain_phases": [{"phase_name": "other"}]}, {"type": "malware"}]})
    assert [tuple(r) for r in advisories.parse_techniques(texts(spark, bundle), ("execution",)).collect()] == [("T1", "n", "HIGH", "execution")]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        for name, data in (("package/x.py", b"x = 1\n"), ("package/lib.so", b"\x7fELF" + b"\0" * 9 + b"http://c.example/x\0"), ("package/big.txt", b"a" * 600_000)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.whl", "w") as z:
        z.writestr("q/y.js", "é".encode("latin-1"))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    rows = archives.read_archives(spark, str(tmp_path), keep_bytes=True)
    got = {r.path: r for r in rows.collect()}
    assert set(got) == {"package/x.py", "package/lib.so", "package/big.txt", "q/y.js", None}
    assert got["package/x.py"].content == "x = 1\n" and got["package/big.txt"].content is None and got["q/y.js"].content == "�" and got[None].error
    elf = archives.binary_kinds(rows.where("bytes IS NOT NULL")).first()
    assert elf.kind == "elf" and elf.network_strings == ["http://c.example/x"]


def test_benchmark_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("name,expected\np,positive\nq,0\nr,\n")
    assert {(r.package, r.label) for r in advisories.labelled(spark, str(tmp_path / "b.csv")).collect()} == {("p", "malicious"), ("q", "benign"), ("r", "benign")}


def test_traces(spark):
    doc = {"Analysis": {"install": {"Files": [{"Path": "/tmp/a", "Read": False, "Write": True}, {"Path": "/home/x/.npmrc", "Read": True, "Write": False}], "Sockets": [{"Address": "1.2.3.4", "Port": 80}], "Commands": [{"Command": ["sh", "-c", "x"]}], "DNS": [{"Queries": [{"Hostname": "h.example"}]}]}, "import": {}}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "{")], "id int, t string")
    got = {r.id: r for r in traces.observed(df, "id", "t").collect()}
    assert got[1].written == ["/tmp/a"] and got[1].sensitive_read == ["/home/x/.npmrc"] and got[1].sockets == ["1.2.3.4:80"] and got[1].commands == ["sh -c x"] and got[1].hosts == ["h.example"]
    assert got[2].written == [] and got[3].hosts == []
    log = 'execve("/bin/sh", [..]) = 0\nopenat(AT_FDCWD, "/etc/passwd", O_RDONLY) = 3\nconnect(3, {sin_addr=inet_addr("9.9.9.9")}) = 0\n'
    r = traces.system_calls(spark.createDataFrame([(1, log)], "id int, t string"), "id", "t").first()
    assert (r.executed, r.sensitive_opened, r.connects) == (["/bin/sh"], ["/etc/passwd"], ["9.9.9.9"])


def test_uuid5_and_documents(spark):
    ns = uuid.NAMESPACE_DNS.bytes
    names = spark.createDataFrame([("a",), ("é",), ("",)], "n string")
    for r in names.select("n", exports.uuid5(ns, F.col("n")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n))
    v = spark.createDataFrame([("npm", "@a/B", "1", "MALICIOUS"), ("npm", "c", "1", "CLEAN"), ("npm", "d", "1", "SUSPICIOUS")], "ecosystem string, package string, version string, verdict string")
    bundles = {r.package: json.loads(r.bundle) for r in exports.stix_bundles(v).collect()}
    assert [o["type"] for o in bundles["@a/B"]["objects"]] == ["indicator", "malware"] and [o["type"] for o in bundles["d"]["objects"]] == ["indicator"] and "c" not in bundles
    assert {(r.rule_name, r.action) for r in exports.policies(v).collect()} == {("npm-a-b-1", "deny"), ("npm-d-1", "warn")}
    e = spark.createDataFrame([("npm", "p", "1", "X", "malicious", 1.7)], "ecosystem string, package string, version string, code string, review string, confidence double")
    assert json.loads(exports.vex_documents(e).first().vex)["vulnerabilities"][0] == {"id": "X", "analysis": {"state": "exploitable"}, "ratings": [{"score": 10.0}]}


def test_layers(spark):
    import base64

    inner = 'x = "' + base64.b64encode(b"import os; os.system('id')").decode() + '"'
    outer = 'exec("' + base64.b64encode(inner.encode()).decode() + '")'
    df = spark.createDataFrame([(1, outer), (2, None), (3, "y = String.fromCharCode(101, 118, 97, 108)")], "id bigint, t string")
    got = {(r.id, r.depth, r.encoding): r.text for r in deobfuscation.decoded_layers(df, "id", "t").collect()}
    assert got == {(1, 1, "base64"): inner, (1, 2, "base64"): "import os; os.system('id')", (3, 1, "codes"): "eval"}
    assert {r.id for r in deobfuscation.augmented(df, "id", "t").where("t LIKE '%os.system%'").collect()} == {1}


def test_taint(spark):
    schema = "file_id bigint, ecosystem string, package string, version string, path string, basename string, language string, content string"
    one = "import os, base64\nimport requests as r\nk = os.getenv('T')\nd = base64.b64encode(k)\nr.post('u', data=d)\nk = 1\nr.post('u', data=k)\n"
    config = "import os\nSECRET = os.environ['S']\n"
    user = "from .config import SECRET, other\nimport subprocess\nsubprocess.run(SECRET)\n"
    rows = [(1, "PyPI", "p", "1", "p-1/p/a.py", "a.py", "python", one), (2, "PyPI", "p", "1", "p-1/p/config.py", "config.py", "python", config), (3, "PyPI", "p", "1", "p-1/p/user.py", "user.py", "python", user), (4, "PyPI", "p", "1", "x.py", "x.py", "python", "def ("), (5, "PyPI", "p", "1", "y.py", "y.py", "python", None)]
    df = spark.createDataFrame(rows, schema)
    assert [(r.file_id, r.source, r.sink, r.sink_line, r.transforms) for r in taint.flows(df).collect()] == [(1, "os.getenv", "requests.post", 5, "base64.b64encode")]
    assert [(r.file_id, r.source, r.sink) for r in taint.cross_file_flows(df).collect()] == [(3, "p.config:os.environ", "subprocess.run")]


def test_change_stream_resumes(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    seen = []

    def into(batch, _):
        seen.extend((r.serial, r.package) for r in releases.release_events(batch).collect())

    def run():
        releases.run_available(releases.changes(spark, str(folder), 2), str(tmp_path / "c"), into)

    (folder / "1.jsonl").write_text("".join(json.dumps({"serial": s, "package": f"p{s}", "version": "1", "action": "create"}) + "\n" for s in (1, 2, 3)) + "broken\n")
    run()
    run()
    (folder / "2.jsonl").write_text(json.dumps({"serial": 4, "package": "p4", "version": "1", "action": "add x"}) + "\n" + json.dumps({"serial": 5, "package": "p5", "version": "1", "action": "remove"}) + "\n")
    run()
    run()
    assert sorted(set(seen)) == [(1, "p1"), (2, "p2"), (3, "p3"), (4, "p4")]


def test_stream_of_indicators_equals_the_batch(spark, tmp_path):
    schema = "id bigint, type string, value string, confidence double, package string"
    rows = [(1, "ip", "a", 0.7, "p"), (2, "ip", "a", 0.7, "q"), (3, "ip", "b", 0.7, None), (4, "ip", "a", 0.7, "p"), (5, "ip", "b", 0.7, "p")]
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    query = stream_indicators.accumulated(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
    query.foreachBatch(lambda b, _: got.update({r.value: (r.observations, r.packages, r.confidence, r.promoted) for r in b.collect()})).start().awaitTermination()
    assert got == {"a": (3, 2, 0.9, True), "b": (2, 1, 0.7, False)}


def test_repeats_are_suppressed(spark, tmp_path):
    pd.DataFrame({"ts": pd.to_datetime(["2025-01-01 00:00:00", "2025-01-01 00:01:00", "2025-01-01 00:02:00"]), "sig": ["a", "a", "b"]}).to_parquet(tmp_path / "r.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("ts timestamp, sig string").parquet(str(tmp_path) + "/r.parquet*")
    kept = []
    q = releases.first_seen(stream, "ts", ["sig"], "6 minutes").writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
    q.foreachBatch(lambda b, _: kept.extend(r.sig for r in b.collect())).start().awaitTermination()
    assert sorted(kept) == ["a", "b"]
