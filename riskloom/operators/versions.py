"""Version order, predecessors and range predicates, all as built-in expressions.

Defined results: a part that is no number counts as 9999; null versions have a null key and satisfy nothing; a range of
unknown form gives null for a single range and false within `||`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Array of numbers that orders dotted versions."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(9999)))


def predecessors(releases: DataFrame, offsets: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Each version of a package with the versions 1, 3 and 5 places before it."""
    distinct = releases.select("ecosystem", "package", "version").where("version IS NOT NULL").distinct()
    order = Window.partitionBy("ecosystem", "package").orderBy(version_key(F.col("version")), "version")
    return distinct.select("*", *[F.lag("version", k).over(order).alias(f"before_{k}") for k in offsets])


def semver_parts(version: Column) -> Column:
    """struct(major, minor, patch) of a version, null if it does not begin with a number; suffixes are ignored."""
    m = r"^\s*[v=]*(\d+)(?:\.(\d+))?(?:\.(\d+))?"
    part = lambda k: F.coalesce(F.regexp_extract(version, m, k).try_cast("int"), F.lit(0))
    return F.when(version.rlike(m), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def satisfies(version: Column, spec: Column) -> Column:
    """Whether a version lies in a range: `*`, `^`, `~`, comparisons, x-ranges and `||` between them. `^0.0.z` takes all
    of 0.0, as the data model has it."""

    def single(one: Column) -> Column:
        text = F.trim(one)
        sign = F.regexp_extract(text, r"^(\^|~|>=|<=|>|<|=)?", 1)
        v, s = semver_parts(version), semver_parts(F.regexp_replace(text, r"^(\^|~|>=|<=|>|<|=)\s*", ""))
        wild = text.rlike(r"^[v=]*\d+(\.\d+)?\.[xX*]|^[v=]*\d+\.[xX*]|^[v=]*\d+$")
        parts = F.size(F.split(F.regexp_replace(text, r"\.?[xX*].*$", ""), r"\."))
        same_minor = (v["major"] == s["major"]) & (v["minor"] == s["minor"])
        caret = F.when(s["major"] > 0, v["major"] == s["major"]).otherwise(same_minor)
        return (
            F.when(text.isin("", "*", "x", "X", "latest"), v.isNotNull())
            .when(s.isNull() | v.isNull(), F.lit(None).cast("boolean"))
            .when(sign == "^", caret & (v >= s))
            .when(sign == "~", same_minor & (v >= s))
            .when(sign == ">=", v >= s)
            .when(sign == "<=", v <= s)
            .when(sign == ">", v > s)
            .when(sign == "<", v < s)
            .when((sign == "") & wild, F.when(parts == 1, v["major"] == s["major"]).otherwise(same_minor))
            .otherwise(v == s)
        )

    alternatives = F.split(spec, r"\|\|")
    return F.when(F.size(alternatives) == 1, single(spec)).otherwise(F.exists(alternatives, lambda a: F.coalesce(single(a), F.lit(False))))


_PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:(?:-(\d+))|(?:[-_.]?(post|rev|r)[-_.]?(\d*)))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?\s*$"
)


def pep440_key(version: Column) -> Column:
    """struct that orders Python versions: epoch, release without trailing zeros, pre-, post- and development release; null
    for what is no version. Local parts are not compared."""
    group = lambda k: F.regexp_extract(version, _PEP440, k)
    number = lambda k: F.coalesce(group(k).try_cast("bigint"), F.lit(0))
    release = F.transform(F.split(F.regexp_replace(group(2), r"(?:\.0+)+$", ""), r"\."), lambda p: p.cast("bigint"))
    pre, post, dev = F.lower(group(3)), (group(5) != "") | (group(6) != ""), group(8) != ""
    stage = F.when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).when(pre != "", 2)
    before = F.when(pre != "", stage).when(~post & dev, -1).otherwise(9)
    after = F.when(post, F.when(group(5) != "", number(5)).otherwise(number(7))).otherwise(F.lit(-1))
    last = F.when(dev, number(9)).otherwise(F.lit(2**62))
    key = F.struct(
        number(1).alias("epoch"), release.alias("release"), before.alias("stage"), number(4).alias("pre"), after.alias("post"), last.alias("dev")
    )
    return F.when(version.rlike(_PEP440), key)


def pep440_fits(version: Column, spec: Column) -> Column:
    """Whether a release lies in a set of Python version specifiers (`==`, `!=`, `<=`, `>=`, `<`, `>`, `~=`, `===`, wildcards;
    all of a list must hold; none given means `==`). Pre- and development releases lie in no set; a malformed set gives null."""
    v = pep440_key(version)
    text = F.trim(spec)
    text = F.when(text.rlike(r"^[<>=!~]"), text).otherwise(F.concat(F.lit("=="), text))

    def padded(release: Column, n: Column) -> Column:
        return F.slice(F.concat(release, F.array_repeat(F.lit(0).cast("bigint"), 64)), F.lit(1), n)

    def single(one: Column) -> Column:
        sign = F.regexp_extract(one, r"^\s*(===|~=|==|!=|<=|>=|<|>)", 1)
        rest = F.trim(F.regexp_replace(one, r"^\s*(===|~=|==|!=|<=|>=|<|>)", ""))
        wild = rest.endswith(".*") & sign.isin("==", "!=")
        s = pep440_key(F.regexp_replace(rest, r"\.\*$", ""))
        parts = F.size(F.split(F.regexp_extract(rest, r"^v?(?:\d+!)?(\d+(?:\.\d+)*)", 1), r"\."))
        same = lambda n: (v["epoch"] == s["epoch"]) & (padded(v["release"], n) == padded(s["release"], n))
        base = (v["epoch"] == s["epoch"]) & (v["release"] == s["release"])
        return (
            F.when(sign == "===", F.lower(F.trim(version)) == F.lower(rest))
            .when((sign == "") | s.isNull() | (rest.endswith(".*") & ~wild), F.lit(None).cast("boolean"))
            .when(wild, F.when(sign == "==", same(parts)).otherwise(~same(parts)))
            .when(sign == "==", v == s)
            .when(sign == "!=", v != s)
            .when(sign == "<=", v <= s)
            .when(sign == ">=", v >= s)
            .when(sign == "<", v < s)
            .when(sign == ">", (v > s) & ~(base & (s["post"] < 0)))
            .when((sign == "~=") & (parts > 1), (v >= s) & same(parts - 1))
        )

    clauses = F.filter(F.split(text, ","), lambda c: F.trim(c) != "")
    held = F.transform(clauses, single)
    plain = (v["stage"] == 9) & (v["dev"] == 2**62)
    return F.when(F.trim(spec) == "", F.lit(None).cast("boolean")).when(
        F.exists(held, lambda h: h.isNull()), F.lit(None).cast("boolean")
    ).otherwise(F.coalesce(plain, F.lit(False)) & F.forall(held, lambda h: h))


def pinned(spec: Column) -> Column:
    """The version that a specifier pins (`1.2`, `=1.2`, `==1.2`), else null."""
    found = F.regexp_extract(spec, r"^\s*(?:==|=)?\s*([0-9][^,;\s]*)\s*$", 1)
    return F.when(found != "", found)


def max_satisfying_python(specs: DataFrame, releases: DataFrame) -> DataFrame:
    """(ecosystem, package, spec, best) as max_satisfying gives, by Python's rules."""
    r = releases.select("ecosystem", "package", "version").distinct()
    joined = specs.select("ecosystem", "package", "spec").distinct().join(r, ["ecosystem", "package"], "left")
    fits = F.when(pep440_fits(F.col("version"), F.col("spec")), F.struct(pep440_key(F.col("version")).alias("k"), F.col("version").alias("v")))
    return joined.groupBy("ecosystem", "package", "spec").agg(F.max(fits)["v"].alias("best"))


def max_satisfying(specs: DataFrame, releases: DataFrame) -> DataFrame:
    """(ecosystem, package, spec, best): the greatest release within each range, null if none is."""
    r = releases.select("ecosystem", "package", "version").distinct()
    joined = specs.select("ecosystem", "package", "spec").distinct().join(r, ["ecosystem", "package"], "left")
    fits = F.when(satisfies(F.col("version"), F.col("spec")), F.struct(semver_parts(F.col("version")).alias("k"), F.col("version").alias("v")))
    return joined.groupBy("ecosystem", "package", "spec").agg(F.max(fits)["v"].alias("best"))
