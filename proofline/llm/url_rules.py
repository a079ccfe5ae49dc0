"""URL filtering by a sort-merge range join over reversed-host keys.

``www.example.com`` becomes ``com.example.www.``, so "this host and all its
subdomains" is the interval of keys that start with the rule's key.  Such
intervals nest or are disjoint.  A sweep over rules and probes in key order
therefore needs one stack: a rule is pushed where its interval opens, and a
probe pops what does not contain it.  Here each rule carries the stack as it
is right after its own push (itself and the rules around it), the window takes
the last pushed stack at or before a probe, and a filter pops.

Two sweeps run, both on distinct values only: hosts against rule hosts, then
the paths of hosts with rules against each rule host's paths.  Probes are
salted and rules are repeated in every salt, so one frequent top-level domain
or rule host never becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, left_join_hot, lower_az

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(probes: DataFrame, pushes: DataFrame, salts: int) -> DataFrame:
    """``probes`` (slice, key, ...) with ``stack``: the nested rules around the key, innermost first.

    ``pushes`` has (slice, key, stack), the stack being an array of structs with a field ``key``.
    """
    spread = pushes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("probe", F.lit(0))
    salted = probes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).withColumn("probe", F.lit(1))
    order = Window.partitionBy("slice", "salt").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, 0)
    swept = spread.unionByName(salted, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(order))
    inside = F.filter("stack", lambda rule: F.startswith(F.col("key"), rule["key"]))
    return swept.where("probe = 1").withColumn("stack", inside).drop("salt", "probe")


def _host_pushes(rules: DataFrame) -> DataFrame:
    hosts = rules.select(F.col("rule_host").alias("host"), host_key(F.col("rule_host")).alias("key")).distinct()
    labels = F.split(F.col("key"), r"\.", -1)
    around = hosts.select(
        "key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("outer")
    )
    found = around.join(hosts.select(F.col("key").alias("outer"), F.col("host").alias("outer_host")), "outer")
    stack = F.reverse(F.array_sort(F.collect_list(F.struct(F.length("outer").alias("n"), F.col("outer").alias("key"), F.col("outer_host").alias("host")))))
    return found.groupBy("key").agg(stack.alias("stack")).select(F.split_part("key", F.lit("."), F.lit(1)).alias("slice"), "key", "stack")


def _path_pushes(rules: DataFrame) -> DataFrame:
    around = rules.select("rule_host", "rule_path", F.explode(F.sequence(F.lit(0), F.length("rule_path"))).alias("n"))
    around = around.withColumn("outer", F.col("rule_path").substr(F.lit(1), F.col("n")))
    outer = rules.select("rule_host", F.col("rule_path").alias("outer"), F.col("rule").alias("outer_rule"), F.col("rule_verdict").alias("outer_verdict"))
    entry = F.struct("n", F.col("outer").alias("key"), F.col("outer_rule").alias("rule"), F.col("outer_verdict").alias("verdict"))
    return (
        around.join(outer, ["rule_host", "outer"])
        .groupBy("rule_host", "rule_path")
        .agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("stack"))
        .select(F.col("rule_host").alias("slice"), F.col("rule_path").alias("key"), "stack")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", rows_per_salt: int = 200_000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (replacing columns of these names).

    ``rules`` has (host, path, verdict); further columns are ignored.  A rule
    fits its host and every subdomain where the URL's path starts with its
    own.  The longest rule (host and path together) wins, among equally long
    ones the longer host.  Without a rule, ``rule`` is null and ``verdict`` is
    ``default``.

    Defined cases: a null URL or one without ``://`` has an empty host and
    path and fits no rule; rules with a null or empty host fit nothing; a null
    rule path counts as empty; of rules that repeat with several verdicts,
    the last in string order ("block") holds; no rules or no pages give the
    default or no rows; repeated pages are judged alike, row by row; URLs of
    any length are judged whole.
    """
    # One domain may have nearly all rows: the salts grow with the table, the rules are repeated in each.
    salts = max(32, -(-pages.count() // rows_per_salt))
    rules = (
        rules.select(lower_az(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host <> ''")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
    )
    judged = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    urls = judged.where("host <> ''").select("host", "path").distinct()
    hosts = urls.select("host").distinct().withColumn("key", host_key(F.col("host"))).withColumn("slice", F.split_part("key", F.lit("."), F.lit(1)))
    ruled = _sweep(hosts, _host_pushes(rules), salts).where("size(stack) > 0").select("host", F.transform("stack", lambda rule: rule["host"]).alias("rule_hosts"))
    probes = urls.join(ruled, "host").select("host", "path", F.explode("rule_hosts").alias("slice"), F.col("path").alias("key"))
    best = F.get("stack", F.lit(0))
    decided = (
        _sweep(probes, _path_pushes(rules), salts)
        .where("size(stack) > 0")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(best["rule"]).alias("n"), F.length("slice").alias("host_n"), best["rule"].alias("rule"), best["verdict"].alias("verdict"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    # URLs without a host fit no rule; as null keys they are not joined.
    keyed = judged.select(F.struct(*judged.columns).alias("__page"), F.when(F.col("host") != "", F.col("host")).alias("host"), "path")
    joined = left_join_hot(keyed, decided, ["host", "path"])
    return joined.select("__page.*", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
