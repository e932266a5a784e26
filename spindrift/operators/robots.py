"""Robots rules: parse bodies to a rule table, and judge URLs by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindrift.functions.robots import (
    AGENT_FIELD,
    DIRECTIVE,
    FORBIDS,
    pattern_found,
    robots_regex,
    robots_target,
    trim_blanks,
)
from spindrift.functions.urls import url_host
from spindrift.operators.dims import near
from spindrift.session import cut_lineage


# What the rules of a batch's hosts may take up when they are sent to every task.
RULE_BYTES = 32 << 20


def parse_robots(robots: DataFrame) -> DataFrame:
    """Rules of every host: ``host, agent, pos, pattern, regex, rule_len, allow``.

    A rule belongs to the last agent named above it.  The window by host holds
    the lines of one robots body: the newest if a host has several, by
    ``fetched_at`` where that is known, then the last in order of its text.
    """
    order = F.struct(*[c for c in ("fetched_at", "body") if c in robots.columns])
    newest = robots.groupBy("host").agg(F.max_by("body", order).alias("body"))
    lines = newest.select("host", F.posexplode(F.split("body", "\n")).alias("pos", "raw"))
    text = F.regexp_replace(F.replace("raw", F.lit("\r"), F.lit("")), "(?s)#.*", "")
    fields = F.split("text", ":")
    parsed = (
        lines.select("host", "pos", text.alias("text"))
        .filter(F.col("text").rlike(DIRECTIVE))
        .select(
            "host",
            "pos",
            trim_blanks(F.get(fields, 0)).alias("field"),
            trim_blanks(F.get(fields, 1)).alias("pattern"),
        )
        .withColumn("is_agent", F.col("field").rlike(AGENT_FIELD))
    )
    above = W.partitionBy("host").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    agent = F.last(F.when(F.col("is_agent"), F.col("pattern")), ignorenulls=True).over(above)
    return (
        parsed.withColumn("agent", agent)
        .filter(~F.col("is_agent") & (F.col("agent") != "") & (F.col("pattern") != ""))
        .withColumn("regex", robots_regex(F.col("pattern")))
        .select(
            "host",
            "agent",
            "pos",
            "pattern",
            "regex",
            F.octet_length("regex").alias("rule_len"),
            (~F.col("field").rlike(FORBIDS)).alias("allow"),
        )
    )


def rules_by_host(rules: DataFrame, agent: str = "*") -> DataFrame:
    """One row per host with the agent's rules, strongest first; those of ``*`` if it has none.

    Strongest is the longest regex, then the later line.  A host's array is
    bounded by its robots body.
    """
    rule = F.struct("rule_len", "pos", "pattern", "regex", "allow")
    own = F.collect_list(F.when(F.col("agent") == agent, rule))
    common = F.collect_list(F.when(F.col("agent") == "*", rule))
    packed = (
        rules.filter(F.col("agent").isin(agent, "*"))
        .groupBy("host")
        .agg(own.alias("own"), common.alias("common"))
    )
    chosen = F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("common"))
    return packed.select("host", F.sort_array(chosen, asc=False).alias("rules"))


def _blocked(rules: Column, target: Column) -> Column:
    """Verdict of the strongest rule found in the target; rules after it are not tried."""

    def judge(verdict: Column, rule: Column) -> Column:
        return F.when(verdict.isNotNull(), verdict).when(pattern_found(rule["pattern"], target), ~rule["allow"])

    verdict = F.aggregate(rules, F.lit(None).cast("boolean"), judge)
    return F.coalesce(verdict, F.lit(False))


def robots_blocked(urls: DataFrame, rules: DataFrame, agent: str = "*", few: bool = False) -> DataFrame:
    """``urls`` with ``blocked``.

    The rules of a host travel as one row and are tried inside the URL's own
    row: no row per (URL, rule) pair and no aggregation afterwards.  They are
    written once, for the join to meet a plain shuffle on both sides: only then
    does Spark split the URLs of a host that has very many.
    """
    hosted = urls.withColumn("_host", url_host(F.col("url")))
    if few:
        rules = near(rules, hosted.select(F.col("_host").alias("host")), ["host"])
    packed = cut_lineage(rules_by_host(rules, agent).withColumnRenamed("host", "_host"))
    if few:
        held = F.aggregate(
            "rules", F.lit(0).cast("bigint"),
            lambda sum, rule: sum + F.octet_length(rule["pattern"]) + F.octet_length(rule["regex"]) + 32,
        )
        few = (packed.agg(F.sum(held + 64)).first()[0] or 0) <= RULE_BYTES
    return (
        hosted.withColumn("_target", robots_target(F.col("url")))
        .join(F.broadcast(packed) if few else packed, "_host", "left")
        .withColumn("blocked", _blocked(F.col("rules"), F.col("_target")))
        .drop("_host", "_target", "rules")
    )
