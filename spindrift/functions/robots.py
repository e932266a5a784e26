"""Column expressions for robots.txt patterns and the text they are matched on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.urls import url_parts

# Which lines count, which of them name an agent, which forbid,
# and the characters that a pattern may not pass on to the regex engine.
DIRECTIVE = r"(?id)^((dis)?allow|user-agent)[^:]*:.+"
AGENT_FIELD = r"(?i)^user-agent$"
FORBIDS = r"(?i)^dis"
METACHARACTERS = r"([\\^+?.()\[\]{}|]|\$(?!\z))"
BLANKS = " \t\n\r\0\x0b"


def trim_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def robots_target(url: Column) -> Column:
    """The part of a URL that rules are matched on; the whole URL when it has no path."""
    parts = url_parts(url)
    tail = F.concat(
        parts["path"],
        F.coalesce(F.concat(F.lit("?"), parts["query"]), F.lit("")),
        F.coalesce(F.concat(F.lit("#"), parts["fragment"]), F.lit("")),
    )
    return F.coalesce(tail, url)


def robots_regex(pattern: Column) -> Column:
    """Regex of a pattern: ``*`` is any run, a final ``$`` the end, all else literal; no start anchor."""
    escaped = F.regexp_replace(trim_blanks(pattern), METACHARACTERS, r"\\$1")
    return F.replace(escaped, F.lit("*"), F.lit(".*"))


def pattern_found(pattern: Column, target: Column) -> Column:
    """Whether a pattern occurs in a target, as its regex says, but in time that grows with their lengths only.

    The pieces between stars are looked for one after another, each as early as
    it can be; a piece before a final ``$`` has to end the target.
    """
    anchored = F.endswith(pattern, F.lit("$"))
    pieces = F.split(F.when(anchored, F.regexp_replace(pattern, r"\$\z", "")).otherwise(pattern), r"\*", -1)
    final = F.element_at(pieces, -1)
    inner = F.when(anchored, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)

    def after(at: Column, piece: Column) -> Column:
        """The place after a piece found at or after ``at``; 0 once a piece was missing."""
        found = F.position(piece, target, at)
        return F.when((at == 0) | (piece == ""), at).when(found > 0, found + F.length(piece)).otherwise(0)

    at = F.aggregate(inner, F.lit(1), after)
    ends = F.endswith(target, final) & (F.length(target) - F.length(final) + 1 >= at)
    return (at > 0) & (~anchored | ends)
