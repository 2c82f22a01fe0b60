"""robots.txt: rules for a set of agents, and paths matched against rules with wildcards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = re.compile(r"[ \t]*(.*):[ \t]*(.*)")  # greedy: split at the last colon


def disallowed(text: str | None, agents: tuple[str, ...] = ("*", "indexer")) -> list[str]:
    """Sorted distinct Disallow rules that hold for any of agents. Lines before any agent hold for all; agents that follow each other share their rules; an empty Disallow takes back what was said before."""
    rules: set[str] = set()
    applies, naming = True, False
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        m = _LINE.fullmatch(line)
        if not m:
            continue
        key, value = m[1].strip(" \t").lower(), m[2].strip(" \t")
        if key == "user-agent":
            applies = (naming and applies) or value in agents
            naming = True
            continue
        naming = False
        if key == "disallow" and applies:
            if value:
                rules.add(value)
            else:
                rules.clear()
    return sorted(rules)


def path_matches(rule: str, path: str) -> bool:
    stars = rule.count("*")
    if not rule:
        return False
    if not stars:
        child = len(path) > len(rule) + 1 and path.startswith(rule) and (path[len(rule)] == "/" or rule[-1] == "/")
        return path in (rule, rule + "/") or child
    if rule[-1] == "$" and rule.startswith(("*", "/*")):
        rule = rule[:-1]
    head, _, tail = rule.partition("*")
    if stars == 2 and rule[-1] == "*" and head in ("", "/"):
        return tail[:-1] in path
    if stars == 1:
        if head in ("", "/"):
            return path.endswith(tail)
        # a tail that is absent counts as found, as is a tail anywhere after the head
        at = path.rfind(tail)
        return path.startswith(head) and (not tail or at == -1 or at > len(head))
    try:
        return re.fullmatch("".join(".*" if c == "*" else re.escape(c) if c in "\\.+()[]{}|" else c for c in rule), path) is not None
    except re.error:
        return False


def plain_rule_blocks(path: Column, rule: Column) -> Column:
    """path_matches for rules without a star, as an expression."""
    child = (F.length(path) > F.length(rule) + 1) & F.startswith(path, rule) & ((F.substring(path, F.length(rule) + 1, F.lit(1)) == "/") | rule.endswith("/"))
    return (rule != "") & ((path == rule) | (path == F.concat(rule, F.lit("/"))) | child)


def rule_blocks(path: Column, rule: Column) -> Column:
    """path_matches as a column: rules without stars natively, others by Arrow batches."""

    @F.pandas_udf("boolean")
    def starred(p, r):
        return p.combine(r, lambda a, b: bool(a is not None and b is not None and "*" in b and path_matches(b, a)))

    return F.when(rule.contains("*"), starred(path, F.when(rule.contains("*"), rule))).otherwise(plain_rule_blocks(path, rule))


def robots_rules(text: Column, agents: tuple[str, ...] = ("*", "indexer")) -> Column:
    @F.pandas_udf("array<string>")
    def rules(s):
        return s.map(lambda x: disallowed(x, agents))

    return rules(text)

