"""Crawl policy: blocked hosts and URL prefixes, built-in rules, robots rules, and what may be crawled."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import robots as R
from lanternfish.functions import text as X
from lanternfish.functions import urls as U

# fixed values: hosts that are never crawled
BLOCKED_HOSTS = (
    "example.com", "example.org", "example.net", "example.io", "example.us", "example.eu", "example.gov", "example.space",
    "localhost", "[::1]", "localhost.localdomain",
    "gus.guru", "ftrv.se", "git.thebackupbox.net", "mikelynch.org", "campaignwiki.org",
)
# fixed values: ends and parts of what is not worth a crawl
LOCAL_ENDS = (".local", ".localhost", ".localdomain")
WEBRING_ENDS = ("/next.cgi", "/prev.cgi", "/rand.cgi", "/next", "/prev", "/rand", "/next.gmi", "/prev.gmi", "/rand.gmi")
PARTS = (".git/tree/", ".git/blob/", "/~xkcd/", "/xkcd/", "gopher:/:/", "rfc-mirror")
FILES = ("/robots.txt", "/favicon.txt")


def repeats_parts(path: Column) -> Column:
    """A part of the path, the root counted as one, comes three times or more."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return (F.size(parts) >= 3) & (F.size(F.filter(F.array_distinct(parts), lambda p: F.size(F.filter(parts, lambda x: x == p)) >= 3)) > 0)


def is_commit(url: Column) -> Column:
    return url.rlike(r"(?s)^((?!commits/).)*commits/[a-z0-9A-Z]+[/.]")


def built_in(url: Column, host: Column, path: Column) -> Column:
    """What the built-in rules block."""
    rules = [host.isin(*BLOCKED_HOSTS), path.isin(*FILES), host.startswith("127.0.0."), *[host.endswith(x) for x in LOCAL_ENDS], path.startswith("/git/"), host.startswith("git."), url.endswith("/git.sh")]
    rules += [url.contains(x) for x in PARTS] + [path.endswith(x) for x in WEBRING_ENDS] + [host.endswith(".onion"), U.has_control(url), repeats_parts(path), is_commit(url)]
    return reduce(or_, rules)


def prefix_rules(urls: DataFrame) -> DataFrame:
    """(origin, rule) of url rules: the URL without path, parameter and fragment, and its path; a parameter is dropped."""
    u = U.with_url(urls, "url", "u").where("u.good")
    return u.select(origin(F.col("u")).alias("origin"), F.col("u.path").alias("rule")).distinct()


def origin(u: Column) -> Column:
    return F.concat(u["protocol"], F.lit("://"), u["host"], F.lit(":"), U.url_port(u).cast("string"))


def blocked_by_prefix(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of urls (url) under a rule of the same origin. Rules are written by hand, so Spark broadcasts them while they are small."""
    u = U.with_url(urls, "url", "_u")
    hit = u.withColumn("origin", origin(F.col("_u"))).join(rules, "origin").where(R.rule_blocks(F.col("_u.path"), F.col("rule")))
    return hit.select("url").distinct()


def blocked_by_robots(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """url of rows (url, host, port, path) that a rule of their host and port blocks."""
    return urls.join(policies, ["host", "port"]).where(R.rule_blocks(F.col("path"), F.col("disallowed"))).select("url").distinct()


ROBOTS_FRESH = "INTERVAL 2 DAYS"
ROBOTS_TYPES = ("text/plain", "text/gemini")


def is_robots(url: Column) -> Column:
    return U.parse_url(url)["path"] == "/robots.txt"


def robots_urls(urls: DataFrame, status: DataFrame, now: Column, protocol: str = "gemini") -> DataFrame:
    """url of the robots file of each host and port of urls (url) that has no fresh status."""
    u = U.with_url(urls.select("url"), "url", "u").where(F.col("u.good") & (F.col("u.protocol") == protocol)).select(F.col("u.host").alias("host"), U.url_port(F.col("u")).alias("port")).distinct()
    due = u.join(fresh_status(status, now), ["host", "port"], "left_anti")
    shown = F.when(F.col("port") == U.DEFAULT_PORTS[protocol], F.lit("")).otherwise(F.concat(F.lit(":"), F.col("port").cast("string")))
    return due.select(F.concat(F.lit(f"{protocol}://"), F.col("host"), shown, F.lit("/robots.txt")).alias("url"))


def fresh_status(status: DataFrame, now: Column) -> DataFrame:
    return status.where(F.col("last_crawled_at") > now - F.expr(ROBOTS_FRESH))


def fresh_policies(policies: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """The rules of hosts whose status is fresh and says that they have any."""
    return policies.join(fresh_status(status, now).where("have_policy").select("host", "port"), ["host", "port"], "left_semi")


def update_robots(policies: DataFrame, status: DataFrame, responses: DataFrame, now: Column, agents: tuple[str, ...] = ("*", "indexer")) -> tuple[DataFrame, DataFrame]:
    """(robot_policies, robot_policies_status) after the robots files among responses, the latest of each host: all rules of a host are replaced at once, and its status is set.

    A file counts if it came with status 20 as plain text or line markup; a host without one has no rules, and a status that says so.
    """
    u = F.col("_u")
    got = U.with_url(responses, "url", "_u").where(u["path"] == "/robots.txt").select(u["host"].alias("host"), U.url_port(u).alias("port"), ((F.col("status") == 20) & X.mime_type(F.col("meta")).isin(*ROBOTS_TYPES)).alias("have_policy"), "body", "fetched_at")
    last = got.groupBy("host", "port").agg(F.max_by(F.struct(F.coalesce("have_policy", F.lit(False)).alias("have_policy"), "body"), F.struct("fetched_at", "body")).alias("v")).select("host", "port", "v.*")
    rules = last.where("have_policy").select("host", "port", F.explode(R.robots_rules(F.make_valid_utf8(F.col("body").cast("string")), agents)).alias("disallowed"))
    hosts = last.select("host", "port")
    news = last.select("host", "port", now.alias("last_crawled_at"), "have_policy")
    return policies.join(hosts, ["host", "port"], "left_anti").unionByName(rules).select(*policies.columns), status.join(hosts, ["host", "port"], "left_anti").unionByName(news).select(*status.columns)


def host_timeouts(log: DataFrame, over: int = 3) -> DataFrame:
    """(host, port, n) of hosts with more than over failed fetches; log has host, port, failed."""
    return log.groupBy("host", "port").agg(F.count(F.when(F.col("failed"), 1)).alias("n")).where(F.col("n") > over)


def should_crawl(urls: DataFrame, rules: DataFrame, policies: DataFrame, timeouts: DataFrame, protocols: tuple[str, ...] = ("gemini",)) -> DataFrame:
    """The rows of urls (url) that may be crawled: good, of an accepted protocol, not blocked, of a host that answers, allowed by robots rules."""
    u = U.with_url(urls, "url", "_u")
    u = u.where(F.col("_u.good") & F.col("_u.protocol").isin(*protocols)).withColumns({"host": F.col("_u.host"), "port": U.url_port(F.col("_u")), "path": F.col("_u.path")})
    u = u.where(~built_in(F.col("url"), F.col("host"), F.col("path")))
    u = u.join(timeouts.select("host", "port"), ["host", "port"], "left_anti")
    u = u.join(blocked_by_prefix(u.select("url"), rules), "url", "left_anti")
    return u.join(blocked_by_robots(u.select("url", "host", "port", "path"), policies), "url", "left_anti").select(*urls.columns)
