"""URL values as struct columns: parse, normalise, compose, format; all native expressions.

A struct has protocol, host, port (null: none given), path, param, fragment and good. Hosts end at ':' or '/', so '?' and '#' can be part
of a host; a port takes the digits that its text begins with; paths are normalised by segments and keep a trailing slash; a null or
malformed text gives good = false. The default port is that of the lower-cased protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: default ports
DEFAULT_PORTS = {"http": 80, "https": 443, "gemini": 1965, "gopher": 70, "ftp": 21}


def normal_path(path: Column) -> Column:
    """Empty and '.' segments go, '..' takes the segment before it away and stops at the root."""
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    stack = F.aggregate(kept, none, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    joined = F.array_join(stack, "/")
    return F.when(joined == "", F.lit("/")).otherwise(F.concat(F.lit("/"), joined, F.when(path.rlike(r"/\.{0,2}$"), F.lit("/")).otherwise(F.lit(""))))


def default_port(protocol: Column) -> Column:
    out = F.lit(0)
    for k, v in DEFAULT_PORTS.items():
        out = F.when(protocol == k, v).otherwise(out)
    return out


# protocol, host, port text, path, parameter, fragment
_URL = r"(?s)^(?:([A-Za-z0-9]+):)?//([^.:/][^:/]*)(?::([^/]*))?((?:/[^?#]*)?)(?:\?([^#]*))?(?:#(.*))?$"


def parse_url(u: Column) -> Column:
    u = F.coalesce(u, F.lit(""))
    part = lambda k: F.regexp_extract(u, _URL, k)
    has_port = u.rlike(r"^(?:[A-Za-z0-9]+:)?//[^:/]+:")
    port = F.regexp_extract(part(3), r"^\s*\+?([0-9]+)", 1).try_cast("int")
    good = u.rlike(_URL) & (~has_port | F.coalesce(port.between(1, 65535), F.lit(False)))
    # named_struct keeps its names beside generators, where aliases are trimmed
    return F.named_struct(
        F.lit("protocol"), F.lower(part(1)),
        F.lit("host"), F.lower(part(2)),
        F.lit("port"), F.when(has_port, port),
        F.lit("path"), normal_path(part(4)),
        F.lit("param"), part(5),
        F.lit("fragment"), part(6),
        F.lit("good"), good,
    )


def with_url(df: DataFrame, url: Column | str, name: str) -> DataFrame:
    """df with the struct of url. The array of one keeps the optimizer from copying the parser into each use of the struct's fields."""
    return df.withColumn(name, F.explode(F.array(parse_url(F.col(url) if isinstance(url, str) else url))))


def url_port(u: Column) -> Column:
    """The port given, else the protocol's default, else 0."""
    return F.coalesce(u["port"], default_port(u["protocol"]))


def format_url(u: Column) -> Column:
    shown = F.when(u["port"].isNotNull() & (u["port"] != default_port(u["protocol"])), F.concat(F.lit(":"), u["port"].cast("string"))).otherwise(F.lit(""))
    mark = lambda c, m: F.when(c != "", F.concat(F.lit(m), c)).otherwise(F.lit(""))
    return F.concat(u["protocol"], F.lit("://"), u["host"], shown, u["path"], mark(u["param"], "?"), mark(u["fragment"], "#"))


def compose_link(base: Column, ref: Column) -> Column:
    """The URL struct of ref as a link on the page of the struct base."""
    path, param, fragment = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(ref, r"(?s)^[^#]*#(.*)$", 1)
    folder = F.regexp_extract(base["path"], r"^(.*/)[^/]*$", 1)
    full = F.when(ref.startswith("/"), path).when(path == "", base["path"]).otherwise(F.concat(folder, path))
    return F.named_struct(F.lit("protocol"), base["protocol"], F.lit("host"), base["host"], F.lit("port"), base["port"], F.lit("path"), normal_path(full), F.lit("param"), param, F.lit("fragment"), fragment, F.lit("good"), base["good"])


def resolve_link(base: Column, ref: Column) -> Column:
    """An absolute ref as it is, '//host' with the base's protocol, anything else composed with the base."""
    own = parse_url(ref)
    with_protocol = own.withField("protocol", F.when(own["protocol"] == "", base["protocol"]).otherwise(own["protocol"]))
    return F.when(own["good"], with_protocol).otherwise(compose_link(base, ref))


def is_non_uri_action(text: Column) -> Column:
    """mailto: and the like: letters, then a colon, without '://'."""
    return ~text.contains("://") & text.rlike("^[A-Za-z]*:")


def index_friendly(url: Column) -> Column:
    return F.translate(url, "_-~", "   ")


def encode_query(text: Column) -> Column:
    """Percent-encoding with '+' for a space; letters, digits and -_.~ stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1f]")


def cross_site(host: Column, port: Column, to_host: Column, to_port: Column) -> Column:
    return (host != to_host) | (port != to_port)
