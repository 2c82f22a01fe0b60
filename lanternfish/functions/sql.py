"""Scalars as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lanternfish.functions import gemtext, robots, text


def register(spark: SparkSession, prefix: str = "lf_") -> list[str]:
    """Registers Python-backed scalars by Arrow batches; native ones need none, being expressions."""
    from pyspark.sql import functions as F

    made = {
        "xxh64_hex": F.pandas_udf(lambda s: s.map(lambda x: None if x is None else text.xxh64_hex(x.encode())), "string"),
        "path_matches": F.pandas_udf(lambda r, p: r.combine(p, lambda a, b: None if a is None or b is None else robots.path_matches(a, b)), "boolean"),
        "robots_rules": F.pandas_udf(lambda s: s.map(robots.disallowed), "array<string>"),
        "markup_text": F.pandas_udf(lambda s: s.map(lambda x: gemtext.extract(gemtext.parse_nodes(x))[0]), "string"),
        "markup_title": F.pandas_udf(lambda s: s.map(lambda x: gemtext.extract(gemtext.parse_nodes(x))[1]), "string"),
    }
    for name, f in made.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in made]
