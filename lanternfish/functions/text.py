"""Scalars on texts: MIME, titles, drawings, sizes, sanitising, token lists, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters that drawings are made of
GLYPHS = "☆★░█⣿⡇⢀┼╭"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def is_ascii_art(text: Column) -> Column:
    """A run of four of one ASCII character other than blanks, or a drawing's characters."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(r"([\x00-\x08\x0A-\x1f\x21-\x7f])\1{3}") | t.rlike(f"[{GLYPHS}]") | t.contains("(_-<") | t.contains("_ _ _ _")


def mime_type(meta: Column) -> Column:
    return F.btrim(F.split(F.coalesce(meta, F.lit("")), ";")[0], F.lit(" \t"))


def mime_params(meta: Column) -> Column:
    """name -> value of the parts after the first; parts without '=' are left out, the last of equal names counts."""
    parts = F.filter(F.slice(F.split(F.coalesce(meta, F.lit("")), ";"), 2, 1 << 20), lambda p: p.contains("="))
    key = lambda p: F.btrim(F.substring_index(p, "=", 1), F.lit(" \t"))
    value = lambda p: F.btrim(F.substring(p, F.instr(p, "=") + 1, F.length(p)), F.lit(" \t"))
    return F.aggregate(parts, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != key(p)), F.create_map(key(p), value(p))))


def first_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of text of at most limit bytes; a character is not cut."""
    at = lambda n: F.substring(text.cast("binary"), 1, n).cast("string")
    return F.coalesce(*[F.when(F.is_valid_utf8(at(n)), at(n)) for n in range(limit, limit - 4, -1)])


def truncate_title(title: Column, limit: int = 1000) -> Column:
    return F.when(F.octet_length(title) > limit, F.concat(first_bytes(title, limit), F.lit("..."))).otherwise(title)


def left_pad(value: Column, width: int) -> Column:
    """Blanks in front up to width; a longer value stays whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def ascii_lower(text: Column) -> Column:
    """Only A-Z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_number(hexadecimal: Column) -> Column:
    """The unsigned number of up to 16 hexadecimal digits; 0 for an empty or malformed text."""
    return F.when(hexadecimal.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(hexadecimal, 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def unsigned(text: Column) -> Column:
    """The whole text as an unsigned number, or null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def size_kb(size: Column) -> Column:
    return F.greatest(F.floor(size / 1000), F.lit(1)).cast("long")


def content_label(content_type: Column) -> Column:
    return F.when(F.coalesce(content_type, F.lit("")) == "", F.lit("unknown/none")).otherwise(content_type)


def clean_preview(text: Column) -> Column:
    return F.regexp_replace(F.btrim(F.regexp_replace(text, r"\s+", " ")), "^[`*=>#\\s]+", "")


def clean_title(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\n|\t|```", " "), "^[`*=>#\\s]+", "")


def escape_sql(text: Column) -> Column:
    """Text inside quotes of an escaped string literal: backslashes and single quotes doubled."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))


def too_binary(raw_bytes: Column, text_bytes: Column) -> Column:
    """Less than a fifth of the bytes survived decoding."""
    return text_bytes * 5 < raw_bytes


def feed_type(content_type: Column, path: Column, is_gemsub: Column) -> Column:
    return F.when(is_gemsub, "gemsub").when(path.endswith("/twtxt.txt") & content_type.startswith("text/"), "twtxt").when(content_type == "application/rss+xml", "rss").when(content_type == "application/atom+xml", "atom")


def xxh64_hex(data: bytes) -> str:
    """The 64-bit hash (seed 0) in upper-case hexadecimal, most significant digit first."""
    import xxhash

    return xxhash.xxh64_hexdigest(data).upper()


def decode_bytes(data: bytes, charset: str | None) -> str:
    """Text of bytes; undecodable ones and unknown charsets' non-ASCII ones are left out."""
    try:
        return data.decode(charset or "utf-8", errors="ignore")
    except LookupError:
        return data.decode("ascii", errors="ignore")


DATED = re.compile(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*", re.S)
