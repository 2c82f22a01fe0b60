"""PII surrogates: detected entities get keyed replacements of the same type, script, gender and format.

An entity is (type, norm): the norm drops what formats differ in (case of e-mail addresses and names, separators of numbers), so all
mentions of one value, in whatever format, get one surrogate (coreference), rendered like each mention: separators, letter case and
alphabet of keys stay, card numbers keep a valid check digit, addresses stay addresses, and names stay in their script and, where a
title tells, gender. A phone number keeps its country code; with and without one it is two entities. The surrogate of a norm is drawn
by a keyed hash of (type, norm, attempt). The key is the caller's; without one, a random key is drawn for the process, so that nobody
can rebuild the mapping, and another process draws other surrogates.

Texts are searched once; the rows with their mentions are a written table. Collision checks hold the distinct entities of all rows, by a
distributed group by of the surrogate: of entities that share one, or whose surrogate is another entity's real value, all but the
smallest norm draw again with the next attempt, until all are distinct. Names get longer with the attempt, so there are always
enough. Attempts above 0 are a table joined to their rows; all others are computed on the spot.

Types: email, phone, ip (both versions), card (Luhn-valid), ssn, iban (valid check number), secret (after a key word), key (by its
prefix), name (after a title).

Defined results: null text stays null, with no entities; an entity is replaced wherever it is found, in very long texts too; repeated
rows and rows without doc_id are treated like others, each returned; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import common as C

@functools.cache
def own_key() -> bytes:
    return secrets.token_bytes(32)


# what may stand between the parts of a number: blanks, marks, column lines
GAP = r"[^\w\n]{0,5}"
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία"), "n": ("Dr", "Prof", "Doktor", "Doctor", "доктор")}
GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?i:token|secret|api[_-]?key|password)[^\w\n]{1,8}[\"'](?P<secret_value>[A-Za-z0-9_\-]{16,128})[\"']",
    "key": r"(?<![\w-])(?P<key_prefix>AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk-)(?P<key_value>[A-Za-z0-9_-]{16,128})(?![\w-])",
    "phone": rf"\+(?P<phone_code>\d{{1,3}}){GAP}\(?\d{{3}}\)?{GAP}\d{{3}}[-. ]?\d{{4}}(?!\w)|(?<![\w+.-])(?:\(\d{{3}}\) ?|\d{{3}}[-.])\d{{3}}[-.]\d{{4}}(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)){1,7}(?::|(?::?[0-9A-Fa-f]{1,4}){1,7})(?![\w:]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"\b(?P<name_title>{_TITLE})\.? (?P<name_value>(?:[^\W\d_a-z]\. ?){{0,3}}[^\W\d_a-z][^\W\d_]+(?: [^\W\d_a-z][^\W\d_]+)?)",
}
# text without any of these has no entity; quick to look for
_NEED = re.compile(r"@|\d\d|::|[0-9A-Fa-f]:[0-9A-Fa-f]|AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk-|(?i:token|secret|key|password)|\b(?:" + _TITLE + r")\b")
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_SYLLABLES = {
    "LATIN": (["ba", "de", "fi", "go", "ha", "ka", "le", "mi", "no", "ra", "so", "ta", "ve", "zo"], {"m": ["n", "r", "s"], "f": ["a", "ia"], "n": ["el", "y"]}),
    "CYRILLIC": (["ба", "ве", "ди", "жо", "ка", "ле", "ми", "но", "ра", "со", "та"], {"m": ["н", "р"], "f": ["а", "ия"], "n": ["о"]}),
    "GREEK": (["βα", "δε", "κα", "λε", "μι", "νο", "ρα", "σο", "τα"], {"m": ["ς"], "f": ["α", "η"], "n": ["ο"]}),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        k = int(c) * (1 + i % 2)
        total += k - 9 * (k > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def card_within(value: str, at: int) -> tuple[int, int]:
    """Span of the longest run of whole digit groups in value, which begins at at, that is a valid card; (at, at) if there is none."""
    groups = [g.span() for g in re.finditer(r"\d+", value)]
    runs = [(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:]]
    for a, b in sorted(runs, key=lambda r: r[0] - r[1]):
        digits = re.sub(r"\D", "", value[a:b])
        if 13 <= len(digits) <= 19 and luhn(digits):
            return at + a, at + b
    return at, at


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, norm) of each entity, in order, without overlaps."""
    out = []
    if not text or not _NEED.search(text):
        return out
    at = 0
    while m := _ANY.search(text, at):
        kind, (start, end) = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m[k] is not None), m.span()
        value = m[0]
        at = end
        if kind == "email":
            norm = value.lower()
        elif kind == "secret":
            start, end = m.span("secret_value")
            norm = m["secret_value"].lower()
        elif kind == "key":
            norm = m["key_prefix"] + ":" + m["key_value"]
        elif kind == "ip6":
            try:
                norm = ipaddress.IPv6Address(value).exploded if any(c.isdigit() for c in value) else ""  # names of code are joined by colons, too
            except ValueError:
                norm = ""
            if not norm:
                at = m.start() + 1
                continue
            kind = "ip"
        elif kind == "phone":
            code = m["phone_code"] or ""
            norm = code + ":" + re.sub(r"\D", "", value)[len(code) :]
        elif kind == "name":
            start, end = m.span("name_value")
            norm = GENDER[m["name_title"].lower()] + ":" + re.split(r"[ .]", m["name_value"])[-1].casefold()
        elif kind == "iban":
            norm = value.replace(" ", "")
            if not 15 <= len(norm) <= 34 or _mod97(norm) != 1:
                at = m.start() + 1
                continue
        else:
            norm = re.sub(r"\D", "", value) if kind != "ip" else ".".join(str(int(x)) for x in value.split("."))
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind == "card" and not luhn(norm):
                start, end = card_within(value, start)
                if start == end:
                    # a card may begin in this match and end after it
                    at = m.start() + value.index(" ") + 1 if " " in value else at
                    continue
                norm, at = re.sub(r"\D", "", text[start:end]), end
        out.append((start, end, kind, norm))
    return out


class _Draw:
    """A stream of keyed numbers."""

    def __init__(self, key: bytes, *what: str):
        self.seed, self.n, self.pool = hashlib.blake2b("\x1f".join(what).encode(), key=key, digest_size=32).digest(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.n += 1
            self.pool = self.pool << 256 | int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), digest_size=32).digest(), "big")
        self.pool, out = divmod(self.pool, n)
        return out


def _like(c: str, draw: _Draw) -> str:
    if c.isdigit():
        return str(draw.below(10))
    return chr(97 + draw.below(26)) if c.isalpha() else c


def script(text: str) -> str:
    first = unicodedata.name(next((c for c in text if c.isalpha()), "a"), "LATIN").split()[0]
    return first if first in _SYLLABLES else "LATIN"


def _same(c: str, draw: _Draw) -> str:
    """Another character of the kind of c."""
    return str(draw.below(10)) if c.isdigit() else chr((65 if c.isupper() else 97) + draw.below(26)) if c.isalpha() else c


def core(kind: str, norm: str, attempt: int = 0, key: bytes | None = None) -> str:
    """The surrogate's norm: of the same type and never the norm itself."""
    key = key or own_key()
    while True:
        draw = _Draw(key, kind, norm, str(attempt))
        if kind == "email":
            local, _, domain = norm.partition("@")
            *labels, tld = domain.split(".")
            out = "".join(_like(c, draw) for c in local) + "@" + ".".join("".join(_like(c, draw) for c in x) for x in labels) + "." + tld
        elif kind == "ip" and ":" in norm:
            out = ":".join(["2001", "0db8", *(f"{draw.below(1 << 16):04x}" for _ in range(6))])
        elif kind == "key":
            prefix, _, value = norm.partition(":")
            out = prefix + ":" + "".join(_same(c, draw) for c in value)
        elif kind == "phone":
            code, _, value = norm.partition(":")
            out = code + ":" + "".join(_like(c, draw) for c in value)
        elif kind == "ip":
            out = ".".join([str(1 + draw.below(223)), str(draw.below(256)), str(draw.below(256)), str(1 + draw.below(254))])
        elif kind == "card":
            out = norm[0] + "".join(str(draw.below(10)) for _ in norm[2:])
            out += next(d for d in "0123456789" if luhn(out + d))
        elif kind == "iban":
            out = norm[:2] + "00" + "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in norm[4:])
            out = out[:2] + f"{98 - _mod97(out):02d}" + out[4:]
        elif kind == "secret":
            hexed = all(c in "0123456789abcdef-_" for c in norm)
            out = "".join("0123456789abcdef"[draw.below(16)] if hexed and c.isalnum() else _like(c, draw) for c in norm)
        elif kind == "name":
            gender, _, name = norm.partition(":")
            parts, ends = _SYLLABLES[script(name)]
            out = gender + ":" + "".join(parts[draw.below(len(parts))] for _ in range(3 + draw.below(3) + min(attempt % (1 << 20), 60) // 2)) + ends[gender][draw.below(len(ends[gender]))]
        else:
            out = "".join(_like(c, draw) for c in norm)
        if out != norm:
            return out
        attempt += 1 << 20


def render(kind: str, mention: str, surrogate: str, key: bytes | None = None) -> str:
    """The surrogate's norm in the format of the mention."""
    if kind == "name":
        name = surrogate.partition(":")[2]
        words = re.findall(r"[^ .]+", mention)
        # a first name before the last one is drawn for the pair, so it stays with it
        new = [*(core("name", surrogate[:2] + w.casefold() + "\x1f" + name, 0, key)[2:] for w in words[:-1]), name]
        new = iter([x[0].upper() if len(w) == 1 else x.upper() if w.isupper() else x.capitalize() for x, w in zip(new, words)])
        return re.sub(r"[^ .]+", lambda _: next(new), mention)
    if kind == "ip":
        if ":" not in surrogate:
            return surrogate
        out = surrogate if len(mention) == 39 else ipaddress.IPv6Address(surrogate).compressed
        return out.upper() if any(c.isupper() for c in mention) else out
    if kind == "key":
        return surrogate.replace(":", "", 1)
    if kind in ("email", "secret", "iban"):
        rest = iter(surrogate)
        same = [c if kind == "iban" and c == " " else next(rest) for c in mention]
        return "".join(x.upper() if c.isupper() else x for x, c in zip(same, mention))
    surrogate = surrogate.partition(":")[2] if kind == "phone" else surrogate
    digits, rest = re.sub(r"\D", "", mention), iter(surrogate)
    lead = len(digits) - len(surrogate)  # a country code stays
    return "".join(c if not c.isdigit() or (lead := lead - 1) >= 0 else next(rest) for c in mention)


_FOUND = "struct<start:int,end:int,type:string,norm:string>"


def mentions_of(docs: DataFrame) -> DataFrame:
    """(row: a number of its own, doc_id, text, found: array of struct<start, end, type, norm>) of each row. Write it: numbers are told anew by each scan."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("norm", pa.string())])
        for batch in batches:
            found = [[dict(zip(("start", "end", "type", "norm"), x)) for x in mentions(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(span))], names=["row", "doc_id", "text", "found"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(find, f"row long, doc_id long, text string, found array<{_FOUND}>")


def attempts(found: DataFrame, key: bytes | None = None) -> DataFrame:
    """(type, norm, attempt) of the entities of found (type, norm) whose attempt is above 0, as a written table, so that surrogates are distinct and nobody's real value."""
    key = key or own_key()

    @F.pandas_udf("string")
    def draw(kind, norm, attempt):
        return kind.combine(norm, lambda k, n: (k, n)).combine(attempt, lambda x, a: core(*x, int(a), key))

    with C.Scratch() as scratch:
        real = scratch.keep(found.select("type", "norm").distinct(), "entities")
        state = scratch.keep(real.withColumn("attempt", F.lit(0)).withColumn("core", draw("type", "norm", "attempt")), "surrogates")
        while True:
            first = state.groupBy("type", "core").agg(F.min("norm").alias("_first"), F.count("*").alias("_n"))
            # a surrogate that is a real value, or shared and not the first norm's
            taken = first.join(real.select("type", F.col("norm").alias("core"), F.lit(True).alias("_real")), ["type", "core"], "left").where("_n > 1 or _real")
            taken = scratch.keep(taken, "taken")
            if taken.isEmpty():
                return C.materialize(state.where("attempt > 0").select("type", "norm", "attempt"), "attempts")
            judged = state.join(taken, ["type", "core"], "left").withColumn("_again", F.coalesce((F.col("_real") & F.lit(True)) | (F.col("norm") != F.col("_first")), F.lit(False)))
            nexts = judged.select("type", "norm", (F.col("attempt") + F.col("_again").cast("int")).alias("attempt"), F.when(~F.col("_again"), F.col("core")).alias("core"))
            redrawn = nexts.where("core is null").withColumn("core", draw("type", "norm", "attempt"))
            old, state = state, scratch.keep(nexts.where("core is not null").unionByName(redrawn), "surrogates")
            scratch.drop(old, taken)


_RESULT = "n_entities int, types array<string>, replaced array<struct<start:int,end:int,type:string,surrogate:string>>, text string"


def pseudonymize(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """(doc_id, n_entities, types, replaced: place in the old text, type and surrogate, text) of each row."""
    key = key or own_key()
    with C.text_batches(docs.sparkSession), C.Scratch() as scratch:
        rows = C.materialize(mentions_of(docs), "mentions")  # the result reads its rows without entities from here
        hit = rows.where(F.size("found") > 0)
        one = hit.select("row", F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["type"].alias("type"), x["norm"].alias("norm"))))).alias("x")).select("row", "x.*")
        again = scratch.own(attempts(one, key))
        per = one.join(again, ["type", "norm"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "type", "norm"), "attempt"))).alias("again"))
        per = scratch.keep(per, "attempts-by-row")  # of a known size, so it is broadcast only if small

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for t, found, again in zip(batch.column("text"), batch.column("found").to_pylist(), batch.column("again").to_pylist()):
                    t, tries = t.as_py(), dict(again or ())
                    spans, parts, at = [], [], 0
                    for x in found:
                        kind, norm, start, end = x["type"], x["norm"], x["start"], x["end"]
                        new = render(kind, t[start:end], core(kind, norm, tries.get(f"{kind}\x1f{norm}", 0), key), key)
                        spans.append({"start": start, "end": end, "type": kind, "surrogate": new})
                        parts += [t[at:start], new]
                        at = end
                    out.append((len(spans), sorted({x["type"] for x in spans}), spans, "".join(parts) + t[at:]))
                cols = list(zip(*out)) or [[]] * 4
                span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("surrogate", pa.string())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.list_(span)), pa.array(cols[3], pa.string())], names=["doc_id", "n_entities", "types", "replaced", "text"])

        done = C.materialize(hit.join(per, "row", "left").select("doc_id", "text", "found", "again").mapInArrow(replace, "doc_id long, " + _RESULT), "replaced")
    none = {x.split(" ")[0]: x.split(" ", 1)[1] for x in _RESULT.split(", ")}
    clean = rows.where(F.size("found") == 0).select("doc_id", F.lit(0).alias("n_entities"), F.array().cast(none["types"]).alias("types"), F.array().cast(none["replaced"]).alias("replaced"), "text")
    return done.unionByName(clean)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key that the session names in lanternfish.surrogate.key, if any."""
    key = spark.conf.get("lanternfish.surrogate.key", None)
    return pseudonymize(C.read(spark, sf_dir, "documents"), key.encode()[:64] if key else None)
