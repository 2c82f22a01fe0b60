import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import op01_quality as q1
from lanternfish.llm import op02_lines as q2
from lanternfish.llm import op03_jaccard as q3
from lanternfish.llm import op04_toxicity as q4
from lanternfish.llm import op05_shards as q5
from lanternfish.llm import op06_pack as q6
from lanternfish.llm import op07_media as q7
from lanternfish.llm import op08_counts as q8
from lanternfish.llm import op09_pii as q9
from lanternfish.llm import op10_mix as q10
from lanternfish.llm import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


# 1


def test_base_counts(docs, clashing, rows, nothing):
    got = sorted(map(repr, q1.features(docs).collect()))
    assert len(got) == len(rows) and got == sorted(map(repr, q1.features(clashing).collect()))
    by = defaultdict(list)
    for r in q1.features(docs).collect():
        by[r["doc_id"]].append(r)
    for doc, t, *_ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        win = Counter(zip(w, w[1:], w[2:]))
        covered = {i + o for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for o in range(3)}
        expect = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert expect in [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in by[doc]]
    assert q1.features(nothing).count() == 0


def test_exact_binomial(spark):
    d = spark.createDataFrame([(k, n) for n in (1, 20, 900) for k in (0, 1, 3, 10) if k <= n], "k long, n long")
    for r in d.withColumn("lp", q1.log_cdf("k", "n", 0.02)).collect():
        exact = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["lp"] == 0 if r["k"] >= r["n"] * 0.02 else r["lp"] == pytest.approx(math.log(exact), rel=1e-9)


def test_thresholds_hold_back(spark, labels):
    make = lambda n, bad: spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"), F.when(F.col("id") < bad, 250).otherwise(0).cast("long").alias("n_symbols"), *[F.lit(0).cast("long").alias(c) for c in ("n_word_lines", "n_dup_lines", "n_shouts", "n_repeat_words")])
    good = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert q1.thresholds(make(5000, 0), good).first()["cut_symbol_share"] == 1
    assert q1.thresholds(make(5000, 500), good).first()["cut_symbol_share"] is None  # a tenth of the good ones is above all cutoffs
    few = q1.thresholds(make(30, 0), good).collect()
    assert not few or few[0]["cut_symbol_share"] is None


def test_quality_filter(docs, clashing, labels, nothing):
    assert q1.filter_documents(clashing, labels).columns == clashing.columns
    assert q1.filter_documents(nothing, labels).count() == 0
    assert q1.filter_documents(docs, labels).count() <= docs.count()


def test_small_strata_reject(spark, docs):
    text = lambda i, mark: " ".join(f"w{i}x{k}{mark}" for k in range(60))
    good = [(i, text(i, ""), lang, "a", 1) for i, lang in enumerate(["en"] * 300 + ["de"] * 300 + ["fr"] * 300 + ["es"] * 100)]
    bad = [(5000 + i, text(i, "##"), lang, "a", 1) for i, lang in enumerate(["en", "de", "fr", "es", "it"])]  # es has few labels, it has none
    labels = spark.createDataFrame([(r[0], 1) for r in good], "doc_id long, quality int")
    kept = {r["doc_id"] for r in q1.filter_documents(spark.createDataFrame([*good, *bad], docs.schema), labels).collect()}
    assert kept == {r[0] for r in good}
    cuts = {r["stratum"]: r["last"] for r in q1.joint_cuts(q1.features(spark.createDataFrame(good, docs.schema)), labels).collect()}
    assert set(cuts) == {"en", "de", "fr", None} and cuts[None] > 0


# 2


def line_drops(rows):
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(q2.UPPER, q2.LOWER))
    for d, t, *_ in rows:
        if d is not None and t is not None:
            for x in t.split("\n"):
                held[key(x)].add(d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < 10 or d <= min(held[key(x)], default=d)]
        out.append((d, "\n".join(keep), len(lines) - len(keep)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_line_dedup(spark, docs, clashing, rows, nothing, partitions):
    more = spark.createDataFrame([(200 + i, f"Shared line of text\n{i}\n SHARED LINE OF TEXT\t\nother", "en", "a", 1) for i in range(40)], docs.schema)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for base, extra in ((docs, []), (docs.union(more), more.collect())):
            got = q2.dedup_lines(base, "gone").select("doc_id", F.coalesce("text", F.lit("")), "gone").collect()
            assert sorted(repr(tuple(r)) for r in got) == line_drops([*rows, *extra])
        assert q2.dedup_lines(clashing).columns == clashing.columns and q2.dedup_lines(nothing).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


# 3


def jaccard_components(rows):
    sets = {}
    for d, t, *_ in rows:
        w = [x.translate(str.maketrans(q2.UPPER, q2.LOWER)) for x in words(t)]
        if d is not None:
            sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard(spark, docs, clashing, rows, nothing):
    base = " ".join(f"w{i}" for i in range(120))
    cluster = []
    for i in range(60):  # a chain of edits: neighbours are near, ends are not
        w = base.split()
        for k in range(i // 4):
            w[(k * 11) % 120] = f"e{k}"
        w[(i * 7) % 120] = f"x{i % 9}"
        cluster.append((300 + i, " ".join(w), "en", "a", 1))
    both = docs.union(spark.createDataFrame(cluster, docs.schema))
    expect = jaccard_components([*rows, *cluster])
    got = q3.jaccard_components(both).collect()
    assert len(got) == len(rows) + len(cluster)
    assert all(expect[r["doc_id"]] == (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    kept = q3.near_duplicates(clashing)
    assert kept.columns == clashing.columns and q3.near_duplicates(nothing).count() == 0 and q3.jaccard_components(nothing).count() == 0


def test_joining_links_are_named_so(spark, docs):
    base = [f"w{i}" for i in range(200)]
    copies = [(i, " ".join([*base[:100], f"x{i}", *base[101:]]), "en", "a", 1) for i in range(8)]
    got = q3.jaccard_components(spark.createDataFrame(copies, docs.schema)).collect()
    assert {"class_id", "n_joining_links"} <= set(got[0].asDict()) and "n_links" not in got[0].asDict()
    assert {r["component_id"] for r in got} == {0} and all(1 <= r["n_joining_links"] <= 7 for r in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["comp"] for r in q3.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[101] == got[100] == 100


# 4


def test_ordinal_model():
    rng = np.random.default_rng(1)
    texts = ["calm words here " * 10 + "vile " * int(k) for k in rng.integers(0, 8, 400)]
    n = np.array([t.count("vile") for t in texts])
    xs = [q4.vector(t) for t in texts]
    grades = np.digitize(n, [1, 4, 7])
    m = q4.fit_ordinal(xs, grades)
    e = m.severity(np.array([m.score(t) for t in texts]))
    assert (np.diff(m.cuts) > 0).all() and np.abs(e - grades).mean() < 0.3 and np.corrcoef(e, n)[0, 1] > 0.9


def test_toxicity(spark, docs, clashing, labels, nothing):
    m = q4.fit(docs, labels)
    got = q4.severities(clashing, m)
    assert got.count() == docs.count() and got.where("severity < 0 or severity > 3 or severity is null").count() == 0
    none = q4.fit(docs, labels.where("toxic = 0"))
    assert q4.severities(docs, none).where("is_toxic or severity <> 0").count() == 0
    assert q4.severities(nothing, m).count() == 0 and q4.fit(nothing, labels).limit == float("inf")


# 5


def test_permutation(spark):
    for n in (1, 2, 3, 5, 24, 97, 1000, 20011):
        p = [r["p"] for r in spark.range(n).select(q5.permuted("id", n).alias("p")).collect()]
        assert sorted(p) == list(range(n))
    for r in spark.range(200).select("id", q5.permuted("id", 200).alias("p")).collect():
        assert r["p"] == plain_permuted(r["id"], 200)


def plain_permuted(x, n):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        for r in range(q5.ROUNDS):
            m, k = ((a, b), (b, a))[r % 2]
            f = int(hashlib.md5(f"{q5.SEED}:{r}:{x % k}".encode()).hexdigest()[:13], 16)
            x = x % k * m + (x // k + f % m) % m
        if x < n:
            return x


def test_shards(docs, clashing, rows, nothing):
    got = q5.shards(docs).collect()
    assert len(got) == len(rows) and q5.shards(nothing).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 24 and all(sorted(s) == list(range(len(s))) for s in by.values()) and len({len(s) for s in by.values()}) <= 2
    assert all(r["shard"] + 24 * r["slot"] == plain_permuted(r["row_number"], len(rows)) for r in got)
    expect = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expect
    again = Counter(tuple(r) for r in q5.shards(clashing.repartition(5)).collect())
    assert again == Counter(map(tuple, got))


# 6


def test_tokens():
    known = tokens.ChunkIds(tokens.vocabulary())
    for t in ["", "don't  stop\tnow it's 'S x's", "a <|endoftext|> b", "áb ́c İSTANBUL ΣΑΣ ÄÖÜß éÉ", "12 \x1c x\u0085y z", "(he's) --x-- 'tis ...'s", "日本語 한국어 🎉"]:
        assert np.frombuffer(known.of(t), "<u4").tolist() == known.tokenizer.encode(t, add_special_tokens=False).ids


def test_pack(docs, clashing, rows, nothing):
    known = tokens.ChunkIds(tokens.vocabulary())
    got = q6.pack(docs).collect()
    expect = Counter()
    for d, t, *_ in rows:
        ids = np.array(known.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            one = ids[at : at + 2048]
            expect[d, k, at, len(one), zlib.crc32(one.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expect
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert q6.pack(clashing).count() == len(got) and q6.pack(nothing).count() == 0


def test_plan_is_near_its_bound():
    rng = np.random.default_rng(3)
    hist = np.bincount(np.minimum(2048, rng.lognormal(5.5, 1, 50000).astype(int) + 1), minlength=2049)
    *_, total = q6.plan(hist)
    assert total <= 1.005 * math.ceil((hist * np.arange(2049)).sum() / 2048)
    assert sum(n for _, n in q6.fit_patterns(hist)) > 0.1 * total  # most have more than three documents here


# 7


def test_sequence():
    html = '<head><title>t</title></head><p>one <b>two</b></p><figure><img src="sha256:aa" alt="x"><figcaption>cap</figcaption></figure>after<img src="sha256:bb" alt="alt"><img src="http://x"><script>no</script>'
    assert [(e["position"], e["kind"], e["text"], e["digest"], e["caption"]) for e in q7.sequence(html)] == [(0, "text", "one two", None, None), (1, "media", None, "aa", "cap"), (2, "text", "after", None, None), (3, "media", None, "bb", "alt")]
    assert q7.sequence(None) == []


def test_media(spark, docs, rows, tmp_path):
    docs.coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = q7.op7_media_columns(spark, f"file://{tmp_path}").collect()
    expect = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        p = b + b"\0" * (64 if not b else -len(b) % 64)
        m = f"P5\n64 {len(p) // 64}\n255\n".encode() + p
        expect[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in got) == expect
    assert {r["caption"] == f"document {r['doc_id']}" or r["doc_id"] is None for r in got} == {True}
    store = spark.createDataFrame([("aa", b"x"), ("aa", b"x")], "digest string, media binary")
    page = spark.createDataFrame([(1, '<img src="sha256:aa"><img src="sha256:zz">')], "page_id long, html string")
    assert [r["media"] for r in q7.resolve(q7.parse(page), store, "page_id").orderBy("position").collect()] == [b"x", None]


# 8


def test_edits(spark, docs, rows, nothing):
    known = tokens.ChunkIds(tokens.vocabulary())
    count = lambda t: len(known.tokenizer.encode(t, add_special_tokens=False).ids)
    rng = np.random.default_rng(7)
    for t in [r[1] or "" for r in rows[:60]] + ["", " ", "word " * 500]:
        tree = q8.TokenTree(t, known, block=4)
        for _ in range(6):
            a = int(rng.integers(-2, len(t) + 3))
            b = a + int(rng.integers(-1, 30))
            new = ["", " ", "x", "mid dle", "\n\n", "'s"][int(rng.integers(6))]
            tree.edit(a, b, new)
            lo = min(max(0, a), len(t))
            t = t[:lo] + new + t[min(max(lo, b), len(t)) :]
            assert (tree.text(), tree.total) == (t, count(t))
    got = q8.count_edits(docs.withColumn("edits", q8.sample_edits())).collect()
    assert len(got) == len(rows) and all(r["n_tokens"] >= 0 for r in got)
    assert q8.count_edits(nothing.withColumn("edits", q8.sample_edits())).count() == 0
    none = docs.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,new:string>>"))
    assert all(r["n_tokens"] == r["n_tokens_after"] for r in q8.count_edits(none).collect())


# 9


def test_surrogates():
    t = "Dr. Anna Müller, und.34@mail7.example.com UND.34@MAIL7.example.com +1 (377) 555-0271 161.17.88.162 4417 7442 8035 1547 4417744280351548 999.1.1.1 token = \"cb1a9fee807a05366fcb8b6c95c7c565ede51a72\" DE89370400440532013000 Frau Müller"
    found = q9.mentions(t)
    assert [k for *_, k, _ in found] == ["name", "email", "email", "phone", "ip", "card", "secret", "iban", "name"]
    new = [q9.render(k, t[a:b], q9.core(k, n)) for a, b, k, n in found]
    assert new[1].lower() == new[2].lower() and new[2].split("@")[0].isupper()
    assert q9.luhn(new[5].replace(" ", "")) and new[5].count(" ") == 3 and q9._mod97(new[7]) == 1 and re.fullmatch("[0-9a-f]{40}", new[6])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[3]) and all(int(x) < 256 for x in new[4].split("."))
    assert all(x not in t for x in new) and q9.script("Ивана") == "CYRILLIC"


def test_cards_beside_numbers():
    card = "4845168114407329"
    spaced = "4845 1681 1440 7329"
    for t, c in [(f"12 {card}", card), (f"{card} 99", card), (f"7-{card}", card), (f"12 {spaced} 9", spaced), (f"1234 {spaced}", spaced), (f"1234 123-45-6789 {card}", card)]:
        found = [(k, t[a:b]) for a, b, k, _ in q9.mentions(t)]
        assert ("card", c) in found, t
    assert [k for *_, k, _ in q9.mentions(f"1234 123-45-6789 {card}")] == ["ssn", "card"]
    assert q9.mentions("1234 5678 9012 3456 7891") == []


def test_collisions(spark, monkeypatch, docs, nothing):
    real = [("phone", str(i)) for i in range(40)]
    monkeypatch.setattr(q9, "core", lambda kind, norm, attempt=0, key=b"": str((int(norm) * 7 + attempt * 13) % 100))
    found = spark.createDataFrame([(i, *x) for i, x in enumerate(real)], "doc_id long, type string, norm string")
    tries = {r["norm"]: r["attempt"] for r in q9.attempts(found).collect()}
    final = [q9.core("phone", n, tries.get(n, 0)) for _, n in real]
    assert len(set(final)) == 40 and not set(final) & {n for _, n in real}
    monkeypatch.undo()
    got = q9.pseudonymize(docs.union(spark.createDataFrame([(900, "mail a.b@c.org and a.b@c.org", "en", "a", 1), (901, "A.B@c.org", "en", "a", 1)], docs.schema)))
    by = {r["doc_id"]: r for r in got.collect()}
    mail = by[900]["text"].split(" ")[1]
    assert by[900]["text"] == f"mail {mail} and {mail}" and by[901]["text"].lower() == mail and by[900]["n_entities"] == 2
    assert by[100]["text"] is None and by[3]["n_entities"] == 0 and q9.pseudonymize(nothing).count() == 0


# 10


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 100, None: 5000}
    d = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_rows long, source_size long")
    got = {r["source"]: r["target"] for r in q10.targets(d).collect()}
    left, share, caps = dict(zip(["a", "b", "c", None], (5, 2, 1, 5))), {}, {k: 2 * v for k, v in sizes.items()}
    total = 1.5 * sum(sizes.values())
    while True:
        now = {k: total * w / sum(left.values()) for k, w in left.items()}
        over = [k for k in now if now[k] > caps[k]]
        if not over:
            share |= now
            break
        for k in over:
            share[k] = caps[k]
            total -= caps[k]
            left.pop(k)
    assert got == pytest.approx(share)


def test_mix(docs, clashing, rows, nothing):
    got = q10.takes(docs).collect()
    assert len(got) == len(rows)
    taken, per = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        per[r["source"]] = (r["target"], max(r["size"], per.get(r["source"], (0, 0))[1]))
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["epochs"] * r["size"]
    assert all(abs(taken[s] - t) <= big / 2 + 1 for s, (t, big) in per.items())
    assert Counter(map(tuple, q10.takes(docs.repartition(5)).collect())) == Counter(map(tuple, got))
    mixed = q10.mix(docs)
    assert mixed.columns == docs.columns and sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert q10.mix(clashing).count() == mixed.count() and q10.mix(nothing).count() == 0 and q10.takes(nothing).count() == 0
