"""The whole pipeline, and its stages' lifetimes, against a plain version in loops."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lanternfish.llm import common as C
from lanternfish.llm import op01_quality as q1
from lanternfish.llm import op10_mix as q10
from lanternfish.llm import tokens
from tests.llm.test_operators import jaccard_components, line_drops, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [prose(12) for _ in range(4)]
    out = []
    for i in range(330):
        lang = "en" if i < 300 else "de"
        text = "\n".join(prose(rng.randint(15, 25)) for _ in range(4))
        if i % 7 == 3:
            text += "\n" + shared[i % 4].upper() + " \nlast words"
        out.append((i, text, lang, ("a", "b", None, "é")[i % 4 if i % 3 else 0], len(text)))
    for i in range(12):  # exact and near copies in one line, which line dedup leaves
        w = out[5 * i][1].split()
        if i % 2:
            w[10] = "changed"
        out.append((1000 + i, " ".join(w), "en", "b", 1))
    out += [(2000 + i, prose(60) + " ##" * 12, ("en", "de", "it")[i % 3], "a", 1) for i in range(9)]  # symbols
    out += [(3000, "too short", "en", "a", 9), (3001, None, "en", "a", None), (3002, "", None, None, 0), (3003, "same three words " * 40, "en", "a", 1), (3004, prose(3000), "en", "b", 1), (None, prose(80), "en", "a", 1)]
    return out


def plain_quality(rows, labels):
    def judged(t):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        win = Counter(zip(w, w[1:], w[2:]))
        covered = {i + o for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for o in range(3)}
        chars = sum(map(len, w))
        value = {"symbol_share": (sum(c in "#*$%&|<>" for c in t or ""), chars), "dup_line_share": (len(lines) - len(set(lines)), len(lines)), "repeat_share": (len(covered), len(w)), "shout_share": ((t or "").count("!"), len(w)), "mean_word": (chars, len(w))}
        firsts = []
        for r, (a, b) in value.items():
            v = min(q1.GRID, max(0, math.ceil((a / b if b else 0.0) / q1.RULES[r]) - 1))
            if v >= q1.LOOSE:
                firsts.append(q1.GRID + 1 - v)
            elif v > 0:
                firsts.append((q1.GRID + 1 if r in ("symbol_share", "shout_share") else q1.GRID + q1.LOOSE) - v)
        return len(w) < 50 or 100 * len(covered) > 50 * len(w), min(firsts, default=q1.STEPS + 1)

    good = {d for d, q in labels if q == 1} - {d for d, q in labels if q == 0}
    seen = {r: judged(r[1]) for r in rows}
    held = defaultdict(list)
    for r, (failed, turn) in seen.items():
        if r[0] in good and not failed:
            held[r[2]].append(turn)
    tests = len(held) + 1
    enough = lambda n: n * math.log(1 - q1.ALPHA) <= math.log(q1.DELTA / tests)

    def last(turns):
        n, out = len(turns), 0
        for g in range(1, q1.STEPS + 1):
            k = sum(t <= g for t in turns)
            p = sum(math.comb(n, i) * q1.ALPHA**i * (1 - q1.ALPHA) ** (n - i) for i in range(k + 1))
            if k < n * q1.ALPHA and p <= q1.DELTA / tests:
                out = g
        return out

    own = {s: last(t) for s, t in held.items() if enough(len(t))}
    small = [x for s, t in held.items() if s not in own for x in t]
    pooled = last(small) if small and enough(len(small)) else last([x for t in held.values() for x in t])
    return [r for r in rows if not seen[r][0] and seen[r][1] > own.get(r[2], pooled)]


def plain_lines(rows):
    texts = {eval(x)[0]: eval(x)[1] for x in line_drops(rows)}  # doc_ids are distinct here
    return [(r[0], None if r[1] is None else texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in rows]


def plain_mix(rows):
    sizes, by = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: q10.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target, total = dict(weight), {}, q10.SHARE * sum(sizes.values())
    while left:
        over = [s for s in left if total * left[s] / sum(left.values()) > q10.CAP * sizes[s]]
        if not over:
            target |= {s: total * w / sum(left.values()) for s, w in left.items()}
            break
        for s in over:
            target[s] = q10.CAP * sizes[s]
            total -= target[s]
            left.pop(s)
    out = []
    for s, rs in by.items():
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, cum = target[s] - whole * sizes[s], 0
        for r in sorted(rs, key=lambda r: hashlib.md5(f"{q10.SEED}:{'null:' + hashlib.md5(r[1].encode()).hexdigest() if r[0] is None else r[0]}".encode()).hexdigest()):
            n = len(words(r[1]))
            out += [r] * (whole + (2 * cum + n < 2 * rest))
            cum += n
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"file://{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(330)] + [(2000 + i, 0, 0) for i in range(9)] + [(7, 0, 0), (None, 1, 0), (8, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}", [x[:2] for x in labels]


def test_pipeline_is_the_plain_one(spark, tables):
    at, labels = tables
    before = list(C._open)
    got = corpus_pipeline.run(spark, at).collect()
    kept = plain_quality(corpus(), labels)
    assert {r[0] for r in kept} & {*range(2000, 2009), 3000, 3001, 3002, 3003} == set() and {3004, None} < {r[0] for r in kept}
    deduped = plain_lines(kept)
    assert sum(a[1] != b[1] for a, b in zip(kept, deduped)) > 5
    comp = jaccard_components(deduped)
    distinct = [r for r in deduped if r[0] is None or comp[r[0]][1] == r[0]]
    assert len(deduped) - len(distinct) > 8
    mixed = plain_mix(distinct)
    known = tokens.ChunkIds(tokens.vocabulary())
    expect = Counter()
    for d, t, *_ in mixed:
        ids = np.array(known.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            expect[d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expect
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        assert [a for a, _ in sorted(s)] == [0, *np.cumsum([n for _, n in sorted(s)])[:-1]] and sum(n for _, n in s) <= 2048
    rooms = []  # plain best fit decreasing
    for n in sorted((r["length"] for r in got), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            fit = 2048
        else:
            rooms.remove(fit)
        rooms.append(fit - n)
    assert len(by) <= len(rooms)
    assert len(C._open) == len(before) + 1  # only the result's table is left


def test_stages_keep_columns_and_leave_the_session_alone(spark, tables, nothing):
    at, _ = tables
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = C.read(spark, at, "documents").withColumn("row", C.F.lit(1)).withColumn("_keep", C.F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.settled(lambda d=docs, f=stage: f(spark, d, at), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "_keep"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = C.settled(lambda d=empty, f=stage: f(spark, d, at), "t")
        assert empty.count() == 0


def test_joint_rules_on_repeated_rows(spark, tables):
    at, labels = tables
    docs = C.read(spark, at, "documents")
    known = C.read(spark, at, "labels")
    once = q1.joint_cuts(q1.features(docs), known).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, q1.joint_cuts(q1.features(docs.union(docs)), known).collect()))
    assert sorted(map(repr, q1.thresholds(q1.features(docs), known).collect())) == sorted(map(repr, q1.thresholds(q1.features(docs.union(docs)), known).collect()))


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"
        getConf = lambda self: self
        get = lambda self, *_: None
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        C.scratch_dir(Session())
