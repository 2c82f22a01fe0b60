"""Quality rules with risk-controlled cutoffs.

Each rule is a number per document with a fixed grid of cutoffs; a document whose value is above the chosen cutoff is rejected.
The labelled documents that pass the base rules and are labelled good form the holdout. Within a stratum (language) and rule,
cutoffs are tested from the loosest to the tightest: with n good documents of which k would be rejected, a cutoff is accepted while
P(Binomial(n, alpha / rules) <= k) <= delta / (strata * rules), the exact (Clopper-Pearson) test. Fixed-sequence testing needs no
correction within the grid; Bonferroni covers rules and strata. So with confidence 1 - delta, in every stratum at once, the rules
together falsely reject at most a fraction alpha of good documents. A stratum with too few labels gets no cutoff and rejects nothing.
These are thresholds() and the query op1_quality_rules, whose SQL says the same.

joint_cuts(), the query op1_quality_joint and filter_documents() need fewer labels: all rules are tested together along one fixed path
of steps (see turn), so alpha is not divided and a step is accepted while P(Binomial(n, alpha) <= k) <= delta / (strata + 1). Strata
with n too small for that even at k = 0, and strata without labels, are judged by one pooled stratum, the last of the strata + 1 tests:
the small strata together or, where these are still too few, all strata. Its bound holds for the documents pooled as a whole.

Defined results: null or empty text has no words and fails the base rules; a null stratum is a stratum of its own; labels that are
null or contradict each other for a doc_id are not used; repeated rows are judged alike, each returned, but a labelled doc_id is one trial; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import common as C

ALPHA = 0.02
DELTA = 0.05
GRID = 40
#: The cutoff at which symbol_share and shout_share, which prose hardly has, go on alone along the joint path.
LOOSE = 20
STEPS = GRID + LOOSE - 1
#: rule -> width of a grid step; cutoff number g stands for g * step, g = GRID is the loosest.
RULES = {"symbol_share": 0.01, "dup_line_share": 0.02, "repeat_share": 0.0125, "shout_share": 0.02, "mean_word": 0.5}


def features(docs: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """keep columns (doc_id, lang unless given) and the base counts of each row of docs (doc_id, text, lang)."""
    keep = [F.col("doc_id"), F.col("lang")] if keep is None else keep
    names = ["_k%d" % i for i in range(len(keep))]
    outer = [F.col(a).alias(b) for a, b in zip(names, docs.select(*keep).columns)]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(C.WS_CHARS)) != "")
    d = docs.select(*[k.alias(a) for k, a in zip(keep, names)], text.alias("_t"), C.words(F.col("text")).alias("_w"), lines.alias("_l"))
    # windows of three words by 64-bit hash: within one document a collision has a chance of n^2 / 2^65
    hashes = F.expr("case when size(_w) < 3 then cast(array() as array<bigint>) else transform(slice(_w, 1, size(_w) - 2), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2])) end")
    d = d.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_word_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!")))).cast("long").alias("n_shouts"),
        hashes.alias("_h"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_word_lines", "n_dup_lines", "n_shouts"]
    # only documents in which some window repeats are sorted
    d = d.select(*names, *counts, F.expr("case when size(array_distinct(_h)) < size(_h) then array_sort(transform(_h, (x, i) -> struct(x as h, i as i))) end").alias("_s"))
    d = d.select(*names, *counts, F.expr("array_sort(transform(filter(_s, (e, j) -> (j > 0 and e.h = _s[greatest(j - 1, 0)].h) or (j < size(_s) - 1 and e.h = _s[least(j + 1, size(_s) - 1)].h)), e -> e.i))").alias("_p"))
    repeat = F.expr("case when _p is null or size(_p) = 0 then 0L when size(_p) = 1 then 3L else aggregate(sequence(1, size(_p) - 1), 3L, (a, k) -> a + least(3, _p[k] - _p[k - 1])) end")
    # the added zero keeps filters above this projection: pushed below it, they would sort a document's windows once for each window
    return d.select(*outer, *counts, (repeat + 0 * F.monotonically_increasing_id()).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_share": over("n_symbols", "word_chars"), "dup_line_share": over("n_dup_lines", "n_word_lines"), "repeat_share": over("n_repeat_words", "n_words"), "shout_share": over("n_shouts", "n_words"), "mean_word": over("word_chars", "n_words")}


def levels() -> dict[str, Column]:
    """The number of grid cutoffs 1..GRID that a document's value is above."""
    return {r: F.least(F.lit(GRID), F.greatest(F.lit(0), F.ceil(v / F.lit(RULES[r])) - 1)).cast("int") for r, v in rule_values().items()}


def turn() -> Column:
    """The first step of the joint path that rejects a document, STEPS + 1 for none: all rules go from GRID to LOOSE together, then symbol_share and shout_share to 1, then the others."""
    first = lambda r, v: F.when(v >= LOOSE, GRID + 1 - v).when(v > 0, (GRID + 1 if r in ("symbol_share", "shout_share") else GRID + LOOSE) - v)
    return F.coalesce(F.least(*[first(r, v) for r, v in levels().items()]), F.lit(STEPS + 1))


def log_cdf(k: str, n: str, p: float) -> Column:
    """ln P(Binomial(n, p) <= k) by the recurrence of the terms in logarithms; 0 (no evidence) where k >= n * p."""
    step = f"s.lp + ln(({n} - i + 1) / i * {p!r} / (1 - {p!r}))"
    add = f"greatest(s.lc, {step}) + ln(1 + exp(-abs(s.lc - ({step}))))"
    start = f"named_struct('lp', {n} * ln(1 - {p!r}), 'lc', {n} * ln(1 - {p!r}))"
    return F.expr(f"case when {k} >= {n} * {p!r} then 0D when {k} = 0 then {n} * ln(1 - {p!r}) else aggregate(sequence(1L, {k}), {start}, (s, i) -> named_struct('lp', {step}, 'lc', {add}), s -> s.lc) end")


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the rows that are labelled good, by all their labels."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 and hi = 1").select("doc_id")


def held_out(feats: DataFrame, labels: DataFrame, stratum: str, values: list[Column]) -> DataFrame:
    """(stratum, values) of the labelled good documents that pass the base rules, one row a doc_id and stratum: of repeated rows the one that is rejected first counts."""
    rows = feats.where(~base_failed()).select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("\x00null")).alias("stratum"), *values)
    names = rows.columns[2:]
    worst = [(F.min if x == "turn" else F.max)(x).alias(x) for x in names]
    return rows.join(good_ids(labels), "doc_id", "left_semi").groupBy("doc_id", "stratum").agg(*worst).select("stratum", *names)


def thresholds(feats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff level per rule or null). feats: base counts with doc_id and the stratum; labels: doc_id, quality."""
    held = held_out(feats, labels, stratum, [v.alias(r) for r, v in levels().items()])
    rules = list(RULES)
    # at most GRID + 1 levels a rule: counts stay small however many documents there are
    long = held.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in rules])).alias("x")).select("stratum", "x.rule", "x.level")
    hist = long.groupBy("stratum", "rule", "level").agg(F.count("*").alias("c"))
    per = hist.groupBy("stratum", "rule").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "c"))).alias("m"))
    # a document at level v is rejected by cutoffs 1..v, so cutoff g rejects those at levels >= g
    grid = per.select("stratum", "rule", "n", "m", F.explode(F.sequence(F.lit(1), F.lit(GRID))).alias("g")).select("stratum", "rule", "n", "g", F.expr(f"aggregate(sequence(g, {GRID}), 0L, (a, v) -> a + coalesce(m[v], 0L))").alias("k"))
    strata = grid.agg(F.countDistinct("stratum").alias("n_strata"))
    tested = grid.crossJoin(F.broadcast(strata)).withColumn("lp", log_cdf("k", "n", alpha / len(rules)))  # strata: one row
    ok = tested.where(F.col("lp") <= F.log(F.lit(delta) / (F.col("n_strata") * len(rules))))
    # k falls as g grows, so the accepted cutoffs are g..GRID and the least is the last of the sequence
    return ok.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("g"))).alias(f"cut_{r}") for r in rules])


def verdict(feats: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """feats with base_failed and kept."""
    lev = levels()
    d = feats.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("\x00null"))).join(cuts.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(lev[r] >= F.col(f"cut_{r}"), F.lit(False))
    return d.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~hit).drop("_stratum", *[f"cut_{r}" for r in RULES])


def joint_cuts(feats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, last accepted step of the joint path, 0 for none) of each stratum with labels enough, and a row of null for all others."""
    hist = held_out(feats, labels, stratum, [turn().alias("turn")]).groupBy("stratum", "turn").agg(F.count("*").alias("c"))
    sizes = hist.groupBy("stratum").agg(F.sum("c").alias("n"))
    tests = sizes.agg((F.count("*") + 1).alias("tests"))
    enough = F.col("n") * F.log(F.lit(1 - alpha)) <= F.log(F.lit(delta) / F.col("tests"))
    sizes = sizes.crossJoin(F.broadcast(tests)).select("stratum", "tests", enough.alias("own"))  # tests: one row
    # kinds of units: 0 a stratum of its own, 1 the small strata, 2 all strata
    unit = F.explode(F.array(F.struct(F.when(F.col("own"), F.col("stratum")).alias("stratum"), F.when(F.col("own"), 0).otherwise(1).alias("kind")), F.struct(F.lit(None).cast("string").alias("stratum"), F.lit(2).alias("kind"))))
    long = hist.join(sizes, "stratum").select("turn", "c", "tests", unit.alias("u")).groupBy("u.stratum", "u.kind", "tests", "turn").agg(F.sum("c").alias("c"))
    per = long.groupBy("stratum", "kind", "tests").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("turn", "c"))).alias("m"))
    steps = per.select("stratum", "kind", "tests", "n", "m", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("g")).select("stratum", "kind", "tests", "n", "g", F.expr("aggregate(sequence(1, g), 0L, (a, v) -> a + coalesce(m[v], 0L))").alias("k"))
    # k grows with g, so the accepted steps are the first ones
    passed = F.when(log_cdf("k", "n", alpha) <= F.log(F.lit(delta) / F.col("tests")), F.col("g"))
    last = steps.groupBy("stratum", "kind", "tests", "n").agg(F.coalesce(F.max(passed), F.lit(0)).alias("last"))
    pooled = last.agg(F.coalesce(F.max(F.when((F.col("kind") == 1) & enough, F.col("last"))), F.max(F.when(F.col("kind") == 2, F.col("last"))), F.lit(0)).alias("last"))
    return last.where("kind = 0").select("stratum", "last").union(pooled.select(F.lit(None).cast("string"), "last"))


def joint_verdict(feats: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """feats with base_failed and kept, by joint_cuts()."""
    own, pooled = cuts.where("stratum is not null").toDF("_stratum", "_last"), cuts.where("stratum is null").select(F.col("last").alias("_pooled"))
    d = feats.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("\x00null"))).join(own, "_stratum", "left").crossJoin(F.broadcast(pooled))  # pooled: one row
    return d.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (turn() > F.coalesce("_last", "_pooled"))).drop("_stratum", "_last", "_pooled")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Cutoffs need the features of labelled good rows only; all others are read once."""
    with C.Scratch() as scratch:
        good = scratch.keep(good_ids(labels), "good-ids")
        some = C.maybe_in(docs.select("doc_id", "text", "lang").where("doc_id is not null"), good, good.count())
        feats = scratch.keep(features(some), "quality-features")
        # written, so that its size is known: one row a stratum, broadcast while small, and texts are not shuffled by stratum
        cuts = C.materialize(joint_cuts(feats, labels), "quality-cuts")
    row = C.fresh(docs, "_row")
    packed = F.struct(*[F.col(c) for c in docs.columns]).alias(row)
    judged = joint_verdict(features(docs, [F.col("lang"), packed]), cuts)
    return judged.where("kept").select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = C.materialize(features(C.read(spark, sf_dir, "documents")), "quality-features")
    cuts = C.materialize(thresholds(feats, C.read(spark, sf_dir, "labels")), "quality-cuts")
    return verdict(feats, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = C.materialize(features(C.read(spark, sf_dir, "documents")), "quality-features")
    cuts = C.materialize(joint_cuts(feats, C.read(spark, sf_dir, "labels")), "quality-cuts")
    return joint_verdict(feats, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BINOMIAL = """list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"""


def oracle_ctes(source: str, out: str) -> str:
    """CTEs that end in {out}: every column of {source} with its counts and verdict."""
    p, rules = repr(ALPHA / len(RULES)), list(RULES)
    value = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_word_lines"), "repeat_share": ("n_repeat_words", "n_words"), "shout_share": ("n_shouts", "n_words"), "mean_word": ("word_chars", "n_words")}
    level = {r: f"least({GRID}, greatest(0, ceil((case when {b} > 0 then {a}::double / {b} else 0.0 end)::double / {RULES[r]!r}::double) - 1))::int" for r, (a, b) in value.items()}
    return f"""
q1 AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM {source}),
q2 AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM q1 WHERE len(w) >= 3),
q3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM q2),
q4 AS (SELECT rid, count(DISTINCT i + o) AS r FROM q3, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY rid),
q5 AS (SELECT q1.*, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols, len(l) AS n_word_lines, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
  (length(t) - length(replace(t, '!', '')))::bigint AS n_shouts, coalesce(r, 0)::bigint AS n_repeat_words FROM q1 LEFT JOIN q4 USING (rid)),
q6 AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce(lang, chr(0) || 'null') AS stratum, {', '.join(f'{level[r]} AS v_{r}' for r in rules)} FROM q5),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
held AS (SELECT * FROM q6 WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
counts AS ({' UNION ALL '.join(f"SELECT stratum, '{r}' AS rule, g, count(*) AS n, count(*) FILTER (WHERE v_{r} >= g) AS k FROM held, range(1, {GRID + 1}) x(g) GROUP BY stratum, g" for r in rules)}),
cuts AS (SELECT stratum, {', '.join(f"min(g) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in rules)} FROM counts WHERE k < n * {p} AND {_BINOMIAL.format(p=p)} <= {DELTA!r} / ((SELECT count(DISTINCT stratum) FROM counts) * {len(rules)}) GROUP BY stratum),
{out} AS (SELECT q6.*, NOT base_failed AND NOT ({' OR '.join(f'coalesce(v_{r} >= cut_{r}, false)' for r in rules)}) AS kept FROM q6 LEFT JOIN cuts USING (stratum))"""


ORACLE = f"WITH {oracle_ctes('documents', 'judged')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"


def joint_oracle_ctes(source: str, out: str) -> str:
    """CTEs that end in {out}: every column of {source} with its counts and the verdict of the joint path."""
    base = oracle_ctes(source, out)
    base = base[: base.index("held AS")]
    first = lambda r: f"CASE WHEN v_{r} >= {LOOSE} THEN {GRID + 1} - v_{r} WHEN v_{r} > 0 THEN {GRID + 1 if r in ('symbol_share', 'shout_share') else GRID + LOOSE} - v_{r} END"
    enough, p = f"n * ln(1 - {ALPHA!r}) <= ln({DELTA!r} / tests)", repr(ALPHA)
    return f"""{base}
q7 AS (SELECT *, coalesce(least({', '.join(map(first, RULES))}), {STEPS + 1}) AS turn FROM q6),
held AS (SELECT stratum, min(turn) AS turn FROM q7 WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY doc_id, stratum),
sz AS (SELECT stratum, count(*) AS n FROM held GROUP BY stratum),
tt AS (SELECT count(*) + 1 AS tests FROM sz),
ow AS (SELECT stratum, {enough} AS own FROM sz, tt),
un AS (SELECT turn, CASE WHEN own THEN stratum END AS stratum, CASE WHEN own THEN 0 ELSE 1 END AS kind FROM held JOIN ow USING (stratum) UNION ALL SELECT turn, NULL, 2 FROM held),
st AS (SELECT stratum, kind, g, count(*) AS n, count(*) FILTER (WHERE turn <= g) AS k FROM un, range(1, {STEPS + 1}) x(g) GROUP BY stratum, kind, g),
la AS (SELECT stratum, kind, n, tests, coalesce(max(g) FILTER (WHERE k < n * {p} AND {_BINOMIAL.format(p=p)} <= {DELTA!r} / tests), 0) AS last FROM st, tt GROUP BY stratum, kind, n, tests),
po AS (SELECT coalesce(max(last) FILTER (WHERE kind = 1 AND {enough}), max(last) FILTER (WHERE kind = 2), 0) AS pooled FROM la),
{out} AS (SELECT q7.*, NOT base_failed AND turn > coalesce(la.last, pooled) AS kept FROM q7 CROSS JOIN po LEFT JOIN la ON la.kind = 0 AND la.stratum = q7.stratum)"""


JOINT_ORACLE = f"WITH {joint_oracle_ctes('documents', 'judged')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
