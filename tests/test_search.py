import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lanternfish import cli, config, serving
from lanternfish.operators import graph as G
from lanternfish.operators import lifecycle as L
from lanternfish.operators import policy as P
from lanternfish.operators import reports as R
from lanternfish.operators import search as S
from lanternfish.plans import querylang as Q
from lanternfish.sources import markup, tables
from lanternfish.streaming import crawl


def test_query_language(spark):
    q = Q.parse_query("Foo domain:a.b NOT size:>5K NOT bar size:x intitle:t NOT")
    assert q.text == "foo not bar not" and [(f.kind, f.value, f.negate) for f in q.filters] == [("domain", "a.b", False), ("size", ">5K", True), ("intitle", "t", False)]
    assert Q.parse_size(">1.5KiB") == (">", 1536.0) and Q.parse_size("<.") is None and Q.parse_size(">2x") is None and Q.parse_size(">3") == (">", 3.0)
    assert Q.page_number("3") == 3 and Q.page_number("x") == 1 and Q.page_number("0") == 1
    d = spark.createDataFrame([("a", "text/x", 0, "t"), ("b", "text/y", 10, "u")], "domain_name string, content_type string, size long, title string")
    assert d.where(Q.filter_column(Q.parse_query("x size:<5K").filters)).count() == 1
    assert d.where(Q.filter_column(Q.parse_query("x domain:a domain:b content_type:text/x").filters)).count() == 1


def test_cover_density():
    assert S.cover_density([[1, 5]]) == pytest.approx(0.2)
    assert S.cover_density([[1], [2]]) == pytest.approx(0.1)
    assert S.cover_density([[1], [4]]) == pytest.approx(0.1 / 3)
    assert S.cover_density([[1, 10], [2, 11]]) == pytest.approx(0.1 + 0.1 / 8 + 0.1)
    assert S.cover_density([[1], []]) == 0


def test_merge_copies():
    row = lambda url, host, path, score, size=5: {"url": url, "host": host, "path": path, "score": score, "size": size, "content_hash": "h"}
    same_path = S.merge_copies([row("g://a/x", "a", "/x", 1.0), row("g://b/x", "b", "/x", 2.0)])
    assert [(r["url"], r["score"]) for r in same_path] == [("g://a/x", 2.0)]
    assert len(S.merge_copies([row("g://a/x", "a", "/x", 1.0), row("g://b/y", "b", "/y", 2.0)])) == 2
    assert len(S.merge_copies([row("g://a/x", "a", "/x", 1.0, 0), row("g://a/x", "a", "/x", 1.0, 0)])) == 2
    assert len(S.merge_copies([row("g://a/users/u/p", "a.b", "/users/u/p", 1.0), row("g://a/user/u/p", "c", "/user/u/p", 1.0)])) == 1
    mirror = S.merge_copies([row("g://a/x", "a", "/x", 1.0), row("g://m/p/a/x", "m", "/p/a/x", 9.0)])
    assert [r["score"] for r in mirror] == [1.0]


def graph_of(spark, pairs):
    e = spark.createDataFrame(pairs, "src string, dst string")
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e


@pytest.mark.parametrize("algorithm", ["hits", "salsa"])
def test_ranks_agree(spark, algorithm, monkeypatch):
    nodes, e = graph_of(spark, [("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "x"), ("d", "e")])
    local = {r["node"]: r["score"] for r in G.rank(nodes, e, algorithm).collect()}
    monkeypatch.setattr(G, "LOCAL_ROWS", 0)
    far = {r["node"]: r["score"] for r in G.rank(nodes, e, algorithm).collect()}
    assert local.keys() == far.keys() and all(local[k] == pytest.approx(far[k], abs=1e-9) for k in far)
    assert max(local, key=local.get) in ("x", "e") and local["x"] > local["y"]


def test_backlinks_and_edges(spark):
    links = spark.createDataFrame([("a", "x", True), ("b", "x", False), ("a", "b", True)], "url string, to_url string, is_cross_site boolean")
    assert {r["is_cross_site"]: r["urls"] for r in G.backlinks(links, "x").collect()} == {True: ["a"], False: ["b"]}
    root, nodes = spark.createDataFrame([("a",), ("b",)], "url string"), spark.createDataFrame([("a",), ("b",), ("x",)], "url string")
    assert sorted(map(tuple, G.subgraph_edges(root, nodes, links).collect())) == [("a", "b"), ("a", "b"), ("a", "x")]


def response(url, body, status=20, meta="text/gemini"):
    return (url, status, meta, body.encode(), dt.datetime(2024, 1, 1))


def test_crawl_and_search(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.create_tables(spark, root)
    tables.create_tables(spark, root)
    pages, links = tables.read_table(spark, root, "pages"), tables.read_table(spark, root, "links")
    now = F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz")
    got = [response("gemini://a.x/", "# Cats\ncats and dogs\n=> gemini://b.x/p other\n=> /own me\n=> mailto:x@y\n"), response("gemini://b.x/p", "# Dogs\ndogs only, cats rarely\n=> gemini://a.x/ back\n"), response("gemini://c.x/", "", 51, "gone"), response("gemini://d.x/i", "", 10, "Your name?")]
    landed = spark.createDataFrame(got, tables.RESPONSES)
    p, k = L.crawl_batch(pages, links, landed, now)
    p, k = p.cache(), k.cache()
    by = {r["url"]: r for r in p.collect()}
    assert by["gemini://a.x/"]["title"] == "Cats" and by["gemini://a.x/"]["cross_site_links"] == ["gemini://b.x/p"] and by["gemini://a.x/"]["internal_links"] == ["gemini://a.x/own"]
    assert by["gemini://c.x/"]["last_status"] == 0 and by["gemini://d.x/i"]["content_type"] == "<gemini-request-info>" and by["gemini://a.x/own"]["content_body"] is None
    assert k.count() == 3
    again, _ = L.crawl_batch(p, k, landed, F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz"))
    same = {r["url"]: r for r in again.collect()}["gemini://a.x/"]
    assert same["last_indexed_at"] == dt.datetime(2024, 1, 2) and same["last_crawled_at"] == dt.datetime(2024, 1, 3)
    found = S.search(p, S.postings(p), k, "cats")
    rows = found.collect()
    assert [r["url"] for r in rows][:1] == ["gemini://a.x/"] and "[cats]" in rows[0]["preview"] and len(rows) == 2
    assert S.search(p, S.postings(p), k, "cats dogs domain:b.x").count() == 1
    with pytest.raises(ValueError):
        S.search(p, S.postings(p), k, "domain:b.x")
    assert R.domains_and_pages(p).first() == (4, 4) or R.domains_and_pages(p).first()["n_pages"] >= 3
    assert R.add_seed(p, "gemini://new.x", now).count() == p.count() + 1 and R.add_seed(p, "bad", now).count() == p.count()


def test_lifecycle(spark):
    now = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    t = lambda *a: dt.datetime(2024, *a)
    pages = spark.createDataFrame([("a", t(1, 1), t(1, 31), None), ("b", t(1, 31), t(1, 31), None), ("c", None, None, None), ("d", t(1, 1), None, t(1, 31, 23, 58))], "url string, last_crawled_at timestamp_ntz, last_crawl_success_at timestamp_ntz, last_queued_at timestamp_ntz")
    batch, leased = L.claim_batch(pages, now)
    assert {r["url"] for r in batch.collect()} == {"a", "c"} and leased.where("last_queued_at is not null").count() == 3
    assert L.sample_frontier(pages, now).count() == 2
    assert {r["url"] for r in L.expire(pages, now, "INTERVAL 12 HOURS").collect()} == {"c", "d"}
    r = spark.createDataFrame([("a", "b"), ("b", "c")], "from_url string, to_url string")
    assert {x["url"]: (x["target"], x["n_hops"]) for x in L.follow_redirects(pages, r).collect()}["a"] == ("c", 2)
    assert L.purge(pages, "a%", ["url"]).count() == 3
    p = spark.createDataFrame([("h", 1, "/x")], "host string, port int, disallowed string")
    urls = spark.createDataFrame([("gemini://h:1/x/yy",), ("gemini://h:1/z",), ("http://h/z",), ("gemini://git.h/",), ("gemini://t/",), ("gemini://p/q/rr",)], "url string")
    rules = P.prefix_rules(spark.createDataFrame([("gemini://p/q?z",)], "url string"))
    timeouts = spark.createDataFrame([("t", 1965, 9)], "host string, port int, n long")
    assert [r["url"] for r in P.should_crawl(urls, rules, p, timeouts).collect()] == ["gemini://h:1/z"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([response("gemini://a.x/", "x")], tables.RESPONSES).write.parquet(src)
    seen = []
    crawl.ingest(crawl.responses_stream(spark, src), lambda df, i: seen.append((i, df.count())), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(n for _, n in seen) == 1
    log = spark.createDataFrame([("h", 1, True, dt.datetime(2024, 1, 1, 0, i)) for i in range(5)], "host string, port int, failed boolean, ts timestamp")
    assert crawl.timeouts_stream(log).first()["n"] == 5


def test_sources(spark, tmp_path):
    f = tmp_path / "seeds"
    f.write_text("gemini://a\n\n gemini://b \n")
    assert [r["url"] for r in tables.read_seeds(spark, str(f)).collect()] == ["gemini://a", "gemini://b"]
    d = spark.range(2)
    tables.write_snapshot(d, str(tmp_path), "t", 1)
    assert spark.read.parquet(f"{tmp_path}/t/v00000001").count() == 2
    assert tables.as_json_array(d.where("id > 9"), ["id"]).first()["json"] == "[]"


def test_blocked_urls(spark):
    from lanternfish.operators.blocked_urls import blocked_urls

    rules = P.prefix_rules(blocked_urls(spark))
    urls = spark.createDataFrame([("gemini://taz.de/",), ("gemini://caolan.uk/weather/xy",), ("gemini://caolan.uk/",), ("gemini://geddit.pitr.ca/post",)], "url string")
    assert {r["url"] for r in P.blocked_by_prefix(urls, rules).collect()} == {"gemini://taz.de/", "gemini://caolan.uk/weather/xy", "gemini://geddit.pitr.ca/post"}


def test_cover_rank_is_cover_density(spark):
    rng = random.Random(3)
    cases = [[sorted(rng.sample(range(1, 60), rng.randint(1, 12))) for _ in range(rng.randint(1, 4))] for _ in range(80)] + [[[5], [5]], [[1, 2, 3], [3], [3, 9]]]

    def plain(positions):
        if len(positions) == 1:
            return 0.1 * len(positions[0])
        events, rank, begin = sorted((p, t) for t, ps in enumerate(positions) for p in ps), 0.0, -1
        for i, (p, _) in enumerate(events):
            last = {t: q for q, t in events[: i + 1]}
            if len(last) == len(positions) and min(last.values()) > begin:
                begin = min(last.values())
                inside = [e for e in events[: i + 1] if e[0] >= begin]
                first = inside.index(min(e for e in inside if last[e[1]] == e[0] == begin))
                rank += 0.1 / (1 + max(0, p - begin - (len(inside) - 1 - first)))
        return rank

    for c in cases:
        got = spark.range(1).select(S.cover_rank(F.array(*[F.array(*map(F.lit, ps)) for ps in c]), len(c)).alias("r")).first()["r"]
        assert got == pytest.approx(S.cover_density(c)) == pytest.approx(plain(c))


def test_native_fold_is_the_plain_one(spark):
    rng = random.Random(4)
    hosts, paths, rows = ["a.x", "b.x", "c.x", "m.x"], ["/p", "/~u/p", "/users/u/p", "/user/u/p", "/a.x/p", "/b.x/~u/p", "/q/", "/q"], []
    for i in range(300):
        host, path = rng.choice(hosts), rng.choice(paths)
        rows.append((f"gemini://{host}{path}", host, path, rng.choice(["h1", "h2", "h3", "h4", "", None]), rng.choice([0, 5, 5, 5]), float(rng.randint(0, 400)), float(rng.randint(0, 20))))
    cols = ["url", "host", "path", "content_hash", "size", "text_rank", "score"]
    got = S.dedup(spark.createDataFrame(rows, "url string, host string, path string, content_hash string, size long, text_rank double, score double")).collect()
    expect = []
    for h in {r[3] for r in rows}:
        mine = [dict(zip(cols, r)) for r in rows if r[3] == h]
        whole = [r for r in mine if r["size"] and h]
        expect += [r for r in mine if not (r["size"] and h)] + S.merge_copies(sorted(whole, key=lambda r: (-r["text_rank"], r["url"], r["host"], r["path"], r["size"], r["score"])), better=True)
    assert sorted(repr([r[c] for c in cols]) for r in got) == sorted(repr([r[c] for c in cols]) for r in expect)


def test_local_ranking_is_asked_for(spark, monkeypatch):
    nodes, e = graph_of(spark, [("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "x"), ("d", "e")])
    for algorithm in ("hits", "salsa", "other"):
        far, near = ({r["node"]: r["score"] for r in G.rank(nodes, e, algorithm, local).collect()} for local in (False, True))
        assert far.keys() == near.keys() and all(far[k] == pytest.approx(near[k], abs=1e-9) for k in far)
    monkeypatch.setattr(G, "LOCAL_ROWS", 3)
    with pytest.raises(ValueError):
        G.rank(nodes, e, "salsa", True)


def test_stored_index(spark, tmp_path):
    pages = spark.createDataFrame([(f"gemini://h/{i}", f"Title {i}", "the cat and the dog " + "cat " * i) for i in range(20)], "url string, title string, content_body string")
    at = f"file://{tmp_path}/index"
    S.write_index(S.postings(pages), at, buckets=16)
    some = S.read_index(spark, at, ["cat", "dog"], buckets=16)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]  # other folders are not read
    rows = lambda d: sorted(map(repr, d.select("term", "url", "field", "tf", "positions").collect()))
    assert rows(some) == rows(S.postings(pages, terms=["cat", "dog"])) and rows(S.read_index(spark, at)) == rows(S.postings(pages))
    new = spark.createDataFrame([("gemini://h/3", "New", "bird"), ("gemini://h/99", "Else", "cat")], pages.schema)
    gone = pages.where("url = 'gemini://h/4'").select("url")
    left = pages.where("url not in ('gemini://h/3', 'gemini://h/4')").unionByName(new)
    assert rows(S.update_index(S.read_index(spark, at), new, gone)) == rows(S.postings(left))
    assert S.read_index(spark, at, [], buckets=16).count() == 0


def stamp(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def ntz(t):
    return F.lit(t).cast("timestamp_ntz")


def test_latest_response_counts(spark):
    pages, links = spark.createDataFrame([], tables.PAGES), spark.createDataFrame([], tables.LINKS)
    rows = [("gemini://a.x/", 20, "text/gemini", b"# Old\n=> /old", stamp(1)), ("gemini://a.x/", 20, "text/gemini", b"# New\n=> /new", stamp(2)), ("gemini://a.x/", 20, "text/gemini", b"# New\n=> /new", stamp(2))]
    p, k = L.crawl_batch(pages, links, spark.createDataFrame(rows, tables.RESPONSES), ntz(stamp(3)))
    assert {r["url"]: r["title"] for r in p.collect()} == {"gemini://a.x/": "New", "gemini://a.x/new": None} and p.count() == 2
    assert [r["to_url"] for r in k.collect()] == ["gemini://a.x/new"]


def test_touch_notes_the_type(spark):
    old = [("gemini://a.x/", 20, "text/gemini", b"same", stamp(1))]
    pages, links = L.crawl_batch(spark.createDataFrame([], tables.PAGES), spark.createDataFrame([], tables.LINKS), spark.createDataFrame(old, tables.RESPONSES), ntz(stamp(1)))
    again = spark.createDataFrame([("gemini://a.x/", 21, "text/plain; lang=en", b"same", stamp(2))], tables.RESPONSES)
    r = L.crawl_batch(pages, links, again, ntz(stamp(2)))[0].first()
    assert (r["content_type"], r["last_status"], r["last_meta"], r["last_indexed_at"]) == ("text/plain", 21, "text/plain; lang=en", stamp(1))
    forced = L.crawl_batch(pages, links, again, ntz(stamp(2)), force=True)[0].first()
    assert forced["last_indexed_at"] == stamp(1)  # both hashes are the same


def test_crawl_round(spark):
    one = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    none = {n: one(tables.TABLES[n]) for n in tables.TABLES}
    page = lambda url, **more: tuple({"url": url, "domain_name": "h", "port": 1965, "size": 0, "first_seen_at": stamp(1), "indexed_content_hash": "", "raw_content_hash": "", **more}.get(c.split()[0]) for c in tables.PAGES.replace("\n", " ").split(", "))
    pages = one(tables.PAGES, page("gemini://h.x/../odd"), page("gemini://gone.x/", last_status=53, last_crawled_at=stamp(9)), page("gemini://shut.x/in/a", last_crawl_success_at=stamp(9)))
    got = one(
        tables.RESPONSES, ("gemini://shut.x/robots.txt", 20, "text/plain", b"User-agent: *\nDisallow: /in\n", stamp(10)), ("gemini://shut.x/in/a", 20, "text/gemini", b"x", stamp(10)), ("gemini://gone.x/", 20, "text/gemini", b"x", stamp(10)),
        ("gemini://h.x/moved", 31, "gemini://h.x/there", None, stamp(10)), ("gemini://h.x/there", 20, "text/gemini", b"# There\n=> gemini://shut.x/in/b\n=> gemini://shut.x/out\n=> gemini://localhost/\n", stamp(10)), ("gemini://h.x/lost", 30, "gemini://nowhere.x/", None, stamp(10)), ("gemini://h.x/bad", 53, "wrong host", None, stamp(10)),
    )
    new = L.crawl_round(pages, none["links"], none["robot_policies"], none["robot_policies_status"], none["perma_redirects"], got, ntz(stamp(11)), P.prefix_rules(one("url string")), one("host string, port int"))
    by = {r["url"]: r for r in new["pages"].collect()}
    assert set(by) == {"gemini://gone.x/", "gemini://shut.x/in/a", "gemini://h.x/moved", "gemini://h.x/there", "gemini://h.x/lost", "gemini://h.x/bad", "gemini://shut.x/out"}
    assert by["gemini://gone.x/"]["last_crawled_at"] == stamp(9) and by["gemini://shut.x/in/a"]["last_meta"] == "blocked"
    assert by["gemini://h.x/moved"]["title"] == "There" and by["gemini://h.x/lost"]["last_status"] == 30 and (by["gemini://h.x/bad"]["last_status"], by["gemini://h.x/bad"]["last_meta"]) == (53, "wrong host")
    assert [tuple(r) for r in new["perma_redirects"].collect()] == [("gemini://h.x/moved", "gemini://h.x/there")]
    assert [tuple(r) for r in new["robot_policies"].collect()] == [("shut.x", 1965, "/in")] and new["robot_policies_status"].first()["have_policy"]
    assert new["links"].where("url = 'gemini://h.x/there'").count() == 3
    assert P.robots_urls(one("url string", ("gemini://shut.x/a",), ("gemini://h.x:70/a",)), new["robot_policies_status"], ntz(stamp(12))).collect() == [("gemini://h.x:70/robots.txt",)]


def test_purge_counts(spark):
    pages, links = spark.createDataFrame([("a1",), ("a2",), ("b",)], "url string"), spark.createDataFrame([("a1", "b"), ("b", "a2"), ("b", "b")], "url string, to_url string")
    p, k, n = L.purge_index(pages, links, "a%")
    assert n == 2 and p.count() == 1 and k.count() == 1


def test_backlinks_without_protocol(spark):
    links = spark.createDataFrame([("gemini://b/", "gemini://a.x/p", True)], "url string, to_url string, is_cross_site boolean")
    assert G.backlink_rows(links, "a.x/p").count() == 1 and G.backlink_rows(links, "gemini://a.x/p").count() == 1 and G.backlink_rows(links, "a.x").count() == 0


def test_feed_contract(spark):
    pages = spark.createDataFrame([("a", "atom"), ("b", "rss"), ("c", None)], "url string, feed_type string")
    assert [r["url"] for r in R.known_feeds(pages, "").collect()] == ["a"] and [r["url"] for r in R.known_feeds(pages, "rss").collect()] == ["b"]
    with pytest.raises(ValueError):
        R.known_feeds(pages, "html")


def test_result_markup(spark, tmp_path):
    found = spark.createDataFrame([("gemini://a.x/b%20c", "T", 1.5, 2500, "", None, "text"), ("gemini://a.x/", "gemini://a.x/", 1.0, 10, "text/x", dt.datetime(2024, 1, 2), "more")], "url string, title string, score double, size long, content_type string, last_crawl_success_at timestamp_ntz, preview string")
    plain = [r["markup"] for r in markup.results(found).collect()]
    assert plain == ["=> gemini://a.x/b%20c T (unknown/none, 2KB)\n* gemini://a.x/b c\ntext\n", "=> gemini://a.x/ gemini://a.x/ (text/x, 1KB)\nmore\n"]
    assert "* Score: 1.0\n* Last Crawled: 2024-01-02 00:00:00" in markup.results(found, True).collect()[1]["markup"]
    markup.write(markup.hosts(found), f"file://{tmp_path}/hosts", ["markup"])
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/hosts").collect()] == ["=> gemini://a.x/", "=> gemini://a.x/b%20c"]


def test_command_line(spark, tmp_path, capsys):
    root, seeds = f"file://{tmp_path}/tables", tmp_path / "seeds"
    (tmp_path / "settings.json").write_text('{"tables": "%s", "batch": 10}' % root)
    seeds.write_text("gemini://a.x/\n\ngemini://b.x\nnot a url\n")
    run = lambda *a: cli.main(["--config", str(tmp_path / "settings.json"), *a])
    run("populate_schema")
    run("populate_schema")
    run("seed", str(seeds))
    landed = [("gemini://a.x/", 20, "text/gemini", b"# A\n=> /p\n", stamp(1)), ("gemini://b.x/", 20, "image/png", b"\x89", stamp(1))]
    spark.createDataFrame(landed, tables.RESPONSES).write.parquet(f"file://{tmp_path}/landed")
    run("crawl", f"file://{tmp_path}/landed")
    pages = {r["url"]: r for r in tables.current(spark, root, "pages").collect()}
    assert set(pages) == {"gemini://a.x/", "gemini://b.x/", "gemini://a.x/p"} and pages["gemini://a.x/"]["title"] == "A" and pages["gemini://b.x/"]["size"] == 0
    run("purge", "gemini://a.x/%")
    run("indexstatus")
    assert "Deleted 2 pages" in (out := capsys.readouterr().out) and "1 pages in index" in out
    with pytest.raises(ValueError):
        config.load('{"nonsense": 1}')
    assert config.load("{}") == config.Settings()


def test_serving(spark):
    now = [0.0]
    kept, made = serving.Kept(lambda: now[0]), []
    one = lambda: made.append(1) or spark.range(3)
    first = kept.get("search", "cats", one)
    assert kept.get("search", "cats", one) is first and first.is_cached and len(made) == 1
    now[0] = 601
    assert kept.get("search", "cats", one) is not first and not first.is_cached and kept.get("api", "x", lambda: [1]) == [1]
    assert [serving.wait(n) for n in (0, 64, 65, 128, 640, 10_000)] == [None, None, 2, 4, 512, 512]
    assert serving.page_path("a+b") == "/search?a+b" and serving.page_path("a", 3, True) == "/v/search/3?a"
    assert serving.jump("a", "2") == "/search/2?a" and serving.jump("a", "1") == "/search?a" and serving.jump("a", "x") is None and serving.jump("a", "0") is None
    assert serving.next_run(dt.datetime(2024, 1, 3)) == dt.datetime(2024, 1, 7) and serving.next_run(dt.datetime(2024, 1, 2, 23)) == dt.datetime(2024, 1, 3)
