from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions import gemtext as G
from lanternfish.functions import robots as R
from lanternfish.functions import sql
from lanternfish.functions import text as X
from lanternfish.functions import urls as U


def column(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", T.StringType())]))
    return [r["o"] for r in d.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse_url(spark):
    urls = ["gemini://example.com/", "gemini://Example.COM:1966/a/../b//c/.?x=1#f", "gemini://h", "//h/x", "x", "", None, "gem ini://h/", "gemini://.h/", "gemini://h:/", "gemini://h:99999/", "gemini://h:1966abc/", "http://h/a/b/..", "gemini://h/#a?b", "gemini://h?q"]
    u = column(spark, urls, U.parse_url)
    assert [x["good"] for x in u] == [True, True, True, True, False, False, False, False, False, False, False, True, True, True, True]
    assert (u[1]["host"], u[1]["port"], u[1]["path"], u[1]["param"], u[1]["fragment"]) == ("example.com", 1966, "/b/c/", "x=1", "f")
    assert u[2]["path"] == "/" and u[3]["protocol"] == "" and u[11]["port"] == 1966 and u[12]["path"] == "/a/"
    assert (u[13]["param"], u[13]["fragment"]) == ("", "a?b") and u[14]["host"] == "h?q"


def test_format_is_idempotent(spark):
    urls = ["gemini://example.com:1965/a/./b/../c/?q#f", "GEMINI://H/..//x", "http://h:81/"]
    once = column(spark, urls, lambda c: U.format_url(U.parse_url(c)))
    assert once == ["gemini://example.com/a/c/?q#f", "gemini://h/x", "http://h:81/"]
    assert column(spark, once, lambda c: U.format_url(U.parse_url(c))) == once


def test_compose_links(spark):
    base = U.parse_url(F.lit("gemini://h/dir/page.gmi?old"))
    out = column(spark, ["/abs", "rel", "../up/", "./x?y#z", "?q", "gemini://other/x", "//o/x"], lambda c: U.format_url(U.resolve_link(base, c)))
    assert out == ["gemini://h/abs", "gemini://h/dir/rel", "gemini://h/up/", "gemini://h/dir/x?y#z", "gemini://h/dir/page.gmi?q", "gemini://other/x", "gemini://o/x"]


def test_small_scalars(spark):
    assert column(spark, ["mailto:a@b", "gemini://x", "/a", ":x"], U.is_non_uri_action) == [True, False, False, True]
    assert column(spark, ["a b~c*d/ü"], U.encode_query) == ["a+b~c%2Ad%2F%C3%BC"]
    assert column(spark, ["gemini://a_b-c~d"], U.index_friendly) == ["gemini://a b c d"]
    assert column(spark, ["aaaa", "abc", "    ", "█", "(_-<", "ab 1111 x", "_ _ _ _"], X.is_ascii_art) == [True, False, False, True, True, True, True]
    assert column(spark, ["text/gemini; lang=en;charset=utf-8", " text/plain ", None], X.mime_type) == ["text/gemini", "text/plain", ""]
    assert column(spark, ["text/gemini; lang=en; charset = utf-8;x", "a"], X.mime_params) == [{"lang": "en", "charset": "utf-8"}, {}]
    assert column(spark, ["12", "1x", "", "-1"], X.unsigned) == [12, None, None, None]
    assert column(spark, ["it's \\ x"], X.escape_sql) == ["it''s \\\\ x"]
    assert column(spark, ["\n\n=> x\n y"], X.clean_preview) == ["x y"]
    assert X.xxh64_hex(b"Hello, World!") == "C49AACF8080FE47F"
    assert X.decode_bytes(b"a\xffb", None) == "ab" and X.decode_bytes("é".encode("latin-1"), "latin-1") == "é"


PATHS = [("/foo", "/foo", True), ("/foo/", "/foo", True), ("/foo/bar", "/foo", True), ("/foobar", "/foo", False), ("/f", "/", False), ("/foo/a", "/foo/", False), ("/foo/ab", "/foo/", True), ("/a/foo/b", "*foo*", True), ("/x.gif", "*.gif$", True), ("/cgi-bin/x", "/cgi-bin*", True), ("/ab/q/cd", "/ab*cd", True), ("/x", "", False), ("/a1b2c", "/a*b*c", True), ("/a/nope", "/a*zz", True)]


def test_path_rules(spark):
    for path, rule, blocked in PATHS:
        assert R.path_matches(rule, path) == blocked, (path, rule)
    d = spark.createDataFrame(PATHS, "path string, rule string, blocked boolean")
    assert d.where(R.rule_blocks(F.col("path"), F.col("rule")) != F.col("blocked")).count() == 0


def test_robots():
    assert R.disallowed("User-agent: *\r\nDisallow: /a\r\nDisallow: /b\n") == ["/a", "/b"]
    assert R.disallowed("User-agent: other\nDisallow: /a") == []
    assert R.disallowed("User-agent: other\nUser-agent: indexer\nDisallow: /a") == ["/a"]
    assert R.disallowed("Disallow: /x\nUser-agent: *\nDisallow:\nDisallow: /y") == ["/y"]
    assert R.disallowed(None) == []


def test_markup():
    n = G.parse_nodes("# Head\n=>\tgemini://x.y\t\tHello  \n=>gemini://z\n* list\n```alt\ncode\n```\nplain\n\n")
    assert [x.type for x in n] == ["heading1", "link", "link", "list", "preformatted_text", "text", "text"]
    assert (n[1].meta, n[1].text, n[2].text, n[4].text, n[4].meta) == ("gemini://x.y", "Hello", "", "code\n", "alt")
    assert [x.text for x in G.parse_nodes("\n\n")] == ["", ""]
    text, title, links = G.extract(G.parse_nodes("# T\n```\nart\n```\nhello\n-----\n=> /a b\n```ascii\nx\n```\n```code\nkept\n```\n###--###\n"))
    assert title == "T" and links == ["/a"] and "art" not in text and "-----" not in text and "kept" in text
    dated = "=> /1 2024-01-01 a\n=> /2 2024-01-02 b\ntext\n=> /3 2024-1-3\n"
    assert G.is_feed(G.parse_nodes(dated)) and not G.is_feed(G.parse_nodes(dated.replace("/3 2024", "/3 x")))
    assert G.is_feed(G.parse_nodes(dated), "h", "gemini") and not G.is_feed(G.parse_nodes(dated.replace("/2", "gemini://o/2")), "h", "gemini")


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "lf_path_matches" in names
    assert spark.sql("select lf_path_matches('/a*', '/abc') x, lf_xxh64_hex('Hello, World!') y").first() == (True, "C49AACF8080FE47F")


# every kind of rule: none, plain, folder, star at the start, the end, both, in the middle, twice, escaped
RULES = [("/", "/", True), ("/pub", "/", True), ("/pub", "/doc", False), ("/doc", "/docs", False), ("/doc", "/doc/", False), ("/doc/", "/doc", True), ("/doc/new/", "/doc", True), ("/doc/", "/doc/new", False), ("/doc.gmi", "/doc", False), ("/doc/a.gmi", "/doc", True), ("/doc/a.gmi", "/doc/*", True), ("/doc/a.gmi", "*.gmi", True), ("/doc/a.gmi", "*.wav", False), ("/doc/old/a.gmi", "*.gmi", True), ("/doc/old/a.gmi", "*.gmi$", True), ("/doc/old_ones/a.gmi", "*old_ones*", True), ("/doc/new_ones/a.gmi", "*old_ones*", False), ("/doc/new_ones/log/a.gmi", "/doc/*/log", True), ("/~ann/cig/a.gmi", "/~*/cgi/", True), ("/doc/1/log/2/end", "/doc/*/log/*/end", True), ("/doc/1/log/end", "/doc/*/log/*/end", False), ("/doc/1/log/end", "/doc/*/log/*", True), ("/doc", "/***", True), ("/doc/(", "/doc/(", True), ("/*/doc/*/.wav", "/pub/doc/log/1wav", False), ("/doc/\\*", "/doc/*", True)]


def test_all_kinds_of_rules(spark):
    for path, rule, blocked in RULES:
        assert R.path_matches(rule, path) == blocked, (path, rule)
    d = spark.createDataFrame(RULES, "path string, rule string, blocked boolean")
    assert d.where(R.rule_blocks(F.col("path"), F.col("rule")) != F.col("blocked")).count() == 0


def test_titles_are_cut_by_bytes(spark):
    long = ["a" * 1000, "a" * 1001, "é" * 1500, "a" + "é" * 1500, "日" * 400, "a🎉" * 300]
    for t, got in zip(long, column(spark, long, X.truncate_title)):
        cut = t.encode()[:1000].decode(errors="ignore")
        assert got == (t if len(t.encode()) <= 1000 else cut + "...")
    assert column(spark, [None, ""], X.truncate_title) == [None, ""]


def test_text_helpers(spark):
    assert column(spark, ["7", "123456789"], lambda c: X.left_pad(c, 8)) == ["       7", "123456789"]
    assert column(spark, ["ÀBc"], X.ascii_lower) == ["Àbc"]
    assert [int(x) for x in column(spark, ["FFFFFFFFFFFFFFFF", "0a", "", "xyz"], X.hash_number)] == [2**64 - 1, 10, 0, 0]


def test_feeds_of_a_host(spark):
    page = "=> {}/1 2024-01-01 a\n=> /2 2024-01-02 b\n=> /3 2024-01-03 c\n"
    d = spark.createDataFrame([(page.format(""), "h"), (page.format("gemini://o"), "h"), (page.format("gemini://o"), None)], "t string, host string")
    assert [r["x"]["is_feed"] for r in d.select(G.document_of(F.col("t"), host=F.col("host")).alias("x")).collect()] == [True, False, True]
