"""Each catalogue query on the smallest tables against its SQL, where the tables are there."""

import json
import os

import duckdb
import pytest

from lanternfish.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ["token_tf_documents", "search_single_term", "search_all_terms", "score_fusion", "exact_dup_groups", "filter_or_and", "filter_not", "page_n_of_results", "url_parts", "extract_links", "compose_root_relative_links", "backlink_counts", "edge_multiset", "degrees", "stat_content_type", "known_hosts_lower", "index_status_stale", "redirect_chain_5", "change_detection_skip", "redirect_upsert", "path_repeat_guard", "robots_prefix_block", "mime_parse"]


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    sql = c.sql(catalogue.ORACLES[name])
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(x) for x in cols]
    assert sorted([plain(r[x]) for x in cols] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in sql.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_json_report_of_all_rows(spark):
    hosts = {r["source"] + ".test" for r in catalogue.read(spark, DATA, "documents").select("source").distinct().collect()}
    got = json.loads(catalogue.QUERIES["json_known_hosts"](spark, DATA).first()["json"])
    assert {x["domain_name"] for x in got} == hosts and len(got) == len(hosts)
    test_same_rows(spark, "json_known_hosts")


def test_every_query_is_named():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 50


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_preview_of_every_document(spark):
    docs = {r["doc_id"]: r["text"] for r in catalogue.read(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["preview"] for r in catalogue.QUERIES["previews"](spark, DATA).collect()}
    assert got.keys() == docs.keys() and len(got) > 10
    for i, text in docs.items():
        plain = " ".join(catalogue.S.headline(text, [catalogue.TERM]).split())
        assert got[i] == plain.lstrip("`*=># ")


MORE = ["search_cover_density", "dedup_same_host_or_path", "previews", "markup_documents", "json_pages", "title_truncate", "blacklist_rules", "blacklist_prefixes", "robots_blocked", "should_crawl_urls", "frontier_due", "frontier_leases", "robots_due", "robots_freshness", "robots_status_upsert", "crawl_enqueue", "crawl_links", "change_two_hashes", "cross_site_links", "mark_blocked", "normal_pages", "normal_links", "extract_kinds", "seed_new", "title_clean", "text_forms", "binary_guard", "text_scalars", "input_links", "markup_statistics", "markup_backlinks", "salsa_to_end"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", MORE)
def test_same_rows_too(spark, name):
    test_same_rows(spark, name)
    # the smallest tables have no page for some of the rules
    assert name in ("blacklist_prefixes", "robots_blocked", "should_crawl_urls") or catalogue.QUERIES[name](spark, DATA).count() > 0


def pages_of(tmp_path, monkeypatch, *urls):
    """Pages of these urls, numbered from 0, as the table that test_same_rows reads."""
    monkeypatch.setitem(globals(), "DATA", str(tmp_path))
    rows = ", ".join(f"({i}, '{u}', '')" for i, u in enumerate(urls))
    duckdb.sql(f"copy (select page_id::bigint as page_id, url, html from (values {rows}) v(page_id, url, html)) to '{tmp_path}/pages.parquet' (format parquet)")


def test_redirects_of_urls_that_several_pages_have(spark, tmp_path, monkeypatch):
    # b leads to d by c and to g by e and f, a to j by h and i and to g by b: one row a url, the end of the longer way
    pages_of(tmp_path, monkeypatch, *(f"http://{x}.test/" for x in "abcdbefgahij"))
    test_same_rows(spark, "redirect_chain_5")


def test_redirects_of_equally_long_ways(spark):
    # the SQL leaves open which of them counts
    urls, to = spark.createDataFrame([("a",), ("a",), ("b",)], "url string"), spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "from_url string, to_url string")
    assert sorted(map(tuple, catalogue.L.follow_redirects(urls, to).collect())) == [("a", "c", 1), ("b", "b", 0)]


def test_links_of_pages_that_share_a_url(spark, tmp_path, monkeypatch):
    # pages 0, 1 and 5 have one url: their own, peer and port links are the same, the other ones of 0 and 5 too
    pages_of(tmp_path, monkeypatch, *(f"https://{x}.test/en/1" for x in "aabcda"))
    test_same_rows(spark, "cross_site_links")


def test_upsert_of_redirects_of_pages_that_share_a_url(spark, tmp_path, monkeypatch):
    # x.test/2 is updated on pages 0 and 4, x.test/1 stays on 1 and 5
    pages_of(tmp_path, monkeypatch, *(f"http://x.test/{x}" for x in "21342156"))
    test_same_rows(spark, "redirect_upsert")


def test_seeds_of_pages_that_share_a_url(spark, tmp_path, monkeypatch):
    # pages 1, 3 and 5 have the same seed, pages 0 and 2 one url, and page 4 is a seed's url
    pages_of(tmp_path, monkeypatch, "http://b.test/", "http://a.test/en/1", "http://b.test/", "http://a.test/en/1#top", "http://a.test/en/1?seed", "http://a.test/en/1", "http://c.test/", "http://c.test/?x")
    test_same_rows(spark, "seed_new")
