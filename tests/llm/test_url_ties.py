"""URL filters: entries of equal length, line ends in URLs, letters outside A-Z; both ways to look entries up."""

import duckdb
import pytest

from perilscope.llm import queries, urls


@pytest.mark.parametrize("max_bytes", [urls.MAX_BYTES, 0])
def test_of_equal_lengths_the_longer_path_wins(spark, max_bytes):
    rules = [("z.com/", "block", False), ("com/xy", "allow", False), ("q.org/a", "allow", True), ("org/a/b", "block", True), ("net/a\nb", "block", False)]
    entries = spark.createDataFrame(rules, "key string, verdict string, listed boolean")
    want = {
        "http://z.com/xy/1": ("com/xy", "allow"), "http://z.com/x": ("z.com/", "block"), "http://q.org/a/b": (None, "block"),
        "http://q.org/a": (None, "allow"), "x\n://w.net/a\nbc": ("net/a\nb", "block"), "http://w.net/a": (None, "allow"), None: (None, "allow"),
    }
    pages = spark.createDataFrame([(u,) for u in want], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, entries, max_bytes=max_bytes).collect()}
    assert got == want


def test_query_equals_its_sql_on_line_ends_and_other_letters(spark, tmp_path):
    texts = [
        "a\n://ads.com/", "http://ADS.com/x", "http://ads\n/x", "http://x-ads\n.com/", "http://\u212apills.com", "http://PILLS.\u0130.com/", "http://a.org/fr/b\nc",
        "x://spam", "://", "", None, "ads.com", "http://example.net/en/\n", "HTTP://A.NET/EN/",
    ]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, queries.op3_url_filters(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(queries.OP3_SQL).df()[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None))
    assert got == want
    assert dict((g[0], g[4]) for g in got)[0] == "block"
