"""Operators with SQL, against DuckDB; url filters and quality rules on edge cases."""

import duckdb
import pytest

from hubrisk.llm import quality_rules as Q
from hubrisk.llm import queries
from hubrisk.llm import url_templates as U

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    assert got == sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=key)


def test_quality_counts_of_edge_cases(odd, nothing):
    rows = {r.doc_id: r for r in Q.quality_rules(odd.drop("n")).collect()}
    assert [(rows[i].n_words, rows[i].word_chars, rows[i].n_lines, rows[i].kept) for i in (1, 2, 3)] == [(0, 0, 0, False)] * 3
    assert rows[5].n_words == 20_000 and rows[6].n_dup_lines == 2 and rows[6].n_repeat_words == 9
    assert Q.quality_rules(nothing).count() == 0
    kept = Q.keep(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == []  # LONG has no stop words


def test_repeated_windows_and_leading_space_lines(spark):
    text = "x x x x x\n  a\na\n a"
    r = Q.metrics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.n_lines) == (8, 5, 0, 4)


def test_quality_needs_no_python(spark):
    plan = queries.QUERIES["op1_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.com/en/1?x#y", "http://example.com/en/1", "http://a.example.com/EN/1", "http://b.net/es/", "b.net/es/",
            None, "", "http://com", "http://x.com", "http://notcom/en/", "ftp://a.net/fr/x://y", "http://h?q=://z/en/", "http://B.ORG/a b\nc"]
    rows = [(i, u, "extra") for i, u in enumerate(urls)] + [(0, urls[0], "again"), (None, urls[1], "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "url_key string, bad boolean")
    got = U.url_filter(pages, labels).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[1] == ("example.com", "/en/1", "example.com/en/", "block") and by[None] == by[1]
    assert by[2] == ("a.example.com", "/EN/1", "com/", "allow") and by[3] == ("b.net", "/es/", "net/es/", "block")
    assert by[4] == by[5] == by[6] == ("", "", None, "allow")
    assert by[7] == ("com", "", None, "allow") and by[8] == ("x.com", "", None, "allow") and by[9][2] is None
    assert by[10] == ("a.net", "/fr/x://y", "net/fr/", "block") and by[11] == ("h", "", None, "allow")
    assert by[12] == ("b.org", "/a b\nc", None, "allow")
    assert U.url_filter(pages.limit(0), labels).count() == 0


def test_impure_templates_are_rejected(spark):
    rows = [(i, f"http://s.org/spam/item-{i}.html") for i in range(60)] + [(100 + i, f"http://s.org/news/2024-01-01/{i + 100}") for i in range(60)]
    rows += [(200 + i, f"http://s.org/{chr(97 + i % 26)}{chr(97 + i // 26)}q/z") for i in range(90)]  # fan-out: one wildcard
    labels = spark.createDataFrame([(f"item-{i}", True) for i in range(30)] + [(str(i + 100), False) for i in range(60)], "url_key string, bad boolean")
    got = {r.page_id: r.verdict for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(100, 160)} == {"allow"}
    assert {got[i] for i in range(200, 290)} == {"allow"}
