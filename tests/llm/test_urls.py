"""URL verdicts against SQL and a brute-force miner."""

import glob
import os
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from platen.llm import urlfilter
from platen.llm.queries import op3_url_rules

duckdb = pytest.importorskip("duckdb")

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://b.example.net/de/1.html", "http://example.com/de/", "http://xexample.com/de/q", "ftp://x.org/fr/a", "http://x.org/FR/a", "http://net/", "http://net", "http://x.net?/en/",
    "http://é.example.org/de/1#top", "http://a.b.c.d.e.example.com/en/é.html?utm=1&b=2", "http://x.net\n/a", "http://..net/a", "http://q.example.net/en", "http://q.example.net/en/", "://h.org/fr/", "http://user@x.org:80/fr/?a://b",
]


def sql_rows(table):
    con = duckdb.connect()
    con.register("arrow_pages", table)
    con.execute("create view pages as select * from arrow_pages")
    return con.execute(urlfilter.ORACLE).fetchall()


def test_odd_urls_match_sql(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(4, URLS[4], "x"), (None, URLS[5], "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urlfilter.verdicts(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, sql_rows(pages.toArrow())))
    by_id = {r.page_id: r for r in got}
    assert (by_id[4].host, by_id[4].path, by_id[4].rule, by_id[4].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (by_id[6].rule, by_id[7].rule, by_id[9].rule, by_id[11].rule) == ("example.com/de/", None, None, None)
    assert by_id[None].verdict == "block" and (by_id[0].host, by_id[0].path) == ("", "")


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = op3_url_rules(spark, "/root/testdata/sf0.001").select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, sql_rows(pages.toArrow())))
    assert urlfilter.verdicts(pages.filter(F.lit(False))).count() == 0
    unlabelled = spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string")
    assert urlfilter.verdicts(unlabelled).first().verdict == "allow"


def test_mined_rules_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labelled = urlfilter.explicit(urlfilter.parts(pages)).filter("rule is not null").select("tokens", "verdict")
    rows = [(frozenset(r.tokens), r.verdict) for r in labelled.collect()]
    want, seen, hits = {}, Counter(), Counter()
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                seen[frozenset(c)] += 1
                hits[frozenset(c), verdict] += 1
    for (s, v), n in hits.items():
        if n >= urlfilter.MIN_SUPPORT * len(rows) and n / seen[s] >= urlfilter.MIN_CONFIDENCE:
            want[s, v] = (n, n / seen[s])
    assert max(len(s) for s, _ in want) > 2
    got = {(frozenset(r.tokens), r.verdict): (r.hits, r.confidence) for r in urlfilter.mine(labelled).collect()}
    assert got == want
    # What is pruned never decides: of all rules that fit a set the best one stays.
    left = {(frozenset(r.tokens), r.verdict) for r in urlfilter.pruned(urlfilter.mine(labelled)).collect()}
    best = lambda rules, tokens: min(((-want[r][1], -want[r][0], -len(r[0]), " ".join(sorted(r[0])), r[1]) for r in rules if r[0] <= tokens), default=None)
    assert left < set(want) and all(best(left, t) == best(want, t) for t, _ in rows[:60])


def test_a_rule_of_three_tokens_decides(spark):
    """Blocked are only pages with ending, key and fragment together; any two of them are mostly allowed."""
    rows, k = [], 0
    for times, host, ending, key, mark in ((20, "a.net", ".php", "?ad=1", "#x"), (20, "a.org", ".php", "?ad=1", ""), (20, "a.org", ".php", "", "#x"), (20, "a.org", "", "?ad=1", "#x")):
        for _ in range(times):
            k += 1
            rows.append((k, f"http://{host}/fr/p{k}{ending}{key}{mark}"))
    rows += [(1000, "http://z.com/q.php?ad=2#y"), (1001, "http://z.com/q.php?ad=2")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.verdicts(pages).collect()}
    assert (got[1000], got[1001]) == ("block", "allow")
    assert {i: v for i, _, _, _, v in sql_rows(pages.toArrow())} == got


def test_no_python_in_the_plan(spark):
    plan = urlfilter.verdicts(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow")) and os.path.exists(glob.glob("/root/testdata/sf0.001/pages.parquet*")[0])
