"""Forms of canonical links and redirects, resolved with built-in columns, against urllib and the query's SQL."""

import random
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from sitelake.core import DataContractError
from sitelake.llm import queries
from sitelake.llm.url_filter import judge_urls, page_links, resolved, rule_table

PAGE = "https://Shop.com/a/b/page.html?x=1#top"
FORMS = {
    '<link rel="canonical" href="../../de/q">': "https://Shop.com/de/q",
    "<link rel=canonical href=/x/../de/q>": "https://Shop.com/de/q",
    "<LINK href='?p=2' REL='alternate canonical'>": "https://Shop.com/a/b/page.html?p=2",
    '<link rel="canonical" href="&#47;de&#x2F;q&amp;r=&#233;">': "https://Shop.com/de/q&r=é",
    '<base href="https://o.com/de/sub/"><link rel="canonical" href="q">': "https://o.com/de/sub/q",
    '<link rel="canonical" href="./q"><base target="_top"><base href="/de/"><base href="/no/">': "https://Shop.com/de/q",
    '<meta http-equiv="Refresh" content="0; URL=\'../../de/\'">': "https://Shop.com/de/",
    "<meta content=5;url=//o.com/de http-equiv=refresh>": "https://o.com/de",
    '<link rel="canonical" href="https://o.com/./a/../../de/.?q=/../#f">': "https://o.com/de/?q=/../#f",
    '<link rel="canonical" href="#part">': None, '<link rel="canonical" href="mailto:a@b.c">': None, '<link rel="canonical" href="">': "none at all",
    '<link rel="canonicals" href="/de/q">': "none at all", '<link data-rel="canonical" href="/de/q">': "none at all", '<meta http-equiv="refresh" content="5">': "none at all",
    '<linker rel="canonical" href="/de/q">': "none at all", '<link rel="canonical" href="&#0;&#55296;&#1114112;&bogus;">': "https://Shop.com/a/b/&#0;&#55296;&#1114112;&bogus;",
}


def test_forms_of_links(spark):
    pages = spark.createDataFrame([(PAGE.replace("#top", f"#{i}"), h) for i, h in enumerate(FORMS)], "url string, html string")
    got = {r.from_url.split("#")[1]: r.to_url for r in page_links(pages).collect()}
    for i, (html, want) in enumerate(FORMS.items()):
        assert got.get(str(i), "none at all") == want, html


def test_references_resolve_as_urllib_does(spark):
    rnd = random.Random(4)
    parts = ["a", "b.c", "..", ".", "", "de", "x;y", "é"]
    bases = ["https://h.com", "https://h.com/", "http://h.com/a/b", "http://h.com/a/b/?q=/x/", "http://h.com/a/../b/c#f"]
    cases = []
    for _ in range(300):
        path = "/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) or "z"
        ref = rnd.choice(["", "/", ""]) + path.lstrip("/") + rnd.choice(["", "?q=1/../2", "#f"])
        cases.append((rnd.choice(bases), ref or "z"))
    df = spark.createDataFrame(cases, "base string, ref string")
    for r in resolved(df, "ref", "base", "got").collect():
        if "//" not in r.ref and not r.ref.startswith(("?", "#")):  # urllib drops some empty segments
            assert r.got == urljoin(r.base, r.ref), (r.base, r.ref)


def test_planted_links_agree_with_the_sql(spark, tmp_path):
    """Chains of all forms; what is blocked in Spark is blocked in SQL, and the aliases of blocked pages are."""
    rnd = random.Random(6)
    rows = [(i, f"https://s{i % 5}.net/a/b/{i}", rnd.choice([*FORMS, "", None])) for i in range(150)]
    rows += [(200 + i, f"https://c.net/{i}", f'<link rel="canonical" href="{i + 1}">') for i in range(40)] + [(240, "https://c.net/40", '<meta http-equiv=refresh content="0;url=http://x.com/de/">')]
    rows += [(300, PAGE, '<link rel="canonical" href="../../de/q">'), (301, "https://Shop.com/fr/x", '<link rel="canonical" href="/de/q">'), (None, None, '<link rel=canonical href="http://x.com/de/">'), (302, "", "")]
    rows += [(400 + i, "https://shop.com/" + "a/../" * i + "p", h) for i, h in enumerate(FORMS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in queries.QUERIES["op10_url_filter"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted((str(a), b, c, str(d), e) for a, b, c, d, e in con.execute(queries.ORACLES["op10_url_filter"]).fetchall())
    assert got == want
    verdicts = {r[0]: r[4] for r in got}
    assert {verdicts[str(200 + i)] for i in range(41)} == {"block"} and verdicts["300"] == "block" and verdicts["301"] == "allow"


def test_too_many_rule_lengths_fail(spark, monkeypatch):
    import sitelake.llm.url_filter as u

    monkeypatch.setattr(u, "SMALL_RULES", 2)
    pages = spark.createDataFrame([(1, "http://a.b/c", "")], "page_id long, url string, html string")
    rules = rule_table(spark, [("block", "b", "/" + "c" * i) for i in range(4)])
    with pytest.raises(DataContractError):
        judge_urls(pages, rules)
