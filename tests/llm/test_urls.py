import random
import re
from urllib.parse import quote

import pytest

from millrace.llm import registry, urls
from tests.llm.sql import same_as_sql


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    query = rest.split("#")[0].split("?", 1)[1] if "?" in rest.split("#")[0] else ""
    h = host.rsplit("@", 1)[-1]
    h = re.sub(r"\.*(:(80|443)?)?\Z", "", h)
    h = re.sub(r"^(www|m)\.", "", h)
    p = re.sub(r"(/index)?(\.html)?/?\Z", "", re.sub("/+", "/", path), count=1)
    kept = sorted(x for x in query.split("&") if x and not re.match(r"(utm_[a-z]+|ref|fbclid|gclid)(=|\Z)", x))
    return host, path, h + p + ("?" + "&".join(kept) if kept else "")


def verdict(url, listed, rules):
    host, path, key = plain(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        r = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)))
        return host, path, r.host + r.path, r.verdict
    return host, path, None, "block" if key is not None and key in listed else "allow"


def test_whole_table_against_sql(spark):
    same_as_sql(spark, "op13_url_filter")


def test_every_verdict_occurs(spark):
    got = registry.op13(spark, "/root/testdata/sf0.01").groupBy("rule", "verdict").count().collect()
    assert {(r.rule, r.verdict) for r in got} == {("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "block")}


def urls_of(n, seed):
    rng = random.Random(seed)
    hosts = ["a.org", "www.a.org", "m.a.org:443", "u@B.org.", "x.net", "net", "notnet", "é.org", ""]
    paths = ["", "/", "/fr/1", "//fr//1/", "/fr/1.html", "/index.html", "/q?b=2&a=1&utm_x=3", "/q?a=1&b=2#top", "/q?ref", "?z=1", "/" + quote("ü")]
    return [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.randrange(3) or ''}" for _ in range(n)]


@pytest.mark.parametrize("blocks", [1, 4, 1 << 17])
def test_random_urls_whatever_the_filter_holds(spark, monkeypatch, blocks):
    """A filter that is full passes everything; the exact join still decides."""
    monkeypatch.setattr(urls, "MOST_BLOCKS", blocks)
    pages = [*urls_of(1500, 1), None, "", "no scheme", "://", "a://b://c", "http://x.net\n/fr"]
    listed = [*urls_of(40, 2), None, "nothing", *urls_of(40, 2)]
    rules = (*urls.POLICY, urls.Rule("allow", "org", "/fr/1"), urls.Rule("block", "a.org", "/fr"))
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(pages)], "page_id long, url string, host string")
    got = urls.judge(table, spark.createDataFrame([(x,) for x in listed], "url string"), rules).collect()
    known = {plain(x)[2] for x in listed} - {None}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: verdict(u, known, rules) for i, u in enumerate(pages)}
    assert len(got) == len(pages)
    assert all(r.possible for r in got if r.verdict == "block" and r.rule is None)
    assert {r.canonical for r in got} == {plain(u)[2] for u in pages}


def test_filter_passes_few_others(spark):
    listed = spark.range(20_000).selectExpr("concat('http://a.org/', id) as url")
    pages = spark.range(20_000, 60_000).selectExpr("id as page_id", "concat('http://a.org/', id) as url")
    assert urls.judge(pages, listed, ()).where("possible").count() < 400
    assert urls.blocks_for(0) == 1 and urls.blocks_for(20_000) == 1024 and urls.blocks_for(10**12) == urls.MOST_BLOCKS


def test_repeats_empty_tables_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://A.org/x/#y")], "page_id long, url string")
    listed = spark.createDataFrame([("http://www.a.org/x.html",)], "url string")
    assert [r.verdict for r in urls.judge(pages, listed).collect()] == ["block"] * 3
    assert [r.verdict for r in urls.judge(pages, listed.limit(0)).collect()] == ["allow"] * 3
    assert urls.judge(pages.limit(0), listed).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages, listed, [urls.Rule("block", f"h{i}", "/") for i in range(1001)])


def test_no_python_in_the_plan(spark):
    plan = registry.op13(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
