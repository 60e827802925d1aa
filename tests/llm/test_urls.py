import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxpanel.llm import sql, urls

FOLDER = "/root/testdata/sf0.001"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def canonical(url):
    if url is None or "://" not in url:
        return None
    host, path = parts(url)
    host = re.sub(r"\.\Z", "", re.sub(r":(80|443)\Z", "", host)).removeprefix("www.")
    rest = url.split("://", 1)[1].split("#")[0]
    asked = rest.split("?", 1)[1].split("&") if "?" in rest else []
    told = sorted(p for p in asked if p and not p.startswith("utm_") and p.split("=")[0] not in ("ref", "fbclid", "gclid"))
    return host + path.rstrip("/") + ("?" + "&".join(told) if told else "")


def brute(rows, listed, rules=urls.RULES):
    on_list = {canonical(u) for u in listed} - {None}
    out = []
    for k, url in rows:
        host, path = parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        found = canonical(url) in on_list
        out.append((k, host, path, rule.name if rule else None, rule.verdict if rule else "block" if found else "allow", found))
    return sorted(out, key=str)


ODD = [
    None, "", "no scheme", "http://", "://", "http://net/", "http://NET/x", "http://net", "http://a.net?x", "http://anet/", "https://Example.NET/en/1", "ftp://x.example.net/en", "http://example.com/de/",
    "http://www.example.com:80/fr/", "http://example.com/fr", "http://example.com./fr//#f", "http://a.org/fr/?q=1&utm_source=x&a=2", "http://a.org/frx?a=2&q=1", "a://b://c/d", "http://h.com/p\nq?x\ny#z",
    "http://h.com/p?ref=1&b=2&&a=1", "https://www.h.com/p/?a=1&b=2#top", "http://É.com/É", "http://h.com/" + "p" * 50000, "http://h.com?x=http://other.net/",
]


def judged(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [urls.BROADCAST_BLOCKS, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", limit)
    rng = random.Random(2)
    rows = list(enumerate(ODD))
    for k in range(600):
        host = rng.choice(["a.example.net", "www.b.com", "b.com", "c.example.org", "spam.com", "example.com"])
        rows.append((100 + k, f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(0, 60)}{rng.choice(['', '/', '?utm_a=1', '?p=2', '#x'])}"))
    rows += [(None, "http://spam.com/en/1"), (7, "http://b.com/en/1")] + [(9000, "http://b.com/en/7")] * 300
    listed = [u for _, u in rows if u and "spam" in u] + ["https://b.com/en/7/", None, "nothing", "http://www.h.com/p?b=2&a=1", "http://never.com/"]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    got = judged(urls.filter_urls(df, spark.createDataFrame([(u,) for u in listed], "url string")))
    assert got == brute(rows, listed) and sum(r[5] for r in got) > 50


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(20000).select(F.concat(F.lit("http://h.com/"), "id").alias("url"))
    pages = spark.range(60000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h.com/"), "id").alias("url"))
    out = urls.filter_urls(pages, listed, ())
    got = out.agg(*[F.count_if(F.expr(e)) for e in ("listed", "listed and not passed", "passed and not listed", "listed <> (page_id < 20000)", "(verdict = 'block') <> listed")]).first()
    assert tuple(got)[:2] == (20000, 0) and got[2] < 0.015 * 40000 and tuple(got)[3:] == (0, 0)


def test_nothing_and_columns_of_any_name(spark):
    pages = spark.createDataFrame([("a", "http://x.net/", 1, 2, 3)], "page_id string, url string, rule int, block int, listed int").toDF("page_id", "url", "rule", "a.b`c", "w0")
    none = spark.createDataFrame([], "url string")
    out = urls.filter_urls(pages, none)
    assert out.columns == ["page_id", "url", "a.b`c", "w0", "host", "path", "rule", "verdict", "listed", "passed"]
    assert tuple(out.first()) == ("a", "http://x.net/", 2, 3, "x.net", "/", "net/", "block", False, False)
    assert urls.filter_urls(pages.limit(0), pages).count() == 0 and urls.filter_urls(pages, pages, ()).first()["verdict"] == "block"


@pytest.mark.parametrize("table", ["pages", "odd"])
def test_matches_sql(spark, table):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet") if table == "pages" else spark.createDataFrame([(k, u and u.replace("h.com", "spam-farm.com")) for k, u in enumerate(ODD)], "page_id long, url string")
    con, got = duckdb.connect(), urls.url_digest(pages).toPandas()
    con.register("pages", pages.toPandas())
    expected = con.sql(sql.URLS).df()
    order = lambda df: df[sorted(df.columns)].sort_values("page_id", ignore_index=True)
    pd.testing.assert_frame_equal(order(got), order(expected), check_dtype=False)
    assert got["listed"].any() and (table == "odd" or set(got["verdict"]) == {"allow", "block"})
