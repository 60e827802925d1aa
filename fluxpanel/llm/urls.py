"""URL filters (operator 12): a blocked Bloom filter before an exact hash join.

Rules on hosts and paths come first.  What no rule decides is blocked if its
canonical URL is listed.  The list may have any size: its Bloom filter is a table of
blocks of 256 bits, made by one aggregate (a URL's block by its hash, a bit-wise or
of eight bits), and every URL of a page is tested against one block.  Only URLs that
pass, the listed ones and about one in 200 others, go to the exact join with the
list, which removes the false ones.  A filter of bounded size is broadcast, so pages
are not moved; beyond that blocks are joined by a shuffle of hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, named, plain, small_side

#: Bits of a block and of the filter for each listed URL; words of a block.
BLOCK_BITS, URL_BITS, WORDS = 256, 12, 4

#: Blocks up to which a filter is broadcast: 16 MB of bits.
BROADCAST_BLOCKS = 1 << 19

#: Query parameters that do not change a page, and those that begin so.
IGNORED, IGNORED_PREFIX = ("ref", "fbclid", "gclid"), "utm_"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query, by host and path.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """From the first :// up to a slash, a question mark, a hash or the end, with A-Z
    lower-cased; empty for null and without ://."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to a question mark, a hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form of the URLs of a page: without scheme, www., default ports, a dot after
    the host, slashes at the end, fragment and parameters that only track; other
    parameters in order.  Null for null and without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"\.$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    asked = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&", -1)
    told = F.filter(asked, lambda p: (p != "") & ~p.startswith(IGNORED_PREFIX) & ~F.substring_index(p, "=", 1).isin(*IGNORED))
    told = F.array_join(F.array_sort(told), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(told != "", F.concat(F.lit("?"), told)).otherwise("")))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(name, verdict) of the longest rule that fits (of two as long, the first), or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(url: Column, k: int) -> Column:
    """The two bits of a URL in word k of its block."""
    h = F.xxhash64(url, F.lit("bits"))
    one = lambda q: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * q).bitwiseAND(F.lit(63)).cast("int"))
    return one(2 * k).bitwiseOR(one(2 * k + 1))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, ... w3) of the distinct canonical URLs in `listed` (canonical).
    Blocks without a bit are left out."""
    bits = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), *[_bits(F.col("canonical"), k).alias(f"w{k}") for k in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def blocks_for(listed: int) -> int:
    return max(1, -(-listed * URL_BITS // BLOCK_BITS))


def passing(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """`rows` (canonical and others) with `passed`: whether the filter holds all bits."""
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
    met = keyed.join(small_side(bloom, blocks, BROADCAST_BLOCKS), "block", "left")
    holds = F.lit(True)
    for k in range(WORDS):
        bits = _bits(F.col("canonical"), k)
        holds = holds & (F.col(f"w{k}").bitwiseAND(bits) == bits)
    return met.withColumn("passed", F.coalesce(F.col("canonical").isNotNull() & holds, F.lit(False))).drop("block", *[f"w{k}" for k in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`pages` (url and any other columns) with host, path, rule (its host and path, or
    null), verdict (allow or block), listed (whether its canonical URL is in `listed`)
    and passed (whether it passed the Bloom filter).

    `listed` has a column url, in any form and any number of times.  A null url, or one
    without ://, has an empty host and path, meets no rule and is never listed, so it is
    allowed; repeated rows are judged alike; empty tables of pages stay empty, an empty
    list blocks nothing.  Columns of these names are replaced."""
    pages, own = plain(pages, ("host", "path", "rule", "verdict", "listed", "passed"), ("url",))
    inner = pages.columns
    on_list = materialise(listed.select(canonical(F.col("url")).alias("canonical")).filter("canonical is not null").distinct())
    n = on_list.count()
    blocks = blocks_for(n)
    rows = pages.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rows = rows.withColumn("met", rule_of(F.col("host"), F.col("path"), rules))
    tested = passing(rows, bloom_filter(on_list, blocks), blocks)
    possible = tested.filter("passed")
    # Of the list only what some page may be, each once; pages that passed meet it.
    asked = possible.select("canonical").distinct()
    confirmed = materialise(on_list.join(asked, "canonical", "left_semi"))
    n_confirmed = confirmed.count()
    hits = possible.join(small_side(confirmed.withColumn("listed", F.lit(True)), n_confirmed, 100_000), "canonical", "left")
    out = hits.unionByName(tested.filter("not passed").withColumn("listed", F.lit(None).cast("boolean")))
    found = F.coalesce("listed", F.lit(False))
    by_method = F.when(found, "block").otherwise("allow")
    return named(out.select(*inner, "host", "path", F.col("met.name").alias("rule"), F.coalesce("met.verdict", by_method).alias("verdict"), found.alias("listed"), "passed"), own)


#: Labels of hosts whose pages the query's list is made of.
LISTED_LABELS = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills")


def listed_pages(pages: DataFrame, labels: tuple[str, ...] = LISTED_LABELS) -> DataFrame:
    """(url) of the pages whose host has one of the labels: a list that grows with them."""
    return pages.select("url").filter(F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.array(*[F.lit(x) for x in labels])))


def url_digest(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url"), listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")
