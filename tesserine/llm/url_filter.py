"""Operator 7: URL filter by a blocked Bloom filter and an exact hash join, in Spark expressions.

Rules name a host and a path prefix and fit the host with its subdomains; the longest fitting
rule decides. A URL that no rule fits is looked up in a list of blocked canonical URLs: one word
of a blocked Bloom filter per URL (eight bits in a 64-bit block) lets possible hits pass, and a
hash join on the canonical URL itself drops those that the filter let through wrongly.

The filter is a table of blocks. The number of blocks follows the list and ends at MAX_BLOCKS,
so what is broadcast is at most MAX_BLOCKS rows of 16 bytes; a longer list only lets more URLs
pass to the join, whose answer stays exact.

A canonical URL is host and path: no scheme, user, port, query or fragment, lower-case host
without a final dot or leading www., unreserved percent escapes of ASCII taken back, slashes not doubled
and none at the end.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule, is
never listed, and is allowed. Repeated rows are judged each; nulls of the list are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table

MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 5
BITS = 8
#: The rules of the query, as verdict, host and path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


#: Escapes of letters, digits and - . _ ~ that canonical URLs take back.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def canonical(host: Column, path: Column) -> Column:
    """Canonical host and path; null without a host."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    own = F.regexp_replace(own, r"^www\.", "")
    unhex = lambda p: F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("long"))
    plain = lambda p: p.rlike("^[0-9A-Fa-f]{2}") & F.lit(UNRESERVED).contains(unhex(p))
    parts = F.transform(F.split(path, "%", -1), lambda p, i: F.when(i == 0, p).when(plain(p), F.concat(unhex(p), F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p)))
    decoded = F.when(F.instr(path, "%") > 0, F.array_join(parts, "")).otherwise(path)
    return F.when(own != "", F.concat(own, F.regexp_replace(F.regexp_replace(decoded, r"/+", "/"), r"/$", "")))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column) -> Column:
    """BITS bits of a 64-bit word, six bits of a second hash for each."""
    h = F.xxhash64(url, F.lit("mask"))
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom_table(listed: DataFrame, url: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The blocks in use (block, word) and how many blocks there are."""
    n = listed.count()
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n and blocks < max_blocks:
        blocks *= 2
    return listed.groupBy(_block(F.col(url), blocks).alias("block")).agg(F.bit_or(_mask(F.col(url))).alias("word")), blocks


def listed_hits(urls: DataFrame, listed: DataFrame, url: str = "canonical", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The distinct URLs of urls that listed holds, by filter and exact join."""
    own = listed.select(F.col(url)).where(F.col(url).isNotNull()).distinct()
    table, blocks = bloom_table(own, url, max_blocks)
    asked = urls.select(F.col(url)).where(F.col(url).isNotNull())
    probe = asked.withColumns({"block": _block(F.col(url), blocks), "mask": _mask(F.col(url))})
    maybe = probe.join(F.broadcast(table), "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select(url).distinct()
    return maybe.join(own, url, "left_semi")


def with_rules(pages: DataFrame, url: str = "url", rules=RULES, verdict: str = "rule_verdict", key: str = "canonical") -> DataFrame:
    """pages with host, path and rule, and with columns for the rule's verdict and the canonical URL; such columns are replaced."""
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, verdict: said, key: canonical(F.col("host"), F.col("path"))})


def filtered(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """pages with host, path, rule and verdict; such columns are replaced, others stay. listed has canonical URLs, in column canonical."""
    said, key, hit = (free_name(pages, n) for n in ("rule_verdict", "canonical", "hit"))
    judged = with_rules(pages, url, rules, said, key)
    open_url = F.col("rule").isNull() & F.col(key).isNotNull()
    unruled = judged.where(open_url)
    found = listed_hits(unruled.select(F.col(key).alias("canonical")), listed, max_blocks=max_blocks).select(F.col("canonical").alias(key), F.lit(True).alias(hit))
    # Only URLs that no rule fits, and that have a host, meet the hits; no other row is moved.
    decided = judged.where(~open_url).withColumn("verdict", F.coalesce(said, F.lit("allow")))
    rest = unruled.join(found, key, "left").withColumn("verdict", F.when(F.col(hit), "block").otherwise("allow")).drop(hit)
    return decided.unionByName(rest).drop(said, key)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of the pages that the rules block: a page that evades a rule by port, user, escape or doubled slash is found through it."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = with_rules(pages).where(F.col("rule_verdict") == "block").select("canonical")
    return filtered(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def _decoded_sql(c: str) -> str:
    for x in UNRESERVED:
        for code in dict.fromkeys((f"%{ord(x):02X}", f"%{ord(x):02x}")):
            c = f"replace({c}, '{code}', '{x}')"
    return c


OP7_SQL = rf"""
WITH s AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '^www\.', '') AS bare FROM u),
k AS (SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(regexp_replace({_decoded_sql("path")}, '/+', '/', 'g'), '/$', '') END AS canonical FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN canonical IN (SELECT canonical FROM k WHERE rule IN ('net/', 'example.com/de/') AND canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM k
"""
