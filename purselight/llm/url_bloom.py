"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

The Bloom filter is a table of 256-bit blocks (eight 32-bit words, one bit in each per URL), built by a partial
aggregate over the list. It has at most `most_blocks` blocks whatever the list's length, so it may be broadcast; a
longer list only lets more URLs pass it. URLs that pass go to an exact join with the list, which removes false
positives. The passing side is salted in that join, as one URL may hold many rows.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is allowed; empty and null
list entries are ignored; urls of any length are judged whole; of rules that fit equally long the first in order of text
holds; repeated pages are judged each; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the filter query: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SALTS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where `://` is missing."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(url: Column) -> Column:
    """Host without www., path without slashes at its end, query without tracking fields and in order; no fragment."""
    host, path = host_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref)(=|$)")))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""), F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. Of equally long ones, the first in order of text."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """Eight masks of one bit each, one per word of the block."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(8)]


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n).cast("long"))


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Filter of column url as rows (block, w0..w7); blocks without a URL are left out."""
    rows = listed.select(_block(F.col("url"), n_blocks).alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("url")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)))


def block_count(n_listed: int, bits_per_url: int = 12, most_blocks: int = 1 << 17) -> int:
    """Blocks for a list; at most most_blocks (4 MiB of bits), which bounds what is broadcast."""
    return max(1, min(most_blocks, -(-n_listed * bits_per_url // 256)))


def maybe(df: DataFrame, key: str, listed: DataFrame, most_blocks: int = 1 << 17, bits: int = 12) -> DataFrame:
    """df with a boolean column maybe: false only where key (null included) surely is not in column url of listed."""
    n = block_count(listed.count(), bits, most_blocks)
    probed = df.withColumn("block", _block(F.col(key), n)).join(F.broadcast(bloom_blocks(listed, n)), "block", "left")  # n rows of 40 bytes at most
    passed = reduce(lambda a, b: a & b, (F.col(f"w{k}").bitwiseAND(b) != 0 for k, b in enumerate(_bits(F.col(key)))))
    return probed.withColumn("maybe", F.coalesce(passed, F.lit(False))).drop("block", *(f"w{k}" for k in range(8)))


def matches(pages: DataFrame, listed: DataFrame, key: str = "canonical", bits_per_url: int = 12, most_blocks: int = 1 << 17) -> DataFrame:
    """pages with boolean columns maybe (passed the filter) and listed (is in the list). listed: column url."""
    listed = listed.select("url").where("url is not null and url <> ''").distinct()
    probed = maybe(pages, key, listed, most_blocks, bits_per_url)
    salted = listed.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).withColumn("listed", F.lit(True))
    hits = probed.where("maybe").withColumn("salt", F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int"))
    hits = hits.withColumnRenamed(key, "url_key").join(salted.withColumnRenamed("url", "url_key"), ["url_key", "salt"], "left").withColumnRenamed("url_key", key)
    columns = [*pages.columns, "maybe", F.coalesce("listed", F.lit(False)).alias("listed")]
    return hits.select(*columns).unionByName(probed.where("not maybe").select(*pages.columns, "maybe", F.lit(False).alias("listed")))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed. A rule's verdict holds; else listed URLs are blocked."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = matches(rows.withColumn("rule", rule).withColumn("by_rule", verdict), listed, **limits)
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")


def labelled_toxic(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages whose path names, as a number, a document labelled toxic."""
    path = host_path(F.col("url"))[1]
    named = pages.select(canonical(F.col("url")).alias("url"), F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long").alias("doc_id"))
    return named.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("url")
