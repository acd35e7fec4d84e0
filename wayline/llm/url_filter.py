"""URL filter: a blocked Bloom filter of listed URLs in front of an exact join.

A list holds rules (host, path, verdict). A rule fits its host and all subdomains when the URL's path starts with the
rule's path; the longest fitting rule decides. In canonical form a rule is one string, host + path. A URL has
few strings that could be listed: each suffix of its host, with as much of its path as some rule is long. Those
strings are probed in the filter (bits of one key lie in one 512-bit block: one cache line a probe), and only possible
hits reach the hash join with the list, which removes the false positives.

The filter is sent to every executor, so its size is bounded (`max_filter_bytes`); a longer list makes more false
positives, never a wrong verdict. The list itself is never broadcast by a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_FILTER_BYTES, bloom_words, possible
from .shared import stage


def url_host(url: Column) -> Column:
    """Host after the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives an empty one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict.

    listed: (host, path, verdict), verdict allow or block. The longest rule string wins; of equally long ones the one
    with the longer host; of equal strings, block. A URL that no rule fits gets `default` and a null rule. Null
    or malformed URLs have an empty host, which only a rule with an empty host fits. Rows with null host or path in
    the list are left out. Repeated rows each get their verdict.
    """
    rules = listed.where("host is not null and path is not null").groupBy("host", "path").agg(F.min(F.when(F.col("verdict") == "block", F.lit(0)).otherwise(F.lit(1))).alias("__v"))
    rules = stage(rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("__hl"), F.when(F.col("__v") == 0, "block").otherwise("allow").alias("__rv")), "rules")
    # Path lengths and labels that occur in rules: no more of them than the longest rule is long, however many rules there are.
    lengths = sorted(r[0] for r in rules.select((F.length("rule") - F.col("__hl")).alias("l")).distinct().collect())
    labels = rules.agg(F.max(F.size(F.split(F.substring(F.col("rule"), F.lit(1), F.col("__hl")), r"\."))).alias("n")).first()[0] or 1
    words = bloom_words(rules.select("rule").distinct(), "rule", max_filter_bytes)

    d = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    seen = d.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - (labels - 1)), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    probes = seen.select("host", "path", F.explode(suffixes).alias("__suffix"))
    probes = probes.select("host", "path", "__suffix", F.explode(F.filter(F.from_json(F.lit(str(lengths)), "array<int>"), lambda k: k <= F.length("path"))).alias("__l"))
    probes = probes.select("host", "path", F.length("__suffix").alias("__hl"), F.concat("__suffix", F.substring(F.col("path"), F.lit(1), F.col("__l"))).alias("rule"))
    hits = possible(probes, "rule", words)
    fits = hits.join(rules, ["rule", "__hl"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("l"), "__hl", "rule", "__rv")).alias("__b"))
    # Written first, so that the join with all rows is one of two plain tables and a URL on very many rows can be split.
    best = stage(best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("__b.rule").alias("rule"), F.col("__b.__rv").alias("verdict")), "best")
    out = d.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").drop("__host", "__path")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
