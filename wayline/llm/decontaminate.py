"""Benchmark decontamination: windows of documents that repeat a benchmark item, by SimHash.

Each item and each window of as many words gets a 64-bit SimHash over its shingles (`SHINGLE` words, weighted by how often
each occurs). Fingerprints are cut into BLOCKS blocks of 16 bits. Two within the radius differ in 3 bits at most of some block
(15 bits over 4 blocks), so an item's blocks with up to 2 bits flipped and a window's with up to 1 flipped meet: joining on
(size, block number, block) finds every pair within the radius, and few others. Candidates are verified by the exact weighted
Jaccard similarity of their shingles. Texts with 0.8 of their shingles in common are 10 bits apart on average, so the
radius misses about one in forty of those just at 0.8, and hardly any closer ones; the tests measure it.

The windows of an item's size are those aligned with it: at least one shingle stands in the same place in both. Where an
aligned one would stick out of the text it is moved to the edge, and a text of fewer words than the item is a window as a whole.
Windows with no shared shingle have similarity 0, and those beside an aligned one repeat less of the item than it does, unless
the item's parts stand in another order. So windows that no aligned leak of the item overlaps are tried as well, if they
begin with a shingle of the item or end the text (moving any other to the next such start loses no shared shingle) and hold
as many of its shingles as the similarity needs. Only DataFrame expressions are used.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS = 4, 16
#: Bits flipped in the blocks of an item and of a window, and the distance within which their pairs are found for sure.
ITEM_FLIPS, WINDOW_FLIPS = 2, 1
RADIUS = BLOCKS * (ITEM_FLIPS + WINDOW_FLIPS + 1) - 1
#: Counters of two bits of the fingerprint share a long, 32 bits each: enough for any text.
PER_LANE, LANE_BITS = 2, 32
LANES = 64 // PER_LANE


def _hashes(text: str = "text") -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, size: Column, k: int) -> Column:
    """Hashes of all runs of k words; none in a text with fewer."""
    n = size - (k - 1)
    runs = F.slice(words, F.lit(1), n)
    for j in range(1, k):
        runs = F.zip_with(runs, F.slice(words, F.lit(j + 1), n), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprint_lanes(h: Column) -> list[Column]:
    """The 64 bits of a hash spread over longs, ready to be summed."""
    return [reduce(lambda a, b: a + b, [F.shiftleft(F.shiftrightunsigned(h, lane * PER_LANE + j).bitwiseAND(F.lit(1)), j * LANE_BITS) for j in range(PER_LANE)]) for lane in range(LANES)]


def fingerprint(sums: list[Column], total: Column) -> Column:
    """Bit b is set if most of the weight has it set."""
    bits = []
    for lane, s in enumerate(sums):
        for j in range(PER_LANE):
            n = F.shiftrightunsigned(s, j * LANE_BITS).bitwiseAND(F.lit(2**LANE_BITS - 1))
            bits.append(F.shiftleft((n * 2 > total).cast("long"), lane * PER_LANE + j))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def with_fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h) rows, a shingle each, to (keys, fp, total)."""
    sums = shingles.groupBy(*keys).agg(F.count("*").alias("total"), *[F.sum(x).alias(f"__{k}") for k, x in enumerate(fingerprint_lanes(F.col("h")))])
    return sums.select(*keys, "total", fingerprint([F.col(f"__{k}") for k in range(LANES)], F.col("total")).alias("fp"))


def blocks(fp: Column, flips: int) -> Column:
    """The blocks that tile the 64 bits, each with up to `flips` of its bits changed, as (block, bits)."""
    masks = F.from_json(F.lit(str([sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(BLOCK_BITS), n)])), "array<int>")

    def flipped(k: int) -> Column:
        own = F.shiftrightunsigned(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        return F.transform(masks, lambda mask: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(mask).alias("bits")))

    return F.concat(*map(flipped, range(BLOCKS)))


def item_shingles(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(item_id, m, k, place, h) of each item with words: m words, shingles of k words or the whole item if it is shorter."""
    d = benchmark.select("item_id", _hashes().alias("w")).withColumn("m", F.size("w")).where("m > 0").dropDuplicates(["item_id", "w"])
    short = [F.when(F.col("m") == j, _shingles(F.col("w"), F.col("m"), j)) for j in range(1, k)]
    d = d.withColumn("s", F.coalesce(*short, _shingles(F.col("w"), F.col("m"), k)))
    return d.select("item_id", "m", F.least("m", F.lit(k)).alias("k"), F.posexplode("s").alias("place", "h"))


def _keyed(benchmark: DataFrame) -> DataFrame:
    """benchmark with a key for each item: its id after a sign, or a hash of its text where it has none."""
    return benchmark.withColumn("item_id", F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.concat(F.lit("?"), F.sha2("text", 256)))).where("item_id is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, words, hamming, similarity): windows that repeat an item, start counted in words from 0.

    Nulls and empty texts leak nothing; items without words are left out; items without an id count, one for each text, and
    have a null item_id in the result; rows with one doc_id are one document each,
    and equal rows give each window once. Words are compared with A-Z in lower case.
    """
    kind = benchmark.schema["item_id"].dataType
    items = stage(item_shingles(_keyed(benchmark), k), "items")
    fps = with_fingerprints(items, ["item_id", "m"])
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most SHINGLE values
    d = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("thash"), _hashes().alias("w")).withColumn("n", F.size("w"))
    found = []
    for j in sizes:
        here = d.withColumn("s", _shingles(F.col("w"), F.col("n"), j)).select("doc_id", "thash", "n", F.posexplode_outer("s").alias("at", "h"))  # outer: an inner one adds a filter that repeats the work below
        found.append(here.join(items.where(F.col("k") == j).select("h").distinct(), "h").select("doc_id", "thash", "n", F.lit(j).alias("k"), "at", "h"))
    if not found:
        found = [docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("thash"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h"))]
    # Shingles of texts that some item has.
    hits = stage(reduce(DataFrame.unionByName, found).distinct(), "hits")
    marks = items.groupBy("k", "h", "m", "place").agg(F.count("*").alias("__n")).drop("__n")
    size = lambda words: words - F.col("k") + 1
    fits = size(F.least("n", "m")) + 1e-9 >= similarity * size(F.col("m"))  # only texts shorter than the item may not
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), F.col("n") - F.col("m")))
    windows = stage(hits.join(marks, ["k", "h"]).where(fits).select("doc_id", "thash", "m", start.alias("start")).distinct(), "windows")
    aligned = stage(_similar(docs, windows, items, fps, sizes, k, similarity), "aligned")
    # The windows at hits that hold enough of them: the last of those needed stands within the window.
    need = F.greatest(F.lit(1), F.ceil(2 * similarity / (1 + similarity) * size(F.col("m")) - 1e-9)).cast("int")
    own = items.select("item_id", "m", "k", "h").distinct()
    places = hits.join(own, ["k", "h"]).where("n >= m and m > k").groupBy("doc_id", "thash", "n", "item_id", "m", "k").agg(F.sort_array(F.collect_set("at")).alias("a")).withColumn("need", need)
    at = F.filter(F.transform("a", lambda x, i: F.when(F.get("a", i + F.col("need") - 1) <= x + F.col("m") - F.col("k"), F.least(x, F.col("n") - F.col("m")))), lambda x: x.isNotNull())
    other = places.where(F.size("a") >= F.col("need")).select("doc_id", "thash", "item_id", "m", F.explode(F.array_distinct(at)).alias("start"))
    seen = aligned.select(F.col("doc_id").alias("__d"), F.col("thash").alias("__t"), F.col("item_id").alias("__i"), F.col("m").alias("__m"), F.col("start").alias("__s"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("thash") == F.col("__t")) & (F.col("item_id") == F.col("__i")) & (F.col("m") == F.col("__m"))
    other = stage(other.join(seen, same & (F.abs(F.col("start") - F.col("__s")) < F.col("m")), "left_anti"), "other")
    both = aligned
    if not other.isEmpty():
        more = _similar(docs, other.select("doc_id", "thash", "m", "start").distinct(), items, fps, sizes, k, similarity)
        wanted = other.withColumnsRenamed({"doc_id": "__d", "thash": "__t", "item_id": "__i", "m": "__m", "start": "__s"})
        both = both.unionByName(more.join(wanted, same & (F.col("start") == F.col("__s")), "left_semi"))
    both = both.groupBy("doc_id", "item_id", "start", "words").agg(F.min("hamming").cast("int").alias("hamming"), F.max("similarity").alias("similarity"))
    return both.withColumn("item_id", F.when(F.col("item_id").startswith("="), F.substr("item_id", F.lit(2))).cast(kind))


def _similar(docs: DataFrame, windows: DataFrame, items: DataFrame, fps: DataFrame, sizes: list[int], k: int, similarity: float) -> DataFrame:
    """(doc_id, thash, start, m, item_id, words, hamming, similarity) of the (doc_id, thash, m, start) windows that repeat an item of m words."""
    # The documents that hold such windows, with their words again.
    per = windows.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("start", "m")).alias("windows"))
    per = per.withColumnsRenamed({"doc_id": "__d", "thash": "__t"})
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("thash"), "text")
    texts = texts.join(per, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("thash") == F.col("__t"))).dropDuplicates(["doc_id", "thash"])
    texts = texts.select("doc_id", "thash", "windows", _hashes().alias("w")).withColumn("n", F.size("w"))
    parts = []
    for j in sizes:
        s = texts.select("doc_id", "thash", "n", _shingles(F.col("w"), F.col("n"), j).alias("s"), F.explode("windows").alias("x"))
        s = s.where((F.col("x.m") == j) if j < k else (F.col("x.m") >= j)).withColumn("words", F.least("n", "x.m"))
        parts.append(s.select("doc_id", "thash", F.col("x.start").alias("start"), F.col("x.m").alias("m"), "words", F.explode(F.slice("s", F.col("x.start") + 1, F.col("words") - (j - 1))).alias("h")))
    if not parts:
        parts = [windows.withColumn("words", F.lit(0)).withColumn("h", F.lit(0).cast("long"))]
    inside = stage(reduce(DataFrame.unionByName, parts), "inside")
    key = ["doc_id", "thash", "start", "m", "words"]
    left = with_fingerprints(inside, key)
    left = left.withColumn("b", F.explode(blocks(F.col("fp"), WINDOW_FLIPS))).select(*key, "fp", "b.block", "b.bits")
    right = fps.withColumn("b", F.explode(blocks(F.col("fp"), ITEM_FLIPS))).select("item_id", "m", F.col("fp").alias("fp2"), "b.block", "b.bits")
    near = left.join(right, ["m", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))).where(F.col("hamming") <= RADIUS)
    near = stage(near.select(*key, "item_id", "hamming").distinct(), "near")
    # Exact weighted similarity: sum of the smaller over sum of the larger counts.
    mine = inside.groupBy(*key, "h").agg(F.count("*").alias("c1"))
    theirs = items.groupBy("item_id", "m", "h").agg(F.count("*").alias("c2"))
    renamed = near.withColumnsRenamed({"doc_id": "__d"}).drop("words")
    both = mine.join(renamed, F.col("doc_id").eqNullSafe(F.col("__d")) & (mine["thash"] == renamed["thash"]) & (mine["start"] == renamed["start"]) & (mine["m"] == renamed["m"])).select("doc_id", mine["thash"], mine["start"], mine["m"], "words", "item_id", "hamming", "h", "c1")
    both = both.join(theirs, ["item_id", "m", "h"]).groupBy(*key, "item_id", "hamming").agg(F.sum(F.least("c1", "c2")).alias("least"))
    size = lambda words: F.when(F.col("m") >= k, words - (k - 1)).otherwise(F.lit(1))
    both = both.withColumn("similarity", F.col("least") / (size(F.col("words")) + size(F.col("m")) - F.col("least")))
    return both.where(F.col("similarity") >= similarity).select(*key, "item_id", "hamming", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item (all rows of such a doc_id); rows with a null doc_id stay unless one leaks."""
    bad = stage(leaks(docs, benchmark).select(F.col("doc_id").alias("__d")).distinct(), "leaking")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti")
