"""URL filters by a blocked Bloom filter and an exact hash join, on built-in functions only.

Rules name a host (and all below it) and a path prefix; their canonical form is host and
path together, like ``example.net/en/``. A page's url gives one key for each shape of rule
(number of host labels, length of path) that it is long enough for. Keys that the Bloom
filter doesn't know can't be listed; possible hits go to a hash join with the rules, which
removes false positives. The longest rule wins (then the longer host); a url that no rule
fits is allowed.

The filter has 64-bit blocks, 12 bits a rule; a key sets five bits of one block. Up to
``ARRAY_BLOCKS`` blocks (256 KB, some 170,000 rules) it travels inside the plan as one array,
and pages that it rules out are judged on the spot; a larger one is joined by block number,
and all pages are grouped. The rules are broadcast only up to ``BROADCAST_RULES`` of them.
Both ways give the same rows.

A null url, or one without ``://``, has an empty host and path. Rules with a null host or
path are dropped, and of rules with the same key, block wins. Without rules every page is
allowed. Repeated pages are judged each; extra columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAY_BLOCKS, BROADCAST_RULES, BROADCAST_BYTES = 1 << 15, 100_000, 16 << 20
BITS_A_RULE, BITS_SET = 12, 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1).cast("long")).cast("int")


def _mask(h: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(BITS_SET):
        # 1 shifted by six bits of the hash, above those that choose the block
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 33 + 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


def rule_table(rules: DataFrame) -> DataFrame:
    """key, action, host length: one row for each canonical key."""
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    return known.groupBy(F.concat("host", "path").alias("key")).agg(F.max("action").alias("action"), F.max(F.length("host")).alias("host_len"), F.max(F.length("path")).alias("path_len"), F.max(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict for every page. ``rules``: action (allow or block), host, path."""
    spark = pages.sparkSession
    listed = rule_table(rules)
    n, size = listed.agg(F.count(F.lit(1)), F.sum(F.octet_length("key") + 32)).first()
    read = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not n:
        return read.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    blocks = 1 << max(0, math.ceil(math.log2(n * BITS_A_RULE / 64)))
    shapes = listed.select(F.struct("labels", "path_len").alias("s")).distinct().agg(F.array_sort(F.collect_list("s"))).scalar()
    hashed = listed.select(F.xxhash64("key").alias("h"))
    words = hashed.groupBy(_block(F.col("h"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("h"))).alias("word"))

    fits = F.filter(F.col("shapes"), lambda s: s["path_len"] <= F.length("path"))
    keys = F.array_distinct(F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.left("path", s["path_len"]))))
    tried = read.withColumn("shapes", shapes).withColumn("tries", F.transform(keys, lambda k: F.struct(k.alias("key"), F.xxhash64(k).alias("h"))))
    if blocks <= ARRAY_BLOCKS:
        every = spark.range(blocks).select(F.col("id").cast("int").alias("block")).join(words, "block", "left")
        bloom = every.agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))["word"]).scalar()
        passed = F.filter(F.col("tries"), lambda t: F.get(F.col("bloom"), _block(t["h"], blocks)).bitwiseAND(_mask(t["h"])) == _mask(t["h"]))
        hits = tried.withColumn("bloom", bloom).withColumn("hits", F.transform(passed, lambda t: t["key"])).select(key, "host", "path", "hits")
        # what the filter rules out is judged where it stands; only possible hits are shuffled
        ruled_out = hits.where(F.size("hits") == 0).select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
        hits = hits.where(F.size("hits") > 0).select(key, "host", "path", F.size("hits").alias("n"), F.explode("hits").alias("key"))
    else:
        each = tried.select(key, "host", "path", F.size("tries").alias("n"), F.explode_outer("tries").alias("t")).withColumn("block", _block(F.col("t.h"), blocks))
        ruled_out = None
        hits = each.join(words, "block", "left").select(key, "host", "path", "n", F.when(F.col("word").bitwiseAND(_mask(F.col("t.h"))) == _mask(F.col("t.h")), F.col("t.key")).alias("key"))
    side = listed.select("key", "action", "host_len")
    side = F.broadcast(side) if n <= BROADCAST_RULES and size <= BROADCAST_BYTES else side
    # tries that the filter rules out have no key and would meet in one task of the join
    misses = hits.where("key is null").withColumns({"action": F.lit(None).cast("string"), "host_len": F.lit(None).cast("int")})
    found = hits.where("key is not null").join(side, "key", "left").unionByName(misses)
    order = F.struct(F.length("key").alias("size"), "host_len", F.col("key").alias("rule"), "action")
    best = found.groupBy(F.col(key), "host", "path").agg(F.max(F.when(F.col("action").isNotNull(), order)).alias("best"), (F.count(F.lit(1)) / F.greatest(F.lit(1), F.max("n"))).cast("int").alias("copies"))
    out = best.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    out = out.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))
    return out if ruled_out is None else out.unionByName(ruled_out)
