"""URL rules behind a blocked Bloom filter, in DataFrame expressions only.

Listed canonical URLs (host and path, an optional action) are hashed into a blocked Bloom filter:
a key sets ``PROBES`` bits inside one block of 256 bits, kept as four longs. The keys that a page's
url could match are tested there first; only possible hits go on to an exact hash join with the
list, which removes the false positives. The filter is broadcast in bounded pieces (of a short list it is a constant of the plan), so that rows that
cannot match are turned away where they are read. A short list of few shapes is joined there too, and
no row is shuffled; else possible hits are made distinct and settled, and verdicts joined back by url.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, saved

PROBES = 8
WORDS = 4
#: Lists of up to so many entries (16 KB of filter) are looked up with the filter as a constant.
SHORT = 2048
#: Lists of up to so many entries are broadcast (16 MB at most); of longer ones the possible hits are joined by key.
BROADCAST_RULES = 100_000
#: Blocks of the filter in one broadcast (10 MB), and such pieces at most; a larger filter is joined by block.
PIECE, PIECES = 250_000, 64
#: Shapes of a short list that are looked up side by side.
NARROW = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``; A-Z lower-cased) and path (then up to ``? #``).

    Both are empty for null and for urls without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key and its bit positions within 256 bits."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    second = F.xxhash64(key, F.lit(1))
    return block, [F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(block, word0..word3)``: the non-empty blocks of the filter over a key column."""
    block, bits = _place(F.col(key), blocks)
    return keys.select(block.alias("block"), *(_mask(bits, w).alias(f"word{w}") for w in range(WORDS))).groupBy("block").agg(*(F.bit_or(f"word{w}").alias(f"word{w}") for w in range(WORDS)))


def _mask(bits: list[Column], word: int) -> Column:
    """The bits of a key that fall into one of the block's words."""
    out = F.lit(0).cast("long")
    for bit in bits:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)))
        out = out.bitwiseOR(F.when(F.shiftright(bit, 6) == word, one).otherwise(F.lit(0).cast("long")))
    return out


def filter_urls(pages: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules(action, host, path)`` lists canonical urls. A rule fits its host and every subdomain of
    it if the url's path starts with the rule's path; the longest fitting rule wins (then the longer
    host, then the rule's text). Without one, ``rule`` is null and the verdict is ``default``.

    Null urls and urls without ``://`` have an empty host and path and get the default, as do all
    rows under an empty list. Repeated rows are judged each. Rules with a null field are left out; of
    equal rules with different actions ``block`` stands. Input columns whose names clash with added
    ones stay; the added column then ends in an underscore.
    """
    listed = rules.where("action IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("action").alias("action"))
    listed = listed.select("action", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_chars"), F.size(F.split("rule_host", "\\.")).alias("labels"), F.length("rule_path").alias("chars"))
    # The shapes (labels of the host, characters of the path) bound what a url can match.
    spark, own = pages.sparkSession, listed.limit(SHORT + 1).collect()
    if len(own) <= SHORT:
        listed = spark.createDataFrame(own, listed.schema)
        count, shapes = len(own), sorted({(r["labels"], r["chars"]) for r in own})
    else:
        listed = saved(listed)
        count = listed.count()
        shapes = sorted(tuple(r) for r in listed.select("labels", "chars").distinct().collect())
    few = count <= BROADCAST_RULES
    host, path = host_and_path(F.col(url))
    names = {k: free_name(pages, k) for k in ("host", "path", "rule", "verdict")}
    given = pages.withColumns({names["host"]: host, names["path"]: path})
    if not shapes:
        return given.withColumns({names["rule"]: F.lit(None).cast("string"), names["verdict"]: F.lit(default)})

    blocks = max(1, math.ceil(count * 16 / 256))
    bloom = bloom_filter(listed, "rule", blocks)
    if few and len(own) <= SHORT and len(shapes) <= NARROW:
        return _looked_up(given, names, listed, bloom, blocks, shapes, default)
    parts = F.split("h", "\\.")
    # One expression for all shapes, however many; a url is asked about those that it is long enough for.
    known = F.from_json(F.lit(json.dumps([{"l": x, "c": y} for x, y in shapes])), "array<struct<l:int,c:int>>")
    fit = F.filter(known, lambda s: (s["l"] <= F.size(parts)) & (s["c"] <= F.length("p")))
    candidates = F.transform(fit, lambda s: F.concat(F.array_join(F.slice(parts, F.size(parts) - s["l"] + 1, s["l"]), "."), F.substring(F.col("p"), F.lit(1), s["c"])))
    probes = pages.select(F.col(url).alias("u")).where("u IS NOT NULL").select("u", host_and_path(F.col("u"))[0].alias("h"), host_and_path(F.col("u"))[1].alias("p"))
    probes = probes.select("u", F.explode(candidates).alias("key"))
    block, bits = _place(F.col("key"), blocks)
    probes = probes.withColumn("block", block)
    pieces = math.ceil(blocks / PIECE)
    if pieces <= PIECES:
        bloom = saved(bloom)
        cut = [probes.where(F.col("block").between(i * PIECE, (i + 1) * PIECE - 1)).join(F.broadcast(bloom.where(F.col("block").between(i * PIECE, (i + 1) * PIECE - 1))), "block") for i in range(pieces)]
        probes = reduce(DataFrame.unionByName, cut)
    else:
        probes = probes.join(bloom, "block")
    # Only possible hits are shuffled.
    possible = probes.where(_all_set(bits, F.col)).select("u", "key").distinct()
    exact = possible.join(F.broadcast(listed) if few else listed, F.col("key") == F.col("rule"))
    best = exact.groupBy("u").agg(F.max(F.struct(F.length("rule").alias("l"), "host_chars", "rule", "action")).alias("best"))
    out = given.join(best, F.col(url) == F.col("u"), "left")
    return out.select(*given.columns, F.col("best.rule").alias(names["rule"]), F.coalesce("best.action", F.lit(default)).alias(names["verdict"]))


def _candidate(parts: Column, path: Column, labels: int, chars: int) -> Column:
    """The key of a shape that a url could match: its last labels and the first characters of its path; null if it is too short."""
    return F.when((F.size(parts) >= labels) & (F.length(path) >= chars), F.concat(F.array_join(F.slice(parts, -labels, labels), "."), F.substring(path, 1, chars)))


def _all_set(bits: list[Column], word: Callable[[str], Column]) -> Column:
    """Whether a block's words hold all bits of a key."""
    return reduce(lambda a, b: a & b, (word(f"word{w}").bitwiseAND(_mask(bits, w)) == _mask(bits, w) for w in range(WORDS)))


def _looked_up(given: DataFrame, names: dict[str, str], listed: DataFrame, bloom: DataFrame, blocks: int, shapes: list[tuple[int, int]], default: str) -> DataFrame:
    """One pass over the rows: for each shape the filter, a constant, and then, for possible hits, the rules, broadcast once."""
    own = "_u"  # no input column begins so
    while any(c.lower().startswith(own) for c in given.columns):
        own += "_"
    hits, key, hit, rule = (own + x for x in ("hits", "key", "hit", "rule"))
    words = [0] * (blocks * WORDS)
    for row in bloom.collect():
        for w in range(WORDS):
            words[row["block"] * WORDS + w] = row[f"word{w}"]
    held = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    rules = F.broadcast(listed.select(F.struct(F.length("rule").alias("l"), "host_chars", "rule", "action").alias(hit), F.col("rule").alias(rule)))
    out = given.withColumn(hits, F.array().cast("array<struct<l:int,host_chars:int,rule:string,action:string>>"))
    for shape in shapes:
        tried = out.withColumn(key, _candidate(F.split(names["host"], "\\."), F.col(names["path"]), *shape))
        block, bits = _place(F.col(key), blocks)
        word = lambda bit, block=block: F.get(held, block * WORDS + F.shiftright(bit, 6))
        there = reduce(lambda a, b: a & b, (F.call_function("shiftright", word(bit), bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1 for bit in bits))
        tested = tried.select(*out.columns, F.when(F.col(key).isNotNull() & there, F.col(key)).alias(key))
        found = tested.join(rules, F.col(key) == F.col(rule), "left")
        out = found.select(*given.columns, F.when(F.col(rule).isNotNull(), F.array_append(hits, F.col(hit))).otherwise(F.col(hits)).alias(hits))
    best = F.array_max(hits)
    return out.select(*given.columns, best["rule"].alias(names["rule"]), F.coalesce(best["action"], F.lit(default)).alias(names["verdict"]))
