"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

A list may hold any number of URLs. Its canonical forms set eight bits each in one block of a filter, whose number of blocks
follows the list's size up to MOST_BLOCKS; so the filter is a table of bounded size that is broadcast. A URL finds its
block by one lookup. If some of its bits are not set it is certainly not listed and is decided on the spot; only the
others are shuffled, to an exact hash join with the list that removes false positives. A list that is too long for its
filter costs more shuffled rows, never a wrong verdict.

All work is in DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of 32 bits in a block: one bit of each is set by a URL.
WORDS = 8
#: Bits of the filter for each listed URL: less than 1 in 1,000 of the others pass.
BITS_PER_URL = 16
#: Blocks that a filter may have; a broadcast filter is then below 16 MB as a hash table.
MOST_BLOCKS = 1 << 16
#: Rules are tried as one expression, so they are a short parameter; long lists are given as listed URLs.
MOST_RULES = 256
#: Query parameters that name no other page.
TRACKING = ("ref", "fbclid", "gclid")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """The host, A-Z in lower case; empty for null and for URLs without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path with its slash, up to ? or #; empty for null and for URLs without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for URLs of the same page: host without www., path without a closing slash, other query parameters than tracking ones in order; no scheme, no fragment.

    Null for null and for URLs without ://, which are never listed.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~q.startswith("utm_") & ~F.split_part(q, F.lit("="), F.lit(1)).isin(*TRACKING)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, by the lower half of its hash, and its bit in each word: five bits of another product of the upper half for each."""
    hashed = F.xxhash64(key)
    block = (hashed.bitwiseAND(F.lit(0xFFFFFFFF)) % blocks).cast("int")
    high = F.shiftrightunsigned(hashed, 32)
    odd = [pow(0x9E3779B1, i + 1, 2**31) | 1 for i in range(WORDS)]  # below 2 ** 31, so that products stay longs
    return block, [F.shiftrightunsigned((high * F.lit(m)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for m in odd]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the blocks in use of a filter of the column ``key``. Bits are joined before the shuffle."""
    block, bits = _place(F.col("key"), blocks)
    rows = keys.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    rows = rows.select("block", *[F.expr(f"shiftleft(1L, b{i})").alias(f"w{i}") for i in range(WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def blocks_for(n: int) -> int:
    """Blocks for ``n`` listed URLs."""
    return max(1, min(MOST_BLOCKS, -(-n * BITS_PER_URL // (32 * WORDS))))


def checked(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """Append ``maybe``: false if ``key`` is null or the filter rules it out. True for all listed keys, and for few others."""
    block, bits = _place(F.col("key"), blocks)
    found = rows.withColumns({"block": block, **{f"b{i}": b for i, b in enumerate(bits)}}).join(F.broadcast(filter_), "block", "left")
    hits = reduce(lambda a, b: a & b, [F.expr(f"shiftrightunsigned(w{i}, b{i}) & 1L") == 1 for i in range(WORDS)])
    return found.select(*rows.columns, F.coalesce(hits & F.col("key").isNotNull(), F.lit(False)).alias("maybe"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (host, path, verdict), null if none fits.

    A rule fits its host and all subdomains if the path starts with its path. Of two rules of one length that with the longer host wins.
    """
    if len(rules) > MOST_RULES or len({(h, p) for h, p, _ in rules}) < len(rules) or {v for *_, v in rules} - {"allow", "block"}:
        raise ValueError(f"up to {MOST_RULES} different rules that allow or block")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Append host, path, rule and verdict (allow or block) to every row: the verdict of the longest fitting rule, else block for a listed URL, else allow.

    ``listed`` has a column ``url``; any number of rows, in any form, repeated or null. Equal URLs get equal verdicts; null URLs and
    those without :// have an empty host and path, no rule and are allowed. Columns of ``pages`` with one of the new names are
    replaced, all others stay; an empty list allows all. Repeated rows stay as often as they are there.

    ``pages`` is read twice, for the rows that the filter decides and for those that it passes on; only the latter are
    shuffled, by their canonical URL, and a URL that many pages share is split by AQE, as the list has it once.
    """
    new = ["host", "path", "rule", "verdict"]
    kept = pages.drop(*new)
    source = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    slim = kept.select(source.alias("r"), F.col(f"`{url}`").alias("u"))
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = slim.select("r", "u", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict})
    keys = materialise(listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct())
    blocks = blocks_for(keys.count())
    filter_ = materialise(bloom(keys, blocks))  # a table of MOST_BLOCKS rows at most, made once
    open_key = F.when(F.col("verdict").isNull(), canonical(F.col("u"))).alias("key")
    rows = checked(parsed.select("r", open_key, *new), filter_, blocks)
    decided = rows.where("not maybe").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    exact = rows.where("maybe").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    looked = exact.withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    each = [*[F.col("r").getField(c).alias(c) for c in kept.columns], *new]
    return decided.select(*each).unionByName(looked.select(*each))
