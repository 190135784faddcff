"""Operator 12 [native]: URL filters by Bloom filter cascades.

A list of keys (rules, listed addresses) is encoded against the corpus's complete universe of
keys: level 1 holds the listed keys, level 2 the unlisted keys of the universe that pass level 1,
level 3 the listed keys that pass level 2, and so on until no key passes wrongly.  A key belongs
to the list if the first level that it fails has an even number (or it passes all of an odd
number of levels), so membership of every key of the universe is exact, and asking needs no join
with the list.  Each level hashes anew.

A level is cut into shards of ``SHARD_BITS`` bits, each built by ``bitmap_construct_agg``.  As long as
all levels are below ``BOUND_BYTES`` they reach the rows as one bound value; beyond it rows meet
their key's shard by an equi-join on (level, shard), salted, as a listed key may be in a third
of all rows.

``judge`` uses three lists: rules that block, rules that allow, and listed addresses (host + path)
for urls that no rule fits.  A rule (host, path) is the key ``host + path``; a url's candidate
keys are, for each shape of a rule (number of host labels, length of the path), its last labels
and the start of its path.  The longest rule wins, of equally long ones that with the longer
host; a key listed both ways blocks.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed; a host keeps its port and user; rules are compared with A-Z lower-cased in the host
only; repeated rows are judged alike; no rules, no listed keys and empty tables are fine; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.tables import stored, table

SHARD_BITS = 32768             # one bitmap of bitmap_construct_agg
BITS_PER_KEY = 8
HASHES = 4
BOUND_BYTES = 16 << 20         # of all levels of a cascade, as a bound value
SALTS = 16
#: The rules of the registered query: (host, path) of what is blocked and allowed.
BLOCK = (("net", "/"), ("example.com", "/de/"))
ALLOW = (("example.net", "/en/"), ("org", "/fr/"))


# ---------------------------------------------------------------- cascades

@dataclass
class Level:
    number: int
    shards: int
    bits: int
    bitmaps: DataFrame   # shard, bitmap


@dataclass
class Cascade:
    levels: list[Level]
    bound_bytes: int

    @property
    def n_bytes(self) -> int:
        return sum(v.shards for v in self.levels) * SHARD_BITS // 8


def _shard(key: Column, number: int, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"shard {number}"), key), F.lit(shards)).cast("int")


def _places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(f"bit {number} {i}"), key), F.lit(bits)) for i in range(hashes)]


def _bit(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def build_level(keys: DataFrame, number: int, n: int, bits_per_key: int, hashes: int, bits: int) -> Level:
    """A Bloom filter over the ``n`` rows of ``keys`` (key)."""
    shards = max(1, -(-n * bits_per_key // bits))
    places = F.explode(F.array(*_places(F.col("key"), number, bits, hashes)))
    set_bits = keys.select(_shard(F.col("key"), number, shards).alias("shard"), places.alias("place")).distinct()
    bitmaps = set_bits.groupBy("shard").agg(F.bitmap_construct_agg(F.col("place")).alias("bitmap"))
    return Level(number, shards, bits, stored(bitmaps, f"cascade-level{number}", narrow=True))


def _passes(df: DataFrame, key: str, level: Level, hashes: int, bound: bool, out: str) -> DataFrame:
    """Adds ``out``: whether ``key`` passes the level."""
    spark = df.sparkSession
    shard, places = _shard(F.col(key), level.number, level.shards), _places(F.col(key), level.number, level.bits, hashes)
    if bound:
        # every shard in its place, missing ones (no key fell there) empty
        all_ = spark.range(level.shards).select(F.col("id").cast("int").alias("shard")).join(level.bitmaps, "shard", "left")
        all_ = all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "bitmap"))), lambda s: s["bitmap"]).alias("all"))
        bitmap, df, drop = F.element_at(all_.scalar(), shard + 1), df, []
    else:
        salted = level.bitmaps.select(F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.col("bitmap").alias("_bitmap"))
        df = df.withColumns({"_shard": shard, "_salt": F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")}).join(salted, ["_shard", "_salt"], "left")
        bitmap, drop = F.col("_bitmap"), ["_shard", "_salt", "_bitmap"]
    test = F.lit(True)
    for p in places:
        test = test & _bit(bitmap, p)
    return df.withColumn(out, F.coalesce(test, F.lit(False))).drop(*drop)


def build(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES, bits: int = SHARD_BITS,
          bound_bytes: int = BOUND_BYTES) -> Cascade:
    """The cascade of the ``listed`` keys against all keys of ``universe`` (both: key)."""
    keys = universe.select("key").where("key is not null").distinct()
    listed = listed.select("key").distinct().withColumn("in_list", F.lit(True))
    marked = stored(keys.join(listed, "key", "left").select("key", F.coalesce("in_list", F.lit(False)).alias("in_list")), "cascade-universe")
    inside, outside = marked.where("in_list").select("key"), marked.where("not in_list").select("key")
    cascade, number = Cascade([], bound_bytes), 0
    while True:
        n = inside.count()
        if not n:
            return cascade
        number += 1
        level = build_level(inside, number, n, bits_per_key, hashes, bits)
        cascade.levels.append(level)
        bound = level.shards * SHARD_BITS // 8 <= bound_bytes
        wrong = _passes(outside, "key", level, hashes, bound, "passes").where("passes").select("key")
        inside, outside = stored(wrong, f"cascade-wrong{number}"), inside


def member(df: DataFrame, key: str, cascade: Cascade, out: str, hashes: int = HASHES) -> DataFrame:
    """Adds ``out``: whether ``key`` (of the cascade's universe; null: no) is listed."""
    bound = cascade.n_bytes <= cascade.bound_bytes
    names, columns = [], df.columns
    for level in cascade.levels:
        names.append(f"_passes{level.number}")
        df = _passes(df, key, level, hashes, bound, names[-1])
    listed = F.lit(len(names) % 2 == 1)
    for i in reversed(range(len(names))):   # level i + 1 fails first: listed if its number is even
        listed = F.when(~F.col(names[i]), F.lit(i % 2 == 1)).otherwise(listed)
    return df.select(*columns, (F.coalesce(listed, F.lit(False)) & F.col(key).isNotNull()).alias(out))


# ---------------------------------------------------------------- urls

def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shapes(rules: Sequence[tuple[str, str]]) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) of all rules, the longest host first."""
    return sorted({(host.count(".") + 1, len(path)) for host, path in rules}, reverse=True)


def candidate(host: Column, path: Column, labels: int, length: int) -> Column:
    """The key that a rule of this shape must have to fit; null if none of this shape can."""
    fits = (F.length(host) > 0) & (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= length)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))


def address(host: Column, path: Column) -> Column:
    return F.when(F.length(host) > 0, F.concat(host, path))


def judge(pages: DataFrame, block: Sequence[tuple[str, str]], allow: Sequence[tuple[str, str]], listed: DataFrame | None = None, **sizes) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``listed`` (key): addresses, host and path, that are blocked where no rule fits.  ``sizes`` go to ``build``.
    """
    spark = pages.sparkSession
    block, allow = ([(_ascii_lower(h), p) for h, p in rules] for rules in (block, allow))
    host, path = host_and_path(F.col("url"))
    urls = stored(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    kinds = shapes([*block, *allow])
    keys = urls.select("host", "path").distinct()
    hashes = {"hashes": sizes["hashes"]} if "hashes" in sizes else {}
    found = []
    if kinds:
        fitting = F.explode(F.array(*[candidate(F.col("host"), F.col("path"), *k) for k in kinds])).alias("key")
        universe = stored(keys.select(fitting).where("key is not null").distinct(), "url-candidates", narrow=True)
        lists = [spark.range(1).select(F.explode(F.array(*[F.lit(h + p) for h, p in rules]).cast("array<string>")).alias("key")) for rules in (block, allow)]
        blocks, allows = (build(rules, universe, **sizes) for rules in lists)
        out = urls
        for i, k in enumerate(kinds):
            out = out.withColumn(f"key{i}", candidate(F.col("host"), F.col("path"), *k))
            out = member(out, f"key{i}", blocks, f"block{i}", **hashes)
            out = member(out, f"key{i}", allows, f"allow{i}", **hashes)
            # the length of the key, then that of its host: the shapes come with the longest host first
            found.append(F.when(F.col(f"block{i}") | F.col(f"allow{i}"), F.struct(
                F.length(f"key{i}").alias("length"), F.lit(k[0]).alias("labels"), F.col(f"key{i}").alias("key"), F.col(f"block{i}").alias("block"))))
        best = F.greatest(*found) if len(found) > 1 else found[0]
        out = out.withColumn("best", best)
    else:
        out = urls.withColumn("best", F.lit(None).cast("struct<key:string,block:boolean>"))
    out = out.withColumn("address", address(F.col("host"), F.col("path")))
    if listed is None:
        out = out.withColumn("listed", F.lit(False))
    else:
        out = member(out, "address", build(listed, keys.select(address(F.col("host"), F.col("path")).alias("key")), **sizes), "listed", **hashes)
    blocked = F.when(F.col("best").isNotNull(), F.col("best.block")).otherwise(F.col("listed"))
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def unstable(pages: DataFrame) -> DataFrame:
    """Addresses (key) that have answered with different pages."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select(address(host, path).alias("key"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("page")).where("key is not null")
    return seen.groupBy("key").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo != hi").select("key")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, BLOCK, ALLOW, unstable(pages))
