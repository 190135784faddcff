import random
import re

import pytest
from pyspark.sql import functions as F

from custlens.llm import url_cascade as U

DDL = "page_id bigint, url string, html string"


def some_pages(n=400, seed=2):
    rng = random.Random(seed)
    hosts = ["a.example.net", "example.net", "net", "www.example.com", "notexample.com", "x.example.org", "org", "b.c.net", "EXAMPLE.com", "example.net:80", "u@x.org"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/de/x/y", "/fr/", "/fr/9?x=/de/", "?q=/en/", "#/fr/", "/EN/", "/en//", "/de"]
    rows = [(i, rng.choice(["http", "https", "HTTP", ""]) + "://" + rng.choice(hosts) + rng.choice(paths), f"page {i % 9}") for i in range(n)]
    rows += [(n, None, None), (n + 1, "", ""), (n + 2, "example.net/en/", "x"), (n + 3, "http://", "x"), (n + 4, "a://b://net/", "x"), (n + 5, "http:///en/", "x"),
             (n + 6, "http://x.net/" + "y" * 20000, "x"), (n + 7, "http://" + "a." * 300 + "net/", "x"), (n + 8, "http://é.net/fr/ü", "x"), (None, "http://net/", "x")]
    return rows + rows[:3]


def parts(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def brute(rows, block, allow, listed=()):
    out = []
    for page_id, url, _ in rows:
        host, path = parts(url)
        fits = [(len(h + p), len(h), h + p, v) for rules, v in ((allow, "allow"), (block, "block")) for h, p in rules
                if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else None
        out.append((page_id, host, path, rule and rule[2], rule[3] if rule else "block" if host and host + path in listed else "allow"))
    return sorted(out, key=repr)


def judged(spark, rows, block, allow, listed=None, **kw):
    keys = None if listed is None else spark.createDataFrame([(k,) for k in listed], "key string")
    out = U.judge(spark.createDataFrame(rows, DDL).repartition(3), block, allow, keys, **kw)
    return sorted((tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"bits_per_key": 4, "hashes": 2, "bits": 64}])
def test_equals_brute_force(spark, sizes):
    rows = some_pages()
    listed = {h + p for h, p in (parts(u) for _, u, _ in rows[::5]) if h} | {"not.in/the/corpus", "net/"}
    assert judged(spark, rows, U.BLOCK, U.ALLOW, sorted(listed), **sizes) == brute(rows, U.BLOCK, U.ALLOW, listed)


def test_longest_rule_wins(spark):
    rows = some_pages(150)
    block = [("net", "/"), ("example.net", "/en/1"), ("example.com", "/de"), ("org", ""), ("Example.ORG", "/fr/")]
    allow = [("example.net", "/en"), ("org", ""), ("x.example.org", "/")]
    assert judged(spark, rows, block, allow) == brute(rows, [(h.lower(), p) for h, p in block], allow)


@pytest.mark.parametrize("bound", [U.BOUND_BYTES, 0])
def test_cascade_is_exact(spark, bound):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(key) % 3 = 0").unionByName(spark.createDataFrame([("outside",), ("k3",), ("k3",)], "key string"))
    c = U.build(listed, universe, bits_per_key=2, hashes=1, bits=512, bound_bytes=bound)
    assert len(c.levels) > 3 and c.levels[0].shards > 1
    got = U.member(universe.unionByName(spark.createDataFrame([(None,)], "key string")), "key", c, "listed", hashes=1)
    want = {r.key for r in listed.collect()}
    assert all(r.listed == (r.key in want) for r in got.collect())


def test_empty_and_clashing(spark):
    assert judged(spark, [], U.BLOCK, U.ALLOW, []) == []
    rows = some_pages(30)
    assert judged(spark, rows, [], [], []) == brute(rows, [], [])
    assert judged(spark, rows, [], []) == brute(rows, [], [])
    pages = spark.createDataFrame(rows, DDL)
    extra = pages.withColumns({c: F.lit(i) for i, c in enumerate(["host", "path", "rule", "verdict", "key", "key0", "block0", "shard", "_shard", "best", "listed"])})
    assert sorted(map(repr, U.judge(extra, U.BLOCK, U.ALLOW).collect())) == sorted(map(repr, U.judge(pages, U.BLOCK, U.ALLOW).collect()))


def test_unstable_addresses(spark, tmp_path):
    rows = [(1, "http://a.com/x?1", "p"), (2, "http://a.com/x#2", "q"), (3, "http://a.com/y", "p"), (4, "http://a.com/y?2", "p"), (5, None, "p"), (6, None, "q"),
            (7, "http://b.net/x", "p"), (8, "http://b.net/x", None)]
    pages = spark.createDataFrame(rows, DDL)
    assert sorted(r.key for r in U.unstable(pages).collect()) == ["a.com/x", "b.net/x"]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.rule, r.verdict) for r in U.op12(spark, str(tmp_path)).collect()) == [
        (1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, "net/", "block"), (8, "net/", "block")]
