"""Operator 10: near-duplicate documents by ProbMinHash.

Each distinct ``SHINGLE``-word shingle of a document has weight 1, however often it occurs, so that
candidates come from the similarity that a link is verified by.  Each shingle is a
Poisson process whose rate is its weight: its arrivals (exponential gaps drawn from hashes of the
shingle) fall on one of ``REGISTERS`` registers, and a register keeps the shingle of its earliest
arrival.  A process stops once its next arrival lies behind the latest register (early
termination).  The share of equal registers estimates the probability Jaccard of two documents, with
these weights the Jaccard similarity of their shingle sets.

Registers are cut into bands of ``ROWS``; documents with an equal band are candidates, and a pair
is a link if the Jaccard similarity of their shingle sets is at least ``SIMILARITY``.  Classes
are the connected components of links.

Within a bucket (documents with an equal band) the member with the smallest key leads: it is
verified against every other member.  So a bucket of near copies takes as many pairs as members.
What is left in buckets that still hold two classes or more goes by an exact prefix filter: the
shingles of those documents are put in one order, rare ones first (by the number of these documents
that hold them), and two documents of similarity ``SIMILARITY`` share one among the first
``n - ceil(SIMILARITY * n) + 1`` of each.  Their first shared one, at place i of n and j of m, leaves
min(n - i, m - j) that they can have in common, which must reach SIMILARITY / (1 + SIMILARITY) of
n + m.  So documents that share only a frequent passage, and copies with too many words of their
own, never meet.  Per shingle the members with the fewest rare shingles before it lead (more each
round), members that no other one's size can match leave, and so do all of a bucket that belongs to
one class.  No pair of an open bucket that could join two classes is left out, and there is no cap.
Equal texts are one node from the start.

Verification streams: members come sorted behind their leader, at most ``FOLLOWERS`` behind each
copy of it, and a task holds one leader's shingles and one batch.

Defined cases: null counts as empty text; texts without words are equal to each other only
(and so one class if equal); a text of fewer than ``SHINGLE`` words has one shingle of all its words; a
class is named by its smallest doc_id (null if none has one); repeated rows are copies; other
columns are passed on by ``keep_one`` and ignored by ``op10``; an empty table gives an empty
result.  Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlens.llm.tables import importable, set_aside, stored, table
from custlens.llm.textscan import GRAM, Words, grams, mix, scan, slices

SHINGLE = 5
SIMILARITY = 0.8
# a pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** 7) ** 36 = 0.9998, one at 0.3 with 0.008
BANDS = 36
ROWS = 7
REGISTERS = BANDS * ROWS
FOLLOWERS = 64
LEADERS_GROWTH = 4   # leaders of a shingle's bucket: 1, 4, 16, ... by round
SLACK = 1e-6         # for rounding, on the side of more candidates
SLICE_BYTES = 1 << 20   # 44 MB of memory on top of a worker (4 MB: 86)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences), one entry per distinct shingle of a text, in that order."""
    h, doc, n = words.hashes(), words.doc(), words.n_words
    g = grams(h, k)
    at = np.flatnonzero(doc[:len(g)] == doc[k - 1:][:len(g)])
    d, g = doc[at], g[at]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        alone = np.array([mix((h[words.first[i]:words.first[i + 1]] * GRAM[:n[i]]).sum(keepdims=True) + np.uint64(n[i]))[0] for i in few], dtype=np.uint64)
        d, g = np.concatenate((d, few)), np.concatenate((g, alone))
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    return d[first], g[first], np.diff(np.concatenate((first, [len(d)])))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: of each document (a row) the shingle that arrives first at each register;
    0 everywhere for a document without shingles."""
    best = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, dtype=np.uint64)
    t = np.zeros(len(doc))
    turn = 0
    while len(doc):
        turn += 1
        x = mix(shingle + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        register = ((mix(x) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        cell = doc * registers + register
        np.minimum.at(best, cell, t)
        won = best[cell] == t
        held[cell[won]] = shingle[won]
        latest = best.reshape(n_docs, registers).max(axis=1)
        go = t < latest[doc]
        doc, shingle, weight, t = doc[go], shingle[go], weight[go], t[go]
    return held.reshape(n_docs, registers)


def band_keys(held: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = held.reshape(len(held), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GRAM[rows], (len(held), bands)).copy()
    for j in range(rows):
        key += parts[:, :, j] * GRAM[j]
    return mix(key).view(np.int64)


def _bands(batches):
    for b in slices(batches, "text", SLICE_BYTES):
        nodes = b.column("node").to_numpy(zero_copy_only=False)
        _, rows = np.unique(nodes, return_index=True)   # copies within the slice have the same bands
        words = scan(b.column("text").take(pa.array(np.sort(rows))))
        nodes = nodes[np.sort(rows)]
        d, g, _ = shingles(words)
        keys = band_keys(signatures(d, g, np.ones(len(d)), len(nodes)))
        some = words.n_words > 0
        nodes, keys = nodes[some], keys[some]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(nodes) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], names=["node", "keys"])


def _verified(batches):
    """Rows sorted by (leader, part, follower): the leader's text first, then its followers'."""
    now, own = None, None
    for b in slices(batches, "text", SLICE_BYTES):
        leader, part, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leader", "part", "node"))
        words = scan(b.column("text"))
        d, g, _ = shingles(words)
        cut = np.searchsorted(d, np.arange(b.num_rows + 1))
        a, z = [], []
        for i in range(b.num_rows):
            mine = g[cut[i]:cut[i + 1]]
            if leader[i] == node[i]:
                now, own = (leader[i], part[i]), mine
                continue
            if now != (leader[i], part[i]):
                raise ValueError("a follower without its leader")
            small, large = sorted((len(own), len(mine)))
            if small < SIMILARITY * large:
                continue
            both = len(np.intersect1d(own, mine, assume_unique=True))
            if both >= SIMILARITY * (len(own) + len(mine) - both):
                a.append(leader[i])
                z.append(node[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among ``pairs`` (leader, node); ``texts`` has one row (node, text) per node."""
    part = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(FOLLOWERS)))).cast("int")
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    rows = pairs.join(sizes, "leader").select("leader", "node", part.alias("part"))
    heads = rows.select("leader", F.col("leader").alias("node"), "part").distinct()
    rows = rows.unionByName(heads).join(texts, "node").select("leader", "part", "node", "text")
    rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node") != F.col("leader"))
    return rows.mapInArrow(_verified, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of the nodes of ``edges`` (a, b): the smallest node of the component.

    Alternating large and small stars, each a grouped minimum and a join, until nothing changes."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "near-edges", narrow=True)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "near-stars", narrow=True)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return members.unionByName(members.select(F.col("class").alias("node"), "class").distinct())


def _shingle_lists(batches):
    for b in slices(batches, "text", SLICE_BYTES):
        d, g, _ = shingles(scan(b.column("text")))
        cut = np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(cut), pa.array(g.view(np.int64)))], names=["node", "shingles"])


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, node, place, size): the shingles of each text by which a link must meet another text.

    ``place`` is the shingle's position among the text's ``size`` shingles in the common order; those
    that no other text has come first and can't meet any, so they are left out."""
    lists = stored(texts.mapInArrow(_shingle_lists, "node bigint, shingles array<bigint>"), "near-shingles")
    rows = lists.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    frequent = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    behind = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("key")))
    rows = rows.join(frequent, "key").withColumn("behind", behind).where(F.col("behind") >= F.ceil(SIMILARITY * F.col("size") - SLACK))
    return rows.select("key", "node", (F.col("size") - F.col("behind")).alias("place"), "size")


def _with_classes(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("class", F.col("node"))
    return members.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _joined(found: DataFrame | None, pairs: DataFrame, texts: DataFrame) -> DataFrame | None:
    """The classes after the links among ``pairs``: the classes so far are stars, new links join them."""
    new = stored(_verify(pairs, texts), "near-links")
    if new.isEmpty():
        return found
    if found is not None:
        new = new.unionByName(found.select(F.col("node").alias("a"), F.col("class").alias("b")))
    return stored(components(new), "near-classes", narrow=True)


def classes(docs: DataFrame) -> DataFrame | None:
    """(node, class) of every text that is linked with another one; ``docs`` has ``node`` and
    ``text``; None if no text is."""
    keys = stored(docs.mapInArrow(_bands, "node bigint, keys array<bigint>"), "near-bands")
    members = keys.select(F.explode("keys").alias("key"), "node").distinct()
    shared = keys.select(F.explode("keys").alias("key"), "node").groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("hi")).where("leader != hi")
    buckets = stored(members.join(shared.select("key", "leader"), "key"), "near-buckets")
    texts = docs.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "near-texts")
    found = _joined(None, buckets.where("node != leader").select("leader", "node").distinct(), texts)

    at = stored(_with_classes(buckets.select("key", "node"), found), "near-members", narrow=True)
    open_ = at.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("key")
    members = prefixes(texts.join(at.join(open_, "key", "left_semi").select("node").distinct(), "node", "left_semi"))
    least_common = lambda n, m: SIMILARITY / (1 + SIMILARITY) * (n + m) - SLACK
    leaders = 1
    while True:
        at = stored(_with_classes(members, found), "near-members", narrow=True)
        open_ = at.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("size").alias("least")).where("lo != hi").select("key", "least")
        left = at.join(open_, "key").where(F.col("size") - F.col("place") >= least_common(F.col("size"), F.col("least"))).drop("least")
        left = stored(left, "near-open", narrow=True)
        if left.isEmpty():
            return found
        lead = left.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("place", "node"))).where(F.col("turn") <= leaders)
        lead = lead.select("key", *[F.col(c).alias(f"lead_{c}") for c in ("node", "class", "place", "size")])
        lead = stored(lead, "near-leaders", narrow=True)
        behind = F.struct("place", "node") > F.struct("lead_place", "lead_node")
        common = F.least(F.col("size") - F.col("place"), F.col("lead_size") - F.col("lead_place"))
        pairs = left.join(lead, "key").where(behind & (F.col("class") != F.col("lead_class")) & (common >= least_common(F.col("size"), F.col("lead_size"))))
        found = _joined(found, pairs.select(F.col("lead_node").alias("leader"), "node").distinct(), texts)
        last = lead.groupBy("key").agg(F.max(F.struct("lead_place", "lead_node")).alias("last"))
        members = left.join(last, "key").where(F.struct("place", "node") > F.col("last")).select("key", "node", "place", "size")
        leaders *= LEADERS_GROWTH


def with_nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text", F.octet_length("text")))


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` of every document: the smallest doc_id of its near-duplicates."""
    importable(docs.sparkSession)
    rows = with_nodes(docs)
    found = classes(rows.select("node", "text"))
    own = rows.select("doc_id", "node")
    if found is not None:
        own = own.join(found, "node", "left").select("doc_id", F.coalesce("class", "node").alias("node"))
    own = stored(own, "near-own")
    names = own.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return own.join(names, "node").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with its columns.

    Of repeated rows of that document one stays; a document without an id stays only if no other
    of its class has one."""
    importable(docs.sparkSession)
    rows, back = set_aside(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumn("_node", F.xxhash64(text, F.octet_length(text)))
    nodes = with_nodes(docs)
    found = classes(nodes.select("node", "text"))
    # of equal texts one row, then of a class's texts one
    own = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    if found is not None:
        own = own.join(found, "node", "left").select("node", "doc_id", F.coalesce("class", "node").alias("class"))
        best = own.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
        own = best.select("best.node", "best.doc_id")
    own = stored(own.select(F.col("node").alias("_kept"), F.col("doc_id").alias("_id")), "near-kept", narrow=True)
    kept = rows.join(own, (F.col("_node") == F.col("_kept")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_semi")
    repeated = rows.groupBy("doc_id", "_node").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_node"])
    return back(kept)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
