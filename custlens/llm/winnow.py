"""Operator 5 [native]: document fingerprints by winnowing.

A text's words are hashed, every ``K`` consecutive words give a gram hash, and of each window of
``WINDOW`` consecutive grams the smallest is chosen, the rightmost one on ties.  The chosen
(position, hash) pairs are the fingerprint: two texts that share ``K + WINDOW - 1`` consecutive
words share a chosen gram, and the positions say where.  Window minima are taken by doubling
(minima of 2, 4, 8 grams), so a text costs O(words); a gram's hash and position travel in one
long (hash above, complement of the position below), so that its minimum breaks ties to the
right.

Neighbours in descending ``doc_id`` come together by one shuffle: blocks of ids between exact
cut points (existing ids, from a distributed quantile sketch); the first row of each block is
sent to the preceding block as well, and the first row of all to the last block.

Defined cases: a null text counts as empty; a text of 1 to ``K`` - 1 words has one gram of all
its words; a text without words has an empty fingerprint; the likeness (Jaccard, of the chosen
hashes) of two empty fingerprints is 1 and of an empty and another 0; rows that repeat a
``doc_id`` are ordered by their text, so a repeated row's next row may be its copy; null ids come
last; a single document is its own next; where no row has an id, the last has an empty next; an
empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 5
WINDOW = 8   # a power of two
SPACES = r"[ \t\n\x0B\f\r]+"
_POSITION_BITS = 31
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def _chosen(df: DataFrame, text: str, out: str, k: int, window: int) -> DataFrame:
    """Adds ``out``: the chosen grams of column ``text``, as packed longs in text order."""
    w, g = f"{out}_w", f"{out}_g"
    df = df.withColumn(w, F.filter(F.split(F.col(text), SPACES), lambda x: x != ""))
    df = df.withColumn(w, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(w)

    def gram(i: Column) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]), 32)
        return F.shiftleft(h, _POSITION_BITS).bitwiseOR(F.lit(_POSITION_MASK).cast("bigint") - i)

    alone = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(w), 32), _POSITION_BITS).bitwiseOR(F.lit(_POSITION_MASK).cast("bigint")))
    df = df.withColumn(g, F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram)).when(n > 0, alone).otherwise(F.array().cast("array<bigint>")))
    span = 1
    while span < window:
        df = df.withColumn(g, _least_with(g, span))
        span *= 2
    windows = F.greatest(F.size(g) - (window - 1), F.least(F.size(g), F.lit(1)))
    return df.withColumn(out, F.array_distinct(F.slice(F.col(g), F.lit(1), windows))).drop(w, g)


def _least_with(column: str, ahead: int) -> Column:
    """Each element or the one ``ahead`` of it, whichever is smaller."""
    return F.transform(column, lambda x, i: F.least(x, F.get(F.col(column), i + ahead)))


def _position(v: Column) -> Column:
    return F.lit(_POSITION_MASK).cast("bigint") - v.bitwiseAND(F.lit(_POSITION_MASK).cast("bigint"))


def _text_form(chosen: str) -> Column:
    """``position:hash`` (hash in 8 hex digits), in text order, blank-separated."""
    return F.array_join(F.transform(chosen, lambda v: F.concat(_position(v).cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(F.shiftright(v, _POSITION_BITS)), 8, "0")))), " ")


def _hashes(chosen: str) -> Column:
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, _POSITION_BITS)))


def _likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    both = f"{out}_both"
    df = df.withColumn(both, F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - F.col(both)
    return df.withColumn(out, F.when(union == 0, F.lit(1.0)).otherwise(F.col(both) / union)).drop(both)


def beside_next(df: DataFrame, key: str, text: str, blocks: int, prepare: Callable[[DataFrame], DataFrame], lead: dict[str, str]) -> DataFrame:
    """Each row with values of the next row in descending ``key`` (after the last: of the first).

    ``key`` is a bigint column, ``text`` a string column without nulls that orders equal keys.
    ``prepare`` adds columns to the rows once they lie in their blocks; ``lead`` maps new columns
    to those they take from the next row.  The driver gets ``blocks`` cut points, as many as the
    partitions it deals out to.
    """
    shares = [(i + 1) / blocks for i in range(blocks)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * blocks)).alias("cuts"), F.max(key).alias("top")).first()
    cuts = sorted({*(found["cuts"] or ()), found["top"]} - {None}) or [0]
    # the block of a key: how many cut points lie below it, counted in two steps of about sqrt(blocks)
    wide = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]
    as_long = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    near = F.array(*[as_long(r) for r in rows])
    df = df.withColumn("_row", F.size(F.filter(as_long([r[-1] for r in rows]), lambda c: c < F.col(key))))
    df = df.withColumn("_in", F.size(F.filter(F.get(near, F.col("_row")), lambda c: c < F.col(key))))
    block = F.when(F.col(key).isNull(), 0).otherwise(F.col("_row") * wide + F.col("_in"))
    is_cut = F.coalesce(F.get(F.get(near, F.col("_row")), F.col("_in")) == F.col(key), F.lit(False))
    # the rows of a block's highest key also follow the block above; those of the highest of all, the last row of all
    above = block + 1 < len(cuts)
    own = F.struct(block.alias("block"), F.lit(0).alias("after"))
    also = F.struct(F.when(above, block + 1).otherwise(0).alias("block"), F.when(above, 1).otherwise(2).alias("after"))
    df = df.withColumn("_at", F.explode(F.when(is_cut, F.array(own, also)).otherwise(F.array(own))))
    df = df.withColumns({"_block": F.col("_at.block"), "_after": F.col("_at.after")}).drop("_row", "_in", "_at")
    df = prepare(df.repartition("_block"))
    order = Window.partitionBy("_block").orderBy("_after", F.col(key).desc_nulls_last(), F.col(text))
    return df.withColumns({new: F.lead(old).over(order) for new, old in lead.items()}).where("_after = 0").drop("_after", "_block")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_chars, chosen`` and ``fingerprint`` of every document's text."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    return _chosen(df, "_t", "chosen", k, window).select("doc_id", F.char_length("_t").cast("bigint").alias("n_chars"), "chosen", _text_form("chosen").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint beside those of its edited text (its last third replaced by
    the beginning of the next document) and of the next document."""
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = beside_next(df, "doc_id", "_t", blocks, lambda d: _chosen(d, "_t", "_fp", k, window), {"_next": "_t", "_fn": "_fp"})
    df = df.withColumn("n_chars", F.char_length("_t").cast("bigint"))
    df = df.withColumn("_third", F.floor(F.col("n_chars") / F.lit(3)).cast("int"))
    own = F.col("_t").substr(F.lit(1), (F.col("n_chars") - F.col("_third")).cast("int"))
    df = df.withColumn("_edited", F.concat(own, F.coalesce(F.col("_next"), F.lit("")).substr(F.lit(1), F.col("_third"))))
    df = _chosen(df, "_edited", "_fe", k, window)
    df = df.withColumn("_fn", F.coalesce("_fn", F.array().cast("array<bigint>")))
    for chosen in ("_fp", "_fn", "_fe"):
        df = df.withColumn(f"{chosen}h", _hashes(chosen))
    df = _likeness(df, "_fph", "_feh", "near_edited")
    df = _likeness(df, "_fph", "_fnh", "near_next")
    return df.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), _text_form("_fp").alias("fingerprint"), _text_form("_fe").alias("edited_fingerprint"), "near_edited", "near_next")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custlens.llm.tables import table
    return edited_fingerprints(table(spark, sf_dir, "documents"))
