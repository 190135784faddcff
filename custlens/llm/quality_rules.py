"""Operator 4 [native]: quality rules with adaptive thresholds.

Each document has counts (below) and four shares derived from them.  Per (lang, source) a
mergeable quantile sketch (KLL) of each share is built over all documents that pass the base
rule; the groups' sketches are merged into one per language and one for everything.  A share's
limit in a sketch is its median plus ``SPREADS`` times the shorter of the median's distances to the
lower and the upper decile (so neither a low tail nor a tenth of junk widens it), at least the median
plus the share's least step where that spread is narrower, and at most half way from the median to 1,
so that a share can always reject.  Limits are blended by size: a group of n documents
counts n / (n + ``BLEND``) and its language the rest, a language likewise with everything, so no
limit jumps when a row is added.  The
documents are then joined with their group's thresholds: a document is kept if it passes the
base rule and none of its shares exceeds its threshold.

Counts, over words ``[^\\x20\\x09-\\x0D]+``: ``n_words``; ``word_chars`` code points in words;
``n_symbols`` of ``[#*$%&|<>]``; ``n_dup_lines`` lines with a word that equal an earlier line;
``n_repeat_words`` words in 3-word windows found twice or more in the text (windows are compared
by a 64-bit hash); ``n_shout`` of ``[!A-Z]``; ``n_lines`` with a word.

Defined cases: a null text has no words; a document without words fails the base rule; null
lang or source form groups of their own; repeated rows count and are judged as separate
documents; other columns are ignored (``op4``) or passed on (``filter_documents``); an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.tables import set_aside, stored, table

SPACES = r"[ \t\n\x0B\f\r]+"
#: Share and the least step of its threshold above the median.
SHARES = {"symbol_share": 0.05, "shout_share": 0.2, "dup_line_share": 0.4, "repeat_share": 0.3}
SPREADS = 8.0
BLEND = 100
SKETCH_K = 400
MIN_WORDS = 50
MOST_REPEATED = 0.5


def with_counts(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds struct column ``out`` with the counts of column ``text``."""
    t = F.coalesce(F.col(text), F.lit(""))
    c = {x: f"{out}_{x}" for x in ("w", "lines", "g", "s", "p")}
    df = df.withColumns({
        c["w"]: F.filter(F.split(t, SPACES), lambda x: x != ""),
        c["lines"]: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))})
    n = F.size(c["w"])
    window = lambda i: F.xxhash64(*[F.get(F.col(c["w"]), i + j) for j in range(3)])
    df = df.withColumn(c["g"], F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    # only texts with a repeated window sort them
    repeated = F.size(F.array_distinct(c["g"])) < F.size(c["g"])
    df = df.withColumn(c["s"], F.when(repeated, F.sort_array(F.transform(c["g"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn(c["s"], _repeated_places(c["s"]))
    df = df.withColumn(c["p"], _covered(c["s"]))
    return df.withColumn(out, F.struct(
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join(c["w"], "")).cast("bigint").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(c["p"], F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")).alias("n_repeat_words"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[!A-Z]+", ""))).cast("bigint").alias("n_shout"),
        F.size(c["lines"]).cast("bigint").alias("n_lines"))).drop(*c.values())


def _repeated_places(s: str) -> Column:
    """Of windows sorted by (hash, place): the places, ascending, of those found twice or more."""
    like = lambda e, j: F.coalesce(F.get(F.col(s), j)["h"] == e["h"], F.lit(False))
    found = F.filter(s, lambda e, i: like(e, i - 1) | like(e, i + 1))
    return F.sort_array(F.transform(found, lambda e: e["i"]))


def _covered(p: str) -> Column:
    """Words that each window adds to those that the windows before it cover."""
    return F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col(p), i + 1) - x, F.lit(3))))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def shares(c: Column) -> dict[str, Column]:
    part = lambda a, b: a / F.greatest(b, F.lit(1))
    return {"symbol_share": part(c["n_symbols"], c["word_chars"]), "shout_share": part(c["n_shout"], c["word_chars"]),
            "dup_line_share": part(c["n_dup_lines"], c["n_lines"]), "repeat_share": part(c["n_repeat_words"], c["n_words"])}


def thresholds(counted: DataFrame, counts: str) -> DataFrame:
    """One row per (lang, source): ``limits``, a struct with a threshold for each share (null
    where no document at all passes the base rule)."""
    c = F.col(counts)
    own = counted.select("lang", "source", base_failed(c).alias("out"), *[x.alias(k) for k, x in shares(c).items()])
    own = own.groupBy("lang", "source").agg(
        F.sum((~F.col("out")).cast("bigint")).alias("n"),
        *[F.kll_sketch_agg_double(F.when(~F.col("out"), F.col(k)), SKETCH_K).alias(k) for k in SHARES])
    # merged over the sources of a language, and over all
    rolled = stored(own, "rule-sketches")
    merged = lambda df: df.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in SHARES])
    languages = merged(rolled.groupBy("lang"))
    everything = merged(rolled.groupBy())

    def limits(n: str) -> Column:
        def one(k: str, step: float) -> Column:
            q = F.kll_sketch_get_quantile_double(F.col(k), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
            low, mid, high = q[0], q[1], q[2]
            wide = mid + F.greatest(F.lit(step), SPREADS * F.least(mid - low, high - mid))
            return F.least(wide, (1 + mid) / 2).alias(k)
        return F.when(F.col(n) > 0, F.struct(*[one(k, step) for k, step in SHARES.items()]))

    def blended(n: str, own: Column, wider: Column) -> Column:
        w = F.col(n) / (F.col(n) + BLEND)
        return F.struct(*[F.coalesce(w * own[k] + (1 - w) * wider[k], own[k], wider[k]).alias(k) for k in SHARES])

    own = rolled.select("lang", "source", "n", limits("n").alias("own"))
    languages = languages.select(F.col("lang").alias("_lang"), F.col("n").alias("lang_n"), limits("n").alias("by_lang"))
    general = everything.select(limits("n").alias("all")).scalar()
    joined = own.join(languages, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("all", general)
    joined = joined.withColumn("by_lang", blended("lang_n", F.col("by_lang"), F.col("all")))
    return joined.select("lang", "source", blended("n", F.col("own"), F.col("by_lang")).alias("limits"))


def judge(counted: DataFrame, counts: str, kept: str) -> DataFrame:
    """Adds ``kept`` to rows that have their counts (the rows must be stored: they are read twice)."""
    limits = stored(thresholds(counted, counts), "rule-thresholds").select(F.col("lang").alias("_rule_lang"), F.col("source").alias("_rule_source"), F.col("limits").alias("_rule_limits"))
    out = counted.join(limits, F.col("lang").eqNullSafe(F.col("_rule_lang")) & F.col("source").eqNullSafe(F.col("_rule_source")))
    c = F.col(counts)
    within = F.lit(True)
    for k, x in shares(c).items():
        within = within & F.coalesce(x <= F.col("_rule_limits")[k], F.lit(True))
    return out.withColumn(kept, ~base_failed(c) & within).drop("_rule_lang", "_rule_source", "_rule_limits")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    rows, back = set_aside(docs)
    counted = stored(with_counts(rows, "text", "_rule_counts"), "rule-documents")
    return back(judge(counted, "_rule_counts", "_rule_kept").where("_rule_kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    counted = with_counts(docs.select("doc_id", "lang", "source", "text"), "text", "c").drop("text")
    counted = stored(counted, "rule-counts")
    out = judge(counted, "c", "kept")
    return out.select("doc_id", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words", base_failed(F.col("c")).alias("base_failed"), "kept")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
