"""Quality rules whose cut-offs follow the data of each language and source.

Every document gets a few counts and per-mille rates. Each rate goes into a
log-bucketed quantile sketch: an integer's leading six bits name its bucket, so
a bucket is at most 1/32 wide, sketches merge by adding counts, and the result
does not hang on the order of merging. Sketches are built per (lang, source)
and merged per lang and over all. A rate fails above
``q75 + reach * max(q75 - q25, floor)`` of its group; a group of fewer than
``least`` documents takes its language's fence, and a small language that of
all documents. The fences join back to filter.

Rows: one per input row. A null text counts as empty; a null ``lang`` or
``source`` is a group of its own; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm._text import has_word, let, words
from fieldcast.session import stored

SPAN = 8
#: rate -> the least spread, per mille, that counts as ordinary; REACH times that of
#: repeat_rate is half the base cut-off of 300, so a group that repeats little has its own
RATES = {"symbol_rate": 4, "upper_rate": 40, "dup_line_rate": 60, "repeat_rate": 25}
REACH, LEAST = 6, 100


def repeated_words(w: Column, span: int = SPAN) -> Column:
    """Words of ``w`` inside windows of ``span`` words that occur twice or more."""
    grams = F.when(F.size(w) > span, F.transform(
        F.sequence(F.lit(1), F.size(w) - (span - 1)), lambda i: F.xxhash64(F.slice(w, i, span))))

    def starts(s: Column) -> Column:
        twins = F.filter(s, lambda e, k: F.get(s, k + 1)["h"].eqNullSafe(e["h"])
                         | F.get(s, k - 1)["h"].eqNullSafe(e["h"]))
        return F.sort_array(F.transform(twins, lambda e: e["i"]))

    def total(q: Column) -> Column:
        steps = F.transform(q, lambda v, k: F.least(
            F.lit(span), F.coalesce(F.get(q, k + 1) - v, F.lit(span))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(starts(s), total))

    # the sort is only for texts that repeat something
    return let(grams, lambda g: F.when(
        g.isNull() | (F.size(F.array_distinct(g)) == F.size(g)), 0).otherwise(covered(g)))


def features(docs: DataFrame) -> DataFrame:
    """Counts and per-mille rates of every document."""
    text = F.coalesce("text", F.lit(""))
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
        repeated_words(w).alias("again")))
    of_lines = let(F.filter(F.split(text, "\n"), has_word), lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    raw = docs.select(
        "doc_id", "lang", "source", of_words.alias("w"), of_lines.alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("upper"))
    rate = lambda a, b: F.floor(F.lit(1000) * a / F.greatest(b, F.lit(1))).cast("long")
    return raw.select(
        "doc_id", "lang", "source",
        F.col("w.n").cast("long").alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        F.col("l.again").cast("long").alias("n_dup_lines"),
        F.col("w.again").cast("long").alias("n_repeat_words"),
        rate(F.col("symbols"), F.col("w.chars")).alias("symbol_rate"),
        rate(F.col("upper"), F.col("w.chars")).alias("upper_rate"),
        rate(F.col("l.again"), F.col("l.n")).alias("dup_line_rate"),
        rate(F.col("w.again"), F.col("w.n")).alias("repeat_rate"))


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number from 0 on: itself below 64."""
    shift = F.length(F.bin(v)) - 6
    lead = F.floor(v / F.pow(F.lit(2.0), shift))
    return F.when(v < 64, v).otherwise(F.lit(32) * shift + lead).cast("long")


def sketch(rows: DataFrame, keys: list[str], rates: list[str]) -> DataFrame:
    """keys, rate, bucket, n, top: counts per bucket, with the largest value met."""
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in rates])).alias("e"))
    return (long.select(*keys, "e.rate", "e.v", bucket(F.col("e.v")).alias("bucket"))
            .groupBy(*keys, "rate", "bucket").agg(F.count(F.lit(1)).alias("n"),
                                                  F.max("v").alias("top")))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return (sketches.groupBy(*keys, "rate", "bucket")
            .agg(F.sum("n").alias("n"), F.max("top").alias("top")))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """n, q25 and q75 of each group and rate; a group has a bounded number of buckets."""
    by = Window.partitionBy(*keys, "rate")
    run = sketches.select("*", F.sum("n").over(by).alias("all"), F.sum("n").over(
        by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("top")))
    return run.groupBy(*keys, "rate").agg(F.max("all").alias("n"), at(25).alias("q25"),
                                          at(75).alias("q75"))


def fences(sketches: DataFrame, rates: dict[str, int], reach: int, least: int) -> DataFrame:
    """lang, source and one fence per rate."""
    floor = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    spread = F.greatest(F.col("q75") - F.col("q25"), floor[F.col("rate")])
    fence = lambda q, name: q.select(
        *[c for c in q.columns if c not in ("n", "q25", "q75")], F.col("n").alias(f"{name}_n"),
        (F.col("q75") + reach * spread).alias(name))
    own = fence(quartiles(sketches, ["lang", "source"]), "own")
    lang = fence(quartiles(merged(sketches, ["lang"]), ["lang"]), "of_lang")
    every = fence(quartiles(merged(sketches, []), []), "of_all")
    both = own.join(lang.withColumnRenamed("lang", "_l").withColumnRenamed("rate", "_r"),
                    F.col("lang").eqNullSafe(F.col("_l")) & (F.col("rate") == F.col("_r")))
    chosen = (F.when(F.col("own_n") >= least, F.col("own"))
              .when(F.col("of_lang_n") >= least, F.col("of_lang")).otherwise(F.col("of_all")))
    return (both.join(every, "rate").groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rate") == r, chosen)).alias(f"{r}_fence") for r in rates]))


def apply_rules(docs: DataFrame, rates: dict[str, int] | None = None, reach: int = REACH,
                least: int = LEAST) -> DataFrame:
    """Counts, rates, fences and the verdict of every document."""
    rates = RATES if rates is None else rates
    rows = stored(features(docs), "rule-features")
    limits = fences(stored(sketch(rows, ["lang", "source"], list(rates)), "rule-sketches"),
                    rates, reach, least)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    base_failed = ((F.col("n_words") < 20)
                   | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    inside = F.lit(True)
    for r in rates:
        inside = inside & (F.col(r) <= F.col(f"{r}_fence"))
    return (rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang"))
                      & F.col("source").eqNullSafe(F.col("_source")), "left")
            .drop("_lang", "_source")
            .withColumn("base_failed", base_failed)
            .withColumn("kept", ~base_failed & inside))
