"""Line dedup: a suffix array over line ids, grown by prefix doubling.

The lines of all documents that have a word form sequences. A line met once
anywhere ends every repeat, so only repeated lines stay as suffix starts, and
only complete repeated windows go on: round ``h`` joins the rank of a window of
``h`` lines with the rank ``h`` lines further on, sorts the pairs that occur
twice or more over the whole cluster, and numbers them in that order. Ranks
follow the order of the (hashed) line ids, so they are the suffix array's
positions, with gaps; the suffixes that share a rank in round ``h`` are an
interval of the array whose common prefix is ``h`` or longer. Rounds go on
until no interval has two members, so the longest runs are met whatever they
measure. Binary descent through the ranks then gives each suffix its exact longest
common prefix with an earlier one.

In each interval the earliest member, by (doc_id, line), stays. Where a later
suffix starts a maximal run, that is an interval that does not only carry on the
one a line before, the run's lines are deleted if there are two or more, or if it
is one line of at least ``min_words`` words.

A suffix has no order among rows that share a doc_id: such rows never delete
each other's lines. Null texts and blank lines have nothing to delete and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm._text import has_word, let, words
from fieldcast.session import stored

MIN_WORDS = 50
_KEY = ["_d", "_t"]


def _row_key() -> list[Column]:
    # rows are told apart by id and text; a null id has a number no table uses
    return [F.coalesce("doc_id", F.lit(-(2**63))).alias("_d"), F.xxhash64("text").alias("_t")]


def _here() -> Column:
    return F.struct("_d", "ln")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Windows met twice or more, numbered in the order of ``by``."""
    groups = (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(_here()).alias("first"))
              .where("_n > 1").drop("_n"))
    # ids rise with the sorted order, within and across partitions
    return groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> list[DataFrame]:
    """Per round, the windows that have a twin: _d, _t, ln, rank, later, long."""
    item = F.filter(F.split("text", "\n"), has_word)
    lines = (docs.where(F.col("text").isNotNull())
             .select(*_row_key(), F.posexplode(item).alias("ln", "line"))
             .select(*_KEY, "ln", F.xxhash64("line").alias("k1"),
                     F.xxhash64(F.lit(7), "line").alias("k2"),
                     F.when(F.octet_length("line") < 2 * min_words - 1, False)
                     .otherwise(F.size(words(F.col("line"))) >= min_words).alias("long")))
    level = stored(lines.join(_ranked(lines, ["k1", "k2"]), ["k1", "k2"]).select(
        *_KEY, "ln", "rank", (_here() != F.col("first")).alias("later"), "long"), "suffixes")
    found, h = [level], 1
    while level.limit(1).count():
        further = Window.partitionBy(*_KEY).orderBy("ln").rangeBetween(h, h)
        pairs = level.select(*_KEY, "ln", F.col("rank").alias("r1"),
                             F.max("rank").over(further).alias("r2")).where("r2 is not null")
        pairs = stored(pairs, "suffix-pairs")
        level = stored(pairs.join(_ranked(pairs, ["r1", "r2"]), ["r1", "r2"]).select(
            *_KEY, "ln", "rank", (_here() != F.col("first")).alias("later"),
            F.lit(False).alias("long")), "suffixes")
        found.append(level)
        h *= 2
    return found


def run_lengths(levels: list[DataFrame]) -> DataFrame:
    """_d, _t, ln, lcp: for every suffix with an earlier twin, how many lines it has in
    common with the earlier suffix that shares most.

    The doubling leaves each such suffix in the interval of its longest window
    ``2**k`` that has an earlier copy. Binary descent makes it exact: an interval is
    parted by the rank of the next ``2**s`` lines, and the suffix goes on in its part
    if that holds an earlier one. An interval's members stay at hand, whether they
    still search or not, as long as one of them searches there; suffixes of all
    intervals take a step together.
    """
    pos = ["_d", "_t", "ln"]
    top = len(levels) - 2  # the last level is empty

    def starting(k: int) -> DataFrame:
        """The level, and whose search starts there: longer windows have no earlier copy."""
        more = levels[k + 1].where("later").select(*pos, F.lit(True).alias("more"))
        return levels[k].select(*pos, "rank", "later").join(more, pos, "left").select(
            *pos, "rank", (F.col("later") & F.col("more").isNull()).alias("asks"))

    if top < 0:
        return levels[0].select(*pos, F.lit(1).alias("lcp"))
    rows = None
    for s in range(top - 1, -1, -1):
        level = stored(starting(s + 1), "starting")
        ranks = level.where("asks").select("rank").distinct()
        fresh = level.join(ranks, "rank", "left_semi").select(
            *pos, F.xxhash64(F.lit(s), "rank").alias("state"), F.lit(2 ** (s + 1)).alias("lcp"), "asks")
        rows = fresh if rows is None else rows.unionByName(fresh)
        further = levels[s].select("_d", "_t", F.col("ln").alias("at"), F.col("rank").alias("r"))
        rows = stored(rows.withColumn("at", F.col("ln") + F.col("lcp"))
                      .join(further, ["_d", "_t", "at"], "left").drop("at"), "descent")
        parts = (rows.where("r is not null").groupBy("state", "r")
                 .agg(F.min(_here()).alias("first"), F.max(F.when(F.col("asks"), _here())).alias("last"))
                 .where("last > first").select("state", "r", "first"))
        met = rows.join(parts, ["state", "r"], "left").withColumn(
            "moves", F.col("asks") & F.coalesce(_here() > F.col("first"), F.lit(False)))
        met = stored(met, "descent")
        gone_on = met.where("first is not null").select(
            *pos, F.xxhash64("state", "r").alias("state"), (F.col("lcp") + 2 ** s).alias("lcp"),
            F.col("moves").alias("asks"))
        staying = met.where("asks and not moves").select("state").distinct()
        left = met.join(staying, "state", "left_semi").select(
            *pos, "state", "lcp", (F.col("asks") & ~F.col("moves")).alias("asks"))
        rows = gone_on.unionByName(left)  # read once, by the next step
    out = starting(0).where("asks").select(*pos, F.lit(1).alias("lcp"))
    return out if rows is None else out.unionByName(rows.where("asks").select(*pos, "lcp"))


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_d, _t, gone (sorted numbers of deleted lines among those with a word),
    shared (lines of the longest run that is a later copy)."""
    levels = repeats(docs, min_words)
    lengths = run_lengths(levels)
    # the head of an interval reaches further than the line before it
    before = Window.partitionBy(*_KEY).orderBy("ln").rangeBetween(-1, -1)
    heads = (lengths.withColumn("_b", F.max("lcp").over(before))
             .where("lcp > 1 and (_b is null or lcp > _b - 1)"))
    runs = heads.select(*_KEY, F.sequence("ln", F.col("ln") + F.col("lcp") - 1).alias("at"), "lcp")
    single = levels[0].where("later and long").select(*_KEY, F.array("ln").alias("at"), F.lit(1).alias("lcp"))
    return runs.unionByName(single).groupBy(*_KEY).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("gone"),
        F.max("lcp").alias("shared"))


def _kept_text(text: Column, gone: Column) -> Column:
    def rest(lines: Column) -> Column:
        worded = F.filter(F.transform(lines, lambda x, i: F.when(has_word(x), i)),
                          lambda i: i.isNotNull())
        drop = let(worded, lambda at: F.transform(gone, lambda g: F.get(at, g)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), rest)


def with_removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (all columns of ``docs``), gone (null: nothing), shared, and kept, the
    text without its later copies, for every row of ``docs``."""
    out = docs.select(F.struct("*").alias("row"), *_row_key()).join(
        removals(docs, min_words), _KEY, "left").drop(*_KEY)
    text = F.col("row.text")
    return out.withColumn("kept", F.when(F.size("gone") > 0, _kept_text(text, F.col("gone")))
                          .otherwise(text))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies deleted from ``text`` and ``n_chars`` counted
    anew; a document of which no word is left goes."""
    out = with_removals(docs, min_words)
    cut = F.coalesce(F.size("gone") > 0, F.lit(False))
    old = {c: F.col(f"row.`{c}`") for c in docs.columns}
    new = {"text": F.col("kept"), "n_chars": F.when(cut, F.length("kept").cast("long"))}
    return out.where(~cut | has_word(F.col("kept"))).select(*[
        (F.coalesce(new[c], old[c]) if c in new else old[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: lines with a word, deleted lines, maximal deleted runs, the
    longest of them, the longest run that is a later copy and the kept text's digest."""
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    runs = let(gone, lambda g: let(
        F.transform(F.filter(F.transform(g, lambda v, k: F.struct(v.alias("v"), k.alias("k"))),
                             lambda e: ~F.get(g, e["k"] + 1).eqNullSafe(e["v"] + 1)),
                    lambda e: e["k"]),
        lambda e: F.transform(e, lambda v, k: v - F.coalesce(F.get(e, k - 1), F.lit(-1)))))
    return with_removals(docs.select("doc_id", "text"), min_words).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.filter(F.split(F.coalesce("row.text", F.lit("")), "\n"), has_word))
        .cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(runs).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(runs), F.lit(0)).cast("long").alias("longest_run"),
        F.coalesce("shared", F.lit(0)).cast("long").alias("shared_lines"),
        F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))
