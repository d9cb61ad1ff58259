"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source with target T and size S is read floor(T / S) whole times; the remainder is drawn
without replacement: each document has the key -ln(u) / weight, with u from a hash of its id and
the seed, and the documents with the smallest keys are taken up to the remaining budget. Keys
are dealt into buckets by their size, so only the bucket in which the budget ends is sorted and
prefix-summed; sums of the others come from a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_words

#: Most epochs over a source, and the key buckets of a source.
MAX_EPOCHS, BUCKETS = 3, 2048
#: Plans of at most so many sources are broadcast (about 100 bytes each); longer ones are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Digits of md5 that make u; 52 bits fit a double.
_DIGITS = 13


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key, the same on every run."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, _DIGITS)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def text_quality(text: Column) -> Column:
    """A weight in [0.25, 1]: the share of letters, marks and spaces in a text's characters; null or empty: 0.25."""
    n = F.length(text)
    other = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\x20\x09-\x0D]+", ""))
    share = F.when(n > 0, 1.0 - other / n).otherwise(0.0)
    return F.greatest(F.lit(0.25), F.coalesce(share, F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: list[int], share: float = 1.0, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, get the weights in turn. Targets share `share` of all
    sizes by weight; none exceeds cap times its size, and what is above is shared again among
    the others. The sorted ratio cap * size / weight tells which sources are capped.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * cap)
    upto = everything.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_rank").asc())
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "_all": F.sum("source_size").over(everything) * F.lit(float(share)),
        "_caps": F.sum("_cap").over(earlier),
        "_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0)),  # a frame without an end is computed anew for each row
    })
    level = (F.col("_all") - F.coalesce(F.col("_caps"), F.lit(0))) / F.col("_left")
    # The level rises while the sources that it overfills are set aside, and falls after: its peak is the one that holds.
    ranked = ranked.withColumn("_level", F.max(level).over(everything))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: list[int], *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality: Column | None = None, share: float = 1.0, seed: int = 17, carried: bool = False) -> DataFrame:
    """What the mix takes of each document: (id, size, source_size, target, taken), all in words.

    taken is a multiple of size: whole documents, at most MAX_EPOCHS times. The document that the
    budget ends in is taken if that brings its source nearer to its target. A null text has size 0
    and is never taken; a null source is a source; equal keys are ordered by id and size, and
    repeated rows are documents of their own; an empty table gives no rows; other columns are
    not read, unless the rows are carried: then each is beside its own plan, as a struct `row`, and
    rows of equal key, id and size are ordered by a hash of all columns.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        (-F.log(uniform(F.col(id_col), seed)) / (text_quality(F.col(text_col)) if quality is None else quality)).alias("_key"),
        *([F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("_tie")] if carried else []),
    )
    # exp(-key) is in (0, 1) and falls as the key grows: equal steps of it are the buckets.
    rows = rows.withColumn("_bucket", F.floor((1.0 - F.exp(-F.col("_key"))) * BUCKETS).cast("int"))
    rows = checkpoint(rows)  # a few dozen bytes a document, if rows aren't carried: the texts are read once
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share)
    targets = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = buckets.withColumnRenamed("source", "_source").withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    ends = ends.join(targets, F.col("_source").eqNullSafe(F.col("source"))).where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_size") > F.col("_rest")))
    ends = ends.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_end"), F.col("_before").alias("_base"))
    plan = targets.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s")
    plan = checkpoint(plan)
    small = plan.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(plan) if small else plan, rows["source"].eqNullSafe(plan["_s"])).drop("_s")
    edge = rows.where(F.col("_bucket") == F.col("_end"))
    run = Window.partitionBy("source").orderBy("_key", "_id", "size", *(["_tie"] if carried else [])).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_at", F.col("_base") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    edge = edge.withColumn("_more", (F.col("_at") + F.col("size") / 2 <= F.col("_rest")).cast("long"))
    rest = rows.where(F.col("_end").isNull() | (F.col("_bucket") != F.col("_end"))).withColumn("_more", (F.col("_end").isNotNull() & (F.col("_bucket") < F.col("_end"))).cast("long"))
    picks = ["_id", "size", "source_size", "target", "_epochs", "_more", *(["row"] if carried else [])]
    both = rest.select(picks).unionByName(edge.select(picks))
    return both.select(F.col("_id").alias(id_col), "size", "source_size", "target", ((F.col("_epochs") + F.col("_more")) * F.col("size")).alias("taken"), *(["row"] if carried else []))
