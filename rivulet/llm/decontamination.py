"""Benchmark decontamination, in DataFrame functions only.

Windows as long as a benchmark item are laid over each document wherever it has a word shingle
of an item, at the place that shingle has in the item (a window without a common shingle has
similarity 0). Windows and items get 64-bit SimHash fingerprints of their shingles, weighted by
how often each occurs. RADIUS + 1 blocks of the fingerprint index the items: two fingerprints
within the radius agree on a block, so the join on blocks finds all of them. Candidates are then
decided by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, checkpoint, free_prefix

#: At similarity 0.8 two fingerprints differ in about 10 of 64 bits, in more than 22 with a chance below 1 in 20,000.
BITS, RADIUS = 64, 22
#: Benchmarks of at most so many shingles (about 50 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_SHINGLES = 500_000


def word_codes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text, in order; null and blank texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(codes: Column, width: int) -> Column:
    """Hashes of the shingles of width words, in order; shorter texts have none."""
    starts = F.when(F.size(codes) >= width, F.sequence(F.lit(1), F.size(codes) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(codes, i + (k - 1)) for k in range(width)]))


def _own_shingles(codes: Column) -> Column:
    """Shingles of SHINGLE_WORDS words; of all words where there are fewer."""
    out = shingles(codes, SHINGLE_WORDS)
    for width in range(1, SHINGLE_WORDS):
        out = F.when(F.size(codes) == width, shingles(codes, width)).otherwise(out)
    return out


def simhash(hashes: Column) -> Column:
    """64 bits: each is the majority of the hashes' bits at its place, every occurrence counting."""

    def with_bit(out: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return out.bitwiseOR(F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), with_bit)


def _blocks(bits: Column) -> Column:
    """The RADIUS + 1 blocks of a fingerprint."""
    cuts = [round(k * BITS / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return F.array(*[F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def weighted_similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of the smaller and of the larger counts of the shingles of two texts: their quotient is the similarity."""
    count = lambda hashes, e: F.size(F.filter(hashes, lambda h: h == e))
    low = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, e: n + F.least(count(a, e), count(b, e)))
    return low, F.size(a) + F.size(b) - low


def _bit_table(own: DataFrame, n: int):
    """A test that every shingle of the benchmark passes, and one in 30 others: a bit table of at most 128 kB."""
    words = 1 << max(6, min(14, (32 * n // 64).bit_length()))
    place = F.pmod(F.shiftrightunsigned("_shingle", 6), F.lit(words))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_shingle").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = own.groupBy(place.alias("p")).agg(F.bit_or(bit).alias("v")).collect()  # at most one row a word of the table
    table = np.zeros(words, np.int64)
    for p, v in rows:
        table[p] = v
    bits = F.lit(table)
    return lambda s: F.getbit(F.get(bits, F.pmod(F.shiftrightunsigned(s, 6), F.lit(words)).cast("int")), s.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def _tested(has):
    return lambda x: has(x["s"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start_word, n_words, similarity): the best window of each document and benchmark item at similarity >= percent / 100.

    Of equally similar windows the first counts. Null, empty and blank texts and items leak
    nothing; a document whose id is null keeps it; repeated rows of a document or an item give one
    result; empty tables give no rows; other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), word_codes(F.col(item_text_col)).alias("_codes")).where(F.size("_codes") > 0)
    items = items.withColumn("_own", _own_shingles(F.col("_codes"))).withColumn("_n", F.size("_codes"))
    items = items.withColumn("_bits", simhash(F.col("_own"))).dropDuplicates(["_item", "_codes"])
    items = checkpoint(items.withColumn("_key", F.monotonically_increasing_id()))  # fixed by the table that is written
    size = items.agg(F.sum(F.size("_own"))).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_SHINGLES else (lambda df: df)
    widths = [r[0] for r in items.select(F.least("_n", F.lit(SHINGLE_WORDS)).alias("w")).distinct().collect()]  # at most SHINGLE_WORDS numbers
    # Outer explodes: for others Spark adds a filter on the array's size below, which computes the array's expressions again, many times over.
    places = items.select("_n", F.posexplode("_own").alias("_at", "_shingle")).distinct()

    longest = items.agg(F.max("_n")).first()[0] or 0
    coded = docs.select(F.col(id_col).alias("_id"), word_codes(F.col(text_col)).alias("_w"))
    found = None
    for width in sorted(widths):
        own = places.where(F.least("_n", F.lit(SHINGLE_WORDS)) == width).select("_shingle", F.col("_n").alias("_size"), "_at")
        own = own.groupBy("_shingle").agg(F.collect_set(F.struct("_size", "_at")).alias("_places"))
        has = _bit_table(own, size)
        # Shingles that the table rules out are dropped before rows are made; a row takes along the words that its windows can hold.
        met = coded.select("_id", "_w", F.transform(shingles(F.col("_w"), width), lambda s, i: F.struct(i.alias("pos"), s.alias("s"))).alias("_all"))
        near = lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"), F.slice("_w", F.greatest(F.lit(0), x["pos"] - longest) + 1, F.lit(2 * longest)).alias("near"))
        met = met.select("_id", F.size("_w").alias("_words"), F.transform(F.filter("_all", _tested(has)), near).alias("_some"))
        met = met.select("_id", "_words", F.explode_outer("_some").alias("_x")).where("_x IS NOT NULL").select("_id", "_words", F.col("_x.pos").alias("_pos"), F.col("_x.s").alias("_s"), F.col("_x.near").alias("_near"))
        met = met.join(small(own), F.col("_s") == F.col("_shingle")).select("_id", "_words", "_pos", "_near", F.explode("_places").alias("_p"))
        low = F.greatest(F.lit(0), F.least(F.col("_pos") - F.col("_p._at"), F.col("_words") - F.col("_p._size")))
        met = met.select("_id", F.col("_p._size").alias("_size"), low.alias("_start"), F.greatest(F.lit(0), F.col("_pos") - longest).alias("_from"), "_near")
        met = met.select("_id", "_size", "_start", F.slice("_near", F.col("_start") - F.col("_from") + 1, F.col("_size")).alias("_window"))
        found = met if found is None else found.unionByName(met)
    kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    if found is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind[0]}, `{item_col}` {kind[1]}, start_word int, n_words int, similarity double")
    windows = found.dropDuplicates(["_id", "_size", "_start", "_window"])
    windows = windows.withColumn("_shingles", _own_shingles(F.col("_window")))
    # Behind a checkpoint, so that no filter of the join below is moved under the fingerprints and computes them again.
    windows = checkpoint(windows.withColumn("_print", simhash(F.col("_shingles"))))

    # The index holds numbers only; an item's shingles are fetched once for those within the radius.
    index = items.select("_key", "_n", "_bits", F.posexplode_outer(_blocks(F.col("_bits"))).alias("_ib", "_iv"))
    blocks = windows.select("_id", "_size", "_start", "_shingles", "_print", F.posexplode_outer(_blocks(F.col("_print"))).alias("_wb", "_wv"))
    hits = blocks.join(small(index), (F.col("_size") == F.col("_n")) & (F.col("_wb") == F.col("_ib")) & (F.col("_wv") == F.col("_iv")))
    # A window and an item that agree on several blocks are taken at the first of them.
    differ = F.col("_print").bitwiseXOR(F.col("_bits"))
    first = F.array_position(_blocks(differ), F.lit(0).cast("long")) - 1
    hits = hits.where((F.bit_count(differ) <= RADIUS) & (F.col("_wb") == first))
    hits = hits.join(small(items.select("_key", "_item", F.col("_own").alias("_other"))), "_key")
    low, high = weighted_similarity(F.col("_shingles"), F.col("_other"))
    scored = hits.select("_id", "_item", "_start", "_size", low.alias("_low"), high.alias("_high")).where(F.col("_low") * 100 >= F.col("_high") * percent)
    best = F.max(F.struct((F.col("_low") / F.col("_high")).alias("s"), (-F.col("_start")).alias("at"), F.col("_size").alias("n"))).alias("_best")
    out = scored.groupBy("_id", "_item").agg(best)
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), (-F.col("_best.at")).alias("start_word"), F.col("_best.n").alias("n_words"), F.col("_best.s").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that leak no benchmark item; all columns are kept, and rows without an id go only with their likes."""
    leak = f"{free_prefix(docs)}leak"
    leaks = find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(leak)).distinct()
    return docs.join(leaks, F.col(f"`{id_col}`").eqNullSafe(F.col(leak)), "left_anti")
