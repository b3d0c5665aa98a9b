"""Find benchmark items in documents: SimHash windows of an item's size, multi-index Hamming blocks, exact verification.

1. A window can be similar to an item only if they share a shingle, so windows (of as many words as the item, the whole document if
   it is shorter) are begun at each shingle of a document that is an item's of that size. Any window can be moved right to its first
   such shingle, or to the document's end, without losing one, so these include a best one, in whatever order the item's parts stand.
   Windows with fewer such shingles than the threshold demands of an item of that size cannot match and are left out.
2. Each window and each item has a 64-bit SimHash of its shingles, equal ones told apart by their number, so that a multiset is a set whose
   Jaccard similarity is the multiset's weighted one, and a word that stands many times weighs no more than its places. It is cut into ``BLOCKS`` blocks of eight bits. Two
   fingerprints within ``RADIUS`` bits of each other differ in at most RADIUS // BLOCKS bits in one of these, so an item is filed in each
   block under all values so near its own, and windows look up items of their size by their own value: no pair within the
   radius is missed. Then the distance is taken. Only fingerprints are filed, some hundred times each; an item's shingles are held once. Two sets at the threshold differ in ten bits on average, with a deviation of three, so a
   radius of 23 is not expected to lose one in a hundred thousand.
3. What is left is verified exactly: the weighted Jaccard similarity of the shingle multisets must reach ``PERCENT``.

Words and shingles are those of the Jaccard join (five words; an item with fewer words is one shingle of its own length). Everything is
built from DataFrame functions. Null text counts as empty, which contains nothing; an item without words matches nothing.
Rows that repeat an id have results of their own.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import BROADCAST_ROWS, materialize, maybe_broadcast, unused

WORDS = 5
PERCENT = 80
RADIUS = 23
BLOCKS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of so many words, in order; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(hashes) - words)
    return F.when(F.size(hashes) < words, F.array().cast("array<long>")).otherwise(F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(words)])))


def numbered(own: Column) -> Column:
    """The shingles of a multiset as a set: the first of equal ones as it is, further ones hashed with their number. own: a sorted column (no expression, for it is read for each shingle)."""
    nth = lambda x, i: (i + 1 - F.array_position(own, x)).cast("int")
    each = F.transform(own, lambda x, i: F.when(nth(x, i) == 0, x).otherwise(F.xxhash64(x, nth(x, i))))
    return F.when(F.size(F.array_distinct(own)) == F.size(own), own).otherwise(each)


def simhash(own: Column) -> Column:
    """64 bits: each the sign of the sum of the shingles' bits."""
    bit = lambda b: F.aggregate(own, F.lit(0), lambda n, x: n + F.when(F.getbit(x, b) == 1, 1).otherwise(-1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, b: F.shiftleft(out, 1).bitwiseOR(F.when(bit(b) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def blocks(fingerprint: Column, radius: int = 0) -> Column:
    """(number, value) of each block of bits; with a radius, all values within radius // BLOCKS bits of a block's own.

    Made from a constant array of numbers and masks: as an expression for each of the some hundred pairs, the code that Spark
    generates takes hundreds of MB to compile, in the driver and in each executor.
    """
    width = 64 // BLOCKS
    masks = [sum(1 << b for b in own) for n in range(radius // BLOCKS + 1) for own in combinations(range(width), n)]
    number = lambda c: F.shiftright(c, width)
    value = lambda c: F.call_function("shiftrightunsigned", fingerprint, number(c) * width).bitwiseXOR(c.cast("long")).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.transform(F.array(*[F.lit(i << width | m) for i in range(BLOCKS) for m in masks]), lambda c: F.struct(number(c).alias("block"), value(c).alias("bits")))


def items(benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """item_id, n_words, gram (words in a shingle), own (its shingles, sorted)."""
    hashed = benchmark.select(F.col(key).alias("item_id"), word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0).distinct()
    gram = F.least(F.size("h"), F.lit(WORDS))
    own = reduce(lambda rest, k: F.when(gram == k, shingles(F.col("h"), k)).otherwise(rest), range(1, WORDS), shingles(F.col("h")))
    return hashed.select("item_id", F.size("h").alias("n_words"), gram.alias("gram"), F.sort_array(own).alias("own"))


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """row (a hash of text), key and item_id: which items each document holds. Equal rows have the same hits."""
    wanted = materialize(items(benchmark), "items")
    grams = sorted(r["gram"] for r in wanted.select("gram").distinct().collect())  # five values at most
    own_row = F.xxhash64(F.col(key), F.coalesce("text", F.lit("")))
    hashed = docs.select(own_row.alias("row"), word_hashes(F.col("text")).alias("h"))
    places = maybe_broadcast(materialize(wanted.select("n_words", "gram", F.explode("own").alias("shingle")).distinct(), "item-shingles"))
    found = []
    for k in grams:
        each = hashed.select("row", F.size("h").alias("size"), F.posexplode(shingles(F.col("h"), k)).alias("pos", "shingle"))
        hits = each.join(places.where(F.col("gram") == k), "shingle").groupBy("row", "size", "n_words", "gram").agg(F.array_sort(F.collect_set("pos")).alias("hits"))
        last = F.col("n_words") - k  # a window's last shingle, from its start; it needs so many hits:
        least = F.ceil((last + 1) * percent / 100).cast("int")
        start = lambda pos: F.greatest(F.lit(0), F.least(pos, F.col("size") - F.col("n_words")))
        full = F.filter(F.col("hits"), lambda pos, i: F.coalesce(F.get(F.col("hits"), i + least - 1) <= start(pos) + last, F.lit(False)))
        found.append(hits.select("row", "n_words", "gram", F.explode(F.array_distinct(F.transform(full, start))).alias("start")))
    if not found:
        return docs.sparkSession.createDataFrame([], "row long, item_id long")
    windows = materialize(reduce(DataFrame.union, found).distinct(), "windows")
    holding = maybe_broadcast(materialize(windows.select("row").distinct(), "holding"))
    texts = docs.select(own_row.alias("row"), "text").join(holding, "row", "left_semi").distinct()
    spans = windows.join(texts.select("row", word_hashes(F.col("text")).alias("h")), "row")
    laid = F.slice("h", F.col("start") + 1, F.col("n_words"))
    own = reduce(lambda rest, k: F.when(F.col("gram") == k, shingles(F.col("words"), k)).otherwise(rest), range(1, WORDS), shingles(F.col("words")))
    spans = spans.select("row", "n_words", "gram", laid.alias("words")).select("row", "n_words", "gram", F.sort_array(own).alias("own")).distinct()
    spans = materialize(spans.withColumn("own", numbered(F.col("own"))), "sets")
    spans = materialize(spans.withColumn("print", simhash(F.col("own"))), "fingerprints")
    wanted = materialize(wanted.withColumn("own", numbered(F.col("own"))), "item-sets")
    marked = materialize(wanted.withColumn("print", simhash(F.col("own"))), "item-prints")
    slot = ((F.col("n_words").cast("long") * BLOCKS + F.col("b.block")) * (1 << 64 // BLOCKS) + F.col("b.bits")).alias("slot")  # a size's block's value
    x = spans.select("row", "n_words", "own", "print", F.explode(blocks(F.col("print"))).alias("b")).select("row", "n_words", "own", "print", slot)
    y = marked.select("n_words", F.col("print").alias("their_print"), F.explode(blocks(F.col("print"), radius)).alias("b")).select(slot, "their_print")
    y = maybe_broadcast(materialize(y.distinct(), "item-blocks"))
    met = x.join(y, "slot").where(F.bit_count(F.col("print").bitwiseXOR(F.col("their_print"))) <= radius)
    met = met.select("row", "n_words", "own", "their_print").dropDuplicates()
    theirs = marked.select("item_id", "n_words", F.col("own").alias("theirs"), F.col("print").alias("their_print"))
    held = theirs.agg(F.sum(F.size("theirs"))).first()[0]
    met = met.join(F.broadcast(theirs) if held <= BROADCAST_ROWS else theirs, ["n_words", "their_print"])
    both = F.size(F.array_intersect("own", "theirs"))
    either = F.size("own") + F.size("theirs") - both
    return met.where(100 * both >= percent * either).select("row", "item_id").distinct()


def mark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", into: str = "item_ids") -> DataFrame:
    """docs with a column of the sorted items that each holds (empty: clean). A column of that name is replaced."""
    row, own = unused(docs, "decontamination_row"), unused(docs, "decontamination_items")
    hits = search(docs, benchmark, key).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias(own))
    hits = maybe_broadcast(materialize(hits, "contaminated")).withColumnRenamed("row", row)
    joined = docs.join(hits, F.xxhash64(F.col(key), F.coalesce("text", F.lit(""))) == F.col(row), "left")
    return joined.withColumn(into, F.coalesce(own, F.array().cast(hits.schema[own].dataType))).drop(row, own)
