"""Benchmark passages in documents, in DataFrame operations only.

A window is as many words long as the item it is held against.  Text is described by the hashes of its five-word
shingles (words are runs of letters and digits, lower case; an item of fewer words is one shingle); a shingle weighs
ln(1 + items / items with it), and one that no item holds weighs nothing.  So a window is the set of the items' shingles
in it, and text without any needs no window: the similarity (the share of an item's weight that the window holds) is 0.

Windows start at each place of a shingle that an item of that length holds.  This loses none: the window from the first
shingle shared with an item on holds all that any window from further left holds.  A window whose weight is
below ``least`` of the lightest item of its length is left out.  Equal windows of different documents are one.

Candidates: weighted 64-bit SimHash of window and item; 8 blocks of 8 bits; two fingerprints within ``RADIUS`` = 23 bits have
a block within 2 bits, and items are listed under every value within 2 bits of each of their blocks, so that a
join on (length, block, value) finds all of them.  At a similarity of 0.8 a window differs from its item by some 9 bits,
or 13 where the rest of it is filled by other items' shingles.  Verification: the similarity from the sets, exactly.

Documents and items with a null or wordless text match nothing.  Rows with one doc_id (also a null one) are told apart by
their text, equal rows are one; of windows with equal similarity the first is reported.  An empty table gives no row.
Other columns are not read.  A text of any length gives an array of its shingles in its own row only; what is exploded
carries no array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.storage import Scratch

WIDTH = 5
RADIUS = 23
BLOCKS = 8
#: Shingles of the items that are broadcast at most (some 100 bytes each); more are joined by shuffle, salted.
MOST_BROADCAST = 1_000_000
SALTS = 32


WORDS = r"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+', 0)"


def _words(text: str) -> Column:
    return F.expr(WORDS.format(text=text))


def _shingles(words: str, width: int) -> Column:
    """Hash of the ``width`` words from each place of the array ``words``; none of a shorter one.

    The outer transform binds the array once: else the optimizer puts its expression into the inner lambda.
    """
    terms = ", ".join(f"get(w, i + {k})" for k in range(width))
    inner = f"if(size(w) >= {width}, transform(sequence(0, greatest(size(w) - {width}, 0)), i -> xxhash64({terms})), cast(array() as array<bigint>))"
    return F.expr(f"element_at(transform(array({words}), w -> {inner}), 1)")


def _simhash(weights: str) -> Column:
    """Weighted SimHash of an array of (h, w), sorted by h so that equal sets have equal sums."""
    bit = f"aggregate({weights}, 0D, (a, x) -> a + if((shiftrightunsigned(x.h, b) & 1L) = 1L, x.w, -x.w)) > 0"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (fp, b) -> if({bit}, fp | shiftleft(1L, b), fp))")


def _byte(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).cast("int")


def _weight(weights: str) -> Column:
    return F.expr(f"aggregate({weights}, 0D, (a, x) -> a + x.w)")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), width, weights (h and w of distinct shingles, by h), whole (their sum), fp."""
    words = benchmark.select("item_id", _words("text").alias("w")).where(F.size("w") > 0)
    sized = words.withColumn("n", F.size("w")).withColumn("width", F.least(F.col("n"), F.lit(WIDTH)))
    shingles = F.lit(None).cast("array<bigint>")
    for width in range(1, WIDTH + 1):
        shingles = F.when(F.col("width") == width, _shingles("w", width)).otherwise(shingles)
    texts = sized.select("item_id", "n", "width", F.array_sort(F.array_distinct(shingles)).alias("hs")).distinct()
    # an id with several texts is several items
    keyed = texts.withColumn("item", F.xxhash64("item_id", "n", "width", "hs"))
    held = keyed.select("item", "item_id", "n", "width", F.explode("hs").alias("h"))
    df = held.groupBy("width", "h").agg(F.log1p(F.lit(keyed.count()) / F.count("*")).alias("w"))
    made = held.join(df, ["width", "h"]).groupBy("item", "item_id", "n", "width").agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("weights"))
    return made.withColumn("whole", _weight("weights")).withColumn("fp", _simhash("weights"))


def _vocabulary(items: DataFrame) -> DataFrame:
    """width, h, w, lengths: a shingle with the lengths of the items that hold it, each with the weight of the lightest item of that length."""
    lightest = items.groupBy("width", "n").agg(F.min("whole").alias("lightest"))
    held = items.select("width", "n", F.explode("weights").alias("x")).select("width", "n", "x.h", "x.w").distinct()
    return held.join(lightest, ["width", "n"]).groupBy("width", "h", "w").agg(F.array_sort(F.collect_list(F.struct("n", "lightest"))).alias("lengths"))


def _hits(docs: DataFrame, width: int, vocabulary: DataFrame, small: bool) -> DataFrame:
    """doc_id, text_hash, width, size (places), hits (place, h, w, lengths by place) of documents that hold shingles of items."""
    hashed = docs.select("doc_id", "text_hash", _shingles(WORDS.format(text="text"), width).alias("s"))
    placed = hashed.select("doc_id", "text_hash", F.size("s").alias("size"), F.posexplode("s").alias("i", "h"))
    own = vocabulary.where(F.col("width") == width).drop("width")
    if small:
        joined = placed.join(F.broadcast(own), "h")
    else:  # a shingle that many documents hold is joined in many tasks
        salted = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "i"), F.lit(SALTS)))
        joined = salted.join(own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["h", "salt"]).drop("salt")
    hits = joined.groupBy("doc_id", "text_hash", "size").agg(F.array_sort(F.collect_set(F.struct("i", "h", "w", "lengths"))).alias("hits"))
    return hits.select("doc_id", "text_hash", F.lit(width).alias("width"), "size", "hits")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = RADIUS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, start_word: the best window of every document and item that match."""
    scratch = Scratch(docs.sparkSession, "leaks")
    items = scratch.write(items_of(benchmark), "items")
    vocabulary = scratch.write(_vocabulary(items), "vocabulary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    counts = vocabulary.groupBy("width").count().orderBy("width").collect()  # WIDTH rows at most
    if not counts:
        return rows.select("doc_id", "text_hash", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word")).where("false")
    hits = None
    for width, count in counts:
        some = _hits(rows, width, vocabulary, count <= most_broadcast)
        hits = some if hits is None else hits.unionByName(some)
    # a window is the slice of the hits from one on, as long as the item, up to the window's end
    content = "array_sort(array_distinct(transform(filter(slice(hits, at + 1, y.n - width + 1), z -> z.i < x.i + y.n - width + 1), z -> struct(z.h as h, z.w as w))))"
    made = F.expr(f"flatten(transform(hits, (x, at) -> transform(x.lengths, y -> struct(x.i as i, y.n as n, y.lightest as lightest, {content} as window))))")
    heavy = F.filter(made, lambda m: F.aggregate(m["window"], F.lit(0.0), lambda a, x: a + x["w"]) >= m["lightest"] * (least - 1e-9))
    windows = hits.select("doc_id", "text_hash", "width", "size", F.explode(heavy).alias("m")).select("doc_id", "text_hash", "width", "size", "m.i", "m.n", "m.window")
    start = F.least(F.col("i"), F.greatest(F.col("size") - (F.col("n") - F.col("width") + 1), F.lit(0)))
    wkey = F.md5(F.concat_ws(",", F.col("width").cast("string"), F.col("n").cast("string"), F.transform("window", lambda x: x["h"].cast("string"))))
    members = scratch.write(windows.select("doc_id", "text_hash", "width", "n", start.alias("start"), "window", wkey.alias("wkey")), "windows")
    distinct = members.groupBy("wkey").agg(*[F.first(c).alias(c) for c in ("width", "n", "window")]).withColumn("fp", _simhash("window"))
    distinct = scratch.write(distinct, "distinct")
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _byte(i).alias("value")) for i in range(BLOCKS)])).alias("x")
    near = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda v: F.bit_count(v.bitwiseXOR(F.col("x.value"))) <= radius // BLOCKS)
    listed = items.select("item", "width", "n", "fp", blocks).select("item", "width", "n", F.col("fp").alias("item_fp"), "x.block", F.explode(near).alias("value"))
    listed = scratch.write(listed, "listed")  # so that Spark knows its size, some 300 rows an item
    probed = distinct.select("wkey", "width", "n", "fp", blocks).select("wkey", "width", "n", "fp", "x.block", "x.value")
    close = probed.join(listed, ["width", "n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("wkey", "item").distinct()
    both = close.join(distinct.select("wkey", "window").hint("merge"), "wkey").join(items.select("item", "item_id", "weights", "whole"), "item")
    shared = F.expr("aggregate(array_intersect(window, weights), 0D, (a, x) -> a + x.w)")
    matched = both.select("wkey", "item_id", (shared / F.col("whole")).alias("similarity")).where(F.col("similarity") >= least - 1e-9)
    matched = scratch.write(matched.groupBy("wkey", "item_id").agg(F.max("similarity").alias("similarity")), "matched")
    # tables of windows grow with the corpus: they are not broadcast, however small their files
    hit = members.select("wkey", "doc_id", "text_hash", "start").hint("merge").join(matched.hint("merge"), "wkey")
    best = hit.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).alias("start_word"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad = Scratch(docs.sparkSession, "leaking").write(bad, "leaking")  # of known size: few are broadcast, many are joined by shuffle
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__hash"]), "left_anti")
