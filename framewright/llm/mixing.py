"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets are words per source (water filling below a cap of passes over a source). Each
source's documents stand in an order permuted by hash; its mix is a prefix of that order,
repeated for every full pass, cut into blocks of equal words. A tree splits the exact block
quotas of all sources among the output shards: a node's blocks, ranked by a hash, go half
to either child, which draws a multivariate-hypergeometric sample. Shards so hold disjoint
blocks of every source, and their rows are shuffled within the shard. Only DataFrame
expressions are used; no data row passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import named, saved, unused

#: Weights of the sources in code point order, repeating; fixed values of the mix.
WEIGHTS = (5, 2, 1)
#: Times that a source may be passed over.
MAX_PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one bucket of the permuted order holds on average.
BUCKET_ROWS = 20_000
#: Sources whose targets are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """sizes (source, source_size) -> with `target`: shares of all words by weight, none above passes * size.

    The shares above the cap go to the others by weight until none is above: with the sources in order of
    cap / weight, those before the first whose fair share fits are capped. The windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    caps = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * passes)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = (
        caps.withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("fits", (F.col("all_words") - F.col("capped")) * F.col("w") <= F.col("cap") * F.col("w_left"))
    )
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("capped"), F.col("w_left")))).over(whole)
    at = F.max("fits").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = (F.col("all_words") - F.col("first.capped")).cast("double") * F.col("w") / F.col("first.w_left")
    target = F.when(at, share).otherwise(F.col("cap").cast("double"))
    return rest.withColumn("first", first).withColumn("target", target).select("source", "source_size", "target")


def plan(docs: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document (doc_id, source, key columns): size, source_size, target, taken, and its place in the order.

    docs: doc_id, text, source; other columns are ignored. Null or wordless text: size 0, taken 0. A null source is a
    source of its own, last in order. Rows of equal (doc_id, source, size) stand one behind
    the other, numbered from 1 by `nth`. An empty table gives no rows.
    The order is that of md5(doc_id), then doc_id; running words come from bucket sums, then within a bucket, so no
    task holds a source.
    """
    rows = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    n = rows.count()
    digits = max(1, min(8, len(f"{max(1, n // bucket_rows):x}")))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("order", digest).withColumn("bucket", F.substring("order", 1, digits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = saved(buckets, "buckets")
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, passes).withColumnRenamed("source", "t_source")
    if sizes.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    ahead = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    starts = buckets.select("source", "bucket", ahead.alias("ahead")).join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy("source", "bucket", "order", "doc_id", "size").orderBy("upto")
    rows = rows.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.row_number().over(equal))
    s = starts.alias("s")
    joined = rows.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    place = F.col("s.ahead") + F.col("r.upto") - F.col("r.size")
    turns = F.when(F.col("s.source_size") > 0, F.least(F.floor(F.col("s.target") / F.col("s.source_size")), F.lit(passes))).otherwise(0).cast("long")
    part = F.col("s.target") - turns * F.col("s.source_size")
    more = F.when((turns < passes) & (F.col("r.size") > 0) & (place + F.col("r.size") / 2 <= part), 1).otherwise(0)
    times = F.when(F.col("r.size") > 0, turns + more).otherwise(0).cast("long")
    return joined.select(
        "r.doc_id", "r.source", "r.size", "s.source_size", "s.target", (times * F.col("r.size")).alias("taken"), times.alias("times"), place.alias("place"), F.col("r.order").alias("order"), F.col("r.nth").alias("nth")
    )


def _quota(blocks: int) -> Column:
    return F.ceil(F.when(F.col("all_target") > 0, F.col("target") * blocks / F.col("all_target")).otherwise(0)).cast("int")


def _order(seed: int, level: int) -> Column:
    """A hash of a block for the draws of a level of the tree; one that other engines have as well."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{level}"), F.coalesce("source", F.lit("")), F.col("block").cast("string")).cast("binary"))


def splitting_tree(targets: DataFrame, shards: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """(source, block) -> shard: the blocks of every source's mix, split among shards by a tree of exact draws.

    targets: (source, target). Blocks are equal parts of the whole mix, shards * blocks_per_shard of them and one
    more per source at most, so the table is bounded by the parameters and the number of sources, not by the data.
    """
    total = targets.agg(F.sum("target").alias("all_target"))
    quota = targets.crossJoin(F.broadcast(total)).select(  # one row against one row per source
        "source", _quota(shards * blocks_per_shard).alias("quota")
    )
    blocks = quota.where("quota > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("block"))
    blocks = blocks.withColumn("low", F.lit(0)).withColumn("high", F.lit(shards))
    for level in range(max(0, (shards - 1).bit_length())):
        node = Window.partitionBy("low", "high")
        rank = F.row_number().over(node.orderBy(_order(seed, level), "source", "block"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        left = rank * (F.col("high") - F.col("low")) <= F.count("*").over(node) * (middle - F.col("low"))
        split = F.col("high") - F.col("low") > 1
        blocks = blocks.select("source", "block", "low", "high", middle.alias("middle"), left.alias("left"), split.alias("split")).select(
            "source", "block", F.when(F.col("split") & ~F.col("left"), F.col("middle")).otherwise(F.col("low")).alias("low"), F.when(F.col("split") & F.col("left"), F.col("middle")).otherwise(F.col("high")).alias("high")
        )
    return blocks.select("source", "block", F.col("low").alias("shard"))


def draw(planned: DataFrame, shards: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """A row for each copy that plan takes: doc_id, source, size, nth, pass, block, and by the splitting tree shard and shard_order.

    planned: the rows of plan, saved. A copy's block is where its place falls in its source's mix; the tree holds every such
    block, so each copy has one shard.
    """
    blocks = shards * blocks_per_shard
    taken = planned.where("times > 0")
    targets = taken.groupBy("source").agg(F.first("target").alias("target"))
    tree = saved(splitting_tree(targets, shards, blocks_per_shard, seed), "tree")
    total = targets.agg(F.sum("target").alias("all_target"))
    copies = taken.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).crossJoin(F.broadcast(total))  # one row
    at = F.col("place") + (F.col("pass") - 1) * F.col("source_size")
    copies = copies.withColumn("block", F.least(F.floor(at * blocks / F.col("all_target")).cast("int"), _quota(blocks) - 1))
    lookup = tree.select(F.col("source").alias("t_source"), F.col("block").alias("t_block"), "shard")
    if tree.count() <= BROADCAST_SOURCES + blocks:
        lookup = F.broadcast(lookup)
    hit = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block"))
    order = F.xxhash64(F.lit(seed), "order", "pass", "nth").alias("shard_order")
    return copies.join(lookup, hit).select("doc_id", "source", "size", "nth", "pass", "block", "shard", order)


def digest(docs: DataFrame, shards: int = 16, blocks_per_shard: int = 64, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, the words of its drawn copies, and shards, where the
    tree put them: a shard for each pass, in order."""
    planned = saved(plan(docs), "planned")
    copies = saved(draw(planned, shards, blocks_per_shard, seed), "copies")
    keys = ["doc_id", "source", "size", "nth"]
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"].cast("string")), ",")  # as many as passes
    drawn = copies.groupBy(*keys).agg(F.count("*").alias("n"), listed.alias("shards")).select(*(F.col(c).alias(f"k_{c}") for c in keys), "n", "shards")
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return planned.join(drawn, same, "left").select("doc_id", "size", "source_size", "target", (F.coalesce("n", F.lit(0)) * F.col("size")).alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def mix(docs: DataFrame, shards: int = 16, blocks_per_shard: int = 64, weights=WEIGHTS, passes: int = MAX_PASSES, seed: int = 7) -> DataFrame:
    """The mixed rows: docs' own columns, one row per taken copy, with `shard` and `shard_order`; sort by both to read.

    Rows of equal (doc_id, source, size) are taken one by one, in the order of their texts. Columns of docs named shard or
    shard_order, in any case, are replaced.
    """
    docs = docs.drop("shard", "shard_order")
    planned = saved(plan(docs, weights, passes), "planned")
    keys = ["doc_id", "source", "size", "nth"]
    *theirs, words, row = unused(docs, *(f"k_{c}" for c in keys), "words", "row")
    placed = draw(planned, shards, blocks_per_shard, seed).select(*(F.col(c).alias(k) for c, k in zip(keys, theirs)), "shard", "shard_order")
    k_doc, k_source, k_size, k_nth = map(F.col, theirs)
    sized = docs.withColumn(words, word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(k_doc) & F.col("source").eqNullSafe(k_source) & (F.col(words) == k_size)
    if not planned.where("nth > 1 and size > 0").isEmpty():  # else texts need no order
        sized = sized.withColumn(row, F.row_number().over(Window.partitionBy("doc_id", "source", words).orderBy("text")))
        same &= F.col(row) == k_nth
    return sized.join(placed, same).select(*named(docs.columns), "shard", "shard_order")
