"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, document after document, are packed into blocks of BLOCK words. Output shards hold SHARD_BLOCKS slots
each. Each shard draws its sources' counts: a multinomial draw given that all shards together keep the sources' totals, made
by one pseudorandom permutation of all slots that is cut into shards. A slot's number within its source is mapped by another
permutation, of the source's blocks, a new one for each pass over the source, and slots are joined with blocks by that index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 512
#: Slots of an output shard: 16384 words, a training batch rather than a file; a file takes any number of shards.
SHARD_BLOCKS = 32
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"
#: Documents whose place in their source is summed up by one task at a time.
BUCKET_DOCS = 1000
#: Steps after which a walk out of the permuted range has ended, but for a chance of about n ** (-WALK / 2).
WALK = 64
_ROUNDS = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0..n-1 by key: additive rounds on the two digits of x in a grid just above n, walked until below n."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.when(k % 2 == 0, F.struct(((left + F.pmod(F.xxhash64(right, k, *key), a)) % a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), ((right + F.pmod(F.xxhash64(left, k, *key), b)) % b).alias("r")))

    def once(y: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), F.struct((y % a).cast("long").alias("l"), F.floor(y / a).cast("long").alias("r")), step, lambda s: s["l"] + a * s["r"])

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x.cast("long"), lambda y, i: F.when((i == 1) | (y >= n), once(y)).otherwise(y)))


def targets(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source of sized (source, size): its place by code point (null last), docs, source_size, weight and target.

    passes over all its blocks and a rest in words make the target, rounded; they take slots, before which all sources before it
    have base slots, and all sources together all_slots.

    Weights repeat by place. A target is the source's share by weight of all words, at most CAP times the source's own; what is
    cut is shared out again by weight. That ends at the level where all uncut targets are level * weight: sources are cut in
    order of cap / weight, so the level is found from sums over that order.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # one row per source from here on
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int")))
    before = Window.orderBy(CAP * F.col("source_size") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    cut, gone = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in (CAP * F.col("source_size"), F.col("weight")))
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (F.col("total") - cut) / (F.sum("weight").over(everything) - gone))
    # the level rises while sources are cut and falls afterwards
    level = F.max("level").over(everything)
    per = per.withColumn("level", level).withColumn("target", F.least((CAP * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    per = per.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", wanted - F.col("passes") * F.col("source_size"))
    per = per.withColumn("slots", F.col("passes") * F.ceil(F.col("source_size") / block) + F.ceil(F.col("rest") / block))
    return per.withColumn("base", F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all_slots", F.sum("slots").over(everything))


def row_key(docs: DataFrame) -> Column:
    """128 bits of hashes of all columns of a row and of which are null: equal rows only have the same."""
    parts = [*docs.columns, *(F.isnull(c) for c in docs.columns)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(SEED), *parts).alias("b"))


def placed(docs: DataFrame, text: str = "text", source: str = "source", row: Column | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, size, offset (words of the source before it) and the source's figures for each row of docs, written to the shared folder.

    The order in a source is by a bucket of the id, then the id, then the size, then row (see row_key) where it is given; rows
    without an id then have buckets by row. Offsets are summed by bucket first, so that no task holds a source. Rows alike in
    all of these are interchangeable.
    """
    key = [] if row is None else ["row"]
    sized = stored(docs.select("doc_id", docs[source].cast("string").alias("source"), word_count(docs[text]).alias("size"), *(row.alias(c) for c in key)), "sizes")
    buckets = max(1, sized.count() // BUCKET_DOCS)
    named = F.xxhash64("doc_id") if row is None else F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))
    sized = sized.withColumn("bucket", F.pmod(named, F.lit(buckets)))
    per = targets(sized, block)
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(by_bucket), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "begin")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(sums, out["source"].eqNullSafe(sums["s"]) & (out["bucket"] == sums["b"])).drop("s", "b")
    per = per.withColumnRenamed("source", "s")
    return stored(out.join(per, out["source"].eqNullSafe(per["s"])).select("doc_id", "source", "size", (F.col("begin") + F.col("within")).alias("offset"), "source_no", "source_size", "target", "passes", "rest", "base", "all_slots", *key), "placed")


def mixed(place: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix of documents with their places (see placed), a row for each piece of a document in an output slot.

    shard, place (of the slot among all), source_no, epoch (pass over the source), slot (place in that pass), block, doc_id, offset, first_word and n_words of
    the piece within the document, and row where place has it. A source's pieces hold as many words as its rounded target: whole passes take every block
    once; the last takes blocks in permuted order, the last one cut. The short block at a source's end comes last in a pass.
    """
    b, key = F.lit(block), [c for c in place.columns if c == "row"]
    place = place.where("size > 0").withColumn("full", F.floor(F.col("source_size") / b).cast("long"))
    pieces = place.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / b).cast("long"), F.floor((F.col("offset") + F.col("size") - 1) / b).cast("long"))))
    pieces = pieces.withColumn("first", F.greatest("offset", F.col("block") * b)).withColumn("last", F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * b))
    # each block stands once among the pieces that begin it, and with it the slot of the same number
    slots = pieces.where(F.col("first") == F.col("block") * b).select("source_no", "source_size", "passes", "rest", "full", "base", "all_slots", F.col("block").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("epoch"))
    begun = F.col("slot") * b
    slots = slots.withColumn("cut", F.when(F.col("epoch") < F.col("passes"), b.cast("long")).otherwise(F.least(b.cast("long"), F.col("rest") - begun))).where("cut > 0")
    index = F.when(F.col("slot") < F.col("full"), permuted(F.col("slot"), F.col("full"), F.lit(seed), F.col("source_no"), F.col("epoch"))).otherwise(F.col("full"))
    number = F.col("base") + F.col("epoch") * F.ceil(F.col("source_size") / b) + F.col("slot")
    place_in_mix = permuted(number.cast("long"), F.col("all_slots"), F.lit(seed + 1))
    slots = slots.select("source_no", "epoch", "slot", index.alias("block"), "cut", place_in_mix.alias("place"))
    slots = slots.withColumn("shard", F.floor(F.col("place") / shard_blocks).cast("long"))
    out = slots.join(pieces.select("source_no", "block", "doc_id", "offset", "first", "last", *key), ["source_no", "block"])
    out = out.withColumn("n_words", F.least(F.col("last"), F.col("block") * b + F.col("cut")) - F.col("first")).where("n_words > 0")
    return out.select("shard", "place", "source_no", "epoch", "slot", "block", "doc_id", "offset", (F.col("first") - F.col("offset")).alias("first_word"), "n_words", *key)


def mixing(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and shards (how many output shards hold some) for each row of docs.

    Null texts have size 0; a null source is a source of its own. Repeated rows have places of their own. An empty table gives
    no rows. Columns of docs but doc_id, text and source have no influence.
    """
    place = placed(docs, block=block)
    taken = mixed(place, block).groupBy("source_no", "offset").agg(F.sum("n_words").alias("n"), F.size(F.collect_set("shard")).cast("long").alias("in_shards"))
    taken = taken.select(F.col("source_no").alias("s"), F.col("offset").alias("o"), "n", "in_shards")
    out = place.join(taken, (place["size"] > 0) & (place["source_no"] == taken["s"]) & (place["offset"] == taken["o"]), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0).cast("long")).alias("taken"), F.coalesce("in_shards", F.lit(0).cast("long")).alias("shards"))


def mixed_documents(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The mix as rows like those of docs: one for each pass over the source that takes words of a document.

    A pass that takes all of a document gives its text as it is; one that takes a part gives the part's words joined by a
    space. Documents that the mix leaves out have no row. Rows without an id, or with the id of another row, have takes of their own.
    """
    taken = mixed(placed(docs, text, row=row_key(docs), block=block), block).groupBy("source_no", "offset", "row", "epoch").agg(F.sum("n_words").alias("n"), F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("parts"))
    takes = taken.groupBy("source_no", "offset", "row").agg(F.collect_list(F.struct("epoch", "n", "parts")).alias("takes"))
    place = placed_rows(docs, text, takes)
    words = F.regexp_extract_all(F.col("__text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("take.parts", lambda p: F.slice(F.col("words"), (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
    rows = place.withColumn("take", F.explode("takes")).withColumn("words", F.when(F.col("take.n") < F.col("size"), words))
    return rows.select(*(F.when(F.col("take.n") == F.col("size"), F.col("__text")).otherwise(cut).alias(c) if c == text else F.col("__doc")[c].alias(c) for c in docs.columns))


def placed_rows(docs: DataFrame, text: str, takes: DataFrame) -> DataFrame:
    """__doc, __text, size and takes of the rows of docs that the mix takes words of. Equal rows share out the takes of their places."""
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text).alias("__text"), row_key(docs).alias("__row"), word_count(docs[text]).alias("size"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0))))
    places = takes.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("source_no", "offset", "takes"))).alias("places"))
    own = rows.join(places, rows["__row"] == places["row"]).withColumn("place", F.get("places", F.col("__n") - 1))
    return own.where("place IS NOT NULL").select("__doc", "__text", "size", F.col("place.takes").alias("takes"))
