"""Similarity join of documents by their word shingles with a token-group matrix.

Sets of shingles link when 100 * intersection >= 80 * union. Linked sets share one of their first tokens (a prefix of a fifth
of each set, in one order of all tokens), so only prefixes are exchanged. The order puts tokens that are frequent in the corpus
last: passages that many documents hold leave the prefixes of all sets but those that hold little else. Similar documents
are partitioned into groups: families, sets that meet one leader, cut into blocks. The matrix of tokens and blocks bounds how
much a set can share with a block; blocks that pass are opened: their members' token union bounds the overlap again, and a set
that passes that meets all members at once in the block's own matrix. A set asks a block, not its members, and a block
answers with numbers of links and with as many links as join what is linked, so no group's pairs are spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, among, complete, frequent, hashes, mix, slices, stored, utf8, windows
from .components import components

GRAM = 5
#: Sets in a block of a group at most, about; queries that one task holds against a block.
BLOCK, SALT = 2048, 1024
#: Sizes of the sets in a block differ by this factor at most.
SIZES = 1.1
#: Tokens in a block at most, about: what one task holds of it.
BLOCK_TOKENS = 1 << 20
#: Blocks that may hold a token for it to name candidates by itself; a commoner token counts as shared by all that have it.
COMMON = 64
#: A token is frequent if it makes up this share of all tokens (see common.frequent): hashes of at most 2 ** 24 tokens (128 MB; 1.4 MB
#: measured on the check's larger input, 0.6 MB on the smaller one) are sent to every executor. Any choice gives the same links.
FREQUENT, LEAST = 2.0**-23, 8
#: Rows (48 bytes each) that are sent to every executor to pick texts; beyond it the texts are shuffled to them.
FEW = 300_000
NO_ID = (1 << 63) - 1
SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    return _LOWER[data], offsets


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, one text after the other, and the texts' n+1 bounds."""
    w = Words(*lowered(column))
    codes, distinct = w.coded()
    values = hashes(distinct)[codes]
    keep = np.flatnonzero(complete(w.bounds, len(values), GRAM))
    tokens, rows = windows(values, GRAM)[keep], w.doc[keep]
    short = np.flatnonzero((w.counts > 0) & (w.counts < GRAM))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(GRAM - 1):
            at = np.minimum(w.bounds[short] + j, len(values) - 1)
            whole = np.where(j < w.counts[short], mix(whole + values[at] + np.uint64(j + 1)), whole)
        tokens, rows = np.concatenate([tokens, whole]), np.concatenate([rows, short])
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    if len(tokens):
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])])
        tokens, rows = tokens[new], rows[new]
    return tokens, np.searchsorted(rows, np.arange(len(column) + 1))


def set_id(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else 0


def needed(n):
    """Four fifths, rounded up: what a set of n must share with any set that it links with."""
    return (4 * n + 4) // 5


def tokens_of(part: pa.RecordBatch) -> list[np.ndarray]:
    """Shingle hashes of a slice's texts; a token's repeats within one text stay."""
    w = Words(*lowered(part.column(0)))
    codes, distinct = w.coded()
    values = hashes(distinct)[codes]
    return [windows(values, GRAM)[complete(w.bounds, len(values), GRAM)]]


def ordered(tokens: np.ndarray, bounds: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Each set's tokens as signed numbers in the order of the prefixes: frequent ones last, by hash otherwise."""
    last = among(tokens, often)
    numbers = (tokens >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(63))
    if last.any():
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        numbers = numbers[np.argsort(2 * row + last, kind="stable")]
    return numbers.view(np.int64) ^ np.int64(-(1 << 63))


def described(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """key, set_id (null for no words), n, and prefix: the n - needed(n) + 1 first tokens, for the first of equal sets in a slice."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, "__text", SLICE):
                tokens, bounds = shingles(p.column(1))
                numbers = ordered(tokens, bounds, sent.value)
                n = np.diff(bounds)
                ids = [set_id(tokens[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                seen: set = set()
                prefix = [None if i is None or i in seen or seen.add(i) else numbers[a : a + m - needed(m) + 1] for i, a, m in zip(ids, bounds.tolist(), n.tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], names=["key", "set_id", "n", "prefix"])

    return docs.select("key", "__text").mapInArrow(run, "key long, set_id long, n int, prefix array<long>")


def with_set_id(docs: DataFrame) -> DataFrame:
    """docs (with __text) and the set_id of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, "__text", SLICE):
                tokens, bounds = shingles(p.column(p.schema.get_field_index("__text")))
                ids = [set_id(tokens[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(ids, pa.int64())], names=[*p.schema.names, "set_id"])

    return docs.mapInArrow(run, docs.withColumn("set_id", F.lit(None).cast("long")).schema)


def share(n: Column, m: Column) -> Column:
    """What sets of n and m must share to link: 4 (n + m) / 9, rounded up."""
    return F.floor((4 * (n + m) + 8) / 9)


def four_fifths(n: Column) -> Column:
    return F.floor((4 * n + 4) / 5)


def least_prefix(n: Column, m: Column) -> Column:
    """Prefix tokens that linked sets of n and m share at least."""
    return share(n, m) - F.greatest(four_fifths(n), four_fifths(m)) + 1


def within(n: Column) -> tuple[Column, Column, Column]:
    """Of sizes from least to most the first and last that a set of n can link with, and the least_prefix of all between.

    Before rounding, least_prefix is least at an end; rounding up twice can put a size between the ends one lower.
    """
    first, last = F.greatest(F.col("least"), four_fifths(n)), F.least(F.col("most"), F.floor(5 * n / 4))
    return first, last, F.least(least_prefix(n, first), least_prefix(n, last)) - F.when(first == last, 0).otherwise(1)


def opened(own: DataFrame, reps: DataFrame, members: DataFrame, asks: DataFrame) -> DataFrame:
    """What the sets of asks find among the members of the same block: rows (a, null, links) and rows (a, b, 0).

    The former add up to the number of documents that set a links with, equal sets aside; the latter are links, as many of a
    block as join what it links. members: block, set_id. asks: block, set_id and home, the block that the set is a member of. Texts
    travel to the block and are cut into shingles there; a block's queries are split over salted copies of the block. The
    block's matrix of members and tokens gives a query's overlap with the token union, and, if that passes, with all members.
    """
    parts = asks.groupBy("block").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    turns = asks.groupBy("set_id").agg(F.collect_set("block").alias("turns"))
    held = members.join(parts, "block").join(turns, "set_id", "left").select("block", "set_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("home"), "turns")
    asked = asks.join(parts, "block").select("block", "set_id", F.pmod(F.xxhash64("set_id"), "parts").cast("int").alias("salt"), "home", F.lit(None).cast("array<long>").alias("turns"))
    sent = stored(held.unionByName(asked).join(reps.select("set_id", "key", "copies"), "set_id"), "sent")
    texts = own.join(F.broadcast(sent) if sent.count() <= FEW else sent, "key").select("block", "salt", "home", "set_id", "copies", "turns", "__text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, block, rows = None, None, Block(0), []
        for batch in batches:
            for p in slices(batch, "__text", SLICE):
                tokens, bounds = shingles(p.column(6))
                for i, (b, salt, home, own_id, copies, turns) in enumerate(zip(*(p.column(c).to_pylist() for c in range(6)), strict=True)):
                    mine = tokens[bounds[i] : bounds[i + 1]]
                    if set_id(mine) != own_id or (b, salt, home, own_id) == last:  # another text with the same id, or the same text
                        continue
                    last = (b, salt, home, own_id)
                    if (b, salt) != at:
                        rows += block.given()
                        at, block = (b, salt), Block(b)
                    if home is None:
                        block.add(own_id, mine, copies, turns)
                    else:
                        rows += block.asked(own_id, mine, copies, home)
                yield told(rows)
                rows = []
        yield told(block.given())

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["a", "b", "links"])

    return texts.repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("home").asc_nulls_first(), "set_id").mapInArrow(compare, "a long, b long, links long")


class Block:
    """Sets of a block, the union of their tokens and the matrix of both."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.ids: list[int] = []
        self.copies: list[int] = []
        self.turns: list[set[int]] = []
        self.sets: list[np.ndarray] = []
        self.union: np.ndarray | None = None
        self.joined: dict[int, int] = {}

    def add(self, own_id: int, tokens: np.ndarray, copies: int, turns: list[int] | None) -> None:
        """Takes in a member, before the first question. turns: the blocks that it asks."""
        self.ids.append(own_id)
        self.copies.append(copies)
        self.turns.append(set(turns or ()))
        self.sets.append(tokens)

    def index(self) -> None:
        """The matrix by token: of each token of the union, the members that hold it."""
        self.own = np.array(self.ids)
        self.times = np.array(self.copies)
        self.given_links = np.zeros(len(self.sets), dtype=np.int64)
        self.sizes = np.array([len(s) for s in self.sets])
        tokens = np.concatenate(self.sets)
        order = np.argsort(tokens, kind="stable")
        self.holders = np.repeat(np.arange(len(self.sets), dtype=np.int32), self.sizes)[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.append(self.first, len(tokens))

    def asked(self, own_id: int, tokens: np.ndarray, copies: int, home: int) -> list[tuple]:
        """Rows for a query from block home: its number of links, and links that join it with what it is not joined with yet.

        Two linked sets may both ask: within one block each then counts for itself; of two blocks the smaller one's set counts for both.
        """
        if not self.sets:
            return []
        if self.union is None:
            self.index()
        place = np.searchsorted(self.union, tokens)
        place = place[self.union[np.minimum(place, len(self.union) - 1)] == tokens]
        if len(place) < needed(len(tokens)):
            return []
        start, n = self.first[place], self.first[place + 1] - self.first[place]
        held = self.holders[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(held, minlength=len(self.sets))
        found = np.flatnonzero((9 * shared >= 4 * (len(tokens) + self.sizes)) & (self.own != own_id))
        if not len(found):
            return []
        silent = found if home < self.number else found[[home not in self.turns[i] for i in found]]
        self.given_links[silent] += copies
        counted = found if home == self.number else silent
        rows: list[tuple] = [(own_id, None, int(self.times[counted].sum()))]
        for other in self.own[found].tolist():
            a, b = self.root(own_id), self.root(other)
            if a != b:
                self.joined[max(a, b)] = min(a, b)
                rows.append((own_id, other, 0))
        return rows

    def given(self) -> list[tuple]:
        """Rows for the links that members have with queries of other blocks."""
        return [] if self.union is None else [(self.ids[i], None, int(self.given_links[i])) for i in np.flatnonzero(self.given_links)]

    def root(self, node: int) -> int:
        while (above := self.joined.get(node, node)) != node:
            node = above
        return node


def candidates(homed: DataFrame, sets: DataFrame) -> DataFrame:
    """block, set_id and home (its own block) of all blocks that may hold a set that links with set_id; of two linked sets one asks at least.

    homed: token, set_id, n, block of prefix tokens that several sets have. sets: set_id, n, prefix.
    """
    matrix = homed.groupBy("token", "block").agg(F.count("*").alias("held"), F.min("n").alias("least"), F.max("n").alias("most"))
    matrix = stored(matrix.withColumn("blocks", F.count("*").over(Window.partitionBy("token"))), "matrix")
    # of two blocks the smaller one's sets ask; sets of one block ask their own
    rare = matrix.where((F.col("blocks") <= COMMON) & ((F.col("blocks") > 1) | (F.col("held") > 1))).select("token", F.col("block").alias("other"), "held", "least", "most")
    n = F.col("n")
    order = (F.col("block") < F.col("other")) | ((F.col("block") == F.col("other")) & (F.col("held") > 1))
    met = homed.join(rare, "token").where(order & (5 * F.col("most") >= 4 * n) & (4 * F.col("least") <= 5 * n))
    met = met.groupBy("set_id", "n", "block", "other").agg(F.count("*").alias("met"))
    # a block's sizes bound what must be met: it is least at the ends of the sizes that can link
    sizes = homed.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("block", "other")
    met = met.join(sizes, "other").withColumn("bound", within(n)[2])
    heavy = stored(homed.join(matrix.where(F.col("blocks") > COMMON).select("token").distinct(), "token"), "heavy")
    heavies = heavy.groupBy("set_id").agg(F.count("*").alias("heavy"), F.collect_list("token").alias("own"))
    theirs = heavy.groupBy(F.col("block").alias("other")).agg(F.collect_set("token").alias("theirs"))
    met = met.join(heavies, "set_id", "left").where(F.col("met") + F.coalesce("heavy", F.lit(0)) >= F.col("bound")).join(theirs, "other", "left")
    asks = met.where(F.col("met") + F.coalesce(F.size(F.array_intersect("own", "theirs")), F.lit(0)) >= F.col("bound")).select("block", "other", "set_id")
    asks = asks.unionByName(only_common(heavy, heavies.select("set_id", "heavy"), sets)).distinct()
    return stored(asks.select(F.col("other").alias("block"), "set_id", F.col("block").alias("home")), "asks")


def stepped(h: Column) -> Column:
    """Classes of counts: each of its own up to 32, then sixteen for each doubling."""
    return F.when(h <= 32, h).otherwise(32 + F.ceil(16 * F.log2(h / 32))).cast("int")


def up_to(step: Column) -> Column:
    """The largest count of a class."""
    return F.when(step <= 32, step.cast("double")).otherwise(32 * F.pow(F.lit(2.0), (step - 32) / 16))


def only_common(heavy: DataFrame, heavies: DataFrame, sets: DataFrame) -> DataFrame:
    """block, other and set_id of sets (of block) that may link with one of other though all prefix tokens they share are common ones.

    Of such sets z and w let z's prefix end first (at cut). Its other prefix tokens are then missing from w, so its h common ones
    must do: share(n_z, n_w) <= needed(n_z) - 1 + h, hence n_w <= 0.8 n_z + 2.25 h; and w's other tokens up to z's cut are missing
    from z: at most 1.25 h of them. So w's prefix passes z's cut within its own common tokens and 1.25 h more (until). Sets meet by
    common token, size class (powers of 1.25) and class of h (see stepped); those of w that pass no cut there are left out first.
    """
    known = sets.where("prefix IS NOT NULL").join(heavies, "set_id").select("set_id", "prefix", "heavy").dropDuplicates(["set_id"])
    each = heavy.join(known, "set_id").withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    z = each.select("token", "set_id", F.col("block").alias("other"), F.col("n").alias("n_z"), F.col("heavy").alias("h"), F.array_max("prefix").alias("cut"), stepped(F.col("heavy")).alias("few"), "class")
    # the sets of a block in one class are one row, with what the loosest of them allows
    z = z.groupBy("token", "other", "class", "few").agg(F.min("n_z").alias("least"), F.max("n_z").alias("most"), F.max("h").alias("h"), F.min("cut").alias("cut"), F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    z = z.withColumn("class", F.explode(F.array(*(F.col("class") + d for d in range(-2, 3)))))
    first = z.groupBy("token", "class", "few").agg(F.min("cut").alias("first"))
    until = F.try_element_at("prefix", (F.col("heavy") + F.floor(1.25 * up_to(F.col("few"))) + 1).cast("int"))
    w = each.join(first, ["token", "class"]).withColumn("until", until).where("until IS NULL OR until > first")
    w = w.select("token", "class", "few", "set_id", "block", F.col("n").alias("n_w"), F.col("heavy").alias("own"), "until")
    n_w = F.col("n_w")
    first, last, bound = within(n_w)
    fits = (share(last, n_w) <= four_fifths(last) + F.col("h")) & (first <= last) & (bound <= F.least("h", "own"))
    met = w.join(z, ["token", "class", "few"]).where((F.col("until").isNull() | (F.col("cut") < F.col("until"))) & ((F.col("set_id") != F.col("low")) | (F.col("set_id") != F.col("high"))) & fits)
    # a block may hold several classes of sizes and counts; all of them together must be met as often as the loosest asks
    met = met.groupBy("set_id", "block", "other").agg(F.countDistinct("token").alias("met"), F.min(bound).alias("bound")).where("met >= bound")
    return met.select("block", "other", "set_id")


def linked(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (doc_id, NO_ID for null), set_id, n, component_id, chosen and n_links for each row of docs: see similarity_classes().

    chosen: the least set_id that component_id has in the component, null for no words.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col(text).alias("__text"))
    sets = stored(described(own, frequent(own.select("__text"), tokens_of, 1, FREQUENT, LEAST, SLICE)[0]), "sets")
    some = sets.where("set_id IS NOT NULL")
    reps = stored(some.groupBy("set_id").agg(F.min("key").alias("key"), F.count("*").alias("copies")), "reps")
    shared = stored(several(some.where("prefix IS NOT NULL").select(F.explode("prefix").alias("token"), "set_id", "n")), "shared")
    # a set's family is that of the leader that it meets most, where that is often enough; links that this leaves out are found below
    star = shared.where("set_id <> leader").groupBy("leader", "set_id", "n").agg(F.count("*").alias("met")).where(10 * F.col("met") >= F.col("n") - four_fifths(F.col("n")) + 1)
    star = stored(star.groupBy("set_id").agg(F.max_by("leader", F.struct("met", "leader")).alias("family"), F.max("n").alias("n")), "star")
    leaders = star.select(F.col("family").alias("set_id")).distinct()
    families = star.select("set_id", "family").join(leaders, "set_id", "left_anti").unionByName(leaders.select("set_id", F.col("set_id").alias("family")))
    sized = families.join(star.select("set_id", "n"), "set_id", "left")
    size = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS), F.lit(1)).alias("parts"))
    home = families.join(size, "family")
    # sets of a block are of about one size, so that what must be met of it is known well
    step = F.floor(F.log("n") / F.log(F.lit(SIZES)))
    block = F.when(F.col("family").isNotNull(), F.xxhash64("family", step, F.pmod(F.xxhash64("set_id"), F.col("parts")))).otherwise(F.xxhash64("set_id"))
    homed = shared.join(home, "set_id", "left").select("token", "set_id", "n", block.alias("block"))
    homed = stored(homed, "homed")
    asks = candidates(homed, sets)
    members = asks.select("block").distinct().join(homed.select("block", "set_id").distinct(), "block")
    found = stored(opened(own, reps, members, asks), "found")
    links = found.groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    classes = reps.join(components(found.where("b IS NOT NULL")).withColumnRenamed("node", "set_id"), "set_id", "left").join(links, "set_id", "left")
    classes = classes.select("set_id", "key", F.coalesce("label", "set_id").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = classes.groupBy("label").agg(F.min(F.struct("key", "set_id")).alias("least")).join(classes.select("label", "set_id", "n_links"), "label")
    ids = ids.select("set_id", F.col("least.key").alias("component_id"), F.col("least.set_id").alias("chosen"), "n_links")
    out = sets.select("key", "set_id", "n").join(ids, "set_id", "left")
    return out.select("key", "set_id", "n", F.coalesce("component_id", "key").alias("component_id"), "chosen", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def several(tokens: DataFrame) -> DataFrame:
    """token, set_id, n and leader (the least set_id of the token) of tokens that several sets have in their prefixes, once each.

    Frequent tokens, which any share of all sets may have, are counted before their rows meet; no other token has more
    than a bounded share of the rows.
    """
    by_token = Window.partitionBy("token")
    rare = tokens.where("token < 0").repartition("token")
    rare = rare.withColumn("leader", F.min("set_id").over(by_token)).withColumn("last", F.max("set_id").over(by_token)).where("leader <> last").drop("last").distinct()
    often = tokens.where("token >= 0")
    ends = often.groupBy("token").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last")).where("leader <> last").drop("last")
    return rare.unionByName(often.distinct().join(ends, "token"))


def similarity_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and n_links (rows linked with) for each row of docs.

    Null texts and texts without words have no shingles and link with nothing; texts of fewer than five words have one. Rows
    with equal shingles link, whatever their ids. A null doc_id comes after all others: it is the component_id only where
    all ids are null. Other columns of docs have no influence; an empty table gives no rows.
    """
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked(docs, text).select(known("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), known("component_id").alias("component_id"), "n_links")
