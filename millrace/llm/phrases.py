"""Phrases that stay together: counts of all short phrases from word-id suffix arrays, scored by how seldom their parts stand apart.

Each task builds suffix arrays over shards of its texts: words become ids, prefix doubling ranks the stretches of 1, 2 and 4 words, and
the intervals of the suffix order in which suffixes share their first m words give the counts of all phrases of m words. Counts of
shards are merged by phrase over all shards. A first pass merges hashes of words and of pairs, a second those of three words
whose pairs are frequent, and what is frequent leaves a table of bits of fixed size; the last merges phrases that can be frequent after
it. The table spares rows and decides nothing: chance hits add phrases whose true counts then drop them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, hashes, mix, slices, stored, utf8

#: Bytes of text in a shard. A larger one has fewer phrases that other shards count again, and takes more memory (about 40 bytes a byte).
SHARD = 3 << 20
#: Bits of the table of what is frequent (16 MB). With more frequent words and pairs than an eighth of it, it spares less.
BITS = 1 << 27
#: Bits of the hashes that are merged: fewer bytes to exchange than all 64.
HASH = np.uint64((1 << 40) - 1)
LONGEST = 4
#: Groups of phrases that are ranked on their own first, so that few meet where a language's are ranked.
GROUPS = 32


def bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


CUT = bytes_in(b".,;:!?\n\x0b\x0c\r")
BETWEEN = CUT | bytes_in(b" \t")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Shard:
    """The words of a shard in suffix order.

    ids: of each word, one for each word and language; left: words from each on to the end of its piece, at most LONGEST; order: word places in
    the order of the up to depth words (2 or LONGEST) that begin there; shared: how many of these are those of the place before in the order.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array, depth: int = LONGEST):
        data, offsets = utf8(texts)
        data = LOWER[data]
        words = Words(data, offsets, BETWEEN)
        codes, self.distinct = words.coded()
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        lang = coded.indices.to_numpy(zero_copy_only=False)[words.doc].astype(np.int64)
        n = len(words)
        both, self.ids = np.unique(lang * max(len(self.distinct), 1) + codes, return_inverse=True)
        self.lang_of, self.word_of = (x.astype(np.int32) for x in np.divmod(both, max(len(self.distinct), 1)))
        cuts = np.cumsum(CUT[data], dtype=np.int32) if len(data) else np.zeros(1, np.int32)
        begins = np.ones(n + 1, dtype=bool)
        begins[1:n] = (cuts[words.starts[1:]] != cuts[words.starts[:-1]]) | (words.doc[1:] != words.doc[:-1])
        ends = np.flatnonzero(begins)
        self.left = np.minimum(np.repeat(ends[1:], np.diff(ends)) - np.arange(n), LONGEST)
        ranks = self.doubled(self.ids, 1)
        self.order = np.argsort(ranks if depth == 2 else self.doubled(ranks, 2), kind="stable")
        self.shared = np.zeros(n, dtype=np.int8)
        a, b = self.order[:-1], self.order[1:]
        for m in range(1, depth + 1):
            same = (self.shared[1:] == m - 1) & (self.left[a] >= m) & (self.left[b] >= m)
            same[same] = self.ids[a[same] + m - 1] == self.ids[b[same] + m - 1]
            self.shared[1:][same] = m

    def doubled(self, rank: np.ndarray, step: int) -> np.ndarray:
        """Ranks of twice as many words: by rank, then the rank step words on, nothing before anything."""
        second = np.zeros(len(rank), dtype=np.int64)
        on = np.flatnonzero(self.left > step)
        second[on] = rank[on + step] + 1
        return np.unique(rank.astype(np.int64) * (len(rank) + 1) + second, return_inverse=True)[1]

    def intervals(self, m: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A place of each phrase of m words, and how often the phrase occurs. among: of these word places only, all places of a phrase or none."""
        held = self.left[self.order] >= m
        if among is not None:
            held &= among[self.order]
        # places that are too short part no interval: suffixes between two that share m words share them, too
        first = np.flatnonzero(held & (self.shared < m))
        total = np.concatenate([[0], np.cumsum(held)])
        return self.order[first], total[np.append(first[1:], len(held))] - total[first]

    def hashed(self) -> list[np.ndarray]:
        """Hashes of the one, two and three words at each place, with their language; where a piece has fewer words, they mean nothing."""
        langs = hashes(self.langs.cast(pa.binary()), 1)
        own = mix(hashes(self.distinct)[self.word_of] + langs[self.lang_of] if len(self.word_of) else np.zeros(0, np.uint64))[self.ids]
        pairs = mix(own * np.uint64(0x9E3779B97F4A7C15) + np.append(own[1:], own[:1]))
        return [own & HASH, pairs & HASH, mix(pairs * np.uint64(0xC2B2AE3D27D4EB4F) + np.append(own[2:], own[:2])) & HASH]

    def phrases(self, places: np.ndarray, m: int) -> pa.Array:
        parts = [self.distinct.take(pa.array(self.word_of[self.ids[places + j]])) for j in range(m)]
        return pc.binary_join_element_wise(*parts, b" ").cast(pa.string()) if m > 1 else parts[0].cast(pa.string())


def shards(batches: Iterator[pa.RecordBatch], limit: int, depth: int) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> Shard:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return Shard(whole.column(0), whole.column(1), depth)

    for batch in batches:
        for part in slices(batch, "text", max(1, limit // 8)):
            own = int(utf8(part.column(1))[1][-1])
            if held and size + own > limit:
                yield made()
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield made()


def often(table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = (own & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def next_place(flags: np.ndarray) -> np.ndarray:
    return np.append(flags[1:], np.zeros(min(1, len(flags)), dtype=bool))


def frequent_bits(docs: DataFrame, least: int, shard: int, bits: int, known: Broadcast | None = None) -> np.ndarray:
    """A table of bits, in bytes: set at the hashes of all words and pairs of words that docs hold at least least times, or, after the table known, of all three words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches, shard, LONGEST if known else 2):
            own = s.hashed()
            if known:
                words, pairs = often(known.value, own[0]), often(known.value, own[1])
                # three words can be frequent only if both of their pairs are
                found = [(own[2], s.intervals(3, words & pairs & next_place(pairs)))]
            else:
                found = [(own[m - 1], s.intervals(m)) for m in (1, 2)]
            for values, (places, n) in found:
                yield pa.RecordBatch.from_arrays([pa.array(values[places].view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    frequent = docs.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = frequent.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, dtype="<i8")
    out[rows.column("at").to_numpy()] = rows.column("set").to_numpy()
    return out.view(np.uint8)


def counted(docs: DataFrame, least: int, shard: int, bits: int) -> DataFrame:
    """lang, m, phrase, n: exact counts of all phrases of 1 to LONGEST words that occur at least least times; with m = 0, all words of each language."""
    context = docs.sparkSession.sparkContext
    short = context.broadcast(frequent_bits(docs, least, shard, bits))
    table = context.broadcast(short.value | frequent_bits(docs, least, shard, bits, short))
    short.unpersist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches, shard, LONGEST):
            words, pairs, threes = (often(table.value, own) for own in s.hashed())
            pairs &= words
            threes &= pairs & next_place(pairs)
            langs = s.lang_of[s.ids]
            total = np.bincount(langs, minlength=len(s.langs))
            yield pa.RecordBatch.from_arrays([s.langs, pa.array(np.zeros(len(total)), pa.int32()), pa.array([""] * len(total)), pa.array(total.astype(np.int64))], names=["lang", "m", "phrase", "n"])
            for m, within in enumerate((words, pairs, threes, threes & next_place(threes)), 1):
                places, n = s.intervals(m, within)
                for a in range(0, len(places), 1 << 16):
                    own = places[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(langs[own])), pa.array(np.full(len(own), m), pa.int32()), s.phrases(own, m), pa.array(n[a : a + (1 << 16)].astype(np.int64))], names=["lang", "m", "phrase", "n"])

    return docs.mapInArrow(count, "lang string, m int, phrase string, n long").groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("m") == 0))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, share: int = 80, shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the top phrases of 2 to 4 words of each language.

    Texts are lower-cased (A-Z), cut at . , ; : ! ? and line ends, and split at spaces and tabs. n is the number of words of the
    language, a how often the phrase occurs (least at least), l and r how often the two parts of its loosest cut do, score is floor(2000000 a / (l + r));
    the loosest cut has the lowest score, of equal ones the shortest first part. Phrases inside a longer one with share per cent of
    their count go. A null language is und; null and empty texts, and those without words, count nothing; rows that repeat count as often as
    they occur; other columns don't matter. An empty table gives no rows. Ties in score: more frequent phrases, then smaller ones in the order of their bytes.
    """
    if bits < 64 or bits & (bits - 1):
        raise ValueError("bits is a power of two, 64 at least")
    docs = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    counts = stored(counted(docs, least, shard, bits), "phrases")
    words = F.split("phrase", " ")
    longer = counts.where("m >= 2").select("lang", "m", "phrase", F.col("n").alias("a"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = longer.withColumn("words", words).select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("cut"), "words", "m")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("m") - F.col("cut")).alias("rest"))
    known = counts.where("m > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    loosest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inside = longer.where("m > 2").withColumn("words", words).select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
    inside = inside.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("start"))
    inside = inside.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = loosest.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.expr(f"cast(most as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(share)}"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    few = kept.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.drop("rank", "group").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = F.broadcast(counts.where("m = 0").select("lang", F.col("n").alias("words")))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
