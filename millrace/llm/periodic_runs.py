"""Periodic runs of words: Main–Lorentz divide and conquer on interned word ids.

A run is a stretch of words with a smallest period q and at least max(least, 2q) words that no neighbouring word extends keeping that
period. Texts are halved again and again; at each middle the repetitions that cross it are found from how far the words agree
forwards and backwards with those a period away, right and left of it. Of these values only those are worked out that can belong to a
run: the three words behind or before the middle must agree, as two extensions that come to six words together have three on one
side. All middles of a level, of all texts of a batch, are worked on at once. Extensions come from ranks of all stretches of 1, 2, 4, ...
words, so they are exact and reach over the whole text; equal intervals then keep their smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, complete, hashes, slices, utf8, windows

#: Words that a run has at least; at least 12, as the six words that must agree follow from it.
LEAST = 12
#: Words that two stretches of a run a period apart share at least.
SHARED = 6

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class Texts:
    """Word ids of several texts, one after the other, with marks that equal nothing between them and at both ends.

    first, stop: bounds of each text. ranks[j]: equal numbers for equal stretches of 2**j words.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        n = len(counts)
        self.first = np.cumsum(counts) - counts + 3 + np.arange(n)
        self.stop = self.first + counts
        size = int(counts.sum()) + n + 6
        x = np.arange(size) + (int(ids.max()) + 1 if len(ids) else 0)
        x[np.repeat(self.first - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        self.ranks = [np.unique(x, return_inverse=True)[1].astype(np.int32)]
        longest = int(counts.max()) if n else 0
        while 2 << len(self.ranks) - 1 <= longest:
            rank, repeats = self.pairs(self.ranks[-1], 1 << len(self.ranks) - 1)
            if not repeats:
                break
            self.ranks.append(rank)
        self.threes = self.pairs(self.ranks[0], 1, self.pairs(self.ranks[0], 1)[0])[0]

    @staticmethod
    def pairs(rank: np.ndarray, step: int, second: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
        """Ranks of what begins at each place and what begins step places on; whether any occur twice. Beyond the end, each place is its own."""
        second = rank if second is None else second
        wide = np.arange(len(rank), dtype=np.int64) + len(rank)
        wide[: len(rank) - step] = second[step:]
        distinct, found = np.unique(rank.astype(np.int64) * (2 * len(rank)) + wide, return_inverse=True)
        return found.astype(np.int32), len(distinct) < len(rank)

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.ranks) - 1, -1, -1):
            rank, top = self.ranks[j], j == len(self.ranks) - 1
            on = np.ones(len(a), dtype=bool)
            while on.any():
                on = np.maximum(a, b) < len(rank)
                on[on] = rank[a[on]] == rank[b[on]]
                a[on] += 1 << j
                b[on] += 1 << j
                if not top:
                    break
        return a - start

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.ranks) - 1, -1, -1):
            rank, top = self.ranks[j], j == len(self.ranks) - 1
            on = np.ones(len(a), dtype=bool)
            while on.any():
                on = np.minimum(a, b) >= 1 << j
                on[on] = rank[a[on] - (1 << j)] == rank[b[on] - (1 << j)]
                a[on] -= 1 << j
                b[on] -= 1 << j
                if not top:
                    break
        return start - a

    def crossing(self, low: np.ndarray, middle: np.ndarray, high: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
        """Runs found at the middles: rows of text, start, end, period."""
        out = []
        for span, right in ((high - middle, True), (middle - low, False)):
            at = np.repeat(np.arange(len(span)), span)
            period = np.arange(len(at)) - np.repeat(np.cumsum(span) - span, span) + 1
            near = middle[at]
            far = near + period if right else near - period
            agree = (self.threes[near] == self.threes[far]) | (self.threes[near - 3] == self.threes[far - 3])
            at, period, a = at[agree], period[agree], np.minimum(near, far)[agree]
            start, stop = a - self.backwards(a, a + period), a + period + self.forwards(a, a + period)
            enough = stop - start >= np.maximum(least, 2 * period)
            out.append(np.stack([text[at], start, stop, period], axis=1)[enough])
        return np.concatenate(out)

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start (within the text), length and smallest period of all runs, by text, start and period."""
        low, high, text = self.first, self.stop, np.arange(len(self.first))
        found = [np.zeros((0, 4), dtype=np.int64)]
        while len(low):
            held = high - low >= least
            low, high, text = low[held], high[held], text[held]
            middle = (low + high) // 2
            found.append(np.unique(self.crossing(low, middle, high, text, least), axis=0))
            low, high, text = np.concatenate([low, middle]), np.concatenate([middle, high]), np.concatenate([text, text])
        all_ = np.unique(np.concatenate(found), axis=0)
        smallest = np.ones(len(all_), dtype=bool)
        smallest[1:] = (all_[1:, :3] != all_[:-1, :3]).any(axis=1)
        text, start, stop, period = all_[smallest].T
        order = np.lexsort((period, start, text))
        text, start, stop, period = text[order], start[order], stop[order], period[order]
        return text, start - self.first[text], stop - start, period


def suspects(ids: np.ndarray, distinct: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Which rows hold a stretch of SHARED words twice; without one there is no run. Hashes that meet by chance only add rows."""
    values = windows(hashes(distinct)[ids] if len(ids) else np.zeros(0, np.uint64), SHARED)
    inside = np.flatnonzero(complete(bounds, len(ids), SHARED))
    row = np.searchsorted(bounds, inside, side="right") - 1
    order = np.lexsort((values[inside], row))
    value, row = values[inside][order], row[order]
    out = np.zeros(len(bounds) - 1, dtype=bool)
    out[row[1:][(value[1:] == value[:-1]) & (row[1:] == row[:-1])]] = True
    return out


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    sizes = words.ends - words.starts
    n = np.bincount(words.doc[keep], minlength=len(words.counts))
    ends = np.concatenate([[0], np.cumsum(np.bincount(words.doc[keep], sizes[keep], len(words.counts)).astype(np.int64) + np.maximum(n - 1, 0))])
    if ends[-1] >= 1 << 31:
        raise ValueError("a text is beyond what a column of strings holds")
    rank = np.cumsum(keep) - 1 - np.repeat(np.cumsum(n > 0) - (n > 0), words.counts)
    chars = words.data[words.inside][np.repeat(keep, sizes)]
    out = np.full(ends[-1], 0x20, dtype=np.uint8)
    # spaces before a word: one for each kept word before it, less the one that each earlier row saves
    out[np.arange(len(chars)) + np.repeat(rank[keep], sizes[keep])] = chars
    return pa.Array.from_buffers(pa.string(), len(words.counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def solve(column: pa.Array, least: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each row."""
    words = Words(*utf8(column))
    ids, distinct = words.coded()
    some = suspects(ids, distinct, words.bounds)
    row, start, length, period = Texts(ids[some[words.doc]], words.counts[some]).runs(least)
    row = np.flatnonzero(some)[row]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, words.bounds[row] + start + period, 1)
    np.add.at(change, words.bounds[row] + start + length, -1)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))]).astype(np.int32)
    fields = [pa.field(f.name, pa.int64(), False) for f in RUN]
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=fields))
    return words.counts, runs, joined(words, np.cumsum(change[:-1]) == 0)


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """The columns of docs named in keep (doc_id by default), then n_words, runs (start, length, period, in words; by start, then
    period) and collapsed: the text without the words that repeat, i. e. those of any run behind its first period, joined by one space.

    One row per row of docs. Null and empty texts, and those without words, have 0 words, no runs and an empty collapsed text. Rows
    that repeat are worked on alike, each on its own; ids and other columns, whatever their names, don't matter; names in keep
    that clash with a result are refused by Spark when selected. Of equal intervals the smallest period counts. A long text is worked on as a
    whole, in memory that grows with its own words (times the logarithm of its longest repetition).
    """
    if least < 2 * SHARED:
        raise ValueError(f"a run has at least {2 * SHARED} words")
    keep = ["doc_id"] if keep is None else keep
    docs = docs.select(F.struct(*keep).alias("__doc"), docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                counts, runs, collapsed = solve(part.column(1), least)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), runs, collapsed], names=["__doc", "n_words", "runs", "collapsed"])

    kinds = [docs.schema["__doc"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    return docs.mapInArrow(run, T.StructType(kinds)).select("__doc.*", "n_words", "runs", "collapsed")


def with_periods(text: Column, doc_id: Column) -> Column:
    """The text of the query: where crc32 of the decimal id ends in 0, its words from some place on repeat the first p of them. A null id changes nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    facts = F.struct(words.alias("w"), g.alias("g"))

    def repeated(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        a = x["g"] % n
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        return F.array_join(F.transform(x["w"], lambda word, i: F.when(i < a, word).otherwise(F.get(x["w"], (a + (i - a) % p).cast("int")))), " ")

    changed = F.get(F.transform(F.array(facts), lambda x: F.when(F.size(x["w"]) > 0, repeated(x)).otherwise("")), 0)
    return F.when(h % 10 == 0, changed).otherwise(text)


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    out = periodic_runs(docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("down"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = out.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    length, period = F.col("best.length"), -F.col("best.down")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) div (- best.down)").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
