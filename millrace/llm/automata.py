"""Substring deduplication with suffix automata of reference shards.

Every 13-word window that also starts in a document with a smaller id is removed. The reference is sharded by content: the
passages that share an anchor (see repeats) and still differ form a shard, so that an automaton is as small as what can match
in it; automata of whole documents would grow with the corpus and could be neither broadcast nor held. Within a shard the
passages stream by rising id: an automaton of the smaller ids gives the length of the longest match at every word, and
matches of the threshold's length or more are marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Plan, Units, repeated, spans_of, words

WIDTH, GRAM = 13, 4


class Automaton:
    """A suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def split(self, p: int, q: int, c) -> int:
        """The state for the suffixes of q that p reaches by c, parted from q if q has longer ones as well."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self.split(last, self.next[last][c], c)
                continue
            new, p = self.state(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self.split(p, self.next[p][c], c)
            last = new

    def matches(self, sequence: list) -> list[int]:
        """Length of the longest suffix, at each place of sequence, that occurs in the automaton's sequences."""
        at = size = 0
        out, follow, link, length = [], self.next, self.link, self.length
        for c in sequence:
            while at and c not in follow[at]:
                at = link[at]
                size = length[at]
            nxt = follow[at].get(c)
            if nxt is not None:
                at, size = nxt, size + 1
            out.append(size)
        return out


def solve(pieces: list[tuple[int, int, bytes, int]], width: int) -> list[np.ndarray]:
    """For each piece (anchor, id, words joined by a space, windows), by anchor and id: which windows an earlier id's pieces hold."""
    out, shard, waiting, reference = [], None, [], None
    for anchor, key, text, n in pieces:
        if anchor != shard:
            shard, reference, waiting = anchor, Automaton(), []
        if waiting and waiting[0][0] != key:
            for _, sequence in waiting:
                reference.add(sequence)
            waiting = []
        sequence = text.split(b" ")
        waiting.append((key, sequence))
        out.append(np.array(reference.matches(sequence)[width - 1 : width - 1 + n]) >= width)
    return out


def kept_words(u: Units, removed: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, for each row."""
    stay = ~removed
    size = np.where(stay, u.ends - u.starts + 1, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(ends[-1], 0x20, dtype=np.uint8)
    n = (size - 1)[stay]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(ends[:-1][stay], n) + step] = u.data[np.repeat(u.starts[stay], n) + step]
    raw = out.tobytes()
    return pa.array([raw[a : max(a, b - 1)].decode() for a, b in zip(ends[bounds[:-1]], ends[bounds[1:]], strict=True)], pa.string())


def finish(u: Units, removed: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.diff(bounds), pa.int64()), spans_of(removed, bounds), kept_words(u, removed, bounds)]


def substring_dedup(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The columns of docs in keep, n_words, removed (array<struct<start, stop>>, in words) and kept (the words left, joined by a space).

    Windows are judged on the input. Texts that are null or have fewer than width words lose nothing; kept is empty for null.
    Rows with one id are one document: neither is smaller. A null id counts as larger than all others. Other columns of docs
    have no influence; an empty table gives no rows.
    """
    plan = Plan(words, width, min(GRAM, width), True, solve)
    return repeated(docs, plan, finish, "n_words long, removed array<struct<start:int,stop:int>>, kept string", text, ["doc_id"] if keep is None else keep)
