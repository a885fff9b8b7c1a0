"""Suffix-array deduplication by prefix-free parsing.

Every byte covered by a 400-byte string that also starts elsewhere is removed. Passages that share an anchor and still differ
(see repeats) are parsed: a rolling hash of WINDOW bytes triggers the ends of phrases, which overlap by those bytes. The
suffixes of the dictionary of distinct phrases and the suffixes of the parse are sorted apart; a place's suffix is ordered by its phrase's
suffix, then by the parse from the next phrase on. In that order equal windows are neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Sums
from .common import mix
from .repeats import Plan, Units, octets, repeated, spans_of

WIDTH, GRAM = 400, 160
#: Bytes of the rolling hash, and one of how many hashes triggers.
WINDOW, MODULUS = 8, 64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64)), mix(np.arange(1001, 1257, dtype=np.uint64))


def triggers(text: np.ndarray) -> np.ndarray:
    """Places where the WINDOW bytes before end a phrase."""
    if len(text) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    s = Sums(_BYTE[0][text], 0)
    at = np.arange(len(text) - WINDOW + 1)
    return np.flatnonzero(s(at, at + WINDOW) % np.uint64(MODULUS) == 0) + WINDOW


def doubled(rank: np.ndarray, left: np.ndarray, span: int, most: int) -> np.ndarray:
    """Ranks of suffixes by prefix doubling. rank: by the first span items; left: items to each suffix's end; most: longest suffix."""
    while span < most:
        ahead = np.zeros(len(rank), dtype=np.int64)
        more = np.flatnonzero(left > span)
        ahead[more] = rank[more + span] + 1
        new = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
        if new.max() == rank.max():
            break
        rank, span = new, 2 * span
    return rank


def dictionary_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the phrases, equal for equal suffixes, and where each phrase begins among them."""
    sizes = np.array([len(p) for p in phrases])
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(phrases), dtype=np.uint8)
    left = np.repeat(first + sizes, sizes) - np.arange(len(data))
    # the first step takes seven bytes at once, each above 0, with 0 behind the end
    head = np.zeros(len(data), dtype=np.int64)
    for j in range(7):
        inside = np.flatnonzero(left > j)
        head <<= 9
        head[inside] += data[inside + j].astype(np.int64) + 1
    return doubled(np.unique(head, return_inverse=True)[1], left, 7, int(sizes.max())), first


def corpus_order(pieces: list[bytes], starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The order of the suffixes at starts (places in the joined pieces, which begin at first), each up to its piece's end."""
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.append(first[1:], len(text))
    cut = triggers(text)
    own = np.searchsorted(first, cut - 1, side="right") - 1
    cut = cut[(cut - WINDOW >= first[own]) & (cut < ends[own])]
    begin = np.union1d(first, cut - WINDOW)  # a phrase begins with the bytes that ended the one before
    piece = np.searchsorted(first, begin, side="right") - 1
    stop = np.append(begin[1:] + WINDOW, len(text))
    last = np.append(piece[1:] != piece[:-1], True)
    stop = np.where(last, ends[piece], np.minimum(stop, ends[piece]))
    raw = text.tobytes()
    phrases = [raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    distinct = sorted(set(phrases))
    number = {p: i for i, p in enumerate(distinct)}
    parse = np.array([number[p] for p in phrases], dtype=np.int64)
    parts = np.flatnonzero(last) + 1
    left = np.repeat(parts, np.diff(np.concatenate([[0], parts]))) - np.arange(len(parse))
    suffix = doubled(parse, left, 1, int(left.max()))
    follows = np.zeros(len(parse), dtype=np.int64)
    follows[:-1] = np.where(last[:-1], 0, suffix[1:] + 1)
    ranks, at = dictionary_ranks(distinct)
    phrase = np.searchsorted(begin, starts, side="right") - 1
    inner = ranks[at[parse[phrase]] + starts - begin[phrase]]
    return np.argsort(inner * (len(parse) + 2) + follows[phrase], kind="stable")


def solve(pieces: list[tuple[int, int, bytes, int]], width: int) -> list[np.ndarray]:
    """For each piece (anchor, id, bytes, windows): which of its windows stand in another piece too."""
    texts = [p[2] for p in pieces]
    n = np.array([p[3] for p in pieces])
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    base = np.cumsum(n) - n
    starts = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(base, n)
    order = corpus_order(texts, starts, first)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = starts[order]
    same = np.ones(len(at) - 1, dtype=bool)
    for which in (0, 1):
        h = Sums(_BYTE[which][data], which)(at, at + width)
        same &= h[1:] == h[:-1]
    flags = np.zeros(len(starts), dtype=bool)
    flags[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return np.split(flags, base[1:])


def finish(u: Units, removed: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    raw, left = u.data[~removed].tobytes(), np.concatenate([[0], np.cumsum(~removed)])[bounds]
    return [pa.array(np.diff(bounds), pa.int64()), spans_of(removed, bounds), pa.array([raw[a:b] for a, b in zip(left[:-1], left[1:], strict=True)], pa.binary())]


def suffix_dedup(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The columns of docs in keep, n_bytes, removed (array<struct<start, stop>>, in bytes, maximal runs) and kept (the bytes left).

    Strings are judged on the input; overlapping ones count, and so do two places in one text. Null and shorter texts lose
    nothing; kept is empty for null. Repeated rows repeat each other, whatever their id. Other columns have no influence; an
    empty table gives no rows. kept is binary: a cut may fall inside a character.
    """
    gram = max(1, min(GRAM, width * 2 // 5))
    plan = Plan(octets, width, gram, False, solve)
    return repeated(docs, plan, finish, "n_bytes long, removed array<struct<start:int,stop:int>>, kept binary", text, ["doc_id"] if keep is None else keep)
