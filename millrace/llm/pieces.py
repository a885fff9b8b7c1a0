"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a model and their scores span a lattice over a text; a segmentation scores the sum of its pieces. Forward Viterbi
scores at each place are the exact cost to go for an A* search from the end backwards, which so yields segmentations best first.
No piece holds a space after another character, so a text's lattice falls into chunks at spaces (and around characters that
no piece holds): chunks are solved once each, and the chunks' lists are merged into the text's.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Solved chunks that a Python worker remembers, and chunks' N-best lists.
REMEMBERED, LISTS = 150_000, 30_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
ALTERNATIVES = "array<struct<score: double, changes: array<struct<at: int, drop: int, ids: array<int>>>>>"


@dataclass
class Table:
    """A model's pieces as bytes (the space mark is a space), by id, and scores; byte pieces stand for characters without a piece."""

    pieces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    key: str = ""

    def __post_init__(self) -> None:
        self.key = hashlib.sha256(repr((self.pieces, self.scores.tolist())).encode()).hexdigest()
        self.sizes = np.array([len(p) for p in self.pieces])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces of all rows' ids (rows' n+1 offsets), joined, and the rows' n+1 offsets in that."""
        n = self.sizes[ids] if len(ids) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.pool[np.repeat(self.first[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes() if len(ids) else b""
        return raw, ends[offsets]


def load(path: str = MODEL) -> Table:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.vocab_size())
    normal = np.array([not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in n])
    pieces, byte_ids = [], np.full(256, -1, dtype=np.int32)
    for i in n:
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
            pieces.append(bytes([int(p[1:-1], 16)]))
        else:
            pieces.append(p.replace("▁", " ").encode() if normal[i] else b"")
    return Table(pieces, np.array([m.get_score(i) for i in n], dtype=np.float64), normal, byte_ids)


@dataclass
class Solver:
    """Solves chunks with one table; kept by a Python worker from task to task."""

    table: Table
    known: dict[bytes, tuple[bytes, float, float]] = field(default_factory=dict)
    lists: dict[bytes, list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        t = self.table
        self.ids = {p: i for i, p in reversed(list(enumerate(t.pieces))) if t.normal[i] and p}
        self.longest = max(map(len, self.ids), default=1)
        #: A character without a piece of its own counts less than any piece and turns into its bytes.
        self.unknown = float(t.scores[t.normal & (t.scores > -1e8)].min(initial=0.0)) - 10
        children: list[dict[int, int]] = [{}]
        final = [-1]
        for p, i in self.ids.items():
            at = 0
            for b in p:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    final.append(-1)
                at = nxt
            final[at] = i
        inner = [n for n, c in enumerate(children) if c]
        row = np.full(len(children), -1, dtype=np.int32)
        row[inner] = np.arange(len(inner))
        self.step = np.full((len(inner), 256), -1, dtype=np.int32)
        for n in inner:
            for b, c in children[n].items():
                self.step[row[n], b] = c
        self.row, self.final = row, np.array(final, dtype=np.int32)
        held = set(b"".join(self.ids))
        #: Single-byte characters that no piece holds: no piece crosses them.
        self.apart = np.array([b < 0x80 and b not in held for b in range(256)])
        if any(b" " in p.lstrip(b" ") for p in self.ids):
            raise ValueError("a piece has a space after another character")

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Chunks of the texts, each text led by a space if it isn't empty, and the texts' n+1 bounds in chunks."""
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes > 0)
        data = np.insert(data, offsets[some], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
        cut = np.zeros(len(data) + 1, dtype=bool)
        space, apart = data == 0x20, self.apart[data]
        cut[1:-1] = (space[1:] & ~space[:-1]) | apart[1:] | apart[:-1]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        bounds = np.searchsorted(at, offsets)
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(offsets), dtype=np.int64)
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]), bounds

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece (-1: unknown character) of every edge of the lattice; ends: where each place's chunk ends."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(data)))
        at, state, found, alone = lead, np.zeros(len(lead), dtype=np.int32), [], np.zeros(len(data), dtype=bool)
        wide = np.zeros(len(data), dtype=np.int32)
        wide[lead] = width
        for n in range(1, self.longest + 1):
            ok = at + n <= ends[at]
            at, state = at[ok], state[ok]
            state = self.step[self.row[state], data[at + n - 1]]
            ok = state >= 0
            at, state = at[ok], state[ok]
            piece = self.final[state]
            hit = piece >= 0
            found.append((at[hit], np.full(hit.sum(), n, dtype=np.int32), piece[hit]))
            alone[at[hit & (wide[at] == n)]] = True
            ok = self.row[state] >= 0
            at, state = at[ok], state[ok]
            if not len(at):
                break
        rest = lead[~alone[lead]]
        found.append((rest, wide[rest], np.full(len(rest), -1, dtype=np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def solve(self, chunks: list[bytes]) -> list[tuple[bytes, float, float]]:
        """Ids (32-bit numbers), score and loss of the second best segmentation (infinite if there is none) for each chunk."""
        sizes = np.array([len(c) for c in chunks])
        data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)])
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        start, size, piece = self.edges(data, first[1:][chunk])
        own = chunk[start]
        score = np.where(piece >= 0, self.table.scores[piece], self.unknown)
        place = start - first[own]
        node = start + own  # a chunk has a node more than bytes
        forward = np.full(len(data) + len(chunks), -np.inf)
        forward[first[:-1] + np.arange(len(chunks))] = 0
        backward, last = np.full(len(forward), -np.inf), first[1:] + np.arange(len(chunks))
        backward[last] = 0
        came = np.full(len(forward), -1, dtype=np.int64)
        # of one length, one edge at most ends (or starts) at a node: edges go group by group, by place and length
        for edge in groups((place + size) * 64 + size):
            to = node[edge] + size[edge]
            value = forward[node[edge]] + score[edge]
            better = value > forward[to]
            forward[to[better]] = value[better]
            came[to[better]] = edge[better]
        for edge in reversed(groups(place * 64 + size)):
            value = backward[node[edge] + size[edge]] + score[edge]
            backward[node[edge]] = np.maximum(backward[node[edge]], value)
        on = np.zeros(len(start), dtype=bool)
        at = last[sizes > 0]
        while len(at):
            edge = came[at]
            on[edge] = True
            at = node[edge]
            at = at[came[at] >= 0]
        second = np.full(len(chunks), -np.inf)
        np.maximum.at(second, own[~on], (forward[node] + score + backward[node + size])[~on])
        path = np.flatnonzero(on)
        path = path[np.argsort(start[path], kind="stable")]
        n = np.where(piece[path] >= 0, 1, size[path])
        ids = np.repeat(piece[path], n)
        unknown = ids < 0
        if unknown.any():
            byte = np.repeat(start[path], n) + np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            ids[unknown] = self.table.byte_ids[data[byte[unknown]]]
        split = 4 * np.searchsorted(np.repeat(own[path], n), np.arange(len(chunks) + 1))
        best, raw = forward[last], ids.astype(np.int32).tobytes()
        return [(raw[split[i] : split[i + 1]], float(best[i]), float(best[i] - second[i])) for i in range(len(chunks))]

    def solved(self, chunks: list[bytes]) -> list[tuple[bytes, float, float]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        self.known.update(zip(new, self.solve(new), strict=True) if new else ())
        return [self.known[c] for c in chunks]

    def nbest(self, chunk: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a chunk, best first: forward Viterbi, then A* from its end."""
        if chunk in self.lists and len(self.lists[chunk]) >= n:
            return self.lists[chunk][:n]
        size = len(chunk)
        ending: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [-np.inf] * size
        lead = [i for i in range(size) if chunk[i] & 0xC0 != 0x80] + [size]
        for k, at in enumerate(lead[:-1]):
            for to in lead[k + 1 :]:
                if to - at > self.longest and to != lead[k + 1]:
                    break
                i = self.ids.get(chunk[at:to])
                if i is not None:
                    ending[to].append((at, float(self.table.scores[i]), (i,)))
                elif to == lead[k + 1]:
                    ending[to].append((at, self.unknown, tuple(int(self.table.byte_ids[b]) for b in chunk[at:to])))
        for to in lead[1:]:
            best[to] = max((best[at] + s for at, s, _ in ending[to]), default=-np.inf)
        # (minus the whole's score, age, place, score behind it, pieces behind it as a linked list); of equal scores the youngest goes first, so that it runs to the start
        agenda: list[tuple[float, int, int, float, tuple]] = [(-best[size], 0, size, 0.0, ())]
        out, made, opened = [], 0, [0] * (size + 1)
        while agenda and len(out) < n:
            _, _, at, behind, tail = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((behind, tuple(ids)))
                continue
            opened[at] += 1
            if opened[at] > n:  # n better ways lead on from here
                continue
            for start, s, own in ending[at]:
                made += 1
                heapq.heappush(agenda, (-round(best[start] + s + behind, 6), -made, start, behind + s, (own, tail)))
        if len(self.lists) > LISTS:
            self.lists.clear()
        self.lists[chunk] = out
        return out

    def alternatives(self, codes: np.ndarray, distinct: list[bytes], loss: np.ndarray, total: float, own: np.ndarray, at: np.ndarray, n: int) -> list[dict]:
        """The second to n-th best segmentations of a text, as changes to its best one.

        codes: its chunks; loss: of their second best; total: its best score; own and at: how many pieces chunks have, and from where.

        Only chunks with the n-1 smallest losses can differ from the best in them.
        """
        few = np.argsort(loss, kind="stable")[: n - 1] if len(loss) <= 4 * n else (near := np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2]))[np.argsort(loss[near], kind="stable")][: n - 1]
        few = [int(i) for i in few if np.isfinite(loss[i])]
        lists = [self.nbest(distinct[codes[i]], n) for i in few]
        heap, seen, out = [(0.0, (0,) * len(few))], {(0,) * len(few)}, []
        while heap and len(out) < n:
            cost, pick = heapq.heappop(heap)
            out.append({"score": total - cost, "changes": [{"at": int(at[i]), "drop": int(own[i]), "ids": list(ways[p][1])} for i, ways, p in zip(few, lists, pick, strict=True) if p]})
            for k, ways in enumerate(lists):
                if pick[k] + 1 < len(ways):
                    nxt = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (cost + ways[pick[k]][0] - ways[pick[k] + 1][0], nxt))
        return out[1:]

    def encode(self, column: pa.Array, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """ids, score and alternatives of each text."""
        chunks, bounds = self.chunks(*utf8(column))
        coded = chunks.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        solved = self.solved(distinct)
        lengths = np.array([len(s[0]) // 4 for s in solved], dtype=np.int64)
        pool = np.frombuffer(b"".join(s[0] for s in solved), dtype=np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        own = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = pool[np.repeat(offsets[codes] - ends[:-1], own) + np.arange(ends[-1])]
        best, losses = (np.array([s[k] for s in solved], dtype=np.float64) for k in (1, 2))
        totals = np.diff(np.concatenate([[0.0], np.cumsum(best[codes])])[bounds])
        loss = losses[codes] if len(codes) else losses
        others = [self.alternatives(codes[a:b], distinct, loss[a:b], total, own[a:b], ends[a:b] - ends[a], n) if n > 1 and b > a else [] for a, b, total in zip(bounds[:-1].tolist(), bounds[1:].tolist(), totals.tolist(), strict=True)]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(totals), pa.array(others, type=kind)


_SOLVERS: dict[str, Solver] = {}


def solver(table: Table) -> Solver:
    if table.key not in _SOLVERS:
        _SOLVERS.clear()
        _SOLVERS[table.key] = Solver(table)
    return _SOLVERS[table.key]


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", keep: list[str] | None = None, n: int = 4, check: bool = False) -> DataFrame:
    """The columns of docs named in keep, then ids (the best segmentation), score, and alternatives: the second to n-th best,
    each with its score and the changes that turn the best one into it (drop pieces at a place, put in ids).

    A text gets a leading space, as the model's own encoder adds one. Characters without a piece become their UTF-8 bytes,
    and so does the model's space mark where a text holds that character itself, so decoding is exact. Null and empty texts
    have no pieces, score 0 and no alternatives. Repeated rows are encoded alike; ties go to shorter last pieces. Extra columns have no
    influence. model: a file that the driver reads; executors get its pieces from the driver. check: adds round_trip, whether the ids
    decode to the text again, which is known at once where they are made.
    """
    keep = ["doc_id"] if keep is None else keep
    table = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = solver(table)
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                text_column = part.column(len(keep))
                made = list(s.encode(text_column, n))
                if check:
                    made.append(round_trips(table, made[0], text_column))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=[*keep, "ids", "score", "alternatives", *["round_trip"][: len(made) - 3]])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["ids array<int>", "score double", f"alternatives {ALTERNATIVES}"] + ["round_trip boolean"] * check)
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, ddl)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", keep: list[str] | None = None, name: str = "decoded") -> DataFrame:
    """The columns of encoded named in keep, and the text of ids: pieces joined, less the leading space. Null ids give null;
    bytes that are no valid UTF-8 become U+FFFD; ids outside the model are an error."""
    keep = ["doc_id"] if keep is None else keep
    table = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(len(keep))
            for at in range(0, batch.num_rows, 512):
                part = col.slice(at, 512)
                offsets = part.offsets.to_numpy()
                raw, ends = table.joined(part.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
                texts = [raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                texts = [t[1:] if t[:1] == " " else t for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, 512) for i in range(len(keep))] + [pa.array([t if ok else None for t, ok in zip(texts, part.is_valid().to_pylist(), strict=True)], pa.string())], names=[*keep, name])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema] + [f"`{name}` string"])
    return encoded.select(*keep, ids).mapInArrow(run, ddl)


def checked_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids and score of the best segmentation, next_scores of the next best, and round_trip: whether decoding gives the text again."""
    out = encode(docs.select("doc_id", "text"), model, check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", F.transform("alternatives", lambda a: a["score"]).alias("next_scores"), "round_trip")


def round_trips(table: Table, ids: pa.ListArray, column: pa.Array) -> pa.Array:
    """Whether each row's ids decode to its text."""
    raw, ends = table.joined(ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy() - ids.offsets[0].as_py())
    data, offsets = utf8(column)
    text = data.tobytes()
    return pa.array([raw[a + (b > a) : b] == text[c:d] and (b == a or raw[a] == 0x20) for a, b, c, d in zip(ends[:-1].tolist(), ends[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.bool_())


def groups(key: np.ndarray) -> list[np.ndarray]:
    """Places of equal keys, by rising key."""
    if not len(key):
        return []
    order = np.argsort(key.astype(np.uint16) if key.max() < 65536 else key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
