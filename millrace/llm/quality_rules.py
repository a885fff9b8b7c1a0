"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks, with limits by length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import Words, covered, complete, per_row, slices, utf8

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Texts of at least from_bytes bytes keep a ratio (compressed / plain) from low to high."""

    from_bytes: int
    low: float
    high: float


#: Very short texts have no stable ratio: they pass. The longer a text, the narrower the band of prose.
DOCUMENT_BANDS = (Band(0, 0.0, 99.0), Band(128, 0.25, 1.15), Band(256, 0.28, 0.95), Band(1024, 0.25, 0.75), Band(8192, 0.2, 0.7), Band(65536, 0.15, 0.7))
CHUNK_BANDS = (Band(0, 0.0, 99.0), Band(512, 0.2, 0.9), Band(2048, 0.22, 0.75))
CHUNK_BYTES = 4096
#: Share of a text's judged chunks outside their band from which the text is rejected.
CHUNK_SHARE = 0.5
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, verdict string, kept boolean"


def limits(bands: tuple[Band, ...], n: int) -> Band:
    return next(b for b in reversed(bands) if n >= b.from_bytes)


def repeated_words(codes: np.ndarray, bounds: np.ndarray, width: int = 8) -> np.ndarray:
    """Words of each row that lie in a window of width (a power of two) words found twice or more in that row.

    Exact: windows get numbers by doubling, from pairs of words up; no hash stands for a window.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(len(bounds) - 1, dtype=np.int64)
    rank, half = codes.astype(np.int64), 1
    while half < width:
        rank = np.unique(rank[:-half] * (int(rank.max()) + 1) + rank[half:], return_inverse=True)[1]
        half *= 2
    at = np.flatnonzero(complete(bounds, len(codes), width))
    if not len(at):
        return np.zeros(len(bounds) - 1, dtype=np.int64)
    row = np.searchsorted(bounds, at, side="right") - 1
    _, where, times = np.unique(rank[at] * np.int64(len(bounds)) + row, return_inverse=True, return_counts=True)
    return per_row(covered(len(codes), at[times[where] > 1], width), bounds)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def ratios(text: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Ratio of the whole text; chunks that are judged, too repetitive, and incompressible."""
    whole = len(pack.compress(text)) / len(text)
    low = high = judged = 0
    if len(text) > CHUNK_BYTES:
        for at in range(0, len(text), CHUNK_BYTES):
            chunk = text[at : at + CHUNK_BYTES]
            band = limits(CHUNK_BANDS, len(chunk))
            if band.from_bytes:
                r = len(pack.compress(chunk)) / len(chunk)
                judged, low, high = judged + 1, low + (r < band.low), high + (r > band.high)
    return whole, judged, low, high


def judge(column: pa.Array, level: int) -> dict[str, list | np.ndarray]:
    data, offsets = utf8(column)
    words = Words(data, offsets)
    codes, _ = words.coded()
    lead = words.inside & ((data & 0xC0) != 0x80)
    repeats = repeated_words(codes, words.bounds)
    failed = (words.counts < 20) | (100 * repeats > 30 * words.counts)
    pack = zstandard.ZstdCompressor(level=level, write_content_size=False)
    raw = data.tobytes()
    found: dict[str, list] = {k: [] for k in ("dup", "ratio", "chunks", "low", "high", "verdict")}
    for i in range(len(offsets) - 1):
        text = raw[offsets[i] : offsets[i + 1]]
        whole, judged, low, high = ratios(text, pack) if text else (None, 0, 0, 0)
        band = limits(DOCUMENT_BANDS, len(text))
        verdict = "base" if failed[i] else "repetitive" if whole < band.low or low and low >= CHUNK_SHARE * judged else "incompressible" if whole > band.high or high and high >= CHUNK_SHARE * judged else "kept"
        for k, v in zip(found, (duplicate_lines(text), whole, judged, low, high, verdict), strict=True):
            found[k].append(v)
    return {
        "n_words": words.counts, "word_chars": per_row(lead, offsets), "n_symbols": per_row(SYMBOL[data], offsets), "n_dup_lines": found["dup"], "n_repeat_words": repeats, "base_failed": failed,
        "n_bytes": np.diff(offsets), "ratio": found["ratio"], "n_chunks": found["chunks"], "n_low_chunks": found["low"], "n_high_chunks": found["high"], "verdict": found["verdict"], "kept": [v == "kept" for v in found["verdict"]],
    }


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, level: int = 3) -> DataFrame:
    """One row per row of docs: the columns named in keep (doc_id by default), then base counts, ratios and a verdict.

    verdict: base (a base rule failed: fewer than 20 words, or over 30 % of words in 8-word windows that repeat), repetitive or
    incompressible (outside a band of DOCUMENT_BANDS, or at least CHUNK_SHARE of the chunks outside CHUNK_BANDS), else kept.
    Null and empty texts: 0 words, ratio null, verdict base. Repeated rows are judged alike, each on its own. Other columns of
    docs, whatever their names, don't matter; names in keep that clash with a result are refused by Spark when selected.
    """
    keep = ["doc_id"] if keep is None else keep
    schema = docs.select(*keep).schema
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = judge(part.column(part.schema.get_field_index("__text")), level)
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "verdict": pa.string()}
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(found[k], type=kinds.get(k, pa.int64())) for k in names], names=[*keep, *names])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [SCHEMA])
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, ddl)
