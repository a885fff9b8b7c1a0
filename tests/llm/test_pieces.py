import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.pieces import Solver, checked_pieces, decode, encode, load

SCHEMA = "doc_id long, text string, ids string, score int, decoded string"


@pytest.fixture(scope="module")
def solver():
    return Solver(load())


def brute(s, text, n):
    """All segmentations of a whole text, not of its chunks."""
    raw, out = (" " + text).encode(), []

    def go(at, ids, score):
        if at == len(raw):
            out.append((score, ids))
            return
        width = 1
        while at + width < len(raw) and raw[at + width] & 0xC0 == 0x80:
            width += 1
        for size in range(1, s.longest + 1):
            i = s.ids.get(raw[at : at + size]) if at + size <= len(raw) else None
            if i is not None:
                go(at + size, (*ids, i), score + s.table.scores[i])
        if raw[at : at + width] not in s.ids:
            go(at + width, ids + tuple(int(s.table.byte_ids[b]) for b in raw[at : at + width]), score + s.unknown)

    go(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])[:n]


def apply(ids, changes):
    out = list(ids)
    for c in sorted(changes, key=lambda c: -c["at"]):
        out[c["at"] : c["at"] + c["drop"]] = c["ids"]
    return tuple(out)


def test_n_best_against_all_segmentations(spark, solver):
    texts = ["the cat", "a  bé\nc", "x\ty", "日本 ▁z", "un\x00do", "ab ab ab", "\n", " ", "ç" * 3, "hello"]
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in enumerate(texts)], SCHEMA)
    for r in encode(df, n=5).collect():
        want = brute(solver, texts[r.doc_id], 5)
        assert r.score == pytest.approx(want[0][0])
        assert [a["score"] for a in r.alternatives] == pytest.approx([w[0] for w in want[1:]])
        every = dict(zip((w[1] for w in brute(solver, texts[r.doc_id], 10**6)), (w[0] for w in brute(solver, texts[r.doc_id], 10**6)), strict=True))
        assert every[tuple(r.ids)] == pytest.approx(r.score)
        mine = [apply(r.ids, a["changes"]) for a in r.alternatives]
        assert len({tuple(r.ids), *mine}) == len(mine) + 1
        for ids, a in zip(mine, r.alternatives, strict=True):
            assert every[ids] == pytest.approx(a["score"])


def test_round_trip(spark):
    rng = random.Random(3)
    alphabet = "ab the  \n\t\x00▁é日😀İ ,.-"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))), "x", 1, "y") for i in range(500)]
    rows += [(600, "x" * 20000, "", 1, ""), (601, "a b " * 30000, "", 1, ""), (602, "", "", 1, ""), (603, None, None, None, None), (604, " lead", "", 0, ""), (604, " lead", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    back = decode(encode(df, keep=["doc_id", "text"]), keep=["doc_id", "text"])
    assert checked_pieces(df).where("round_trip").count() == len(rows)
    assert back.count() == len(rows)
    assert back.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).count() == 0


def test_table_and_model_decoder(spark, sf):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = encode(df, keep=["text"]).collect()
    assert all(m.decode(list(r.ids)) == r.text for r in rows[:50])
    assert all(len(r.alternatives) == 3 and r.score >= r.alternatives[0]["score"] >= r.alternatives[2]["score"] for r in rows if len(r.text) > 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert encode(df).count() == 0 and decode(encode(df)).count() == 0


def test_batches_and_single_chunks_agree(solver):
    chunks = [b" then", b" l\xc3\xa9", b"\n", b" zzzzzz", b"  "]
    for c, (ids, score, loss) in zip(chunks, solver.solve(chunks), strict=True):
        best = solver.nbest(c, 2)
        assert score == pytest.approx(best[0][0]) and (np.isinf(loss) if len(best) < 2 else loss == pytest.approx(best[0][0] - best[1][0]))
        assert tuple(np.frombuffer(ids, dtype=np.int32)) == best[0][1] or loss == 0
