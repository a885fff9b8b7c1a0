import base64
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm.byte_bpe import Coder, byte_bpe, decode, encode, load

SCHEMA = "doc_id long, text string, tokens string, decoded int, `key` long, part string"


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, None) for i, t in rows], SCHEMA).repartition(3)


def made(rng, n):
    parts = ["don't", "we'll", "'re", "''s", " ", "  ", "\n", " \n\n", "\t", " ", " ", "é", "日本語", "12345", "x²", "!?", "...'t", "naïve", "🙂", "á", "\x1c", "Ωmega", "z" * 30, " " * 30, "²", "'", "'d"]
    return "".join(rng.choice(parts) if rng.random() < 0.5 else " word" + str(rng.randrange(50)) for _ in range(n))


def check(spark, library, rows, **kw):
    got = {}
    out = encode(frame(spark, rows), **kw)
    assert out.columns == ["doc_id", "tokens"]
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(list(r.tokens))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library.encode_ordinary(t or ""))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


@pytest.mark.parametrize("chunk, overlap", [(40, 40), (64, 25), (200, 80)])
def test_chunks_stitch_to_what_the_library_gives(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    rows = [(i, made(rng, rng.randrange(1, 120))) for i in range(80)]
    rows += [(80, None), (81, ""), (None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1]), (82, "z" * 1500), (83, " " * 900 + "a"), (84, "ab " * 400), (85, "日" * 500), (86, "x" + " \n" * 300)]
    check(spark, library, rows, chunk=chunk, overlap=overlap)


def test_standard_chunks(spark, library):
    rng = random.Random(9)
    check(spark, library, [(i, made(rng, 9000)) for i in range(4)] + [(9, "q" * 40000), (10, "one two " * 30000)])


def test_white_space_that_the_library_gives_up_on(spark):
    """A million spaces overflow the library's reader; they are encoded by their pre-tokens, and decode to the text."""
    text = "a" + " " * 1_000_000 + "b"
    out = encode(frame(spark, [(1, text)]))
    [r] = decode(out).collect()
    assert bytes(r.decoded).decode() == text


def test_digests_and_round_trip(spark, library, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe(docs).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert not got


def test_empty_table_and_null_ids(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert encode(empty).count() == 0 and byte_bpe(empty).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, tokens array<int>")
    assert [(r.doc_id, bytes(r.decoded)) for r in decode(rows).orderBy("doc_id").collect()] == [(1, b""), (2, b""), (3, Coder(*load()).encoding.decode_bytes([64, 65]))]


def test_arguments(spark):
    with pytest.raises(ValueError):
        encode(frame(spark, [(1, "a")]), chunk=10, overlap=11)
