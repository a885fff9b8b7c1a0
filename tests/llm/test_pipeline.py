import re

import pytest
import sentencepiece

import corpus_pipeline
from millrace.llm.pii import find, train
from millrace.llm.quality_rules import quality_rules

from .test_jaccard import brute
from .test_mixing import expected_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The output of every stage over the table and some odd rows, written and read again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, None, None), (9003, "word " * 30000, "en", "src0", 1), (first.doc_id, first.text, first.lang, first.source, first.n_chars), (9004, first.text, "en", None, 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out, base = [docs.collect()], str(tmp_path_factory.mktemp("steps"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        assert i == 4 or docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_quality_rules_reject(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
    judged = quality_rules(spark.createDataFrame(steps[0], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r.doc_id for r in judged.where("kept").collect()) == sorted(r.doc_id for r in steps[1])
    assert not {9001, 9002, 9003} & {r.doc_id for r in steps[1]}


def test_one_of_each_group_stays(steps):
    want = {int(d) for d, _, c, *_ in brute([(r.doc_id, r.text) for r in steps[1]]) if d == c}
    assert sorted(r.doc_id for r in steps[2]) == sorted(want)


def test_personal_data_is_replaced(spark, steps):
    before, after = ({r.doc_id: r.text for r in steps[i]} for i in (2, 3))
    docs = spark.createDataFrame(steps[2], "doc_id long, text string, lang string, source string, n_chars long")
    for r in find(docs, model=train(spark)).collect():
        text, at, out = before[r.doc_id], 0, ""
        for s in sorted([*r.base, *r.added]):
            if s.start >= at:
                out += text[at : s.start] + f"<{('email', 'ip', 'card', 'phone')[s.kind]}>"
            at = max(at, s.stop)
        assert after[r.doc_id] == out + text[at:]
    assert all(r.n_chars == len(r.text) for r in steps[3])


def test_mix_comes_to_its_targets(steps):
    sizes, target = expected_targets([(r.doc_id, r.text, r.source) for r in steps[3]])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    taken = {s: sum(len(words(r.text)) for r in steps[4] if r.source == s) for s in sizes}
    assert taken == {s: int(t + 0.5) for s, t in target.items()}
    texts = {r.doc_id: " ".join(words(r.text)) for r in steps[3]}
    for r in steps[4]:
        assert set(words(r.text)) <= set(words(texts[r.doc_id]))


def test_pieces_decode_to_the_mix(steps):
    m = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert all(r.round_trip for r in steps[5])
    assert sorted((r.doc_id, m.decode(list(r.ids))) for r in steps[5]) == sorted((r.doc_id, r.text) for r in steps[4])


def test_run_gives_the_last_stage_again(spark, sf):
    a, b = (sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).select("doc_id", "ids").collect()) for _ in range(2))
    assert a == b and a
