import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_classifier as C
from millrace.llm.quality_rules import quality_rules

SCHEMA = "doc_id long, text string, n_words string, label int, score int"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_base_against_brute_force(spark):
    rng = random.Random(1)
    pieces = ["a b c d e f g h ", "é😀 ", "#|x ", "\n", "\t", "\x0b", "line one\n", " ", "w1 w2 w3 ", " ", "\x1c"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(120))), "", 0, 0) for i in range(400)]
    rows += [(900, None, None, None, None), (901, "", "", 0, 0), (902, " \n", "", 0, 0), (903, "x " * 300000, "", 0, 0), (904, "y" * 3000000, "", 0, 0), (904, "y" * 3000000, "", 0, 0)]
    texts = {r[0]: r[1] for r in rows}
    out = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), repr(texts[r.doc_id])[:200]
        assert r.kept == (r.verdict == "kept") and not (r.base_failed and r.kept)


def test_bands_reject_what_repeats_and_what_is_random(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice(["th", "er", "an", "in", "re", "on"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30)) for _ in range(300))
    echo = "\n".join(f"{i} say it over and over once more {'again ' * 40}" for i in range(40))
    half = prose[:6000] + " ".join(f"abcdefgh{i % 7}" for i in range(9000))
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(1, prose, "", 0, 0), (2, noise, "", 0, 0), (3, echo, "", 0, 0), (4, half, "", 0, 0)], SCHEMA)).collect()}
    assert out[1].kept and out[1].verdict == "kept"
    assert out[2].verdict == "incompressible" and not out[3].kept and not out[4].kept


def test_clean_documents_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules(docs).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    assert judged.where("not kept").count() == 0


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = C.quality_classifier(docs, labels).toPandas()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(out) == docs.count() and all(out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id])
    held = out[out.held_out & out.doc_id.isin(truth.keys())]
    y = np.array([truth[i] for i in held.doc_id])
    assert (held.predicted.values == y).mean() > 0.93
    rank = held.score.rank().values
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.97
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.limit(50)
    assert np.allclose(C.quality_classifier(docs, flipped).where("doc_id < 50").orderBy("doc_id").toPandas().score, out[out.doc_id < 50].sort_values("doc_id").score)
    assert few.count() == 50


def test_odd_rows(spark):
    rows = [(1, None, "", 0, 0), (2, "", "", 0, 0), (3, "z" * 200000, "", 0, 0), (None, "abc", None, None, None), (3, "z" * 200000, "", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, None), (77, 1), (None, 1)], "doc_id long, quality int")
    out = C.quality_classifier(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0.5 for r in C.quality_classifier(docs, labels.limit(0)).collect())
    assert C.quality_classifier(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 960, 961, 5000])
def test_chunks_cover_the_whole_text(n):
    data = (np.arange(n) % 250).astype(np.uint8)
    chunks, bounds = C.chunked(data, np.array([0, n]))
    seen = np.zeros(n, dtype=bool)
    for i, c in enumerate(chunks):
        own = c[c != C.PAD]
        assert (own == data[i * C.STEP : i * C.STEP + len(own)]).all()
        seen[i * C.STEP : i * C.STEP + len(own)] = True
    assert seen.all() and bounds[-1] == len(chunks) >= 1
    assert len(C.probabilities(C.fit([], [], 0.5), pa.array(["x" * n]))) == 1
