"""The pipeline against a plain version of each stage, on whole tables."""

import hashlib
import struct
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronoweir.llm import common, toxicity
from conftest import prose
from test_line_dedup import brute as line_brute
from test_minhash import brute as near_brute

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
def test_equals_plain_version(spark):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in common.table(spark, SF, "documents").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, SF, "labels").collect() if r["toxic"] is not None}
    held = {i for i in docs if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    learn = sorted(i for i in docs if i in labels and i not in held)
    model = toxicity.fit([docs[i][0] or "" for i in learn], [labels[i] for i in learn])
    emit = toxicity.Emissions(model)
    score = lambda t: model.scores(toxicity._evidence([(t or "").encode().split()], emit, model)[0])[0]
    docs = {i: v for i, v in docs.items() if score(v[0]) < toxicity.THRESHOLD}
    lines = line_brute([(i, t) for i, (t, _) in docs.items()])
    docs = {i: (kept if gone else docs[i][0], docs[i][1]) for i, _, gone, kept in lines if kept.strip(WHITE) or not (docs[i][0] or "").strip(WHITE)}
    docs = {i: docs[i] for i, _, c in near_brute([(i, t) for i, (t, _) in docs.items()], 5, 80) if i == c}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    got = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) <= set(docs)
    # how often each is taken is tested with the mixing; here the sum
    from test_mixing import level

    sizes, taken, most = Counter(), Counter(), Counter()
    for i, (t, s) in docs.items():
        n = len((t or "").split())
        sizes[s] += n
        taken[s] += copies[i] * n
        most[s] = max(most[s], n)
    for s, target in level(dict(sizes)).items():
        assert abs(taken[s] - target) <= 2 * most[s]
    for r in got:
        ids = library.encode(docs[r["doc_id"]][0] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decisions_take_effect(spark, frame, tmp_path):
    import random

    rng = random.Random(11)
    base = [prose(rng, 120) for _ in range(40)]
    passage = "A line that many documents share, with enough characters"
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t + " tail", "en", "s0", 0) for i, t in enumerate(base[:5])]
    rows += [(200 + i, passage, "en", "s1", 0) for i in range(4)]
    bad = [(300 + i, prose(rng, 40) + " grolker grolking grolks " + prose(rng, 40) + " grolked", "en", "s0", 0) for i in range(30)]
    frame(rows + bad).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 1, 1) for r in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(i >= 300 for i in got)  # toxic
    assert not any(200 < i < 300 for i in got)  # nothing but copied lines
    assert not any(100 <= i < 105 for i in got)  # near copies
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows}  # clean ones stay
