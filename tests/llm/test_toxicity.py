import itertools
import math
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from chronoweir.llm import common, toxicity
from conftest import prose

SF = "/root/testdata/sf0.1"


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 1, 5])
    emissions, pair = rng.normal(size=9), rng.normal(size=(2, 2))
    got, at = toxicity.marginals(emissions, counts, pair), 0
    for n in counts:
        e = emissions[at : at + n]
        total, one = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] * t for i, t in enumerate(tags)) + sum(pair[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            one += w * np.array(tags)
        if n:
            assert np.allclose(got[at : at + n], one / total)
        at += n


def labelled(seed, n):
    """Texts; the toxic ones hold words that start alike."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words, bad = prose(rng, rng.randrange(20, 200)).split(), i % 4 == 0
        if bad:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), "grolk" + rng.choice(["er", "ing", "s", "", "ish", "ed"]) + rng.choice(["", "!", ","]))
        out.append((" ".join(words), int(bad)))
    return [t for t, _ in out], [y for _, y in out]


def test_learns_tags_and_scores():
    model = toxicity.fit(*labelled(1, 500))
    texts, y = labelled(2, 200)
    emit = toxicity.Emissions(model)
    evidence, p, counts = toxicity._evidence([t.encode().split() for t in texts], emit, model)
    predicted = model.scores(evidence) >= toxicity.THRESHOLD
    assert (predicted == np.array(y, bool)).mean() > 0.98
    at = 0
    for t, n in zip(texts, counts, strict=True):
        found = {t[s["start"] : s["stop"]] for s in toxicity.spans(t, p[at : at + n])}
        assert all("grolk" in x for x in found)
        at += n
    assert toxicity.Model.from_json(model.to_json()).scores(evidence).tolist() == model.scores(evidence).tolist()


def test_all_marked_words_and_all_clean_words_are_trained_on():
    split = [["bad"] * 41 + ["w"] * 30 + ["bad"], ["c%d" % i for i in range(300)]]
    word, names, label, counts = toxicity._sequences(split, np.array([True, False]), {"bad"})
    assert label.sum() == 42 and counts.sum() == len(word) and counts.max() <= toxicity.STRETCH
    assert {names[i] for i in word} == {"bad", "w", *split[1]}
    assert len(word) == 41 + 8 + 8 + 1 + 300


def test_plain_score():
    """The score by forward and backward sums in plain Python."""
    model = toxicity.fit(*labelled(1, 300))
    for text in [*labelled(4, 12)[0], "", "one"]:
        words = text.split()
        e = [math.exp(min(30, max(-30, model.bias + sum(model.weights.get(f, 0) for f in toxicity.features(w))))) for w in words]
        m = np.exp(model.pair)
        ahead, behind = [], []
        for x in e:
            ahead.append(np.array([1, x]) * (ahead[-1] @ m if ahead else 1))
            ahead[-1] /= ahead[-1].sum()
        for x in reversed([*e[1:], None] if e else []):
            behind.insert(0, np.ones(2) if x is None else m @ (np.array([1, x]) * behind[0]))
            behind[0] /= behind[0].sum()
        p = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, behind, strict=True)]
        want = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log(0.3 + sum(x * x for x in p)))))
        emit = toxicity.Emissions(model)
        assert abs(model.scores(toxicity._evidence([text.encode().split()], emit, model)[0])[0] - want) < 1e-9


def test_learning_takes_little_memory(monkeypatch):
    """All words as strings, lists of features and step arrays over all places took 76 times these texts' bytes; numbers worked on in parts take 25."""
    monkeypatch.setattr(toxicity, "PLACES", 5000, raising=False)
    monkeypatch.setattr(toxicity, "TOGETHER", 50, raising=False)
    rng = random.Random(3)
    texts, y = labelled(1, 800)
    texts = [t + "".join(f" {rng.choice('bdgklm')}a{rng.randrange(10**5)}" for _ in range(100)) for t in texts]
    toxicity.fit(texts[:40], y[:40])
    tracemalloc.start()
    try:
        model = toxicity.fit(texts, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weights
    assert peak < 35 * sum(map(len, texts)), peak / sum(map(len, texts))


@pytest.mark.parametrize("places", [1, 70, 1000])
def test_parts_of_places_change_nothing(monkeypatch, places):
    texts, y = labelled(5, 60)
    whole = toxicity.fit(texts, y)
    monkeypatch.setattr(toxicity, "PLACES", places)
    parts = toxicity.fit(texts, y)
    assert parts.weights.keys() == whole.weights.keys()
    assert np.allclose([parts.weights[f] for f in whole.weights], list(whole.weights.values()), atol=1e-6)
    counts = np.array([3, 1, 64, 64, 2, 5])
    assert [p.stop - p.start for p, _, _ in toxicity._parts(counts)] == ([*counts] if places == 1 else [68, 71] if places == 70 else [139])


def test_nothing_to_learn_from():
    for texts, y in (([], []), (["a b"], [1]), (["a", "b"], [0, 0])):
        model = toxicity.fit(texts, y)
        assert model.scores(np.array([0.0, 3.0])).tolist() == [0.0, 0.0]


def test_held_out_rows_are_not_learned_from(spark, texts_frame):
    texts, y = labelled(3, 80)
    labels = spark.createDataFrame([(10 + i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    docs = texts_frame(texts)
    held = {r[0] for r in docs.select("doc_id", toxicity.held_out().alias("h")).filter("h").collect()}
    import zlib

    assert held == {i for i in range(10, 90) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r["doc_id"] for r in toxicity.training_sample(docs, labels).collect()} == set(range(10, 90)) - held


def test_scores_come_from_texts_alone(spark, frame):
    model = toxicity.fit(*labelled(1, 300))
    text = labelled(2, 1)[0][0]
    rows = [(1, text, "en", "a", 1), (2, text, None, None, None), (3, "", "en", "a", 0), (4, None, "en", "a", 0)]
    got = toxicity.score(frame(rows), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] > 0.9
    assert by[1]["spans"] and by[1]["spans"] == by[2]["spans"]
    assert by[3]["score"] == by[4]["score"] < 0.3 and by[3]["spans"] == []


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
def test_held_out_accuracy(spark):
    labels = common.table(spark, SF, "labels").filter("toxic is not null").select("doc_id", "toxic")
    rows = toxicity.op8_toxicity(spark, SF).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    y, p, s = (np.array([r[k] for r in rows]) for k in ("toxic", "predicted", "score"))
    assert len(y) > 500 and y.sum() > 20
    recall, false = p[y == 1].mean(), p[y == 0].mean()
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    print(f"held out: {len(y)} documents, {y.sum()} toxic; recall {recall:.3f}, false alarms {false:.4f}, area {auc:.4f}")
    assert recall >= 0.9 and false < 0.02 and auc > 0.95
