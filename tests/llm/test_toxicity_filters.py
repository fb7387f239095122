"""The toxicity classifier against a plain forward pass, its slopes against differences, and word order."""

import re
import zlib

import numpy as np
import pytest

from leafspark.llm import toxicity as t


def plain_logit(model, text):
    """Word by word, window by window. Buckets come from the operator: hashes are no part of the network."""
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text or b""))
    vectors = []
    for w in words:
        v = t.vocabulary([w])
        assert len(v.pieces) == 1
        vectors.append(sum(model.embed[b].astype(float) for b in v.pieces[0]))
    logit = model.constant
    for k, width in enumerate(t.WIDTHS):
        for f in range(t.FILTERS):
            act = [max(0.0, float(x @ model.filters[:, f] + model.bias[f])) for x in vectors]
            logit += model.output[k, f] * max([sum(act[i : i + width]) for i in range(len(act))], default=0) / np.sqrt(width)
    for k, width in enumerate(t.TAPPED):
        padded = [np.zeros(t.DIMS)] * (width - 1) + vectors + [np.zeros(t.DIMS)] * (width - 1)
        for f in range(t.FILTERS):
            best = 0.0
            for i in range(len(padded) - width + 1):
                best = max(best, model.tap_bias[k, f] + sum(float(padded[i + j] @ model.taps[k][j, :, f]) for j in range(width)))
            logit += model.output[len(t.WIDTHS) + k, f] * best
    return logit


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    calm, rude = "the a nice day river walk friend book tree lake".split(), "idiot fool moron stupid".split()
    texts, labels = [], []
    for k in range(240):
        words = list(rng.choice(calm, int(rng.integers(1, 40))))
        if k % 3 == 0:
            words[int(rng.integers(len(words))) :] = ["you", str(rng.choice(rude))]
        texts.append(" ".join(words).encode())
        labels.append(int(k % 3 == 0))
    return t.train(texts, np.array(labels))


def test_equals_a_plain_forward_pass(model):
    rng = np.random.default_rng(2)
    words = "the nice You IDIOT fool, stupidly x été 北京 walk tree moronic --".split()
    texts = [" ".join(rng.choice(words, int(n))).encode() for n in rng.integers(0, 60, 60)] + [None, b"", b"...", b"idiot", b"fool " * 300]
    assert np.allclose(model.logits(texts)[0], [plain_logit(model, x) for x in texts], atol=1e-6)


def test_word_order_counts(model):
    assert model.logits([b"you idiot"])[0] != model.logits([b"idiot you"])[0]


def test_a_text_scores_alike_in_any_batch(model):
    texts = [b"you idiot", b"a nice day by the lake", b"stupid tree", None]
    alone = [model.scores([x])[0] for x in texts]
    assert list(model.scores(texts * 7 + [b"fool " * 999])[:4]) == alone


@pytest.mark.parametrize("width", t.TAPPED)
def test_slopes_equal_differences(width):
    rng = np.random.default_rng(width)
    first = np.array([0, 0, 4, 5, 12, 12])
    place = np.array([0, 1, 3, 4, 5, 8, 11])
    e, taps, bias, up = rng.normal(size=(7, 3)), rng.normal(size=(width, 3, 2)), -rng.uniform(0.05, 0.2, 2), rng.normal(size=(5, 2))
    loss = lambda: float((t._convolve(e, place, first, taps, bias)[0] * up).sum())
    _, best, at = t._convolve(e, place, first, taps, bias)
    for array, slope in zip((e, taps, bias), t._convolve_back(up, e, best, at, taps)):
        for i in np.ndindex(array.shape):
            was = array[i]
            array[i] = was + 1e-6
            more = loss()
            array[i] = was - 1e-6
            less = loss()
            array[i] = was
            assert abs((more - less) / 2e-6 - slope[i]) < 1e-5


def test_recall_and_precision_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r for r in t.classify(docs, labels).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in got and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    both = sum(p == y == 1 for p, y in held)
    assert both / sum(y == 1 for _, y in held) > 0.8 and both / sum(p == 1 for p, _ in held) > 0.8
