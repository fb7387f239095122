"""Decontamination, encoding, licences, media, toxicity and scoring against plain versions, and odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafspark.llm import bpe, decontaminate, licenses, lm_score, media, toxicity, webp, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def word_list(t):
    return WORD.findall(low(t))


def sample(spark, k=60):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(k).collect()]


def test_words_equal_regular_expressions(odd_rows):
    texts = [r[1] for r in odd_rows] * 2
    for kind, pattern in ((words.ALPHANUMERIC, WORD), (words.NON_SPACE, re.compile(r"[^\x20\x09-\x0D]+"))):
        w = words.scan([t.encode() if t is not None else None for t in texts], kind)
        assert w.counts().tolist() == [len(pattern.findall(low(t))) for t in texts]
        seen = {}
        for t, a in zip(texts, w.first):
            for k, x in enumerate(pattern.findall(low(t))):
                assert seen.setdefault(x, w.hashes[a + k]) == w.hashes[a + k]
        assert len(set(seen.values())) == len(seen)


def test_blocks_of_any_size_give_the_same_words(monkeypatch):
    text = ("lorem ipsum, dolor " * 50 + "y" * 700).encode()
    whole = words.scan([text, b"", text], words.ALPHANUMERIC)
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    cut = words.scan([text, b"", text], words.ALPHANUMERIC)
    assert (whole.hashes == cut.hashes).all() and (whole.first == cut.first).all()


# Decontamination


def brute_hits(text, items, window):
    w, hit, found = word_list(text), set(), set()
    for i, t in items:
        p = word_list(t)
        m = min(window, len(p))
        wins = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m else set()
        at = [k for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in wins] if m else []
        hit |= {k + j for k in at for j in range(m)}
        if at and i is not None:
            found.add(i)
    names = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_decontamination(spark, odd_rows, pass_bytes, monkeypatch):
    items = [(1, "over the lazy dog near the old river bank today and more"), (2, "ONE"), (3, None), (4, ""), (10, "word word word word word word word word word word word"), (None, "lost text"), (10, "quick brown"), (2, "one"), (7, "…!")]
    rows = [(r[0], r[1]) for r in odd_rows] + sample(spark, 20) + [(99, "a one. The QUICK, brown-fox jumps over the lazy dog near the old river bank!")]
    b = spark.createDataFrame(items, "item_id long, text string")
    original = decontaminate.find_benchmark
    monkeypatch.setattr(decontaminate, "find_benchmark", lambda d, x, w: original(d, x, w, pass_bytes=pass_bytes))
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()
    wanted = Counter((d, *brute_hits(t, items, 10)) for d, t in rows)
    assert Counter(tuple(r) for r in got) == wanted


def test_decontamination_keeps_clashing_columns_and_empty_tables(spark, odd, none):
    b = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.find_benchmark(odd, b).select("spans", "n_words").first() == ("clash", "clash")
    assert decontaminate.decontaminate(none, b).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd, b.limit(0)).collect())


# Encoding


def test_encoding_equals_the_library(spark, odd_rows):
    t = Tokenizer.from_file(PATH)
    rows = [(r[0], r[1]) for r in odd_rows] + sample(spark) + [(50, "a<|endoftext|>B <|startoftext|>"), (51, "ΣΑΣ İ e\u0301 'll'LL 12½ \x85\u2028")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    wanted = set()
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        wanted.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == wanted


def test_cuts_are_certain():
    codec = bpe.Codec(open(PATH, encoding="utf-8").read(), memory=50)  # memory is dropped again and again
    t = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(2)
    cut = 0
    for _ in range(300):
        word = "".join(chr(int(c)) for c in rng.choice([*range(97, 123), 0xDF, 0xE9, 0x416, 0x4E2D], 12))
        cut += len(codec.cut(word.encode())) > 1
        assert codec.encode(word) == t.encode(word, add_special_tokens=False).ids
    assert cut > 50


def test_encoding_of_odd_tables(odd, none):
    assert bpe.round_trip(none, PATH).count() == 0
    assert bpe.round_trip(odd, PATH).where("doc_id = 3").first().n_tokens == 0
    assert odd.where("doc_id = 6").select(bpe.encoded(odd, PATH)).first()[0] == Tokenizer.from_file(PATH).encode("one").ids


# Licences


def test_base_phrases(spark, odd, odd_rows):
    got = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    for d, t, *_ in odd_rows:
        w, places, labels = word_list(t), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r.labels.split(","))) >= labels and 0 <= r.score <= 1
    assert got[11].labels == "cc-by,cc-by-4.0,mit,reserved"


def test_every_rule_needs_its_keywords():
    """A text that a rule fits has one of its keywords as a word: the prefilter loses nothing."""
    assert len(licenses.rules()) > 300
    texts = ["SPDX-License-Identifier: GPL-3.0", "GNU Lesser General Public License v2.1", "Apache License 2.0", "Creative Commons Attribution-ShareAlike 4.0", "the 3-clause BSD license", "CC BY-NC 4.0", "Redistribution and use in source and binary forms"]
    for t in map(str.lower, texts):
        by_gate = {i for i, r in enumerate(licenses.rules()) if set(r.keywords) & set(word_list(t))}
        for i, r in enumerate(licenses.rules()):
            if r.find.search(t):
                assert i in by_gate, (t, r)


def test_suppression_of_contained_detections():
    found = [(0, 10, 0), (2, 5, 1), (3, 12, 1), (0, 20, 2), (11, 12, 2), (0, 10, 3)]
    priority = [1, 2, 3, 1]
    kept = [found[i] for i in licenses.suppress(found, priority)]
    brute = [f for i, f in enumerate(found) if not any(j != i and g[0] <= f[0] and f[1] <= g[1] and (priority[g[2]] < priority[f[2]] or (priority[g[2]] == priority[f[2]] and (g[1] - g[0] > f[1] - f[0] or (g[:2] == f[:2] and g[2] < f[2])))) for j, g in enumerate(found))]
    assert kept == brute


# Media


def test_webp_round_trips():
    rng = np.random.default_rng(1)
    for k in range(8):
        h, w = rng.integers(1, 40, 2)
        p = rng.integers(0, 2**32, (h, w), dtype=np.uint64).astype(np.uint32)
        if k % 2:
            p = (p[:, :1] & np.uint32(0x0F0F0F0F)) | np.zeros((h, w), np.uint32)
        shape = ((h + 7) // 8, (w + 7) // 8)
        modes, elements = rng.integers(0, 14, shape), rng.integers(0, 2**32, shape, dtype=np.uint64).astype(np.uint32)
        for transforms in ((), (0,), (1,), (2,), (0, 1), (0, 1, 2), (2, 0), (3,), (0, 1, 2, 3)):
            for cache in (0, 1, 6):
                assert (webp.decode(webp.encode(p, transforms, cache, modes=modes, elements=elements)) == p).all()
    for colors in (1, 2, 3, 4, 5, 16, 17, 256):
        p = rng.integers(0, colors, (30, 50)).astype(np.uint32) * np.uint32(0x10101) | np.uint32(0xFF000000)
        assert (webp.decode(webp.encode(p, cache_bits=4)) == p).all()


def test_webp_rejects_damage():
    good = webp.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for bad in (b"", good[:20], b"RIFF" + good[4:8] + b"WAVE" + good[12:]):
        with pytest.raises((ValueError, IndexError, Exception)):  # noqa: B017
            webp.decode(bad)


def test_media(odd, odd_rows, none):
    got = {r.doc_id: r for r in media.media_features(odd).collect()}
    for d, t, *_ in odd_rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[3].media_sha256 == got[4].media_sha256 and got[1].media_sha256 == got[2].media_sha256
    stored = odd.where("doc_id = 8").select(media.stored(odd["text"])).first()[0]
    assert media.from_image(webp.decode(bytes(stored))).startswith(b"word word")
    assert media.media_features(none).count() == 0


def test_payload_beyond_the_tallest_image(monkeypatch):
    monkeypatch.setattr(media, "MAX_SIDE", 4)
    payload = bytes(range(192)) * 11
    assert media.from_image(webp.decode(media.store(payload))) == payload


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    pairs = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in got]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r, _ in pairs)
    held = [(r.predicted, y) for r, y in pairs if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_toxicity_without_labels_and_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(odd, labels).count() == 13
    assert toxicity.classify(none, labels).count() == 0


def test_equal_texts_get_equal_scores(odd):
    model = toxicity.train([b"you idiot fool", b"a nice day"] * 30, np.array([1, 0] * 30))
    s = model.scores([b"you idiot", b"a day", b"you idiot", None, b""])
    assert s[0] == s[2] > 0.7 > s[1] and s[3] == s[4]


# Scoring


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_counts(spark, odd_rows, order):
    rows = [(k, r[1][:5000] if r[1] else r[1]) for k, r in enumerate(odd_rows)] + [(100 + d, t) for d, t in sample(spark, 40)]
    texts = {d: word_list(t) for d, t in rows}
    own = {d: Counter(tuple(w[a : a + k]) for k in range(1, order + 1) for a in range(len(w) - k + 1)) for d, w in texts.items()}
    total = sum(own.values(), Counter())
    n = sum(map(len, texts.values()))
    got = {r.doc_id: r for r in lm_score.score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), order, chunk_bytes=20_000).collect()}
    for d, w in texts.items():
        c, s = (lambda g: total[g] - own[d][g]), 0.0
        for a in range(len(w)):
            longest = min(a, order - 1)
            for k in range(longest, -1, -1):
                g = tuple(w[a - k : a + 1])
                if k == 0:
                    s += math.log(max(c(g), 0.5) / max(1, n - len(w))) + longest * math.log(0.4)
                elif c(g) > 0:
                    s += math.log(c(g) / max(c(g[:-1]), c(g))) + (longest - k) * math.log(0.4)
                    break
        assert got[d].n_words == len(w) and got[d].log_score == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert (got[d].perplexity is None) == (not w)


def test_scoring_an_empty_table(none):
    assert lm_score.score_corpus(none).count() == 0
