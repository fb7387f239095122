"""The registered scores look at more than pairs of words."""

import re

import numpy as np

from leafspark.llm import lm_score
from leafspark.llm.queries import op3_lm_scoring


def test_texts_fluent_in_pairs_only_score_lower(spark, tmp_path):
    """Both last texts have pairs of words that others have equally often; only the first has their triples, too."""
    others = ["a b c", "a b c", "x b y", "x b y", "a b c x b y"] * 4
    spark.createDataFrame(list(enumerate([*others, "a b c", "a b y"])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.mean_log_score for r in op3_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[len(others)] - got[len(others) + 1] > 0.25


def brute(texts, order):
    """Mean log score of each text under the counts of all others, from whole strings."""
    from collections import Counter
    from math import log

    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in words]
    every = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    out = []
    for w, own in zip(words, grams):
        others = max(sum(map(len, words)) - len(w), 1)
        rest = lambda g, own=own: every[len(g) - 1][g] - own[len(g) - 1][g]
        total = 0.0
        for i in range(len(w)):
            longest = min(i, order - 1)
            k = next((k for k in range(longest, 0, -1) if rest(tuple(w[i - k : i + 1]))), 0)
            share = rest(tuple(w[i - k : i + 1])) / max(rest(tuple(w[i - k : i])), rest(tuple(w[i - k : i + 1]))) if k else max(rest((w[i],)), 0.5) / others
            total += log(share) + (longest - k) * log(0.4)
        out.append((len(w), round(total, 6)))
    return out


def test_whole_long_texts_null_and_repeated_ids(odd, odd_rows):
    """Several chunks and partitions; columns with clashing names."""
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.score_corpus(odd, 3, chunk_bytes=200, part_words=1500).collect())
    wanted = sorted((-1 if r[0] is None else r[0], *b) for r, b in zip(odd_rows, brute([r[1] for r in odd_rows], 3)))
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert all(abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2])) for g, w in zip(got, wanted))


def test_counts_and_hashes_survive_packing():
    rng = np.random.default_rng(3)
    for many in (0, 1, 5, 4000):
        h = np.unique(rng.integers(1, 1 << 56, many).astype(np.uint64))
        c = rng.integers(1, 600, len(h))
        assert (lm_score.unpack(lm_score.pack(h)) == h).all() and (lm_score.unpack_counts(lm_score.pack_counts(c), len(c)) == c).all()
