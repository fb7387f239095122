"""The n-gram join against all pairs, on texts with copies, near copies at the threshold, chains and odd cases."""

import random
import re

import numpy as np
import pytest

from leafspark.llm import ngram_join as J


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [sets_of(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and den * k >= num * (len(a) + len(sets[j]) - k):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted((d if d is not None else -1, len(s), -1 if (c := least[root(i)] if s else d) is None else c) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def texts(seed, n_docs=160):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared, rows = make(40), []
    while len(rows) < n_docs:
        base = make(rng.choice([1, 2, 3, 4, 5, 7, 12, 30, 60, 200, 400]))
        if rng.random() < 0.3:
            base = base[: len(base) // 2] + shared + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                i = rng.randrange(len(t))
                if rng.random() < 0.5:
                    t[i] = rng.choice(vocabulary)
                elif len(t) > 1:
                    del t[i]
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (1, 50, 100, 3)])
def test_equals_all_pairs(spark, n, num, den, seed, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "RUN", 3)
    rows = texts(seed)
    got = J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, num, den)


def test_odd_cases(odd, odd_rows):
    got = J.ngram_join(odd).collect()
    null = lambda x: -1 if x is None else x
    assert sorted((null(r.doc_id), r.n_shingles, null(r.component_id)) for r in got) == brute([r[:2] for r in odd_rows], 3, 90, 100)


def test_empty_table(none):
    assert J.ngram_join(none).count() == 0


def test_tokens_of_linked_sets_meet():
    """The argument behind the tokens, on random sets at the very threshold."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        num, den = ((90, 100), (80, 100))[rng.integers(2)]
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, size, np.uint64))
        b, k = a.copy(), 0
        while True:
            c = b.copy()
            if rng.random() < 0.5 and len(c) > 1:
                c = np.delete(c, rng.integers(len(c)))
            else:
                c = np.unique(np.append(c, rng.integers(0, 2**63, 1, np.uint64)))
            if not J.linked(a, c, num, den) or k > 200:
                break
            b, k = c, k + 1
        x, y = (set(np.concatenate(J.tokens_of(s, num, den)).tolist()) for s in (a, b))
        assert x & y
        w = min(J.bitmap_bits(J.band_of(len(s))) for s in (a, b)) // 64
        bits = [J._fold(J.bitmap(s, J.bitmap_bits(J.band_of(len(s))))[None], w)[0] for s in (a, b)]
        assert J.may_link(np.int64(len(a)), bits[0], np.int64(len(b)), bits[1], num, den)[0]
