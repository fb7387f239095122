"""Links inside components against all pairs."""

import pytest
from test_ngram_join import sets_of, texts
from test_ngram_rows import ROWS, SCHEMA

from leafspark.llm import ngram_join as J

CHAIN = [(k, " ".join(f"a{i}" for i in range(100) if i >= 4 * k)) for k in range(5)] + [(9, " ".join(f"a{i}" for i in range(4, 100)))]


def linked_rows(rows, n, num, den):
    sets = [sets_of(t, n) for _, t in rows]
    both = lambda a, b: len(a & b)
    return sets, [[bool(a and b) and den * both(a, b) >= num * (len(a) + len(b) - both(a, b)) for b in sets] for a in sets]


@pytest.mark.parametrize(("rows", "n", "num"), [(CHAIN, 3, 94), (ROWS, 3, 94), (texts(4), 3, 90), (texts(5, 100), 1, 50)])
def test_links_equal_all_pairs(spark, rows, n, num, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "_COLUMNS", 16)
    null = lambda x: -1 if x is None else x
    sets, ok = linked_rows(rows, n, num, 100)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = J.ngram_join(docs, n, num, 100, links=True).collect()
    assert sorted((null(r.doc_id), r.n_shingles, r.n_links) for r in got) == sorted((null(d), len(s), max(sum(x) - 1, 0)) for (d, _), s, x in zip(rows, sets, ok))
    of = {}
    for (d, _), s in sorted(zip(rows, sets), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        of.setdefault(frozenset(s), d)
    wanted = {(*sorted((null(of[frozenset(sets[i])]), null(of[frozenset(sets[j])]))), len(sets[i] & sets[j])): 1 for i in range(len(rows)) for j in range(i) if ok[i][j] and sets[i] != sets[j]}
    pairs = [(*sorted((null(r.a_id), null(r.b_id))), r.n_common) for r in J.ngram_links(docs, n, num, 100).collect()]
    assert sorted(pairs) == sorted(wanted)
