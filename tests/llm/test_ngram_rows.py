"""The n-gram join where ids are missing or stand for several texts."""

import pytest
from test_ngram_join import brute

from leafspark.llm import ngram_join as J

SCHEMA = "doc_id long, text string"


def words(name, k, without=()):
    return " ".join(f"{name}{i}" for i in range(k) if i not in without)


#: A chain whose middle has no id; near copies that have none at all; an id with two texts, each with a near copy of
#: its own; the same row twice; and copies that only rows without id have.
ROWS = [
    (1, words("a", 100)), (None, words("a", 100, [0, 1, 2, 3])), (2, words("a", 100, range(8))),
    (None, words("b", 80)), (None, words("b", 80, [0])), (None, words("b", 80, [0])),
    (10, words("c", 60)), (10, words("d", 60)), (11, words("c", 60, [0])), (12, words("d", 60, [59])),
    (10, words("e", 60)), (20, words("f", 50)), (20, words("f", 50)), (None, words("g", 40)),
]


@pytest.mark.parametrize("turned", [False, True])
def test_rows_without_id_and_ids_of_two_texts(spark, turned):
    rows = ROWS[::-1] if turned else ROWS
    got = J.ngram_join(spark.createDataFrame(rows, SCHEMA), 3, 94, 100).collect()
    null = lambda x: -1 if x is None else x
    assert sorted((null(r.doc_id), r.n_shingles, null(r.component_id)) for r in got) == brute(rows, 3, 94, 100)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 11, 12)} == {(1, 1), (2, 1), (11, 10), (12, 10)}


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([*ROWS, (30, ""), (30, None), (None, " ")], SCHEMA), "").collect()
    words_of = lambda t: (t or "").split(" ")[0][:1]
    assert sorted((-1 if r.doc_id is None else r.doc_id, words_of(r.text)) for r in kept) == [(-1, ""), (-1, "b"), (-1, "g"), (1, "a"), (10, "c"), (10, "d"), (10, "e"), (20, "f"), (30, ""), (30, "")]
