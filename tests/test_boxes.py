"""Box operators against straight-line code written from the rules, on random pages with ties, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from leafspark.functions import geometry as G
from leafspark.operators import boxes as B

SCHEMA = "page_id long, bubble_id long, x1 int, y1 int, x2 int, y2 int, conf double"


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def inter(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def share(a, b):
    return inter(a, b) / max(min(area(a), area(b)), 1)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    rows = [(0, 0, 5, 5, 30, 30, 0.5), (1, 0, 0, 0, 40, 40, 0.9), (1, 1, 0, 0, 40, 40, 0.9)]
    for p in range(2, 40):
        for k in range(rng.randrange(1, 12)):
            x, y = rng.randrange(0, 300, 10), rng.randrange(0, 300, 10)
            rows.append((p, k, x, y, x + rng.randrange(10, 120, 10), y + rng.randrange(10, 120, 10), rng.choice([0.3, 0.5, 0.9])))
    return rows


def by_page(rows):
    out = {}
    for p, k, *rest in rows:
        out.setdefault(p, []).append((k, tuple(rest[:4]), rest[4]))
    return out


def test_suppression(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA)
    for standard in (False, True):
        wanted = set()
        for p, items in by_page(pages).items():
            kept = []
            for k, b, _ in sorted(items, key=lambda i: (-i[2], i[0])):
                if not any((standard or j < k) and inter(a, b) / max(area(a) + area(b) - inter(a, b), 1) > 0.4 for j, a in kept):
                    kept.append((k, b))
            wanted |= {(p, k) for k, _ in kept}
        assert {tuple(r) for r in B.suppress(df, standard=standard).collect()} == wanted


def test_panels(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA)
    wanted = set()
    for p, items in by_page(pages).items():
        label = {k: k for k, _, _ in items}
        changed = True
        while changed:
            changed = False
            for i, a, _ in items:
                for j, b, _ in items:
                    hg, vg = max(0, max(a[0], b[0]) - min(a[2], b[2])), max(0, max(a[1], b[1]) - min(a[3], b[3]))
                    near = share(a, b) > 0.05 or (min(a[2], b[2]) > max(a[0], b[0]) and vg <= 12) or (min(a[3], b[3]) > max(a[1], b[1]) and hg <= 12) or (hg <= 12 and vg <= 12)
                    if i != j and near and label[i] != label[j]:
                        label[i] = label[j] = min(label[i], label[j])
                        changed = True
        wanted |= {(p, k, v) for k, v in label.items()}
    assert {tuple(r) for r in B.panels(df, 320, 300).collect()} == wanted


def test_neighbours_are_symmetric(spark, pages):
    found = {(r.page_id, r.bubble_id): r.overlap_ids for r in B.overlap_neighbours(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert len(found) == len(pages)
    assert all(k in found[p, j] for (p, k), ids in found.items() for j in ids)


def test_reading_order_numbers_every_box_once(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA)
    rows = B.reading_order(df, B.panels(df, 320, 300)).collect()
    for p, items in by_page(pages).items():
        assert sorted(r.reading_order for r in rows if r.page_id == p) == list(range(len(items)))


def test_order_does_not_depend_on_row_order(spark, pages):
    shuffled = random.Random(1).sample(pages, len(pages))
    a, b = ({tuple(r) for r in B.line_groups(spark.createDataFrame(x, SCHEMA).withColumn("line_height", F.lit(20.0))).collect()} for x in (pages, shuffled))
    assert a == b


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert B.page_overlap_stats(empty).count() == B.suppress(empty).count() == B.panels(empty, 10, 10).count() == B.reading_order_fallback(empty).count() == 0


@pytest.mark.parametrize(("box", "wanted"), [((2.2, 3.7, 40.1, 50.9), (2, 3, 41, 51)), ((-5, -5, 1, 1), (0, 0, 8, 8)), ((95, 95, 99, 99), (91, 91, 99, 99)), ((120, 0, 130, 20), (92, 0, 100, 20))])
def test_clip(spark, box, wanted):
    df = spark.createDataFrame([tuple(map(float, box))], "a double, b double, c double, d double")
    assert tuple(df.select(*G.clip_box(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 100, 100)).first()) == wanted
