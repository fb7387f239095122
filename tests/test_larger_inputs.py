"""Queries on inputs that the small tables don't have, against their SQL or straight-line code."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafspark import queries as core
from leafspark.functions import layout as L
from leafspark.functions import text as T
from leafspark.operators import boxes as B


def _against_sql(spark, name, folder, table):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found, wanted = entry.queries()[name](spark, str(folder)), duck.sql(core.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert sorted(map(repr, map(tuple, found.select(*wanted.columns).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_source_hash_of_long_and_missing_pages(spark, tmp_path):
    rows = [(1, "a" * 65_536), (2, "a" * 65_536 + "b"), (3, "a" * 65_536 + "c"), (4, "ő" * 40_000), (5, ""), (6, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    _against_sql(spark, "source_hash", tmp_path, "pages")


@pytest.mark.parametrize("name", ["panel_components", "reading_order", "ordered_pages"])
def test_a_page_is_brought_together_once(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_roots_do_not_depend_on_the_pairs_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 40, 2, 0, 7, 90])
    n = sizes.sum()
    x, y = rng.integers(0, 2000, n), rng.integers(0, 2000, n)
    box = {"x1": x, "y1": y, "x2": x + rng.integers(1, 90, n), "y2": y + rng.integers(1, 90, n)}
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    wanted = np.arange(n)
    for k in range(n):  # straight-line: spread the least place until nothing changes
        for j in range(n):
            for i in range(first[j], j):
                across, down = min(box["x2"][i], box["x2"][j]) - max(x[i], x[j]), min(box["y2"][i], box["y2"][j]) - max(y[i], y[j])
                if across >= -40 and down >= -40 and (across > 0 or down > 0 or min(across, down) >= -40):
                    wanted[i] = wanted[j] = min(wanted[i], wanted[j])
        if k and (wanted == before).all():
            break
        before = wanted.copy()
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(B, "PAIRS", most)
        assert (B._roots(first, box, 40, 0.05) == wanted).all()


def test_a_reply_is_cleaned_and_parsed_once_on_all_cores(spark):
    found = entry.queries()["json_salvage_visual"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("```json\\s*|") == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_wrap_and_score_of_a_long_text_take_one_pass(spark):
    words = [f"w{'x' * (k * 7 % 17)}" for k in range(20_000)]
    lines = []
    for w in words:
        if lines and len(lines[-1]) + 1 + len(w) <= 20:
            lines[-1] += " " + w
        else:
            lines.append(w)
    texts = spark.createDataFrame([(" \n".join(words),)], "t string").repartition(1)
    began = time.monotonic()
    found = texts.select(T.wrap(F.col("t"), 20).alias("l")).select("l", L.line_balance(F.col("l")).alias("b")).first()
    assert found.l == lines and 0 < found.b <= 1
    assert time.monotonic() - began < 10  # the sums of squares of 20,000 words and 12,000 lines took longer


@pytest.mark.parametrize("name", ["layout_score", "best_candidate"])
def test_candidates_are_scored_on_all_cores(spark, name):
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
