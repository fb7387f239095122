"""Options, providers and incremental runs."""

from pyspark.sql import functions as F

from leafspark import config as C
from leafspark import providers as P
from leafspark.operators import state as D
from leafspark.plans import incremental as N
from leafspark.streaming.breaker import breaker


def test_options():
    o, bad = C.from_environment(C.Options(), {"LEAFSPARK_RUN_FORCE": "off", "LEAFSPARK_LAYOUT_IOU": "0", "LEAFSPARK_RENDER_FONT_MIN": "x", "LEAFSPARK_RUN_SKIP": "ocr,render", "OTHER": "1"})
    assert o.run.force is False and o.layout.iou == 0.0 and o.run.skip == ("ocr", "render") and bad == ["LEAFSPARK_RENDER_FONT_MIN"]
    assert C.override(C.Options(), {"run": {"force": "yes", "nothing": 1}}).run.force is True
    assert C.fingerprint(C.Options()) == C.fingerprint(C.Options()) != C.fingerprint(o)


def test_lifecycle_and_pool():
    calls = []
    registry = P.Registry()
    registry.register("broken", lambda: P.Provider("broken", load=lambda: 1 / 0))
    registry.register("flaky", lambda: P.Provider("flaky", call=lambda m, t: calls.append(t) or 1 / (len(calls) - 1), retries=1))
    pool = P.Pool(registry)
    p = pool.acquire("broken", "flaky")
    assert p.provider_id == "flaky" and p.run("x").success and len(calls) == 2 and p.status == P.READY
    p.stop()
    assert not p.run("x").success and pool.acquire("broken") is None


def test_apply_skips_fails_and_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "d")], "id long, t string")
    rows = {r.id: r.result for r in P.apply(df, "t", ["chat", "local"], F.col("id") < 4).collect()}
    assert rows[1].data == "A" and rows[1].provider_id == "local" and rows[2].skipped and rows[3].skipped and rows[4].skipped and rows[4].provider_id == ""
    assert not any(r.result.success for r in P.apply(df, "t", ["chat"]).where("t IS NOT NULL").collect())


def test_incremental_run(spark):
    key = "page_id string, hash string"
    sources = spark.createDataFrame([("new", "1"), ("same", "2"), ("changed", "4"), ("idle", "5")], key)
    state = spark.createDataFrame([("same", "2"), ("changed", "3"), ("gone", "9"), ("idle", "5")], key)
    flags = spark.createDataFrame([("same", "render"), ("gone", "ocr")], "page_id string, stage string")
    todo = N.plan(spark, sources, state, flags)
    by = {}
    for r in todo.collect():
        by.setdefault(r.page_id, set()).add(r.stage)
    assert by == {"new": set(D.STAGES), "changed": set(D.STAGES), "same": {"render", "composite", "export"}}
    o = C.override(C.Options(), {"run": {"force": True, "skip": ("ocr",)}})
    assert N.plan(spark, sources, state, flags, o).count() == 4 * 8
    out = spark.createDataFrame([("same", "render", True, 5, None), ("same", "composite", False, 1, "boom"), ("new", "layout", False, 1, "boom")], "page_id string, stage string, ok boolean, ms long, error string")
    run = N.ledger(todo, out)
    left = {tuple(r) for r in N.flags_after(flags, run).collect()}
    assert ("same", "render") not in left and ("same", "composite") in left and ("gone", "ocr") in left
    m = N.manifest(run, spark.createDataFrame([("same",), ("same",)], "page_id string")).first()
    assert (m.total, m.failed, m.partial, m.skipped, m.success, m.bubbles, m.exit_code) == (3, 1, 1, 1, 0, 2, 1)


def test_rerender_clears_one_hash(spark):
    b = spark.createDataFrame([("p", 1, "h"), ("p", 2, "h"), ("q", 1, "h")], "page_id string, bubble_id long, render_hash string")
    assert {(r.page_id, r.bubble_id) for r in N.rerender(b, "p", 1).where("render_hash = ''").collect()} == {("p", 1)}


def test_streamed_breaker_equals_the_batch_one(spark, tmp_path):
    rows = [(p, k, (p * 7 + k * 5) % 4 == 0) for p in range(3) for k in range(12)]
    spark.createDataFrame(rows, "page_id long, event_id long, usable boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("page_id long, event_id long, usable boolean").parquet(f"{tmp_path}/in")
    job = breaker(stream).writeStream.outputMode("append").format("memory").queryName("breaker_out").trigger(availableNow=True).start()
    job.awaitTermination()
    from leafspark.operators.ocr import circuit_breaker

    batch = circuit_breaker(spark.createDataFrame(rows, "page_id long, event_id long, usable boolean"), ["event_id"])
    assert {tuple(r) for r in spark.table("breaker_out").collect()} == {(r.page_id, r.event_id, r.primary_disabled) for r in batch.collect()}
