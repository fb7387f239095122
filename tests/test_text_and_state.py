"""Text rules, salvage of replies, recognition, state and streams: hand-made cases with boundary values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.functions import layout as L
from leafspark.functions import salvage as S
from leafspark.functions import text as T
from leafspark.operators import images as I
from leafspark.operators import ocr as O
from leafspark.operators import state as D
from leafspark.sources import documents as SRC

TICKS = "`" * 3


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("text", "wanted"), [("BOOM!", True), (" boom ", True), ("WAIT!", False), ("*boom*", True), ("~Whoosh~", True), ("KRRZT!!", True), ("KRRZT!!?", True), ("KRRZT!?!", False), ("HELLO THERE!", False), ("A!", False), ("", False), (None, False), ("OH!?", False)])
def test_sfx(spark, text, wanted):
    assert one(spark, T.is_sfx(F.col("t")), t=text) is wanted


def test_effective_text_order(spark):
    rows = [(True, "r", "t", "c", "o", "t"), (False, "r", "t", "c", "o", "r"), (True, "r", "", "c", "o", "r"), (False, "", None, "c", "o", "c"), (False, None, None, None, None, "")]
    df = spark.createDataFrame(rows, "m boolean, r string, t string, c string, o string, w string")
    assert all(x[0] == x.w for x in df.select(T.effective_text(*[F.col(k) for k in "mrtco"]), "w").collect())


@pytest.mark.parametrize(("reply", "wanted"), [('{"translation": "szia"}', "szia"), (f"ok {TICKS}json\n{{\"translation\": \"a\"}}\n{TICKS} bye", "a"), ('{"translation": "hello"}', ""), ('{"translation": "x"} junk', ""), ("", ""), ("{", ""), ('{"other": 1}', ""), (None, "")])
def test_translation_reply(spark, reply, wanted):
    assert (one(spark, S.translation(F.col("r"), F.lit("Hello")), r=reply) or "") == wanted


def test_wrap(spark):
    wrap = lambda t, w: one(spark, T.wrap(F.col("t"), w), t=t)
    assert wrap("aa bb cc", 5) == ["aa bb", "cc"]
    assert wrap("extraordinary x", 4) == ["extraordinary", "x"]
    assert wrap("  ", 4) == []
    assert one(spark, T.fix_widow(T.wrap(F.col("t"), 5)), t="aa bb cc") == ["aa", "bb cc"]


def test_outline_is_half_even(spark):
    rows = [(s,) for s in (6, 12, 16, 20, 24, 28, 40)]
    got = [r[0] for r in spark.createDataFrame(rows, "s int").select(L.outline_width(F.col("s"))).collect()]
    assert got == [3, 3, 2, 2, 2, 1, 1]


def test_largest_font(spark):
    assert spark.range(1).select(L.largest_font(lambda s: s <= 17)).first()[0] == 17
    assert spark.range(1).select(L.largest_font(lambda s: s < 0)).first()[0] == L.FONT_MIN


def test_ctc(spark):
    logits = np.full((6, 4), -5.0)
    for t, k in enumerate([1, 1, 0, 1, 3, 2]):
        logits[t, k] = 5.0
    row = spark.createDataFrame([(logits.tolist(),)], "s array<array<double>>").select(O.ctc_decode(F.col("s"), ["", "a", "b"]).alias("d")).first().d
    assert row.text == "aab"  # 3 is out of vocabulary, but ends a run
    assert 0.99 < row.confidence < 1


@pytest.mark.parametrize(("usable", "wanted"), [("0001", "0001"), ("001000", "000000"), ("0010001", "0000001"), ("111", "000")])
def test_circuit_breaker(spark, usable, wanted):
    rows = [(1, k, u == "1") for k, u in enumerate(usable)]
    got = O.circuit_breaker(spark.createDataFrame(rows, "page_id long, k int, usable boolean"), ["k"]).orderBy("k").collect()
    assert "".join(str(int(r.primary_disabled)) for r in got) == wanted


def test_closure(spark):
    found = {}
    for r in D.stage_closure(spark).collect():
        found.setdefault(r.stage, set()).add(r.downstream)
    assert found["render"] == {"composite", "export"} and len(found["layout"]) == 8 and "export" not in found
    assert all(found.get(d, set()) <= s for s in found.values() for d in s)


def test_documents_tolerate_unknown_missing_and_broken(spark):
    texts = ['{"page_id": "p", "x": 1, "bubbles": [{"bubble_id": 1, "bbox": [1, 2, 3, 4], "y": 2}, {"raw_text": "no id"}], "dirty_flags": {"ocr": false}}', "{broken", ""]
    pages = SRC.read_documents(spark.createDataFrame([(t,) for t in texts], "value string"))
    rows = SRC.bubbles_of(pages).collect()
    assert len(rows) == 1 and rows[0].tone == "neutral" and rows[0].reading_order == -1 and rows[0].bbox == [1, 2, 3, 4]
    assert {r.stage for r in SRC.dirty_flags(pages).collect()} == set(SRC.STAGES) - {"ocr"}


def test_image_scan_takes_each_name_once(spark, tmp_path):
    for name in ("b.PNG", "B.png", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = SRC.scan_images(spark, f"file://{tmp_path}").orderBy("name").collect()
    assert [r.name.lower() for r in found] in (["a.jpg", "b.png"], ["b.png", "a.jpg"])


def test_decode_keeps_files_that_fail(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x01\x02")
    (tmp_path / "b.png").write_bytes(b"bad")
    rows = SRC.decode_images(SRC.scan_images(spark, f"file://{tmp_path}"), lambda c: np.frombuffer(c, np.uint8).reshape(1, 2, 1)).collect()
    assert sorted((r.height is None) for r in rows) == [False, True]


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\n\nb\n")
    assert {(r.symbol, r.place) for r in SRC.read_vocabulary(spark, f"file://{tmp_path}/v.txt").collect()} == {("blank", 0), ("a", 1), ("b", 2)}


def test_kernels():
    mask = I.box_mask(10, 10, (2, 2, 5, 5), 1)
    assert mask.sum() == 25 * 255 and not I.box_mask(10, 10, (12, 0, 20, 5)).any()
    assert I.distance_field(mask).max() == 3
    image = np.full((10, 10), 0.25)
    assert np.allclose(I.fill(image, mask, 0.25), image) and I.is_simple(image)
    assert I.compose(image, image + 0.001)[1] and not I.compose(image, image + 0.5)[1]
    assert np.allclose(I.blend_linear(image, image, np.ones((10, 10)) * 0.5), image)
    assert I.perspective_crop(np.arange(100).reshape(10, 10), [(1, 1), (6, 1), (6, 6), (1, 6)]).shape == (5, 5)
    assert I.perspective_crop(image, [(1, 1), (3, 1), (3, 3), (1, 3)]) is None


def test_masks_and_regions():
    grey = np.full((60, 80), 250.0)
    grey[20:24, 20:50] = 10
    mask = I.text_mask(grey, (5, 5, 75, 55), 4, 2)
    assert mask[22, 30] == 255 and mask[50, 70] == 0 and not I.text_mask(grey, (90, 0, 99, 9)).any()
    assert (I.dilate(I.dilate(mask, 3), 3) >= I.dilate(mask, 3)).all() and (I.close(mask, 3) >= mask).all()
    scores = np.zeros((20, 30))
    scores[2:6, 3:9] = scores[6:8, 9:12] = 0.9  # touch at a corner
    scores[15, 20] = 0.9
    assert I.regions(scores, 0.3) == [(3, 2, 12, 8)]
    assert I.text_boxes(scores, 0.3, 2.0, 1.0, 60, 20)[0][0] < 6
    assert I.recogniser_input(np.zeros((10, 500))).shape == (48, 1200) and I.recogniser_input(np.full((96, 20), 255.0)).max() == 1.0


def test_measure_block(spark):
    widths = F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(5))
    got = spark.range(1).select(L.measure_block(F.array(F.lit("ab"), F.lit("aax")), widths, 4, F.lit(10)).alias("m")).first().m
    assert (got.width, got.height) == (10, 24)
    assert spark.range(1).select(L.measure_block(F.array().cast("array<string>"), widths, 4, F.lit(10)).alias("m")).first().m == (0, 0)
