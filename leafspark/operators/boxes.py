"""Operators on the boxes of pages: frames of page_id, bubble_id, x1, y1, x2, y2 and, for suppression, conf.

A page has a bounded number of boxes, so pairs are made within a page only: by an equi-join on page_id, or by folding
the page's sorted array where the semantics are sequential. All of it stays in the JVM but the panels, whose components
are found for many pages at once by an Arrow function in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.functions import geometry as G
from leafspark.functions.bind import bound

BOX = ("x1", "y1", "x2", "y2")


def box_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in BOX])


def pairs(boxes: DataFrame) -> DataFrame:
    """(page_id, a, b) for boxes a.bubble_id < b.bubble_id of one page that share area; a and b are structs.

    The join is on the page; the residual drops pairs that are apart before anything else is computed."""
    side = lambda c: boxes.select("page_id", F.struct("bubble_id", *BOX).alias(c))
    a, b = F.col("a"), F.col("b")
    meets = (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])
    return side("a").join(side("b"), "page_id").where((a["bubble_id"] < b["bubble_id"]) & meets)


def overlap_pairs(boxes: DataFrame, threshold: float = 0.08) -> DataFrame:
    """(page_id, i, j) with an overlap ratio above the threshold, i < j."""
    return pairs(boxes).where(G.overlap_ratio(F.col("a"), F.col("b")) > threshold).select("page_id", F.col("a.bubble_id").alias("i"), F.col("b.bubble_id").alias("j"))


def overlap_neighbours(boxes: DataFrame, threshold: float = 0.08) -> DataFrame:
    """For every box the sorted ids of the boxes that it overlaps; empty where there is none."""
    found = overlap_pairs(boxes, threshold)
    both = found.union(found.select("page_id", F.col("j").alias("i"), F.col("i").alias("j")))
    lists = both.groupBy("page_id", F.col("i").alias("bubble_id")).agg(F.array_sort(F.collect_list("j")).alias("overlap_ids"))
    return boxes.select("page_id", "bubble_id").join(lists, ["page_id", "bubble_id"], "left").select("page_id", "bubble_id", F.coalesce("overlap_ids", F.array().cast("array<bigint>")).alias("overlap_ids"))


def page_overlap_stats(boxes: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Per page: boxes, overlapping pairs, boxes with a neighbour, the enclosing box, and confidence in thousandths."""
    found = overlap_pairs(boxes, threshold)
    per = found.groupBy("page_id").agg(F.count("*").alias("n_pairs"), F.size(F.array_union(F.collect_set("i"), F.collect_set("j"))).cast("long").alias("n_touching"))
    stats = boxes.groupBy("page_id").agg(F.count("*").alias("n_boxes"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum(F.round(F.col("conf") * 1000).cast("long")).alias("conf_milli"))
    return stats.join(per, "page_id", "left").select("page_id", "n_boxes", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), F.coalesce("n_touching", F.lit(0)).cast("long").alias("n_touching"), *BOX, "conf_milli")


def _page_array(boxes: DataFrame, *fields: Column | str) -> DataFrame:
    return boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("boxes"))


def _kept_arrays(boxes: DataFrame, threshold: float, standard: bool) -> DataFrame:
    """(page_id, kept): the boxes that greedy suppression keeps, by falling confidence."""
    arrays = _page_array(boxes, (-F.col("conf")).alias("rank"), "bubble_id", *BOX)
    kind = "array<struct<rank:double,bubble_id:bigint,x1:int,y1:int,x2:int,y2:int>>"

    def step(kept: Column, b: Column) -> Column:
        hit = lambda k: (G.iou(k, b) > threshold) & (F.lit(True) if standard else k["bubble_id"] < b["bubble_id"])
        return F.when(F.exists(kept, hit), kept).otherwise(F.concat(kept, F.array(b)))

    return arrays.select("page_id", F.aggregate(F.col("boxes").cast(kind), F.array().cast(kind), step).alias("kept"))


def suppress(boxes: DataFrame, threshold: float = 0.40, standard: bool = False) -> DataFrame:
    """(page_id, bubble_id) of boxes that greedy suppression keeps, by falling confidence, ties by id.

    As coded in the original semantics a box only suppresses boxes of a larger id; standard=True drops that."""
    return _kept_arrays(boxes, threshold, standard).select("page_id", F.explode("kept").alias("b")).select("page_id", "b.bubble_id")


def overlap_groups(boxes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(page_id, leader, members): ids in order each lead a group of later unused boxes that overlap the leader itself;
    groups of one are dropped."""
    arrays = _page_array(boxes, "bubble_id", *BOX)
    kind = "struct<used:array<bigint>,groups:array<array<bigint>>>"

    def step(acc: Column, b: Column, every: Column) -> Column:
        free = lambda o: (o["bubble_id"] > b["bubble_id"]) & ~F.array_contains(acc["used"], o["bubble_id"]) & (G.overlap_ratio(b, o) > threshold)
        mine = F.transform(F.filter(every, free), lambda o: o["bubble_id"])
        new = F.struct(F.concat(acc["used"], F.array(b["bubble_id"]), mine).alias("used"), F.concat(acc["groups"], F.array(F.concat(F.array(b["bubble_id"]), mine))).alias("groups"))
        return F.when(F.array_contains(acc["used"], b["bubble_id"]) | (F.size(mine) == 0), acc).otherwise(new)

    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<array<bigint>>").alias("groups")).cast(kind)
    found = F.aggregate("boxes", start, lambda acc, b: step(acc, b, F.col("boxes")))["groups"]
    return arrays.select("page_id", F.explode(found).alias("members")).select("page_id", F.col("members")[0].alias("leader"), "members")


#: Pairs of boxes that are compared at once, and what is known of a page's panels.
PAIRS = 1 << 20
_ITEM = "struct<bubble_id:bigint,x1:int,y1:int,x2:int,y2:int>"
_PANELS = f"array<struct<panel:bigint,x1:int,y1:int,x2:int,y2:int,items:array<{_ITEM}>>>"


def _roots(first: np.ndarray, box: dict[str, np.ndarray], gap_px: int, least_overlap: float) -> np.ndarray:
    """The least place of a box's component, for boxes in a row whose pages begin at the places `first`."""
    place = np.arange(len(first))
    label, earlier, done = place.copy(), place - first, np.zeros(len(first) + 1, np.int64)
    np.cumsum(earlier, out=done[1:])
    start = 0
    while start < len(first):
        stop = max(int(np.searchsorted(done, done[start] + PAIRS, "right")) - 1, start + 1)
        j = np.repeat(place[start:stop], earlier[start:stop])
        i = np.arange(len(j)) - np.repeat(done[start:stop] - done[start] - first[start:stop], earlier[start:stop])
        a, b = {c: v[i] for c, v in box.items()}, {c: v[j] for c, v in box.items()}
        across, down = np.minimum(a["x2"], b["x2"]) - np.maximum(a["x1"], b["x1"]), np.minimum(a["y2"], b["y2"]) - np.maximum(a["y1"], b["y1"])
        area = lambda o: (o["x2"] - o["x1"]) * (o["y2"] - o["y1"])
        shared, smaller = np.maximum(across, 0) * np.maximum(down, 0), np.maximum(np.minimum(area(a), area(b)), 1)
        near_x, near_y = -across <= gap_px, -down <= gap_px
        meet = (shared / smaller > least_overlap) | ((across > 0) & near_y) | ((down > 0) & near_x) | (near_x & near_y)
        i, j = i[meet], j[meet]
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label = label[label]
        start = stop
    return label


def _panel_lists(pages: pa.Array, gap_px: int, least_overlap: float) -> pa.Array:
    """The panels of arrays of boxes in the order of ids, by the centre of their enclosing box, then by name."""
    sizes, flat = pages.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), pages.flatten()
    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
    box = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in BOX}
    root = _roots(np.repeat(np.cumsum(sizes) - sizes, sizes), box, gap_px, least_overlap)
    members = np.argsort(root, kind="stable")
    starts = np.flatnonzero(np.diff(root[members], prepend=-1))
    n, top = np.diff(starts, append=len(root)), root[members][starts]
    around = {c: (np.minimum if c[1] == "1" else np.maximum).reduceat(box[c][members], starts) if len(starts) else starts for c in BOX}
    page = np.repeat(np.arange(len(sizes)), sizes)[top]
    rank = np.lexsort((top, around["x1"] + around["x2"], around["y1"] + around["y2"], page))
    n, top = n[rank], top[rank]
    taken = members[np.arange(len(root)) + np.repeat(starts[rank] - (np.cumsum(n) - n), n)]
    columns = [flat.field("bubble_id").take(pa.array(top)), *[pa.array(around[c][rank], pa.int32()) for c in BOX], lists(n, flat.take(pa.array(taken)))]
    return lists(np.bincount(page, minlength=len(sizes)), pa.StructArray.from_arrays(columns, ["panel", *BOX, "items"]))


def _panel_arrays(arrays: DataFrame, page_width: int, page_height: int, ratio: float, least_overlap: float) -> DataFrame:
    """(page_id, ps) of page arrays in the order of ids: each page's panels with their boxes."""
    gap_px = max(int(min(page_width, page_height) * ratio), 8)

    def grouped(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _panel_lists(batch.column(1), gap_px, least_overlap)], ["page_id", "ps"])

    listed = arrays.select("page_id", F.col("boxes").cast(f"array<{_ITEM}>").alias("boxes"))
    return listed.mapInArrow(grouped, f"page_id {listed.schema['page_id'].dataType.simpleString()}, ps {_PANELS}")


def panels(boxes: DataFrame, page_width: int, page_height: int, ratio: float = 0.04, least_overlap: float = 0.05) -> DataFrame:
    """(page_id, bubble_id, panel): connected components of adjacent boxes; panel is the smallest id in it."""
    listed = _panel_arrays(_page_array(boxes, "bubble_id", *BOX), page_width, page_height, ratio, least_overlap)
    each = F.flatten(F.transform("ps", lambda p: F.transform(p["items"], lambda b: F.struct(b["bubble_id"].alias("id"), p["panel"].alias("panel")))))
    return listed.select("page_id", F.explode(each).alias("z")).select("page_id", F.col("z.id").alias("bubble_id"), F.col("z.panel").alias("panel"))


def panel_boxes(boxes: DataFrame, page_width: int, page_height: int, ratio: float = 0.04, least_overlap: float = 0.05) -> DataFrame:
    """(page_id, panel, n, x1, y1, x2, y2): the panels with their numbers of boxes and enclosing boxes."""
    listed = _panel_arrays(_page_array(boxes, "bubble_id", *BOX), page_width, page_height, ratio, least_overlap)
    return listed.select("page_id", F.explode("ps").alias("p")).select("page_id", "p.panel", F.size("p.items").cast("long").alias("n"), *[F.col(f"p.{c}") for c in BOX])


def _place_in_rows(rows: Column, item: Column, tolerance: Column) -> Column:
    """Adds item to the first row whose mean centre is within the tolerance, else as a new row. A row is a struct of
    n, total (of centres) and items; sums of half pixels are exact, so means are those of the original order."""
    near = F.transform(rows, lambda r: F.abs(item["cy"] - r["total"] / r["n"]) <= tolerance)
    first = F.array_position(near, F.lit(True))
    grown = F.transform(rows, lambda r, i: F.when(i + 1 == first, F.struct((r["n"] + 1).alias("n"), (r["total"] + item["cy"]).alias("total"), F.concat(r["items"], F.array(item)).alias("items"))).otherwise(r))
    fresh = F.array(F.struct(F.lit(1).alias("n"), item["cy"].alias("total"), F.array(item).alias("items")))
    return F.when(first > 0, grown).otherwise(F.concat(rows, fresh))


def row_order(items: Column, kind: str, tolerance) -> Column:
    """Rows of an array of items (structs with cy and a sort key x), from top to bottom, each from left to right: an
    array of arrays. tolerance gives the column for an item. Ties keep the order of items."""
    row = f"struct<n:int,total:double,items:array<{kind}>>"
    rows = F.aggregate(items, F.array().cast(f"array<{row}>"), lambda acc, it: _place_in_rows(acc, it, tolerance(it)).cast(f"array<{row}>"))
    keyed = F.array_sort(F.transform(rows, lambda r, i: F.struct((r["total"] / r["n"]).alias("y"), i.alias("i"), r["items"].alias("items"))))
    sort_x = lambda r: F.transform(F.array_sort(F.transform(r["items"], lambda it, i: F.struct(it["x"].alias("x"), i.alias("i"), it.alias("it")))), lambda s: s["it"])
    return F.transform(keyed, sort_x)


_PLACED = "struct<id:bigint,cy:double,x:double,x1:int,y1:int,x2:int,y2:int>"


def _panel_order(boxes: Column, y_tolerance: float, overlap: float) -> Column:
    """Ids of a panel's boxes, an array in the order of ids, as they are read."""
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast(f"array<array<{_PLACED}>>").alias("groups"))
    placed = lambda b: F.struct(b["bubble_id"].alias("id"), ((b["y1"] + b["y2"]) / 2.0).alias("cy"), ((b["x1"] + b["x2"]) / 2.0).alias("x"), *[b[c].alias(c) for c in BOX])
    by_size = lambda g: F.transform(F.array_sort(F.transform(g, lambda o: F.struct(G.area(o).alias("area"), o["cy"].alias("cy"), o["x"].alias("x"), o["id"].alias("id"), o.alias("o")))), lambda s: s["o"])

    def lead(acc: Column, x: Column, items: Column) -> Column:
        free = lambda o: (o["id"] > x["id"]) & ~F.array_contains(acc["used"], o["id"]) & (G.overlap_ratio(x, o) > overlap)
        led = lambda mine: F.when(F.size(mine) == 0, acc).otherwise(F.struct(F.concat(acc["used"], F.array(x["id"]), F.transform(mine, lambda o: o["id"])).alias("used"), F.concat(acc["groups"], F.array(F.concat(F.array(x), mine))).alias("groups")))
        return F.when(F.array_contains(acc["used"], x["id"]), acc).otherwise(bound(F.filter(items, free), led))

    def spliced(block: Column, rest: Column) -> Column:
        before = F.aggregate(F.transform(rest, lambda o, i: F.when(o["cy"] <= block[0]["cy"], i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        return F.when(F.size(block) == 0, rest).otherwise(bound(before, lambda at: F.concat(F.slice(rest, F.lit(1), at), block, F.slice(rest, at + 1, F.size(rest)))))

    def ordered(items: Column, g: Column) -> Column:
        rest = F.flatten(row_order(F.filter(items, lambda o: ~F.array_contains(g["used"], o["id"])), _PLACED, lambda _: F.lit(y_tolerance)))
        return bound(F.flatten(F.transform(g["groups"], by_size)), lambda block: bound(rest, lambda r: spliced(block, r)))

    many = bound(F.transform(boxes, placed), lambda items: bound(F.aggregate(items, start, lambda acc, x: lead(acc, x, items)), lambda g: ordered(items, g)))
    return F.when(F.size(boxes) == 1, F.transform(boxes, lambda b: b["bubble_id"])).otherwise(F.transform(many, lambda o: o["id"]))


def _numbered(listed: DataFrame, y_tolerance: float, overlap: float) -> DataFrame:
    """Numbers the boxes of pages whose array ps holds their panels in order."""
    flat = F.flatten(F.transform("ps", lambda p: F.transform(_panel_order(p["items"], y_tolerance, overlap), lambda i: F.struct(p["panel"].alias("panel"), i.alias("id")))))
    return listed.select("page_id", F.posexplode(flat).alias("reading_order", "o")).select("page_id", F.col("o.id").alias("bubble_id"), F.col("o.panel").alias("panel"), F.col("reading_order").cast("long").alias("reading_order"))


def reading_order(boxes: DataFrame, panel_of: DataFrame, y_tolerance: float = 50.0, overlap: float = 0.1) -> DataFrame:
    """(page_id, bubble_id, panel, reading_order) from 0: panels by the centre of their enclosing box, in a panel rows
    from top to bottom and left to right; overlapping boxes of a panel stand together, smaller ones first, after the
    last other box whose centre isn't below that of the first of them."""
    b = boxes.join(panel_of, ["page_id", "bubble_id"])
    item = F.struct("bubble_id", *BOX).cast(_ITEM)
    p = b.groupBy("page_id", "panel").agg(F.array_sort(F.collect_list(item)).alias("items"), ((F.min("x1") + F.max("x2")) / 2.0).alias("px"), ((F.min("y1") + F.max("y2")) / 2.0).alias("py"))
    listed = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("py", "px", "panel", "items"))).alias("ps"))
    return _numbered(listed, y_tolerance, overlap)


def panelled_order(boxes: DataFrame, page_width: int, page_height: int, suppressed: float | None = None, standard: bool = False) -> DataFrame:
    """reading_order of the boxes in their panels; with a threshold, of those that suppression keeps. The page is
    brought together once."""
    if suppressed is None:
        arrays = _page_array(boxes, "bubble_id", *BOX)
    else:
        placed = F.array_sort(F.transform("kept", lambda b: F.struct(*[b[c].alias(c) for c in ("bubble_id", *BOX)])))
        arrays = _kept_arrays(boxes, suppressed, standard).select("page_id", placed.alias("boxes"))
    return _numbered(_panel_arrays(arrays, page_width, page_height, 0.04, 0.05), 50.0, 0.1)


def reading_order_fallback(boxes: DataFrame) -> DataFrame:
    """Order by centre (y, then x), from 0; ties by id."""
    cy, cx = F.col("y1") + F.col("y2"), F.col("x1") + F.col("x2")
    arrays = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(cy.alias("cy"), cx.alias("cx"), "bubble_id"))).alias("bs"))
    return arrays.select("page_id", F.posexplode("bs").alias("reading_order", "b")).select("page_id", "b.bubble_id", F.col("reading_order").cast("long").alias("reading_order"))


def line_groups(lines: DataFrame, ratio: float = 0.6, least: float = 8.0) -> DataFrame:
    """(page_id, bubble_id, line_group_id, reading_order) of text lines with line_height: rows by a tolerance of the
    line's own height; in a row by left edge."""
    kind = "struct<id:bigint,cy:double,x:int,h:double>"
    item = F.struct(F.col("bubble_id").cast("long").alias("id"), ((F.col("y1") + F.col("y2")) / 2.0).alias("cy"), F.col("x1").cast("int").alias("x"), F.col("line_height").cast("double").alias("h"))
    arrays = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = row_order(F.col("items"), kind, lambda it: F.greatest(it["h"] * ratio, F.lit(least)))
    flat = F.flatten(F.transform(rows, lambda r, g: F.transform(r, lambda it: F.struct(g.alias("g"), it["id"].alias("id")))))
    return arrays.select("page_id", F.posexplode(flat).alias("reading_order", "o")).select("page_id", F.col("o.id").alias("bubble_id"), F.col("o.g").cast("long").alias("line_group_id"), F.col("reading_order").cast("long").alias("reading_order"))
