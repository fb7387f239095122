"""Tolerant readers of model replies: JSON that is bare, fenced, wrapped in prose, cut off or missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bound
from .text import changed, strip, tone

FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def outer_braces(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such stretch."""
    return F.nullif(F.regexp_extract(text, r"(?s)^[^{]*+(\{.*\})", 1), F.lit(""))


def valid_object(text: Column) -> Column:
    """The text if it is one JSON object and nothing else, else null."""
    return bound(text, lambda t: F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(t).isNotNull(), t))


def leading_object(reply: Column) -> Column:
    """The JSON object that begins at the first opening brace, fences aside, whatever comes after it; null if there is
    none or it can't be read. Braces within strings don't count."""
    bare = strip(F.regexp_replace(reply, r"```(?:json)?\s*|\s*```", ""))
    start = F.instr(bare, "{")
    text = F.substr(bare, F.greatest(start, F.lit(1)))
    state = lambda depth, inside, escaped, at, end: F.struct(depth.alias("depth"), inside.alias("inside"), escaped.alias("escaped"), at.alias("at"), end.alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        free = ~s["inside"]
        depth = s["depth"] + F.when(free & (c == "{"), 1).when(free & (c == "}"), -1).otherwise(0)
        ends = (s["end"] == 0) & free & (c == "}") & (depth == 0)
        return state(depth, F.when(quote, ~s["inside"]).otherwise(s["inside"]), s["inside"] & (c == "\\") & ~s["escaped"], s["at"] + 1, F.when(ends, s["at"] + 1).otherwise(s["end"]))

    begin = state(F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0))
    end = F.aggregate(F.split(text, ""), begin, step)["end"]
    return F.when((start > 0) & (end > 0), valid_object(F.left(text, end)))


def translation(reply: Column, source: Column) -> Column:
    """Field `translation` of a reply that is an object, fenced or bare; empty if unreadable or just the source again."""
    bare = strip(reply)
    fenced = F.nullif(F.regexp_extract(bare, FENCED, 1), F.lit(""))
    body = F.when(F.instr(bare, "```") > 0, F.coalesce(fenced, outer_braces(bare), bare)).otherwise(bare)
    found = strip(F.coalesce(F.get_json_object(valid_object(body), "$.translation"), F.lit("")))
    return F.when(changed(found, source), found).otherwise("")


def visual_reply(reply: Column) -> Column:
    """Struct of tone, scene, ocr_correction, emphasis_words (empty if missing) and confidence; unreadable replies are
    neutral with confidence 0."""
    body = valid_object(outer_braces(strip(F.regexp_replace(reply, r"```json\s*|\s*```", ""))))

    def fields(body: Column) -> Column:
        get = lambda key: F.get_json_object(body, f"$.{key}")
        return F.struct(
            tone(F.coalesce(get("tone"), F.lit("neutral"))).alias("tone"), F.coalesce(get("scene"), F.when(body.isNotNull(), "Comic panel.").otherwise("")).alias("scene"),
            get("ocr_correction").alias("ocr_correction"),
            F.coalesce(F.from_json(get("emphasis_words"), "array<string>"), F.array().cast("array<string>")).alias("emphasis_words"), F.when(body.isNotNull(), 0.85).otherwise(0.0).alias("confidence"),
        )

    return bound(body, fields)


def first_flat_object(reply: Column) -> Column:
    """The first object without inner braces, or null."""
    return F.nullif(F.regexp_extract(reply, r"(\{[^{}]+\})", 1), F.lit(""))


CLOUD = "struct<bubbles:array<struct<bubble_id:string,source_text:string,translated_text:string,speaker:string,confidence:string>>>"


def cloud_bubbles(reply: Column) -> Column:
    """Array of bubble structs of a page-level reply; items whose numbers can't be read are dropped, a missing id is the
    item's place, a missing confidence 0."""
    items = F.from_json(outer_braces(reply), CLOUD)["bubbles"]
    made = F.transform(items, lambda it, i: F.struct(
        F.coalesce(F.when(it["bubble_id"].isNull(), i.cast("long")), it["bubble_id"].try_cast("bigint")).alias("bubble_id"),
        F.coalesce(it["source_text"], F.lit("")).alias("source_text"), F.coalesce(it["translated_text"], F.lit("")).alias("translated_text"),
        F.coalesce(it["speaker"], F.lit("")).alias("speaker"), F.coalesce(F.when(it["confidence"].isNull(), F.lit(0.0)), it["confidence"].try_cast("double")).alias("confidence"),
    ))
    return F.coalesce(F.filter(made, lambda m: m["bubble_id"].isNotNull() & m["confidence"].isNotNull()), F.array().cast("array<struct<bubble_id:bigint,source_text:string,translated_text:string,speaker:string,confidence:double>>"))


GROUNDING = "struct<bubbles:array<struct<box_2d:array<double>,text:string>>>"


def grounded_boxes(reply: Column, width: Column, height: Column) -> Column:
    """Array of {reading_order, x1, y1, x2, y2, text, confidence} of a reply with boxes in thousandths, y first; items
    whose box hasn't four numbers are dropped but keep their place."""
    items = F.from_json(outer_braces(reply), GROUNDING)["bubbles"]
    px = lambda v, size: ((v / F.lit(1000.0).cast("double")) * size).cast("int")
    made = F.transform(items, lambda it, i: F.struct(i.cast("long").alias("reading_order"), it["box_2d"].alias("b"), it["text"].alias("text")))
    kept = F.filter(made, lambda m: F.size(m["b"]) == 4)
    return F.transform(kept, lambda m: F.struct(
        m["reading_order"].alias("reading_order"), px(m["b"][1], width).alias("x1"), px(m["b"][0], height).alias("y1"), px(m["b"][3], width).alias("x2"), px(m["b"][2], height).alias("y2"),
        F.coalesce(m["text"], F.lit("")).alias("text"), F.lit(0.9).cast("double").alias("confidence"),
    ))
