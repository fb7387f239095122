"""Benchmark decontamination by Wu-Manber search over words.

The strings are windows of benchmark words and the alphabet is 64-bit word hashes. A table of shifts by block of
words tells how far the search may jump; where the shift is 0 a bucket of that block's hash lists the windows that
end in it, and these are compared word by word. Many stretches of text ("lanes") are searched side by side, so every
step of the search is one numpy operation over all lanes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowwise import struct_column
from .scratch import Scratch
from .words import ALPHANUMERIC, Words, mix, scan

#: Bytes of benchmark text that are searched for in one pass, all in one broadcast; more take more passes.
PASS_BYTES = 16 << 20
#: Words of a block of the shift tables, and of a lane.
BLOCK_WORDS, LANE = 3, 512
#: Comparisons that are made at once.
COMPARE = 1 << 20

_SALT = np.random.default_rng(11).integers(1, 2**63, BLOCK_WORDS, np.uint64) | np.uint64(1)


@dataclass
class _Length:
    """Windows of one length: rows of word hashes, the shift by block code, and by code the rows that end in it."""

    windows: np.ndarray
    block: int
    bits: int
    shift: np.ndarray
    bucket: np.ndarray
    rows: np.ndarray
    #: Row i stands in items item[item_at[i]:item_at[i + 1]].
    item_at: np.ndarray
    item: np.ndarray


def _codes(h: np.ndarray, ends: np.ndarray, block: int, bits: int) -> np.ndarray:
    code = np.zeros(len(ends), np.uint64)
    for k in range(block):
        code += h[ends - k] * _SALT[k]
    return (mix(code) >> np.uint64(64 - bits)).astype(np.int64)


def _table(windows: np.ndarray, items: np.ndarray) -> _Length:
    distinct, row = np.unique(windows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([row.ravel(), items]), axis=1)
    item_at = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
    m = windows.shape[1]
    block = min(BLOCK_WORDS, m)
    bits = int(min(max(10, int(np.ceil(np.log2(len(distinct) * m * 4)))), 24))
    shift = np.full(1 << bits, m - block + 1, np.uint8 if m < 250 else np.int32)
    flat = np.ascontiguousarray(distinct).ravel()
    for end in range(block - 1, m):
        np.minimum.at(shift, _codes(flat, np.arange(len(distinct)) * m + end, block, bits), m - 1 - end)
    code = _codes(flat, np.arange(len(distinct)) * m + m - 1, block, bits)
    rows = np.argsort(code, kind="stable")
    return _Length(distinct, block, bits, shift, np.searchsorted(code[rows], np.arange((1 << bits) + 1)), rows, item_at, pairs[1])


class Matcher:
    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        ids = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(ids)} | {None: -1}
        words = scan([(t or "").encode() for _, t in items], ALPHANUMERIC)
        by: dict[int, tuple[list, list]] = {}
        for (i, _), a, b in zip(items, words.first[:-1].tolist(), words.first[1:].tolist()):
            if b > a:
                m = min(window, b - a)
                of = by.setdefault(m, ([], []))
                of[0].append(np.lib.stride_tricks.sliding_window_view(words.hashes[a:b], m))
                of[1].append(np.full(b - a - m + 1, place[i]))
        self.ids, self.lengths = ids, [_table(np.concatenate(w), np.concatenate(i)) for _, (w, i) in sorted(by.items())]

    def _ends(self, t: _Length, h: np.ndarray) -> np.ndarray:
        """Positions at which the search stops with shift 0."""
        m, found = t.windows.shape[1], []
        at = np.arange(m - 1, len(h), LANE)
        stop = np.minimum(at + LANE, len(h))
        while len(at):
            step = t.shift[_codes(h, at, t.block, t.bits)]
            hit = step == 0
            found.append(at[hit])
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last word of every occurrence, and (text, place of item) of the items that occur."""
        h, starts, ends, texts, items = words.hashes, [], [], [], []
        for t in self.lengths:
            m = t.windows.shape[1]
            stops = self._ends(t, h)
            text = np.searchsorted(words.first, stops, "right") - 1
            inside = stops - m + 1 >= words.first[text]
            stops, text = stops[inside], text[inside]
            code = _codes(h, stops, t.block, t.bits)
            many = t.bucket[code + 1] - t.bucket[code]
            total = np.concatenate([[0], np.cumsum(many)])
            at = 0
            while at < len(stops):
                to = max(at + 1, int(np.searchsorted(total, total[at] + COMPARE, "right")) - 1)
                which = np.repeat(np.arange(at, to), many[at:to])
                row = t.rows[np.arange(len(which)) - np.repeat(total[at:to] - total[at], many[at:to]) + np.repeat(t.bucket[code[at:to]], many[at:to])]
                for k in range(m):
                    same = t.windows[row, k] == h[stops[which] - m + 1 + k]
                    which, row = which[same], row[same]
                starts.append(stops[which] - m + 1), ends.append(stops[which])
                n = t.item_at[row + 1] - t.item_at[row]
                texts.append(np.repeat(text[which], n))
                before = np.cumsum(n) - n
                items.append(t.item[np.arange(n.sum()) - np.repeat(before, n) + np.repeat(t.item_at[row], n)])
                at = to
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(starts), join(ends), join(texts), join(items)


RESULT = "n_words bigint, spans array<bigint>, items array<bigint>"


def _search(matcher, texts: list[bytes | None]) -> list:
    """Words, merged spans of hit words (start, end, start, end, ...; ends exclusive) and item ids, for each text."""
    words = scan(texts, ALPHANUMERIC)
    starts, ends, where, items = matcher.find(words)
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends + 1, -1)
    hit = np.cumsum(cover)[:-1] > 0
    new = np.zeros(len(hit), bool)
    new[words.first[:-1][words.counts() > 0]] = True
    edge = np.flatnonzero(hit & (new | ~np.concatenate([[False], hit[:-1]]))) if len(hit) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit & np.concatenate([new[1:] | ~hit[1:], [True]])) + 1 if len(hit) else np.zeros(0, np.int64)
    text = np.searchsorted(words.first, edge, "right") - 1
    spans: list[list[int]] = [[] for _ in texts]
    for i, a, b in zip(text.tolist(), (edge - words.first[text]).tolist(), (last - words.first[text]).tolist()):
        spans[i] += [a, b]
    found: list[list[int]] = [[] for _ in texts]
    if len(items):
        pairs = np.unique(np.stack([where, items]), axis=1)
        for i, k in zip(*pairs.tolist()):
            if k >= 0:
                found[i].append(matcher.ids[k])
    return [words.counts(), spans, found]


def _matches(text: Column, matcher) -> Column:
    return struct_column(lambda texts: _search(matcher.value, texts), RESULT, text)


def _merged_spans(spans: Column) -> Column:
    """Spans of several passes (array of arrays start, end, start, end, ...) as those of their union."""
    pairs = F.array_sort(F.flatten(F.transform(spans, lambda x: F.filter(F.transform(x, lambda v, i: F.when(i % 2 == 0, F.array(v, F.get(x, i + 1)))), lambda p: p.isNotNull()))))
    joined = F.aggregate(
        pairs, F.array().cast("array<bigint>"),
        lambda out, p: F.when((F.size(out) > 0) & (p[0] <= F.element_at(out, -1)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(F.element_at(out, -1), p[1])))).otherwise(F.concat(out, p)),
    )
    return joined


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", pass_bytes: int = PASS_BYTES, name: str = "_benchmark") -> DataFrame:
    """docs with one more column: a struct of n_words, spans of hit words and the item ids that occur.

    Windows are `window` consecutive words of an item, or all words of a shorter one. A null text has no words, an item
    without words no window. A window of a null item_id hits words but counts as no item. Repeated items count once.
    The benchmark is measured first and dealt into passes of about pass_bytes of its text; every pass collects and
    broadcasts that much at most (or one item, if that is longer), and keeps what earlier ones have found.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    out = docs
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        matcher = spark.sparkContext.broadcast(Matcher([tuple(r) for r in part.collect()], window))
        column = _matches(F.col(text), matcher)
        out = out.withColumn(name if passes == 1 else f"{name}_{k}", column)
    if passes > 1:
        parts = [F.col(f"{name}_{k}") for k in range(passes)]
        merged = F.struct(parts[0]["n_words"].alias("n_words"), _merged_spans(F.array(*[p["spans"] for p in parts])).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in parts])))).alias("items"))
        out = out.withColumn(name, merged).drop(*[f"{name}_{k}" for k in range(passes)])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs (see find_benchmark)."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark, window).select("doc_id", "_benchmark.*")
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumn("n_hit", hit)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
