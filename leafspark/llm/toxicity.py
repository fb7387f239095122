"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word is the sum of hashed embeddings of its pieces: itself and its beginnings of 3 to 8 bytes. Filters of widths 2, 3
and 5 have a tap for each place of their window, so word order counts. A filter of width 1 gives each word a few
activations besides, which long windows (10 to 160 words) add up with equal weights. Max pooling over the whole text and
a logistic output follow. The language by which the threshold is chosen is guessed from the text's function words; no
other column is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowwise import struct_column
from .words import ALPHANUMERIC, _tables, hash_word, mix, scan

#: Labelled rows that are collected for training at most, each class; texts of more bytes are not used for training.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 20_000
BUCKETS, DIMS, FILTERS = 1 << 17, 6, 4
#: Words in the windows of filters with a tap for each place, and of sums of the filter of width 1.
TAPPED, WIDTHS = (2, 3, 5), (1, 10, 40, 160)
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A piece must stand in so many training texts, and lean to the toxic ones by so many standard errors, to get an embedding.
LEAST_TEXTS, LEAST_Z = 4, 2.0
PASS_SCORE = 0.7

#: Frequent function words, by language.
FUNCTION_WORDS = {
    "en": "the of and to in that is for on with was are this be it at by from have not",
    "fr": "le la les de du des et un une en que qui pour dans par sur est au aux avec",
    "de": "der die das und ist von zu den mit ein eine nicht sich auf dem für des im auch als",
    "es": "el la los las de del y un una en que por con para se no al es lo como",
}
LANGUAGES = tuple(FUNCTION_WORDS)


@cache
def _language_weights() -> tuple[np.ndarray, np.ndarray]:
    table: dict[int, np.ndarray] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            table.setdefault(int(hash_word(w, ALPHANUMERIC)), np.zeros(len(LANGUAGES)))[k] = 1
    keys = np.array(sorted(table), np.uint64)
    weights = np.stack([table[int(k)] for k in keys])
    return keys, weights / weights.sum(axis=1, keepdims=True)


@dataclass
class Vocabulary:
    """Different words of some texts: the buckets of each one's pieces (0: none), and which word stands where."""

    pieces: np.ndarray
    hashes: np.ndarray
    word: np.ndarray
    first: np.ndarray


def vocabulary(texts: list[bytes | None]) -> Vocabulary:
    words = scan(texts, ALPHANUMERIC)
    buffer = np.frombuffer(words.data, np.uint8)
    hashes, example, word = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts = words.starts[example]
    length = words.ends[example] - starts
    out = np.zeros((len(hashes), len(PREFIXES) + 1), np.int32)
    bucket = lambda h: (h >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1) + 1
    out[:, 0] = bucket(hashes)
    power, _ = _tables(max(PREFIXES) + 1)
    value = np.zeros(len(hashes), np.uint64)
    for k in range(max(PREFIXES)):
        live = length > k
        value[live] += ALPHANUMERIC[buffer[starts[live] + k]] * power[k]
        if k + 1 in PREFIXES:
            out[live, PREFIXES.index(k + 1) + 1] = bucket(mix(value[live] ^ np.uint64((k + 1) << 56)))
    return Vocabulary(out, hashes, word.ravel(), words.first)


@dataclass
class Model:
    """embed: a bucket's vector; filters and bias: the filter of width 1; taps: for each of TAPPED its filters by place,
    dimension and number; tap_bias and output by width and filter (output: the sums' widths first)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    taps: list[np.ndarray]
    tap_bias: np.ndarray
    output: np.ndarray
    constant: float
    thresholds: np.ndarray

    def logits(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        v = vocabulary(texts)
        vectors = self.embed[v.pieces].sum(axis=1, dtype=np.float64)
        place = np.flatnonzero(vectors.any(axis=1)[v.word])
        e = vectors[v.word[place]]
        pooled = [_pool(np.maximum(e @ self.filters + self.bias, 0), place, v.first)[0]]
        for k, taps in enumerate(self.taps):
            pooled.append(_convolve(e, place, v.first, taps, self.tap_bias[k])[0][:, None])
        return np.concatenate(pooled, axis=1).reshape(len(texts), -1) @ self.output.ravel() + self.constant, guess_languages(v)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """0 to 1; PASS_SCORE where the logit is its language's threshold. Rounded, as sums depend a little on what else
        is in the batch."""
        logit, language = self.logits(texts)
        return np.round(1 / (1 + np.exp(-np.clip(logit - self.thresholds[language] + np.log(PASS_SCORE / (1 - PASS_SCORE)), -50, 50))), 9)


def _pool(act: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum over each text's windows, by width and filter; the row of act that the best window starts with, and the
    row after each row's window, by width. act has a row for each word that isn't silent, place the words' numbers; as
    activations aren't negative, some best window starts with such a word. Windows end with the text."""
    n, texts = len(place), len(first) - 1
    out, where = np.zeros((texts, len(WIDTHS), act.shape[1])), np.full((texts, len(WIDTHS), act.shape[1]), -1)
    begin = np.searchsorted(place, first)
    full = np.flatnonzero(np.diff(begin))
    ends = np.zeros((len(WIDTHS), n), np.int64)
    if not len(full):
        return out, where, ends
    sums = np.zeros((n + 1, act.shape[1]))
    np.cumsum(act, axis=0, out=sums[1:])
    many = np.diff(begin)[full]
    to = np.repeat(begin[1:][full], many)
    for w, width in enumerate(WIDTHS):
        ends[w] = np.minimum(np.searchsorted(place, place + width), to)
        window = (sums[ends[w]] - sums[:-1]) / np.sqrt(width)
        out[full, w] = np.maximum.reduceat(window, begin[:-1][full], axis=0)
        row = np.where(window >= np.repeat(out[full, w], many, axis=0), np.arange(n)[:, None], n)
        where[full, w] = np.minimum.reduceat(row, begin[:-1][full], axis=0)
    return out, where, ends


def _convolve(e: np.ndarray, place: np.ndarray, first: np.ndarray, taps: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum over each text's windows of relu(bias + the sum over places t of e[word t] @ taps[t]), by filter; the best
    window's row (-1: none above 0), and each word's windows by the place that it has in them. Words without a row in e
    count as zeros, as places before and after the text do; bias must be negative, so windows of such words stay silent."""
    width, texts = len(taps), len(first) - 1
    out, best = np.zeros((texts, taps.shape[2])), np.full((texts, taps.shape[2]), -1)
    if not len(place):
        return out, best, np.zeros((0, width), np.int64)
    owner = np.searchsorted(first, place, side="right") - 1
    # Texts are width - 1 places apart, so that no window reaches two of them.
    slot = place - place[0] + (owner - owner[0]) * (width - 1)
    window = np.zeros(slot[-1] + width, bool)
    for t in range(width):
        window[slot + t] = True
    window = np.cumsum(window) - 1
    at = window[slot[:, None] + np.arange(width - 1, -1, -1)]
    total, text = np.tile(bias, (window[-1] + 1, 1)).astype(np.float64), np.zeros(window[-1] + 1, np.int64)
    for t in range(width):  # a window has at most one word at place t
        total[at[:, t]] += e @ taps[t]
        text[at[:, t]] = owner
    np.maximum(total, 0, out=total)
    full, begin = np.unique(text, return_index=True)
    out[full] = np.maximum.reduceat(total, begin, axis=0)
    row = np.where((total >= out[text]) & (total > 0), np.arange(len(total))[:, None], len(total))
    found = np.minimum.reduceat(row, begin, axis=0)
    best[full] = np.where(found < len(total), found, -1)
    return out, best, at


def _convolve_back(up: np.ndarray, e: np.ndarray, best: np.ndarray, at: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of e, taps and bias, given those of _convolve's maxima."""
    slope = np.zeros((int(at.max()) + 1 if len(at) else 0, taps.shape[2]))
    text, f = np.nonzero(best >= 0)
    np.add.at(slope, (best[text, f], f), up[text, f])
    of_taps, of_e = np.zeros_like(taps), np.zeros_like(e)
    for t in range(len(taps)):
        here = slope[at[:, t]]
        of_taps[t] = e.T @ here
        of_e += here @ taps[t].T
    return of_e, of_taps, slope.sum(axis=0)


def guess_languages(v: Vocabulary) -> np.ndarray:
    """Place in LANGUAGES for each text; the first where no function word occurs."""
    keys, weights = _language_weights()
    at = np.minimum(np.searchsorted(keys, v.hashes), len(keys) - 1)
    known = keys[at] == v.hashes
    place = np.flatnonzero(known[v.word])
    each = weights[at[v.word[place]]]
    sums = np.zeros((len(place) + 1, len(LANGUAGES)))
    np.cumsum(each, axis=0, out=sums[1:])
    cut = np.searchsorted(place, v.first)
    return np.argmax(sums[cut[1:]] - sums[cut[:-1]], axis=1)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5, epochs: int = 12, batch: int = 64, rate: float = 0.02) -> Model:
    """Adam on the log loss; a fifth of the rows is kept for choosing the thresholds."""
    rng = np.random.default_rng(seed)
    v = vocabulary(texts)
    n = len(texts)
    held = rng.permutation(n) < n // 5 if n >= 20 else np.zeros(n, bool)
    p, q = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for i in np.flatnonzero(~held):  # a text at a time: a piece counts once in it
        seen = np.unique(v.pieces[np.unique(v.word[v.first[i] : v.first[i + 1]])])
        (p if labels[i] == 1 else q)[seen] += 1
    odds = np.log((p + 0.5) / (np.sum(labels[~held] == 1) + 1)) - np.log((q + 0.5) / (np.sum(labels[~held] == 0) + 1))
    known = (p + q >= LEAST_TEXTS) & (odds / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) > LEAST_Z)
    known[0] = False
    embed = rng.normal(0, 0.02, (BUCKETS, DIMS))
    embed[:, 0] = np.clip(odds, -1, 4) / 4  # starts from the pieces' log odds
    embed[~known] = 0
    weights = {"filters": np.abs(rng.normal(0, 0.1, (DIMS, FILTERS))), "bias": np.full(FILTERS, -0.3), "output": np.abs(rng.normal(0.3, 0.1, (len(WIDTHS) + len(TAPPED), FILTERS))), "tap_bias": np.full((len(TAPPED), FILTERS), -0.3), "constant": np.full(1, -2.0)}
    weights["filters"][0] = rng.uniform(0.8, 1.2, FILTERS)
    for k, width in enumerate(TAPPED):
        weights[k] = np.abs(rng.normal(0, 0.1, (width, DIMS, FILTERS)))
        weights[k][:, 0] = rng.uniform(0.5, 1.5, (width, FILTERS)) / np.sqrt(width)
    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in (weights | {"embed": embed}).items()}
    place = np.flatnonzero(known[v.pieces].any(axis=1)[v.word])  # all other words have no activation
    cut = np.searchsorted(place, v.first)
    order, step = np.flatnonzero(~held), 0
    share = np.array([max(1, np.sum(labels == k)) for k in (0, 1)]) / max(1, n)
    balance = 0.5 / share[labels]
    for _ in range(epochs):
        order = rng.permutation(order)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            begin = np.concatenate([[0], np.cumsum(np.diff(v.first)[pick])])
            words = np.concatenate([place[cut[i] : cut[i + 1]] for i in pick])
            moved = words + np.repeat(begin[:-1] - v.first[pick], (cut[pick + 1] - cut[pick]))
            x = v.pieces[v.word[words]]
            e = embed[x].sum(axis=1)
            total = e @ weights["filters"] + weights["bias"]
            act = np.maximum(total, 0)
            sums, where, ends = _pool(act, moved, begin)
            tapped = [_convolve(e, moved, begin, weights[k], weights["tap_bias"][k]) for k in range(len(TAPPED))]
            pooled = np.concatenate([sums, *(t[0][:, None] for t in tapped)], axis=1)
            logit = (pooled * weights["output"]).sum(axis=(1, 2)) + weights["constant"]
            slope = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[pick]) * balance[pick] / len(pick)
            up = np.zeros_like(act)
            for w, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    some = np.flatnonzero(where[:, w, f] >= 0)
                    spread = np.zeros(len(act) + 1)
                    share = slope[some] * weights["output"][w, f] / np.sqrt(width)
                    np.add.at(spread, where[some, w, f], share)
                    np.add.at(spread, ends[w][where[some, w, f]], -share)
                    up[:, f] += np.cumsum(spread)[:-1]
            up *= total > 0
            grads = {"filters": e.T @ up, "bias": up.sum(axis=0), "output": (slope[:, None, None] * pooled).sum(axis=0), "constant": slope.sum(keepdims=True)}
            down, of_bias = up @ weights["filters"].T, np.zeros_like(weights["tap_bias"])
            for k, (_, best, at_window) in enumerate(tapped):
                of_e, grads[k], of_bias[k] = _convolve_back(slope[:, None] * weights["output"][len(WIDTHS) + k], e, best, at_window, weights[k])
                down += of_e
            grads["tap_bias"] = of_bias
            step += 1
            for k, g in grads.items():
                _adam(weights[k], g, state[k], step, rate)
            for k in ("bias", "tap_bias"):  # words without known pieces stay silent
                np.minimum(weights[k], -0.05, out=weights[k])
            used, back = np.unique(x.ravel(), return_inverse=True)
            g = np.zeros((len(used), DIMS))
            np.add.at(g, back.ravel(), np.repeat(down, x.shape[1], axis=0))
            g[~known[used]] = 0
            m1, m2 = state["embed"]
            m1[used] = 0.9 * m1[used] + 0.1 * g
            m2[used] = 0.99 * m2[used] + 0.01 * g * g
            embed[used] -= rate * m1[used] / (np.sqrt(m2[used]) + 1e-6)
    model = Model(embed.astype(np.float32), weights["filters"], weights["bias"], [weights[k] for k in range(len(TAPPED))], weights["tap_bias"], weights["output"], float(weights["constant"][0]), np.zeros(len(LANGUAGES)))
    check = np.flatnonzero(held) if held.any() else np.arange(n)
    model.thresholds = _thresholds(model, [texts[i] for i in check], labels[check])
    return model


def _adam(w: np.ndarray, g: np.ndarray, state: tuple[np.ndarray, np.ndarray], step: int, rate: float) -> None:
    m, v = state
    m *= 0.9
    m += 0.1 * g
    v *= 0.99
    v += 0.01 * g * g
    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _thresholds(model: Model, texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """For each language the logit with the best F1 on these rows, middle of its gap; languages of few rows get that of all."""

    def best(logit: np.ndarray, label: np.ndarray) -> float:
        order = np.argsort(-logit)
        hits = np.cumsum(label[order] == 1)
        f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, np.sum(label == 1)))
        k = int(np.argmax(f1))
        below = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 1
        return float((logit[order[k]] + below) / 2)

    if not len(texts) or not (labels == 1).any():
        return np.zeros(len(LANGUAGES))
    logit, language = model.logits(texts)
    out = np.full(len(LANGUAGES), best(logit, labels))
    for k in range(len(LANGUAGES)):
        own = language == k
        if np.sum(labels[own] == 1) >= 8 and np.sum(labels[own] == 0) >= 8:
            out[k] = best(logit[own], labels[own])
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out from training."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on labelled rows whose fold isn't 1: at most sample_rows of each class, those with the smallest hashes of
    their id, of texts up to sample_bytes (of several texts of one id the least). Ids that are labelled both ways, null ids and null labels are left out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = marked.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    picked = []
    for k in (0, 1):  # ids first: only the chosen rows' texts are moved
        picked.append(marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    ids = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= sample_bytes)
    rows = sorted(texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("doc_id", "text", "toxic").collect())
    return train([r.text.encode() for r in rows], np.array([r.toxic for r in rows], np.int64))


def score(text: Column, model) -> Column:
    """A struct column of score and predicted; model is a broadcast Model."""

    def work(texts: list[bytes | None]) -> list:
        s = model.value.scores(texts)
        return [s, (s >= PASS_SCORE).astype(np.int32)]

    return struct_column(work, "score double, predicted int", text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs. A null or empty text gets the score of no words; a
    null id is not held out; without labels of both kinds all scores come from the model's starting values."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), score(F.col("text"), model).alias("_s")).select("doc_id", "held_out", "_s.score", "_s.predicted")
