"""Language-model scoring: stupid backoff over the corpus's own n-gram counts, each text against all others.

Counts are relational: every task cuts its texts into chunks and writes each chunk's words down as places in a list of
word hashes. Each chunk's distinct n-grams and their counts go to the partition of the count table that their hash
belongs to, every partition adds up its counts, and answers each chunk with the totals of the n-grams that it sent.
The chunk's n-grams are joined to these by position and summed for each text. An n-gram travels once for each chunk
that has it, whatever its frequency, so frequent n-grams make no hot partition; and chunks are made of rows as they
come, so repeated rows make no hot chunk. Lists of n-grams are rows, one for each chunk and partition, that is for each
block that a shuffle has anyway; both numbers grow with the corpus, unless chunk_bytes and part_words do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import ALPHANUMERIC, chunks, mix, release, scan

#: Bytes of text of a chunk; words for each partition of the count table.
CHUNK_BYTES = 8 << 20
PART_WORDS = 1 << 20
BACKOFF = 0.4
TOTAL = np.uint64(0)  # the "n-gram" whose count is the number of words
HASH_BITS = 56
WORD_BYTES = 6  # of a word's hash

_SALT = np.random.default_rng(13).integers(1, 2**63, 8, np.uint64) | np.uint64(1)

CHUNKS = "chunk long, doc_ids array<long>, lengths binary, hashes binary, places binary, n_words long"

_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeeze(data: bytes) -> bytes:
    return _ZSTD.compress(data, asbytes=True) if data else b""


def _unsqueeze(data: bytes, size: int) -> bytes:
    return _ZSTD.decompress(data, size, asbytes=True) if size else b""


def _planes(values: np.ndarray, wide: int) -> bytes:
    """The low `wide` bytes of whole numbers, first all lowest ones, then all second ones, and so on."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _from_planes(data: bytes, many: int, wide: int) -> np.ndarray:
    out = np.zeros((many, 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, many * wide).reshape(wide, many).T
    return out.view(np.uint64).ravel()


def _chunks(limit: int):
    """Chunks of about limit bytes of text: ids and numbers of words of its texts, its distinct words, and which stands where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, lengths, hashes, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            found, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            by = np.argsort(-count, kind="stable")  # frequent words get small numbers, whose high bytes cost nothing
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by))
            columns = [[chunk], [ids], [np.concatenate(lengths).astype(np.uint32).tobytes()], [_planes(found[by], WORD_BYTES)], [_squeeze(_planes(rank[place.ravel()], 4))], [len(place)]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "doc_ids", "lengths", "hashes", "places", "n_words"])

        for batch, texts in chunks(batches):
            words = scan(texts, ALPHANUMERIC)
            ids += batch.column("doc_id").to_pylist()
            lengths.append(words.counts()), hashes.append(words.hashes >> np.uint64(64 - 8 * WORD_BYTES))
            size += len(words.data)
            if size >= limit:
                yield made()
                chunk += 1
                ids, lengths, hashes, size = [], [], [], 0
        if ids:
            yield made()
        ids, lengths, hashes = [], [], []
        release()

    return run


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's words in order, and the number of words of each of its texts."""
    many = row["n_words"]
    place = _from_planes(_unsqueeze(row["places"], 4 * many), many, 4)
    hashes = mix(_from_planes(row["hashes"], len(row["hashes"]) // WORD_BYTES, WORD_BYTES))
    return hashes[place.astype(np.int64)], np.frombuffer(row["lengths"], np.uint32).astype(np.int64)


def _ngrams(hashes: np.ndarray, lengths: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length 1..order the hash of the n-gram that ends in each word (0: it would begin before the text); each
    word's text; and the words before it in its text."""
    n = len(hashes)
    text = np.repeat(np.arange(len(lengths)), lengths)
    before = np.arange(n) - (np.cumsum(lengths) - lengths)[text]
    out, sums = [], np.zeros(n, np.uint64)
    for k in range(order):
        sums[k:] += hashes[: max(n - k, 0)] * _SALT[k]
        gram = np.maximum(mix(sums + _SALT[7] * np.uint64(k)) >> np.uint64(64 - HASH_BITS), np.uint64(1))
        out.append(np.where(before >= k, gram, np.uint64(0)))
    return out, text, before


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, their counts, and each n-gram's place among them; first comes TOTAL."""
    found, counts, places, at = [np.zeros(1, np.uint64)], [np.full(1, len(grams[0]))], [], 1
    for g in grams:  # a length at a time, which takes less memory
        own, place, count = np.unique(g[g > 0], return_inverse=True, return_counts=True)
        here = np.zeros(len(g), np.int32)
        here[g > 0] = place.ravel() + at
        found.append(own), counts.append(count), places.append(here)
        at += len(own)
    every, count = np.concatenate(found), np.concatenate(counts)
    del found, counts
    order = np.argsort(every, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return every[order], count[order], np.concatenate([rank[p] for p in places])


def _parts(found: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's stretch of the sorted hashes begins."""
    return np.concatenate([[0], np.searchsorted(found, np.array([-(-(p << HASH_BITS) // parts) for p in range(1, parts)], np.uint64)), [len(found)]]).astype(np.int64)


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences: four bytes as they are, and the higher ones, which are alike, compressed. The first
    byte tells how many bytes there are."""
    step = np.diff(hashes, prepend=np.uint64(0))
    wide = max(4, -(-int(step.max()).bit_length() // 8)) if len(step) else 4
    return bytes([wide]) + len(step).to_bytes(8, "little") + (step & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + _squeeze(_planes(step >> np.uint64(32), wide - 4))


def unpack(data: bytes) -> np.ndarray:
    wide, many = data[0], int.from_bytes(data[1:9], "little")
    low = np.frombuffer(data, np.uint32, many, offset=9).astype(np.uint64)
    high = _from_planes(_unsqueeze(data[9 + 4 * many :], many * (wide - 4)), many, wide - 4)
    return np.cumsum(low + (high << np.uint64(32)), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, compressed; 255 stands for one of the larger counts, which come first with 8 bytes each."""
    large = counts[counts >= 255].astype(np.int64)
    return len(large).to_bytes(8, "little") + large.tobytes() + _squeeze(np.minimum(counts, 255).astype(np.uint8).tobytes())


def unpack_counts(data: bytes, many: int) -> np.ndarray:
    large = int.from_bytes(data[:8], "little")
    out = np.frombuffer(_unsqueeze(data[8 + 8 * large :], many), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, large, offset=8)
    return out


def _counts(order: int, parts: int):
    def lists(row: dict) -> pa.RecordBatch:
        found, count, _ = _distinct(_ngrams(*_words(row), order)[0])
        cut = _parts(found, parts).tolist()
        some = [p for p in range(parts) if cut[p + 1] > cut[p]]
        columns = [some, [row["chunk"]] * len(some), [pack(found[cut[p] : cut[p + 1]]) for p in some], [pack_counts(count[cut[p] : cut[p + 1]]) for p in some]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                out = lists(batch.slice(i, 1).to_pylist()[0])
                release()
                yield out

    return run


def _totals(key, table):
    """Adds up one partition of the count table, and answers every chunk in the order of its hashes."""
    hashes = [unpack(x) for x in table.column("hashes").to_pylist()]
    cut = np.cumsum([0, *map(len, hashes)]).tolist()
    counts = np.concatenate([unpack_counts(x, len(h)) for x, h in zip(table.column("counts").to_pylist(), hashes)])
    every = np.concatenate(hashes)
    del hashes
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(first, append=len(every)))
    out = pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([pack_counts(total[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())})
    del every, order, total, counts
    release()
    return out


def backoff_logs(grams: list[np.ndarray], place: np.ndarray, total: np.ndarray, text: np.ndarray, before: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log of each word's stupid-backoff score, from counts without the word's own text: the count of the longest n-gram
    that other texts have over that of its context, times BACKOFF for each word that was dropped from the longest one the
    text offers. A word that no other text has counts as a half."""
    n, texts = len(text), max(1, len(lengths))
    rest = []  # counts in other texts, by n-gram length
    for k in range(len(grams)):
        at = place[k * n : (k + 1) * n]
        _, back, own = np.unique(at * texts + text, return_inverse=True, return_counts=True)
        rest.append(np.where(before >= k, total[at] - own[back.ravel()], 0))
    others = np.maximum(total[0] - lengths[text], 1)
    out = np.log(np.maximum(rest[0], 0.5) / others)
    dropped = np.minimum(before, len(grams) - 1)  # words dropped when only the word itself is left
    out += dropped * np.log(BACKOFF)
    for k in range(1, len(grams)):
        context = np.concatenate([np.zeros(1, np.int64), rest[k - 1][:-1]])
        seen = np.flatnonzero((rest[k] > 0) & (before >= k))
        out[seen] = np.log(rest[k][seen] / np.maximum(context[seen], rest[k][seen])) + (dropped[seen] - k) * np.log(BACKOFF)
    return out


def _scores(order: int, parts: int):
    def run(key, texts, answers):
        row = texts.to_pylist()[0]
        hashes, lengths = _words(row)
        grams, text, before = _ngrams(hashes, lengths, order)
        found, _, place = _distinct(grams)
        data = [t for _, t in sorted(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()))]
        sizes = np.diff(_parts(found, parts))
        total = np.concatenate([unpack_counts(x, m) for x, m in zip(data, sizes[sizes > 0].tolist(), strict=True)])
        logs = backoff_logs(grams, place, total, text, before, lengths)
        sums = np.bincount(text, weights=logs, minlength=len(lengths))
        empty = lengths == 0
        mean = sums / np.maximum(lengths, 1)
        out = pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(lengths, pa.int64()), "log_score": pa.array(sums, pa.float64()),
            "mean_log_score": pa.array(mean, pa.float64(), mask=empty), "perplexity": pa.array(np.exp(np.minimum(-mean, 700)), pa.float64(), mask=empty),
        })
        del grams, found, place, total, logs, before, text, hashes, row, data
        release()
        return out

    return run


def score_corpus(docs: DataFrame, order: int = 3, chunk_bytes: int = CHUNK_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score and perplexity of every row of docs.

    Words are those of ALPHANUMERIC, n-grams are compared by hashes of 56 bits. Every text is scored by the n-gram counts
    of all other rows' texts; a repeated row counts as another text, a null or repeated doc_id is carried along. Texts
    without words, and null ones, have log_score 0 and null means; an empty table has no scores. Other columns are
    ignored. A chunk holds whole texts, so a text longer than chunk_bytes has a chunk of its own.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        dealt = scratch.write(source.mapInArrow(_chunks(chunk_bytes), CHUNKS))
        parts = max(1, -(-(dealt.agg(F.sum("n_words")).first()[0] or 0) // part_words))
        counts = dealt.mapInArrow(_counts(order, parts), "part long, chunk long, hashes binary, counts binary")
        totals = scratch.write(counts.groupBy("part").applyInArrow(_totals, "chunk long, part long, totals binary"))
        scored = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_scores(order, parts), "doc_id long, n_words long, log_score double, mean_log_score double, perplexity double")
        return scratch.write(scored, keep=True)
