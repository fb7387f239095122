"""Exact Jaccard join of word n-gram sets.

Method: size bands, tiles, hashed bitmap signatures whose bit counts bound the overlap from above, and then the exact
intersection of sorted arrays.

1. A text's set is the sorted array of its distinct n-gram hashes (64 bits). Texts with equal sets form one node.
2. Sizes fall into bands [2**i, 2**(i+1)). Two linked sets lie in the same band or, near its end, in neighbouring
   ones; such a set works in both. In a band the hash space is cut into k ranges; the elements of a set in one range
   form a token. Linked sets differ in at most D elements (D follows from size and threshold), so at most D tokens of
   one are not the other's; hence the first D + 1 tokens of both, in any common order, share one. That order takes
   tokens of many elements first, which few unrelated sets have. Sets of too few tokens for that argument also get a
   token that stands for the whole band.
   Tokens are brought together by packed lists: a task lists each different token once, whatever the number of its
   rows that have it, in a list for each partition of the token space (so as many lists as Spark's shuffle has blocks);
   only tokens that occur more than once come out as rows.
3. A token's nodes form a tile. All are compared with the tile's smallest node: first by bitmap, then exactly. That
   joins almost everything that belongs together, at a cost linear in the tile.
4. Tiles whose nodes are still in different components are compared in full, block by block, but only across
   components and only by bitmap. In a first few rounds each component hands over only its most promising partner of
   a block; so a large tile of near copies soon is one component, and costs no more. The last round hands over all
   that the bitmaps let through; so no link between components is lost. What is handed over is intersected exactly.
5. That gives components, but not all links inside them. For those (counted, or listed by ngram_links) the sets of each
   component of three or more are intersected exactly, block by block, as products of 0/1 matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import CHUNK_BYTES, NON_SPACE, chunks, mix, release, scan

#: Nodes of one block of a tile or component; elements of the sets of one block of a component; partners of one node that one run of exact comparisons takes; rounds of best partners
#: before the last one; ids that may be broadcast (16 bytes each; more are joined by a shuffle, with the same result).
BLOCK = 512
ELEMENTS = 1 << 20
RUN = 128
ROUNDS = 2
MAX_BROADCAST_IDS = 1_000_000
#: Tokens that a task holds before it lists them; bytes of text for each partition of the token space.
LISTED = 1 << 20
PART_BYTES = 16 << 20

_COLUMNS = 2048  # of a matrix at once

_SALT = np.random.default_rng(7).integers(1, 2**63, 64, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes | None], n: int, kind: np.ndarray = NON_SPACE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words than n has its whole sequence as one element."""
    words = scan(texts, kind)
    h, first = words.hashes, words.first
    grams = np.zeros(len(h), np.uint64)
    for k in range(n):
        grams[: len(h) - k] += h[k:] * _SALT[k]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = short * _SALT[40] + h[k : k + 1]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, from sorted arrays."""
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return den * both >= num * (len(a) + len(b) - both)


def band_of(size: int) -> int:
    return size.bit_length() - 1


def most_different(size: int, partner: int, num: int, den: int) -> int:
    """Elements in which linked sets of these sizes can differ."""
    return (size + partner) * (den - num) // (den + num)


def ranges_of(band: int, num: int, den: int) -> int:
    top = (2 << band) - 1
    d = most_different(top, top * den // num, num, den)
    return 1 if d == 0 else (3 * (d + 1) + 1) // 2


def bitmap_bits(band: int) -> int:
    return 1 << min(max(band + 2, 9), 15)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit x is the parity of the elements with hash x; two bitmaps differ in at most as many bits as their sets in elements."""
    parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def bands_for(size: int, num: int, den: int) -> list[int]:
    own = band_of(size)
    least = -(-size * num // den)
    return [own] if band_of(max(least, 1)) == own else [own, own - 1]


def tokens_of(s: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The token hashes under which the set s is listed."""
    size, out = len(s), []
    mixed = mix(s)
    for band in bands_for(size, num, den):
        k = ranges_of(band, num, den)
        partner = min(size * den // num, (2 << band) - 1) if band < band_of(size) else size * den // num
        d = most_different(size, partner, num, den)
        place = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(place, prepend=np.uint64(k + 1)))
        count = np.diff(starts, append=size)
        token = mix(np.add.reduceat(mixed, starts) + place[starts] * _SALT[41] + _SALT[42:43] * np.uint64(band))
        out.append(token[np.lexsort((token, -count))[: d + 1]])
        if len(token) <= d:
            out.append(mix(np.array([band], np.uint64) * _SALT[43]))
    return out


#: A row of the input (part is null), or a list of tokens: of those whose hash falls into a part, each with the first row
#: that has it; or (part -1) of all rows with tokens that several rows of the list's maker have.
SKETCH = "doc_id long, key long, n_shingles long, row long, node long, bits binary, part int, base long, tokens binary, rows binary"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("bits", pa.binary()), ("part", pa.int32()), ("base", pa.int64()), ("tokens", pa.binary()), ("rows", pa.binary())])
_TOKEN_BITS = np.uint64(48)


def _sketch_batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type) for f in _SKETCH], schema=_SKETCH)


def pack(tokens: np.ndarray) -> bytes:
    """Sorted tokens as differences of 4 bytes each, or 6 where one is larger; the first byte tells which."""
    step = np.diff(tokens, prepend=np.uint64(0))
    wide = 6 if len(step) and int(step.max()) >> 32 else 4
    return bytes([wide]) + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    step = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    step[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def _numbers(data: bytes, many: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * many else np.uint32).astype(np.int64)


def _lists(tokens: list[np.ndarray], rows: list[int], parts: int) -> pa.RecordBatch | None:
    """Lists of the tokens of some rows."""
    if not tokens:
        return None
    base, row = rows[0], np.repeat(np.array(rows, np.int64) - rows[0], list(map(len, tokens)))
    token = np.concatenate(tokens)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    first = np.flatnonzero(np.diff(token, prepend=token[0] + np.uint64(1)))
    many = np.repeat(np.diff(first, append=len(token)) > 1, np.diff(first, append=len(token)))
    small = np.uint16 if rows[-1] - base < 1 << 16 else np.uint32
    out = [(-1, pack(token[many]), row[many].astype(small).tobytes())] if many.any() else []
    token, row = token[first], row[first].astype(small)
    cut = np.searchsorted(token, [-(-(p << int(_TOKEN_BITS)) // parts) for p in range(1, parts)]).tolist() if parts > 1 else []
    out += [(p, pack(token[a:b]), row[a:b].tobytes()) for p, (a, b) in enumerate(zip([0, *cut], [*cut, len(token)])) if b > a]
    part, packed, of = zip(*out)
    return _sketch_batch(len(out), part=list(part), base=[base] * len(out), tokens=list(packed), rows=list(of))


def _sketches(n: int, num: int, den: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, rows, seen, size = [], [], set(), 0
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, n)
            row, first = np.arange(first, first + len(sets)), first + len(sets)
            node, bits = [], []
            for r, s in zip(row.tolist(), sets):
                if not len(s):
                    node.append(None), bits.append(None)
                    continue
                node.append(int(mix(np.array([np.add.reduce(mix(s ^ _SALT[44])) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]))
                bits.append(bitmap(s, bitmap_bits(band_of(len(s)))).tobytes())
                if node[-1] not in seen:  # copies have no tokens of their own
                    seen.add(node[-1])
                    tokens = np.unique(np.concatenate(tokens_of(s, num, den)) >> (np.uint64(64) - _TOKEN_BITS))
                    held.append(tokens), rows.append(r)
                    size += len(tokens)
            yield _sketch_batch(len(sets), doc_id=batch.column("doc_id"), key=batch.column("key"), n_shingles=[len(s) for s in sets], row=row, node=node, bits=bits)
            if size >= LISTED:
                yield _lists(held, rows, parts)
                held, rows, seen, size = [], [], set(), 0
        if held:
            yield _lists(held, rows, parts)
        del held, rows
        release()

    return run


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, row) of the lists of part -1."""
    for batch in batches:
        for base, tokens, rows in zip(*(batch.column(c).to_pylist() for c in ("base", "tokens", "rows"))):
            token = unpack(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(_numbers(rows, len(token)) + base)], names=["token", "row"])


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """(token, row) of the tokens of one part that several lists have."""
    tokens = [unpack(x) for x in table.column("tokens").to_pylist()]
    rows = [_numbers(x, len(t)) + b for x, t, b in zip(table.column("rows").to_pylist(), tokens, table.column("base").to_pylist())]
    token, row = np.concatenate(tokens), np.concatenate(rows)
    del tokens, rows
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    return pa.table({"token": pa.array(token[same].view(np.int64)), "row": pa.array(row[same])})


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of more 64-bit words as ones of fewer: bit x goes to bit x modulo the new size."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(size_a, bits_a, size_b, bits_b, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the bitmaps (equal widths) allow the sets to be linked, and the similarity they allow; broadcasts over rows."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1).astype(np.int64)
    total = size_a + size_b
    most = np.maximum(np.minimum((total - differ) // 2, np.minimum(size_a, size_b)), 0)
    return (most > 0) & (den * most >= num * (total - most)), most / (total - most)


def _bound_pairs(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a_bits", "b_bits"))
            sa, sb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a_size", "b_size"))
            width = np.array([min(len(x), len(y)) // 8 for x, y in zip(a, b)], np.int64)
            keep = np.zeros(len(a), bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x, y = (np.concatenate([_fold(np.frombuffer(side[i], np.uint64)[None], w) for i in at]) for side in (a, b))
                keep[at] = may_link(sa[at], x, sb[at], y, num, den)[0]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Runs of rows of equal keys in sorted batches, as column lists; a run is bounded by how rows were salted."""
    held: dict[str, list] | None = None
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        ids = list(zip(*(rows[k] for k in keys)))
        at = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[at]:
                part = {c: v[at:i] for c, v in rows.items()}
                if held is not None and tuple(held[k][0] for k in keys) == ids[at]:
                    for c in held:
                        held[c] += part[c]
                else:
                    if held is not None:
                        yield held
                    held = part
                at = i
    if held is not None:
        yield held


def _verify(n: int, num: int, den: int):
    """Rows sorted by (a, salt, b is null first): the first has a's text, the others each a partner's. One set is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, np.zeros(0, np.uint64)
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, n)
            found_a, found_b = [], []
            for a, salt, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), sets):
                if b is None:
                    current, own = (a, salt), s
                elif (a, salt) == current and linked(own, s, num, den):
                    found_a.append(a), found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def _best(ok: np.ndarray, allowed: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each label of the rows the (row, column) that allows the highest similarity."""
    score = np.where(ok, allowed, -1)
    column = score.argmax(axis=1)
    top = score[np.arange(len(score)), column]
    order = np.lexsort((-top, label))
    first = order[np.flatnonzero(np.diff(label[order], prepend=label[order[:1]] - 1))]
    first = first[top[first] >= 0]
    return first, column[first]


def _tiles(num: int, den: int, best: bool):
    """Pairs of different components within a tile's block, or across its two blocks, that the bitmaps allow; or only
    the most promising one for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["tile", "i", "j"]):
            node, size, label = (np.array(g[c], np.int64) for c in ("node", "size", "label"))
            width = min(map(len, g["bits"])) // 8
            bits = np.concatenate([_fold(np.frombuffer(x, np.uint64)[None], width) for x in g["bits"]])
            block = np.array(g["block"], np.int64)
            left = np.flatnonzero(block == g["i"][0])
            right = np.flatnonzero(block == g["j"][0])
            step = max(1, (1 << 21) // max(1, len(right) * width))
            out = [np.zeros((2, 0), np.int64)]
            for at in range(0, len(left), step):
                x, y = left[at : at + step, None], right[None, :]
                ok, allowed = may_link(size[x], bits[x], size[y], bits[y], num, den)
                ok &= label[x] != label[y]
                if not best:
                    p, q = np.nonzero(ok)
                    out.append(np.stack([node[left[at + p]], node[right[q]]]))
                elif ok.any():
                    for turned in (False, True):
                        of = right if turned else left[at : at + step]
                        p, q = _best(ok.T, allowed.T, label[of]) if turned else _best(ok, allowed, label[of])
                        out.append(np.stack([node[of[p]], node[(left[at : at + step] if turned else right)[q]]]))
            a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column.ravel()]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[np.argsort(column, kind="stable")]
    column = np.sort(column)
    out = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, int(column[-1]) + 1, _COLUMNS):
        a, b = np.searchsorted(column, (first, first + _COLUMNS))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[of[a:b], column[a:b] - first] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _inside(n: int, num: int, den: int, pairs: bool):
    """All links within a component's block, or across its two blocks: as pairs, or added up for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["label", "i", "j"]):
            sets, at, size = [], 0, 0
            for k, t in enumerate(g["text"], 1):
                size += len(t)
                if size >= CHUNK_BYTES or k == len(g["text"]):
                    sets += shingle_sets(g["text"][at:k], n)
                    at, size = k, 0
            node, copies, block = (np.array(g[c], np.int64) for c in ("node", "copies", "block"))
            left, right = np.flatnonzero(block == g["i"][0]), np.flatnonzero(block == g["j"][0])
            both = _common(sets, left, right)
            size = np.array([len(s) for s in sets], np.int64)
            ok = (both > 0) & (den * both >= num * (size[left][:, None] + size[right][None, :] - both))
            one = g["i"][0] == g["j"][0]
            if pairs:
                p, q = np.nonzero(np.triu(ok, 1) if one else ok)
                yield pa.RecordBatch.from_arrays([pa.array(node[left[p]]), pa.array(node[right[q]]), pa.array(both[p, q])], names=["a", "b", "n_common"])
                continue
            if one:
                np.fill_diagonal(ok, False)
            found = [(node[left], ok @ copies[right])] + ([] if one else [(node[right], copies[left] @ ok)])
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["node", "n"])

    return run


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A hash of a row's id and text, by which rows are fetched again: neither needs to be unique, nor the id be there."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def _classes(docs: DataFrame, n: int, num: int, den: int, text: str, doc_id: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with keys and texts; their sketches; nodes; and (node, label) of the nodes that have links."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    parts = max(1, -(-(source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART_BYTES))
    written = scratch.write(source.mapInArrow(_sketches(n, num, den, parts), SKETCH))
    sketch = written.where("part is null").select("doc_id", "key", "n_shingles", "row", "node", "bits")
    full = sketch.where("node is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("least")
    nodes = full.groupBy("node").agg(least, F.first("n_shingles").alias("size"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
    nodes = scratch.write(nodes.select("node", "least.doc_id", "least.key", "size", "bits", "copies"))
    local = written.where("part = -1").select("base", "tokens", "rows").mapInArrow(_local, "token long, row long")
    across = written.where("part >= 0").select("part", "base", "tokens", "rows").groupBy("part").applyInArrow(_meet, "token long, row long")
    met = scratch.write(local.union(across))
    of = full.select("row", "node")
    listed = scratch.write(met.join(of, "row").select("token", "node").distinct())
    shared = listed.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").select("token", "hub")
    tiles = scratch.write(listed.join(shared, "token").select("token", "hub", "node"))
    scratch.drop(met, listed)

    first = tiles.where("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tried = scratch.write(_bounded(first, nodes, num, den))
    links = scratch.write(_exact(tried, nodes, source, scratch, n, num, den))
    labels = components(links, scratch)

    member = None
    for k in range(ROUNDS + 1):
        if member is None:
            member = scratch.write(tiles.select("token", "node").join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label")))
            open_tiles = member.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("least != most")
            open_tiles = scratch.write(open_tiles.groupBy("n", "who").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
            if open_tiles.isEmpty():
                break
        fresh = scratch.write(_across(member, open_tiles, nodes, num, den, k < ROUNDS).join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():  # all best partners are known not to be linked; now the others
            continue
        more = scratch.write(_exact(fresh, nodes, source, scratch, n, num, den))
        tried, links = tried.union(fresh), links.union(more)
        if not more.isEmpty():
            labels = components(links, scratch)
            scratch.drop(member, open_tiles)
            member = None
    return source, sketch, nodes, labels


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id", rows: bool = False, links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_linked_texts) for every row of docs; if rows, also key (its row_key) and
    class_id, which names the component even where no id does (null for a row without words); if links, also n_links, the
    number of other rows to whose texts the row's own is linked itself, equal ones included.

    Texts are linked when den * intersection >= num * union of their sets of n-word shingles; component_id is the
    smallest doc_id that is reachable. n_linked_texts counts the different sets in the component. A null text or one
    without words has no shingles and is alone; a null doc_id counts as a text without id: its component is the
    smallest id of its links, or null. Repeated rows come back as often as they came. Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        source, sketch, nodes, labels = _classes(docs, n, num, den, text, doc_id, scratch)
        named = nodes.join(labels, "node", "left").select("node", "doc_id", "copies", F.coalesce("label", "node").alias("label"))
        least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_linked_texts"), F.sum("copies").alias("n_rows"))
        which = named.join(least, "label").select("node", F.col("label").alias("class_id"), "component_id", "n_linked_texts", "copies", "n_rows")
        if links:
            inner = _links(nodes, labels, source, scratch, 3).mapInArrow(_inside(n, num, den, False), "node long, n long")
            which = which.join(scratch.write(inner.groupBy("node").agg(F.sum("n").alias("n"))), "node", "left")
            which = which.withColumn("n_links", F.when(F.col("n_linked_texts") > 2, F.col("n") + F.col("copies")).otherwise(F.col("n_rows")) - 1)
        out = sketch.select("doc_id", "key", "n_shingles", "node").join(which, "node", "left")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
        more = (["key", "class_id"] if rows else []) + ([F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else [])
        return scratch.write(out.select("doc_id", "n_shingles", component, F.coalesce("n_linked_texts", F.lit(1)).alias("n_linked_texts"), *more), keep=True)


def ngram_links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every link between two different sets once: (a_id, a_key, b_id, b_key, n_common). A set is named by the id and the
    row_key of one of its rows, that of the smallest id; n_common is the size of the intersection. A group of g sets has
    up to g * (g - 1) / 2 links."""
    with Scratch(docs.sparkSession) as scratch:
        source, _, nodes, labels = _classes(docs, n, num, den, text, doc_id, scratch)
        found = _links(nodes, labels, source, scratch, 2).mapInArrow(_inside(n, num, den, True), "a long, b long, n_common long")
        a, b = (nodes.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_id"), F.col("key").alias(f"{c}_key")) for c in "ab")
        return scratch.write(found.join(a, "a").join(b, "b").select("a_id", "a_key", "b_id", "b_key", "n_common"), keep=True)


def _links(nodes: DataFrame, labels: DataFrame, source: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """Texts of the components of at least so many nodes, once for every pair of blocks that a node is compared in."""
    sized = nodes.join(labels, "node").select("node", "label", "size", "copies")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / ELEMENTS)).cast("int").alias("blocks")
    blocks = sized.groupBy("label").agg(parts, F.count("*").alias("n")).where(F.col("n") >= least).select("label", "blocks")
    member = scratch.write(sized.join(blocks, "label").select("node", "label", "copies", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    rows = member.join(_texts(member.select("node"), nodes, source, scratch), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", F.col("text").cast("binary").alias("text"))
    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")


def _bounded(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    a, b = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")) for c in "ab")
    both = pairs.join(b, "b").join(a, "a").where(f"{den} * least(a_size, b_size) >= {num} * greatest(a_size, b_size)")
    return both.select("a", "b", "a_size", "b_size", "a_bits", "b_bits").mapInArrow(_bound_pairs(num, den), "a long, b long")


def by_key(rows: DataFrame, keys: DataFrame, many: int, on: str = "key", how: str = "inner") -> DataFrame:
    """rows joined with a table of many keys, which is broadcast if that is few enough."""
    return rows.join(F.broadcast(keys) if many <= MAX_BROADCAST_IDS else keys, on, how)


def _texts(needed: DataFrame, nodes: DataFrame, source: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text): the text of one row of each needed node."""
    keys = scratch.write(nodes.join(needed, "node").select("node", "key"))
    many = keys.count()
    texts = scratch.write(by_key(source, keys, many).select("node", "text"))
    return texts if texts.count() == many else scratch.write(texts.dropDuplicates(["node"]))  # rows that repeat id and text


def _exact(pairs: DataFrame, nodes: DataFrame, source: DataFrame, scratch: Scratch, n: int, num: int, den: int) -> DataFrame:
    """The pairs that are linked. Each a's text goes once to each of its runs, of about RUN partners' texts."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, source, scratch)
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    theirs = pairs.join(runs, "a").join(texts.withColumnRenamed("node", "b"), "b").select("a", F.pmod(F.xxhash64("b"), "runs").cast("int").alias("salt"), "b", "text")
    own = runs.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    return own.union(theirs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_verify(n, num, den), "a long, b long").distinct()


def _across(member: DataFrame, open_tiles: DataFrame, nodes: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    rows = member.join(open_tiles, "token").join(nodes, "node").select(F.col("token").alias("tile"), "node", "label", "size", "bits", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "size", "bits")
    return rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(_tiles(num, den, best), "a long, b long").where("a != b").distinct()
