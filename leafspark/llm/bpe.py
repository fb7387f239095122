"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that no vocabulary token contains can never come to lie inside one, as merges only build
tokens. So words are cut between such bytes, the fragments are encoded on their own (and remembered, as they recur),
and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowwise import struct_column

#: Bytes of fragments with their ids that a Python worker remembers, and half as many of stretches between white space;
#: longer ones are not remembered. Fragments of more symbols are merged by a heap.
MEMORY, LONGEST, HEAP_FROM = 64 << 20, 2048, 48
#: Texts of these characters only are normalised and split here: they have no combining marks, nothing in them changes
#: under NFC, and str.split() splits them where the pattern's white space stands. The rest goes through the library's
#: normaliser and splitter, whose Unicode tables may differ from Python's.
#: Letters whose lower case lies elsewhere are not among them.
SIMPLE = "".join(c for c in map(chr, (*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028), 0x20AC)) if all(ord(x) < 0x250 for x in c.lower()) or ord(c) > 0x250)


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """Remembers results of work up to limit bytes of keys and values, then begins anew."""

    def __init__(self, work, limit: int):
        super().__init__()
        self.work, self.limit, self.size = work, limit, 0

    def __missing__(self, key):
        value = self.work(key)
        if len(key) <= LONGEST:
            self.size += len(key) + len(value) + 200  # what two objects and their place take besides
            if self.size > self.limit:
                self.clear()
                self.size = 0
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of a BPE whose words end in a marked symbol, from the text of its description."""

    def __init__(self, description: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        data = json.loads(description)
        model = data["model"]
        end = self.end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or data["decoder"] or data["post_processor"] or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in data["added_tokens"]):
            raise ValueError("this kind of tokenizer is not supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.pairs = [(self.vocab[a], self.vocab[b]) for a, b in pairs]
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.ranks = {p: r for r, p in enumerate(self.pairs)}
        self.names = _byte_names()
        self.symbols = [self.vocab[c] for c in self.names], [self.vocab[c + end] for c in self.names]
        self.inside = self._pairs_inside()
        self.library = Tokenizer.from_str(description)
        self.byte_of = {c: b for b, c in enumerate(self.names)}
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters, digits = ("".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN")
        self.simple_words = re.compile(pattern.replace("\\p{L}", letters).replace("\\p{N}", digits)).findall
        self.unusual = re.compile(f"[^{re.escape(SIMPLE)}]").search
        self.split = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")").split if self.added else lambda t: [t]
        self.fragments = _Memo(self._merge, memory)
        self.ids = _Memo(self._ids_of_stretch, memory // 2)
        self.texts = _Memo(lambda ids: " ".join(self.token[int(i)] for i in ids.split()), memory // 2)

    def _pairs_inside(self) -> list[set[int]]:
        """For each byte the bytes that follow it inside some token; 256 more where the second ends a word."""
        place = {c: b for b, c in enumerate(self.names)}
        inside: list[set[int]] = [set() for _ in range(256)]
        for token in self.vocab:
            ends = token.endswith(self.end)
            bytes_ = [place[c] for c in (token[: -len(self.end)] if ends else token)]
            if ends and bytes_:
                bytes_[-1] += 256
            for a, b in zip(bytes_, bytes_[1:]):
                inside[a].add(b)
        return inside

    def cut(self, word: bytes) -> list[bytes]:
        """Fragments of a word; the one that ends it has a byte 255 more, which UTF-8 never has."""
        out, at, last = [], 0, len(word) - 1
        for i in range(last):
            if (word[i + 1] + 256 if i + 1 == last else word[i + 1]) not in self.inside[word[i]]:
                out.append(word[at : i + 1])
                at = i + 1
        out.append(word[at:] + b"\xff")
        return out

    def _merge(self, fragment: bytes) -> str:
        """Ids of a fragment: again and again the leftmost pair of the lowest rank is merged."""
        ids = [self.symbols[0][b] for b in fragment]
        if fragment[-1] == 255:
            ids[-2:] = [self.symbols[1][fragment[-2]]]
        if len(ids) > HEAP_FROM:
            return " ".join(map(str, self._merge_long(ids)))
        rank, never = self.ranks.get, len(self.pairs)
        ranks = [rank(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i : i + 2] = (self.merged[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), never)
        return " ".join(map(str, ids))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) and links between neighbours; entries that a merge has outdated are skipped."""
        n, rank = len(ids), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs[r] != (ids[i], ids[j]):
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank((ids[k], ids[after[k]]))) is not None:
                    heappush(heap, (r, k))
        return [i for i in ids if i >= 0]

    def _ids_of_words(self, words: list[bytes]) -> str:
        return " ".join([self.fragments[fragment] for word in words for fragment in self.cut(word)])

    def _ids_of_stretch(self, stretch: str) -> str:
        """Ids of lower-case text without white space."""
        return self._ids_of_words([w.encode() for w in self.simple_words(stretch)])

    def parts(self, text: str) -> list[str]:
        """Ids of the text's stretches and special tokens as text: decimal numbers joined by one space."""
        out: list[str] = []
        for k, piece in enumerate(self.split(text)):
            if k % 2:
                out.append(str(self.added[piece]))
            elif self.unusual(piece):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
                if words:
                    out.append(self._ids_of_words([bytes(map(self.byte_of.__getitem__, w)) for w, _ in words]))
            else:
                out += map(self.ids.__getitem__, piece.lower().split())
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in " ".join(self.parts(text)).split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space; this kind of description has no decoder of its own."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def digests(self, text: str) -> tuple[int, str, str]:
        parts = self.parts(text)
        ids = " ".join(parts)
        decoded = " ".join(map(self.texts.__getitem__, parts))
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def _codec(description) -> Codec:
    """One for each Python worker; description is broadcast and has the size of the vocabulary file."""
    if description.value not in _codecs:
        _codecs[description.value] = Codec(description.value)
    return _codecs[description.value]


def _read(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, text: str = "text") -> Column:
    """A column of ids. A null text has none."""
    description = _read(docs, path)
    return struct_column(lambda texts: [[_codec(description).encode((t or b"").decode()) for t in texts]], "ids array<int>", F.col(text))["ids"]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: the text is encoded with the vocabulary at path,
    and the ids are decoded. A null text counts as empty, which has no tokens; repeated rows come back as often as they
    came; texts of any length take time in proportion to it (times its logarithm, in a word without forced boundaries).
    Other columns are ignored."""
    description = _read(docs, path)

    def work(texts: list[bytes | None]) -> list:
        codec = _codec(description)
        rows = [codec.digests((t or b"").decode()) for t in texts]
        return [list(x) for x in zip(*rows)] or [[], [], []]

    column = struct_column(work, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", F.col("text"))
    return docs.select("doc_id", column.alias("_r")).select("doc_id", "_r.*")
