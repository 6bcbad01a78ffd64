"""Byte-pair encoding and decoding by contiguous rank arrays.

A short word is a row of part ids with, beside it, the rank of each pair of neighbouring parts. Again and again the row is scanned
for its smallest rank, the boundary there is deleted (the parts behind move up by one place), and the two neighbouring ranks are
looked up anew, until no pair has a rank. Rows of like length are worked on together as one array. Words longer than SHORT
bytes, for which scans would be quadratic, keep their pairs in a heap."""

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from boutline.llm.bytesops import Codes, mix, ragged, text_bytes
from boutline.llm.common import arrow_map
from boutline.llm.units import Units

# Fixed value: the vocabulary's pattern, white space spelled out.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r\x20\x85\p{Z}\p{L}\p{N}]+|[\t-\r\x20\x85\p{Z}]+(?![^\t-\r\x20\x85\p{Z}])|[\t-\r\x20\x85\p{Z}]+")
SHORT = 128
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary file: printable Latin-1 for itself, the others
    from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class RankBpe:
    """Encoder and decoder for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.table = Codes(17)
        self.table.add(mix((left << np.uint64(32)) | right))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        top = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * top
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_sizes = np.fromiter(map(len, spelled), np.int64, top)
        self.spelled_starts = np.cumsum(self.spelled_sizes) - self.spelled_sizes
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.table.find(mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)))
        return np.where(found < 0, NONE, found)

    def merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part ids after all merges, and how many are left, for words of one length (rows)."""
        n, width = parts.shape
        size = np.full(n, width)
        if width == 1:
            return parts, size
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        rows, cols = np.arange(n), np.arange(width)
        live_parts, live_ranks = parts.copy(), ranks
        while True:
            at = live_ranks.argmin(1)
            best = live_ranks[np.arange(len(rows)), at]
            go = best != NONE
            if not go.all():
                parts[rows[~go]] = live_parts[~go]
                rows, live_parts, live_ranks, at, best = rows[go], live_parts[go], live_ranks[go], at[go], best[go]
            if not len(rows):
                return parts, size
            i = np.arange(len(rows))
            source = np.minimum(cols + (cols > at[:, None]), width - 1)
            live_parts = np.take_along_axis(live_parts, source, 1)
            live_ranks = np.take_along_axis(live_ranks, source, 1)
            size[rows] -= 1
            left = size[rows]
            live_ranks[:, -1] = NONE
            live_parts[i, at] = self.merged[best]
            for k in (at - 1, at):
                real = (k >= 0) & (k + 1 < left)
                live_ranks[i[k >= 0], k[k >= 0]] = NONE
                r, c = i[real], k[real]
                live_ranks[r, c] = self.ranks(live_parts[r, c], live_parts[r, c + 1])

    def merge_long(self, word: bytes) -> list[int]:
        """One long word: linked parts, pairs in a heap by (rank, place)."""
        parts = self.byte_ids[np.frombuffer(word, np.uint8)].astype(np.int64)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(parts[:-1], parts[1:])
        ids = parts.tolist()
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        dead = [False] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], dead[j], after[i] = int(self.merged[rank]), True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r = int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r != NONE:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, gone in zip(ids, dead) if not gone]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, all words given once."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for width in np.unique(sizes).tolist():
            where = np.flatnonzero(sizes == width)
            if width > SHORT:
                for i in where.tolist():
                    out[i] = self.merge_long(words[i])
                continue
            step = max(1, (1 << 18) // width)
            for a in range(0, len(where), step):
                some = where[a:a + step].tolist()
                raw = np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), width)
                parts, left = self.merge_rows(self.byte_ids[raw])
                for i, row, k in zip(some, parts.tolist(), left.tolist()):
                    out[i] = row[:k]
        return out

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of each text: special tokens first, then the pattern's words."""
        spec, cut = self.special, self.cut
        cutting = [[p for p in cut.split(u) if p] if cut and "<|" in u else [u] for u in units]
        found = [[p if p in spec else PATTERN.findall(p) for p in ps] for ps in cutting]
        distinct = list(dict.fromkeys(chain.from_iterable(w for ps in found for w in ps if not isinstance(w, str))))
        ids = dict(zip(distinct, self.words([w.encode() for w in distinct])))
        return [list(chain.from_iterable([spec[p]] if isinstance(p, str) else chain.from_iterable(map(ids.__getitem__, p)) for p in ps)) for ps in found]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id lists one after another, and their bounds."""
        sizes = self.spelled_sizes[ids]
        return self.spelled[ragged(self.spelled_starts[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])[bounds]


_held: dict = {}


def coder(path: str) -> tuple[RankBpe, Units]:
    """One coder per worker process and file."""
    if path not in _held:
        bpe = RankBpe(path)
        _held[path] = bpe, Units(bpe.encode, lead=True)
    return _held[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` per row: the token ids of the whole text (null: no ids)."""

    def run(batch):
        flat, bounds = coder(path)[1].ids(*text_bytes(batch.column("text")))
        return {"doc_id": batch.column("doc_id"), "ids": [a.tolist() for a in np.split(flat, bounds[1:-1])]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: each whole text is encoded, and its ids are decoded again.

    A null text is empty: no ids, and the digests of nothing. Repeated rows give repeated results, an empty table
    none; other columns are not read."""

    def run(batch):
        bpe, units = coder(path)
        flat, bounds = units.ids(*text_bytes(batch.column("text")))
        said, ends = bpe.decode(flat, bounds)
        ids, b, e = flat.astype("<u4").tobytes(), (bounds * 4).tolist(), ends.tolist()
        said = said.tobytes()
        return {
            "doc_id": batch.column("doc_id"), "n_tokens": np.diff(bounds),
            "ids_sha256": [hashlib.sha256(ids[x:y]).hexdigest() for x, y in zip(b, b[1:])],
            "decoded_sha256": [hashlib.sha256(said[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(e, e[1:])],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
