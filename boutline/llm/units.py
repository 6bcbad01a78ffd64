"""Token ids of whole texts from the ids of their units, which repeat and so are encoded once.

A tokenizer that cuts texts by a pattern before it merges never lets a token reach across a single space between two visible
characters, nor from an ASCII letter to an ASCII sign behind it. So the ids of a text are those of the units between such
places, one after another. Texts that hold the opening of a special token are encoded whole."""

import json
import os
from itertools import chain

import numpy as np

from boutline.llm.bytesops import LOWER, Codes, ragged, segment_hashes
from boutline.llm.common import give_back

MOST_UNITS = 1_000_000
MOST_IDS = 6_000_000
SOME = 2000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
SIGN = np.zeros(256, bool)
SIGN[33:127] = True
SIGN &= ~LETTER
VISIBLE = np.ones(256, bool)  # bytes next to a space that are no part of any white space character
VISIBLE[:33] = VISIBLE[127] = False
WIDE = np.zeros(256, bool)  # first bytes of characters among which are white space ones
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(raw: np.ndarray, bounds: np.ndarray, lead: bool) -> np.ndarray:
    """Ascending starts of the units. ``lead``: a unit begins with its space; else spaces carry no tokens."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    mark = np.zeros(n, bool)
    p = np.flatnonzero(raw == 32)
    if lead:
        p = p[(p >= 3) & (p + 1 < n)]
        p = p[VISIBLE[raw[p - 1]] & VISIBLE[raw[p + 1]] & ~WIDE[raw[p + 1]] & (raw[p - 2] != 0xC2) & ~WIDE[raw[p - 3]]]
    mark[p] = True
    if not lead:
        mark[raw == 10] = True
    q = np.flatnonzero(LETTER[raw[:-1]] & SIGN[raw[1:]]) + 1
    mark[q] = True
    mark[bounds[:-1][bounds[:-1] < n]] = True
    return np.flatnonzero(mark)


class Units:
    """``encode(units) -> list of id lists``. ``lead``: white space carries tokens (byte-level vocabularies). ``fold``: the
    tokenizer lower-cases, so A-Z may be folded before. What is kept is bounded by MOST_UNITS and MOST_IDS, then dropped."""

    def __init__(self, encode, lead: bool, fold: bool = False):
        self.encode, self.lead, self.fold = encode, lead, fold
        self.clear()

    def clear(self):
        self.codes, self.flat, self.used = Codes(), np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _keep(self, lists) -> None:
        n, at = len(lists), self.codes.size
        lengths = np.fromiter(map(len, lists), np.int64, n)
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        self.starts[at:at + n] = self.used + np.cumsum(lengths) - lengths
        self.sizes[at:at + n] = lengths
        self.used += total

    def ids(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text's ids (one more than texts)."""
        whole = self._special(raw, bounds)
        if whole is not None:
            return whole
        if self.codes.size > MOST_UNITS or self.used > MOST_IDS:
            self.clear()
        if self.fold:
            raw = LOWER[raw]
        starts = cuts(raw, bounds, self.lead)
        ends = np.append(starts[1:], len(raw))
        h = segment_hashes(raw, starts, ends)
        codes = self.codes.find(h)
        if len(new := np.flatnonzero(codes < 0)):
            fresh, first = np.unique(h[new], return_index=True)
            at, data = new[first], raw.tobytes()
            lists = self.encode([data[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            self._keep(lists)
            self.codes.add(fresh)
            codes[new] = self.codes.find(h[new])
        sizes = self.sizes[codes]
        flat = self.flat[ragged(self.starts[codes], sizes)]
        return flat, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)]

    def _special(self, raw, bounds):
        """Texts with the opening of a special token go whole to the encoder; None where there is none."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        hits = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        if not len(hits):
            return None
        odd = np.unique(np.searchsorted(bounds, hits, side="right") - 1)
        flats, sizes, data = [], [], raw.tobytes()
        edges = np.unique(np.concatenate([[0, len(bounds) - 1], odd, odd + 1])).tolist()
        for a, b in zip(edges, edges[1:]):
            if a in odd:
                lists = self.encode([data[bounds[a]:bounds[b]].decode()])
                flats.append(np.array(lists[0], np.uint32))
                sizes.append([len(lists[0])])
            else:
                f, c = self.ids(raw[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                flats.append(f)
                sizes.append(np.diff(c))
        return np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


class Whole:
    """Texts encoded whole, for vocabularies that do not cut as the units assume."""

    def __init__(self, encode):
        self.encode = encode

    def ids(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, at = raw.tobytes(), bounds.tolist()
        lists = self.encode([data[a:b].decode() for a, b in zip(at, at[1:])])
        return np.array([i for ids in lists for i in ids], np.uint32), np.cumsum([0] + [len(x) for x in lists]).astype(np.int64)


# The pre-tokenizers and the normalizer for which `cuts` was made.
BYTE_LEVEL = [("ByteLevel", False, True)]
WORD_SPLIT = ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"]
WORD_NORMAL = ["NFC", "Replace", "Lowercase"]


def fits(described: dict, lead: bool) -> bool:
    """Whether a tokenizer (its file) cuts texts as the units do and its added tokens open as `Units._special` expects."""
    plain = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in described.get("added_tokens") or [])
    normal, first = described.get("normalizer"), described.get("pre_tokenizer") or {}
    steps = first.get("pretokenizers", [first])
    level = [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps]
    if lead:
        return plain and normal is None and level == BYTE_LEVEL
    split = [x.get("pattern", {}).get("Regex") for x in steps[:1]]
    return plain and split == WORD_SPLIT and level[1:] == [("ByteLevel", False, False)] and [x["type"] for x in (normal or {}).get("normalizers", [])] == WORD_NORMAL


_held: dict = {}


def library(path: str, lead: bool) -> Units | Whole:
    """Units (or whole texts, see `fits`) encoded by the tokenizers library from the vocabulary at ``path``; one per worker process."""
    if path not in _held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def encode(units):
            out = []
            for a in range(0, len(units), SOME):  # an encoding object is much larger than its ids
                out += [e.ids for e in tok.encode_batch_fast(units[a:a + SOME], add_special_tokens=False)]
            return out

        _held[path] = Units(encode, lead, not lead) if fits(json.loads(tok.to_str()), lead) else Whole(encode)
        give_back()  # reading the file takes several times what is kept of it
    return _held[path]
