"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of tokens that are popped on the way along it, worked out once:
a node that spells a token pops it and fails to the root; another node pops what its parent's link pops, and so on, until the
rest of its string stands in the trie again. Reading a word so never goes back: where the trie has no edge for the next byte, the
popped count is added and the link followed. The count equals that of greedy longest-match pieces, none of which is built.

Vocabulary tokens with the ending ``</w>`` match at the end of a word only. A word any of whose bytes starts no token counts as one
unknown token. Words are the runs of `[^\\x20\\x09-\\x0D]`, A-Z lower-cased."""

import json

import numpy as np
from pyspark.sql import DataFrame

from boutline.llm.bpe import byte_letters
from boutline.llm.bytesops import LOWER, Codes, mix, segment_hashes, text_bytes, words
from boutline.llm.common import arrow_map

END = 256
ENDING = "</w>"
DEAD = -1
MOST_WORDS = 2_000_000


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Tokens of a byte-level vocabulary file as byte values, END for the word end; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for token in spec["model"]["vocab"]:
        body, last = (token[:-len(ENDING)], (END,)) if token.endswith(ENDING) else (token, ())
        if body and all(c in byte_of for c in body):
            out.append(tuple(byte_of[c] for c in body) + last)
    return out


class Automaton:
    def __init__(self, tokens):
        edges: list[dict[int, int]] = [{}]
        token_at = {}
        for token in [*tokens, (END,)]:
            node = 0
            for c in token:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                node = edges[node][c]
            token_at[node] = 0 if token == (END,) else 1  # the end alone is no token
        n = len(edges)
        self.fail, self.pops = np.full(n, DEAD, np.int64), np.zeros(n, np.int64)
        fail, pops, layer = [DEAD] * n, [0] * n, [0]
        while layer:
            below = []
            for u in layer:
                for c, v in edges[u].items():
                    below.append(v)
                    if v in token_at:
                        fail[v], pops[v] = 0, token_at[v]
                        continue
                    z, count = fail[u], pops[u]
                    while z != DEAD and c not in edges[z]:
                        count += pops[z]
                        z = fail[z]
                    if z != DEAD:
                        fail[v], pops[v] = edges[z][c], count
            layer = below
        self.fail[:], self.pops[:] = fail, pops
        keys = np.array([u * 257 + c for u, e in enumerate(edges) for c in e], np.uint64)
        self.edges = Codes(18)
        self.edges.add(mix(keys))
        self.to = np.array([v for e in edges for v in e.values()], np.int64)
        self.clear()

    def clear(self):
        self.known, self.counts = Codes(), np.zeros(1 << 14, np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        found = self.edges.find(mix(state.astype(np.uint64) * np.uint64(257) + symbol.astype(np.uint64)))
        return np.where(found < 0, DEAD, self.to[found])

    def count(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word raw[start:end]; all words move on by one byte at a time."""
        order = np.argsort(starts - ends, kind="stable")  # longest first, so those that go on are a prefix
        begin, size = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live = np.ones(len(order), bool)
        for i in range(int(size[0]) + 1 if len(size) else 0):
            k = int(np.searchsorted(-size, -i, side="right"))
            at = np.flatnonzero(live[:k])
            symbol = np.where(size[at] == i, END, raw[np.minimum(begin[at] + i, len(raw) - 1)].astype(np.int64))
            while len(at):
                to = self.step(state[at], symbol)
                ok = to != DEAD
                state[at[ok]] = to[ok]
                at, symbol = at[~ok], symbol[~ok]
                total[at] += self.pops[state[at]]
                state[at] = self.fail[state[at]]
                gone = state[at] == DEAD
                live[at[gone]] = False
                total[at[gone]] = 1
                at, symbol = at[~gone], symbol[~gone]
        at = np.flatnonzero(live & (state != 0))
        while len(at):  # what the walk still holds
            total[at] += self.pops[state[at]]
            state[at] = self.fail[state[at]]
            gone = state[at] == DEAD
            total[at[gone]] = 1
            at = at[(state[at] != 0) & ~gone]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def text_counts(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text. A word met before is not read again; what is kept is bounded by MOST_WORDS."""
        raw = LOWER[raw]
        starts, ends, per = words(raw, bounds)
        if self.known.size > MOST_WORDS:
            self.clear()
        h = segment_hashes(raw, starts, ends)
        code = self.known.find(h)
        if len(new := np.flatnonzero(code < 0)):
            fresh, first = np.unique(h[new], return_index=True)
            at = new[first]
            got = self.count(raw, starts[at], ends[at])
            where = self.known.add(fresh)
            while self.known.size > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.counts[where] = got
            code[new] = self.known.find(h[new])
        return np.diff(per), np.diff(np.concatenate([[0], np.cumsum(self.counts[code])])[per])


_held: dict = {}


def automaton(path: str) -> Automaton:
    """One automaton per worker process and file."""
    if path not in _held:
        _held[path] = Automaton(vocabulary(path))
    return _held[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` per row: the words of the whole text and its greedy longest-match tokens.

    A null text has none; repeated rows give repeated results, an empty table none; other columns are not read."""

    def run(batch):
        n_words, n_tokens = automaton(path).text_counts(*text_bytes(batch.column("text")))
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_tokens": n_tokens}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def greedy_count(tokens: set, word: bytes, longest: int) -> int:
    """The plain definition, for tests: the longest token (``longest`` symbols at most) at each place, one after another."""
    symbols, at, n = (*word, END), 0, 0
    while at < len(word):
        end = next((e for e in range(min(len(symbols), at + longest), at, -1) if symbols[at:e] in tokens), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n

