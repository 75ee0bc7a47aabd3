"""A byte-level BPE vocabulary as sorted arrays, and two vectorised ways to apply it to many words at once.

``Vocabulary.encode`` runs merge rounds over the symbols of all words in one flat array. ``Vocabulary.count`` runs a
matching automaton over the bytes of all words and accepts a token only if it is compatible with the token before it,
which gives the number of tokens of the exact encoding in time linear in the bytes, without making the ids.

The arrays are small (a few MB, fixed by the vocabulary, not by the data), so the driver builds them once and
broadcasts them.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

#: Where the vocabulary files lie unless the caller or the environment names another folder.
TOKENIZERS = os.environ.get("PASSAGEMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed: the pattern that splits a text into words before the merges of the byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(0x7FFFFFFF)


@lru_cache(1)
def _words():
    return regex.compile(WORDS)


def split_words(text: str) -> list[str]:
    return _words().findall(text)


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key among the sorted ones, -1 where there is none; a binary search."""
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


@dataclass
class Vocabulary:
    byte_ids: np.ndarray  # id of each single byte
    pair_keys: np.ndarray  # left << 32 | right of every pair that merges, sorted
    pair_ids: np.ndarray  # id of the merged token, which is also its rank
    left: np.ndarray  # the two tokens that a token is merged from; itself for single bytes
    right: np.ndarray
    lengths: np.ndarray  # bytes of each token
    edge_keys: np.ndarray  # state << 8 | byte of every trie edge, sorted
    edge_to: np.ndarray
    fail: np.ndarray  # longest proper suffix state
    ends: np.ndarray  # longest token that ends in a state
    shorter: np.ndarray  # next shorter token that ends where a token ends, -1 if none

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the offset of each word in it (one more than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self._ranks(flat, word)
        while len(flat):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(flat)])
            open_ = np.repeat(lowest != NONE, size)
            if not open_.all():
                done.append((word[~open_], flat[~open_]))
                flat, word, rank = flat[open_], word[open_], rank[open_]
                lowest, size = lowest[lowest != NONE], size[lowest != NONE]
                if not len(flat):
                    break
            hit = rank == np.repeat(lowest, size)
            # of overlapping pairs of one rank, such as in "aaa", the first, third and so on merge
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
            first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            flat[at] = rank[at]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            changed = np.zeros(len(flat), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            # a merged-away neighbour is dropped below, so its mark moves to the symbol that took its place
            before = at[at > 0] - 1
            before = before[~keep[before]] - 1
            changed[before] = True
            flat, word, rank, changed = flat[keep], word[keep], rank[keep], changed[keep]
            at = np.flatnonzero(changed)
            rank[at] = self._ranks_at(flat, word, at)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        owner, ids = (np.concatenate(x) for x in zip(*done))
        ids = ids[np.argsort(owner, kind="stable")]
        offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]
        return ids.astype(np.int32), offsets

    def _ranks(self, flat: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._ranks_at(flat, word, np.arange(len(flat)))

    def _ranks_at(self, flat: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the merge of each symbol with the next one, NONE where they don't merge or the word ends."""
        out = np.full(len(at), NONE, np.int32)
        near = np.flatnonzero(at < len(flat) - 1)
        a = at[near]
        near, a = near[word[a] == word[a + 1]], a[word[a] == word[a + 1]]
        k = _find(self.pair_keys, flat[a].astype(np.int64) << 32 | flat[a + 1])
        out[near[k >= 0]] = self.pair_ids[k[k >= 0]]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        starts = np.r_[0, np.cumsum(lengths)[:-1]][order]
        flat = np.frombuffer(b"".join(words), np.uint8)
        last = np.full(len(flat), -1, np.int32)  # the token that ends at a byte in the encoding of all up to it
        tokens = np.zeros(len(flat), np.int32)  # how many tokens that encoding has
        state = np.zeros(len(words), np.int32)
        for depth in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -depth, "left"))  # words longer than depth
            at = starts[:live] + depth
            state = self._step(state[:live], flat[at])
            token = self.ends[state].copy()
            open_ = np.arange(live)
            while len(open_):
                t = token[open_]
                back = depth - self.lengths[t]
                before = np.where(back >= 0, last[at[open_] - self.lengths[t]], -1)
                fits = back < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self._compatible(before[inner], t[inner])
                good = open_[fits]
                last[at[good]] = t[fits]
                tokens[at[good]] = 1 + np.where(back[fits] >= 0, tokens[at[good] - self.lengths[t[fits]]], 0)
                open_ = open_[~fits]
                token[open_] = self.shorter[token[open_]]
        out = np.zeros(len(words), np.int64)
        full = size > 0
        out[order[full]] = tokens[(starts + size - 1)[full]]
        return out

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's state after one more byte; follows suffix links where a state has no such edge."""
        state, out = state.astype(np.int64), np.zeros(len(state), np.int32)
        open_ = np.arange(len(state))
        while len(open_):
            k = _find(self.edge_keys, state[open_] << 8 | byte[open_])
            out[open_[k >= 0]] = self.edge_to[k[k >= 0]]
            open_ = open_[k < 0]
            state[open_] = self.fail[state[open_]]  # every byte is a token, so the root has all edges
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of token a followed by those of token b encode to just these two tokens.

        Both are taken apart again, the later merge first. At each step the two parts that meet at the seam would have
        merged, had their merge come before the one that is taken apart.
        """
        good = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            k = _find(self.pair_keys, a << 32 | b)
            bad = (k >= 0) & (self.pair_ids[k] < limit)
            good[at[bad]] = False
            a_first = (a > b) & (self.left[a] != a) | (self.left[b] == b)
            over = (self.left[a] == a) & (self.left[b] == b)
            go = ~bad & ~over
            at, a, b, a_first = at[go], a[go], b[go], a_first[go]
            # a's merge has the priority among equals as it lies to the left: b's parts may not meet what a still is
            limit = np.where(a_first, a, b + 1)
            a, b = np.where(a_first, self.right[a], a), np.where(a_first, b, self.left[b])
        return good


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(4)
def load(name: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> Vocabulary:
    return build(read_ranks(os.path.join(folder, name)))


def build(tokens: list[bytes]) -> Vocabulary:
    ids = {t: i for i, t in enumerate(tokens)}
    byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
    pairs: dict[int, int] = {}
    for t, i in ids.items():
        for cut in range(1, len(t)):
            a, b = ids.get(t[:cut]), ids.get(t[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = i
    pair_keys = np.array(sorted(pairs), np.int64)
    pair_ids = np.array([pairs[k] for k in pair_keys.tolist()], np.int32)

    left = np.arange(len(tokens), dtype=np.int32)
    right = left.copy()
    for t, i in ids.items():
        if len(t) > 1:
            left[i], right[i] = _last_merge(t, ids)

    edges: list[dict[int, int]] = [{}]
    token_of = [-1]
    for i, t in enumerate(tokens):
        s = 0
        for b in t:
            if b not in edges[s]:
                edges[s][b] = len(edges)
                edges.append({})
                token_of.append(-1)
            s = edges[s][b]
        token_of[s] = i
    fail = np.zeros(len(edges), np.int32)
    ends = np.array(token_of, np.int32)
    shorter = np.full(len(tokens), -1, np.int32)
    queue = deque(edges[0].values())
    while queue:
        s = queue.popleft()
        if token_of[s] >= 0:
            shorter[token_of[s]] = ends[fail[s]]
        else:
            ends[s] = ends[fail[s]]
        for b, to in edges[s].items():
            f = int(fail[s])
            while b not in edges[f] and f:
                f = int(fail[f])
            fail[to] = edges[f].get(b, 0) if s else 0
            queue.append(to)
    keys = np.array([s << 8 | b for s, e in enumerate(edges) for b in e], np.int64)
    to = np.array([x for e in edges for x in e.values()], np.int32)
    order = np.argsort(keys)
    return Vocabulary(byte_ids, pair_keys, pair_ids, left, right, np.array([len(t) for t in tokens], np.int64), keys[order], to[order], fail, ends, shorter)


def _last_merge(token: bytes, ids: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens that ``token`` is at last merged from."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        ranks = [ids.get(parts[i] + parts[i + 1], len(ids)) for i in range(len(parts) - 1)]
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ids[parts[0]], ids[parts[1]]
