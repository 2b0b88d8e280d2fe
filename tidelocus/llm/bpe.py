"""Byte-level BPE: encode by speculating and verifying, decode by gathering token bytes.

For a batch of texts, in numpy:

1. Texts are cut into words as the tokenizer's pattern does (runs of letters, digits or other signs
   with one blank before them, contractions, white space), from character classes alone.
2. Words that this task hasn't seen are encoded together.  Greedy longest match over a trie of the
   vocabulary proposes tokens.  A proposal is the true encoding if every adjacent pair of tokens is
   compatible: stepping back through the merges that made both, no pair of symbols that stood
   side by side at some time had a merge of its own at that time.
3. Only words with an incompatible pair are merged exactly, lowest rank first, side by side in a grid of a column a word.
4. A table from word to tokens, at most ``MAX_TOKEN_WORDS`` words of ``MAX_BYTES`` bytes (then it starts anew; only
   speed depends on it), turns the words of the batch into ids by one gather.

Words of more than ``LONG`` bytes take the same steps one by one, their merges from a heap of pairs, so that
the time grows as n log n.

Texts are whole, never truncated, and rows never move: each executor task works on its own rows.
Edge cases: null and empty texts have no ids and decode to ""; strings of special tokens inside a
text become that token, as is the library's default; ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import add_columns, kept, keeps_columns
from .textbytes import SHORT, flat, gather, packed

OTHER, LETTER, DIGIT, SPACE = range(4)
MAX_WORDS, MAX_TOKEN_WORDS, MAX_BYTES = 300_000, 1_000_000, 64 << 20
LONG_BITS = 9
LONG = 1 << LONG_BITS
NEVER = np.int64(1) << 40
_SPREAD, _SPREAD_HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF, _TOP_BYTE = np.uint64(32), np.uint64(56)
#: Characters with Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions that the word pattern sets apart.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    major = "".join(map(lambda c: unicodedata.category(c)[0], map(chr, range(sys.maxunicode + 1))))
    kinds = np.frombuffer(major.encode(), np.uint8)
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = DIGIT
    out[WHITE] = SPACE
    return out


@lru_cache(1)
def _ascii() -> bytes:
    """The class of each byte below 0x80, else 0."""
    return classes()[:128].tobytes() + bytes(128)


def characters(data: np.ndarray) -> np.ndarray:
    """For each of the bytes in UTF-8 the class of its character."""
    kinds = np.frombuffer(bytearray(data).translate(_ascii()), np.uint8)
    place = np.flatnonzero(data >= 0xC0)
    if len(place):
        first = data[place].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = slice(None) if k == 1 else np.flatnonzero(size > k)
            point[more] = point[more] << 6 | data[place[more] + k] & 0x3F
        own = classes()[point]
        kinds[place] = kinds[place + 1] = own
        for k in (2, 3):
            more = np.flatnonzero(size > k)
            kinds[place[more] + k] = own[more]
    return kinds


def words(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """Word starts, ends, each text's first word (n + 1), and {word: index of special} for special strings."""
    kind = characters(data)
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    marks: list[tuple[int, int, int]] = []
    text = None
    for k, s in enumerate(special):
        text = data.tobytes() if text is None else text
        p = text.find(s)
        while p >= 0:
            q = p + len(s)
            if np.searchsorted(offsets, p, "right") == np.searchsorted(offsets, q, "left"):
                marks.append((p, q, k))
                p = text.find(s, q)
            else:
                p = text.find(s, p + 1)
    for a, b, _ in marks:
        cut[a] = cut[b] = True
    space = kind == SPACE
    opens = cut[:n].copy()
    opens[1:] |= kind[1:] != kind[:-1]
    joined = ~space & opens & ~cut[:n]
    joined[1:] &= data[:-1] == 0x20
    closing = space.copy()
    closing[:-1] &= ~space[1:] & ~cut[1:n]
    closing[-1:] = False
    wide = np.flatnonzero(closing & (data >= 0x80))
    if len(wide):
        # from the last byte of a character to its first
        closing[wide] = False
        while len(inner := np.flatnonzero(data[wide] < 0xC0)):
            wide[inner] -= 1
        closing[wide] = True
    start = np.append((opens & ~joined) | closing, True)
    quote = np.flatnonzero((data == 0x27) & start[:n])
    if len(quote):
        taken = np.zeros(n + 1, bool)
        for tail in CONTRACTIONS:
            fits = quote[quote + len(tail) < n]
            for k, c in enumerate(tail, 1):
                fits = fits[(data[fits + k] == ord(c)) & ~cut[fits + k]]
            fits = fits[~taken[fits]]
            taken[fits] = True
            start[fits + 1] = False
            start[fits + 1 + len(tail)] = True
    for a, b, _ in marks:
        start[a + 1 : b] = False
        start[a] = start[b] = True
    starts = np.flatnonzero(start[:n])
    ends = np.append(starts[1:], n)[: len(starts)]
    return starts, ends, np.searchsorted(starts, offsets), {int(np.searchsorted(starts, a)): k for a, _, k in marks}


def _longer(values: np.ndarray, least: int) -> np.ndarray:
    """The values and zeros after them, at least so many in all."""
    return np.append(values, np.zeros(max(least - len(values), len(values)), values.dtype))


class WordTable:
    """Values (arrays of ints) of words, learned as they come; ``learn(list of bytes) -> (flat, lengths)``.

    Words are told apart by their bytes: short ones by their packed bytes and size, which a table of open addressing
    holds, and longer ones as keys of a dictionary.
    """

    def __init__(self, learn):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.exact: dict[bytes, int] = {}
        self.count, self.bytes = 0, 0
        self.values, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        # free slots hold -1; the last place of the keys stays zero, which no word's key is
        self.low, self.high = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.slots, self.shift = np.full(1 << 18, -1, np.int32), np.uint64(64 - 18)

    def _no_room(self) -> bool:
        return self.count > MAX_WORDS or self.bytes > MAX_BYTES

    def _taught(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes()
        return self.learn([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Learn words, and the indices they get."""
        flat_values, lengths = self._taught(data, starts, ends)
        base = self.count
        self.count += len(starts)
        self.bytes += int((ends - starts).sum())
        if self.used + len(flat_values) > len(self.values):
            self.values = _longer(self.values, self.used + len(flat_values))
        if self.count >= len(self.start):
            self.start, self.size, self.low, self.high = (_longer(x, self.count + 1) for x in (self.start, self.size, self.low, self.high))
        self.values[self.used : self.used + len(flat_values)] = flat_values
        self.size[base : self.count] = lengths
        self.start[base : self.count] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat_values)
        return np.arange(base, self.count)

    def _place(self, at: np.ndarray, index: np.ndarray) -> None:
        """Give each index the first free slot from ``at`` on."""
        last = len(self.slots) - 1
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = index[free]
            left = self.slots[at] != index
            at, index = at[left] + 1 & last, index[left]

    def _hold(self, low: np.ndarray, high: np.ndarray, index: np.ndarray) -> None:
        """Enter keys that aren't in the table yet."""
        self.low[index], self.high[index] = low, high
        if 4 * self.count > len(self.slots):
            while 4 * self.count > len(self.slots):
                self.slots, self.shift = np.full(2 * len(self.slots), -1, np.int32), self.shift - np.uint64(1)
            index = np.flatnonzero(self.high[: self.count])
            low, high = self.low[index], self.high[index]
        self._place(self._slot(low, high), index)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        spread = high * _SPREAD_HIGH
        spread ^= spread >> _HALF
        spread += low
        spread *= _SPREAD
        spread ^= spread >> _HALF
        spread *= _SPREAD
        spread >>= self.shift
        return spread.view(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        last, at = len(self.slots) - 1, self._slot(low, high)
        out = self.slots[at]
        left = np.flatnonzero((self.low[out] != low) | (self.high[out] != high))
        left = left[out[left] >= 0]
        at = at[left]
        while len(left):
            at = at + 1 & last
            held = self.slots[at]
            out[left] = held
            more = (held >= 0) & ((self.low[held] != low[left]) | (self.high[held] != high[left]))
            left, at = left[more], at[more]
        return out

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The index of each word, after learning the new ones."""
        if self._no_room():
            self.clear()
        size = ends - starts
        low, high = packed(data, starts, ends)
        # the highest byte is free in a short word, and tells its size
        high |= (size + 1).astype(np.uint64) << _TOP_BYTE
        far = np.flatnonzero(size >= SHORT)
        out = self._find(low, high)
        out[far] = 0
        new = np.flatnonzero(out < 0)
        while len(new):
            # the first of each of these keys' hashes; of several keys with one hash the others are left to the next round
            lead = new[np.sort(np.unique(low[new] * _SPREAD + high[new] * _SPREAD_HIGH, return_index=True)[1])]
            self._hold(low[lead], high[lead], self._add(data, starts[lead], ends[lead]))
            out[new] = self._find(low[new], high[new])
            new = new[out[new] < 0]
        if len(far):
            text = data.tobytes()
            whole = [text[a:b] for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
            fresh = {w: k for k, w in zip(far[::-1].tolist(), whole[::-1], strict=True) if w not in self.exact}
            if fresh:
                lead = np.array(sorted(fresh.values()))
                self.exact.update(zip(sorted(fresh, key=fresh.__getitem__), self._add(data, starts[lead], ends[lead]).tolist(), strict=True))
            out[far] = [self.exact[w] for w in whole]
        return out


class TokenTable(WordTable):
    """Tokens of words, at most ``MAX_TOKEN_WORDS`` of some 60 bytes each; ``learn(bytes, n + 1 offsets) -> (flat, lengths)``."""

    def _no_room(self) -> bool:
        return self.count > MAX_TOKEN_WORDS or self.bytes > MAX_BYTES

    def _taught(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.learn(*gather(data, starts, ends - starts))


class Places:
    """The place of keys in an array of distinct ones (not negative), by a hash table with a quarter of its slots in use at most."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.none = np.uint64(64 - bits), len(keys)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        step = np.arange(len(keys))
        at = np.maximum.accumulate(slot[order] - step) + step if len(keys) else step
        # a free slot follows the last key
        size = max(1 << bits, int(at.max(initial=0)) + 1) + 1
        self.keys, self.place = np.full(size, -1, np.int64), np.full(size, self.none, np.int32)
        self.keys[at], self.place[at] = keys[order], order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or the number of keys for one that isn't there."""
        at = self._slot(keys)
        held = self.keys[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] += 1
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held >= 0)]
        return self.place[at]


class ByteBpe:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        vocab = {bytes(sign[c] for c in token): i for token, i in model["vocab"].items()}
        size = 1 + max(vocab.values())
        self.special = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
        size = max([size, *(i + 1 for _, i in self.special)])
        tokens = [b""] * size
        for b, i in [*vocab.items(), *self.special]:
            tokens[i] = b
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.size = size
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        pairs = []
        for k, pair in enumerate(model["merges"]):
            a, b = (bytes(sign[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocab[a + b]
            self.rank[made], self.left[made], self.right[made] = k, vocab[a], vocab[b]
            pairs.append((vocab[a] * size + vocab[b], k, made))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_rank, self.pair_made = (np.append(table[:, i], NEVER) for i in range(3))
        self.pair_place = Places(self.pair_keys[:-1])
        self.single = np.array([vocab[bytes([b])] for b in range(256)])
        # ranks with room for a row; without a merge all bits
        kind = np.int32 if len(pairs) < 1 << 31 - LONG_BITS else np.int64
        self.pair_first = np.append(self.pair_rank[:-1] << LONG_BITS, np.iinfo(kind).max).astype(kind)
        self.byte_first = self.pair_first[self.pair_place.find((self.single[:, None] * size + self.single).ravel())]
        self.rank_made = np.zeros(len(model["merges"]), np.int64)
        self.rank_made[self.pair_rank[:-1]] = self.pair_made[:-1]
        self._grow_trie(vocab)
        self.table = TokenTable(self.encode_words)

    def _grow_trie(self, vocab: dict[bytes, int]) -> None:
        step: dict[int, int] = {}
        ends = {0: -1}
        for token, i in vocab.items():
            node = 0
            for b in token:
                node = step.setdefault(node << 8 | b, len(step) + 1)
            ends[node] = i
        self.trie_keys = np.array(sorted(step), np.int64)
        self.trie_next = np.array([step[k] for k in self.trie_keys.tolist()], np.int64)
        self.trie_place = Places(self.trie_keys)
        # the node after two bytes
        one = np.array([step.get(b, -1) for b in range(256)])
        self.trie_two = np.array([step.get(a << 8 | b, -1) if a >= 0 else -1 for a in one.tolist() for b in range(256)], np.int64)
        self.trie_token = np.full(len(step) + 1, -1)
        self.trie_token[list(ends)] = list(ends.values())

    # long words go through dictionaries, of many times the arrays' size; few tasks have such words

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """The rank of each pair that has a merge, and what it makes."""
        return dict(zip(self.pair_keys[:-1].tolist(), zip(self.pair_rank[:-1].tolist(), self.pair_made[:-1].tolist(), strict=True), strict=True))

    @cached_property
    def trie_step(self) -> dict[int, int]:
        return dict(zip(self.trie_keys.tolist(), self.trie_next.tolist(), strict=True))

    @cached_property
    def trie_end(self) -> dict[int, int]:
        end = np.flatnonzero(self.trie_token >= 0)
        return dict(zip(end.tolist(), self.trie_token[end].tolist(), strict=True))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair among the merges, and its rank (``NEVER`` without one)."""
        at = self.pair_place.find(a * self.size + b)
        return at, self.pair_rank[at]

    def propose(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: tokens of all words, and the word of each."""
        word = np.flatnonzero(np.diff(offsets))
        at, last = offsets[word], offsets[word + 1]
        out_token, out_word = [], []
        while len(word):
            first = data[at]
            best, stop = self.single[first], at + 1
            live = np.flatnonzero(stop < last)
            node = self.trie_two[first[live].astype(np.int64) << 8 | data[stop[live]]]
            goes = node >= 0
            live, node = live[goes], node[goes]
            p = stop[live] + 1
            while len(live):
                token = self.trie_token[node]
                whole = token >= 0
                best[live[whole]], stop[live[whole]] = token[whole], p[whole]
                inside = p < last[live]
                live, node, p = live[inside], node[inside], p[inside]
                k = self.trie_place.find(node << 8 | data[p])
                goes = k < len(self.trie_keys)
                live, node, p = live[goes], self.trie_next[k[goes]], p[goes] + 1
            out_token.append(best)
            out_word.append(word)
            some = stop < last
            word, at, last = word[some], stop[some], last[some]
        # the k-th step gives the k-th token of each word that it still meets
        count = np.zeros(len(offsets) - 1, np.int64)
        for w in out_word:
            count[w] += 1
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for k, (t, w) in enumerate(zip(out_token, out_word, strict=True)):
            out[start[w] + k] = t
        return out, np.arange(len(count)).repeat(count)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of tokens side by side as it is."""
        good = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            _, rank = self._pairs(x, y)
            # of merges of one rank the leftmost comes first: that inside x before, that inside y after
            bad = (rank < NEVER) & (rank < x_until) & (rank <= y_until)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, x_until, y_until, rx, ry = (v[on] for v in (live, x, y, x_until, y_until, rx, ry))
            back_x = rx > ry
            x_until, y_until = np.where(back_x, rx, x_until), np.where(back_x, y_until, ry)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return good

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of all words from their bytes: in each round every word does its first merge."""
        size = np.diff(offsets)
        token, word, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for most in (8, 16, 64, LONG):
            some = np.flatnonzero((size > least) & (size <= most))
            if len(some):
                tokens, of = self._merge_grid(data, offsets[some], size[some])
                token.append(tokens)
                word.append(some[of])
            least = most
        token, word = np.concatenate(token), np.concatenate(word)
        order = np.argsort(word, kind="stable")
        return token[order], word[order]

    def _merge_grid(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of words of up to ``LONG`` bytes: a column a word, a row a byte; a merged symbol stays in its first row.

        The row below the last stands for no symbol; it makes no pair.
        """
        n, last = len(starts), int(sizes.max())
        row = np.arange(last)[:, None]
        inside = row < sizes
        byte = data[np.where(inside, starts + row, 0)]
        nothing = -self.size * (self.size + 2)
        token, after, before = np.full((last + 1, n), nothing, np.int64), np.full((last + 1, n), last), np.full((last + 1, n), last)
        token[:-1][inside] = self.single[byte[inside]]
        after[:-2] = np.where(inside[1:], row[1:], last)
        before[1:-1] = row[:-1]
        # rank and row of the pair that begins in each row, by column
        key = np.full((last + 1, n), self.pair_first[-1])
        pair = inside[1:]
        key[:-2][pair] = self.byte_first[byte[:-1][pair].astype(np.int64) << 8 | byte[1:][pair]]
        key[:-1] |= row.astype(key.dtype)
        flat_token, flat_after, flat_before = token.ravel(), after.ravel(), before.ravel()
        column = np.arange(n)
        while True:
            first = key.min(0)
            live = np.flatnonzero(first < self.pair_first[-1])
            if not len(live):
                break
            if 2 * len(live) < len(column):
                key, column, first, live = np.ascontiguousarray(key[:, live]), column[live], first[live], np.arange(len(live))
            first, own, width, flat_key = first[live].astype(np.int64), column[live], len(column), key.ravel()
            p = first & LONG - 1
            at = p * n + own
            q, o = flat_after[at], flat_before[at]
            gone = q * n + own
            r = flat_after[gone]
            made = self.rank_made[first >> LONG_BITS]
            flat_token[at], flat_token[gone] = made, nothing
            flat_after[at], flat_before[r * n + own] = r, p
            pairs = np.concatenate([flat_token[o * n + own] * self.size + made, made * self.size + flat_token[r * n + own]])
            held = self.pair_first[self.pair_place.find(pairs)]
            flat_key[q * width + live] = self.pair_first[-1]
            flat_key[o * width + live], flat_key[p * width + live] = held[: len(o)] | o.astype(key.dtype), held[len(o) :] | p.astype(key.dtype)
        token = np.ascontiguousarray(token[:-1].T)
        stays = token >= 0
        return token[stays], np.nonzero(stays)[0]

    def propose_long(self, word: bytes) -> np.ndarray:
        """Greedy longest match of one word."""
        step, ends, out = self.trie_step.get, self.trie_end.get, []
        at, n = 0, len(word)
        while at < n:
            node, p, best, stop = 0, at, -1, at
            while p < n and (node := step(node << 8 | word[p], -1)) >= 0:
                p += 1
                if (token := ends(node, -1)) >= 0:
                    best, stop = token, p
            out.append(best)
            at = stop
        return np.array(out, np.int64)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Exact BPE of one word: a heap of pairs by rank, then place, over a linked list of symbols."""
        first = self.single[np.frombuffer(word, np.uint8)]
        n, size, pairs = len(word), self.size, self.pairs
        _, rank = self._pairs(first[:-1], first[1:])
        some = np.flatnonzero(rank < NEVER)
        heap = (rank[some] * n + some).tolist()
        heapq.heapify(heap)
        token, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if token[i] < 0 or j == n:
                continue
            pair = pairs.get(token[i] * size + token[j])
            if pair is None or pair[0] != rank:
                continue  # one of the two has become another symbol since
            token[i], token[j] = pair[1], -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if pair := pairs.get(token[i] * size + token[k]):
                    heapq.heappush(heap, pair[0] * n + i)
            if h >= 0 and (pair := pairs.get(token[h] * size + token[i])):
                heapq.heappush(heap, pair[0] * n + h)
        return np.array([t for t in token if t >= 0], np.int64)

    def _encode_long(self, word: bytes) -> np.ndarray:
        token = self.propose_long(word)
        key = np.unique(token[:-1] * self.size + token[1:])
        return token if self.compatible(key // self.size, key % self.size).all() else self.merge_long(word)

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after another, and their number in each."""
        size = np.diff(offsets)
        far = np.flatnonzero(size > LONG)
        if not len(far):
            token, word = self._encode_short(data, offsets)
        else:
            near = np.flatnonzero(size <= LONG)
            token, word = self._encode_short(*gather(data, offsets[near], size[near]))
            more = [self._encode_long(data[offsets[i] : offsets[i + 1]].tobytes()) for i in far.tolist()]
            token = np.concatenate([token, *more])
            word = np.concatenate([near[word], np.repeat(far, [len(x) for x in more])])
            order = np.argsort(word, kind="stable")
            token, word = token[order], word[order]
        return token, np.bincount(word, minlength=len(size))

    def _encode_short(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token, word = self.propose(data, offsets)
        inner = np.flatnonzero(word[1:] == word[:-1])
        back, key = pd.factorize(token[inner] * self.size + token[inner + 1])
        wrong = np.zeros(len(offsets) - 1, bool)
        wrong[word[inner[~self.compatible(key // self.size, key % self.size)[back]]]] = True
        failed = np.flatnonzero(wrong)
        if len(failed):
            again, bounds = gather(data, offsets[failed], np.diff(offsets)[failed])
            more, of = self.merge(again, bounds)
            keep = ~wrong[word]
            token, word = np.concatenate([token[keep], more]), np.concatenate([word[keep], failed[of]])
            order = np.argsort(word, kind="stable")
            token, word = token[order], word[order]
        return token, word

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and n + 1 offsets."""
        data, offsets = flat(column)
        starts, ends, first, marks = words(data, offsets, tuple(s for s, _ in self.special))
        index = self.table.look_up(data, starts, ends)
        size, begin = self.table.size[index], self.table.start[index]
        ids, bounds = gather(self.table.values, begin, size)
        if marks:
            drop = np.zeros(len(ids), bool)
            place = np.array(sorted(marks))
            ids = ids.copy()
            for w in place.tolist():
                drop[bounds[w] + 1 : bounds[w + 1]] = True
                ids[bounds[w]] = self.special[marks[w]][1]
            ids, kept = ids[~drop], size.copy()
            kept[place] = 1
            bounds = np.append(0, np.cumsum(kept))
        return ids, bounds[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        data, bounds = gather(self.token_bytes, self.token_start[ids], self.token_size[ids])
        text, where = data.tobytes(), bounds[offsets].tolist()
        return [text[a:b] for a, b in zip(where, where[1:], strict=False)]


@kept(2)
def load(path: str) -> ByteBpe:
    """The vocabulary, read once in each Python worker."""
    return ByteBpe(path)


@keeps_columns("text", new=("ids",))
def encode(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` (``text``) with ``ids`` (array of int), as the tokenizer file at ``path`` gives them."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, bounds = load(path).encode(batch.column("text"))
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]

    return add_columns(documents, "ids array<int>", make)


@keeps_columns("ids", new=("decoded",))
def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows with ``ids`` and their text again as ``decoded``; null ids are none, bytes that aren't UTF-8 become U+FFFD."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column("ids")
        ids = np.asarray(lists.flatten())
        bounds = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0))))
        return [pa.array([b.decode("utf-8", "replace") for b in load(path).decode(ids, bounds)], pa.string())]

    return add_columns(encoded, "decoded string", make, text=None)
