"""What new and known words cost the tokenizer, words of all sizes, slots that clash, and carries in the range coder."""

import time

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidelocus.llm import bpe, mixing

from .test_llm import PATH


def spent(f):
    began = time.thread_time()
    f()
    return time.thread_time() - began


def made_up(n):
    """Words of syllables, few of which are tokens."""
    rng = np.random.default_rng(2)
    syllables = np.array([a + b + c for a in "bdfglmnrst" for b in "aeiou" for c in ("", "n", "r", "st")])
    return ["".join(x) for x in syllables[rng.integers(0, len(syllables), (n, 4))]]


def test_cost():
    """100,000 new words, and then two million known ones, in sorts of a million numbers: 7.7 when this was written, 14.9 before."""
    unit = min(spent(lambda: np.argsort(x, kind="stable")) for x in np.random.default_rng(1).integers(0, 1 << 40, (3, 1 << 20)))
    words = made_up(100_000)
    fresh = pa.array([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
    rng = np.random.default_rng(3)
    known = [pa.array([" ".join(words[i] for i in rng.integers(0, len(words), 100_000))]) for _ in range(20)]

    def once():
        codec = bpe.ByteBpe(PATH)
        return spent(lambda: codec.encode(fresh)) + spent(lambda: [codec.encode(x) for x in known])

    assert min(once() for _ in range(2)) / unit < 11


def same(codec, texts):
    library = Tokenizer.from_file(PATH)
    ids, bounds = codec.encode(pa.array(texts, pa.string()))
    return all(library.encode(t, add_special_tokens=False).ids == ids[a:b].tolist() for t, a, b in zip(texts, bounds, bounds[1:], strict=False))


def test_sizes():
    """Merges of words on both sides of every bound, and the table's bound of sizes."""
    rng = np.random.default_rng(4)
    sizes = [1, 2, 7, 8, 9, 13, 14, 15, 16, 17, 63, 64, 65, 510, 511, 512, 513, 514]
    texts = ["".join(rng.choice(list(letters), n)) for n in sizes * 3 for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "eéüñ")]
    texts += ["a" * n for n in sizes] + [" ".join(texts[:200]), "", "\0", "\0" * 9]
    codec = bpe.ByteBpe(PATH)
    assert same(codec, texts) and same(codec, texts[::-1])


def test_clashes_and_growth(monkeypatch):
    words = [" ".join(made_up(300)[k : k + 50]) for k in range(0, 300, 50)]
    codec = bpe.ByteBpe(PATH)
    codec.table.slots, codec.table.shift = np.full(16, -1, np.int32), np.uint64(60)
    assert same(codec, words) and len(codec.table.slots) >= 4 * codec.table.count
    monkeypatch.setattr(bpe, "MAX_TOKEN_WORDS", 100)
    assert same(codec, words) and same(codec, words[:2])
    monkeypatch.setattr(bpe.WordTable, "_slot", lambda self, low, high: np.full(len(low), len(self.slots) - 2))
    assert same(bpe.ByteBpe(PATH), words)


def test_two_words_of_one_hash():
    step = int(bpe._SPREAD_HIGH) * pow(int(bpe._SPREAD), -1, 1 << 64)
    one, two = (((12345 - k * step) % (1 << 64)).to_bytes(8, "little") + bytes([70 + k]) for k in (0, 1))
    table = bpe.WordTable(lambda new: (np.array([w[-1] for w in new]), np.ones(len(new), np.int64)))
    at = np.arange(0, 36, 9)
    index = table.look_up(np.frombuffer(one + two + two + one, np.uint8), at, at + 9)
    assert table.values[table.start[index]].tolist() == [70, 71, 71, 70] and table.count == 2


def test_carries():
    """Parts at the range's upper end, again and again, so that words that were emitted have to be carried into."""
    rng = np.random.default_rng(5)
    for rare in (2, 50, 4000):
        blocks = [np.where(rng.integers(0, rare, n) == 0, rng.integers(0, 9, n), 9) for n in (mixing.BLOCK,) * 40 + (3, 2000)]
        blocks += [np.append(np.full(4000, 60_000), rng.permutation(60_000)[:90]), np.append(np.full(4000, 1), rng.permutation(60_000)[:90])]
        assert all(np.array_equal(a, b) for a, b in zip(blocks, mixing.decode_blocks(mixing.encode_blocks(blocks, 16)), strict=True))
