"""A very long text of few distinct words against very many windows of them."""

import random
import resource

import numpy as np
import pyarrow as pa

from tidelocus.llm import decontam
from tidelocus.llm.textbytes import word_hash


def index_of(texts):
    rows = []
    for i, t in enumerate(texts):
        words = t.split()
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        hashes = word_hash(raw, np.append(0, ends[:-1]), ends)
        shift = min(range(len(words)), key=lambda k: (words[k] != "b", k))
        rows.append({"win": t, "items": [str(i % 7)], "size": len(words), "shift": shift, "words": hashes.view(np.int64).tolist()})
    return decontam.Index(rows)


def brute(texts, wins, size):
    for t in texts:
        words = t.split()
        hit, items = [False] * len(words), set()
        for k in range(len(words) - size + 1):
            held = wins.get(" ".join(words[k : k + size]))
            if held is not None:
                hit[k : k + size] = [True] * size
                items.add(str(held % 7))
        yield sum(hit), sorted(items)


def test_two_words():
    rng = random.Random(3)
    wins = sorted({" ".join(rng.choice("ab") for _ in range(10)) for _ in range(700)})
    make = decontam._meet(index_of(wins))
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (3000, 9, 10, 0, 400)]
    got = make(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    want = list(brute(texts, {w: i for i, w in enumerate(wins)}, 10))
    assert got[1].to_pylist() == [n for n, _ in want] and got[3].to_pylist() == [i for _, i in want]


def test_memory_is_bounded():
    rng = random.Random(4)
    letters = ["ab", "ac", "ad"]
    wins = sorted({" ".join(["b", *(rng.choice(letters) for _ in range(9))]) for _ in range(12_000)})
    make = decontam._meet(index_of(wins))
    long = " ".join(rng.choice(["b", *letters]) for _ in range(100_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    make(pa.RecordBatch.from_arrays([pa.array([long])], names=["text"]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
