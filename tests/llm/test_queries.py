"""The registered queries and the pipeline's stages against plain Python, on a small folder of tables; odd tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelocus.llm import ann, bpe, chat, decontam, jaccard, pii, quality, queries, simhash, substring, token_cache, toxicity

from .test_jaccard import brute
from .test_llm import ALNUM, BASE, BLANKS, PATH, fine, fingerprint, lower, ranked, thue_morse

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def quality_of(text):
    """Junk repeats one word or shouts."""
    return int(text is not None and "!!" not in text and len(set(text.split())) > 20)


@pytest.fixture(scope="session")
def tables(texts, tmp_path_factory):
    """Documents (odd ones, good ones, junk, copies, near copies, benchmark passages, toxic ones, very long ones), labels and the rest."""
    top = tmp_path_factory.mktemp("tables")
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [prose(14) for _ in range(5)] + ["one two", ""]
    out = [t for _, t in texts if t is None or len(t) < 4000]
    for k in range(150):
        out.append(prose(rng.randint(60, 200)))
        out.append((prose(rng.randint(60, 120)).upper().replace(" ", "!! ")) if k % 2 else f"{rng.choice(words)} " * 90)
    for k in range(12):
        out.append(f"{prose(70)} {items[k % 5]} {prose(40)}")
        out.append(f"{prose(70)} mail me a{k}@b.co from 10.0.0.{k}, +1 (988) 555-24{k + 10}, token = \"{'0f1e2d3c' * 4}{k}\" {prose(50)}")
        out.append(" ".join(x if rng.random() > 0.08 else "zorkly" for x in prose(120).split()))
    base = prose(150).split()
    for k in range(20):
        out.append(" ".join([*base[: 140 + k % 3], f"end{k % 7}"]))
    out += [prose(30_000), *thue_morse(2048), "é" * 5000]
    docs = list(enumerate(out))
    write = lambda name, **columns: pq.write_table(pa.table(columns), top / f"{name}.parquet")
    write("documents", doc_id=[i for i, _ in docs], text=[t for _, t in docs], lang=["en"] * len(docs), source=["s"] * len(docs), n_chars=[len(t or "") for _, t in docs])
    labelled = [i for i, _ in docs if i % 7]
    write("labels", doc_id=labelled, quality=pa.array([quality_of(out[i]) for i in labelled], pa.int32()), toxic=pa.array([int("zorkly" in (out[i] or "")) for i in labelled], pa.int32()))
    write("benchmark", item_id=list(range(len(items))), text=items)
    write("conversations", conv_id=[1, 1, 2], turn=[0, 1, 0], role=["user", "assistant", "system"], text=["a", "b [INST]", None])
    x = np.random.default_rng(1).normal(size=(400, 12)).astype(np.float32)
    write("embeddings", vec_id=list(range(400)), embedding=list(x), label=[0] * 400)
    return str(top), docs, items, x


def found(spark, tables, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, tables[0]).collect()}


def test_op1(spark, tables):
    got = {}
    for r in queries.op1_ann(spark, tables[0]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: ranked(tables[3].astype(float), q, 20) for q in range(0, 400, 20)}
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want) and all(len(x) == 20 for x in got.values())


def test_op2(spark, tables):
    got = {r.conv_id: r for r in queries.op2_chat(spark, tables[0]).collect()}
    assert sorted(got) == [-7, 1, 2]
    odd = "</s>[INST] ok [/INST]"
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(odd), sha(odd))
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb [INST]\n") and got[2].turns_sha256 == sha("system\n\n")


def test_op3(spark, tables):
    got = found(spark, tables, "op3_pii")
    for i, t in tables[1]:
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if fine(kind, m[0]))
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[i].base_sha256 == sha(shown) and set(shown.split(",")) - {""} <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in spans) for k in BASE]
        planted = [f"secret:{m.start()}:{m.end()}" for m in re.finditer(r'token = "(0f1e2d3c){4}\d+"', t or "")]
        assert set(planted) <= set(got[i].spans.split(","))


@pytest.fixture(scope="module")
def ids(tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    return library, {i: library.encode(t or "", add_special_tokens=False).ids for i, t in tables[1]}


def test_op4_and_op6(spark, tables, ids):
    library, want = ids
    counts, coded = found(spark, tables, "op4_token_counts"), found(spark, tables, "op6_bpe")
    for i, t in tables[1]:
        n = len(want[i])
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((t or "").encode()), n, n > 512)
        assert (coded[i].n_tokens, coded[i].ids_sha256) == (n, sha(struct.pack(f"<{n}I", *want[i])))
        assert coded[i].decoded_sha256 == sha(library.decode(want[i], skip_special_tokens=False))


def test_op7(spark, tables):
    got = found(spark, tables, "op7_quality")
    for i, _ in tables[1]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5)
    held = [(got[i].predicted, quality_of(t)) for i, t in tables[1] if got[i].held_out and t and len(t) > 300]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_op9(spark, tables):
    got = found(spark, tables, "op9_simhash")
    prints = {i: fingerprint(t) for i, t in tables[1]}
    root = {i: i for i in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([prints[i] for i in sorted(prints)], np.uint64)
    for i in sorted(prints):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            a, b = sorted((top(i), top(j)))
            root[b] = a
    for i in prints:
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", top(i))


def test_op10(spark, tables):
    got = found(spark, tables, "op10_toxicity")
    toxic = {i for i, t in tables[1] if "zorkly" in (t or "")}
    assert len(toxic) == 12 and all(got[i].toxic and got[i].grade >= 1 for i in toxic)
    assert sum(r.toxic for i, r in got.items() if i not in toxic) <= 3 and all((r.grade > 0) == r.toxic for r in got.values())


def test_pipeline(spark, tables, ids):
    """Every stage against plain Python on what the stage before kept."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    kept = dict(tables[1])
    names = [n for n, _ in c.STAGES]
    stages = dict(c.STAGES)
    after = {r.doc_id: r.text for r in stages[names[0]](spark, docs, tables[0]).collect()}
    clean = {i for i, t in kept.items() if quality_of(t) and len(t) > 300}
    assert set(after) <= set(kept) and all(after[i] == kept[i] for i in after) and len(clean - set(after)) <= 0.02 * len(clean)
    junk = {i for i, t in kept.items() if not quality_of(t) and len(t or "") > 300}
    assert len(junk & set(after)) <= 0.1 * len(junk)

    def run(name, rows):
        before = docs.join(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string"), "doc_id", "left_semi") if name != names[4] else masked
        return stages[name](spark, before, tables[0])

    root = brute(sorted(after.items()))
    got = run(names[1], after)
    assert got.columns == docs.columns
    after = {i: after[i] for i in set(root.values())}
    assert {r.doc_id: r.text for r in got.collect()} == after
    windows = set()
    for item in tables[2]:
        w = ALNUM.findall(lower(item))
        windows |= {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {i for i, t in after.items() for w in [ALNUM.findall(lower(t))] if any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))}
    assert dirty
    got = run(names[2], after)
    after = {i: t for i, t in after.items() if i not in dirty}
    assert {r.doc_id: r.text for r in got.collect()} == after
    masked = run(names[3], after)
    out = {r.doc_id: r for r in masked.collect()}
    assert set(out) == set(after)
    for i, t in after.items():
        spans = [(m.start(), m.end(), kind) for kind, p in BASE.items() for m in re.finditer(p, t or "") if fine(kind, m[0])]
        spans += [(m.start(), m.end(), "secret") for m in re.finditer(r'token = "[0-9a-f]{20,}"', t or "")]
        want, at = "", 0
        for a, b, kind in sorted(spans):
            want, at = want + t[at:a] + f"[{kind.upper()}]", b
        assert out[i].text == (want + t[at:] if spans else t) and (not spans or out[i].n_chars == len(out[i].text))
    library = ids[0]
    for r in run(names[4], after).collect():
        assert r.ids == library.encode(out[r.doc_id].text or "", add_special_tokens=False).ids and r.exact and r.n_tokens == len(r.ids)


LABELS = "doc_id long, quality int, toxic int"
MAKERS = {
    "op3": lambda d, s, lab, b: pii.find_spans(d),
    "op3 mask": lambda d, s, lab, b: pii.mask(d),
    "op4": lambda d, s, lab, b: token_cache.add_token_counts(d, PATH),
    "op5": lambda d, s, lab, b: decontam.find_contamination(d, b),
    "op5 drop": lambda d, s, lab, b: decontam.drop_contaminated(d, b),
    "op6": lambda d, s, lab, b: bpe.decode(bpe.encode(d, PATH), PATH),
    "op7": lambda d, s, lab, b: quality.score(d, quality.fit(d, lab)),
    "op7 once": lambda d, s, lab, b: quality.fit_and_score(d, lab),
    "op7 keep": lambda d, s, lab, b: quality.keep_good(d, lab),
    "op8": lambda d, s, lab, b: substring.remove_repeats(d),
    "op9": lambda d, s, lab, b: simhash.near_duplicates(d),
    "op9 keep": lambda d, s, lab, b: simhash.keep_one(d),
    "jaccard keep": lambda d, s, lab, b: jaccard.keep_one(d),
    "op10": lambda d, s, lab, b: toxicity.score(d, toxicity.fit(d, lab)),
}
NEW = {"op3": 2, "op4": 1, "op5": 4, "op6": 2, "op7": 1, "op7 once": 1, "op8": 3, "op10": 3}


@pytest.mark.parametrize("name", MAKERS)
def test_odd_tables(spark, name):
    """Null ids and texts, repeated rows, a very long text and word, columns that clash (but for case, with a dot); no rows at all."""
    long = " ".join(f"w{k % 997}" for k in range(40_000))
    rows = [(None, None), (None, "x y"), (1, ""), (1, "other"), (2, long), (2, long), (3, "q" * 60_000), (4, "é\n\t 中"), (5, None)]
    df = spark.createDataFrame([(*r, 1, "b", "c", 2.0, "e") for r in rows], "doc_id long, text string, Score int, `a.b` string, N_Tokens string, SPANS double, digest string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None), (9, None, None), (1, 1, 0)], LABELS)
    bench = spark.createDataFrame([(1, "other"), (None, "x"), (2, None)], "item_id long, text string")
    out = MAKERS[name](df, spark, labels, bench)
    n = out.count()
    keeps = name.endswith(("keep", "drop"))
    assert n <= len(rows) if keeps else n == len(rows)
    if name != "op9":
        lost = {"op3": "SPANS", "op4": "N_Tokens", "op7": "Score", "op7 once": "Score"}.get(name)
        assert out.columns[: len(df.columns) - (lost is not None)] == [c for c in df.columns if c != lost] and len(out.columns) == len(df.columns) - (lost is not None) + NEW.get(name, 0)
    assert MAKERS[name](df.limit(0), spark, labels, bench).count() == 0
    assert MAKERS[name](df, spark, labels.limit(0), bench.limit(0)).count() <= len(rows)


def test_odd_vectors_and_turns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [None, 1.0], 3), (None, [1.0, 1.0], 4), (1, [2.0, 1.0], 5), (3, [1.0], 6)], "vec_id long, embedding array<double>, `a.b` int")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.lit(True), 3).collect()] == []  # the only other vector has the query's own id
    more = df.unionByName(spark.createDataFrame([(7, [1.0, 1.0], 7)], df.schema))
    assert {(r.query_id, r.vec_id, r.score) for r in ann.nearest(more, F.col("vec_id") == 7, 3).where("rank = 1").collect()} == {(7, 1, 3.0)}
    turns = spark.createDataFrame([("c", 1, None, "x" * 100_000, 1), ("c", None, "assistant", None, 2), (None, 1, "user", "y", 3)], "conv_id string, turn long, role string, text string, `a.b` int")
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.format_conversations(turns)).collect()} == {"c": 2, None: 1}
    assert len(BLANKS.findall("a b")) == 2
