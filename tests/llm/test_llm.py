"""The training-data operators against brute force, libraries and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelocus.llm import ann, bpe, chat, decontam, pii, quality, simhash, substring, token_cache, toxicity

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_round_trip(docs, texts, library):
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH), PATH).collect()}
    for i, t in texts:
        assert out[i].ids == library.encode(t or "", add_special_tokens=False).ids
        assert out[i].decoded == (t or "")


def test_bpe_rejects_unknown_ids():
    with pytest.raises(ValueError):
        bpe.load(PATH).decode(np.array([10**6]), np.array([0, 1]))


def test_token_cache_counts_and_appends(spark, docs, texts, library, tmp_path):
    cache = str(tmp_path / "cache")
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts}
    for _ in range(2):
        assert {r.doc_id: r.n_tokens for r in token_cache.add_token_counts(docs, PATH, cache).collect()} == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts})
    more = docs.limit(1).withColumn("text", F.lit("something new"))
    token_cache.add_token_counts(more, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts}) + 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(docs, texts, name, tmp_path):
    small = docs.where("doc_id < 16")
    got = {r.doc_id: r.n_tokens for r in token_cache.add_token_counts(small, P.path(name), str(tmp_path / "c")).collect()}
    if name.endswith(".model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        assert all(got[i] == len(lib.encode(t or "")) for i, t in texts if i < 16)
    else:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(P.path(name))
        assert all(got[i] == len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in texts if i < 16)


@pytest.mark.parametrize("most", [5, 50_000])
def test_contamination(spark, docs, texts, most):
    items = [(1, " ".join((texts[20][1] or "").split()[:30])), (2, texts[57][1]), (3, "one TWO"), (4, None), (None, "x"), (5, ""), (1, "one two"), (6, "\n".join(f"k{i % 90}" for i in range(20_000)))]
    items += [(7 + k, " ".join([x, "tail"])) for k, x in enumerate(thue_morse(1024))]
    more = [(900, "\n".join(f"K{i % 90}" for i in range(85, 130)), "", "", 0, "", 0), (901, thue_morse(1024)[1] + " tail", "", "", 0, "", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"N_Hit": F.lit("own"), "a.b": F.lit(1)})
    texts = [*texts, *((r[0], r[1]) for r in more)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(docs, bench, max_windows=most)
    assert found.columns == [*[c for c in docs.columns if c not in ("n_words", "N_Hit")], "n_words", "n_hit", "hit_spans", "item_ids"]
    out = {r.doc_id: r for r in found.collect()}
    windows = {}
    for k, t in items:
        w = ALNUM.findall(lower(t)) if k is not None else []
        size = min(10, len(w))
        for a in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[a : a + size]), set()).add(str(k))
    for i, t in texts:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for size in {len(win) for win in windows}:
            for a in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[a : a + size])):
                    hit.update(range(a, a + size))
                    found |= ids
        assert (out[i].n_words, out[i].n_hit, out[i].item_ids) == (len(w), len(hit), sorted(found))
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(r.n_hit == 0 for r in out.values())
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def thue_morse(n):
    """A word of n letters and its complement, which polynomial hashes modulo 2^64 can't tell apart."""
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


def test_repeats_removed(docs, texts, spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choices(words, k=90))
    more = [f"{' '.join(rng.choices(words, k=rng.randint(0, 40)))} {passage} {' '.join(rng.choices(words, k=9))}" for _ in range(30)]
    for n in (1024, 4096):
        more += [" ".join([x] * 3 + words[:10]) for x in thue_morse(n)]
    more += ["aa " * 70, "aa " * 40 + "b", "bb aa " * 50, more[0], more[0]]
    texts = [*texts, *enumerate(more, len(texts)), (None, more[1]), (3, more[2])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, N_Words int, `a.b` string")
    first = {}
    words = [(i, BLANKS.findall(t or "")) for i, t in texts]
    key = lambda i: 1 << 62 if i is None else i
    for i, w in words:
        for a in range(len(w) - 12):
            first[tuple(w[a : a + 13])] = min(key(i), first.get(tuple(w[a : a + 13]), 1 << 62))
    want = []
    for i, w in words:
        gone = {p for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < key(i) for p in range(a, a + 13)}
        want.append((key(i), len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    for block, entries, fan in ((1 << 22, 1 << 20, 1 << 14), (3000, 50, 3)):
        out = substring.remove_repeats(docs, block_bytes=block, bucket_entries=entries, fan=fan)
        assert out.columns == ["doc_id", "text", "a.b", "n_words", "n_removed", "kept_text"]
        assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == sorted(want)
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(docs, window=8)


def fingerprint(t):
    import xxhash

    w = BLANKS.findall(lower(t))
    shingles = [" ".join(w[a : a + 3]) for a in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [2, 20_000])
def test_near_duplicates(docs, texts, hot):
    prints = {i: fingerprint(t) for i, t in texts}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = {r.doc_id: r for r in simhash.near_duplicates(docs, hot_shard=hot).collect()}
    for i in prints:
        assert (out[i].fingerprint % (1 << 64), out[i].component_id) == (prints[i], find(i))
    kept = simhash.keep_one(docs.unionByName(docs.where("doc_id = 0")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in prints}) and kept.columns == docs.columns


def test_forest_finds_all_near_pairs():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([centre ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 8)] + [centre]))
    shards = np.sort(rng.integers(0, 3, len(values)))
    found = {tuple(sorted(p)) for a, b in simhash.Forest(values, shards).links(3) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for j in range(len(values)) for i in range(j) if shards[i] == shards[j] and int(values[i] ^ values[j]).bit_count() <= 3}
    assert found == want and want


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fine(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def test_personal_data(docs, texts):
    out = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    for i, t in texts:
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if fine(kind, m[0]))
        assert [tuple(s) for s in out[i].base_spans] == want
        assert {tuple(s) for s in out[i].spans} >= set(want)
    assert any(s.kind == "secret" for s in out[11].spans)
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert masked[10].text == "mail [EMAIL] or [IP], [PHONE], [CARD]" and masked[10].spans == "own" and masked[10].n_chars == len(masked[10].text)
    assert masked[0].text is None and masked[3].text == "a"
    plan = pii.find_spans(docs, [])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chat(spark, monkeypatch):
    control = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", control), (1, 1, "user", "\\" + control + "\\"), (1, 2, "assistant", f"\\\\{control} é😀\n"), (1, 2, None, None), (1, 3, "to [|] ol\\", "a [|] b"), (2, 0, "assistant", ""), (None, None, "", "x"), (None, 4, "assistant", "[/[INST]]<<s>s>")]
    rows += [(5, k, ("user", "assistant", "système")[k % 3], f"<s>é{k} " * (k % 7)) for k in range(120)] + [(6, 0, "user", "é" * 5000), (6, 1, "assistant", "z" * 4000), (1, 0, "system", control)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, N_Turns int").repartition(3)
    first = lambda x: (x is not None, x or 0)
    for size in (1 << 20, 400):
        monkeypatch.setattr(chat, "PIECE_BYTES", size)
        want = {}
        for c, t, r, x in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), r[2] or "", r[3] or "")):
            want.setdefault(c, []).append((r or "", x or ""))
        batches = pa.Table.from_pylist([{"conv_id": c, "role": r, "text": x} for c, turns in want.items() for r, x in turns], pa.schema({"conv_id": pa.int64(), "role": pa.string(), "text": pa.string()})).to_batches(max_chunksize=7)
        texts = {}
        for batch in chat._assemble(iter(batches)):
            for r in batch.to_pylist():
                texts.setdefault(r["conv_id"], []).append(r)
        for c, turns in want.items():
            made = texts[c]
            assert [r["piece"] for r in made] == list(range(len(made))) and (size == 400 or len(made) == 1)
            assert [t for r in made for t in chat.read_turns(r["formatted"])] == turns
            assert [chat.unescape(r["formatted"][s["first"] : s["last"]]) for r in made for s in r["loss_spans"]] == [x for r, x in turns if r == "assistant"]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        all_ = "".join(f"{r}\n{x}\n" for r, x in turns)
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert (got[c].loss_sha256, got[c].turns_sha256) == tuple(hashlib.sha256(t.encode()).hexdigest() for t in (loss, all_))
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[0].tolist()), (301, [0.0] * 16), (302, None), (303, [float("nan")] * 16), (304, [1.0]), (None, x[1].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 10 == 0, 5)
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = np.concatenate([x, x[:1]])
    hits = 0
    for q in range(0, 301, 10):
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(301), -s)) if i != q][:5]
        hits += len(set(best) & {v for v, _ in found[q]})
        assert all(abs(sc - s[v]) < 1e-9 for v, sc in found[q])
    assert hits >= 0.9 * 31 * 5
    assert found[0][0][0] != 0 and ann.nearest(df.limit(0), F.lit(True)).count() == 0


def ranked(x, q, k):
    """The ids of the k largest inner products but the query's own, ties to smaller ids."""
    s = x @ x[q]
    return [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]


@pytest.mark.parametrize("n, width", [(3000, 1e6), (12, 2.0), (30, 0.01)])
def test_nearest_with_ties(spark, n, width):
    """Integer vectors: very many equal scores.  One bucket for all; fewer candidates than asked; buckets that hold nothing."""
    x = np.random.default_rng(n).integers(-1, 2, size=(n, 6)).astype(float)
    x[np.abs(x).sum(1) == 0, 0] = 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, Score int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, width=width).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, n, 20):
        want = ranked(x, q, 20)
        assert [got[q][k + 1][0] for k in range(len(want))] == want and len(got[q]) == len(want)
        assert all(s == float(x[v] @ x[q]) for v, s in got[q].values())


def test_classifiers_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        t = [words[k] for k in rng.integers(0, 300, 80)]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            for k in rng.integers(0, 80, 4):
                t[k] = ["zorkly", "zorkish", "quxter"][k % 3]
        rows.append((i, " ".join(t).upper().replace(" ", "!! ") if bad else " ".join(t)))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (2000, 1, None), (2001, None, 1)], "doc_id long, quality int, toxic int")
    learn = ~quality.held_out()
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, marks, learn)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 402
    assert np.mean([(got[i] >= 0.5) == q for i, q, _ in labels]) > 0.97
    model = toxicity.fit(docs, marks.where(learn))
    held = {r.doc_id: r for r in toxicity.score(docs, model).where(quality.held_out()).collect()}
    assert np.mean([held[i].toxic == bool(t) for i, _, t in labels if i in held]) > 0.95
    assert np.all(np.diff(model.thresholds) > 0)
    none = marks.limit(0)
    assert {r.score for r in quality.score(docs.limit(3), quality.fit(docs, none)).collect()} == {0.5}
    assert not any(r.toxic for r in toxicity.score(docs.limit(3), toxicity.fit(docs, none)).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = c.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.where("not exact").count() == 0
    for name, stage in c.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
