"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside occurrences of benchmark windows, and the items' digest."""
    from .decontam import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 20 its 20 nearest others by inner product."""
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, read back from the formatted text: turns, their digest, and the loss texts' digest."""
    from .chat import digests, format_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("select -7L conv_id, id turn, if(id = 0, 'user', 'assistant') role, '</s>[INST] ok [/INST]' text from range(2)")
    return digests(format_conversations(turns.unionByName(odd)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind and their digest, and all spans."""
    from .pii import KINDS, find_spans

    found = find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [many(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(shown("base_spans"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens, and whether these are over 512."""
    import public_tokenizers

    from .token_cache import add_token_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = add_token_counts(docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")), public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and the digest of the text decoded from them."""
    import public_tokenizers

    from .bpe import load
    from .shared import add_columns

    path = public_tokenizers.path(TOKENIZER)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = load(path)
        ids, bounds = codec.encode(batch.column("text"))
        raw, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        digests = [sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        texts = [sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in codec.decode(ids, bounds)]
        return [pa.array(np.diff(bounds)), pa.array(digests, pa.string()), pa.array(texts, pa.string())]

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return add_columns(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make).drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label is held out, the calibrated score, and the label it predicts."""
    from .quality import fit_and_score, held_out

    scored = fit_and_score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, how many repeat a passage of a smaller doc_id, and the digest of the others."""
    from .substring import remove_repeats

    kept = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and the smallest doc_id that chains of links reach."""
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: expected severity, likeliest grade, and whether it is toxic."""
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "severity", "grade", "toxic")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases of two to four words."""
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frequent word: its form, its root, its count, how many words are near it, and the form's count."""
    from .variants import group_variants

    return group_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the files: ids before it, its ids with the end id, and their checksum."""
    import public_tokenizers

    from ..scratch import folder
    from .token_files import add_starts, checksums, write_ids

    path = folder(spark, "token-files")
    write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), 2)
    return add_starts(checksums(spark, path), spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_chat": op2_chat,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_substring": op8_substring,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_token_files": op13_token_files,
}
_CONTROL = r"(?:</?s>|\[/?INST\]|\[/?SYS\]|\[ANS\]|\[/?ROLE\]|\[\|\])"
ORACLES: dict[str, str] = {
    "op2_chat": rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + case role
    when 'system' then 16 when 'user' then 18 when 'assistant' then 14
    else 23 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) end as size
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from sized group by conv_id
""",
    "op5_decontamination": r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bwin as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select item_id, w, least(10, len(w)) as size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from bw where len(w) > 0)
), sizes as (select distinct size from bwin),
dwin as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from dw, sizes where len(w) >= size)
), m as (select d.doc_id, d.i, d.size, b.item_id from dwin d join bwin b using (size, win)),
hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + size - 1)) as p from m) group by 1),
items as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, cast(item_id as varchar) as item_id from m) group by 1)
select doc_id, len(w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items,
  sha256(coalesce(t.s, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from dw left join hits h using (doc_id) left join items t using (doc_id)
""",
    "op8_substring": r"""
with dw as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as win
  from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from dw where len(w) > 12)
), firsts as (select win, min(doc_id) as least from win group by 1),
gone as (
  select distinct doc_id, p from (
    select doc_id, unnest(generate_series(i, i + 12)) as p from win join firsts using (win) where least < doc_id)
), words as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as p from dw),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as s, count(*) as n
  from words anti join gone using (doc_id, p) group by 1
)
select doc_id, len(w) as n_words, len(w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.s, '')) as kept_sha256
from dw left join kept k using (doc_id)
""",
    "op11_collocations": r"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
    select coalesce(lang, 'und') as lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), totals as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by 1),
grams as (select lang, w[i:i + k - 1] as p from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from pieces, (values (1), (2), (3), (4)) s(k) where len(w) >= k)),
f as (select lang, p, count(*) as a from grams group by all having count(*) >= 30),
c as (select * from f where len(p) > 1),
cuts as (
  select c.lang, c.p, c.a, k, x.a as l, y.a as r, cast(2000000::hugeint * c.a // (x.a + y.a) as bigint) as score
  from (select *, unnest(generate_series(1, len(p) - 1)) as k from c) c join f x on x.lang = c.lang and x.p = c.p[1:k] join f y on y.lang = c.lang and y.p = c.p[k + 1:]
), best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inside as (
  select lang, p[i:i + s - 1] as p, max(a) as longer from (
    select lang, p, a, s, unnest(generate_series(1, len(p) - s + 1)) as i from (select lang, p, a, unnest(generate_series(2, len(p) - 1)) as s from c where len(p) > 2)) group by all
)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, array_to_string(b.p, ' ')) as rank, array_to_string(b.p, ' ') as phrase, a, l, r, n, score
from best b join totals t on t.lang = b.lang left join inside i on i.lang = b.lang and i.p = b.p
where longer is null or 100::hugeint * longer < 80::hugeint * a qualify rank <= 2000
""",
    "op12_spelling": r"""
with recursive rows as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents
), runs as (select doc_id, w, count(*) as c, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || w)) as h from rows group by doc_id, w),
crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce(range(9), lambda v, k: case when k > 0 then case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end else v end, i) as v from (
      select cast(unnest(range(256)) as bigint) as i))
), hashed as (
  select w, c, xor(4294967295, list_reduce(list_transform(range(cast(length(h) // 2 as bigint)), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as bigint)),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), 4294967295)) as x from runs, crc_table
), changed as (select case when x % 199 = 0 then substr(w, 1, x % length(w)) || substr(w, x % length(w) + 2) else w end as word, c from hashed),
words as (select word, cast(sum(c) as bigint) as n from changed where length(word) >= 6 group by word having sum(c) >= 5),
cut as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as v from (select word, unnest(generate_series(1, length(word))) as i from words)),
near as (
  select a.word, b.word as other from cut a join cut b on a.v = b.v and a.i = b.i and a.word <> b.word
  union select w.word, d.word from words w join cut d on d.v = w.word union select d.word, w.word from words w join cut d on d.v = w.word
), best as (
  select x.word, count(*) as n_near, first(other order by y.n desc, other) as form, max(y.n) as form_n from near x join words y on y.word = x.other group by x.word
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * w.n then form end as form, case when form_n >= 5 * w.n then form_n end as form_n from words w left join best using (word)
), chain as (select word, word as root from words union all select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word join forms e on e.word = c.root where e.form is null
""",
}
