"""What Python workers hold: the size of batches, and vocabularies of tasks before."""

import pyarrow as pa
from tokenizers import Tokenizer

from tidelocus.llm import bpe, shared

from .test_llm import PATH


def test_batches_have_bounded_bytes(spark):
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    seen = shared.add_columns(docs, "size long", lambda batch: [pa.array([batch.nbytes] * batch.num_rows)], text=None)
    assert seen.count() == 4000 and seen.agg({"size": "max"}).first()[0] < 12e6


def test_sessions_own_bound_stays(spark):
    other = spark.newSession()
    other.conf.set(shared.BATCH[0], "3m")
    shared.bound_batches(other)
    assert other.conf.get(shared.BATCH[0]) == "3m"


def test_unused_vocabulary_goes():
    def uses(batches):
        bpe.load(PATH)
        yield from batches

    assert list(shared.tidy(uses)(iter([1]))) == [1] and bpe.load.cache_info().currsize == 1
    assert list(shared.tidy(iter)([2])) == [2] and bpe.load.cache_info().currsize == 0


def test_dictionaries_only_for_long_words():
    codec = bpe.ByteBpe(PATH)
    library = Tokenizer.from_file(PATH)
    lazy = {"pairs", "trie_step", "trie_end"}
    assert codec.encode(pa.array(["some words, 12 of them"]))[0].tolist() == library.encode("some words, 12 of them", add_special_tokens=False).ids
    assert not lazy & set(vars(codec))
    for long in ("thequickbrownfox" * 60, "xqzjvwkpthe" * 60):
        assert codec.encode(pa.array([long]))[0].tolist() == library.encode(long, add_special_tokens=False).ids
    assert lazy & set(vars(codec))
