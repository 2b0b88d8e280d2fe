import random
import string

import pytest

ODD = [
    None, "", " ", "a", "one two", "x " * 6000, "é😀 中文 ß", "\n\t\r", "9" * 3000, "don't 'tis <|endoftext|> we'll  end ", "mail a@b.co or 1.2.3.4, +1 (988) 555-2485, 4111 1111 1111 1111",
    'token = "0641917ea4e9feb9cda83477b57ac"', "a@" + "b." * 2000 + "c", "1.1." * 500, "the same words " * 40,
]


@pytest.fixture(scope="session")
def texts():
    """Odd texts, random prose, copies, near copies and shared passages."""
    rng = random.Random(7)
    words = ["".join(rng.choices(string.ascii_letters + "éß-.,", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage = prose(60)
    out = [*ODD, *ODD[-2:]]
    for _ in range(40):
        out.append(prose(rng.randint(1, 200)))
    out += [f"{prose(20)} {passage} {prose(15)}" for _ in range(6)]
    out += [out[30]] * 5 + [out[30] + " tail", out[31].upper(), passage]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "own", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words int")
