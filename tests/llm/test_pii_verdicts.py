"""Candidates that are personal data and as many that only look like it."""

import random

from tidelocus.llm import pii


def cases():
    rng = random.Random(21)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices("ABCDEFGHabcdefgh0123456789_", k=n - 2)) + "a7"
    name, firm = (lambda: rng.choice(["jane", "li.wei", "o.diaz", "sam"])), (lambda: rng.choice(["corp", "uni-x", "mailer"]))
    number = lambda: f"{rng.randint(201, 799)}-{rng.randint(210, 989)}-{rng.choice([1597, 8026, 9051, 4408, 7713])}"
    real = [("secret", "config holds", f'{k} = "{v}"', "and more") for k, v in [("token", hexa(32)), ("api_key", mixed(24)), ("password", mixed(12)), ("secret", hexa(40)), ("access_key", mixed(20))] * 4]
    real += [("phone", cue, number(), "today") for cue in ["call me on", "telephone", "fax", "my mobile is", "phone"] * 3]
    real += [("phone", "or", f"({rng.randint(201, 799)}) {number()[4:]}", "then")]
    real += [("email", cue, f"{name()} [at] {firm()} [dot] {top}", "soon") for cue in ["write to", "contact", "and", "mail"] for top in ("com", "org", "de")]
    bad = [("secret", x, y, z) for x, y, z in [
        ("", "password: required", "here"), ("the", "token = consider", ""), ("", "secret: whispers", "of"), ("see", "api_key = undefined", ""), ("a", "credential: something", ""),
        ("", "title: chapter-one", ""), ("", "time: 10:30:00", ""), ("", "version: 1.2.3.4-5", ""), ("set", "password = changeme123", ""), ("", "token: your_token_here", ""), ("", "author: somebody", ""),
        ("", "result = computed", ""), ("", "secret: ingredient", ""), ("", "colour: turquoise", ""), ("", "width = 1234567", ""), ("", "key: placeholder1", ""), ("", "answer: forty-two", ""), ("", "token: xxxxxxxx", ""),
    ]]
    bad += [("phone", x, y, z) for x, y, z in [
        ("order", "212 555 1234", "parts"), ("part no.", "8005551234", ""), ("isbn", "0306406152", ""), ("serial", "1111111111", ""), ("the sum", "4820119573", "was"), ("item", "100 200 3000", ""), ("id", "0000000000", ""),
        ("about", "300 000 0000", "stars"), ("in", "1234567890", "ways"), ("invoice", "456 789 0123", ""), ("page", "2024010112", ""), ("number", "123 456 7890", ""),
    ]]
    bad += [("email", x, y, z) for x, y, z in [
        ("we", "look at point dot one", ""), ("they", "met at noon dot that", "was"), ("he", "works at acme dot then", ""), ("it", "is at rest dot dot", ""), ("all", "arrive at seven dot sharp", ""), ("so", "are at line dot five", ""),
        ("you", "stay at home dot now", ""), ("and", "was at sea dot again", ""),
    ]]
    return [(i, *c, good) for i, (c, good) in enumerate([(c, True) for c in real] + [(c, False) for c in bad])]


def test_verdicts(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, f"Some words {a} {span} {b} and words") for i, _, a, span, b, _ in rows], "doc_id long, text string").repartition(2)
    found = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in pii.find_spans(docs).collect()}
    candidates = {r.doc_id for r in docs.select("doc_id", pii._wider(docs.text).alias("c")).where("size(c) > 0").collect()}
    assert all(i in candidates for i, *_, good in rows if good) and sum(i in candidates for i, *_, good in rows if not good) >= 0.8 * sum(not r[-1] for r in rows)
    taken = {i for i, kind, _, span, _, _ in rows if (kind, span) in found[i]}
    right = {i for i, *_, good in rows if good}
    wrong = {i for i, *_, good in rows if not good and found[i]}
    assert len(taken & right) >= 0.9 * len(right), [r for r in rows if r[0] in right - taken]
    assert len(taken & right) >= 0.9 * (len(taken & right) + len(wrong)), [(r, found[r[0]]) for r in rows if r[0] in wrong]
    kept = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    for i, _, a, span, b, _ in rows:
        if span in ("password: required", "token = consider", "secret: whispers", "api_key = undefined", "212 555 1234"):
            assert kept[i] == f"Some words {a} {span} {b} and words"
