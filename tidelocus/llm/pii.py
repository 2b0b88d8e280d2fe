r"""Personal data by weak supervision, in DataFrame functions only.

Base spans are matches of four patterns with a check each (``BASE``); they always stay.  Pieces between matches
(``split``) and the matches give their places in code points.

Further candidates (``WIDER``) are far wider than what is wanted: names before any kind of ``at`` and ``dot``, any ten digits in groups, any
key with a value.  Five labelers vote on each, 1, 0 or silent (-1):

* regex: whether the candidate has the strict form of its kind;
* gazetteer: whether a listed term (top-level domain, exchange, key name or prefix) stands in it;
* context: cue words in the 40 characters before it; words of harmless things right before it count against it (silent without either);
* content: whether its letters and digits vary as such data do;
* plainness: against ordinary words, placeholders and digits in sequence (otherwise silent).

Votes are counted over all documents, together with what the classifier sees besides them (``SHAPE``: length, letters and
digits, quotes, case, what stands before).  Expectation-maximisation estimates from the votes, for each kind, the share of
true candidates and every labeler's reliability on both sides; a logistic span classifier with kinds, votes and shape
as features is then trained on the posteriors, so that shape decides where votes tie.  Both run as higher-order functions over the
table of patterns, which has at most 3^4 * 2^6 rows a kind whatever the input (tens in practice).  The classifier's verdict
depends on the pattern alone, so those it accepts go into the second pass as a literal list.

Nothing is shuffled but the counts of patterns.  Patterns have possessive repeats and look-behinds where
that leaves their matches the same, so that long runs cost linear time and no deep recursion.

Edge cases: null texts are empty and have no spans; repeated rows are judged each; a candidate that
overlaps a base span is left out; without candidates only base spans remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keeps_columns, written

KINDS = ("email", "ip", "card", "phone", "secret")
#: The four base patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?:at|AT) ?[\])}] ?| at | AT )[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| dot | DOT )[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(])(?<![0-9][ .-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![ .-]?[0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|[A-Za-z][A-Za-z0-9_-]{1,30}+[\"']? ?[=:] ?[\"']?[A-Za-z0-9_/+.-]{6,}+[\"']?)",
}
WIDER_NEEDS = {"email": r"(?:[\[({] ?| )(?:at|AT)(?: ?[\])}]| )", "phone": "[0-9]{3}[ .-]?[0-9]{4}", "secret": "AKIA|[=:]"}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]* ?[\[({] ?(at|AT) ?[\])}] ?[A-Za-z0-9-]+( ?[\[({] ?(dot|DOT) ?[\])}] ?[A-Za-z0-9-]+)*[A-Za-z]{2}$",
    "phone": r"^(\([2-9][0-9]{2}\) ?[2-9]|[2-9][0-9]{2}([.-])[2-9])[0-9]{2}[.-][0-9]{4}$",
    "secret": r"^AKIA[0-9A-Z]{16}$|[=:] ?[\"']?(?=[^\"']*[0-9])(?=[^\"']*[A-Za-z])[A-Za-z0-9_/+.-]{8,}[\"']?$",
}
#: Terms of the gazetteers.
TOP_LEVEL = "com org net edu gov mil int info biz io ai app dev de fr es it uk eu nl be ch at pl cz se no fi dk pt ie gr ru ua tr jp cn kr in br mx ar cl ca us au nz za".split()
TOLL_FREE = "800 822 833 844 855 866 877 888 900 555".split()
KEY_NAMES = "akia password passwd pwd secret token api_key api-key apikey access_key access-key accesskey private_key private-key privatekey credential".split()
GAZETTEER = {
    "email": f"(?i)(?<![a-z])({'|'.join(TOP_LEVEL)})$",
    "phone": f"^[(]?({'|'.join(TOLL_FREE)})|[^0-9](555)[ .-]",
    "secret": f"(?i)^([a-z0-9]+[_-])*({'|'.join(KEY_NAMES)})[\"']? ?[=:]|^akia",
}
#: Cue words before a candidate.
CUES = {
    "email": r"(?i)mail|contact|write|reach|send|schreib|kontakt|courriel|écri|correo|escrib|address|adress|dirección",
    "phone": r"(?i)tel|phone|call|fax|mobil|cell|hotline|whatsapp|appel|llam|anruf|ruf",
    "secret": r"(?i)key|login|auth|credential|access|config|user|env|export|header|bearer|secret|pass",
}
#: Words of harmless things right before a candidate, and what reads as ordinary words, placeholders or sequences.
HARMLESS = {
    "email": r"(?i)\b(look|meet|arrive|stay|work|hosted|available)\W{1,3}$",
    "phone": r"(?i)\b(order|part|item|sku|isbn|invoice|serial|version|room|page|ref|no|nr|number|bestellung|artikel|commande|pedido)\W{1,3}$",
    "secret": r"(?i)\b(see|the|an?|example|docs?|named|called|field|parameter|option|type|say|said|note|der|die|das|le|la|les|el|los)\W{1,3}$",
}
PLAIN = {
    "email": r"(?i)^(look|looks|looked|meet|met|be|is|are|was|were|here|there|available|hosted|found|stay|stays|arrive|arrives|work|works|and|or|the|it|them|us) ",
    "phone": r"([0-9])(\W?\1){5}|(0123|1234|2345|3456|4567|5678|6789)\)?$",
    "secret": r"(?i)[=:] ?[\"']?([a-z]+([_.-][a-z]+)*[.-]?|.*(example|changeme|placeholder|your[_-]|xxxx).*|[0-9.:/-]+|(.)\4+)[\"']?$",
}
#: What the classifier sees of a candidate besides the votes: (name, pattern of the candidate with one character before it).
SHAPE = {
    "long": r"^.?.{24}",
    "letters and digits": r"(?i)^(?=.*[0-9])(?=.*[a-z])",
    "hexadecimal": r"(?i)[=:] ?[\"']?[0-9a-f]{16,}[\"']?$",
    "quoted": r"[\"']$",
    "upper case": r"^[^a-z]*$",
    "begins a word": r"^[\s\"'(\[{|]",
}
CONTENT = {"email": "[A-Za-z]{2}", "phone": r"([0-9]).*(?!\1)[0-9].*(?!\1)[0-9]", "secret": r"AKIA.*[0-9]|[=:].*[0-9].*[A-Za-z_]|[=:].*[A-Za-z_].*[0-9]"}
LABELERS = 5
EM_ROUNDS, FIT_ROUNDS = 25, 300


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array<struct<start, end, match>>, in code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("match")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("done"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("done")), step, lambda s: s["done"])


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[ -]", ""))
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)
    return F.when((n >= 14) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _holds(kind: str, match: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return match.rlike("^" + r"\.".join([_PART] * 4) + "$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


_SPAN = "cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)"


def _base_kind(text: Column, kind: str) -> Column:
    fine = F.filter(located(text, BASE[kind]), lambda m: _holds(kind, m["match"]))
    spans = F.transform(fine, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    worth = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    return F.when(worth & text.rlike(BASE[kind]), spans).otherwise(F.expr(_SPAN))


def _base(text: Column) -> Column:
    """All base spans, as array<struct<start, rank, kind, end>> by start and kind."""
    return F.array_sort(F.concat(*[_base_kind(text, kind) for kind in BASE]))


def _votes(kind: str, match: Column, before: Column) -> Column:
    """The five labelers' votes."""
    yes_no = [match.rlike(STRICT[kind]), match.rlike(GAZETTEER[kind])]
    return F.array(*[x.cast("int") for x in yes_no], F.when(before.rlike(HARMLESS[kind]), 0).when(before.rlike(CUES[kind]), 1).otherwise(-1), match.rlike(CONTENT[kind]).cast("int"), F.when(match.rlike(PLAIN[kind]), 0).otherwise(-1))


def _wider_kind(text: Column, kind: str) -> Column:
    def one(m: Column) -> Column:
        first = F.greatest(m["start"] - 40, F.lit(0))
        votes = _votes(kind, m["match"], F.substring(text, first + 1, m["start"] - first))
        around = F.concat(F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise(F.lit(" ")), m["match"])
        shape = F.array(*[around.rlike(p).cast("int") for p in SHAPE.values()])
        pattern = F.concat_ws(",", F.lit(kind), F.concat(votes, shape).cast("array<string>"))
        return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), pattern.alias("pattern"))

    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,pattern:string>>)")
    return F.when(text.rlike(WIDER_NEEDS[kind]), F.transform(located(text, WIDER[kind]), one)).otherwise(none)


def _wider(text: Column) -> Column:
    """All candidates, as array<struct<start, rank, kind, end, pattern>>."""
    return F.concat(*[_wider_kind(text, kind) for kind in WIDER])


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, p: a + value(p))


def posteriors(patterns: DataFrame, rounds: int = EM_ROUNDS) -> DataFrame:
    """(kind, v, n, q): q is P(true) of votes ``v``, from EM over ``patterns`` (kind, v, n) for each kind."""
    rows = patterns.groupBy("kind").agg(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n"))).alias("ps"))
    ids = F.sequence(F.lit(0), F.lit(LABELERS - 1))

    def likelihood(state: Column, p: Column) -> Column:
        def term(j: Column) -> Column:
            a, b, v = F.get(state["a"], j), F.get(state["b"], j), F.get(p["v"], j)
            return F.when(v == 1, F.log(a / b)).when(v == 0, F.log((1 - a) / (1 - b))).otherwise(0.0)

        odds = F.aggregate(F.transform(ids, term), F.log(state["share"] / (1 - state["share"])), lambda s, x: s + x)
        return 1 / (1 + F.exp(-odds))

    def step(state: Column, ps: Column) -> Column:
        known = F.transform(ps, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), likelihood(state, p).alias("q")))

        def rate(side, prior: float):
            def of(j: Column) -> Column:
                voted = _sum(known, lambda p: F.when(F.get(p["v"], j) >= 0, p["n"] * side(p["q"])).otherwise(0.0))
                ones = _sum(known, lambda p: F.when(F.get(p["v"], j) == 1, p["n"] * side(p["q"])).otherwise(0.0))
                return (ones + 5 * prior) / (voted + 5)

            return F.transform(ids, of)

        share = (_sum(known, lambda p: p["n"] * p["q"]) + 1) / (_sum(known, lambda p: p["n"]) + 2)
        return F.struct(share.alias("share"), rate(lambda q: q, 0.8).alias("a"), rate(lambda q: 1 - q, 0.2).alias("b"))

    start = F.expr(f"struct(0.5D as share, array_repeat(0.8D, {LABELERS}) as a, array_repeat(0.2D, {LABELERS}) as b)")
    fitted = rows.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: step(s, F.col("ps"))))
    return fitted.select("kind", "state", F.explode("ps").alias("p")).select("kind", "p.v", "p.n", likelihood(F.col("state"), F.col("p")).alias("q"))


def accepted(known: DataFrame, rounds: int = FIT_ROUNDS) -> DataFrame:
    """(kind, v, f, p): the span classifier's probability for each pattern of votes and shape (kind, v, f, n, q), trained on the posteriors q."""
    kinds = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in WIDER]
    signed = F.transform("v", lambda v: F.when(v == 1, 1.0).when(v == 0, -1.0).otherwise(0.0))
    rows = known.withColumn("x", F.concat(F.array(*kinds), signed, F.col("f").cast("array<double>")))
    size = len(WIDER) + LABELERS + len(SHAPE)
    dot = lambda w, x: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    # rare patterns count as well as frequent ones up to a logarithm
    weight = lambda p: F.log1p(p["n"])

    def step(w: Column, ps: Column) -> Column:
        total = _sum(ps, weight)
        errors = F.transform(ps, lambda p: F.struct(p["x"].alias("x"), (weight(p) * (p["q"] - sigmoid(dot(w, p["x"]))) / total).alias("e")))
        return F.transform(w, lambda old, j: old + 2.0 * (_sum(errors, lambda p: p["e"] * F.get(p["x"], j)) - 0.001 * old))

    one = rows.groupBy().agg(F.collect_list(F.struct("kind", "v", "f", "n", "q", "x")).alias("ps"))
    fitted = one.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.expr(f"array_repeat(0D, {size})"), lambda w, _: step(w, F.col("ps"))))
    return fitted.select("w", F.explode("ps").alias("p")).select("p.kind", "p.v", "p.f", sigmoid(dot(F.col("w"), F.col("p.x"))).alias("p"))


def learn(documents: DataFrame) -> list[str]:
    """The patterns of votes and shape that the classifier trained on ``documents`` (``text``) accepts."""
    seen = documents.select(F.explode(_wider(F.coalesce("text", F.lit("")))).alias("c")).groupBy("c.pattern").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("pattern", ",")
    part = lambda first, size: F.slice(parts, first, size).cast("array<int>")
    seen = written(seen.select(parts[0].alias("kind"), part(2, LABELERS).alias("v"), part(2 + LABELERS, len(SHAPE)).alias("f"), "n"), "pii-patterns")
    known = posteriors(seen.groupBy("kind", "v").agg(F.sum("n").alias("n"))).select("kind", "v", "q")
    good = accepted(seen.join(known, ["kind", "v"])).where("p >= 0.5")
    return sorted(r["pattern"] for r in good.select(F.concat_ws(",", "kind", F.concat("v", "f").cast("array<string>")).alias("pattern")).collect())


@keeps_columns("text", new=("base_spans", "spans"))
def find_spans(documents: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """``documents`` (``text``) with base_spans and spans, arrays of struct<start, rank, kind, end>, by start and kind.

    ``patterns`` are the accepted vote patterns (None: learnt from ``documents``).
    """
    patterns = learn(documents) if patterns is None else patterns
    text = F.coalesce("text", F.lit(""))
    kept = documents.withColumn("base_spans", _base(text))
    more = F.filter(_wider(text), lambda c: c["pattern"].isin(patterns) if patterns else F.lit(False))
    plain = F.transform(more, lambda c: F.struct(c["start"], c["rank"], c["kind"], c["end"]))
    kept = kept.withColumn("__more", plain)
    clear = F.filter("__more", lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return kept.withColumn("spans", F.array_sort(F.concat("base_spans", clear))).drop("__more")


@keeps_columns("text", "n_chars")
def mask(documents: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in brackets, and n_chars (if there) anew."""
    found = find_spans(documents, patterns)

    def step(state: Column, s: Column) -> Column:
        # of overlapping spans the first names what both cover
        piece = F.when(s["start"] >= state["at"], F.concat(F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["done"], F.array(piece)).alias("done"))

    start = F.expr("struct(0 as at, cast(array() as array<string>) as done)")
    whole = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["done"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    masked = found.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked
