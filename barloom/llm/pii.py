"""Personal data in texts (DataFrame functions only).

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for bank account numbers), and words near a span raise
its score. Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base: every proposal that passes its own test stays, whatever
its score. ``iban`` needs its checksum, ``ssn`` (three, two and four digits) needs a context word to reach ``MIN_SCORE``.

Offsets count code points, ends are exclusive. Spans come from the lengths of what lies between the matches, so nothing leaves the JVM.
The patterns are written with possessive repeats and left guards: same matches as the plain form, no deep recursion and no
second look at a run of characters, however long the text.

Defined results: null or empty text has no spans; repeated rows give repeated results; null ids stay; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of

LOCAL = "A-Za-z0-9._%+-"
LABEL = "[A-Za-z0-9-]++"
MIN_SCORE = 0.5
NEAR = 40  # code points on both sides in which context words count


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    base: bool = True


KINDS = [
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@{LABEL}(?:\.{LABEL})++", 0.8, r"(?i)e-?mail|contact|write|correo|courriel"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"(?i)\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", 0.8, r"(?i)card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"(?i)phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+|[A-Z0-9]{11,30}+)(?![A-Za-z0-9])", 0.8, r"(?i)iban|bank|account|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"(?i)ssn|social security", base=False),
]


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(c: Column) -> Column:
    return F.ascii(c) - 48


def luhn(digits: Column) -> Column:
    """Luhn checksum of up to 20 digits: every second digit from the right counts double, less 9 when above 9."""
    d = F.lpad(digits, 20, "0")
    plain = reduce(lambda a, b: a + b, [_digit(F.substring(d, i, 1)) for i in range(2, 21, 2)])
    twice = F.translate(d, "0123456789", "0246813579")
    double = reduce(lambda a, b: a + b, [_digit(F.substring(twice, i, 1)) for i in range(1, 21, 2)])
    return (plain + double) % 10 == 0


def mod97(account: Column) -> Column:
    """Country and check digits go last, letters count 10 to 35, and the whole number must leave 1."""
    c = F.regexp_replace(account, " ", "")
    chars = F.split(F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4)), "")
    step = lambda acc, x: F.when(F.ascii(x) < 58, (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(F.filter(chars, lambda x: x != ""), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(digits_of(value))
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(a: Column) -> Column:
    """Sum up to and with each element; the array is copied for each element."""
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
    return F.aggregate(a, F.expr("cast(array() as array<int>)"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))


def running_sums(a: Column, part: int = 64) -> Column:
    """The same for long arrays: sums inside parts, on top of the sums of the parts before, so only short arrays are copied."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / part).cast("int")), lambda c: F.slice(x, c * part + 1, F.lit(part)))
    total = lambda q: F.aggregate(q, F.lit(0), lambda acc, y: acc + y)

    def joined_parts(parts: Column) -> Column:
        ends = _sums(F.transform(parts, total))
        shifted = lambda q, e: _bound(e - total(q), lambda before: F.transform(_sums(q), lambda v: v + before))
        return F.flatten(F.zip_with(parts, ends, shifted))

    return _bound(a, lambda x: _bound(cut(x), joined_parts))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, near>> of the leftmost matches that do not overlap; ``near``: the match with ``NEAR`` code points on both sides.

    Everything comes from the matches and what lies between them; the text is not looked up again, so the cost does not grow with the square of the matches.
    """
    values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,near:string>>)")

    def placed(p: Column) -> Column:
        before = F.transform(p, lambda x: F.right(F.concat(x["b"], x["v"]), F.lit(NEAR)))  # ends of what stands before the next match
        after = F.transform(p, lambda x: F.left(F.concat(x["v"], x["a"]), F.lit(NEAR)))
        ends = running_sums(F.transform(p, lambda x: F.length(x["b"]) + F.length(x["v"])))

        def spans(m: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                # a match is a code point at least, so NEAR matches hold NEAR code points
                left = F.array_join(F.slice(m["before"], F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR))), "")
                right = F.array_join(F.slice(m["after"], i + 2, F.lit(NEAR)), "")
                near = F.concat(F.right(F.concat(left, F.right(x["b"], F.lit(NEAR))), F.lit(NEAR)), x["v"], F.left(F.concat(F.left(x["a"], F.lit(NEAR)), right), F.lit(NEAR)))
                end = F.get(m["ends"], i)
                return F.struct((end - F.length(x["v"])).alias("start"), end.alias("end"), x["v"].alias("value"), near.alias("near"))
            return F.transform(p, span)

        return _bound(F.struct(before.alias("before"), after.alias("after"), ends.alias("ends")), spans)

    def zipped(v: Column) -> Column:
        return _bound(between, lambda g: F.arrays_zip(v.alias("v"), F.slice(g, 1, F.size(v)).alias("b"), F.slice(g, 2, F.size(v)).alias("a")))

    return _bound(values, lambda v: F.when(F.size(v) == 0, none).otherwise(_bound(zipped(v), placed)))


def _confirmed(no: int, k: Kind, proposed: Column) -> Column:
    """Proposals of one kind that are valid, with their score; kinds outside the base need ``MIN_SCORE``."""

    def scored(x: Column) -> Column:
        score = F.lit(k.score) + F.when(x["near"].rlike(k.context), 0.2).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), F.lit(k.name).alias("kind"), x["value"].alias("value"),
            F.round(score, 2).alias("score"), F.lit(k.base).alias("base"),
        )

    good = F.transform(F.filter(proposed, lambda x: valid(k.name, x["value"])), scored)
    return F.filter(good, lambda s: s["base"] | (s["score"] >= MIN_SCORE))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): spans are sorted structs of start, kind_no, end, kind, value, score, base."""
    d = docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).alias("_b_text"))
    d = d.withColumns({f"_b_{k.name}": matches(F.col("_b_text"), k.pattern) for k in KINDS})
    parts = [_confirmed(no, k, F.col(f"_b_{k.name}")) for no, k in enumerate(KINDS)]
    return d.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    at = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, at), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, all spans, best score."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"),
    )
