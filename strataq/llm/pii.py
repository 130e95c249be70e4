"""Personal data spans with DataFrame functions only.

Regular expressions propose spans, validators (octet range, Luhn, digit counts,
mod 97) confirm them, and context words near a span move its score. The base
kinds stay whatever their score; iban and ssn spans need ``ACCEPT``.

Positions come without Python: marks are put around the matches, the text is
split at the marks, and the lengths of the pieces add up to code points. A mark
character that is in the text is first replaced by another single character,
which no pattern matches. Every pattern is written so that a failed start is
not tried again inside the same run, so long runs cost linear time.

Cases: null or empty text has no spans. Repeated rows give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
ACCEPT = 0.7
BEFORE, AFTER = 48, 16

#: Java forms of the base patterns: possessive where nothing follows that could need the characters back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A character that every match of the kind holds; texts without it skip the pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Score of a confirmed span without context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.5}
#: Words that raise and words that lower a score.
FOR = {
    "email": "mail|contact|write|reply|address",
    "ip": "ip|host|address|client|server|login|from",
    "card": "card|visa|credit|debit|payment|pay|cvv|expiry",
    "phone": "phone|tel|call|mobile|fax|contact|number",
    "iban": "iban|bank|account|transfer|sepa|bic",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST = {
    "email": "example|test|noreply",
    "ip": "version|release|section|build",
    "card": "order|invoice|isbn|serial|tracking|part",
    "phone": "score|delta|offset",
    "iban": "serial|model|part|sku",
    "ssn": "serial|part|order|isbn|ref|model",
}


def pieces(text: Column, kind: str) -> Column:
    """Text between matches at even places, matches at odd ones; one piece if there is no match."""
    cut = F.split(F.regexp_replace(text, f"({PATTERNS[kind]})", f"{MARK}$1{MARK}"), MARK, -1)
    need = NEEDS[kind]
    return F.when(F.contains(text, F.lit(need)), cut) if need else F.when(text.rlike("[0-9]"), cut)


FOUND = "array<struct<match:string,start:int>>"
#: Pieces of one fold, an even number: folds append to a list, which they copy at each step.
FOLD = 256


def folded(cut: Column, at: Column) -> Column:
    """struct<at, k, found>: the matches among pieces (at odd places) with their starts, if the first piece starts at ``at``."""
    start = F.struct(at.alias("at"), F.lit(0).alias("k"), F.array().cast(FOUND).alias("found"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x)).alias("at"),
        (s["k"] + 1).alias("k"),
        F.when(s["k"] % 2 == 1, F.concat(s["found"], F.array(F.struct(x.alias("match"), s["at"].alias("start"))))).otherwise(s["found"]).alias("found"),
    )
    return F.aggregate(cut, start, step)


def proposals(cut: Column) -> Column:
    """array<struct<match, start>> from pieces; start counts from 0. Texts with very many pieces are folded part by part, so that time stays near linear."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("found"))

    def part(s: Column, j: Column) -> Column:
        done = F.transform(F.array(folded(F.slice(cut, j * FOLD + 1, F.lit(FOLD)), s["at"])), lambda d: F.struct(d["at"].alias("at"), F.concat(s["found"], F.array(d["found"])).alias("found")))
        return F.element_at(done, 1)

    many = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / FOLD).cast("int")), start, part, lambda s: s["found"]))
    return F.when(F.size(cut) > FOLD, many).when(F.size(cut) > 1, folded(cut, F.lit(0))["found"]).otherwise(F.array().cast(FOUND))


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def term(s: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term) % 10 == 0


def mod97(iban: Column) -> Column:
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def term(s: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), term) == 1


def octet(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), octet)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        packed = F.translate(match, " ", "")
        return F.when(F.length(packed).between(15, 34), mod97(packed)).otherwise(False)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9[0-9]{2})-") & ~match.rlike("-00-") & ~match.rlike("-0000$")
    return F.lit(True)


def scored(text: Column, kind: str, x: Column) -> Column:
    """struct<kind, start, end, score> of a proposal."""
    end = x["start"] + F.length(x["match"])
    from_ = F.greatest(x["start"] - BEFORE, F.lit(0))
    near = F.lower(F.concat(F.substr(text, from_ + 1, x["start"] - from_), F.lit(" "), F.substr(text, end + 1, F.lit(AFTER))))
    gain = F.when(near.rlike(f"(?:^|[^a-z])(?:{FOR[kind]})(?:[^a-z]|$)"), 0.2).otherwise(0.0) - F.when(near.rlike(f"(?:^|[^a-z])(?:{AGAINST[kind]})(?:[^a-z]|$)"), 0.3).otherwise(0.0)
    score = F.round(F.least(F.greatest(F.lit(PRIOR[kind]) + gain, F.lit(0.0)), F.lit(1.0)), 3)
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), end.alias("end"), score.alias("score"))


def accepted(kind: str) -> Column:
    good = F.filter(F.col(f"__{kind}"), lambda x: confirmed(kind, x["match"]))
    spans = F.transform(good, lambda x: scored(F.col("__text"), kind, x))
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= ACCEPT)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: array<struct<kind, start, end, score>> by kind as listed in PATTERNS, then start."""
    out = df.select(F.col(id_col), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK, OTHER).alias("__text"))
    for kind in PATTERNS:
        out = out.withColumn(f"__{kind}", pieces(F.col("__text"), kind))
    for kind in PATTERNS:
        out = out.withColumn(f"__{kind}", proposals(F.col(f"__{kind}")))
    return out.select(id_col, F.concat(*map(accepted, PATTERNS)).alias("spans"))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the span lists as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), *(count(k).alias(f"n_{k}") for k in PATTERNS if k not in BASE), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
