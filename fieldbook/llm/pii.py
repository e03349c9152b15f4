r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are email, ip, card and phone, leftmost and without overlap within a kind; a proposal that fails its check is
dropped. ``iban`` (confirmed by mod 97) and ``ssn`` (no checksum: accepted only with a context word) are added. A score
starts at the kind's own value and rises with a confirmed checksum and with a context word in the 40 characters before.
A context word speaks for one ssn and for those listed right behind it; later ones need another word. An account ends at
its country's length, so that words behind it do not join it; codes without a known length may have any from 15 to 34.

Every pattern matches exactly what its plain form matches, without backtracking: possessive repeats where the next
character cannot belong to the repeat, and a start only at the edge of a run (or where the last match ended), because a
start inside a run would meet the same end. Positions come from the pieces between the matches, summed once.

Built-in functions only. Null text is empty, has no spans and an empty base_sha256 text; repeated rows give repeated
results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.storage import documents_only

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account and the country codes that have so many.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "CV GW LY MZ PT ST AO", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "(?:" + "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9_])" for n, codes in LENGTHS.items()) + ")"
#: A character of an account; what reads as a whole account behind a space begins the next one.
_NEXT = rf"(?: (?!{_KNOWN}))?[A-Z0-9]"
_BOUND = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:{_NEXT}){{{n - 4}}}(?![A-Za-z0-9_])" for n, codes in LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9_])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BOUND}|[A-Z]{{2}}[0-9]{{2}}(?:{_NEXT}){{11,30}}(?![A-Za-z0-9_]))"
SSN = r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = {
    "email": "mail|e-mail|contact|write|correo|courriel", "ip": "ip|address|server|host|client", "card": "card|visa|master|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|contact", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social|security|tax|insurance",
}
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn")
#: Score of the pattern alone, of a confirmed checksum, and of a context word; added kinds are kept from LEAST on.
SCORES = {"email": (0.9, 0.0, 0.05), "ip": (0.7, 0.0, 0.2), "card": (0.5, 0.4, 0.1), "phone": (0.6, 0.0, 0.3), "iban": (0.4, 0.5, 0.1), "ssn": (0.4, 0.0, 0.4)}
LEAST, REACH, _CHUNK = 0.7, 40, 4000
#: What stands between the numbers of a list.
LISTED = r"^(?i:[\s,;/|&]|\b(?:and|or|und|oder|et|ou|y|o)\b)*$"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the digits' sum is a multiple of 10."""
    turned = F.reverse(digits)
    digit = lambda i: F.ascii(F.substr(turned, i, F.lit(1))) - 48
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def passes_mod97(account: Column) -> Column:
    """The first four characters moved to the end, letters read as 10 to 35, the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substr(moved, i, F.lit(1)))
    step = lambda rest, i: F.when(code(i) < 58, (rest * 10 + code(i) - 48) % 97).otherwise((rest * 100 + code(i) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _card(v: Column) -> Column:
    d = digits_of(v)
    return F.when(F.length(v) > 60, False).when(F.length(d).between(16, 19), passes_luhn(d)).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _card,
    "phone": lambda v: F.length(digits_of(v)).between(8, 15),
    "iban": passes_mod97,
    "ssn": lambda v: ~v.rlike("^(?:000|666|9)"),
}
CHECKSUM = ("card", "iban")
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}


def own_score(kind: str) -> float:
    """Score of a span without a context word."""
    return SCORES[kind][0] + (SCORES[kind][1] if kind in CHECKSUM else 0.0)


def nothing_before() -> tuple[Column, Column]:
    """What a fold over proposals carries for ``judged``: the text before, and whether a context word spoke for the last one."""
    return F.lit("").alias("before"), F.lit(False).alias("spoken")


def judged(kind: str, acc: Column, value: Column, piece: Column) -> tuple[Column, Column, tuple[Column, Column]]:
    """Whether a context word speaks for the proposal, whether it is confirmed, and what is carried to the next one."""
    needed = kind in ADDED and own_score(kind) < LEAST
    before = F.right(F.concat(acc["before"], F.right(piece, F.lit(REACH))), F.lit(REACH))
    context = F.lower(before).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})")
    good = value.isNotNull() & F.coalesce(VALID[kind](value), F.lit(False))
    after = F.right(F.concat(before, F.coalesce(value, F.lit(""))), F.lit(REACH))
    if needed:
        context = context | (acc["spoken"] & piece.rlike(LISTED))
        good, after = good & context, F.when(good & context, F.lit("")).otherwise(after)
    return context, good, (after.alias("before"), context.alias("spoken"))


def spans_of(text: Column, kind: str) -> Column:
    """Struct of n and ``found``: kind:start:end/score of each span, joined by commas; code points, end exclusive."""
    pattern, valid = PATTERNS[kind], VALID[kind]
    proposed = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = own_score(kind)

    def step(acc: Column, x: Column) -> Column:
        value, piece = x["value"], x["piece"]
        start = acc["at"] + F.length(piece)
        end = start + F.coalesce(F.length(value), F.lit(0))
        context, good, carried = judged(kind, acc, value, piece)
        score = F.when(context, F.lit(f"/{own + SCORES[kind][2]:.2f}")).otherwise(F.lit(f"/{own:.2f}"))
        entry = F.concat(F.lit(f",{kind}:"), start.cast("string"), F.lit(":"), end.cast("string"), score)
        full = F.length(acc["last"]) > _CHUNK
        return F.struct(
            end.alias("at"), F.when(good, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(good & full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"]).alias("done"),
            F.when(~good, acc["last"]).when(full, entry).otherwise(F.concat(acc["last"], entry)).alias("last"), *carried,
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("done"), F.lit("").alias("last"), *nothing_before())
    finish = lambda acc: F.struct(acc["n"].alias("n"), F.concat(F.array_join(acc["done"], ""), acc["last"]).alias("found"))
    pieces = F.split(text, pattern, -1)
    counted = F.aggregate(F.zip_with(proposed, pieces, lambda v, p: F.struct(v.alias("value"), p.alias("piece"))), zero, step, finish)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("found"))
    possible = text.contains("@") if kind == "email" else text.rlike("[0-9]")
    return F.when(possible & F.exists(proposed, valid), counted).otherwise(none)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_<kind> of every kind, and ``found``: kind:start:end/score of all spans, by kind, then start."""
    given = documents_only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    kinds = BASE + ADDED
    spans = given.withColumns({k: spans_of(F.col("text"), k) for k in kinds})
    joined = lambda some: F.substr(F.concat(*(F.col(f"{k}.found") for k in some)), F.lit(2))
    return spans.select("doc_id", "text", *(F.col(f"{k}.n").alias(f"n_{k}") for k in kinds), joined(BASE).alias("base"), joined(kinds).alias("found"))


def places_only(found: Column) -> Column:
    return F.regexp_replace(found, "/[0-9.]+", "")


def digest(docs: DataFrame) -> DataFrame:
    data = personal_data(docs)
    counts = [f"n_{k}" for k in BASE]
    return data.select("doc_id", *counts, F.sha2(places_only(F.col("base")), 256).alias("base_sha256"), places_only(F.col("found")).alias("spans"))


def put_together(text: Column, kind: str) -> Column:
    """The pieces between the proposals and these again, a confirmed proposal as its kind."""
    pattern = PATTERNS[kind]

    def put(acc: Column, x: Column) -> Column:
        value, piece = x["value"], x["piece"]
        _, good, carried = judged(kind, acc, value, piece)
        entry = F.concat(piece, F.when(good, F.lit(f"[{kind.upper()}]")).otherwise(F.coalesce(value, F.lit(""))))
        full = F.length(acc["last"]) > _CHUNK
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, entry).otherwise(F.concat(acc["last"], entry)).alias("last"), *carried,
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"), *nothing_before())
    proposed = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(proposed, F.split(text, pattern, -1), lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
    return F.aggregate(pairs, zero, put, lambda acc: F.concat(F.array_join(acc["done"], ""), acc["last"]))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, kind after kind; n_chars follows the text."""
    text, names = F.col("text"), docs.columns
    kind_of = docs.schema["n_chars"].dataType if "n_chars" in names else None
    given = docs
    for kind in BASE + ADDED:
        possible = text.contains("@") if kind == "email" else text.rlike("[0-9]")
        found = F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), VALID[kind])
        given = given.withColumn("text", F.when(possible & found, put_together(text, kind)).otherwise(text))
    if kind_of is not None:
        given = given.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text).cast(kind_of)))
    return given.select(*(F.col(f"`{c}`") for c in names))
