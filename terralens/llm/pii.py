"""Personal data, with DataFrame functions only.

Patterns propose spans, checks confirm them (Luhn for cards, mod 97 for bank accounts, ranges for addresses, area rules for
social security numbers), and words nearby adjust each span's score. Spans of the base kinds are kept whatever
their score; those of added kinds need ``KEEP_AT``.

Every pattern is linear on any text: quantifiers are possessive, and a look-behind keeps a search from starting again
inside a run that has already failed. ``\\G`` lets it start where the last match ended. So is the work on the spans of one text: running
values are folded in chunks, and texts around and between spans are cut from blocks of the text, not from its start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn")
#: Length of a bank account number by country: those of the registry of ISO 13616, then those in use without an entry in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI AX FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE IM JE GG ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR BL GF GP MF MQ NC PF PM RE TF WF YT GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTHS_UNLISTED = {25: "AO CV MZ GW", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}


def _iban() -> str:
    """Ends where the country's length does, so that words after it don't join it. Any other code takes the whole run. Only the first letter
    is consumed, and group 1 has the number: a false start ('SE25 GB82 WEST ...') doesn't hide what begins within it."""
    fixed = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}+" for lengths in (IBAN_LENGTHS, IBAN_LENGTHS_UNLISTED) for n, codes in lengths.items()]
    other = f"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{11,30}}+"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join([*fixed, other])})(?![A-Za-z0-9])))[A-Z]"


PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # complete chains of 12 to 19 digits: shorter and longer ones fail anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: The group that is the match, and how many characters of it a search consumes; for others the whole match.
AHEAD = {"iban": (1, 1)}
#: What a text must contain for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": r"mail|contact|write|correo|kontakt|courriel",
    "ip": r"\bip\b|server|host|address|login",
    "card": r"card|visa|master|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|telefon|tel[eé]fono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax",
}
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR, LIFT, KEEP_AT = 48, 0.2, 0.5
_CHUNK = 256
#: Code points of a block, and spans whose gaps are cut from one stretch of blocks.
_BLOCK, _CUTS = 512, 32


def _chunks(n: Column, size: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))


def _scan(items: Column, part: Callable[[Column], Column], kind: str, step: Callable[[Column, Column], tuple[Column, Column]], end: Callable[[Column, Column], Column]) -> Column:
    """Folds ``items`` with a whole number: step gives the next number and what to append, of type ``kind``; end gets the last number and all that was appended.

    part: the items of a chunk. Arrays grow within a chunk only, so many items don't copy a growing array each.
    """
    state = lambda p, o: F.struct(p.alias("p"), o.alias("o"))

    def add(b: Column, x: Column) -> Column:
        p, row = step(b["p"], x)
        return state(p, F.concat(b["o"], row))

    def chunk(a: Column, c: Column) -> Column:
        return F.aggregate(part(c), state(a["p"], F.array().cast(f"array<{kind}>")), add, lambda b: state(b["p"], F.concat(a["o"], F.array(b["o"]))))
    return F.aggregate(_chunks(F.size(items), _CHUNK), state(F.lit(0), F.array().cast(f"array<array<{kind}>>")), chunk, lambda a: end(a["p"], F.flatten(a["o"])))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text from its blocks."""
    first = F.floor(start / _BLOCK).cast("int")
    stretch = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / _BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(stretch, start - first * _BLOCK + 1, end - start)).otherwise(F.lit(""))


def _located(matches: Column, gaps: Column, consumed: int | None = None) -> Column:
    """Code-point places of the matches, from them and the texts between; in chunks, so that many matches don't copy a growing array each.

    ``consumed``: characters of a match that the texts between leave out, if not all.
    """
    def part(c: Column) -> Column:
        pairs = F.zip_with(F.slice(matches, c * _CHUNK + 1, F.lit(_CHUNK)), F.slice(gaps, c * _CHUNK + 1, F.lit(_CHUNK)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.filter(pairs, lambda x: x["m"].isNotNull())

    def step(p: Column, x: Column) -> tuple[Column, Column]:
        s = p + F.char_length(x["g"])
        e = s + F.char_length(x["m"])
        return e if consumed is None else s + consumed, F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))
    return _scan(matches, part, "struct<m:string,s:int,e:int>", step, lambda p, o: o)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """True if the digits in a text pass the Luhn check."""
    d = F.reverse(_digits(m))

    def add(a: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(v > 9, v - 9).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """True if a bank account number has the remainder 1 (letters count 10 to 35, the first four characters go last)."""
    t = F.regexp_replace(m, r"\x20", "")
    t = F.concat(F.substring(t, F.lit(5), F.char_length(t)), F.substring(t, 1, 4))

    def add(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(t, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(t)), F.lit(0), add) == 1


def _confirmed(kind: str, x: Column) -> Column:
    m = x["m"]
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.char_length(F.regexp_replace(m, r"\x20", "")).between(15, 34) & mod97(m)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, x: Column, blocks: Column) -> Column:
    start = F.greatest(x["s"] - NEAR, F.lit(0))
    around = F.lower(_between(blocks, start, start + x["e"] - x["s"] + 2 * NEAR))
    return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(around.rlike(CONTEXT[kind]), LIFT).otherwise(0.0))


def _spans_of(k: int, kind: str, blocks: Column) -> Column:
    good = F.filter(_located(F.col(f"m_{kind}"), F.col(f"g_{kind}"), AHEAD.get(kind, (0, None))[1]), lambda x: _confirmed(kind, x))
    each = F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), _score(kind, x, blocks).alias("score")))
    return each if kind in BASE_KINDS else F.filter(each, lambda x: x["score"] >= KEEP_AT)


def _count(k: int) -> Column:
    return F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")


def _find(docs: DataFrame) -> DataFrame:
    """row (the columns of ``docs``), found and blocks; a text without spans has no blocks."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    matched, gaps, spans = {}, {}, {}
    for kind, pattern in PATTERNS.items():
        needed = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        matched[f"m_{kind}"] = F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(AHEAD.get(kind, (0, None))[0]))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns(matched)
    for kind, pattern in PATTERNS.items():
        gaps[f"g_{kind}"] = F.when(F.size(f"m_{kind}") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    out = out.withColumns(gaps)
    any_match = F.greatest(*(F.size(f"m_{kind}") for kind in KINDS)) > 0
    out = out.withColumn("blocks", F.when(any_match, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for k, kind in enumerate(KINDS):
        spans[kind] = _spans_of(k, kind, F.col("blocks"))
    return out.select("row", F.array_sort(F.concat(*spans.values())).alias("found"), "blocks")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``row`` and a column ``found``: array of (s, k, e, score), by start and kind; code points, end exclusive.

    A null or empty text has none. Rows are independent; columns of ``docs`` named like internal ones are kept apart in a struct.
    """
    return _find(docs).select("row", "found")


def _joined(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans and scores."""
    base = F.filter("found", lambda x: x["k"] < len(BASE_KINDS))
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return find_personal_data(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.transform("found", lambda x: x["score"]).alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by the upper-case name of its kind in brackets; n_chars follows the text. A null text stays null."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, blocks = F.col("row.text"), F.col("blocks")
    kind = "struct<p:int,s:int,k:int>"

    def step(p: Column, x: Column) -> tuple[Column, Column]:
        cut = F.array(F.struct(p.alias("p"), x["s"].alias("s"), x["k"].alias("k")))
        return F.greatest(p, x["e"]), F.when(x["s"] >= p, cut).otherwise(F.array().cast(f"array<{kind}>"))
    # gaps [p, s) before marks, and where the last mark's text ends
    cuts = _scan(F.col("found"), lambda c: F.slice("found", c * _CHUNK + 1, F.lit(_CHUNK)), kind, step, lambda p, o: F.struct(p.alias("end"), o.alias("cuts")))
    out = _find(docs).withColumn("plan", F.when(F.size("found") > 0, cuts))

    def pieces(c: Column) -> Column:
        part = F.slice("plan.cuts", c * _CUTS + 1, F.lit(_CUTS))
        base = F.element_at(part, 1)["p"]
        stretch = F.array(_between(blocks, base, F.element_at(part, -1)["s"]))  # an array of one, so that it is cut once
        mark = lambda r, x: F.concat(F.substring(r, x["p"] - base + 1, x["s"] - x["p"]), F.element_at(names, x["k"] + 1))
        return F.array_join(F.transform(stretch, lambda r: F.array_join(F.transform(part, lambda x: mark(r, x)), "")), "")
    tail = _between(blocks, F.col("plan.end"), F.size("blocks") * _BLOCK)
    whole = F.concat(F.array_join(F.transform(_chunks(F.size("plan.cuts"), _CUTS), pieces), ""), tail)
    out = out.select("row", F.when(F.size("found") > 0, whole).otherwise(text).alias("clean"))
    return out.select(*(F.col("clean").alias("text") if c == "text" else F.char_length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
