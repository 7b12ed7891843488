"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Native: DataFrame functions only. Every pattern scans a text in linear time: possessive runs and a
look-behind (or the end of the last match) keep a start inside a run from being tried again, which
finds the same leftmost matches as the plain pattern. Account numbers differ: words and numbers that
follow one look like its groups, so a run is proposed at each possible start, as far as it may reach,
and the account number is that part of it, up to the end of a group, which passes the checksum.

Places are running sums over matches, made in two levels of blocks, and pieces of a text are cut from
chunks of it, so a text of very many matches never copies all earlier ones or scans from its start.

Defined cases: a null text counts as empty and has no spans; very long texts are scanned whole; each
row is judged on its own, so repeated rows get equal results; an empty table gives an empty result;
extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"
_SPAN = "array<struct<s:int,e:int,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True for a string of digits whose Luhn sum ends in 0."""

    def value(i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(m: Column) -> Column:
    """True for an account number whose rearranged digits leave 1 modulo 97."""

    def of(x: Column) -> Column:
        turned = F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))

        def step(a: Column, i: Column) -> Column:
            code = F.ascii(F.substr(turned, i, F.lit(1)))
            return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), step) == 1

    return let(F.regexp_replace(m, " ", ""), of)


#: Characters of an account number by country; those of other countries may have any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def account(run: Column) -> Column:
    """The part of a run that is an account number, or null: that of the country's length, or else the longest."""

    def of(groups: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
        bare = lambda x: F.length(F.regexp_replace(x, " ", ""))
        fits = F.filter(parts, lambda x: F.when(bare(x).between(15, 34) & x.rlike("^[A-Z0-9 ]+$"), mod97(x)).otherwise(F.lit(False)))
        length = F.try_element_at(F.create_map(*[F.lit(v) for n, names in IBAN_LENGTHS.items() for c in names.split() for v in (c, n)]), F.substr(run, F.lit(1), F.lit(2)))
        return let(fits, lambda f: F.coalesce(F.get(F.filter(f, lambda x: bare(x) == length), F.lit(0)), F.get(f, F.size(f) - 1)))

    return let(F.split(run, " "), of)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that every text with a match passes.
    gate: object
    valid: object
    score: float
    #: What a passed checksum adds to the score.
    checked: float
    context: str
    base: bool = True
    #: The part of group 1 that counts, or null; the match itself takes only so many characters, so the next run may overlap.
    part: object = None
    head: int = 0


KINDS = (
    Kind("email", f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, 0.0, "mail|contact|address"),
    Kind("ip", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", lambda t: t.rlike("[0-9]\\.[0-9]"), lambda m: m.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), 0.5, 0.2, "ip|host|server|address"),
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", lambda t: t.rlike("[0-9](?:[\\x20-]?[0-9]){15}"), lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))), 0.4, 0.4, "card|visa|credit|account"),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(8, 15), 0.6, 0.0, "tel|phone|call|mobile|fax"),
    Kind("iban", "(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}", lambda t: t.rlike("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]"), lambda m: F.lit(True), 0.4, 0.4, "iban|bank|account", False, account, 4),
    Kind("secret", "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?=[\"'`\\s.,;:!?)\\]}<>]|$)", lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.3, 0.0, "token|secret|api_?key|passw|auth|bearer", False),
)


@dataclass(frozen=True)
class PiiConfig:
    """Spans of a kind that is not in the base are kept from this score on; base spans always."""

    least: float = 0.6
    #: Characters on either side in which a context word counts, and what it adds.
    window: int = 32
    context: float = 0.3


def _apart(found: Column) -> Column:
    """Those with a value that start after the end of the last one taken."""

    def step(a: Column, x: Column) -> Column:
        return F.when(x["m"].isNotNull() & (x["s"] >= F.coalesce(F.get(a, F.size(a) - 1)["e"], F.lit(0))), F.concat(a, F.array(x))).otherwise(a)

    return F.aggregate(found, F.array().cast(_SPAN), step)


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The fold of ``values`` up to each of them, for an associative step. Folds blocks of about the root of their number, so none copies much."""

    def by_block(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        part = lambda b: F.slice(v, b * width + 1, width)
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.aggregate(part(b), zero, step))

        def fold(x: Column, first: Column) -> Column:
            start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(x, start, lambda a, y: let(step(a["at"], y), lambda s: F.struct(s.alias("at"), F.concat(a["out"], F.array(s)).alias("out"))), lambda a: a["out"])

        before = lambda w: let(fold(w, zero), lambda f: F.flatten(F.transform(w, lambda _, b: fold(part(b), F.when(b == 0, zero).otherwise(F.get(f, b - 1))))))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(whole, before))

    return let(values, by_block)


def _matches(text: Column, kind: Kind) -> Column:
    """All matches with their places in code points. The pieces between matches give the places."""
    none = F.array().cast(_SPAN)

    def place(m: Column) -> Column:
        def fold(g: Column) -> Column:
            taken = lambda i: F.lit(kind.head) if kind.head else F.length(F.get(m, i))
            steps = F.transform(m, lambda _, i: (F.length(F.get(g, i)) + taken(i)).cast("int"))
            start = lambda x, i, ends: F.get(ends, i) - taken(i)
            return let(running(steps, F.lit(0), lambda a, x: a + x), lambda ends: F.transform(m, lambda x, i: F.struct(start(x, i, ends).cast("int").alias("s"), (start(x, i, ends) + F.length(x)).cast("int").alias("e"), x.alias("m"))))

        return F.when(F.size(m) == 0, none).otherwise(let(F.split(text, kind.pattern, -1), fold))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.part else 0)), place)
    if kind.part:
        parts = F.transform(found, lambda x: let(kind.part(x["m"]), lambda p: F.struct(x["s"].alias("s"), (x["s"] + F.length(p)).alias("e"), p.alias("m"))))
        found = _apart(F.filter(parts, lambda x: x["m"].isNotNull()))
    return F.when(kind.gate(text), F.filter(found, lambda x: kind.valid(x["m"]))).otherwise(none)


#: Characters of a chunk.
_CHUNK = 4096


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) of a text in chunks."""
    first = F.floor(start / _CHUNK).cast("int")
    last = F.floor(F.greatest(end - 1, start) / _CHUNK).cast("int")
    return F.substr(F.array_join(F.slice(cut, first + 1, last - first + 1), ""), start % _CHUNK + 1, end - start)


def _scored(cut: Column, kind: Kind, config: PiiConfig, found: Column) -> Column:
    def one(x: Column) -> Column:
        near = piece(cut, F.greatest(x["s"] - config.window, F.lit(0)), x["e"] + config.window)
        score = F.lit(kind.score + kind.checked) + F.when(F.lower(near).rlike(kind.context), F.lit(config.context)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["m"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    all_of = F.transform(found, one)
    return all_of if kind.base else F.filter(all_of, lambda x: x["score"] >= config.least)


def find_spans(text: Column, config: PiiConfig = PiiConfig()) -> Column:
    """Array of (kind, start, end, value, score), by kind as listed, then start."""

    def of(t: Column) -> Column:
        found = F.struct(*[_matches(t, k).alias(k.name) for k in KINDS])
        some = lambda f: F.greatest(*[F.size(f[k.name]) for k in KINDS]) > 0
        spans = lambda f: let(chunks(t), lambda cut: F.concat(*[_scored(cut, k, config, f[k.name]) for k in KINDS]))
        none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
        return let(found, lambda f: F.when(some(f), spans(f)).otherwise(none))

    return let(F.coalesce(text, F.lit("")), of)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that touch an earlier one join it."""

    def write(ordered: Column) -> Column:
        def joined(reach: Column, cut: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
            fresh = lambda x, i: F.when(x["start"] >= before(i), F.concat(piece(cut, before(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
            rest = piece(cut, F.get(reach, F.size(reach) - 1), F.length(text))
            return F.concat(F.array_join(F.transform(ordered, fresh), ""), rest)

        ends = running(F.transform(ordered, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        return let(ends, lambda reach: let(chunks(text), lambda cut: joined(reach, cut)))

    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, write))


def pii_redact(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """The documents with personal data masked; n_chars, where there is one, follows the new text."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), find_spans(F.col("text"), config).alias("_spans"))
    text = redacted(F.col("_row.text"), F.col("_spans"))
    out = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size("_spans") == 0, F.col("_row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return found.select(*[c.alias(n) for n, c in out.items()])


def pii_digest(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    found = docs.select("doc_id", find_spans(F.col("text"), config).alias("_spans"))
    base = [k.name for k in KINDS if k.base]
    only = lambda k: F.filter("_spans", lambda x: x["kind"] == k)
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return found.select(
        "doc_id",
        *[F.size(only(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("_spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        F.size("_spans").cast("long").alias("n_private"),
    )
