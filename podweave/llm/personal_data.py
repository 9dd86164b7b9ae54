"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Native expressions only, and nothing is shuffled. A kind's matches come from one pass over the text; only where there is
one, the text is also split at the matches, and the lengths of pieces and matches, summed up, are the offsets. A match is
judged by itself and by the pieces beside it, so that the work stays linear in the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span in which context words count, up to the next match of its kind.
CONTEXT = 50

#: What a context word adds to a score.
NEARBY = 0.3

#: Prefix sums are made in groups of so many entries.
GROUP = 256

_EMAIL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """A kind of span: what proposes it, what confirms it (match, text before it, text after it), the score it has by
    itself, the words that raise the score (a regular expression), and whether it is reported whatever its score."""

    name: str
    pattern: str
    confirmed: Callable[[Column, Column, Column], Column]
    score: float
    words: str
    base: bool = False


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _ip(match: Column, before: Column, after: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda part: F.coalesce(part.try_cast("long") <= 255, F.lit(False)))


def _card(match: Column, before: Column, after: Column) -> Column:
    return _let(_digits(match), lambda x: F.length(x).between(13, 19) & F.call_function("luhn_check", x))


def _phone(match: Column, before: Column, after: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _free(before: Column, after: Column) -> Column:
    """Whether the match is no part of a longer word or number."""
    return ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")


def mod97(account: Column) -> Column:
    """Remainder of an account number (capital letters and digits) by 97, its first four characters moved to the end and
    letters written as 10 to 35."""
    moved = F.split(F.concat(F.substring(account, 5, 1 << 20), F.substring(account, 1, 4)), "")
    return F.aggregate(moved, F.lit(0), lambda rest, c: F.pmod(
        F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55), F.lit(97)))


def _iban(match: Column, before: Column, after: Column) -> Column:
    return _let(F.replace(match, F.lit(" "), F.lit("")),
                lambda x: F.length(x).between(15, 34) & (mod97(x) == 1)) & _free(before, after)


def _ssn(match: Column, before: Column, after: Column) -> Column:
    area = F.substring(match, 1, 3)
    valid = ~area.isin("000", "666") & (area < "900") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")
    return valid & _free(before, after)


def _tel(match: Column, before: Column, after: Column) -> Column:
    return _free(before, after) & ~before.rlike(r"\+[0-9][\x20().0-9-]*$")


#: The base kinds, in the order in which they are listed. Where a run of characters can only be entered at
#: its start, the pattern says so (and gives nothing back), or a long run would be tried from each of its characters.
BASE = [
    Kind("email", rf"(?:(?<!{_EMAIL})|\G){_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda *_: F.lit(True),
         0.9, "mail|email|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, "ip|host|server|address|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.7, "card|visa|mastercard|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6, "phone|tel|call|mobile|fax", True),
]

#: Kinds beyond the base: account numbers by their checksum, the other two only beside a context word.
FURTHER = [
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", _iban, 0.8,
         "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, 0.4, "ssn|social|security"),
    Kind("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}-[0-9]{4}", _tel, 0.3, "phone|tel|telephone|call|mobile|fax"),
]

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _scanned(values: Column, zero: Column, combined: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each entry, all entries before it combined."""
    start = F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("seen"))
    return F.aggregate(values, start, lambda s, x: F.struct(
        combined(s["last"], x).cast(kind).alias("last"), F.concat(s["seen"], F.array(s["last"])).alias("seen")),
        lambda s: s["seen"])


def running(values: Column, zero: Column, combined: Callable[[Column, Column], Column], kind: str = "bigint") -> Column:
    """For each entry, all entries before it combined (associatively), in groups, so that long arrays stay cheap."""
    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / GROUP).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(values, g * GROUP + 1, F.lit(GROUP)))
    return _let(groups, lambda all_: F.flatten(F.zip_with(
        all_, _scanned(F.transform(all_, lambda g: F.aggregate(g, zero.cast(kind), lambda s, x: combined(s, x).cast(kind))), zero, combined, kind),
        lambda g, before: F.transform(_scanned(g, zero, combined, kind), lambda x: combined(before, x)))))


def _spans(kind: Kind, body: str, matches: str, least: float) -> Column:
    """array<SPAN> of one kind. `matches`: the column of its matches."""
    sides = F.split(F.col(body), kind.pattern, -1)
    lengths = F.zip_with(sides, F.col(matches), lambda piece, match: F.length(piece) + F.coalesce(F.length(match), F.lit(0)))
    rows = _let(sides, lambda pieces: F.zip_with(
        F.zip_with(pieces, running(lengths, F.lit(0), lambda a, b: a + b), lambda piece, at: F.struct(
            piece.alias("piece"), at.alias("at"))),
        F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces)), F.col(matches), lambda piece, match: F.struct(
            piece.alias("piece"), match.alias("match"))),
        lambda x, y: F.struct(
            y["match"].alias("match"), x["piece"].alias("before"), y["piece"].alias("after"),
            (x["at"] + F.length(x["piece"])).alias("start"))))
    found = F.filter(rows, lambda r: r["match"].isNotNull() & kind.confirmed(r["match"], r["before"], r["after"]))
    near = rf"(?:^|[^a-z])(?:{kind.words})(?:[^a-z]|$)"
    scored = F.transform(found, lambda r: F.struct(
        F.lit(kind.name).alias("kind"), r["start"].cast("bigint").alias("start"),
        (r["start"] + F.length(r["match"])).cast("bigint").alias("end"),
        F.when(F.lower(F.right(r["before"], F.lit(CONTEXT))).rlike(near) | F.lower(F.left(r["after"], F.lit(CONTEXT))).rlike(near),
               F.lit(min(1.0, round(kind.score + NEARBY, 3)))).otherwise(F.lit(kind.score)).alias("score")))
    return scored if kind.base else F.filter(scored, lambda r: r["score"] >= least)


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", further: list[Kind] | None = None,
         least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: key, found (array<SPAN>: kind, start, end exclusive in code points, score from 0 to 1), and
    under `carry` other columns of the input, which must not be called key or found.

    Spans of one kind don't overlap (the leftmost counts, a match that fails its check is dropped and not tried again);
    spans of different kinds may. Base kinds come first and are reported whatever their score; those of `further` (by
    default FURTHER) from `least` on. Within a kind spans ascend.

    A null text is empty and has no spans; every row is looked at by itself, so repeated rows and null keys change
    nothing. A text is one row however long it is. Other columns are not looked at.
    """
    kinds = BASE + (FURTHER if further is None else further)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).alias("_key"), body.alias("_body"), *(F.col(c).alias(f"_own_{c}") for c in carry or []))
    rows = rows.withColumns({f"_m{i}": F.regexp_extract_all("_body", F.lit(k.pattern), F.lit(0)) for i, k in enumerate(kinds)})
    none = F.array().cast(f"array<{SPAN}>")
    spans = [F.when(F.size(f"_m{i}") > 0, _spans(k, "_body", f"_m{i}", least)).otherwise(none) for i, k in enumerate(kinds)]
    return rows.select(F.col("_key").alias(key), F.concat(*spans).alias("found"), *(F.col(f"_own_{c}").alias(c) for c in carry or []))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with every span of `find` written as its kind in angle brackets; of spans that overlap
    the part not yet covered is written, by the kind that begins later. Takes the options of `find`; a null text stays.

    The text is cut as UTF-32, in which a position is found without counting.
    """
    rows = documents.select(F.struct(*documents.columns).alias("document"), F.col(key).alias("row_key"), F.col(text).alias("body"))
    found = find(rows, "row_key", "body", carry=["document", "body"], **options)
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = found.select("document", "body", F.encode("body", "UTF-32").alias("wide"), ordered.alias("spans"))
    covered = running(F.transform("spans", lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    rows = rows.withColumn("parts", F.filter(F.zip_with("spans", covered, lambda s, end: F.struct(
        end.alias("past"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), lambda p: p["end"] > p["past"]))
    last = F.coalesce(F.array_max(F.transform("parts", lambda p: p["end"])), F.lit(0)).cast("int")

    def cut(wide: Column, start: Column, size: Column) -> Column:
        return F.decode(F.substring(wide, (4 * start + 1).cast("int"), (4 * size).cast("int")), "UTF-32")

    written = _let(F.col("wide"), lambda wide: F.array_join(F.transform("parts", lambda p: F.concat(
        cut(wide, p["past"], F.greatest(p["start"] - p["past"], F.lit(0))), F.lit("<"), F.upper(p["kind"]), F.lit(">"))), ""))
    rest = F.decode(F.substring(F.col("wide"), 4 * last + 1, F.greatest(F.octet_length("wide") - 4 * last, F.lit(0))), "UTF-32")
    clean = F.when(F.size("parts") > 0, F.concat(written, rest)).otherwise(F.col("body"))
    return rows.select(*(clean.alias(c) if c == text else F.col(f"document.{c}") for c in documents.columns))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, one count per base kind (n_email and so on), base_sha256 of the base spans as text, spans (all, as text)."""
    names = [k.name for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*names))

    def count(name: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(F.col(key), *map(count, names), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
