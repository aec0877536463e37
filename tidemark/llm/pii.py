"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score; native expressions only.

Positions come from cutting the text at the matches: the pieces between them and the matches themselves, in turn, give
every start and end in code points, summed in blocks of about the root of their number. Patterns avoid Java's recursion and repeated scans of long runs: a match may begin
only where a run of its first characters begins or where the match before it ended, and loops are possessive
wherever what follows can't match what they took; the matches are the same as the plain patterns'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

# Patterns of the base kinds, then of the added ones.
_NAME = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Cheap test that a text can hold a match at all.
    hint: str
    #: Score of a confirmed match without context; below THRESHOLD it needs context words.
    score: float
    context: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", EMAIL, "@", 0.9, ("mail", "contact", "write")),
    Kind("ip", IP, r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address")),
    Kind("card", CARD, r"[0-9][\x20-]?[0-9]", 0.8, ("card", "visa", "payment", "credit")),
    Kind("phone", PHONE, r"\+[0-9]", 0.7, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.8, ("iban", "account", "bank", "konto"), base=False),
    Kind("ssn", SSN, r"[0-9]-[0-9]{2}-[0-9]", 0.3, ("ssn", "social", "security"), base=False),
    Kind("secret", SECRET, r"AKIA|gh[pousr]_|sk-", 0.8, ("key", "token", "secret"), base=False),
)
THRESHOLD, BONUS, WINDOW = 0.5, 0.3, 48


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn checksum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where an IBAN (spaces allowed) has remainder 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda rest, c: F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    """The validator of a kind on a match."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9[0-9]{2})-|-00-|-0000$")
    return F.lit(True)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat_ws(" ", F.right(before, F.lit(WINDOW)), F.left(after, F.lit(WINDOW))))
    return F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(r"\b(?:" + "|".join(kind.context) + r")\b"), BONUS).otherwise(0.0))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is used more than once and worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)


def _blocks(x: Column) -> Column:
    """Sums of the blocks of `block` numbers each."""
    count = F.ceil(F.size(x["each"]) / x["block"]).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: _sum(F.slice(x["each"], k * x["block"] + 1, x["block"])))


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind's spans, by start; the spans of base kinds are never scored out."""
    spans_type = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    bound = F.struct(F.split(text, kind.pattern).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))

    def placed(b: Column) -> Column:
        lengths = F.transform(b["found"], lambda m, i: (F.length(F.get(b["pieces"], i)) + F.length(m)).cast("long"))
        return _once(F.struct(lengths.alias("each"), F.ceil(F.sqrt(F.size(b["found"]))).cast("int").alias("block")), lambda x: _once(_blocks(x), lambda sums: F.transform(F.filter(F.transform(b["found"], lambda m, i: span(b, x, sums, m, i)), lambda s: s["keep"]), lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "score"))))))

    def span(b: Column, x: Column, sums: Column, m: Column, i: Column) -> Column:
        block = F.floor(i / x["block"]).cast("int")
        inside = _sum(F.slice(x["each"], block * x["block"] + 1, i - block * x["block"]))
        begin = _sum(F.slice(sums, F.lit(1), block)) + inside + F.length(F.get(b["pieces"], i))
        score = _score(kind, F.get(b["pieces"], i), F.get(b["pieces"], i + 1))
        keep = confirmed(kind.name, m) if kind.base else confirmed(kind.name, m) & (score >= THRESHOLD)
        return F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), (begin + F.length(m)).alias("end"), score.alias("score"), keep.alias("keep"))

    some = F.element_at(F.transform(F.array(bound), lambda b: F.when(F.size(b["found"]) > 0, placed(b))), 1)
    hinted = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else text.rlike(kind.hint)
    return F.coalesce(F.when(hinted, some), F.array().cast(spans_type))


def find_pii(documents: DataFrame, id_col: str = "doc_id", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """id and `<kind>_spans` for every row.

    Null and empty texts have no spans; repeated rows and ids stay; an empty table gives no rows; other columns are not
    read. A text is searched whole; with n matches its spans take n to the power 1.5 steps.
    """
    rows = documents.select(F.col(id_col), text_of().alias("text"))
    return rows.select(id_col, *(spans_of(F.col("text"), k).alias(f"{k.name}_spans") for k in kinds))


def joined_spans(columns: list[Column]) -> Column:
    return F.array_join(F.transform(F.concat(*columns), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The text with each confirmed span replaced by `<KIND>`, kind after kind.

    What a replacement leaves is searched by the kinds after it, so overlapping spans of two kinds are covered by the first.
    """
    for kind in (*kinds[:1], *(k for k in kinds[1:] if not k.base), *(k for k in kinds[1:] if k.base)):
        text = _redacted(text, kind)
    return text


def _redacted(text: Column, kind: Kind) -> Column:
    def cut(t: Column) -> Column:
        return F.struct(F.split(t, kind.pattern).alias("pieces"), F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)).alias("found"))

    def rebuilt(b: Column) -> Column:
        def shown(p: Column, i: Column) -> Column:
            m = F.get(b["found"], i)
            keep = confirmed(kind.name, m)
            if not kind.base:
                keep = keep & (_score(kind, p, F.get(b["pieces"], i + 1)) >= THRESHOLD)
            return F.concat(p, F.when(m.isNull(), "").when(keep, f"<{kind.name.upper()}>").otherwise(m))

        return F.array_join(F.transform(b["pieces"], shown), "")

    hinted = lambda t: F.contains(t, F.lit(kind.hint)) if kind.hint == "@" else t.rlike(kind.hint)
    return _once(text, lambda t: F.when(hinted(t), _once(cut(t), rebuilt)).otherwise(t))
