"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score.

Everything is a DataFrame expression: no Python runs on the executors.

For one pattern, ``regexp_extract_all`` gives the leftmost non-overlapping matches and
``split`` by the same pattern the text between them, so a running sum of lengths gives
every match its place in code points, in time linear in the text.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` are found by their pattern and rule alone
and always stay.  The method adds ``iban`` (mod 97 confirms it), and ``ssn`` and
``localphone``, whose patterns are weak: they stay only where a context word
stands within ``REACH`` characters of the text, whatever else stands between, and lifts their score over ``THRESHOLD``.

Quantifiers are possessive where nothing that follows could use what they would give
back, and a match may begin only where a run begins or the last match ended.  This
changes no match; it keeps long texts linear and off the stack.

Null text reads as empty: no spans, zero counts, the hash of the empty string.  Repeated
rows each give a row, a null id is passed on, columns that are not named are left out of
``find`` and passed on by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import free_names

REACH = 40
SHORTEST = 11  # characters of the shortest match of a kind with context
THRESHOLD = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # Java
    guard: str  # a cheap pattern that every match holds
    score: float
    context: str = ""  # words that add LIFT when near
    whole: bool = False  # no letter or digit may touch the match


LIFT = 0.35
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.8),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}", 0.7, whole=True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]", 0.3, r"ssn|social security|tax id", True),
    Kind("localphone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", r"[0-9][.-][0-9]{4}", 0.3, r"phone|tel|call|mobile|fax", True),
)


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes Luhn's check."""
    back = F.reverse(digits)
    doubled = F.translate(back, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(19):
        digit = F.substring(back if i % 2 == 0 else doubled, i + 1, 1)
        total = total + F.coalesce(digit.try_cast("int"), F.lit(0))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 by modulo 97 (letters count 10 to 35)."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda acc, c: F.when(value(c) > 9, acc * 100 + value(c)).otherwise(acc * 10 + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
        return match.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind.name == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def judged(kind: Kind, match: Column, before: Column, after: Column) -> Column:
    """Whether a match between two stretches of text stays."""
    good = confirmed(kind, match)
    if kind.name in BASE_KINDS:
        return good
    if kind.whole:
        good = good & ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(after, F.lit(1)).rlike("[A-Za-z0-9]")
    score = F.lit(kind.score)
    if kind.context:
        around = F.lower(F.concat(F.right(before, F.lit(REACH)), F.lit("|"), F.left(after, F.lit(REACH))))
        score = score + F.when(around.rlike(kind.context), F.lit(LIFT)).otherwise(F.lit(0.0))
    return good & (score >= THRESHOLD)


def parts(df: DataFrame, kind: Kind, text: str, matches: str, gaps: str) -> DataFrame:
    """Two array columns: the matches of a kind and the text around them (one more than matches); null without a match."""
    df = df.withColumn(matches, F.when(F.col(text).rlike(kind.guard), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))))
    return df.withColumn(gaps, F.when(F.size(matches) > 0, F.split(text, kind.pattern, -1)))


def around(kind: Kind, matches: str, gaps: str, i: Column) -> tuple[Column, Column]:
    """The ``REACH`` characters of the text before and after match ``i``, other matches of the kind included."""
    near = -(-REACH // SHORTEST)  # so many neighbouring matches can lie within reach
    part = lambda array, at: F.coalesce(F.get(array, at), F.lit(""))
    left, right = [F.right(part(gaps, i), F.lit(REACH))], [F.left(part(gaps, i + 1), F.lit(REACH))]
    for k in range(1, near + 1):
        left = [F.right(part(gaps, i - k), F.lit(REACH)), part(matches, i - k), *left]
        right += [part(matches, i + k), F.left(part(gaps, i + k + 1), F.lit(REACH))]
    return F.right(F.concat(*left), F.lit(REACH)), F.left(F.concat(*right), F.lit(REACH))


def verdicts(kind: Kind, matches: str, gaps: str) -> Column:
    """For every match its text and whether it stays."""
    none = F.lit("")
    return F.transform(
        F.col(matches),
        lambda m, i: F.struct(m.alias("m"), judged(kind, m, *(around(kind, matches, gaps, i) if kind.whole or kind.context else (none, none))).alias("ok")),
    )


def places(kind: Kind, matches: str, gaps: str) -> Column:
    """(start, end, name) of every match that stays, in code points, end exclusive."""
    array = "array<struct<start: bigint, end: bigint, name: string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(array).alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["v"]["m"]), F.lit(0))
        found = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind.name).alias("name"))
        return F.struct(end.alias("at"), F.when(x["v"]["ok"], F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    each = F.arrays_zip(F.col(gaps).alias("gap"), verdicts(kind, matches, gaps).alias("v"))
    found = F.aggregate(each, start, step, lambda acc: acc["out"])
    return F.when(F.col(gaps).isNotNull(), found).otherwise(F.array().cast(array))


def spans(kind: Kind, matches: str, gaps: str) -> Column:
    """``kind:start:end`` of every match that stays."""
    return F.transform(places(kind, matches, gaps), lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of their spans, and all spans."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for i, kind in enumerate(KINDS):
        df = parts(df, kind, "_text", f"_m{i}", f"_g{i}")
    df = df.select("doc_id", *[spans(k, f"_m{i}", f"_g{i}").alias(f"_{k.name}") for i, k in enumerate(KINDS)])
    base = F.concat_ws(",", F.flatten(F.array(*[F.col(f"_{k}") for k in BASE_KINDS])))
    return df.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.flatten(F.array(*[F.col(f"_{k.name}") for k in KINDS]))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with every confirmed span replaced by its kind in brackets.

    Spans of all kinds are found in the text as it is; those that overlap become one, named after the
    one that starts first (then the longer one), and the text is cut once: no character of a span stays.
    Null text stays null.
    """
    names = docs.columns
    mark, *own = free_names(docs, "spans", *[f"{x}{i}" for i in range(len(KINDS)) for x in ("m", "g")])
    df = docs
    for i, kind in enumerate(KINDS):
        df = parts(df, kind, f"`{text_col}`", own[2 * i], own[2 * i + 1])
    all_ = F.flatten(F.array(*[places(k, own[2 * i], own[2 * i + 1]) for i, k in enumerate(KINDS)]))
    order = F.transform(all_, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("last"), x["name"].alias("name"), x["end"].alias("end")))
    df = df.withColumn(mark, F.array_sort(order)).drop(*own)

    text = F.col(f"`{text_col}`")
    piece = lambda a, b: F.substr(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        new = x["start"] >= acc["at"]
        tag = F.array(piece(acc["at"], x["start"]), F.concat(F.lit("["), F.upper(x["name"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(new, F.concat(acc["out"], tag)).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(F.col(mark), first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), piece(acc["at"], F.length(text).cast("long"))))
    df = df.withColumn(text_col, F.when(F.size(mark) > 0, cut).otherwise(text))
    # a generator on top: a filter on the text is then not pushed below and repeated in every step
    return df.select(*[F.explode_outer(F.array(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
