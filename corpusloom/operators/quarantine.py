"""Rows that fail to parse: every column as nullable text, rules into an error array, split by empty arrays.

The operator knows nothing of a file format. A caller gives a *parse* of the raw text into columns (nullable
text, no cast that can fail) and *rules*: a reason with a condition that is true where the row breaks it. All
rules of a row are evaluated as built-in column expressions in one pass, without a shuffle; the broken ones
stand in ``errors`` in the order of the rules. Rows with an empty array are the valid ones.

Defined results: a condition that is null counts as not broken (rules say themselves what null means); rows
delivered again give equal errors; an empty table gives two empty tables; very long texts are handled by
per-field expressions, not by a regular expression that nests per field; the names of added columns
(``errors`` and what the parse adds) start with the prefix ``_q_`` until the result is chosen, so columns of the
input with clashing names survive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ERRORS = "_q_errors"

#: White space of a review line.
SPACE = " \t\r\n"
#: The label strings of a review line and the labels they stand for.
LABELS = {"#label#:positive": 1, "#label#:negative": 0}
LABEL_START = "#label#"
MAX_INT = 2147483647


@dataclass(frozen=True)
class Rule:
    """A reason, and the condition under which a row fails for it."""

    reason: str
    broken: Column


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a generator of one row, which the optimizer neither copies
    into every later use nor merges into a filter."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with an array of the reasons that hold, in the order of the rules."""
    if not rules:
        return df.withColumn(ERRORS, F.array().cast("array<string>"))
    found = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.reason)) for r in rules]))
    return once(df, **{ERRORS: found})


def split_rows(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows without errors, failed rows with the column ``_q_errors``); each keeps the columns of ``df``."""
    checked = with_errors(df, rules)
    return checked.where(F.size(ERRORS) == 0).drop(ERRORS), checked.where(F.size(ERRORS) > 0)


def typed_rules(types: dict[str, str], required: Sequence[str] = ()) -> list[Rule]:
    """Rules for text columns that must cast to a type (``cast:NAME``) or must not be null (``null:NAME``)."""
    rules = [Rule(f"null:{c}", F.col(c).isNull()) for c in required]
    return rules + [Rule(f"cast:{c}", F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()) for c, t in types.items()]


def _rtrim(text: Column) -> Column:
    ends = F.right(text, F.lit(1)).isin(*SPACE)
    return F.when(ends, F.rtrim(text, F.lit(SPACE))).otherwise(text)


def parse_review_lines(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """Adds the nullable text columns of a review line: ``_q_body``, the unquoted line, ``_q_label``, its last field,
    and ``_q_rest``, the fields before it, each followed by a blank."""
    df = once(lines, _q_outer=_rtrim(F.col(text)))
    quoted = F.col("_q_outer").startswith('"') & F.col("_q_outer").endswith('"') & (F.length("_q_outer") > 1)
    inner = F.when(quoted, F.expr("substring(_q_outer, 2, length(_q_outer) - 2)")).otherwise(F.col("_q_outer"))
    df = once(df, _q_inner=inner)
    df = once(df, _q_body=_rtrim(F.col("_q_inner")))
    df = once(df, _q_label=F.substring_index("_q_body", " ", -1))
    df = once(df, _q_rest=F.expr("left(_q_body, length(_q_body) - length(_q_label))"))
    return df.drop("_q_outer", "_q_inner")


def _entries(rest: Column) -> Column:
    """The fields of ``_q_rest`` as structs (ts, tfreq), both text; for lines whose fields have one colon each."""
    fields = F.filter(F.split(rest, " ", -1), lambda x: x != "")
    return F.transform(fields, lambda x: F.struct(F.substring_index(x, ":", 1).alias("ts"), F.substring_index(x, ":", -1).alias("tfreq")))


def _frequency(text: Column) -> Column:
    """The frequency a text stands for, null where it is none: ASCII digits only, from 1 to 2147483647."""
    number = F.when(text.rlike(r"\A0*[1-9][0-9]{0,9}\z"), F.ltrim(text, F.lit("0")).try_cast("bigint"))
    return F.when(number.between(1, MAX_INT), number.cast("int"))


#: Searches in ``_q_rest``; each walks along the text without nesting, whatever its length.
OTHER_LABEL = rf"(?:\A| ){LABEL_START}"
BAD_ENTRY = r"(?:\A| )(?::|[^ :]*+ |[^ :]*+:[^ :]*+:)"
#: A frequency that is not plainly good, as one to nine digits without a leading zero are.
DOUBTFUL = r":(?![1-9][0-9]{0,8} )"


def review_line_rules(text: str = "line_text") -> list[Rule]:
    """What makes a review line unloadable, in the order in which reasons are reported.

    One search over the line finds doubtful frequencies; only lines with such a one are looked at field by field.
    """
    rest = F.col("_q_rest")
    blank = F.col(text).isNull() | ~F.col(text).rlike(r"[^ \t\r\n]")
    label = ~F.col("_q_label").isin(*LABELS) | rest.rlike(OTHER_LABEL)
    value = F.when(rest.rlike(DOUBTFUL), F.exists(_entries(rest), lambda e: _frequency(e["tfreq"]).isNull()))
    return [Rule("empty", blank), Rule("quote", F.col("_q_body").contains('"')), Rule("label", label), Rule("entry", rest.rlike(BAD_ENTRY)), Rule("tfreq", value)]


def split_review_lines(lines: DataFrame, text: str = "line_text") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of raw review lines.

    Records: the columns of ``lines`` but the text, with ``features`` array<struct<ts, tfreq int>> and ``label`` int
    (1 positive, 0 negative). Rejects: the columns of ``lines`` with ``errors``, all reasons in order, and
    ``reason``, the first. Rows stay as delivered; a line delivered twice stands twice in either.
    """
    own = [c for c in lines.columns if c not in ("features", "label", "errors", "reason")]
    valid, failed = split_rows(parse_review_lines(lines, text), review_line_rules(text))
    features = F.transform(_entries(F.col("_q_rest")), lambda e: F.struct(e["ts"].alias("ts"), _frequency(e["tfreq"]).alias("tfreq")))
    label = F.coalesce(*[F.when(F.col("_q_label") == k, F.lit(v)) for k, v in LABELS.items()])
    records = valid.select(*[c for c in own if c != text], features.alias("features"), label.alias("label"))
    return records, failed.select(*own, F.col(ERRORS).alias("errors"), F.col(ERRORS)[0].alias("reason"))
