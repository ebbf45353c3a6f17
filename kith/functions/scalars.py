"""Scalar derivations used to shape tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(col: Column) -> Column:
    """Cast to int; text that is no number gives null instead of an error."""
    return col.try_cast("double").try_cast("int")


def tenure_months(col: Column, fmt: str = "M/d/yyyy", as_of: date | str | None = None) -> Column:
    """Whole months from a date text to ``as_of`` (today if not given), cut towards zero."""
    end = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    start = F.try_to_timestamp(col, F.lit(fmt)).cast("date")
    return F.months_between(end, start).cast("int")


def metadata_map(columns: Sequence[str]) -> Column:
    """``map<string,string>`` of the columns, every value as text."""
    entries = []
    for name in columns:
        entries += [F.lit(name), F.col(f"`{name}`").cast("string")]
    return F.create_map(*entries).cast("map<string,string>")


def meta_get(col: Column, key: str, default: str = "Unknown", encoded: bool = False) -> Column:
    """A metadata value with a default; ``encoded`` metadata is a JSON object kept as text."""
    if encoded:
        value = F.get_json_object(col, f"$['{key}']")
    else:
        value = F.try_element_at(col, F.lit(key))
    return F.coalesce(value, F.lit(default))


def same_value(a: Column, b: Column) -> Column:
    """``a = b`` as a nullable boolean."""
    return a == b


def compare(a: Column, b: Column) -> Column:
    """``same`` where both are equal, else ``different`` (also where one is null)."""
    return F.when(a == b, "same").otherwise("different")


def bucket_number(col: Column, width: float) -> Column:
    return F.floor(col / F.lit(float(width))).cast("long")


def bucket_label(col: Column, width: int, unit: int = 1000, suffix: str = "k") -> Column:
    """Fixed-width bucket as text: ``Under 5k``, ``5k - 10k``, ...; null stays null."""
    if width % unit:
        raise ValueError("width must be a multiple of unit")
    step = width // unit
    number = bucket_number(col, width)

    def edge(n: Column) -> Column:
        return F.concat((n * step).cast("string"), F.lit(suffix))

    return F.when(number < 1, F.lit(f"Under {step}{suffix}")).when(
        number >= 1, F.concat(edge(number), F.lit(" - "), edge(number + 1)))


def flag_keywords(col: Column, words: Sequence[str]) -> Column:
    """True where the lower-cased text contains any of the words."""
    text = F.lower(col)
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word.lower())
    return hit


def append_if(col: Column, condition: Column, suffix: str) -> Column:
    return F.when(condition, F.concat(col, F.lit(suffix))).otherwise(col)


def step_fields(log: Column, action: str = "Action:", action_input: str = "Action Input:") -> dict[str, Column]:
    """Thought, action and action input of one step log, cut at its marker words.

    The log is cut at every action marker: what stands before the first one is the thought, the
    piece after it holds the action and, behind the input marker, the action input.
    """
    pieces = F.split(log, r"\Q" + action + r"\E")
    body = F.try_element_at(pieces, F.lit(2))
    halves = F.split(body, r"\Q" + action_input + r"\E")
    return {
        "thought": F.try_element_at(pieces, F.lit(1)),
        "action": F.try_element_at(halves, F.lit(1)),
        "action_input": F.try_element_at(halves, F.lit(2)),
    }


def exact_sum(col: Column) -> Column:
    """The sum as a double. Values below 10^15 are added as decimals with nine places, so their order doesn't matter and no cents are cut.

    Larger ones and infinities are added as doubles; a NaN makes the sum NaN; without any value it is null.
    """
    near = F.when(F.abs(col) < 1e15, col.cast("decimal(28, 9)"))  # NaN is no smaller than any number
    exact = F.sum(near).cast("double")
    rest = F.sum(F.when(near.isNull(), col.cast("double")))
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)
