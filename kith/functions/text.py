"""Row text: one row as ``"col: value; col: value"`` and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SEP = "; "
KEY_SEP = ": "


def _plain_number(col: Column) -> Column:
    """Number text without exponent or trailing zeros, so 0, 0.0 and 0E-3 read the same."""
    fixed = F.format_string("%.9f", col.cast("double"))
    text = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    # format_string writes a null as the word "null"
    return F.when(text == "-0", "0").when(col.isNotNull(), text)


def row_text(columns: Sequence[str], types: dict[str, T.DataType] | None = None) -> Column:
    """The row text of ``columns``; a null value leaves out its whole pair.

    With ``types`` given, float columns are written in one plain form and NaN counts as null,
    so a corpus and a seed file that infer different number types still give equal text.
    """
    parts = []
    for name in columns:
        value = F.col(f"`{name}`")
        kind = (types or {}).get(name)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), _plain_number(value))
        elif isinstance(kind, T.DecimalType):
            value = _plain_number(value)
        parts.append(F.concat(F.lit(name + KEY_SEP), value.cast("string")))
    return F.concat_ws(PAIR_SEP, *parts)


def token_pairs(text: Column) -> Column:
    """The distinct ``"col: value"`` pairs of a row text, in order."""
    return F.array_distinct(F.array_remove(F.split(text, PAIR_SEP), ""))


def text_map(text: Column) -> Column:
    """Row text as ``map<string,string>``.

    A pair is cut at its first ``": "``; a pair without one has a null value; of pairs with the
    same key the last one wins.
    """
    pairs = F.transform(
        F.array_remove(F.split(text, PAIR_SEP), ""),
        lambda p: F.struct(
            F.substring_index(p, KEY_SEP, 1).alias("k"),
            F.when(F.instr(p, KEY_SEP) > 0, p.substr(F.instr(p, KEY_SEP) + 2, F.length(p))).alias("v"),
        ),
    )
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda seen, e: F.map_concat(
            F.map_filter(seen, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
    )


def text_field(text: Column, key: str) -> Column:
    """One value of a row text, null where the key is absent."""
    return F.element_at(text_map(text), F.lit(key))
