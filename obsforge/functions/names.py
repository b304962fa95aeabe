"""Names of exported samples: build them, read them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats existing exports use. {date} is yyyy-MM-dd.
NAME_FORMATS = {
    "current": "locust_{date}_label_{label}_{country}_idx_{id}",
    "plain": "locust_{date}_label_{label}_idx_{id}",
    "numbered": "locust_{date}_label_{label}_{number}",
    "scene": "patch_idx_{id}_{date_}_label_{label}",
    "multiscale": "Klein_MultiScale_locust_{date}_label_{label}_idx_{id}",
}
# What a reader accepts; groups are date, label, country, id.
NAME_PATTERN = r"^locust_([0-9]{4}-[0-9]{2}-[0-9]{2})_label_([0-9])_(?:(.+)_)?idx_([0-9]+)(?:\.tiff?)?$"
NUMBERED_PATTERN = r"^locust_([0-9]{4}-[0-9]{2}-[0-9]{2})_label_([0-9])_([0-9]+)(?:\.tiff?)?$"


def build_name(kind: str, day: Column, label: Column, row_id: Column, country: Column | None = None) -> Column:
    """Export name of a sample. `numbered` counts from one, the others keep the id."""
    parts = {
        "date": F.date_format(day, "yyyy-MM-dd"),
        "date_": F.date_format(day, "yyyy_MM_dd"),
        "label": label.cast("int").cast("string"),
        "country": F.coalesce(country if country is not None else F.lit(None).cast("string"), F.lit("unknown")),
        "id": row_id.cast("string"),
        "number": (row_id + 1).cast("string"),
    }
    pieces: list[Column] = []
    rest = NAME_FORMATS[kind]
    while rest:
        literal, brace, rest = rest.partition("{")
        if literal:
            pieces.append(F.lit(literal))
        if brace:
            field, _, rest = rest.partition("}")
            pieces.append(parts[field])
    return F.concat(*pieces)


def _group(name: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, index), F.lit(""))


def parse_name(name: Column) -> Column:
    """Struct of date, label, country and id; all NULL when the name is not an export name.

    Accepts the name with or without a country and the older numbered form,
    whose number minus one is the id.
    """
    date = F.coalesce(_group(name, NAME_PATTERN, 1), _group(name, NUMBERED_PATTERN, 1))
    label = F.coalesce(_group(name, NAME_PATTERN, 2), _group(name, NUMBERED_PATTERN, 2))
    row_id = F.coalesce(
        _group(name, NAME_PATTERN, 4).try_cast("bigint"),
        _group(name, NUMBERED_PATTERN, 3).try_cast("bigint") - 1,
    )
    day = F.try_to_date(date, "yyyy-MM-dd")
    known = day.isNotNull()
    return F.struct(
        F.when(known, day).alias("date"),
        F.when(known, label.cast("int")).alias("label"),
        F.when(known, _group(name, NAME_PATTERN, 3)).alias("country"),
        F.when(known, row_id).alias("id"),
    )


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")


def label_from_name(name: Column) -> Column:
    """The integer after the token `label`; NULL without one, or when an INT cannot hold it."""
    tokens = F.split(_stem(name), "_")
    at = F.array_position(tokens, F.lit("label"))
    token = F.when(at > 0, F.get(tokens, at.cast("int")))
    return F.when(token.rlike("^-?[0-9]+$"), token.try_cast("int"))


def flag_from_name(name: Column) -> Column:
    """1 when the lower-case file name holds `presence` or `label_1`, else 0."""
    low = F.lower(F.element_at(F.split(name, "/"), -1))
    return (low.contains("presence") | low.contains("label_1")).cast("int")


def index_from_name(name: Column) -> Column:
    """The last token, when it is a number that a BIGINT holds."""
    token = F.element_at(F.split(_stem(name), "_"), -1)
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("bigint"))
