"""Reusable column expressions. Everything here stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from both ends of a text field. SQL trim only drops blanks.
WHITESPACE = " \t\n\r\x0b\x0c"

# Fixed pattern: runs of anything but letters and digits separate search tokens.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"

# Fixed rule-of-five limits.
MAX_WEIGHT = 500
MAX_LOGP = 5
MAX_DONORS = 5
MAX_ACCEPTORS = 10
MAX_VIOLATIONS = 1


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean_list(c: Column) -> Column:
    """Trimmed items without the empty ones; a missing list is an empty list."""
    items = F.transform(c, strip)
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def fill_blank(c: Column, other: Column) -> Column:
    """``c`` unless it is null or empty, else ``other``."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def join_list(c: Column, sep: str = ",") -> Column:
    """Joined list with nulls skipped; a missing list gives the empty text."""
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def one_line(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def as_text(c: Column, data_type: str) -> Column:
    """Any value as text for comparison or CSV: lists comma-joined, null empty."""
    if data_type == "array<string>":
        return join_list(c)
    if data_type.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def with_label(node_id: Column, label: Column) -> Column:
    """``id(Label)``, the id form of the bulk-import files."""
    return F.concat(node_id, F.lit("("), label, F.lit(")"))


def list_size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def percent(part: Column, total: Column) -> Column:
    """Share of a total in percent, two decimals; null when the total is zero."""
    return F.round(F.try_divide(F.lit(100.0) * part, total), 2)


def dotted_prefix(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), n), ".")


def year_of_file(name: Column) -> Column:
    """Four digits right before ``.xml`` in a file path, null when it has none.

    The dump may also be a folder of that name with part files inside.
    """
    return F.regexp_extract(name, r"(\d{4})\.xml(?:/[^/]*)?$", 1).try_cast("int")


def preview(c: Column, length: int, tail: str = "...") -> Column:
    """The first ``length`` characters, with ``tail`` when something was cut."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(tail))).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-cased search tokens of a text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_SEPARATOR), lambda t: t != "")


def name_and_description(name: Column, description: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(description, F.lit("")))


def path_text(node_names: Column) -> Column:
    return F.concat(F.lit("Graph Path: "), F.array_join(node_names, " -> ", ""))


def pick_property(props: Column, kind: str, last: bool = True) -> Column:
    """Value of the last (or first) ``{kind, value}`` entry of that kind."""
    hits = F.filter(props, lambda p: strip(p["kind"]) == kind)
    return clean_text(F.try_element_at(hits, F.lit(-1 if last else 1))["value"])


def primary_id(ids: Column) -> Column:
    """The id marked primary, else the first one; null when there is none."""
    primary = F.try_element_at(F.filter(ids, lambda i: F.lower(i["_primary"]) == "true"), F.lit(1))
    return clean_text(F.coalesce(primary["_VALUE"], F.try_element_at(ids, F.lit(1))["_VALUE"]))


def rule_of_five(weight: Column, logp: Column, donors: Column, acceptors: Column) -> dict[str, Column]:
    """Flags, violation count and verdict over descriptor columns."""
    flags = {
        "lipinski_mw": weight <= MAX_WEIGHT,
        "lipinski_logp": logp <= MAX_LOGP,
        "lipinski_hbd": donors <= MAX_DONORS,
        "lipinski_hba": acceptors <= MAX_ACCEPTORS,
    }
    violations = sum(((~flag).cast("int") for flag in flags.values()), F.lit(0))
    return {**flags, "lipinski_violations": violations, "lipinski_compliant": violations <= MAX_VIOLATIONS}
