"""Entity ids and place names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator between parent and child in an entity id.
SEP = " | "


def compose(parent: Column, child: Column) -> Column:
    """``parent | child``; null when either part is null."""
    return F.concat(parent, F.lit(SEP), child)


def split_parent(entity: Column) -> Column:
    return F.when(F.contains(entity, F.lit(SEP)), F.split(entity, r" \| ", 2)[0]).otherwise(entity)


def split_child(entity: Column) -> Column:
    """Everything after the first separator, or an empty text when there is none."""
    return F.coalesce(F.get(F.split(entity, r" \| ", 2), F.lit(1)), F.lit(""))


def normalize_name(name: Column) -> Column:
    """Key for matching place names: letters only, ``&`` spelt out, "island(s)" dropped."""
    text = F.replace(F.lower(name), F.lit("&"), F.lit("and"))
    return F.regexp_replace(F.regexp_replace(text, "islands?", ""), "[^a-z]", "")


def district_key(name: Column) -> Column:
    """District name in lower case without a trailing " district"."""
    return F.regexp_replace(F.lower(name), " district$", "")
