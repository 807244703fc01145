"""JSX attribute names and styles in their HTML form, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes whose name is another one in HTML.
RENAMED = {"className": "class", "htmlFor": "for"}
DYNAMIC = "[dynamic]"


def kebab(name: Column) -> Column:
    """``backgroundColor`` -> ``background-color``."""
    return F.lower(F.regexp_replace(name, r"([A-Z])", "-$1"))


def html_attribute(name: Column) -> Column:
    """``className`` -> ``class``, ``htmlFor`` -> ``for``, ``onClick`` -> ``onclick``; others stay."""
    out = F.when(name.rlike("^on[A-Z]"), F.lower(name))
    for jsx, html in RENAMED.items():
        out = out.when(name == jsx, html)
    return out.otherwise(name)


def html_value(value: Column) -> Column:
    """Quoted text without its quotes; an expression in braces is dynamic."""
    return F.when(value.rlike(r"^\{[\s\S]*\}$"), DYNAMIC).otherwise(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def html_style(style: Column) -> Column:
    """A map of style properties with names in kebab case and trimmed values."""
    return F.map_from_entries(F.transform(F.map_entries(style), lambda e: F.struct(kebab(e["key"]), F.trim(e["value"]))))
