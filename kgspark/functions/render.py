"""Result rows as readable text, one projection per kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _line(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("unknown"))


KINDS = {
    "entity": lambda: _line("- ", text_of("canonical_name"), " (", text_of("type"), ", ", text_of("topic"), ")"),
    "fact": lambda: _line("- ", text_of("content"), " [", F.when(F.col("invalid_at").isNull(), "current").otherwise("past"), "]"),
    "message": lambda: _line("[", F.upper("role"), "] ", text_of("content")),
    "edge": lambda: _line(text_of("a_id"), " <-> ", text_of("b_id"), " x", text_of("weight")),
    "step": lambda: F.when(F.col("locked"), "[LOCKED]").otherwise(_line(text_of("from_name"), " -> ", text_of("to_name"))),
    "file": lambda: _line("- ", text_of("name"), " (", text_of("size"), " bytes)"),
}


def rendered(kind: str) -> Column:
    return KINDS[kind]()
