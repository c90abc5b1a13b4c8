"""Labels and scores out of a model's replies. A null reply is a failed call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that state uncertainty.
UNCERTAIN = ("uncertain", "unsure", "not sure", "can't tell", "cannot tell", "no difference", "equal", "tie", "both", "neither")
WHITE = " \t\n\r\f\x0b"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def strip_think(c: Column) -> Column:
    """The reply without its reasoning."""
    return stripped(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))


def first_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n"), 1)


def last_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n"), -1)


def parse_preference(c: Column) -> Column:
    """0, 1 or -1: a lone -1 anywhere, else a lone 0, else a lone 1, else what the first line says; -1 if it says nothing."""
    text = strip_think(c)
    line = first_line(text)
    unsure = F.lower(line).rlike("|".join(UNCERTAIN))
    label = (
        F.when(text.rlike(r"(?<![0-9])-1(?![0-9])"), -1)
        .when(text.rlike(r"\b0\b"), 0)
        .when(text.rlike(r"\b1\b"), 1)
        .when(unsure | line.contains("-1"), -1)
        .when(line.contains("0"), 0)
        .when(line.contains("1"), 1)
    )
    return F.coalesce(label, F.lit(-1))


def parse_single(c: Column) -> Column:
    """0, 1 or -1 by what the reply contains, -1 before 0 before 1."""
    return F.coalesce(F.when(c.contains("-1"), -1).when(c.contains("0"), 0).when(c.contains("1"), 1), F.lit(-1))


def parse_int(c: Column, line: str = "last") -> Column:
    """The whole number on the first or last line, if it is a label; else -1."""
    chosen = {"first": first_line, "last": last_line}[line](stripped(c))
    number = stripped(chosen).try_cast("int")
    return F.coalesce(F.when(number.isin(0, 1), number), F.lit(-1))


def parse_score(c: Column) -> Column:
    """A score from 0 to 1 on the first line, scaled to [-1, 1]; null if it is no number or the reply for "unsure", -1."""
    number = stripped(first_line(stripped(c))).try_cast("double")
    return F.when((number != -1) & ~F.isnan(number) & (F.abs(number) < float("inf")), number * 2 - 1)
