"""Names: validity, similarity and role scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivener.functions.text import num_tokens


def valid_person_name(c: Column) -> Column:
    """No CJK ideograph, fewer than five tokens and twenty characters."""
    return ~F.rlike(c, F.lit(r"[一-鿿]")) & (num_tokens(c) < 5) & (F.length(c) < 20)


def valid_length(c: Column, kind: str) -> Column:
    """Token bounds of synthetic training entities."""
    n = num_tokens(c)
    return {"role": n < 3, "person": n < 3, "org": (n > 1) & (n < 4)}[kind]


def is_subset(a: Column, b: Column) -> Column:
    """Whether all tokens of ``a`` are tokens of ``b``."""
    return F.size(F.array_except(F.split(a, " ", -1), F.split(b, " ", -1))) == 0


def rotate(c: Column, by: int) -> Column:
    """Tokens moved one place to the left (1) or right (-1)."""
    t = F.split(c, " ", -1)
    n = F.size(t)
    turned = F.concat(F.slice(t, 2, n), F.slice(t, 1, 1)) if by > 0 else F.concat(F.slice(t, n, 1), F.slice(t, 1, n - 1))
    return F.array_join(turned, " ")


def name_distance(a: Column, b: Column) -> Column:
    """1 if the several tokens of ``b`` are tokens of ``a``, else the least edit distance of ``a`` and its rotations to ``b``."""
    x, y = F.lower(a), F.lower(b)
    least = F.least(F.levenshtein(x, y), F.levenshtein(F.lower(rotate(a, 1)), y), F.levenshtein(F.lower(rotate(a, -1)), y))
    return F.when((num_tokens(b) > 1) & is_subset(b, a), F.lit(1)).otherwise(least)


def role_score(doc_type: Column, role: Column, literal: bool = True) -> Column:
    """Weight of a role: 2 for leading roles, else 1.

    ``literal``: every journal role counts 2.  Otherwise a journal role has to name a chief.
    """
    r = F.lower(role)
    senior = F.contains(r, F.lit("senior"))
    journal = F.lit(True) if literal else F.contains(r, F.lit("chief")) | senior
    conference = senior | F.contains(r, F.lit("chair"))
    return F.when(F.when(doc_type == "journal", journal).otherwise(conference), F.lit(2)).otherwise(F.lit(1))
