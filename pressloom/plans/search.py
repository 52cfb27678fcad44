"""The search box: words, phrases, and / or / not as a Column over title and content."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions.columns import fold, fold_literal

# What the box takes for operators.
_AND, _OR, _NOT = {"AND", "ET", "&&", "&"}, {"OR", "OU", "||", "|"}, {"NOT", "SAUF", "NON"}


def _marks(text: str, default: str) -> list[str]:
    """'(', ')', 'AND', 'OR', 'NOT' or '=term' in order, the default operator between neighbours that have none."""
    out: list[str] = []
    for mark in re.findall(r'"[^"]*"|[()]|[^\s()]+', text):
        word = mark.upper()
        kinds = [k for k, names in (("AND", _AND), ("OR", _OR), ("NOT", _NOT)) if word in names]
        dashed = mark[0] == "-" and len(mark) > 1
        new = kinds or ([mark] if mark in "()" else ["NOT", "=" + mark[1:].strip('"')] if dashed else ["=" + mark.strip('"')])
        if out and (out[-1] == ")" or out[-1][0] == "=") and (new[0] in ("NOT", "(") or new[0][0] == "="):
            out.append("AND" if new[0] == "NOT" else default)
        out += new
    return out


def keyword_filter(text: str | None, default: str = "AND", title: str = "title", content: str = "content") -> Column | None:
    """A predicate for the box's text; None if it is blank.

    A term is found anywhere in title or content, accents and case aside; its
    own % and _ stay wildcards. or binds less than and, that less than not.
    Neighbours are joined by the default operator, a not always by and. A
    missing operand is true; an unmatched ) ends the reading. Rows whose title
    and content are null match neither a term nor its negation.
    """
    if not text or not text.strip():
        return None
    marks = _marks(text.strip(), default)[::-1]  # read from the end of the list

    def level(names: str, below, join, row: Column) -> Column:
        parts = [below(row)]
        while marks and marks[-1] == names:
            marks.pop()
            parts.append(below(row))
        return reduce(join, parts)

    def either(row: Column) -> Column:
        return level("OR", both, lambda a, b: a | b, row)

    def both(row: Column) -> Column:
        return level("AND", single, lambda a, b: a & b, row)

    def single(row: Column) -> Column:
        mark = marks.pop() if marks else ""
        if mark == "NOT":
            return ~single(row)
        if mark == "(":
            inside = either(row)
            if marks and marks[-1] == ")":
                marks.pop()
            return inside
        if mark[:1] == "=":
            like = f"%{fold_literal(mark[1:])}%"
            return row["title"].ilike(like) | row["content"].ilike(like)
        return F.lit(True)

    # inside a lambda, title and content are folded once for a row and not again for each term
    folded = F.array(F.struct(fold(F.col(title)).alias("title"), fold(F.col(content)).alias("content")))
    return F.get(F.transform(folded, either), F.lit(0))
