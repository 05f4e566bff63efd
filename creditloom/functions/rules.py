"""Keyword rules, bands and small list helpers as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_of(column: str, words: Iterable[str]) -> str:
    return " OR ".join(f"contains({column}, {_quoted(w)})" for w in words)


def contains_any(column: str, words: Iterable[str]) -> Column:
    """Whether the named column contains one of the words. Long word lists are built as one expression text."""
    return F.expr(_any_of(column, words))


def minimal_rules(rules: Iterable[tuple[str, list[str]]], ordered: bool) -> list[tuple[str, str]]:
    """(rule, word) pairs without the words that cannot change a result.

    A word containing another word of its rule is redundant; if only the first rule counts, so is a word
    containing a word of an earlier rule.
    """
    out: list[tuple[str, str]] = []
    for name, words in rules:
        earlier = [w for _, w in out] if ordered else []
        kept = [w for w in words if not any(e in w for e in earlier) and not any(o != w and o in w for o in words)]
        out += [(name, w) for w in dict.fromkeys(kept)]
    return out


def first_rule(column: str, rules: Iterable[tuple[str, list[str]]]) -> Column:
    """The name of the first rule with a word inside the named column; null when none applies.

    A CASE, so a text is not searched beyond the first hit. Dropping the words that cannot matter also keeps
    the compiled method small enough for the JIT.
    """
    by_rule: list[tuple[str, list[str]]] = []
    for name, word in minimal_rules(rules, ordered=True):
        if by_rule and by_rule[-1][0] == name:
            by_rule[-1][1].append(word)
        else:
            by_rule.append((name, [word]))
    return F.expr("CASE " + " ".join(f"WHEN {_any_of(column, words)} THEN {_quoted(name)}" for name, words in by_rule) + " END")


def field_of(label: str, match: str = "first") -> Column:
    """Spreadsheet field named by a label column.

    ``first`` takes the first field of the dictionary with a hit (so "debt to equity" reads as net worth);
    ``longest`` takes the field whose matching keyword is longest.
    """
    if match == "first":
        return first_rule(label, fv.FIELD_KEYWORDS.items())
    if match != "longest":
        raise ValueError(f"unknown match rule: {match}")
    # The sort is stable, so equally long words keep the order of the dictionary.
    by_length = sorted(((f, w) for f, words in fv.FIELD_KEYWORDS.items() for w in words), key=lambda p: -len(p[1]))
    return first_rule(label, [(f, [w]) for f, w in by_length])


def field_mask_of(header: str) -> int:
    """All spreadsheet fields a known header feeds, as a bit per field."""
    return sum(1 << i for i, words in enumerate(fv.FIELD_KEYWORDS.values()) if any(w in header.lower() for w in words))


def field_mask(header: str) -> Column:
    """``field_mask_of`` for a lower-cased header column; a fixed-width value keeps aggregations hash-based."""
    bits = {f: i for i, f in enumerate(fv.FIELD_KEYWORDS)}
    pairs = minimal_rules(fv.FIELD_KEYWORDS.items(), ordered=False)
    listed = ", ".join(f"struct({1 << bits[f]}L AS bit, {_quoted(w)} AS word)" for f, w in pairs)
    return F.expr(f"aggregate(filter(array({listed}), p -> contains({header}, p.word)), 0L, (m, p) -> m | p.bit)")


def fields_in(mask: str) -> Column:
    """The field names of a bit mask."""
    listed = ", ".join(f"struct({1 << i}L AS bit, {_quoted(f)} AS field)" for i, f in enumerate(fv.FIELD_KEYWORDS))
    return F.expr(f"transform(filter(array({listed}), p -> ({mask} & p.bit) <> 0), p -> p.field)")


def words_present(column: str, words: Iterable[str]) -> Column:
    """How many of the words occur in the named column."""
    return F.expr(" + ".join(f"int(contains({column}, {_quoted(w)}))" for w in words))


def texts_where(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in pairs]))


def is_credit(c: Column) -> Column:
    return F.coalesce(F.lower(c).contains("credit"), F.lit(False))


def split_promoters(c: Column) -> Column:
    names = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(names, lambda x: x != "")


def slice_n(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def infer_sector(c: Column) -> Column:
    return F.when(F.lower(c).rlike("|".join(fv.SECTOR_WORDS)), "textile").otherwise("MSME")


def rating_band(c: Column) -> Column:
    return F.when(c >= 70, "Strong").when(c >= 50, "Adequate").otherwise("Weak")


def risk_band(c: Column) -> Column:
    return F.when(c > 50, "HIGH RISK").when(c > 25, "MEDIUM RISK").otherwise("LOW RISK")


def level_of(pct: Column) -> Column:
    """Mismatch percentage to a level; a missing percentage counts as zero."""
    return F.when(pct > 40, "high").when(pct > 20, "medium").otherwise("low")
