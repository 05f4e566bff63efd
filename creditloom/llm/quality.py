"""Quality rules as a short-circuit cascade.

Each rule is a boolean column that is true for a text to reject. Cost and selectivity of every rule are estimated on a
bounded sample; the rules are then tried in the order of rejections per second, and a text that one rule rejects is
not shown to the later ones. The order decides how much work is done, never which texts are kept.

Everything is built from DataFrame functions and one pass over the rows. Words are compared by 64-bit hashes; runs of
eight words by 64-bit hashes of those.

Defined results: a null or empty text has no words and zeros everywhere. Repeated rows are judged alike. Extra columns
stay; names of results and names beginning with ``_q_`` are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import SPACE

SAMPLE_ROWS = 400
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
WORDS = "_q_words"
TEXT = "_q_text"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def n_words() -> Column:
    return F.size(WORDS).cast("long")


def word_chars() -> Column:
    return F.char_length(F.array_join(WORDS, "")).cast("long")


def n_symbols() -> Column:
    return (F.size(F.split(F.col(TEXT), SYMBOLS, -1)) - 1).cast("long")


def n_dup_lines() -> Column:
    lines = F.filter(F.split(F.col(TEXT), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _covered(runs: Column) -> Column:
    """Words inside runs that occur at least twice. Sorting (hash, place) brings equal runs together; sorted places
    of repeated runs then cover eight words each, less where the next one starts earlier."""
    n = F.size(runs)
    ordered = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            same_before = (i > 0) & (F.get(s, i - 1)["h"] == x["h"])
            same_after = (i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])
            return F.coalesce(same_before, F.lit(False)) | F.coalesce(same_after, F.lit(False))

        return F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(ordered, lambda s: _let(places(s), total))


def n_repeat_words() -> Column:
    """Words in eight-word windows found twice or more in the text, the first included."""

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def count(r: Column) -> Column:
        return F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0).cast("long")).otherwise(_covered(r))

    hashes = F.transform(F.col(WORDS), lambda w: F.xxhash64(w))
    return F.when(F.size(WORDS) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(runs(h), count)))


MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``rejects`` is true, given its measures by name."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


BASE = (
    Rule("too_short", ("n_words",), lambda n: n < 20),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda n, r: r * 100 > n * 30),
)
#: Beyond the base: words of absurd length, more symbols than words, mostly repeated lines.
RULES = (
    *BASE,
    Rule("odd_words", ("n_words", "word_chars"), lambda n, c: (c > n * 25) | (c < n * 2 - n / 2)),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: s > n),
    Rule("same_lines", ("n_words", "n_dup_lines"), lambda n, d: d * 4 > n),
)


def _with_words(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumns({TEXT: text, WORDS: words_of(text)})


def _condition(rule: Rule, known: Sequence[str]) -> Column:
    return rule.rejects(*[F.col(m) if m in known else MEASURES[m]() for m in rule.needs])


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of ``rows`` rows (a documented bound; only the order depends on it)."""
    sample = _with_words(docs.select(F.col(f"`{text_col}`").alias("text")).limit(rows), "text").cache()
    try:
        sample.count()
        worth = []
        for i, rule in enumerate(rules):
            query = sample.agg(F.count_if(_condition(rule, ())).alias("n"))
            start = time.perf_counter()
            rejected = query.collect()[0]["n"]
            worth.append((-(rejected + 0.5) / max(time.perf_counter() - start, 1e-6), i))
        return [rules[i] for _, i in sorted(worth)]
    finally:
        sample.unpersist()


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", measures: bool = False, name: str = "kept") -> DataFrame:
    """Adds ``name``, and with ``measures`` all measures and ``base_failed``; else only what the cascade needs is computed."""
    ordered = order_rules(docs, rules, text_col)
    rows = _with_words(docs, text_col)
    known: tuple[str, ...] = ()
    if measures:
        known = tuple(MEASURES)
        rows = rows.withColumns({m: f() for m, f in MEASURES.items()})
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(_condition(rule, known), F.lit(False)).otherwise(verdict)
    results = {name: verdict}
    if measures:
        results["base_failed"] = _condition(BASE[0], known) | _condition(BASE[1], known)
    return rows.withColumns(results).drop(TEXT, WORDS)


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    return judge(docs, rules, text_col, name="_q_kept").where("_q_kept").select(*[f"`{c}`" for c in docs.columns])
