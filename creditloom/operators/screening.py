"""Defaulter screening and borrower history."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.rules import split_promoters

SHARD_CHARS = 1_000_000  # of the terms in one automaton
SLICE_CHARS = 1_000_000  # of the names that pass it in one task


def search_terms(applications: DataFrame) -> DataFrame:
    """One lower-cased term per company name and promoter; empty terms are dropped."""
    names = F.concat(F.array(F.coalesce("company_name", F.lit(""))), split_promoters(F.col("promoter_names")))
    return applications.select("company_id", F.explode(F.transform(names, lambda n: F.lower(n))).alias("term")).where("term <> ''")


def _pieces(texts: DataFrame, column: str, chars: int) -> int:
    """How many pieces of ``chars`` characters the texts make, each with one more for its end."""
    total = texts.agg(F.sum(F.length(column) + 1)).first()[0] or 0
    return max(1, -(-total // chars))


def substring_pairs(terms: DataFrame, names: DataFrame) -> DataFrame:
    """All (term, name) with the term inside the name, without comparing every term with every name.

    Distinct terms are dealt into shards and distinct names into slices, both of a bounded number of characters. A task makes
    one automaton of a shard, a trie with failure arcs, and lets one slice stream past it: every name is read once per shard, whatever the
    number and the lengths of the terms. Shards and slices come from the measured sizes and the texts' hashes.
    """
    terms, names = terms.where("term <> ''").select("term").distinct(), names.where("name is not null").select("name").distinct()
    shards, slices = _pieces(terms, "term", SHARD_CHARS), _pieces(names, "name", SLICE_CHARS)

    def dealt(df: DataFrame, column: str, own: str, own_count: int, other: str, other_count: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(column), F.lit(own_count)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other_count - 1).cast("bigint")))).groupBy("_shard", "_slice")

    def match(shard: pa.Table, piece: pa.Table) -> pa.Table:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in shard["term"].to_pylist():
            automaton.add_word(term, term)
        found: tuple[list[str], list[str]] = ([], [])
        if len(automaton):
            automaton.make_automaton()
            for name in piece["name"].to_pylist():
                for term in {t for _, t in automaton.iter(name)}:
                    found[0].append(term)
                    found[1].append(name)
        return pa.table({"term": pa.array(found[0], pa.string()), "name": pa.array(found[1], pa.string())})

    left, right = dealt(terms, "term", "_shard", shards, "_slice", slices), dealt(names, "name", "_slice", slices, "_shard", shards)
    return left.cogroup(right).applyInArrow(match, "term string, name string")


def blacklist_matches(applications: DataFrame, defaulters: DataFrame) -> DataFrame:
    """Every defaulter row hit by a company's terms; a row hit by several terms appears once per term.

    Terms are matched literally. Equal terms and equal names are looked up once and fanned out again by
    inner equi-joins, whose heavy keys adaptive execution can split on either side.
    """
    terms = search_terms(applications)
    rows = defaulters.withColumn("_name", F.lower("name"))
    pairs = substring_pairs(terms, rows.where(F.col("_name").isNotNull()).select(F.col("_name").alias("name")))
    hits = rows.join(pairs.withColumnRenamed("name", "_name"), "_name")
    return terms.join(hits, "term").select(
        "company_id", F.col("term").alias("matched_term"), "name", "bank", "outstanding_amount", "suit_filed")


def hit_counts(applications: DataFrame, defaulters: DataFrame) -> DataFrame:
    """``match_counts`` of ``blacklist_matches`` without its rows: the lists' rows are counted per name, summed per
    term that a name contains, and then per company."""
    terms = search_terms(applications)
    names = defaulters.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("_rows"))
    per_term = substring_pairs(terms, names.select("name")).join(names, "name").groupBy("term").agg(F.sum("_rows").alias("_rows"))
    return terms.join(per_term, "term").groupBy("company_id").agg(F.sum("_rows").alias("n_matches")).withColumn("blacklisted", F.col("n_matches") > 0)


def match_counts(matches: DataFrame) -> DataFrame:
    """Number of matches of the companies that have any."""
    return matches.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_matches")).withColumn("blacklisted", F.col("n_matches") > 0)


def blacklist_summary(matches: DataFrame | None, applications: DataFrame) -> DataFrame:
    """Flag, number of matches and risk per company; "unknown" when no list was loaded.

    The matches themselves stay rows of ``blacklist_matches``: one company may have any number of them.
    """
    if matches is None:
        return applications.select(
            "company_id", F.lit(False).alias("blacklisted"), F.lit(0).cast("bigint").alias("n_matches"), F.lit("unknown").alias("risk"))
    n = F.coalesce("n_matches", F.lit(0).cast("bigint"))
    return applications.select("company_id").join(match_counts(matches), "company_id", "left").select(
        "company_id", (n > 0).alias("blacklisted"), n.alias("n_matches"), F.when(n > 0, "critical").otherwise("clear").alias("risk"))


def with_history(applications: DataFrame, history: DataFrame, on: str = "company_name") -> DataFrame:
    """One row per application and history row with ``found``; a single row with a message if there is none.

    History stays in rows, and found and not-found companies are joined apart: an inner join lets adaptive
    execution split a company that owns a large share of the history, which an outer join would not.
    """
    found = applications.join(history, on).withColumns({"found": F.lit(True), "message": F.lit(None).cast("string")})
    known = history.select(on).distinct()
    missing = applications.join(known, on, "left_anti").withColumns({"found": F.lit(False), "message": F.lit(fv.NO_HISTORY)})
    return found.unionByName(missing, allowMissingColumns=True)
