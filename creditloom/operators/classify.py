"""Document types from names, previews, prompts and whole texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.rules import contains_any, first_rule, words_present


def classify_docs(docs: DataFrame, name: str, preview: str, out: str = "doc_type") -> DataFrame:
    """Adds the type of every document: file-name rules, then content rules, then the general type.

    Both texts are lower-cased once, ahead of the rules.
    """
    lowered = docs.withColumns({"_name": F.lower(name), "_preview": F.lower(preview)})
    chosen = F.coalesce(first_rule("_name", fv.NAME_RULES), first_rule("_preview", fv.CONTENT_RULES), F.lit(fv.DEFAULT_DOC_TYPE))
    return lowered.withColumn(out, chosen).drop("_name", "_preview")


def classify_pages(pages: DataFrame, key: str = "doc_id", text: str = "text", out: str = "doc_type") -> DataFrame:
    """The type of every whole document by the content rules, from its pages.

    Pages are joined by line ends, which no keyword holds, so the first rule of a document is the first of any page.
    """
    numbered = [(str(i), words) for i, (_, words) in enumerate(fv.CONTENT_RULES)]
    names = F.array(*[F.lit(name) for name, _ in fv.CONTENT_RULES])
    rule = first_rule("_low", numbered).cast("int")
    first = pages.select(key, F.lower(text).alias("_low")).groupBy(key).agg(F.min(rule).alias("_rule"))
    return first.select(key, F.when(F.col("_rule").isNull(), fv.DEFAULT_DOC_TYPE).otherwise(F.get(names, F.col("_rule"))).alias(out))


def classify_fallback(prompt: str) -> Column:
    return F.coalesce(first_rule(f"lower({prompt})", fv.PROMPT_RULES), F.lit(fv.DEFAULT_DOC_TYPE))


def fallback_reply(prompt: str) -> Column:
    """The reply used for a prompt column when no model answers."""
    p = f"lower({prompt})"
    return (
        F.when(contains_any(p, ["classify", "classification"]), classify_fallback(prompt))
        .when(contains_any(p, ["swot"]), json.dumps(fv.SWOT_STATIC))
        .when(contains_any(p, ["extract", "financial"]), "{}")
        .otherwise(fv.PROMPT_DEFAULT_REPLY)
    )


def detect_doc_type(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The type with most distinct keywords present; ties go to the earlier type. No shuffle, texts are read whole."""
    types = list(fv.TYPE_KEYWORDS)
    lowered = texts.select(key, F.lower(text).alias("_low"))
    scored = lowered.select(key, *[words_present("_low", words).alias(t) for t, words in fv.TYPE_KEYWORDS.items()])
    best = F.greatest(*types)
    winner = F.coalesce(*[F.when(F.col(t) == best, F.lit(t)) for t in types])
    return scored.select(key, winner.alias("detected_type"), best.alias("score"))


def apply_overrides(auto: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviewed types: an edit replaces the automatic type; missing types become the general one."""
    current = F.coalesce("auto_type", F.lit(fv.DEFAULT_DOC_TYPE))
    chosen = F.coalesce("edited_type", current)
    return auto.join(edits, "doc_id", "left").select(
        "doc_id", current.alias("auto_type"), chosen.alias("doc_type"),
        F.when(chosen == current, "AUTO").otherwise("EDITED").alias("status"))
