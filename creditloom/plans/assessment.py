"""The whole assessment of a borrower book as one lazy plan."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.replies import rating_text
from creditloom.operators import explain as ex
from creditloom.operators import gst as g
from creditloom.operators import model as m
from creditloom.operators import pages, research, scoring, screening, sheets


def document_facts(page_text: DataFrame, page_owner: DataFrame | None = None) -> DataFrame:
    """Facts of text documents as ``merge_facts`` takes them; without owners the document is the company."""
    facts = pages.regex_facts(page_text)
    if page_owner is not None:
        facts = facts.join(page_owner, "doc_id")
    else:
        facts = facts.withColumns({"company_id": F.col("doc_id"), "doc_order": F.lit(0).cast("bigint")})
    return facts.select("company_id", F.lit("pdf").alias("source_kind"), "doc_order", "field", "value")


def workbook_facts(rows: DataFrame, owner: DataFrame) -> DataFrame:
    """Facts of spreadsheets; ``owner`` has doc_id, company_id and doc_order."""
    facts = sheets.sheet_facts(rows).where(F.col("field").isin(scoring.SHEET_FIELDS))
    return facts.join(owner, "doc_id").select("company_id", F.lit("sheet").alias("source_kind"), "doc_order", "field", "value")


def ratings(replies: DataFrame) -> DataFrame:
    """Rating text of every reply. Replies too short to be one are replaced first, and named in ``quota_warnings``."""
    checked = replies.select("company_id", *research.usable_reply("reply"))
    return checked.withColumn("risk_rating", rating_text(F.col("reply")))


def decided(cases: DataFrame) -> DataFrame:
    """Scores, decision, blacklist override, warnings and explanations of assembled cases; no shuffle."""
    scored = scoring.blend_score(scoring.five_cs(cases))
    return ex.explain(scoring.early_warnings(scoring.override_blacklisted(scoring.decide(scored))))


def assemble(applications: DataFrame, gst: DataFrame, bank: DataFrame, replies: DataFrame, defaulters: DataFrame | None,
             facts: DataFrame | None = None, stated: list[str] | None = None, ml: DataFrame | None = None) -> DataFrame:
    """One case row per applicant from all inputs.

    ``ml`` holds model probabilities; without it they are a column of ``applications``.
    """
    keep = ["company_name"] + (["default_probability"] if ml is None else [])
    financials = scoring.base_financials(applications, stated or [], keep)
    if facts is not None:
        financials = scoring.merge_facts(financials, facts)
    listed = None
    if defaulters is not None:
        listed = screening.hit_counts(applications, defaulters)
    return scoring.assemble_case(financials, g.cross_verify(gst, bank), ratings(replies), listed, ml)


def assess(*args, **kwargs) -> DataFrame:
    """Decision, limit, premium, warnings and explanation for every applicant; takes the inputs of ``assemble``."""
    return decided(assemble(*args, **kwargs))


def model_scores(applications: DataFrame, model: PipelineModel) -> DataFrame:
    """Default probabilities of applicants from their financial rows."""
    features = scoring.model_features(scoring.base_financials(applications))
    return m.score_loans(features, model, key="company_id")
