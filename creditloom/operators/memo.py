"""The credit memo as rows, and its file sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom import fixedvalues as fv
from creditloom.functions.numbers import format_inr
from creditloom.functions.rules import rating_band
from creditloom.operators.explain import plain, styled
from creditloom.operators.research import research_items

SHOWN_SOURCES = 5
STYLED = {*fv.RUPEE_FIELDS, *fv.PERCENT_FIELDS, *fv.RATIO_FIELDS}


def _financial(field: str, kind: str) -> Column:
    """A value as the memo's financial analysis shows it; counts without decimals, texts as they are."""
    if field in STYLED:
        return styled(field, F.col(field))
    return F.col(field) if kind == "string" else F.col(field).try_cast("bigint").cast("string")


def _item(section: int, no: int, label: str, value: Column) -> Column:
    title = "CREDIT APPRAISAL MEMO (CAM)" if section < 0 else fv.MEMO_SECTIONS[section]
    return F.struct(F.lit(section + 1).alias("sec_no"), F.lit(no).alias("item_no"), F.lit(title).alias("title"),
                    F.lit(label).alias("label"), value.cast("string").alias("value"))


def memo_sections(cases: DataFrame, assessment_date: str, prepared_by: str = "creditloom", notes: DataFrame | None = None) -> DataFrame:
    """(company_id, decision, sec_no, item_no, title, label, value) rows of every memo, in section order.

    All sections come from one pass over the cases, exploded within the row. ``notes`` (company_id, note_no,
    note) adds rows ordered by number; ``cases`` is then read twice, so it should be a stored table.
    """
    banner = F.lit("OVERALL RATING: MEDIUM RISK ⚠️")
    for decision, text in fv.MEMO_BANNERS.items():
        banner = F.when(F.col("decision") == decision, text).otherwise(banner)
    date = F.lit(assessment_date)
    premium = F.coalesce(F.concat(plain(F.col("risk_premium")), F.lit("%")), F.lit("N/A"))
    itc = F.concat(F.lit("GSTR-2B Analysis — "), F.when(F.col("gst_risk_level") == "high", "High Risk").otherwise("Compliant"))
    flags = F.when(F.size("gst_flags") > 0, F.array_join("gst_flags", ", ")).otherwise(fv.NO_WARNINGS)
    sources = F.array_join(F.slice("sources", 1, SHOWN_SOURCES), ", ")
    zero = F.lit(0).cast("decimal(28,2)")
    types = dict(cases.dtypes)
    items = [
        _item(-1, 0, "meta", F.concat(F.lit("Borrower: "), F.col("company_name"), F.lit("  |  Date: "), date, F.lit(f"  |  Prepared by: {prepared_by}"))),
        _item(-1, 1, "banner", banner),
        _item(0, 0, "Company Name", F.col("company_name")),
        _item(0, 1, "Loan Requested", format_inr(F.col("loan_amount_requested"))),
        _item(0, 2, "Assessment Date", date),
        _item(0, 3, "Sector Outlook", F.initcap("sector_outlook")),
        _item(0, 4, "Collateral Type", F.initcap("collateral_type")),
        _item(0, 5, "Net Worth", format_inr(F.col("net_worth"))),
        _item(1, 0, "", F.col("explanation")),
        _item(2, 0, "Decision", F.col("decision")),
        _item(2, 1, "Credit Limit", format_inr(F.col("credit_limit"))),
        _item(2, 2, "Risk Premium", premium),
        _item(2, 3, "Credit Score", F.concat(plain(F.col("score")), F.lit("/100"))),
        _item(2, 4, "Ml Model Score", F.concat(plain(F.col("ml_score")), F.lit("/100"))),
        *[_item(3, i, c.title(), F.concat(F.lit(f"{c.title()} ("), F.col(c).cast("string"), F.lit("/100 — "), rating_band(F.col(c)), F.lit(f"): {text}")))
          for i, (c, text) in enumerate(fv.FIVE_CS_TEXTS.items())],
        *[_item(4, i, f.replace("_", " ").title(), _financial(f, types[f])) for i, f in enumerate(fv.FINANCIAL_KEYS)],
        *([_item(4, len(fv.FINANCIAL_KEYS), "Turnover", plain(F.col("turnover")))] if "turnover" in types else []),
        _item(5, 0, "Gst Revenue", format_inr(F.coalesce("gst_revenue", zero))),
        _item(5, 1, "Bank Credits", format_inr(F.coalesce("bank_credits", zero))),
        _item(5, 2, "Discrepancy", F.concat(plain(F.col("discrepancy_pct")), F.lit("%"))),
        _item(5, 3, "Itc Compliance", itc),
        _item(5, 4, "Risk Level", F.upper("gst_risk_level")),
        _item(5, 5, "Fraud Flags", flags),
        _item(6, 100, "References & Data Sources", F.when(F.size("sources") > 0, sources)),
        _item(8, 0, "", F.lit(fv.MEMO_DISCLAIMER)),
    ]
    silent = _item(7, 0, "", F.lit(fv.MEMO_NO_NOTES))
    if notes is None:
        items.append(silent)
    else:
        noted = notes.select("company_id", F.lit(True).alias("_noted")).distinct()
        cases = cases.join(noted, "company_id", "left")
        items.append(F.when(F.col("_noted").isNull(), silent))
    findings = F.transform(research_items(F.col("reply")), lambda r: F.struct(
        F.lit(7).alias("sec_no"), F.lit(0).alias("item_no"), F.lit(fv.MEMO_SECTIONS[6]).alias("title"), r.label.alias("label"), r.content.alias("value")))
    rows = F.concat(F.array_compact(F.array(*items)), findings)
    out = cases.select("company_id", "decision", F.inline(rows)).where(F.col("value").isNotNull())
    if notes is not None:
        out = out.unionByName(notes.join(cases.select("company_id", "decision"), "company_id").select(
            "company_id", "decision", F.lit(8).alias("sec_no"), F.col("note_no").cast("int").alias("item_no"),
            F.lit(fv.MEMO_SECTIONS[7]).alias("title"), F.lit("").alias("label"), F.col("note").alias("value")))
    return out


def memo_name(company_name: Column, stamp: str) -> Column:
    return F.concat(F.lit("CAM_"), F.replace(company_name, F.lit(" "), F.lit("_")), F.lit(f"_{stamp}"))


def write_memos(memos: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Memo rows under one folder per decision, and beside them a manifest: the complete files with their rows, written last."""
    memos.write.mode("overwrite").partitionBy("decision").format(fmt).save(path)
    files = memos.sparkSession.read.format(fmt).schema(memos.schema).load(path).groupBy("decision", F.col("_metadata.file_path").alias("file"))
    files.agg(F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(f"{path}-manifest")


def read_memos(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """The memo rows of the files in the manifest. Raises if there is no manifest, or if it lists rows that are not there any more."""
    manifest = spark.read.parquet(f"{path}-manifest")
    reader = spark.read.format(fmt) if schema is None else spark.read.format(fmt).schema(schema)
    rows = reader.load(path).withColumn("_file", F.col("_metadata.file_path"))
    rows = rows.join(manifest.select(F.col("file").alias("_file")), "_file", "left_semi").drop("_file")
    if rows.count() != (manifest.agg(F.sum("n_rows")).first()[0] or 0):
        raise ValueError(f"{path} has not all the rows its manifest lists; it was written again or damaged")
    return rows
