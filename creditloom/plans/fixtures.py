"""Engine inputs shaped from the given tables; each function takes (spark, folder of parquet tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom import fixedvalues as fv
from creditloom.operators.sheets import doc_fields as _doc_fields
from creditloom.skew import number_rows
from creditloom.sources.cells import to_sheet_rows

STATED = ["debt_service_coverage", "current_ratio", "debt_to_equity", "revenue_growth"]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def gst_returns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS company_id", "o_orderkey AS return_id", "o_orderdate AS filed_at",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'GSTR3B' ELSE 'GSTR2A' END AS return_type",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS taxable_value",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.18 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS total_tax")


def bank_txns(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_custkey AS company_id", "l_shipdate AS txn_at",
        "CASE l_returnflag WHEN 'A' THEN 'NEFT Credit' WHEN 'N' THEN 'CREDIT' ELSE 'Debit' END AS transaction_type",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS amount")


def defaulters_lower(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey % 37 = 0").selectExpr(
        "concat('M/S ', upper(c_name), ' AND SONS') AS party", "concat('BANK', CAST(c_nationkey AS STRING)) AS bknm",
        "CAST(c_acctbal AS DECIMAL(18,2)) AS osamt", "CASE WHEN c_custkey % 2 = 0 THEN 'SUIT' ELSE NULL END AS suit")


def defaulters_upper(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey % 41 = 0").selectExpr(
        "c_name AS PRTY", "concat('BANK', CAST(c_nationkey AS STRING)) AS BKNM",
        "CAST(c_acctbal AS DECIMAL(18,2)) AS `OSAMT (Rs. Lac)`", "'SUIT' AS SUIT")


def _numbered_orders(spark: SparkSession, sf: str) -> DataFrame:
    return number_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"],
                       {"_block": F.expr("o_orderkey div 1048576")}, "page_no")


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered_orders(spark, sf).selectExpr(
        "o_custkey AS doc_id", "page_no",
        """CASE o_orderkey % 6
        WHEN 0 THEN concat('Statement. Total Income for the year: ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' EBITDA 1,234.50')
        WHEN 1 THEN concat('Net Worth ', CAST(o_orderkey % 9000 AS STRING), ',000 Total Borrowings: ', CAST(o_orderkey % 777 AS STRING), ' PAT: 45,000 Total Assets 9,99,000')
        WHEN 2 THEN concat('Current Ratio: 1.', CAST(o_orderkey % 10 AS STRING), CASE WHEN o_orderkey % 12 = 2 THEN '. ' ELSE ' ' END, 'D/E ratio 2.', CAST(o_orderkey % 7 AS STRING))
        WHEN 3 THEN concat('CIBIL report DPD ', CAST(o_orderkey % 61 AS STRING), ' and dpd: 12 days past due')
        WHEN 4 THEN concat('Promoter and group hold ', CAST(o_orderkey % 75 AS STRING), '.5 % Gross NPA ', CAST(o_orderkey % 8 AS STRING), '.25 PAR 90 2.5')
        ELSE 'Suit Filed. Loan written off. DSCR 1.8 Interest Coverage 2.4' END AS text""")


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two-column tables: label and value, numbered from one within a document."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    numbered = number_rows(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
                           {"_line": F.col("l_linenumber"), "_block": F.expr("l_partkey div 65536")}, "row_no")
    return numbered.selectExpr(
        "l_orderkey AS doc_id", "0 AS sheet_no", "row_no",
        """CASE l_partkey % 8 WHEN 0 THEN 'Total Revenue' WHEN 1 THEN 'Net Profit (PAT)' WHEN 2 THEN 'Debt to Equity'
        WHEN 3 THEN 'Unsecured Loans' WHEN 4 THEN 'Current Ratio' WHEN 5 THEN 'Gross NPA %' WHEN 6 THEN 'Promoter Holding' ELSE 'Remarks' END AS label""",
        """CASE l_linenumber % 4 WHEN 0 THEN concat('₹ ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING))
        WHEN 1 THEN concat('(', CAST(CAST(l_quantity AS INT) AS STRING), ',000)')
        WHEN 2 THEN concat(CAST(CAST(l_discount AS DECIMAL(4,2)) AS STRING), '%') ELSE 'n/a' END AS value""")


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The label rows as rows of a CSV with the header (label, value)."""
    return to_sheet_rows(label_rows(spark, sf), F.col("doc_id"), F.col("row_no") - 1, ["label", "value"])


def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty hits a company over its six research and three legal searches; companies grow with the table."""
    return table(spark, sf, "pages").selectExpr(
        "page_id DIV 30 AS company_id", "CASE WHEN page_id % 30 % 9 < 6 THEN 'research' ELSE 'legal' END AS kind",
        "CAST(CASE WHEN page_id % 30 % 9 < 6 THEN page_id % 30 % 9 ELSE page_id % 30 % 9 - 6 END AS INT) AS query_no", "page_id AS hit_rank", "url",
        "html AS content")


def research_replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS company_id",
        """CASE c_custkey % 6
        WHEN 0 THEN '```json {"overall_external_risk_rating":"Low","early_warning_signals_if_any":[]} ```'
        WHEN 1 THEN '```json {"overall_external_risk_rating":" HIGH ","early_warning_signals_if_any":["a","b","c"]} ```'
        WHEN 2 THEN '{"overall_risk":"medium"}'
        WHEN 3 THEN '{"overall_external_risk_rating":"High — manual verification required","overall_risk":"high"}'
        WHEN 4 THEN 'Sure! Here it is: {"overall_risk":"low"} Thanks.' ELSE 'not json' END AS reply""")


def applications(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS company_id", "c_name AS company_name",
        "CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE concat('U', lpad(CAST(c_custkey AS STRING), 20, '0')) END AS cin",
        "CASE WHEN c_custkey % 47 = 0 THEN '' ELSE concat('AAB', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS pan",
        "CAST(1990 + c_custkey % 35 AS INT) AS incorporation_year", "CAST(7 + (c_custkey % 31) * 0.5 AS DECIMAL(10,2)) AS interest_rate",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Manufacturing' WHEN 'FURNITURE' THEN 'Textile' ELSE 'Other' END AS sector",
        "concat('Promoter ', CAST(c_custkey % 50 AS STRING), ', ', ' Customer#', lpad(CAST(c_custkey % 90 AS STRING), 9, '0')) AS promoter_names",
        "CAST(1000000 + (c_custkey * 7919) % 9000000 AS BIGINT) AS loan_amount",
        "CAST((c_custkey * 104729) % 12000000 AS BIGINT) AS collateral_value",
        "CASE c_custkey % 3 WHEN 0 THEN 'Immovable' WHEN 1 THEN 'Movable' ELSE 'None' END AS collateral_type",
        "CAST(5000000 + (c_custkey * 31) % 70000000 AS BIGINT) AS turnover",
        "CAST((c_custkey % 31) * 0.1 AS DECIMAL(10,2)) AS debt_service_coverage",
        "CAST((c_custkey % 23) * 0.1 AS DECIMAL(10,2)) AS current_ratio",
        "CAST((c_custkey % 41) * 0.1 AS DECIMAL(10,2)) AS debt_to_equity",
        "CAST((c_custkey % 37) * 0.01 AS DECIMAL(10,2)) AS revenue_growth",
        "CAST(5 + (c_custkey * 13) % 80 AS DECIMAL(10,2)) AS default_probability")


def loans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS loan_id", "CAST(o_totalprice AS DOUBLE) AS loan_amount",
        "CAST(7 + (o_orderkey * 37 % 171) * 0.1 AS DOUBLE) AS interest_rate",
        "CAST((o_orderkey * 53 % 451) * 0.1 AS DOUBLE) AS debt_to_income",
        "CAST(o_orderkey * 7919 % 150000 AS DOUBLE) AS revolving_balance",
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST((o_orderkey * 71 % 1001) * 0.1 AS DOUBLE) END AS revolving_utilities",
        "CAST(o_orderkey * 104729 % 500000 AS DOUBLE) AS total_current_balance",
        "CAST(5000 + o_orderkey * 1299 % 295000 AS DOUBLE) AS total_revolving_credit_limit",
        "CAST(CASE WHEN o_orderkey * 11 % 6 < 3 THEN 0 ELSE o_orderkey * 11 % 6 - 2 END AS DOUBLE) AS delinquency_two_years",
        "CAST(o_orderkey * 13 % 5 AS DOUBLE) AS inquiries_six_months", "CAST(1 + o_orderkey * 17 % 24 AS DOUBLE) AS open_accounts",
        "CAST(CASE WHEN o_orderkey * 19 % 5 = 4 THEN 1 ELSE 0 END AS DOUBLE) AS public_record", "CAST(2 + o_orderkey * 23 % 38 AS DOUBLE) AS total_accounts")


def wide_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with a title row, a header row and a data row for every line item of the supplier."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    numbered = number_rows(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                           {"_block": F.expr("l_orderkey div 65536")}, "rn")
    return _statement_cells(spark, sf, numbered.selectExpr(
        "l_suppkey", "CAST(l_quantity AS INT) AS q", "CAST(l_extendedprice AS DECIMAL(18,2)) AS p", "rn"))


def _statement_cells(spark: SparkSession, sf: str, ranked: DataFrame) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    heads = suppliers.selectExpr("doc_id", """inline(array(
        named_struct('row_no', 0, 'col_no', 0, 'value', 'Statement of Accounts'), named_struct('row_no', 1, 'col_no', 0, 'value', 'Particulars'),
        named_struct('row_no', 1, 'col_no', 1, 'value', ' Net Sales '), named_struct('row_no', 1, 'col_no', 2, 'value', 'EBITDA'),
        named_struct('row_no', 1, 'col_no', 3, 'value', 'Total Borrowings')))""").withColumn("is_text", F.lit(True))
    data = ranked.selectExpr("l_suppkey AS doc_id", "rn", """inline(array(
        named_struct('col_no', 0, 'value', concat('Q', CAST(rn AS STRING))),
        named_struct('col_no', 1, 'value', CASE WHEN rn = 1 THEN '0' ELSE CAST(q AS STRING) END),
        named_struct('col_no', 2, 'value', concat('₹ ', CAST(p AS STRING))),
        named_struct('col_no', 3, 'value', CASE WHEN rn % 2 = 1 THEN '-' ELSE CAST(p AS STRING) END)))""").selectExpr(
        "doc_id", "rn + 1 AS row_no", "col_no", "value", "col_no <> 1 AS is_text")
    return heads.unionByName(data).selectExpr("doc_id", "0 AS sheet_no", "row_no", "col_no", "value", "is_text")


def note_replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS company_id",
        """CASE c_custkey % 5
        WHEN 0 THEN '```json {"score_adjustment": -15} ```' WHEN 1 THEN '{"score_adjustment": 20}' WHEN 2 THEN '{"positive_signals": []}'
        WHEN 3 THEN 'no json here' ELSE '{"score_adjustment": 5, "deal_breakers": ["x"]}' END AS reply""")


def officer_notes(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as officer notes of the conversation's company."""
    return table(spark, sf, "conversations").where("role = 'user'").selectExpr("conv_id AS company_id", "turn AS note_no", "text AS note")


def conversation_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr("conv_id AS doc_id", "CAST(turn + 1 AS INT) AS page_no", "text")


def page_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The label rows of an order as table rows on the order's page."""
    pages = _numbered_orders(spark, sf).select("o_orderkey", F.col("o_custkey").alias("doc_id"), "page_no")
    rows = label_rows(spark, sf).withColumnRenamed("doc_id", "o_orderkey")
    return rows.join(pages, "o_orderkey").selectExpr(
        "doc_id", "page_no", "row_no", "inline(array(named_struct('col_no', 0, 'value', label), named_struct('col_no', 1, 'value', value)))")


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    """File names made from the document table."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id", """concat(source, '_', CAST(doc_id AS STRING), CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.csv'
        WHEN 3 THEN '.jpeg' WHEN 4 THEN '.txt' WHEN 5 THEN '.v2.xls' ELSE '' END) AS path""")


def factor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(loan_id, feature, impact) rows with one impact per feature of a loan."""
    entries = ", ".join(f"named_struct('feature', '{f}', 'impact', CAST(CAST((o_orderkey * {37 * i + 11}) % 2001 - 1000 AS DECIMAL(10,4)) * 0.0001 AS DOUBLE))"
                        for i, f in enumerate(fv.MODEL_FEATURES))
    return table(spark, sf, "orders").selectExpr("o_orderkey AS loan_id", f"inline(array({entries}))")


def doc_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_fields(spark)
