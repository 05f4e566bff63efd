"""Independent SQL for the registered queries, written for DuckDB over the same parquet tables.

``VIEWS`` are named building blocks; every check is one SELECT over them and is emitted with just the views it
uses. Nothing here is shared with the Spark code except the fixed values.
"""

from __future__ import annotations

import re

from creditloom import fixedvalues as fv

SEP = " ; "


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_words(column: str, rules: list[tuple[str, list[str]]], default: str = "NULL") -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, {q(w)})" for w in words) + f" THEN {q(name)}" for name, words in rules)
    return f"CASE {whens} ELSE {default} END"


def inr(v: str) -> str:
    v = f"CAST({v} AS DECIMAL(20,2))"
    return (f"CASE WHEN {v} IS NULL THEN 'N/A' WHEN {v} >= 10000000 THEN concat('₹', CAST(round({v} * 0.0000001, 2)::DECIMAL(20,2) AS VARCHAR), ' Cr') "
            f"WHEN {v} >= 100000 THEN concat('₹', CAST(round({v} * 0.00001, 2)::DECIMAL(20,2) AS VARCHAR), ' L') "
            f"ELSE concat('₹', format('{{:,}}', CAST(round({v}, 0) AS BIGINT))) END")


def title(c: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"


def text_of(number: str) -> str:
    return f"CAST(CAST({number} AS DOUBLE) AS VARCHAR)"


def clean_number(c: str) -> str:
    return f"TRY_CAST(regexp_replace(replace(replace(trim({c}), '(', '-'), ')', ''), '[^0-9.-]', '', 'g') AS DOUBLE)"


def fact_union(source: str, keys: str, text: str) -> str:
    """One branch per pattern; a match that is not a number drops out."""
    branches = [
        f"SELECT {keys}, {q(f)} AS field, TRY_CAST(replace(regexp_extract(lower({text}), {q(p)}, 1), ',', '') AS DOUBLE) AS value FROM {source}"
        for f, p in fv.TEXT_PATTERNS.items()
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(branches) + ") WHERE value IS NOT NULL"


def swot_rows() -> str:
    coverage = "CAST(round(CAST(collateral_value AS DOUBLE) / greatest(loan_amount, 1), 1)::DECIMAL(20,1) AS VARCHAR)"
    slots = {"coverage": coverage, "sector": "sector", "year": "CAST(incorporation_year AS VARCHAR)"}
    rows = []
    for quadrant, points in fv.SWOT_TEMPLATES.items():
        for i, point in enumerate(points):
            parts = re.split(r"\{(\w+)\}", point)
            text = ", ".join(slots[p] if n % 2 else q(p) for n, p in enumerate(parts))
            rows.append(f"SELECT company_id, {q(quadrant)} AS quadrant, {i} AS point_no, concat({text}) AS point FROM fx_applications")
    return " UNION ALL ".join(rows)


def fanout_rows() -> str:
    rows = []
    for kind, texts in (("research", fv.RESEARCH_QUERIES), ("legal", fv.LEGAL_QUERIES)):
        for i, t in enumerate(texts):
            parts = re.split(r"\{(\w+)\}", t)
            slots = {"company": "company_name", "sector": "CASE WHEN regexp_matches(lower(company_name), 'textile|fabric|garment') THEN 'textile' ELSE 'MSME' END"}
            text = ", ".join(slots[p] if n % 2 else q(p) for n, p in enumerate(parts))
            rows.append(f"SELECT company_id, {q(kind)} AS kind, {i} AS query_no, concat({text}) AS query FROM fx_applications")
    return " UNION ALL ".join(rows)


PREMIUM = f"CASE WHEN risk_premium IS NULL THEN 'N/A' ELSE concat({text_of('risk_premium')}, '%') END"


def chain(tag: str, source: str) -> dict[str, str]:
    """Scoring views over a view of assembled cases."""
    w = fv.FIVE_CS_WEIGHTS
    rule = " + ".join(f"{c} * CAST({w[c]} AS DECIMAL(3,2))" for c in w)
    return {
        f"{tag}_five": f"""SELECT *, CASE risk_rating WHEN 'low' THEN 90 WHEN 'medium' THEN 60 WHEN 'high' THEN 30 ELSE 60 END AS character,
            50 + CASE WHEN debt_service_coverage > 1.5 THEN 10 ELSE -10 END + CASE WHEN current_ratio > 1.2 THEN 10 ELSE -10 END
               + CASE WHEN revenue_growth > 0.1 THEN 10 ELSE -5 END AS capacity,
            50 + CASE WHEN debt_to_equity < 1.5 THEN 20 ELSE -20 END + CASE WHEN net_worth > 0 THEN 10 ELSE -20 END AS capital,
            50 + CASE WHEN collateral_coverage > 1.2 THEN 20 ELSE -10 END + CASE WHEN collateral_type = 'immovable' THEN 10 ELSE 0 END AS collateral,
            50 + 20 + CASE WHEN gst_risk = 'low' THEN 10 ELSE -10 END AS conditions
            FROM {source}""",
        f"{tag}_blend": f"""SELECT *, CAST(round(CAST(rule_score * 0.5 + ml_score * 0.5 AS DECIMAL(18,4)), 2) AS DECIMAL(10,2)) AS weighted_score FROM (
            SELECT *, CAST({rule} AS DECIMAL(10,2)) AS rule_score, CAST(100 - bounded AS DECIMAL(10,2)) AS ml_score FROM (
            SELECT *, CAST(greatest(8, least(75, greatest(8, least(80, default_probability)))) AS DECIMAL(10,2)) AS bounded FROM {tag}_five))""",
        f"{tag}_raw_decision": f"""SELECT *, CASE WHEN score >= 80 THEN 'APPROVE' WHEN score >= 45 THEN 'CONDITIONAL APPROVE' ELSE 'REJECT' END AS raw_decision,
            CASE WHEN score >= 80 THEN round(CAST(loan_amount AS DECIMAL(18,0)) * CAST(score AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2)), 2)
                 WHEN score >= 45 THEN loan_amount * CAST(0.6 AS DECIMAL(2,1)) ELSE 0 END AS raw_limit,
            CASE WHEN score >= 80 THEN round(8.5 + (100 - score) * CAST(0.1 AS DECIMAL(2,1)), 2)
                 WHEN score >= 45 THEN round(10 + (100 - score) * CAST(0.15 AS DECIMAL(3,2)), 2) END AS raw_premium
            FROM (SELECT *, CAST(CASE WHEN gst_risk = 'high' OR debt_to_equity > 3 THEN least(weighted_score, 64) ELSE weighted_score END AS DECIMAL(10,2)) AS score FROM {tag}_blend)""",
        f"{tag}_decision": f"""SELECT *, CASE WHEN blacklisted THEN 'REJECT' ELSE raw_decision END AS decision,
            CASE WHEN blacklisted THEN 0 ELSE raw_limit END AS credit_limit, CASE WHEN NOT blacklisted THEN raw_premium END AS risk_premium
            FROM {tag}_raw_decision""",
        f"{tag}_told": f"""SELECT *,
            concat_ws({q(SEP)}, CASE WHEN discrepancy_pct > 40 THEN {q(fv.WARN_GST)} END, CASE WHEN debt_to_equity > 2 THEN {q(fv.WARN_LEVERAGE)} END,
                CASE WHEN blacklisted THEN {q(fv.WARN_BLACKLIST)} END) AS early_warnings,
            score BETWEEN 45 AND 65 AS officer_review,
            concat('Credit decision: ', decision, ' with score ', {text_of('score')}, '/100. ML model projects ', {text_of('bounded')},
                '% default probability. Five Cs — Character: ', character, ', Capacity: ', capacity, ', Capital: ', capital, ', Collateral: ', collateral,
                ', Conditions: ', conditions, '. Manual review recommended.') AS explanation,
            CASE WHEN discrepancy_pct > 40 THEN concat('a ', {text_of('discrepancy_pct')}, '% GST-bank discrepancy suggesting revenue inflation')
                WHEN character < 40 THEN {q(fv.REASON_CHARACTER)} WHEN bounded > 50 THEN concat('ML model projects ', {text_of('bounded')}, '% default probability')
                WHEN capacity >= 70 THEN concat('strong repayment capacity with DSCR of ', {text_of('debt_service_coverage')}, 'x')
                ELSE concat('overall credit score of ', {text_of('score')}, '/100') END AS top_reason,
            CASE WHEN early IS NULL OR len(early) = 0 THEN {q(fv.NO_WARNINGS)} ELSE array_to_string(early[1:2], ', ') END AS warnings_text
            FROM {tag}_decision""",
        f"{tag}_final": f"""SELECT *, concat('I ', lower(decision), ' this loan because ', top_reason, '. Final credit limit: ₹',
            format('{{:,}}', CAST(round(CAST(credit_limit AS DECIMAL(20,2)), 0) AS BIGINT)), ' at ', {PREMIUM}, ' risk premium.') AS reason_sentence
            FROM {tag}_told""",
    }


PCT = "abs(gst_revenue - bank_credits) * 100.0"
LABEL_CASE = case_words("label", list(fv.FIELD_KEYWORDS.items()))
FEATURES = ", ".join(fv.MODEL_FEATURES)

VIEWS: dict[str, str] = {
    # --- input views ---
    "fx_gst_returns": """SELECT o_custkey AS company_id, o_orderkey AS return_id, CASE WHEN o_orderkey % 2 = 0 THEN 'GSTR3B' ELSE 'GSTR2A' END AS return_type,
        CAST(o_totalprice AS DECIMAL(18,2)) AS taxable_value,
        CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.18 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS total_tax FROM orders""",
    "fx_bank_txns": """SELECT o_custkey AS company_id, CASE l_returnflag WHEN 'A' THEN 'NEFT Credit' WHEN 'N' THEN 'CREDIT' ELSE 'Debit' END AS transaction_type,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_defaulters_lower": """SELECT concat('M/S ', upper(c_name), ' AND SONS') AS party, concat('BANK', CAST(c_nationkey AS VARCHAR)) AS bknm,
        CAST(c_acctbal AS DECIMAL(18,2)) AS osamt, CASE WHEN c_custkey % 2 = 0 THEN 'SUIT' ELSE NULL END AS suit FROM customer WHERE c_custkey % 37 = 0""",
    "fx_defaulters_upper": """SELECT c_name AS prty, concat('BANK', CAST(c_nationkey AS VARCHAR)) AS bknm, CAST(c_acctbal AS DECIMAL(18,2)) AS osamt_lac,
        'SUIT' AS suit FROM customer WHERE c_custkey % 41 = 0""",
    "fx_page_text": """SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey,
        CASE o_orderkey % 6
        WHEN 0 THEN concat('Statement. Total Income for the year: ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ' EBITDA 1,234.50')
        WHEN 1 THEN concat('Net Worth ', CAST(o_orderkey % 9000 AS VARCHAR), ',000 Total Borrowings: ', CAST(o_orderkey % 777 AS VARCHAR), ' PAT: 45,000 Total Assets 9,99,000')
        WHEN 2 THEN concat('Current Ratio: 1.', CAST(o_orderkey % 10 AS VARCHAR), CASE WHEN o_orderkey % 12 = 2 THEN '. ' ELSE ' ' END, 'D/E ratio 2.', CAST(o_orderkey % 7 AS VARCHAR))
        WHEN 3 THEN concat('CIBIL report DPD ', CAST(o_orderkey % 61 AS VARCHAR), ' and dpd: 12 days past due')
        WHEN 4 THEN concat('Promoter and group hold ', CAST(o_orderkey % 75 AS VARCHAR), '.5 % Gross NPA ', CAST(o_orderkey % 8 AS VARCHAR), '.25 PAR 90 2.5')
        ELSE 'Suit Filed. Loan written off. DSCR 1.8 Interest Coverage 2.4' END AS text FROM orders""",
    "fx_cells": """SELECT l_orderkey AS doc_id, 0 AS sheet_no,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
        CASE l_partkey % 8 WHEN 0 THEN 'Total Revenue' WHEN 1 THEN 'Net Profit (PAT)' WHEN 2 THEN 'Debt to Equity' WHEN 3 THEN 'Unsecured Loans'
            WHEN 4 THEN 'Current Ratio' WHEN 5 THEN 'Gross NPA %' WHEN 6 THEN 'Promoter Holding' ELSE 'Remarks' END AS label,
        CASE l_linenumber % 4 WHEN 0 THEN concat('₹ ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR))
            WHEN 1 THEN concat('(', CAST(CAST(l_quantity AS INT) AS VARCHAR), ',000)')
            WHEN 2 THEN concat(CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR), '%') ELSE 'n/a' END AS value FROM lineitem""",
    "fx_search_hits": """SELECT page_id // 30 AS company_id, CASE WHEN n < 6 THEN 'research' ELSE 'legal' END AS kind, CASE WHEN n < 6 THEN n ELSE n - 6 END AS query_no,
        page_id AS hit_rank, url, html AS content FROM (SELECT *, page_id % 30 % 9 AS n FROM pages)""",
    "fx_research": """SELECT c_custkey AS company_id, CASE c_custkey % 6
        WHEN 0 THEN '```json {"overall_external_risk_rating":"Low","early_warning_signals_if_any":[]} ```'
        WHEN 1 THEN '```json {"overall_external_risk_rating":" HIGH ","early_warning_signals_if_any":["a","b","c"]} ```'
        WHEN 2 THEN '{"overall_risk":"medium"}'
        WHEN 3 THEN '{"overall_external_risk_rating":"High — manual verification required","overall_risk":"high"}'
        WHEN 4 THEN 'Sure! Here it is: {"overall_risk":"low"} Thanks.' ELSE 'not json' END AS reply FROM customer""",
    "fx_applications": """SELECT c_custkey AS company_id, c_name AS company_name,
        CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE concat('U', lpad(CAST(c_custkey AS VARCHAR), 20, '0')) END AS cin,
        CASE WHEN c_custkey % 47 = 0 THEN '' ELSE concat('AAB', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) END AS pan,
        CAST(1990 + c_custkey % 35 AS INT) AS incorporation_year, CAST(7 + (c_custkey % 31) * 0.5 AS DECIMAL(10,2)) AS interest_rate,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'Manufacturing' WHEN 'FURNITURE' THEN 'Textile' ELSE 'Other' END AS sector,
        concat('Promoter ', CAST(c_custkey % 50 AS VARCHAR), ', ', ' Customer#', lpad(CAST(c_custkey % 90 AS VARCHAR), 9, '0')) AS promoter_names,
        CAST(1000000 + (c_custkey * 7919) % 9000000 AS BIGINT) AS loan_amount, CAST((c_custkey * 104729) % 12000000 AS BIGINT) AS collateral_value,
        CASE c_custkey % 3 WHEN 0 THEN 'Immovable' WHEN 1 THEN 'Movable' ELSE 'None' END AS collateral_type,
        CAST(5000000 + (c_custkey * 31) % 70000000 AS BIGINT) AS turnover,
        CAST((c_custkey % 31) * 0.1 AS DECIMAL(10,2)) AS debt_service_coverage, CAST((c_custkey % 23) * 0.1 AS DECIMAL(10,2)) AS current_ratio,
        CAST((c_custkey % 41) * 0.1 AS DECIMAL(10,2)) AS debt_to_equity, CAST((c_custkey % 37) * 0.01 AS DECIMAL(10,2)) AS revenue_growth,
        CAST(5 + (c_custkey * 13) % 80 AS DECIMAL(10,2)) AS default_probability FROM customer""",
    "fx_loans": """SELECT o_orderkey AS loan_id, CAST(o_totalprice AS DOUBLE) AS loan_amount, CAST(7 + (o_orderkey * 37 % 171) * 0.1 AS DOUBLE) AS interest_rate,
        CAST((o_orderkey * 53 % 451) * 0.1 AS DOUBLE) AS debt_to_income, CAST(o_orderkey * 7919 % 150000 AS DOUBLE) AS revolving_balance,
        CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST((o_orderkey * 71 % 1001) * 0.1 AS DOUBLE) END AS revolving_utilities,
        CAST(o_orderkey * 104729 % 500000 AS DOUBLE) AS total_current_balance, CAST(5000 + o_orderkey * 1299 % 295000 AS DOUBLE) AS total_revolving_credit_limit,
        CAST(CASE WHEN o_orderkey * 11 % 6 < 3 THEN 0 ELSE o_orderkey * 11 % 6 - 2 END AS DOUBLE) AS delinquency_two_years,
        CAST(o_orderkey * 13 % 5 AS DOUBLE) AS inquiries_six_months, CAST(1 + o_orderkey * 17 % 24 AS DOUBLE) AS open_accounts,
        CAST(CASE WHEN o_orderkey * 19 % 5 = 4 THEN 1 ELSE 0 END AS DOUBLE) AS public_record, CAST(2 + o_orderkey * 23 % 38 AS DOUBLE) AS total_accounts FROM orders""",
    "fx_wide_cells": """SELECT s_suppkey AS doc_id, 0 AS sheet_no, 0 AS row_no, 0 AS col_no, 'Statement of Accounts' AS value, TRUE AS is_text FROM supplier
        UNION ALL SELECT s_suppkey, 0, 1, v.c, v.h, TRUE FROM supplier CROSS JOIN (VALUES (0, 'Particulars'), (1, ' Net Sales '), (2, 'EBITDA'), (3, 'Total Borrowings')) AS v(c, h)
        UNION ALL SELECT x.l_suppkey, 0, x.rn + 1, v.c, CASE v.c WHEN 0 THEN concat('Q', CAST(x.rn AS VARCHAR)) WHEN 1 THEN CASE WHEN x.rn = 1 THEN '0' ELSE CAST(x.q AS VARCHAR) END
            WHEN 2 THEN concat('₹ ', CAST(x.p AS VARCHAR)) ELSE CASE WHEN x.rn % 2 = 1 THEN '-' ELSE CAST(x.p AS VARCHAR) END END, v.c <> 1
        FROM (SELECT l_suppkey, CAST(l_quantity AS INT) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p,
            CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS rn FROM lineitem) x
        CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(c)""",
    "fx_note_replies": """SELECT c_custkey AS company_id, CASE c_custkey % 5
        WHEN 0 THEN '```json {"score_adjustment": -15} ```' WHEN 1 THEN '{"score_adjustment": 20}' WHEN 2 THEN '{"positive_signals": []}'
        WHEN 3 THEN 'no json here' ELSE '{"score_adjustment": 5, "deal_breakers": ["x"]}' END AS reply FROM customer""",
    "fx_notes": "SELECT conv_id AS company_id, turn AS note_no, text AS note FROM conversations WHERE role = 'user'",
    "fx_conversation_pages": "SELECT conv_id AS doc_id, turn + 1 AS page_no, text FROM conversations",
    "fx_factor_rows": " UNION ALL ".join(
        f"SELECT o_orderkey AS loan_id, {q(f)} AS feature, {i} AS ord, CAST(((o_orderkey * {37 * i + 11}) % 2001 - 1000) * CAST(0.0001 AS DECIMAL(10,4)) AS DOUBLE) AS impact FROM orders"
        for i, f in enumerate(fv.MODEL_FEATURES)),
    # --- building blocks ---
    "fx_defaulters": """SELECT party AS name, bknm AS bank, CAST(osamt AS VARCHAR) AS outstanding_amount, suit AS suit_filed FROM fx_defaulters_lower
        UNION ALL SELECT prty, bknm, CAST(osamt_lac AS VARCHAR), suit FROM fx_defaulters_upper""",
    "promoters": "SELECT company_id, list_filter(list_transform(string_split(promoter_names, ','), lambda x: trim(x)), lambda x: x <> '') AS names FROM fx_applications",
    "hits": """SELECT t.company_id, t.term AS matched_term, d.* FROM
        (SELECT company_id, lower(company_name) AS term FROM fx_applications UNION ALL SELECT company_id, lower(unnest(names)) FROM promoters) t
        JOIN fx_defaulters d ON contains(lower(d.name), t.term)""",
    "gst_totals": "SELECT company_id, sum(taxable_value) AS gst_revenue FROM fx_gst_returns GROUP BY company_id",
    "bank_totals": "SELECT company_id, coalesce(sum(amount) FILTER (WHERE contains(lower(transaction_type), 'credit')), 0) AS bank_credits FROM fx_bank_txns GROUP BY company_id",
    "aligned": """SELECT company_id, coalesce(gst_revenue, 0) AS gst_revenue, coalesce(bank_credits, 0) AS bank_credits, bank_credits IS NULL AS no_bank_data
        FROM gst_totals FULL JOIN bank_totals USING (company_id)""",
    "verified": f"""SELECT company_id, gst_revenue, bank_credits, no_bank_data, round(pct, 2) AS discrepancy_pct,
        CASE WHEN pct > 20 THEN concat('Revenue mismatch of ', CAST(CAST(round(pct, 1) AS DECIMAL(28,1)) AS VARCHAR), '% between GST and bank statement') END AS flag_one,
        CASE WHEN pct > 40 THEN {q(fv.FLAG_CIRCULAR)} END AS flag_two,
        CASE WHEN pct > 40 THEN 'high' WHEN pct > 20 THEN 'medium' ELSE 'low' END AS risk_level
        FROM (SELECT *, CASE WHEN bank_credits = 0 THEN 0 ELSE CAST({PCT} AS DOUBLE) / CAST(bank_credits AS DOUBLE) END AS pct FROM aligned)""",
    "itc": """SELECT company_id, coalesce(sum(total_tax) FILTER (WHERE return_type = 'GSTR3B'), 0) AS claimed,
        coalesce(sum(total_tax) FILTER (WHERE return_type = 'GSTR2A'), 0) AS available FROM fx_gst_returns GROUP BY company_id""",
    "cleaned": """SELECT company_id, reply, CASE WHEN json_valid(t) THEN t END AS j FROM (
        SELECT company_id, reply, trim(regexp_replace(reply, '```json|```', '', 'g')) AS t FROM fx_research)""",
    "sound": f"""SELECT company_id, CASE WHEN length(coalesce(reply, '')) < 50 THEN {q(fv.RESEARCH_TOO_SHORT)} ELSE reply END AS reply,
        CASE WHEN length(coalesce(reply, '')) < 50 THEN 'secondary_research' ELSE '' END AS quota_warnings FROM fx_research""",
    "sound_rated": """SELECT company_id, quota_warnings, CASE WHEN j IS NULL THEN 'high' ELSE trim(lower(coalesce(json_extract_string(j, '$.overall_external_risk_rating'),
        json_extract_string(j, '$.overall_risk'), 'medium'))) END AS risk_rating, CAST(json_extract(j, '$.early_warning_signals_if_any') AS VARCHAR[]) AS early
        FROM (SELECT company_id, quota_warnings, CASE WHEN json_valid(t) THEN t END AS j FROM (
            SELECT company_id, quota_warnings, trim(regexp_replace(reply, '```json|```', '', 'g')) AS t FROM sound))""",
    "rated": """SELECT company_id, CASE WHEN j IS NULL THEN 'high' ELSE trim(lower(coalesce(json_extract_string(j, '$.overall_external_risk_rating'),
        json_extract_string(j, '$.overall_risk'), 'medium'))) END AS risk_rating, CAST(json_extract(j, '$.early_warning_signals_if_any') AS VARCHAR[]) AS early FROM cleaned""",
    "listed": "SELECT company_id, count(h.matched_term) AS n_matches FROM fx_applications LEFT JOIN hits h USING (company_id) GROUP BY company_id",
    "financials": """SELECT company_id, company_name, loan_amount, CAST(loan_amount AS DOUBLE) AS loan_amount_requested, interest_rate, lower(collateral_type) AS collateral_type,
        round(CAST(collateral_value AS DOUBLE) / greatest(loan_amount, 1), 6) AS collateral_coverage, turnover * CAST(0.3 AS DECIMAL(2,1)) AS net_worth,
        debt_service_coverage, current_ratio, debt_to_equity, revenue_growth, default_probability FROM fx_applications""",
    "page_facts": fact_union("fx_page_text", "doc_id, page_no", "text"),
    "whole_text": "SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM fx_page_text GROUP BY doc_id",
    "doc_facts": fact_union("whole_text", "doc_id", "text"),
    "last_page_facts": "SELECT doc_id, field, arg_max(value, page_no) AS value FROM page_facts GROUP BY doc_id, field",
    "label_facts": f"""SELECT doc_id, field, arg_max(number, row_no) AS value FROM (
        SELECT doc_id, row_no, {case_words('lower(trim(label))', list(fv.FIELD_KEYWORDS.items()))} AS field, {clean_number('value')} AS number FROM fx_cells)
        WHERE number IS NOT NULL AND field IS NOT NULL GROUP BY doc_id, field""",
    "overrides": """SELECT company_id, field, arg_max(value, doc_order) AS value FROM (
        SELECT doc_id AS company_id, 0 AS doc_order, field, CASE field WHEN 'net_worth' THEN value * 100000 ELSE value END AS value FROM doc_facts
        WHERE field IN ('debt_service_coverage', 'current_ratio', 'debt_to_equity', 'net_worth')
        UNION ALL SELECT o_custkey, o_orderkey + 1, field, value FROM label_facts JOIN orders ON o_orderkey = doc_id
        WHERE field IN ('debt_service_coverage', 'current_ratio', 'debt_to_equity', 'revenue_growth', 'net_worth', 'revenue')) WHERE value > 0 GROUP BY company_id, field""",
    "override_row": "SELECT company_id, " + ", ".join(
        f"max(value) FILTER (WHERE field = '{f}') AS new_{f}" for f in ("debt_service_coverage", "current_ratio", "debt_to_equity", "revenue_growth", "net_worth", "revenue")
    ) + " FROM overrides GROUP BY company_id",
    "cases": """SELECT f.*, gst_revenue, bank_credits, coalesce(discrepancy_pct, 0) AS discrepancy_pct, flag_one, flag_two, coalesce(v.risk_level, 'low') AS gst_risk, r.risk_rating, r.early, coalesce(r.quota_warnings, '') AS quota_warnings,
        l.n_matches, l.n_matches > 0 AS blacklisted
        FROM financials f LEFT JOIN verified v USING (company_id) LEFT JOIN sound_rated r USING (company_id) LEFT JOIN listed l USING (company_id)""",
    "full_cases": """SELECT c.* REPLACE (
        CASE WHEN new_debt_service_coverage IS NULL THEN c.debt_service_coverage ELSE CAST(new_debt_service_coverage AS DECIMAL(20,6)) END AS debt_service_coverage,
        CASE WHEN new_current_ratio IS NULL THEN c.current_ratio ELSE CAST(new_current_ratio AS DECIMAL(20,6)) END AS current_ratio,
        CASE WHEN new_debt_to_equity IS NULL THEN c.debt_to_equity ELSE CAST(new_debt_to_equity AS DECIMAL(20,6)) END AS debt_to_equity,
        CASE WHEN new_revenue_growth IS NULL THEN c.revenue_growth ELSE CAST(new_revenue_growth AS DECIMAL(20,6)) END AS revenue_growth,
        CASE WHEN new_net_worth IS NULL THEN c.net_worth ELSE CAST(new_net_worth AS DECIMAL(24,2)) END AS net_worth)
        FROM cases c LEFT JOIN override_row USING (company_id)""",
    **chain("c", "cases"),
    **chain("w", "full_cases"),
    "ranked_hits": "SELECT *, row_number() OVER (PARTITION BY company_id, kind, query_no ORDER BY hit_rank) AS rn FROM fx_search_hits",
    "numbered_hits": "SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY query_no, rn) AS i FROM ranked_hits WHERE rn <= 2 AND kind = 'research'",
    "context": """SELECT company_id, substring(string_agg(concat('Source ', i, ': ', url, chr(10), substring(content, 1, 500)), concat(chr(10), chr(10)) ORDER BY i), 1, 6000) AS context,
        list(url ORDER BY i) AS sources FROM numbered_hits GROUP BY company_id""",
    "headers": """SELECT doc_id, coalesce(min(row_no) FILTER (WHERE n_text >= 2), 0) AS h FROM (
        SELECT doc_id, row_no, count(*) FILTER (WHERE is_text) AS n_text FROM fx_wide_cells GROUP BY doc_id, row_no) GROUP BY doc_id""",
    "promoted": """SELECT d.doc_id, d.sheet_no, d.row_no, d.col_no, n.header, d.value, d.is_text FROM fx_wide_cells d JOIN headers USING (doc_id)
        LEFT JOIN (SELECT c.doc_id, c.col_no, lower(trim(c.value)) AS header FROM fx_wide_cells c JOIN headers k ON c.doc_id = k.doc_id AND c.row_no = k.h) n
        ON n.doc_id = d.doc_id AND n.col_no = d.col_no WHERE d.row_no > h""",
    "labelled": """SELECT *, CASE WHEN points >= 3 THEN 1 ELSE 0 END AS label FROM (SELECT *, CASE WHEN debt_to_income > 30 THEN 2 ELSE 0 END
        + CASE WHEN delinquency_two_years > 1 THEN 3 ELSE 0 END + CASE WHEN interest_rate > 18 THEN 1 ELSE 0 END + CASE WHEN public_record > 0 THEN 2 ELSE 0 END
        + CASE WHEN inquiries_six_months > 3 THEN 1 ELSE 0 END + CASE WHEN revolving_utilities > 80 THEN 1 ELSE 0 END AS points FROM fx_loans)""",
    "factor_ranks": """SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY impact DESC, ord) AS down, row_number() OVER (PARTITION BY loan_id ORDER BY impact, ord) AS up FROM fx_factor_rows""",
    "factors": """SELECT loan_id, 'risk' AS kind, down AS rank, feature, impact FROM factor_ranks WHERE down <= 3
        UNION ALL SELECT loan_id, 'positive', up, feature, impact FROM factor_ranks WHERE up <= 3""",
    "report_sides": """SELECT c.class, count(*) FILTER (WHERE quality = c.class) AS support, count(*) FILTER (WHERE toxic = c.class) AS predicted,
        count(*) FILTER (WHERE quality = c.class AND toxic = c.class) AS hits FROM labels CROSS JOIN (SELECT quality AS class FROM labels UNION SELECT toxic FROM labels) c GROUP BY c.class""",
    "report_classes": """SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM (
        SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits::DOUBLE / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS r FROM report_sides)""",
    "scan": """SELECT doc_id, count(*) AS n_pages, coalesce(sum(length(text)) FILTER (WHERE page_no <= 3), 0)::BIGINT AS head_chars FROM fx_conversation_pages GROUP BY doc_id""",
    "typed_facts": """SELECT *, CASE doc_id % 6 WHEN 0 THEN 'ALM' WHEN 1 THEN 'Shareholding_Pattern' WHEN 2 THEN 'Borrowing_Profile' WHEN 3 THEN 'Annual_Report'
        WHEN 4 THEN 'Portfolio_Data' ELSE 'Other' END AS doc_type FROM label_facts""",
    "known_fields": "SELECT * FROM (VALUES " + ", ".join(
        f"({q(t)}, {i}, {q(f)})" for t, fields in fv.DOC_FIELDS.items() for i, f in enumerate(fields)) + ") AS k(doc_type, ord, field)",
    "draws": "SELECT o_orderkey AS loan_id, " + ", ".join(
        f"CAST(concat('0x', substring(md5(concat('42:{f}:', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS {f}" for f in fv.MODEL_FEATURES) + " FROM orders",
    "synthetic": """SELECT loan_id, floor(loan_amount * 4950000) + 50000 AS loan_amount, interest_rate * 17.0::DOUBLE + 7 AS interest_rate, debt_to_income * 45.0::DOUBLE AS debt_to_income,
        floor(revolving_balance * 150000) AS revolving_balance, revolving_utilities * 100.0::DOUBLE AS revolving_utilities, floor(total_current_balance * 500000) AS total_current_balance,
        floor(total_revolving_credit_limit * 295000) + 5000 AS total_revolving_credit_limit,
        CAST([0,0,0,1,2,3][CAST(floor(delinquency_two_years * 6) AS INT) + 1] AS DOUBLE) AS delinquency_two_years,
        CAST([0,0,1,1,2,3][CAST(floor(inquiries_six_months * 6) AS INT) + 1] AS DOUBLE) AS inquiries_six_months, floor(open_accounts * 24) + 1 AS open_accounts,
        CAST([0,0,0,0,1][CAST(floor(public_record * 5) AS INT) + 1] AS DOUBLE) AS public_record, floor(total_accounts * 38) + 2 AS total_accounts FROM draws""",
    "page_lines": """SELECT p.doc_id, p.page_no, string_agg(concat(c.label, ' | ', c.value), chr(10) ORDER BY c.row_no) AS lines
        FROM fx_cells c JOIN fx_page_text p ON p.o_orderkey = c.doc_id GROUP BY p.doc_id, p.page_no""",
    "scored_cases": "SELECT company_id, 100 - default_probability AS ml_score, * EXCLUDE (company_id) FROM fx_applications WHERE company_id % 3 <> 0",
}

RESEARCH_ITEMS = f"""SELECT company_id, 'Research Findings' AS label, trim(regexp_replace(reply, '```json|```', '', 'g')) AS content FROM cleaned WHERE j IS NULL
    UNION ALL SELECT company_id, {title('k')}, CASE WHEN json_type(j, concat('$.', k)) = 'ARRAY' THEN array_to_string(CAST(json_extract(j, concat('$.', k)) AS VARCHAR[]), ' | ')
        ELSE json_extract_string(j, concat('$.', k)) END FROM (SELECT company_id, j, unnest(json_keys(j)) AS k FROM cleaned WHERE j IS NOT NULL)"""
VIEWS["research_items"] = RESEARCH_ITEMS
VIEWS["sound_cleaned"] = """SELECT company_id, reply, CASE WHEN json_valid(t) THEN t END AS j FROM (
    SELECT company_id, reply, trim(regexp_replace(reply, '```json|```', '', 'g')) AS t FROM sound)"""
VIEWS["sound_items"] = RESEARCH_ITEMS.replace("FROM cleaned", "FROM sound_cleaned")


def memo_sql() -> str:
    m = fv.MEMO_SECTIONS
    rows = []

    def item(section: int, no: int, label: str, value: str) -> None:
        name = "CREDIT APPRAISAL MEMO (CAM)" if section < 0 else m[section]
        rows.append(f"SELECT company_id, decision, {section + 1} AS sec_no, {no} AS item_no, {q(name)} AS title, {q(label)} AS label, CAST({value} AS VARCHAR) AS value FROM memo_cases")

    item(-1, 0, "meta", "concat('Borrower: ', company_name, '  |  Date: 01 January 2026  |  Prepared by: creditloom')")
    item(-1, 1, "banner", "CASE decision " + " ".join(f"WHEN {q(d)} THEN {q(t)}" for d, t in fv.MEMO_BANNERS.items()) + " END")
    item(0, 0, "Company Name", "company_name")
    item(0, 1, "Loan Requested", inr("loan_amount"))
    item(0, 2, "Assessment Date", "'01 January 2026'")
    item(0, 3, "Sector Outlook", "'Positive'")
    item(0, 4, "Collateral Type", title("collateral_type"))
    item(0, 5, "Net Worth", inr("net_worth"))
    item(1, 0, "", "explanation")
    item(2, 0, "Decision", "decision")
    item(2, 1, "Credit Limit", inr("credit_limit"))
    item(2, 2, "Risk Premium", PREMIUM)
    item(2, 3, "Credit Score", f"concat({text_of('score')}, '/100')")
    item(2, 4, "Ml Model Score", f"concat({text_of('ml_score')}, '/100')")
    for i, (c, text) in enumerate(fv.FIVE_CS_TEXTS.items()):
        item(3, i, c.title(), f"concat({q(c.title() + ' (')}, {c}, '/100 — ', CASE WHEN {c} >= 70 THEN 'Strong' WHEN {c} >= 50 THEN 'Adequate' ELSE 'Weak' END, {q('): ' + text)})")
    item(5, 0, "Gst Revenue", inr("coalesce(gst_revenue, 0)"))
    item(5, 1, "Bank Credits", inr("coalesce(bank_credits, 0)"))
    item(5, 2, "Discrepancy", f"concat({text_of('discrepancy_pct')}, '%')")
    item(5, 3, "Itc Compliance", "concat('GSTR-2B Analysis — ', CASE gst_risk WHEN 'high' THEN 'High Risk' ELSE 'Compliant' END)")
    item(5, 4, "Risk Level", "upper(gst_risk)")
    item(5, 5, "Fraud Flags", f"CASE WHEN flag_one IS NULL THEN {q(fv.NO_WARNINGS)} ELSE concat_ws(', ', flag_one, flag_two) END")
    item(6, 100, "References & Data Sources", "array_to_string(sources[1:5], ', ')")
    item(8, 0, "", q(fv.MEMO_DISCLAIMER))
    financial = f"""SELECT company_id, decision, 5, item_no, {q(m[4])}, label, shown FROM memo_financials JOIN memo_cases USING (company_id)"""
    research = f"SELECT company_id, decision, 7, 0, {q(m[6])}, label, content FROM sound_items JOIN memo_cases USING (company_id)"
    notes = f"""SELECT company_id, decision, 8, note_no, {q(m[7])}, '', note FROM fx_notes JOIN memo_cases USING (company_id)
        UNION ALL SELECT company_id, decision, 8, 0, {q(m[7])}, '', {q(fv.MEMO_NO_NOTES)} FROM memo_cases WHERE company_id NOT IN (SELECT company_id FROM fx_notes)"""
    union = " UNION ALL ".join([*rows, financial, research, notes])
    return f"""SELECT company_id, decision, CAST(sec_no AS BIGINT) AS sec_no, CAST(item_no AS BIGINT) AS item_no, title, label, value FROM ({union}) WHERE value IS NOT NULL"""


VIEWS["memo_cases"] = "SELECT f.*, x.sources FROM c_final f LEFT JOIN context x USING (company_id)"
STYLES = [*fv.RUPEE_FIELDS, *fv.PERCENT_FIELDS, *fv.RATIO_FIELDS]
ZERO_FIELDS = {"revolving_balance": "0", "total_current_balance": "0", "total_revolving_credit_limit": "0", "revolving_utilities": "50"}


def styled(f: str, v: str) -> str:
    v = f"CAST({v} AS DECIMAL(28,6))"
    if f in fv.RUPEE_FIELDS:
        return inr(v)
    if f in fv.PERCENT_FIELDS:
        return f"concat(CAST(CAST(round(CASE WHEN {v} < 1 THEN {v} * 100 ELSE {v} END, 1) AS DECIMAL(28,1)) AS VARCHAR), '%')"
    return f"concat(CAST(CAST(round({v}, 2) AS DECIMAL(28,2)) AS VARCHAR), 'x')"


VIEWS["shown_financials"] = " UNION ALL ".join(
    f"SELECT company_id, {i} AS item_no, {q(f.replace('_', ' ').title())} AS label, {styled(f, ZERO_FIELDS.get(f, f))} AS shown FROM financials"
    for i, f in enumerate(STYLES))
PLAIN_VALUES = {"collateral_type": "collateral_type", "sector_outlook": "'positive'", "delinquency_two_years": "'0'", "inquiries_six_months": "'0'",
                "open_accounts": "'5'", "public_record": "'0'", "total_accounts": "'10'"}
VIEWS["memo_financials"] = " UNION ALL ".join(
    f"SELECT company_id, {i} AS item_no, {q(f.replace('_', ' ').title())} AS label, {PLAIN_VALUES.get(f) or styled(f, ZERO_FIELDS.get(f, f))} AS shown FROM financials"
    for i, f in enumerate(["loan_amount_requested", "interest_rate", "collateral_type", "collateral_coverage", "sector_outlook", "debt_service_coverage",
                           "current_ratio", "debt_to_equity", "revenue_growth", "net_worth", "delinquency_two_years", "inquiries_six_months", "open_accounts",
                           "public_record", "total_accounts", "revolving_balance", "revolving_utilities", "total_current_balance",
                           "total_revolving_credit_limit"]))

CHECKS: dict[str, str] = {
    "csv_source": "SELECT company_id, return_id, return_type, CAST(taxable_value AS DOUBLE) AS taxable_value, CAST(total_tax AS DOUBLE) AS total_tax FROM fx_gst_returns",
    "records": "SELECT concat('{\"return_id\":', return_id, ',\"company_id\":', company_id, ',\"return_type\":\"', return_type, '\",\"taxable_value\":\"', CAST(taxable_value AS VARCHAR), '\"}') AS record FROM fx_gst_returns",
    "defaulter_union": "SELECT * FROM fx_defaulters",
    "warehouse_load": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "file_preview": """SELECT doc_id, concat('Columns: label, value', chr(10), 'Sample rows:', chr(10), string_agg(concat(label, ' | ', value), chr(10) ORDER BY row_no)) AS preview
        FROM fx_cells WHERE row_no <= 3 GROUP BY doc_id""",
    "raw_preview": f"""SELECT doc_id, CAST(sheet_no AS BIGINT) AS sheet_no, CAST(row_no AS BIGINT) AS row_no, string_agg(value, {q(SEP)} ORDER BY col_no) AS filled
        FROM fx_wide_cells WHERE row_no < 20 GROUP BY ALL""",
    "sheet_shape": "SELECT doc_id, CAST(sheet_no AS BIGINT) AS sheet_no, max(row_no) AS n_rows, CAST(2 AS BIGINT) AS n_cols FROM fx_cells GROUP BY doc_id, sheet_no",
    "route_by_ext": """SELECT *, CASE WHEN extractor = 'none' THEN concat('Unsupported: ', ext) END AS error FROM (
        SELECT *, CASE ext WHEN 'pdf' THEN 'pdf' WHEN 'xlsx' THEN 'workbook' WHEN 'xls' THEN 'workbook' WHEN 'csv' THEN 'csv' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image'
            WHEN 'png' THEN 'image' ELSE 'none' END AS extractor FROM (
        SELECT doc_id, path, lower(regexp_extract(path, '[^.]*$', 0)) AS ext FROM (SELECT doc_id, concat(source, '_', CAST(doc_id AS VARCHAR), CASE doc_id % 7 WHEN 0 THEN '.PDF'
            WHEN 1 THEN '.xlsx' WHEN 2 THEN '.csv' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.txt' WHEN 5 THEN '.v2.xls' ELSE '' END) AS path FROM documents)))""",
    "to_cells": """SELECT l_orderkey AS doc_id, CAST(0 AS BIGINT) AS sheet_no, CAST(l_linenumber AS BIGINT) AS row_no, CAST(0 AS BIGINT) AS col_no, 'l_returnflag' AS header, l_returnflag AS value, TRUE AS is_text FROM lineitem
        UNION ALL SELECT l_orderkey, 0, l_linenumber, 1, 'l_partkey', CAST(l_partkey AS VARCHAR), FALSE FROM lineitem
        UNION ALL SELECT l_orderkey, 0, l_linenumber, 2, 'price', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), FALSE FROM lineitem""",
    "validate_columns": """SELECT 'gst' AS kind, count(*) AS n_rows, TRUE AS valid FROM fx_gst_returns UNION ALL SELECT 'bank', count(*), TRUE FROM fx_bank_txns
        UNION ALL SELECT 'bank as gst', count(*), FALSE FROM fx_bank_txns""",
    "resolve_column": """SELECT company_id, CAST(bank_credits AS DOUBLE) AS bank_credits, n_unusable_values FROM bank_totals JOIN (
        SELECT company_id, count(*) FILTER (WHERE amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(28,6)) IS NULL) AS n_unusable_values
        FROM fx_bank_txns GROUP BY company_id) USING (company_id)""",
    "credit_filter": "SELECT company_id, transaction_type, CAST(amount AS DOUBLE) AS amount FROM fx_bank_txns WHERE transaction_type IN ('NEFT Credit', 'CREDIT')",
    "onboarding_check": f"""SELECT company_id, concat_ws({q(SEP)}, CASE WHEN coalesce(company_name, '') = '' THEN 'company_name' END, CASE WHEN coalesce(cin, '') = '' THEN 'cin' END,
        CASE WHEN coalesce(pan, '') = '' THEN 'pan' END) AS missing, coalesce(company_name, '') <> '' AND coalesce(cin, '') <> '' AND coalesce(pan, '') <> '' AS complete FROM fx_applications""",
    "train_prep": f"SELECT loan_id, {FEATURES}, CAST(label AS BIGINT) AS label FROM labelled WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in fv.MODEL_FEATURES),
    "schema_filter": f"""SELECT doc_id, doc_type, field, value FROM typed_facts WHERE (doc_type, field) IN (SELECT doc_type, field FROM known_fields)
        OR (doc_type = 'Other' AND field IN ({', '.join(q(f) for f in fv.OTHER_TYPE_FIELDS)}))""",
    "split_promoters": f"SELECT company_id, array_to_string(names, {q(SEP)}) AS promoters FROM promoters",
    "base_financials": """SELECT company_id, CAST(loan_amount AS DOUBLE) AS loan_amount_requested, CAST(interest_rate AS DOUBLE) AS interest_rate, collateral_type, collateral_coverage,
        'positive' AS sector_outlook, 1.5::DOUBLE AS debt_service_coverage, 1.2::DOUBLE AS current_ratio, 1.5::DOUBLE AS debt_to_equity, 0.1::DOUBLE AS revenue_growth,
        CAST(net_worth AS DOUBLE) AS net_worth, 0.0::DOUBLE AS delinquency_two_years, 0.0::DOUBLE AS inquiries_six_months, 5.0::DOUBLE AS open_accounts, 0.0::DOUBLE AS public_record,
        10.0::DOUBLE AS total_accounts, 0.0::DOUBLE AS revolving_balance, 50.0::DOUBLE AS revolving_utilities, 0.0::DOUBLE AS total_current_balance,
        0.0::DOUBLE AS total_revolving_credit_limit FROM financials""",
    "model_features": "SELECT loan_id, " + ", ".join(f"coalesce({f}, {fv.FEATURE_DEFAULTS[f]}::DOUBLE) AS {f}" for f in fv.MODEL_FEATURES) + " FROM fx_loans",
    "apply_overrides": f"""SELECT doc_id, auto_type, doc_type, CASE WHEN doc_type = auto_type THEN 'AUTO' ELSE 'EDITED' END AS status FROM (
        SELECT doc_id, auto_type, CASE doc_id % 10 WHEN 0 THEN 'ALM' WHEN 1 THEN 'Portfolio_Data' ELSE auto_type END AS doc_type FROM (
        SELECT doc_id, {case_words('lower(text)', fv.CONTENT_RULES, q(fv.DEFAULT_DOC_TYPE))} AS auto_type FROM whole_text))""",
    "blacklist_matches": "SELECT company_id, matched_term, name, bank, outstanding_amount, suit_filed FROM hits",
    "borrower_history": f"""SELECT c_custkey AS company_id, c_name AS company_name, o_orderkey, o_orderkey IS NOT NULL AS found,
        CASE WHEN o_orderkey IS NULL THEN {q(fv.NO_HISTORY)} END AS message FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
    "gst_bank_align": "SELECT company_id, CAST(gst_revenue AS DOUBLE) AS gst_revenue, CAST(bank_credits AS DOUBLE) AS bank_credits, no_bank_data FROM aligned",
    "assemble_case": """SELECT company_id, loan_amount_requested, collateral_coverage, CAST(net_worth AS DOUBLE) AS net_worth, CAST(gst_revenue AS DOUBLE) AS gst_revenue,
        CAST(bank_credits AS DOUBLE) AS bank_credits, discrepancy_pct, gst_risk, risk_rating, blacklisted, n_matches, CAST(default_probability AS DOUBLE) AS default_probability FROM cases""",
    "schema_lookup": f"""SELECT t.doc_type, CAST(k.ord AS BIGINT) AS ord, k.field FROM (SELECT DISTINCT doc_type FROM (SELECT coalesce({case_words('lower(source)', fv.NAME_RULES)},
        {case_words('lower(text)', fv.CONTENT_RULES, q(fv.DEFAULT_DOC_TYPE))}) AS doc_type FROM documents UNION ALL SELECT lang FROM documents)) t
        JOIN (SELECT * FROM known_fields UNION ALL SELECT DISTINCT lang, v.o, v.f FROM documents, (VALUES (0, 'revenue'), (1, 'total_assets')) AS v(o, f)) k ON k.doc_type = t.doc_type""",
    "reply_cache": """SELECT 'hit' AS kind, conv_id * 1000 + turn AS prompt_id, md5(text) AS key, concat('reply ', md5(text)) AS text FROM conversations
        WHERE md5(text) IN (SELECT md5(text) FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)
        UNION ALL SELECT 'todo', NULL, md5(text), min(text) FROM conversations
        WHERE md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE role = 'user' AND conv_id % 2 = 0) GROUP BY md5(text)""",
    "gst_revenue": """SELECT company_id, CAST(gst_revenue AS DOUBLE) AS gst_revenue, n_unusable_values FROM gst_totals JOIN (
        SELECT company_id, count(*) FILTER (WHERE taxable_value IS NOT NULL AND TRY_CAST(taxable_value AS DECIMAL(28,6)) IS NULL) AS n_unusable_values
        FROM fx_gst_returns GROUP BY company_id) USING (company_id)""",
    "bank_credits": """SELECT company_id, CAST(bank_credits AS DOUBLE) AS bank_credits, n_unusable_values FROM bank_totals JOIN (
        SELECT company_id, count(*) FILTER (WHERE amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(28,6)) IS NULL) AS n_unusable_values
        FROM fx_bank_txns GROUP BY company_id) USING (company_id)""",
    "cross_verify": f"""SELECT company_id, CAST(gst_revenue AS DOUBLE) AS gst_revenue, CAST(bank_credits AS DOUBLE) AS bank_credits, discrepancy_pct,
        concat_ws({q(SEP)}, flag_one, flag_two) AS flags, risk_level, no_bank_data FROM verified""",
    "itc_reconcile": f"""SELECT company_id, CASE WHEN available > 0 THEN CAST(round(claimed, 2) AS DOUBLE) ELSE 0 END AS itc_claimed,
        CASE WHEN available > 0 THEN CAST(round(available, 2) AS DOUBLE) ELSE 0 END AS itc_available,
        CASE WHEN available > 0 THEN CAST(round(abs(claimed - available), 2) AS DOUBLE) ELSE 0 END AS itc_variance,
        CASE WHEN available > 0 THEN round(pct, 2) ELSE 0 END AS itc_variance_pct, CASE WHEN available > 0 THEN CAST(round(claimed - available, 2) AS DOUBLE) ELSE 0 END AS signed_variance,
        concat_ws({q(SEP)}, CASE WHEN pct > 20 THEN concat({q(fv.FLAG_ITC_MISMATCH[0])}, CAST(CAST(round(pct, 1) AS DECIMAL(28,1)) AS VARCHAR), {q(fv.FLAG_ITC_MISMATCH[1])}) END,
            CASE WHEN pct > 40 THEN {q(fv.FLAG_ITC_SEVERE)} END, CASE WHEN available <= 0 THEN {q(fv.FLAG_NO_2A)} END) AS flags,
        CASE WHEN pct > 40 THEN 'high' WHEN pct > 20 THEN 'medium' ELSE 'low' END AS risk_level
        FROM (SELECT *, CASE WHEN available > 0 THEN CAST(abs(claimed - available) AS DOUBLE) * 100 / CAST(available AS DOUBLE) END AS pct FROM itc)""",
    "gst_describe": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}::DOUBLE), 3) AS mean, round(stddev_samp({c}::DOUBLE), 3) AS std, round(min({c})::DOUBLE, 3) AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 3) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 3) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 3) AS q75,
        round(max({c})::DOUBLE, 3) AS max FROM fx_gst_returns""" for c in ("taxable_value", "total_tax")),
    "blacklist_summary": "SELECT company_id, n_matches > 0 AS blacklisted, n_matches, CASE WHEN n_matches > 0 THEN 'critical' ELSE 'clear' END AS risk FROM listed",
    "detect_doc_type": "SELECT doc_id, CASE greatest(" + ", ".join(f"s{i}" for i in range(5)) + ") " + " ".join(
        f"WHEN s{i} THEN {q(t)}" for i, t in enumerate(fv.TYPE_KEYWORDS)) + " END AS detected_type, CAST(greatest(" + ", ".join(
        f"s{i}" for i in range(5)) + ") AS BIGINT) AS score FROM (SELECT doc_id, " + ", ".join(
        "(" + " + ".join(f"CAST(contains(lower(text), {q(w)}) AS INT)" for w in words) + f") AS s{i}" for i, words in enumerate(fv.TYPE_KEYWORDS.values())) + " FROM documents)",
    "scanned_docs": "SELECT doc_id, n_pages, head_chars, head_chars < n_pages * 80 AS scanned FROM scan",
    "merge_pages": "SELECT doc_id, field, value FROM last_page_facts",
    "kv_extract": "SELECT doc_id, field, value FROM label_facts",
    "column_extract": f"""SELECT doc_id, field, arg_max(first_value, col_no) AS value FROM (
        SELECT doc_id, col_no, header, arg_min(number, row_no) AS first_value FROM (SELECT *, {clean_number('value')} AS number FROM promoted) WHERE number <> 0 GROUP BY doc_id, col_no, header) c
        JOIN (VALUES {', '.join(f'({q(f)}, {q(w)})' for f, ws in fv.FIELD_KEYWORDS.items() for w in ws)}) AS k(field, word) ON contains(c.header, k.word) GROUP BY doc_id, field""",
    "research_context": f"SELECT company_id, context, array_to_string(sources, {q(SEP)}) AS sources FROM context",
    "confidence": """SELECT doc_id, count(DISTINCT field) AS n_fields, CASE WHEN count(DISTINCT field) >= 5 THEN 'high' WHEN count(DISTINCT field) >= 2 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN count(DISTINCT field) >= 3 THEN 'high' ELSE 'medium' END AS image_confidence FROM doc_facts GROUP BY doc_id""",
    "sheet_confidence": """SELECT doc_id, count(*) AS n_fields, CASE WHEN count(*) >= 3 THEN 'rule_based' ELSE 'needs_assistance' END AS method FROM label_facts GROUP BY doc_id""",
    "class_report": """SELECT CAST(class AS VARCHAR) AS class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM report_classes
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits)::DOUBLE / sum(support), 4), CAST(sum(support) AS BIGINT) FROM report_classes
        UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), CAST(sum(support) AS BIGINT) FROM report_classes
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4),
            CAST(sum(support) AS BIGINT) FROM report_classes""",
    "balanced_weights": """SELECT loan_id, CAST(label AS BIGINT) AS label, round((SELECT count(*) FROM labelled)::DOUBLE / ((SELECT count(DISTINCT label) FROM labelled) * n), 6) AS weight
        FROM labelled JOIN (SELECT label, count(*) AS n FROM labelled GROUP BY label) USING (label)""",
    "five_cs_weighted": "SELECT company_id, CAST(rule_score AS DOUBLE) AS rule_score FROM c_blend",
    "merge_facts": """SELECT company_id, coalesce(CAST(CAST(new_debt_service_coverage AS DECIMAL(20,6)) AS DOUBLE), 1.5) AS debt_service_coverage,
        coalesce(CAST(CAST(new_current_ratio AS DECIMAL(20,6)) AS DOUBLE), 1.2) AS current_ratio, coalesce(CAST(CAST(new_debt_to_equity AS DECIMAL(20,6)) AS DOUBLE), 1.5) AS debt_to_equity,
        coalesce(CAST(CAST(new_revenue_growth AS DECIMAL(20,6)) AS DOUBLE), 0.1) AS revenue_growth,
        coalesce(CAST(CAST(new_net_worth AS DECIMAL(24,2)) AS DOUBLE), CAST(net_worth AS DOUBLE)) AS net_worth, new_revenue AS turnover
        FROM financials LEFT JOIN override_row USING (company_id)""",
    "layer_merge": "SELECT doc_id, field, value * CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS value FROM last_page_facts",
    "doc_completeness": """SELECT o_custkey AS company_id, count(DISTINCT o_orderpriority) AS n_docs, concat(count(DISTINCT o_orderpriority), '/5 DOCUMENTS UPLOADED') AS status,
        count(DISTINCT o_orderpriority) >= 1 AS can_proceed FROM orders GROUP BY o_custkey""",
    "document_text": """SELECT doc_id, CAST(0 AS BIGINT) AS part_no, trim(string_agg(concat(text, CASE WHEN lines IS NULL THEN '' ELSE concat(chr(10), lines) END), chr(10) ORDER BY page_no)) AS text
        FROM fx_page_text LEFT JOIN page_lines USING (doc_id, page_no) GROUP BY doc_id""",
    "extraction_summary": """SELECT doc_id, CASE WHEN head_chars < n_pages * 80 THEN 'vision_scanned' ELSE 'text_tables' END AS method,
        CASE WHEN head_chars < n_pages * 80 THEN least(n_pages, 8) ELSE n_pages END AS pages_processed, n AS n_fields,
        CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (
        SELECT s.*, (SELECT count(*) FROM turn_facts f WHERE f.doc_id = s.doc_id) AS n FROM scan s)""",
    "header_row": "SELECT doc_id, CAST(sheet_no AS BIGINT) AS sheet_no, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, header, value, is_text FROM promoted",
    "legal_context": """SELECT company_id, substring(string_agg(concat('Source ', i, ': ', url, chr(10), substring(content, 1, 400)), concat(chr(10), chr(10)) ORDER BY i), 1, 5000) AS context,
        array_to_string(list(url ORDER BY i), ' ; ') AS sources FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY query_no, rn) AS i FROM ranked_hits WHERE rn <= 2 AND kind = 'legal') GROUP BY company_id""",
    "whole_context": """SELECT company_id, string_agg(concat('Source ', i, ': ', url, chr(10), content), concat(chr(10), chr(10)) ORDER BY i) AS context,
        array_to_string(list(url ORDER BY i), ' ; ') AS sources FROM numbered_hits GROUP BY company_id""",
    "topk_hits": "SELECT company_id, kind, CAST(query_no AS BIGINT) AS query_no, rn, url FROM ranked_hits WHERE rn <= 2",
    "top_factors": "SELECT * FROM factors",
    "head_lists": f"SELECT company_id, " + ", ".join(f"array_to_string(sources[1:{n}], {q(SEP)}) AS first_{n}" for n in (5, 6, 8)) + " FROM context",
    "key_pages": """SELECT doc_id, page_no, scanned FROM (SELECT doc_id, page_no, count(*) OVER (PARTITION BY doc_id) AS n,
        sum(CASE WHEN page_no <= 3 THEN length(text) ELSE 0 END) OVER (PARTITION BY doc_id) < 80 * count(*) OVER (PARTITION BY doc_id) AS scanned FROM fx_page_text)
        WHERE page_no <= 10 AND CASE WHEN scanned THEN page_no <= 8 ELSE n >= 5 AND (page_no <= 3 OR page_no > n - 2) END""",
    "union_lists": """SELECT party, bknm, CAST(osamt AS DOUBLE) AS osamt, suit, NULL AS prty, NULL::DOUBLE AS osamt_lac FROM fx_defaulters_lower
        UNION ALL SELECT NULL, bknm, NULL, suit, prty, CAST(osamt_lac AS DOUBLE) FROM fx_defaulters_upper""",
    "factor_chart": "SELECT loan_id, feature, max(impact) AS impact, CASE WHEN max(impact) > 0 THEN 'Risk' ELSE 'Positive' END AS type FROM factors GROUP BY loan_id, feature",
    "clean_value": f"SELECT doc_id, row_no, value, {clean_number('value')} AS number FROM fx_cells",
    "regex_facts": "SELECT doc_id, field, value FROM doc_facts",
    "bureau_flags": f"""SELECT doc_id, len(m) > 0 OR contains(t, 'days past due') OR contains(t, 'overdue') AS has_dpd, array_to_string(m[1:5], {q(SEP)}) AS dpd_values,
        len(list_filter(m, lambda x: CAST(x AS BIGINT) > 30)) > 0 AS cibil_risk, concat_ws({q(SEP)}, {', '.join(f"CASE WHEN contains(t, {q(k)}) THEN {q(k)} END" for k in fv.BUREAU_RED_FLAGS)}) AS red_flags
        FROM (SELECT doc_id, lower(text) AS t, list_transform(regexp_extract_all(lower(text), {q(fv.DPD_PATTERN)}, 1), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)) AS m FROM whole_text)""",
    "classify_doc": f"SELECT doc_id, coalesce({case_words('lower(source)', fv.NAME_RULES)}, {case_words('lower(text)', fv.CONTENT_RULES, q(fv.DEFAULT_DOC_TYPE))}) AS doc_type FROM documents",
    "classify_fallback": f"SELECT conv_id, turn, {case_words('lower(text)', fv.PROMPT_RULES, q(fv.DEFAULT_DOC_TYPE))} AS doc_type FROM conversations",
    "parse_reply": """SELECT company_id, j IS NOT NULL AS parsed, json_extract_string(j, '$.overall_external_risk_rating') AS rating, json_extract_string(j, '$.overall_risk') AS risk FROM (
        SELECT company_id, coalesce(j, CASE WHEN json_valid(regexp_extract(reply, '(?s)\\{.*\\}', 0)) THEN regexp_extract(reply, '(?s)\\{.*\\}', 0) END) AS j FROM cleaned)""",
    "format_inr": "SELECT o_orderkey, " + ", ".join(f"{inr(f'CAST(o_totalprice AS DECIMAL(18,2)) * {n}')} AS x{n}" for n in (1, 10, 1000)) + " FROM orders",
    "format_financials": "SELECT company_id, label, shown FROM shown_financials",
    "rating_band": " UNION ALL ".join(
        f"SELECT company_id, {q(c.title())} AS parameter, CAST({c} AS BIGINT) AS score, CASE WHEN {c} >= 70 THEN 'Strong' WHEN {c} >= 50 THEN 'Adequate' ELSE 'Weak' END AS rating FROM c_five"
        for c in fv.FIVE_CS_WEIGHTS),
    "risk_band": "SELECT company_id, CASE WHEN default_probability > 50 THEN 'HIGH RISK' WHEN default_probability > 25 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS band FROM fx_applications",
    "research_rating": "SELECT company_id, risk_rating, CAST(CASE risk_rating WHEN 'low' THEN 90 WHEN 'high' THEN 30 ELSE 60 END AS BIGINT) AS character FROM sound_rated",
    "infer_sector": "SELECT p_partkey, p_name, CASE WHEN regexp_matches(lower(p_name), 'textile|fabric|garment') THEN 'textile' ELSE 'MSME' END AS sector FROM part",
    "query_fanout": f"SELECT company_id, kind, CAST(query_no AS BIGINT) AS query_no, query FROM ({fanout_rows()})",
    "flatten_research": "SELECT company_id, label, content FROM research_items",
    "flatten_research_memo": "SELECT company_id, label, left(content, CASE WHEN label = 'Research Findings' THEN 1000 ELSE 800 END) AS content FROM research_items",
    "metric_display": f"""SELECT doc_id, {title('field')} AS label, CASE WHEN v > 100000 THEN {inr('v')} WHEN v < 10 THEN CAST(CAST(round(v, 2) AS DECIMAL(28,2)) AS VARCHAR)
        ELSE format('{{:,.1f}}', CAST(round(v, 1) AS DOUBLE)) END AS shown FROM (SELECT doc_id, field, CAST(value AS DECIMAL(28,6)) AS v FROM label_facts)""",
    "research_quality": f"""SELECT company_id, CASE WHEN length(a) < 50 THEN {q(fv.RESEARCH_TOO_SHORT)} ELSE a END AS analysis, CASE WHEN length(f) < 30 THEN {q(fv.LEGAL_TOO_SHORT)} ELSE f END AS findings,
        concat_ws({q(SEP)}, CASE WHEN length(a) < 50 THEN 'secondary_research' END, CASE WHEN length(f) < 30 THEN 'mca' END) AS quota_warnings FROM (
        SELECT company_id, CASE WHEN company_id % 4 = 0 THEN {q(fv.RESEARCH_NO_HITS)} ELSE reply END AS a, CASE WHEN company_id % 4 = 0 THEN {q(fv.LEGAL_NO_HITS)} ELSE reply END AS f FROM fx_research)""",
    "five_cs": "SELECT company_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in fv.FIVE_CS_WEIGHTS) + " FROM c_five",
    "blend_score": "SELECT company_id, CAST(bounded AS DOUBLE) AS default_probability, CAST(rule_score AS DOUBLE) AS rule_score, CAST(ml_score AS DOUBLE) AS ml_score, CAST(weighted_score AS DOUBLE) AS weighted_score FROM c_blend",
    "decide": "SELECT company_id, CAST(score AS DOUBLE) AS score, raw_decision AS decision, CAST(raw_limit AS DOUBLE) AS credit_limit, CAST(raw_premium AS DOUBLE) AS risk_premium FROM c_raw_decision",
    "blacklist_override": "SELECT company_id, blacklisted, CAST(score AS DOUBLE) AS score, decision, CAST(credit_limit AS DOUBLE) AS credit_limit, CAST(risk_premium AS DOUBLE) AS risk_premium FROM c_decision",
    "early_warnings": "SELECT company_id, early_warnings, officer_review FROM c_told",
    "explain": "SELECT company_id, explanation, top_reason, reason_sentence, warnings_text FROM c_final",
    "qualitative_adjust": """SELECT company_id, CAST(s AS DOUBLE) AS score, CASE WHEN j IS NULL THEN CAST(s AS DOUBLE) ELSE
        CAST(greatest(0, least(100, s + coalesce(CAST(json_extract_string(j, '$.score_adjustment') AS DECIMAL(10,2)), 0))) AS DOUBLE) END AS adjusted_score, CASE WHEN j IS NULL THEN reply END AS raw_response
        FROM (SELECT company_id, default_probability AS s, reply, CASE WHEN json_valid(t) THEN t END AS j FROM fx_applications JOIN (
            SELECT company_id, reply, trim(regexp_replace(reply, '```json|```', '', 'g')) AS t FROM fx_note_replies) USING (company_id))""",
    "note_bullets": "SELECT company_id, CAST(0 AS BIGINT) AS part_no, string_agg(concat('- ', note), chr(10) ORDER BY note_no) AS notes FROM fx_notes GROUP BY company_id",
    "swot_fallback": f"SELECT company_id, quadrant, CAST(point_no AS BIGINT) AS point_no, point FROM ({swot_rows()})",
    "memo_sections": memo_sql(),
    "synth_loans": "SELECT loan_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in fv.MODEL_FEATURES) + """, CAST(CASE WHEN
        CASE WHEN debt_to_income > 30 THEN 2 ELSE 0 END + CASE WHEN delinquency_two_years > 1 THEN 3 ELSE 0 END + CASE WHEN interest_rate > 18 THEN 1 ELSE 0 END
        + CASE WHEN public_record > 0 THEN 2 ELSE 0 END + CASE WHEN inquiries_six_months > 3 THEN 1 ELSE 0 END + CASE WHEN revolving_utilities > 80 THEN 1 ELSE 0 END >= 3 THEN 1 ELSE 0 END AS BIGINT) AS label FROM synthetic""",
    "default_label": "SELECT loan_id, CAST(points AS BIGINT) AS points, CAST(label AS BIGINT) AS label FROM labelled",
    "stratified_split": """SELECT loan_id, CAST(label AS BIGINT) AS label, r <= CAST(round(n * CAST(0.2 AS DECIMAL(6,4)), 0) AS BIGINT) AS is_test FROM (
        SELECT loan_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(loan_id AS VARCHAR), ':42'))) AS r, count(*) OVER (PARTITION BY label) AS n FROM labelled)""",
    "score_fallback": f"""SELECT company_id, CASE WHEN k THEN CAST(default_probability AS DOUBLE) ELSE 35.0::DOUBLE END AS default_probability,
        CASE WHEN k THEN CAST(100 - default_probability AS DOUBLE) ELSE 65.0::DOUBLE END AS ml_score,
        CASE WHEN NOT k THEN 'MEDIUM RISK' WHEN default_probability > 50 THEN 'HIGH RISK' WHEN default_probability > 25 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS recommendation,
        CASE WHEN NOT k THEN CAST(3 AS BIGINT) END AS n_fixed_risks, CASE WHEN NOT k THEN 'open_accounts' END AS first_fixed_positive
        FROM (SELECT *, company_id % 3 <> 0 AS k FROM fx_applications)""",
    "assess_borrowers": "SELECT company_id, company_name, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in fv.FIVE_CS_WEIGHTS) + """, CAST(rule_score AS DOUBLE) AS rule_score,
        CAST(ml_score AS DOUBLE) AS ml_score, CAST(score AS DOUBLE) AS score, decision, CAST(credit_limit AS DOUBLE) AS credit_limit, CAST(risk_premium AS DOUBLE) AS risk_premium,
        discrepancy_pct, gst_risk, risk_rating, blacklisted, early_warnings, officer_review, reason_sentence, warnings_text, quota_warnings FROM w_final""",
}
CHECKS |= {
    "write_memos": CHECKS["memo_sections"],
    "load_and_validate": "SELECT 'gst' AS kind, count(*) AS n_rows, TRUE AS valid FROM fx_gst_returns UNION ALL SELECT 'bank', count(*), TRUE FROM fx_bank_txns",
    "train_default_model_check": """SELECT CAST(label AS BIGINT) AS label, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS n_test, TRUE AS found
        FROM usable GROUP BY label""",
    "model_store_check": """SELECT CAST(1 AS BIGINT) AS version, CAST(sum(n) AS BIGINT) AS n_test, TRUE AS same
        FROM (SELECT floor(count(*) * 0.2 + 0.5) AS n FROM usable GROUP BY label)""",
    "score_loans_check": "SELECT loan_id, TRUE AS bounded, TRUE AS complement, TRUE AS band FROM fx_loans",
    "attributions_check": "SELECT loan_id, TRUE AS additive FROM fx_loans",
    "assess_with_model_check": "SELECT company_id, TRUE AS bounded, TRUE AS complement, TRUE AS score_bounded FROM fx_applications",
    "applicant_factors_check": "SELECT company_id, TRUE AS n_in_range, TRUE AS unlike, TRUE AS typed FROM fx_applications",
}
VIEWS["usable"] = "SELECT * FROM labelled WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in fv.MODEL_FEATURES)
VIEWS["turn_text"] = "SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM fx_conversation_pages GROUP BY doc_id"
VIEWS["turn_facts"] = fact_union("turn_text", "doc_id", "text")

def _with_views(body: str) -> str:
    """The statement preceded by the views it uses, in dependency order."""
    placed: dict[str, str] = {}

    def add(sql: str) -> None:
        bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
        for name in VIEWS:
            if name not in placed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", bare):
                add(VIEWS[name])
                placed[name] = VIEWS[name]

    add(body)
    head = ", ".join(f"{name} AS ({sql})" for name, sql in placed.items())
    return f"WITH {head} {body}" if head else body


ORACLE: dict[str, str] = {key: _with_views(sql) for key, sql in CHECKS.items()}
