"""Word lists, patterns, thresholds and texts that results must reproduce exactly."""

# --- Spreadsheet field dictionary. The order is semantic: the first field with a hit wins. ---
FIELD_KEYWORDS = {
    "revenue": ["revenue", "turnover", "sales", "income from operations", "net sales", "total income"],
    "net_profit": ["net profit", "pat", "profit after tax", "net income", "profit for the year"],
    "gross_profit": ["gross profit", "gross margin", "ebitda"],
    "total_assets": ["total assets", "assets total", "total asset"],
    "total_liabilities": ["total liabilities", "liabilities total", "total liability"],
    "net_worth": ["net worth", "shareholders equity", "shareholders' equity", "equity", "book value"],
    "debt_to_equity": ["debt to equity", "d/e ratio", "leverage ratio", "d:e"],
    "current_ratio": ["current ratio", "liquidity ratio"],
    "debt_service_coverage": ["dscr", "debt service coverage", "debt service cover"],
    "revenue_growth": ["revenue growth", "sales growth", "yoy growth", "growth %"],
    "ebitda": ["ebitda", "operating profit", "pbit"],
    "cash_flow": ["cash flow", "net cash", "operating cash"],
    "total_debt": ["total debt", "total borrowings", "total loans", "total borrowing"],
    "secured_debt": ["secured loans", "secured debt", "secured borrowings"],
    "unsecured_debt": ["unsecured loans", "unsecured debt", "unsecured borrowings"],
    "npa_pct": ["npa", "non performing", "gross npa", "net npa", "npa %", "npa ratio"],
    "stage_1_pct": ["stage 1", "stage i", "performing assets"],
    "stage_2_pct": ["stage 2", "stage ii", "special mention", "sma"],
    "stage_3_pct": ["stage 3", "stage iii", "sub standard", "doubtful", "loss"],
    "par_30": ["par 30", "par>30", "par > 30", "overdue 30"],
    "par_90": ["par 90", "par>90", "par > 90", "overdue 90"],
    "promoter_holding_pct": ["promoter", "promoter holding", "promoter %", "promoter shareholding"],
    "institutional_holding_pct": ["institutional", "fii", "dii", "mutual fund", "institution"],
    "public_holding_pct": ["public", "public holding", "retail", "others"],
    "total_shares": ["total shares", "paid up shares", "equity shares", "number of shares"],
    "pledged_shares_pct": ["pledged", "pledge %", "pledged shares"],
    "liquidity_gap_30d": ["30 day", "upto 30", "1 month", "0-30", "30 days"],
    "liquidity_gap_90d": ["90 day", "upto 90", "3 month", "0-90", "quarter"],
    "total_portfolio_size": ["total portfolio", "aum", "assets under management", "total loan", "portfolio size"],
    "average_interest_rate": ["average rate", "avg rate", "weighted average", "interest rate", "coupon"],
}

# --- Words counted per document type; ties go to the earlier type. ---
TYPE_KEYWORDS = {
    "ALM": ["asset", "liability", "gap", "maturity", "bucket", "liquidity", "nsfr", "lcr", "outflow", "inflow"],
    "Shareholding_Pattern": ["promoter", "holding", "shares", "shareholder", "equity", "stake", "ownership"],
    "Borrowing_Profile": ["lender", "bank", "loan", "borrowing", "repayment", "emi", "outstanding", "sanction"],
    "Annual_Report": ["profit", "loss", "revenue", "assets", "liabilities", "balance sheet", "p&l", "cashflow", "income"],
    "Portfolio_Data": ["npa", "stage", "par", "portfolio", "collection", "disbursement", "overdue", "delinquency"],
}

# --- Document routing: ordered file-name rules, then ordered content rules. ---
DEFAULT_DOC_TYPE = "Annual_Report"
NAME_RULES = [
    ("ALM", ["alm"]),
    ("Shareholding_Pattern", ["shareholding", "sharehol"]),
    ("Borrowing_Profile", ["borrowing", "borrow"]),
    ("Portfolio_Data", ["portfolio", "npa", "par"]),
    ("Annual_Report", ["annual", "pnl", "balance", "financials"]),
]
CONTENT_RULES = [
    ("Portfolio_Data", ["gstin", "gst", "taxable_value", "igst", "cgst", "sgst", "filing"]),
    ("ALM", ["maturity", "liquidity", "gap", "bucket", "inflow", "outflow", "nsfr", "lcr"]),
    ("Shareholding_Pattern", ["promoter", "holding", "shares", "shareholder", "stake", "pledge"]),
    ("Borrowing_Profile", ["lender", "sanction", "outstanding", "repayment", "emi", "secured", "unsecured"]),
    ("Portfolio_Data", ["npa", "stage 1", "stage 2", "stage 3", "par 30", "par 90", "delinquency", "collection"]),
    ("Annual_Report", ["revenue", "profit", "assets", "liabilities", "cashflow", "ebitda", "balance sheet"]),
    ("Borrowing_Profile", ["date", "description", "amount", "balance", "credit", "debit", "transaction"]),
]
PROMPT_RULES = [
    ("ALM", ["alm"]),
    ("Shareholding_Pattern", ["share", "hold"]),
    ("Borrowing_Profile", ["borrow", "debt"]),
    ("Portfolio_Data", ["portfolio", "npa"]),
]

# --- Fields kept per document type; any other type keeps OTHER_TYPE_FIELDS. ---
DOC_FIELDS = {
    "Annual_Report": ["revenue", "net_profit", "total_assets", "total_liabilities", "net_worth",
                      "debt_service_coverage", "current_ratio", "debt_to_equity", "revenue_growth"],
    "ALM": ["total_assets", "total_liabilities", "liquidity_gap_30d", "liquidity_gap_90d", "nsfr_ratio", "lcr_ratio"],
    "Shareholding_Pattern": ["promoter_holding_pct", "institutional_holding_pct", "public_holding_pct",
                             "total_shares", "pledged_shares_pct"],
    "Borrowing_Profile": ["total_debt", "secured_debt", "unsecured_debt", "average_interest_rate",
                          "debt_maturity_1yr", "debt_maturity_3yr"],
    "Portfolio_Data": ["total_portfolio_size", "npa_pct", "stage_1_pct", "stage_2_pct", "stage_3_pct", "par_30", "par_90"],
}
OTHER_TYPE_FIELDS = ["revenue", "total_assets"]

# --- Patterns looked for in lower-cased document text; the first match counts. ---
TEXT_PATTERNS = {
    "revenue": r"(?:revenue|turnover|net sales|total income)[^\d]{0,20}([\d,]+(?:\.\d+)?)",
    "net_profit": r"(?:net profit|pat\b|profit after tax)[^\d]{0,20}([\d,]+(?:\.\d+)?)",
    "ebitda": r"(?:ebitda|operating profit)[^\d]{0,20}([\d,]+(?:\.\d+)?)",
    "total_assets": r"total assets?[^\d]{0,20}([\d,]+(?:\.\d+)?)",
    "net_worth": r"(?:net worth|shareholders.{0,5}equity)[^\d]{0,20}([\d,]+(?:\.\d+)?)",
    "total_debt": r"(?:total debt|total borrowings?)[^\d]{0,20}([\d,]+(?:\.\d+)?)",
    "current_ratio": r"current ratio[^\d]{0,10}([\d.]+)",
    "debt_to_equity": r"(?:d/e ratio|debt.{0,5}equity)[^\d]{0,10}([\d.]+)",
    "debt_service_coverage": r"(?:dscr|debt service coverage)[^\d]{0,10}([\d.]+)",
    "interest_coverage": r"interest coverage[^\d]{0,10}([\d.]+)",
    "promoter_holding_pct": r"promoter.{0,30}?([\d.]+)\s*%",
    "npa_pct": r"(?:gross npa|npa %|npa ratio)[^\d]{0,10}([\d.]+)",
    "par_90": r"par\s*90[^\d]{0,10}([\d.]+)",
}
DPD_PATTERN = r"dpd[^\d]{0,5}(\d+)"
DPD_MENTIONS = ["days past due", "overdue"]
BUREAU_RED_FLAGS = ["wilful default", "npa account", "written off", "suit filed", "strike off"]

# --- Defaulter list headers: each output column with its two spellings. ---
DEFAULTER_HEADERS = {
    "name": ["party", "PRTY"],
    "bank": ["bknm", "BKNM"],
    "outstanding_amount": ["osamt", "OSAMT (Rs. Lac)"],
    "suit_filed": ["suit", "SUIT"],
}

# --- Tax-return and bank cross-check texts. ---
FLAG_REVENUE_MISMATCH = ("Revenue mismatch of ", "% between GST and bank statement")
FLAG_CIRCULAR = "High risk: Possible circular trading or revenue inflation detected"
FLAG_ITC_MISMATCH = ("ITC mismatch of ", "% — company claiming more credit than suppliers reported")
FLAG_ITC_SEVERE = "HIGH RISK: Severe GSTR-2A vs 3B mismatch — possible fake ITC claims or supplier collusion"
FLAG_NO_2A = "Only GSTR-3B data available — GSTR-2A reconciliation not possible"
FLAG_NO_RETURN_TYPE = ("GST data does not contain return_type column — upload GSTR data "
                       "with both 2A and 3B returns")

# --- Score weights, rating scores and form defaults. ---
FIVE_CS_WEIGHTS = {"character": "0.25", "capacity": "0.30", "capital": "0.20", "collateral": "0.15", "conditions": "0.10"}
RATING_SCORES = {"low": 90, "medium": 60, "high": 30}
OTHER_RATING_SCORE = 60
MODEL_FEATURES = ["loan_amount", "interest_rate", "debt_to_income", "revolving_balance", "revolving_utilities",
                  "total_current_balance", "total_revolving_credit_limit", "delinquency_two_years",
                  "inquiries_six_months", "open_accounts", "public_record", "total_accounts"]
FEATURE_DEFAULTS = {
    "loan_amount": 0.0, "interest_rate": 10.0, "debt_to_income": 20.0, "revolving_balance": 0.0,
    "revolving_utilities": 50.0, "total_current_balance": 0.0, "total_revolving_credit_limit": 0.0,
    "delinquency_two_years": 0.0, "inquiries_six_months": 0.0, "open_accounts": 5.0, "public_record": 0.0,
    "total_accounts": 10.0,
}
# The order in which the memo lists a borrower's financial values.
FINANCIAL_KEYS = ["loan_amount_requested", "interest_rate", "collateral_type", "collateral_coverage", "sector_outlook",
                  "debt_service_coverage", "current_ratio", "debt_to_equity", "revenue_growth", "net_worth",
                  "delinquency_two_years", "inquiries_six_months", "open_accounts", "public_record", "total_accounts",
                  "revolving_balance", "revolving_utilities", "total_current_balance", "total_revolving_credit_limit"]
UNSCORED = {"ml_score": "65.00", "default_probability": "35.00", "recommendation": "MEDIUM RISK"}
UNSCORED_RISKS = {"interest_rate": "0.1500", "debt_to_income": "0.1200", "public_record": "0.0800"}
UNSCORED_POSITIVES = {"open_accounts": "-0.0500", "total_accounts": "-0.0400", "revolving_utilities": "-0.0300"}

# --- Early warnings and explanations. ---
WARN_GST = "Severe GST-Bank discrepancy — possible circular trading or revenue inflation"
WARN_LEVERAGE = "High leverage — debt-to-equity exceeds safe threshold of 2x"
WARN_BLACKLIST = "CRITICAL — Entity found in RBI Wilful Defaulters list"
NO_WARNINGS = "None detected"
REASON_CHARACTER = "high external risk detected — regulatory non-compliance and MCA violations"
NO_HISTORY = "No historical data found. Using real-time analysis only."

# --- Research and legal texts used when a reply is missing or too short. ---
RESEARCH_QUERIES = ["{company} latest news India", "{company} promoter fraud litigation India",
                    "{company} MCA regulatory action", "{company} sector outlook credit",
                    "latest RBI circulars for {sector} 2025",
                    "Government of India PLI scheme updates for {sector} MSMEs"]
LEGAL_QUERIES = ["{company} MCA Ministry Corporate Affairs India", "{company} ROC charges director DIN India",
                 "{company} court case litigation NCLT India"]
SECTOR_WORDS = ["textile", "fabric", "garment"]
RESEARCH_NO_HITS = (
    '{"promoter_reputation_and_background": "Web research unavailable — manual verification recommended.", '
    '"litigation_fraud_or_regulatory_actions": "Unable to retrieve data. Please check MCA portal manually.", '
    '"sector_headwinds_or_tailwinds": "Sector data unavailable. Analyst should review RBI sectoral reports.", '
    '"recent_news_that_impacts_creditworthiness": "No recent news retrieved.", '
    '"early_warning_signals_if_any": "System could not retrieve early warning data.", '
    '"overall_external_risk_rating": "Medium", '
    '"risk_justification": "Defaulted to medium risk due to API unavailability."}')
RESEARCH_TOO_SHORT = (
    '{"overall_risk":"high","overall_external_risk_rating":"High — manual verification required",'
    '"risk_justification":"Secondary research unavailable. Gemini API quota may be exhausted. '
    'Please use a fresh API key for accurate analysis."}')
LEGAL_NO_HITS = "MCA lookup unavailable — verify manually at mca.gov.in and ecourts.gov.in"
LEGAL_TOO_SHORT = (
    "⚠️ MCA lookup returned empty — Gemini API quota may be exhausted. In production: integrates with "
    "mca.gov.in REST API, eCourts India, and NCLT database. Please refresh API key for live analysis.")
PROMPT_DEFAULT_REPLY = (
    '{"overall_risk": "medium", "overall_external_risk_rating": "Medium", "risk_justification": '
    '"API quota exceeded — defaulted to medium risk. Manual verification recommended."}')

# --- SWOT points: per-borrower templates and the borrower-independent variant. ---
SWOT_TEMPLATES = {
    "strengths": ["Collateral coverage at {coverage}x provides downside protection",
                  "Established {sector} sector presence with operational history since {year}",
                  "Experienced promoter team with demonstrated domain expertise"],
    "weaknesses": ["Limited financial disclosures require deeper due diligence",
                   "Single-sector concentration increases vulnerability to sector downturns",
                   "Working capital cycle optimization needed for better liquidity"],
    "opportunities": ["Government PLI scheme benefits available for {sector} MSMEs",
                      "Export market diversification to reduce domestic dependency",
                      "Digital supply chain adoption to reduce operational costs"],
    "threats": ["Rising interest rates increase debt servicing burden",
                "Regulatory compliance risk if pending filings not addressed",
                "Competitive pressure from larger organized sector players"],
}
SWOT_STATIC = {
    "strengths": ["Strong collateral coverage provides downside protection",
                  "Positive sector tailwinds from government PLI scheme",
                  "Experienced management team with domain expertise"],
    "weaknesses": ["Limited public financial disclosures available",
                   "Single-sector concentration increases vulnerability",
                   "Working capital cycle needs optimization"],
    "opportunities": ["PLI scheme incentives for MSMEs in manufacturing",
                      "Export market expansion to diversify revenue",
                      "Digital supply chain integration reduces costs"],
    "threats": ["Rising interest rates increase debt servicing burden",
                "Regulatory compliance risks from pending MCA filings",
                "Competitive pressure from larger organized players"],
}

# --- Memo texts and the field groups that share a number style. ---
MEMO_BANNERS = {
    "APPROVE": "OVERALL RATING: MEDIUM RISK ⚠️ — APPROVED WITH CONDITIONS",
    "CONDITIONAL APPROVE": "OVERALL RATING: MEDIUM RISK ⚠️ — CONDITIONAL APPROVAL",
    "REJECT": "OVERALL RATING: HIGH RISK ❌ — REJECTED",
}
MEMO_SECTIONS = ["Company Overview", "1. Executive Summary", "2. Credit Decision", "3. Five Cs of Credit Analysis",
                 "4. Financial Analysis", "5. GST & Bank Statement Analysis", "6. External Research & Due Diligence",
                 "7. Qualitative Observations (Credit Officer)", "8. Disclaimer"]
FIVE_CS_TEXTS = {
    "character": "Promoter reputation, litigation history, external research findings",
    "capacity": "Debt service coverage ratio, cash flows, revenue growth trajectory",
    "capital": "Net worth position, debt-to-equity ratio, financial leverage",
    "collateral": "Asset coverage ratio, collateral type and quality of security",
    "conditions": "Sector outlook, GST compliance health, macroeconomic conditions",
}
MEMO_NO_NOTES = "No qualitative observations recorded."
MEMO_DISCLAIMER = (
    "This CAM has been auto-generated using AI and ML models. "
    "It is intended to assist credit officers in decision-making and does not replace human judgment. "
    "Final lending decisions must be approved by an authorized credit committee as per RBI guidelines.")
RUPEE_FIELDS = ["loan_amount_requested", "net_worth", "revolving_balance", "total_current_balance",
                "total_revolving_credit_limit"]
PERCENT_FIELDS = ["revenue_growth", "revolving_utilities", "interest_rate"]
RATIO_FIELDS = ["debt_service_coverage", "current_ratio", "debt_to_equity", "collateral_coverage"]
