"""Every operator as a named query over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import numbers, replies, rules
from creditloom.operators import (attributions, classify, explain, gst, loans, memo, model, pages, research, scoring,
                                  screening, sheets)
from creditloom.plans import assessment
from creditloom.plans import fixtures as fx
from creditloom.session import ensure_checkpoint_dir, shared_folder
from creditloom.sources import cells, defaulters, files, tables

SEP = " ; "
MODEL_ROUNDS = model.ROUNDS  # boosting rounds of the registered model queries
RECALL_FLOOR = 0.8  # of each class of the hold-out share
MEMO_DATE = "01 January 2026"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def portable(df: DataFrame) -> DataFrame:
    """Columns in types every engine shares: bigint, double, boolean, text; lists become joined text."""
    def convert(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), SEP)
        return c.alias(name)

    return df.select(*[convert(n, k) for n, k in df.dtypes])


def query(key: str):
    def register(fn):
        QUERIES[key] = lambda spark, sf: portable(fn(spark, sf))
        return fn
    return register


# --- sources and sinks ---

def _as_csv(df: DataFrame, spark: SparkSession, name: str) -> str:
    path = shared_folder(spark, name)
    df.write.option("header", True).csv(path)
    return path


@query("csv_source")
def csv_source(spark, sf):
    returns = fx.gst_returns(spark, sf).drop("filed_at")
    return tables.read_table(spark, _as_csv(returns, spark, "gst-csv"))


@query("records")
def records(spark, sf):
    rows = fx.gst_returns(spark, sf).select("return_id", "company_id", "return_type", F.col("taxable_value").cast("string").alias("taxable_value"))
    return tables.to_records(rows)


@query("defaulter_union")
def defaulter_union(spark, sf):
    lists = [_as_csv(fx.defaulters_lower(spark, sf), spark, "list-a"), _as_csv(fx.defaulters_upper(spark, sf), spark, "list-b")]
    return defaulters.load_defaulters(spark, [*lists, lists[0] + "-absent"])


@query("warehouse_load")
def warehouse_load(spark, sf):
    fx.table(spark, sf, "customer").createOrReplaceTempView("credit_data")
    return tables.load_or_fallback(spark, "credit_data", "", ["c_custkey"])


@query("file_preview")
def file_preview(spark, sf):
    return cells.file_preview(fx.sheet_rows(spark, sf))


@query("raw_preview")
def raw_preview(spark, sf):
    return cells.raw_preview(cells.rows_from_cells(fx.wide_cells(spark, sf)))


@query("sheet_shape")
def sheet_shape(spark, sf):
    return cells.shape_of(fx.sheet_rows(spark, sf))


@query("route_by_ext")
def route_by_ext(spark, sf):
    return files.route_files(fx.doc_files(spark, sf))


@query("to_cells")
def to_cells(spark, sf):
    lines = fx.table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    return cells.to_cells(lines, F.col("l_orderkey"), F.col("l_linenumber"), ["l_returnflag", "l_partkey", "price"])


@query("load_and_validate")
def load_and_validate(spark, sf):
    returns = _as_csv(fx.gst_returns(spark, sf).drop("filed_at"), spark, "gst-csv")
    loaded = tables.load_and_validate(spark, returns, _as_csv(_bank(spark, sf), spark, "bank-csv"))
    rows = [loaded[f"{kind}_df"].agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.lit(loaded[f"{kind}_valid"]).alias("valid")) for kind in ("gst", "bank")]
    return rows[0].unionByName(rows[1])


@query("validate_columns")
def validate_columns(spark, sf):
    returns, bank = fx.gst_returns(spark, sf), fx.bank_txns(spark, sf)
    return tables.validate(returns, "gst").unionByName(tables.validate(bank, "bank")).unionByName(
        tables.validate(bank, "gst").withColumn("kind", F.lit("bank as gst")))


# --- projections and filters ---

def _bank(spark, sf):
    return fx.bank_txns(spark, sf).drop("txn_at")


@query("resolve_column")
def resolve_column(spark, sf):
    renamed = _bank(spark, sf).toDF("company_id", "Txn Kind", "AMT (INR)")
    return gst.bank_credits(renamed)


@query("credit_filter")
def credit_filter(spark, sf):
    return _bank(spark, sf).where(rules.is_credit(F.col("transaction_type")))


@query("onboarding_check")
def onboarding_check(spark, sf):
    return scoring.missing_required(fx.applications(spark, sf))


@query("train_prep")
def train_prep(spark, sf):
    return loans.prepare_loans(loans.default_label(fx.loans(spark, sf)), label="label")


def _typed_facts(spark, sf):
    kinds = ["ALM", "Shareholding_Pattern", "Borrowing_Profile", "Annual_Report", "Portfolio_Data", "Other"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 6 + 1).cast("int"))
    return sheets.kv_extract(fx.sheet_rows(spark, sf)).withColumn("doc_type", kind)


@query("schema_filter")
def schema_filter(spark, sf):
    return sheets.filter_schema(_typed_facts(spark, sf), fx.doc_fields(spark, sf)).select("doc_id", "doc_type", "field", "value")


@query("split_promoters")
def split_promoters(spark, sf):
    return fx.applications(spark, sf).select("company_id", rules.split_promoters(F.col("promoter_names")).alias("promoters"))


@query("base_financials")
def base_financials(spark, sf):
    return scoring.base_financials(fx.applications(spark, sf))


@query("model_features")
def model_features(spark, sf):
    return scoring.model_features(fx.loans(spark, sf), "loan_id")


@query("apply_overrides")
def apply_overrides(spark, sf):
    auto = classify.classify_pages(fx.page_text(spark, sf), out="auto_type")
    edits = auto.where("doc_id % 10 < 2").selectExpr("doc_id", "CASE doc_id % 10 WHEN 0 THEN 'ALM' ELSE 'Portfolio_Data' END AS edited_type")
    return classify.apply_overrides(auto, edits)


# --- joins ---

def _defaulters(spark, sf):
    return defaulters.union_lists([defaulters.unify_headers(fx.defaulters_lower(spark, sf)), defaulters.unify_headers(fx.defaulters_upper(spark, sf))])


def _matches(spark, sf):
    return screening.blacklist_matches(fx.applications(spark, sf), _defaulters(spark, sf))


@query("blacklist_matches")
def blacklist_matches(spark, sf):
    return _matches(spark, sf)


@query("borrower_history")
def borrower_history(spark, sf):
    customers = fx.table(spark, sf, "customer")
    apps = customers.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"))
    orders = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    history = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("company_name"), "o_orderkey")
    return screening.with_history(apps, history)


@query("gst_bank_align")
def gst_bank_align(spark, sf):
    return gst.gst_bank_align(fx.gst_returns(spark, sf), _bank(spark, sf))


def _cases(spark, sf):
    return assessment.assemble(fx.applications(spark, sf), fx.gst_returns(spark, sf), _bank(spark, sf), fx.research_replies(spark, sf),
                               _defaulters(spark, sf), stated=fx.STATED)


@query("assemble_case")
def assemble_case(spark, sf):
    return _cases(spark, sf).select("company_id", "loan_amount_requested", "collateral_coverage", "net_worth", "gst_revenue", "bank_credits",
                                    "discrepancy_pct", "gst_risk", "risk_rating", "blacklisted", "n_matches", "default_probability")


@query("schema_lookup")
def schema_lookup(spark, sf):
    docs = fx.table(spark, sf, "documents")
    typed = classify.classify_docs(docs.select("source", "text"), "source", "text").select("doc_type")
    return sheets.schema_lookup(typed.unionByName(docs.select(F.col("lang").alias("doc_type"))))


@query("reply_cache")
def reply_cache(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    prompts = turns.selectExpr("conv_id * 1000 + turn AS prompt_id", "text AS prompt")
    cache = turns.where("role = 'user' AND conv_id % 2 = 0").select(research.prompt_key(F.col("text")).alias("key")).distinct().withColumn(
        "reply", F.concat(F.lit("reply "), "key"))
    hits, todo = research.split_cached(prompts, cache)
    return hits.select(F.lit("hit").alias("kind"), "prompt_id", "key", F.col("reply").alias("text")).unionByName(
        todo.select(F.lit("todo").alias("kind"), F.lit(None).cast("bigint").alias("prompt_id"), "key", F.col("prompt").alias("text")))


# --- aggregations ---

@query("gst_revenue")
def gst_revenue(spark, sf):
    return gst.gst_revenue(fx.gst_returns(spark, sf))


@query("bank_credits")
def bank_credits(spark, sf):
    return gst.bank_credits(_bank(spark, sf))


@query("cross_verify")
def cross_verify(spark, sf):
    return gst.cross_verify(fx.gst_returns(spark, sf), _bank(spark, sf))


@query("itc_reconcile")
def itc_reconcile(spark, sf):
    return gst.itc_reconcile(fx.gst_returns(spark, sf))


@query("gst_describe")
def gst_describe(spark, sf):
    out = gst.describe_numeric(fx.gst_returns(spark, sf), ["taxable_value", "total_tax"])
    return out.select("column", "count", *[F.round(c, 3).alias(c) for c in out.columns[2:]])


@query("blacklist_summary")
def blacklist_summary(spark, sf):
    return screening.blacklist_summary(_matches(spark, sf), fx.applications(spark, sf))


@query("detect_doc_type")
def detect_doc_type(spark, sf):
    return classify.detect_doc_type(fx.table(spark, sf, "documents"), "doc_id")


@query("scanned_docs")
def scanned_docs(spark, sf):
    return pages.scanned_docs(fx.conversation_pages(spark, sf))


@query("merge_pages")
def merge_pages(spark, sf):
    return sheets.merge_last(pages.page_facts(fx.page_text(spark, sf)), "page_no")


@query("kv_extract")
def kv_extract(spark, sf):
    return sheets.kv_extract(fx.sheet_rows(spark, sf))


@query("column_extract")
def column_extract(spark, sf):
    return sheets.column_extract(cells.rows_from_cells(fx.wide_cells(spark, sf)))


@query("research_context")
def research_context(spark, sf):
    return research.build_context(fx.search_hits(spark, sf), **research.RESEARCH_SHAPE)


@query("legal_context")
def legal_context(spark, sf):
    return research.build_context(fx.search_hits(spark, sf), **research.LEGAL_SHAPE)


@query("whole_context")
def whole_context(spark, sf):
    return research.build_context(fx.search_hits(spark, sf))


@query("confidence")
def confidence(spark, sf):
    return pages.confidence(pages.regex_facts(fx.page_text(spark, sf)))


@query("sheet_confidence")
def sheet_confidence(spark, sf):
    return sheets.sheet_confidence(sheets.sheet_facts(fx.sheet_rows(spark, sf)))


@query("class_report")
def class_report(spark, sf):
    return loans.class_report(fx.table(spark, sf, "labels"), "quality", "toxic")


def _labelled(spark, sf):
    return loans.default_label(fx.loans(spark, sf))


@query("balanced_weights")
def balanced_weights(spark, sf):
    return loans.balanced_weights(_labelled(spark, sf)).select("loan_id", "label", F.round("weight", 6).alias("weight"))


@query("five_cs_weighted")
def five_cs_weighted(spark, sf):
    return scoring.five_cs(_cases(spark, sf)).select("company_id", scoring.five_cs_weighted().alias("rule_score"))


def _document_facts(spark, sf):
    owner = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey AS company_id", "o_orderkey + 1 AS doc_order")
    return assessment.document_facts(fx.page_text(spark, sf)).unionByName(assessment.workbook_facts(fx.sheet_rows(spark, sf), owner))


@query("merge_facts")
def merge_facts(spark, sf):
    base = scoring.base_financials(fx.applications(spark, sf))
    return scoring.merge_facts(base, _document_facts(spark, sf)).select("company_id", *scoring.RATIO_DEFAULTS, "net_worth", "turnover")


@query("layer_merge")
def layer_merge(spark, sf):
    rule = sheets.merge_last(pages.page_facts(fx.page_text(spark, sf)), "page_no")
    layers = rule.withColumn("layer", F.lit(1)).unionByName(
        rule.where("doc_id % 3 = 0").selectExpr("doc_id", "field", "value * 2 AS value", "2 AS layer")).unionByName(
        rule.where("doc_id % 5 = 0").selectExpr("doc_id", "field", "value * 3 AS value", "3 AS layer"))
    return sheets.merge_last(layers, "layer")


@query("doc_completeness")
def doc_completeness(spark, sf):
    slots = fx.table(spark, sf, "orders").selectExpr("o_custkey AS company_id", "o_orderpriority AS doc_key")
    return files.doc_completeness(slots)


@query("document_text")
def document_text(spark, sf):
    return pages.document_text(fx.page_text(spark, sf), fx.page_table_cells(spark, sf))


@query("extraction_summary")
def extraction_summary(spark, sf):
    docs = fx.conversation_pages(spark, sf)
    return pages.extraction_summary(docs, pages.regex_facts(docs))


# --- ranking ---

@query("header_row")
def header_row(spark, sf):
    return sheets.promote_header(cells.rows_from_cells(fx.wide_cells(spark, sf)))


@query("topk_hits")
def topk_hits(spark, sf):
    return research.topk_hits(fx.search_hits(spark, sf), k=2).select("company_id", "kind", "query_no", "rn", "url")


@query("top_factors")
def top_factors(spark, sf):
    return attributions.top_factors(fx.factor_rows(spark, sf))


@query("head_lists")
def head_lists(spark, sf):
    lists = research.build_context(fx.search_hits(spark, sf))
    return lists.select("company_id", *[rules.slice_n(F.col("sources"), n).alias(f"first_{n}") for n in (5, 6, 8)])


@query("key_pages")
def key_pages(spark, sf):
    return pages.key_pages(fx.page_text(spark, sf))


# --- set operations ---

@query("union_lists")
def union_lists(spark, sf):
    both = defaulters.union_lists([fx.defaulters_lower(spark, sf), fx.defaulters_upper(spark, sf)])
    return both.select("party", "bknm", "osamt", "suit", F.col("PRTY").alias("prty"), F.col("`OSAMT (Rs. Lac)`").alias("osamt_lac"))


@query("factor_chart")
def factor_chart(spark, sf):
    return attributions.factor_chart_of_rows(fx.factor_rows(spark, sf))


# --- scalar functions ---

@query("clean_value")
def clean_value(spark, sf):
    return fx.label_rows(spark, sf).select("doc_id", "row_no", "value", numbers.clean_value(F.col("value")).alias("number"))


@query("regex_facts")
def regex_facts(spark, sf):
    return pages.regex_facts(fx.page_text(spark, sf))


@query("bureau_flags")
def bureau_flags(spark, sf):
    return pages.bureau_flags(fx.page_text(spark, sf))


@query("classify_doc")
def classify_doc(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "text")
    return classify.classify_docs(docs, "source", "text").select("doc_id", "doc_type")


@query("classify_fallback")
def classify_fallback(spark, sf):
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", classify.classify_fallback("text").alias("doc_type"))


@query("parse_reply")
def parse_reply(spark, sf):
    v = fx.research_replies(spark, sf).select("company_id", replies.parse_reply(F.col("reply")).alias("v"))
    return v.select("company_id", F.col("v").isNotNull().alias("parsed"), replies.text_at(F.col("v"), "overall_external_risk_rating").alias("rating"),
                    replies.text_at(F.col("v"), "overall_risk").alias("risk"))


@query("format_inr")
def format_inr(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", *[numbers.format_inr(price * n).alias(f"x{n}") for n in (1, 10, 1000)])


def _long_financials(spark, sf):
    base = scoring.base_financials(fx.applications(spark, sf), fx.STATED)
    kept = sorted(memo.STYLED)
    return base.select("company_id", *[F.col(c).cast("double").alias(c) for c in kept]).unpivot("company_id", kept, "field", "value")


@query("format_financials")
def format_financials(spark, sf):
    return explain.format_financials(_long_financials(spark, sf))


@query("rating_band")
def rating_band(spark, sf):
    return scoring.five_cs_long(scoring.five_cs(_cases(spark, sf)))


@query("risk_band")
def risk_band(spark, sf):
    return fx.applications(spark, sf).select("company_id", rules.risk_band(F.col("default_probability")).alias("band"))


@query("research_rating")
def research_rating(spark, sf):
    rated = assessment.ratings(fx.research_replies(spark, sf))
    return rated.select("company_id", "risk_rating", replies.rating_score(F.col("risk_rating")).alias("character"))


@query("infer_sector")
def infer_sector(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", "p_name", rules.infer_sector(F.col("p_name")).alias("sector"))


@query("query_fanout")
def query_fanout(spark, sf):
    return research.query_fanout(fx.applications(spark, sf))


@query("flatten_research")
def flatten_research(spark, sf):
    return research.flatten_research(fx.research_replies(spark, sf))


@query("flatten_research_memo")
def flatten_research_memo(spark, sf):
    return research.flatten_research(fx.research_replies(spark, sf), research.LABEL_CHARS, research.FINDINGS_CHARS)


@query("metric_display")
def metric_display(spark, sf):
    facts = sheets.kv_extract(fx.sheet_rows(spark, sf))
    return facts.select("doc_id", numbers.title_label(F.col("field")).alias("label"), numbers.metric_display(F.col("value")).alias("shown"))


@query("research_quality")
def research_quality(spark, sf):
    got = fx.research_replies(spark, sf).where("company_id % 4 <> 0").select("company_id", F.col("reply").alias("analysis"), F.col("reply").alias("findings"))
    return research.with_reply_fallbacks(fx.applications(spark, sf), got)


# --- scoring and decision ---

@query("five_cs")
def five_cs(spark, sf):
    return scoring.five_cs(_cases(spark, sf)).select("company_id", *scoring.FACTORS)


def _scored(spark, sf):
    return scoring.blend_score(scoring.five_cs(_cases(spark, sf)))


@query("blend_score")
def blend_score(spark, sf):
    return _scored(spark, sf).select("company_id", "default_probability", "rule_score", "ml_score", "weighted_score")


@query("decide")
def decide(spark, sf):
    return scoring.decide(_scored(spark, sf)).select("company_id", "score", "decision", "credit_limit", "risk_premium")


@query("blacklist_override")
def blacklist_override(spark, sf):
    return scoring.override_blacklisted(scoring.decide(_scored(spark, sf))).select(
        "company_id", "blacklisted", "score", "decision", "credit_limit", "risk_premium")


def _decided(spark, sf):
    return assessment.decided(_cases(spark, sf))


@query("early_warnings")
def early_warnings(spark, sf):
    return _decided(spark, sf).select("company_id", "early_warnings", "officer_review")


@query("explain")
def explain_query(spark, sf):
    return _decided(spark, sf).select("company_id", "explanation", "top_reason", "reason_sentence", "warnings_text")


@query("qualitative_adjust")
def qualitative_adjust(spark, sf):
    scores = fx.applications(spark, sf).select("company_id", F.col("default_probability").alias("score"))
    return research.qualitative_adjust(scores, fx.note_replies(spark, sf))


@query("note_bullets")
def note_bullets(spark, sf):
    return research.bullet_parts(fx.officer_notes(spark, sf), "note_no")


@query("swot_fallback")
def swot_fallback(spark, sf):
    return explain.swot_points(fx.applications(spark, sf))


def _memos(spark, sf):
    sources = research.build_context(fx.search_hits(spark, sf)).select("company_id", "sources")
    ensure_checkpoint_dir(spark)
    cases = _decided(spark, sf).join(sources, "company_id", "left").checkpoint()
    return memo.memo_sections(cases, MEMO_DATE, notes=fx.officer_notes(spark, sf))


@query("memo_sections")
def memo_sections(spark, sf):
    return _memos(spark, sf)


@query("write_memos")
def write_memos(spark, sf):
    memos, path = _memos(spark, sf), shared_folder(spark, "memos")
    memo.write_memos(memos, path)
    return memo.read_memos(spark, path, schema=memos.schema)


# --- model ---

_model_paths: dict[tuple[str, str], str] = {}


def _model(spark, sf):
    """The stored model of a folder's loans, trained at first use, with its path."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _model_paths:
        _model_paths[at] = shared_folder(spark, "default-model")
    path = _model_paths[at]
    return model.load_or_train(spark, path, _labelled(spark, sf), MODEL_ROUNDS), path


@query("synth_loans")
def synth_loans(spark, sf):
    made = loans.synth_loans(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    return made.select("loan_id", *[F.round(c, 6).alias(c) for c in scoring.fv.MODEL_FEATURES], "label")


@query("default_label")
def default_label(spark, sf):
    return _labelled(spark, sf).select("loan_id", "points", "label")


@query("stratified_split")
def stratified_split(spark, sf):
    return loans.stratified_split(_labelled(spark, sf)).select("loan_id", "label", "is_test")


@query("train_default_model")
def train_default_model(spark, sf):
    fitted, _ = _model(spark, sf)
    return loans.class_report(model.holdout_predictions(fitted, _labelled(spark, sf)))


@query("model_store")
def model_store(spark, sf):
    _, path = _model(spark, sf)
    again = model.load_or_train(spark, path)
    return model.holdout_predictions(again, _labelled(spark, sf)).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _features(spark, sf):
    return scoring.model_features(fx.loans(spark, sf), "loan_id")


@query("score_loans")
def score_loans(spark, sf):
    return model.score_loans(_features(spark, sf), _model(spark, sf)[0])


@query("score_fallback")
def score_fallback(spark, sf):
    apps = fx.applications(spark, sf)
    p = F.col("default_probability")
    known = apps.where("company_id % 3 <> 0").select("company_id", p, (100 - p).alias("ml_score"), rules.risk_band(p).alias("recommendation"))
    out = model.with_fallback(apps, known)
    return out.select("company_id", "default_probability", "ml_score", "recommendation", F.size("risk_factors").alias("n_fixed_risks"),
                      F.col("positive_factors")[0]["feature"].alias("first_fixed_positive"))


@query("attributions")
def attributions_query(spark, sf):
    return attributions.attributions(_features(spark, sf), *_model(spark, sf))


@query("train_default_model_check")
def train_default_model_check(spark, sf):
    """Per class the size of the hold-out share and whether the model finds most of it."""
    fitted, _ = _model(spark, sf)
    right = F.avg((F.col("label") == F.col("prediction")).cast("int"))
    return model.holdout_predictions(fitted, _labelled(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n_test"), (right >= RECALL_FLOOR).alias("found"))


@query("model_store_check")
def model_store_check(spark, sf):
    """The store holds one version, and a model read from it again predicts what the first one does."""
    fitted, path = _model(spark, sf)
    number = model.versions(spark, path)[-1]
    again = PipelineModel.load(model.version_path(path, number))
    rows = model.holdout_predictions(fitted, _labelled(spark, sf)).select("loan_id", "prediction")
    other = model.holdout_predictions(again, _labelled(spark, sf)).select("loan_id", F.col("prediction").alias("again"))
    return rows.join(other, "loan_id").agg(F.lit(number).alias("version"), F.count(F.lit(1)).alias("n_test"), F.every(F.col("prediction") == F.col("again")).alias("same"))


@query("score_loans_check")
def score_loans_check(spark, sf):
    scored = model.score_loans(_features(spark, sf), _model(spark, sf)[0])
    p = F.col("default_probability")
    return scored.select("loan_id", p.between(8, 80).alias("bounded"), (F.abs(p + F.col("ml_score") - 100) < 1e-9).alias("complement"),
                         (F.col("recommendation") == rules.risk_band(p)).alias("band"))


@query("attributions_check")
def attributions_check(spark, sf):
    """Contributions and mean margin give the raw prediction of every loan."""
    fitted, path = _model(spark, sf)
    wide = attributions.attributions_wide(_features(spark, sf), fitted, path)
    raw = fitted.transform(_features(spark, sf)).select("loan_id", vector_to_array("rawPrediction")[1].alias("raw"))
    total = sum([F.col(c) for c in scoring.fv.MODEL_FEATURES], F.col("base"))
    return wide.join(raw, "loan_id").select("loan_id", (F.abs(total - F.col("raw")) < 1e-6).alias("additive"))


# --- whole assessment ---

@query("assess_borrowers")
def assess_borrowers(spark, sf):
    done = assessment.assess(fx.applications(spark, sf), fx.gst_returns(spark, sf), _bank(spark, sf), fx.research_replies(spark, sf),
                             _defaulters(spark, sf), facts=_document_facts(spark, sf), stated=fx.STATED)
    return done.select("company_id", "company_name", *scoring.FACTORS, "rule_score", "ml_score", "score", "decision", "credit_limit", "risk_premium",
                       "discrepancy_pct", "gst_risk", "risk_rating", "blacklisted", "early_warnings", "officer_review", "reason_sentence", "warnings_text",
                       "quota_warnings")


@query("assess_with_model")
def assess_with_model(spark, sf):
    apps = fx.applications(spark, sf)
    done = assessment.assess(apps, fx.gst_returns(spark, sf), _bank(spark, sf), fx.research_replies(spark, sf), _defaulters(spark, sf),
                             stated=fx.STATED, ml=assessment.model_scores(apps, _model(spark, sf)[0]))
    return done.select("company_id", "default_probability", "ml_score", "rule_score", "score", "decision", "credit_limit", "risk_premium", "reason_sentence")


@query("applicant_factors")
def applicant_factors(spark, sf):
    features = scoring.model_features(scoring.base_financials(fx.applications(spark, sf)))
    wide = attributions.attributions_wide(features, *_model(spark, sf), key="company_id")
    return attributions.factor_chart_of_wide(wide, key="company_id")


@query("assess_with_model_check")
def assess_with_model_check(spark, sf):
    p = F.col("default_probability")
    return assess_with_model(spark, sf).select("company_id", p.between(8, 80).alias("bounded"), (F.abs(p + F.col("ml_score") - 100) < 1e-9).alias("complement"),
                                               F.col("score").between(0, 100).alias("score_bounded"))


@query("applicant_factors_check")
def applicant_factors_check(spark, sf):
    """Three to six factors a company, none twice, their type by the sign of their impact."""
    kind = F.when(F.col("impact") > 0, "Risk").otherwise("Positive")
    return applicant_factors(spark, sf).groupBy("company_id").agg(
        F.count(F.lit(1)).between(3, 6).alias("n_in_range"), (F.countDistinct("feature") == F.count(F.lit(1))).alias("unlike"), F.every(F.col("type") == kind).alias("typed"))
