"""Search fan-out, research context, replies, fallbacks and officer notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.numbers import title_label
from creditloom.functions.replies import parse_fenced, strip_fences
from creditloom.functions.rules import infer_sector

LABEL_CHARS, FINDINGS_CHARS = 800, 1000  # what a page-sized memo shows of one entry
MIN_ANALYSIS, MIN_FINDINGS = 50, 30


def _filled(template: str, **values: Column) -> Column:
    """A text template with its {placeholders} replaced by columns."""
    pieces, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))


def query_fanout(applications: DataFrame) -> DataFrame:
    """Six research and three legal search texts per company."""
    company = F.coalesce("company_name", F.lit(""))
    sector = infer_sector(company)
    asked = [("research", i, q) for i, q in enumerate(fv.RESEARCH_QUERIES)] + [("legal", i, q) for i, q in enumerate(fv.LEGAL_QUERIES)]
    rows = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("query_no"), _filled(q, company=company, sector=sector).alias("query"))
        for kind, i, q in asked
    ])
    return applications.select("company_id", F.inline(rows))


RESEARCH_SHAPE = {"kind": "research", "k": 2, "per_hit": 500, "total": 6000}
LEGAL_SHAPE = {"kind": "legal", "k": 2, "per_hit": 400, "total": 5000}


def topk_hits(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` hits of every search. The rank filter is applied before the shuffle as well."""
    w = Window.partitionBy("company_id", "kind", "query_no").orderBy("hit_rank")
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def build_context(hits: DataFrame, kind: str = "research", k: int = 2, per_hit: int | None = None, total: int | None = None) -> DataFrame:
    """Numbered source texts per company from the searches of one kind, and all source addresses.

    Texts are whole unless ``per_hit`` and ``total`` cut them for a reader with little room (``RESEARCH_SHAPE``,
    ``LEGAL_SHAPE``). A company has at most ``k`` hits for each of a fixed number of searches, so its list is short.
    """
    kept = topk_hits(hits.where(F.col("kind") == kind), k)
    content = F.col("content") if per_hit is None else F.substring("content", 1, per_hit)
    ordered = F.array_sort(F.collect_list(F.struct("query_no", "rn", "url", content.alias("content"))))
    lists = kept.groupBy("company_id").agg(ordered.alias("_hits"))
    entries = F.transform("_hits", lambda h, i: F.concat(
        F.lit("Source "), (i + 1).cast("string"), F.lit(": "), h.url, F.lit("\n"), h.content))
    context = F.array_join(entries, "\n\n")
    return lists.select(
        "company_id", (context if total is None else F.substring(context, 1, total)).alias("context"),
        F.transform("_hits", lambda h: h.url).alias("sources"))


def with_reply_fallbacks(companies: DataFrame, replies: DataFrame) -> DataFrame:
    """Companies without any reply get the medium-risk research text and the unavailable legal text."""
    joined = companies.select("company_id").join(replies, "company_id", "left")
    return apply_fallbacks(joined.select(
        "company_id",
        F.coalesce("analysis", F.lit(fv.RESEARCH_NO_HITS)).alias("analysis"),
        F.coalesce("findings", F.lit(fv.LEGAL_NO_HITS)).alias("findings"),
    ))


def usable_reply(column: str) -> list[Column]:
    """The research reply, or the fallback where it is too short, and the list of sources that failed."""
    poor = F.length(F.coalesce(column, F.lit(""))) < MIN_ANALYSIS
    return [
        F.when(poor, fv.RESEARCH_TOO_SHORT).otherwise(F.col(column)).alias(column),
        F.array_compact(F.array(F.when(poor, "secondary_research"))).alias("quota_warnings"),
    ]


def apply_fallbacks(df: DataFrame) -> DataFrame:
    """Replaces replies that are too short and names the sources concerned."""
    poor_research = F.length(F.coalesce("analysis", F.lit(""))) < MIN_ANALYSIS
    poor_legal = F.length(F.coalesce("findings", F.lit(""))) < MIN_FINDINGS
    return df.withColumns({
        "analysis": F.when(poor_research, fv.RESEARCH_TOO_SHORT).otherwise(F.col("analysis")),
        "findings": F.when(poor_legal, fv.LEGAL_TOO_SHORT).otherwise(F.col("findings")),
        "quota_warnings": F.array_compact(F.array(F.when(poor_research, "secondary_research"), F.when(poor_legal, "mca"))),
    })


def _item_text(v: Column) -> Column:
    """A JSON value as text; lists, also lists written inside a text, are joined by " | "."""
    text = v.try_cast("string")
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    from_text = F.coalesce(
        F.array_join(F.try_variant_get(F.try_parse_json(F.replace(text, F.lit("'"), F.lit('"'))), "$", "array<string>"), " | "),
        F.regexp_replace(inner, "^[\"'\\[\\]]+|[\"'\\[\\]]+$", ""),
    )
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    as_list = F.array_join(F.try_variant_get(v, "$", "array<string>"), " | ", "None")
    return F.when(is_list, as_list).when(text.startswith("["), from_text).when(F.is_variant_null(v), "None").otherwise(text)


def _members(v: Column) -> Column:
    """Key/value entries of a JSON object; null for anything else."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def research_items(reply: Column, label_chars: int | None = None, findings_chars: int | None = None) -> Column:
    """(label, content) entries of a JSON reply; one entry with the cleaned text if it is not JSON.

    Nested objects give one entry per inner key. Contents are whole unless a number of characters is asked for.
    """
    def cut(c: Column, n: int | None) -> Column:
        return c if n is None else F.substring(c, 1, n)

    v = parse_fenced(reply)

    def item(label: Column, content: Column) -> Column:
        return F.struct(label.alias("label"), cut(content, label_chars).alias("content"))

    def expand(e: Column) -> Column:
        label = title_label(e.key)
        inner = F.transform(_members(e.value), lambda s: item(F.concat(label, F.lit(" — "), title_label(s.key)), _item_text(s.value)))
        return F.coalesce(inner, F.array(item(label, _item_text(e.value))))

    junk = F.struct(F.lit("Research Findings").alias("label"), cut(strip_fences(reply), findings_chars).alias("content"))
    parsed = F.flatten(F.transform(_members(v), expand))
    none = F.array().cast("array<struct<label:string,content:string>>")
    return F.when(v.isNull(), F.array(junk)).otherwise(F.coalesce(parsed, none))


def flatten_research(replies: DataFrame, label_chars: int | None = None, findings_chars: int | None = None) -> DataFrame:
    """Research entries of every reply as rows; works within the row, no shuffle. Numbers cut the texts, as a page-sized memo does."""
    return replies.select("company_id", F.inline(research_items(F.col("reply"), label_chars, findings_chars)))


def prompt_key(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def split_cached(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, todo): prompts with a stored reply, and each remaining distinct prompt once.

    ``prompts`` has prompt_id and prompt, ``cache`` has unique keys and replies. The lookup carries ids and keys
    only, in one plain join that adaptive execution splits where a prompt is repeated very often; a cache written
    in buckets of its key is not shuffled. For the todo list equal prompts are merged before the shuffle.
    """
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt")))
    hits = keyed.select("prompt_id", "key").join(cache.select("key", "reply"), "key")
    todo = keyed.groupBy("key").agg(F.first("prompt").alias("prompt")).join(cache.select("key"), "key", "left_anti")
    return hits, todo


def bullet_parts(notes: DataFrame, order: str, block: int = 256) -> DataFrame:
    """Officer notes as bulleted text in ordered parts of at most ``block`` notes."""
    part = F.floor(F.col(order) / block).cast("int")
    lines = F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("- "), "note").alias("line"))))
    return notes.groupBy("company_id", part.alias("part_no")).agg(F.array_join(lines.getField("line"), "\n").alias("notes"))


def qualitative_adjust(scores: DataFrame, replies: DataFrame) -> DataFrame:
    """Score after the adjustment a note reply suggests (clamped to 0-100); unreadable replies leave it as it is."""
    v = parse_fenced(F.col("reply"))
    change = F.coalesce(F.try_variant_get(v, "$.score_adjustment", "decimal(10,2)"), F.lit(0))
    score = F.col("score").cast("decimal(10,2)")
    adjusted = F.greatest(F.lit(0), F.least(F.lit(100), score + change))
    return scores.join(replies, "company_id", "left").select(
        "company_id", "score",
        F.when(v.isNull(), score).otherwise(adjusted).cast("double").alias("adjusted_score"),
        F.when(v.isNull(), F.col("reply")).alias("raw_response"))
