"""Facts from document pages.

A document may have any number of pages, so its text is handled as ordered parts of at most
``PAGES_PER_PART`` pages. A part also carries the beginning of what follows it, long enough to finish any
match that starts in the part; the first match of a document is then the one of its lowest part. (Blank
pages are the exception: more than forty in a row between the pieces of one match are not bridged.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.rules import contains_any

PAGES_PER_PART = 64
GAP = 20  # longest run of other characters a pattern allows between its words and the number
SCAN_PAGES, SCAN_CHARS = 3, 80
IMAGE_BUDGET, SCANNED_BUDGET, LONG_DOC = 10, 8, 5
DPD_SHOWN = 5

# What later pages can add to an unfinished match: twice up to GAP non-digits and the number behind them.
AHEAD = "^" + r"[^0-9]{0,%d}[0-9.,]*" % GAP * 2


def _pattern(p: str) -> str:
    """``(?d)`` lets the dot stop at line feeds only."""
    return "(?d)" + p


def _joined(items: Column) -> Column:
    """Page texts in page order, each ended by a line feed."""
    ordered = F.array_sort(F.collect_list(items))
    return F.array_join(F.transform(ordered, lambda p: F.concat(p.text, F.lit("\n"))), "")


def page_blocks(page_text: DataFrame, table_cells: DataFrame | None = None) -> DataFrame:
    """Page text followed by the page's table rows, cells joined by " | "."""
    pages = page_text.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    if table_cells is None:
        return pages
    cell = F.struct("col_no", F.trim(F.coalesce("value", F.lit(""))).alias("value"))
    rows = table_cells.groupBy("doc_id", "page_no", "row_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c.value), " | ").alias("line"))
    tables = rows.groupBy("doc_id", "page_no").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("row_no", "line"))).getField("line"), "\n").alias("lines"))
    return pages.join(tables, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no",
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "lines")).alias("text"))


def document_parts(blocks: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """(doc_id, part_no, text, ahead): whole texts in bounded pieces; page numbers start at one."""
    part = F.floor((F.col("page_no") - 1) / pages_per_part).cast("int")
    own = blocks.select("doc_id", part.alias("part_no"), F.lit(False).alias("next"), "page_no", "text")
    # A blank page still adds its line feed, so this many pages use up both gaps.
    pages = 2 * GAP + 1
    reach = -(-pages // pages_per_part)
    heads = blocks.select(
        "doc_id", F.explode(F.sequence(part - reach, part - 1)).alias("part_no"), F.lit(True).alias("next"), "page_no",
        F.regexp_extract("text", AHEAD, 0).alias("text"),
    ).where((F.col("part_no") >= 0) & (F.col("page_no") - (F.col("part_no") + 1) * pages_per_part <= pages))
    page = F.struct("page_no", "text")
    return (
        own.unionByName(heads)
        .groupBy("doc_id", "part_no")
        .agg(
            _joined(F.when(~F.col("next"), page)).alias("text"),
            F.regexp_extract(_joined(F.when(F.col("next"), page)), AHEAD, 0).alias("ahead"),
        )
    )


def document_text(page_text: DataFrame, table_cells: DataFrame | None = None,
                  pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Whole document text as ordered parts; joined in order they give the text without outer white space."""
    blocks = page_blocks(page_text, table_cells)
    filled = F.when(F.regexp_like("text", F.lit(r"\S")), F.col("page_no"))
    ends = blocks.groupBy("doc_id").agg(F.min(filled).alias("_first"), F.max(filled).alias("_last"))
    part = F.floor((F.col("page_no") - 1) / pages_per_part)
    parts = blocks.withColumn("part_no", part.cast("int")).groupBy("doc_id", "part_no").agg(
        _joined(F.struct("page_no", "text")).alias("text"))
    # The left side has one row per part by now and the right side one per document.
    edges = parts.join(ends, "doc_id")
    first = F.floor((F.col("_first") - 1) / pages_per_part)
    last = F.floor((F.col("_last") - 1) / pages_per_part)
    text = F.when(F.col("part_no") == first, F.regexp_replace("text", r"^\s+", "")).otherwise(F.col("text"))
    text = F.when(F.col("part_no") == last, F.regexp_replace(text, r"\s+$", "")).otherwise(text)
    return edges.where((F.col("part_no") >= first) & (F.col("part_no") <= last)).select("doc_id", "part_no", text.alias("text"))


def _found(df: DataFrame, keys: list[str], within: Column | None = None) -> DataFrame:
    """First match per pattern in the lower-cased text ``_t``; all patterns run in one projection.

    With ``within`` only matches that start in that many leading characters count. The position is looked up
    for matches only.
    """
    raw = df.select("*", *[
        F.nullif(F.regexp_extract("_t", _pattern(p), 1), F.lit("")).alias(f) for f, p in fv.TEXT_PATTERNS.items()
    ])

    def kept(field: str, pattern: str) -> Column:
        c = F.col(field)
        if within is not None:
            c = F.when(c.isNotNull() & (F.regexp_instr("_t", F.lit(_pattern(pattern))) <= within), c)
        return F.replace(c, F.lit(","), F.lit("")).alias(field)

    return raw.select(*keys, *[kept(f, p) for f, p in fv.TEXT_PATTERNS.items()])


def _as_facts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per matched field. A match that is no number keeps its row with a null value."""
    fields = list(fv.TEXT_PATTERNS)
    long = df.unpivot(keys, fields, "field", "raw")
    return long.where(F.col("raw").isNotNull()).select(*keys, "field", F.col("raw").try_cast("double").alias("value"))


def page_facts(page_text: DataFrame) -> DataFrame:
    """Fields found on each page."""
    lowered = page_text.select("doc_id", "page_no", F.lower("text").alias("_t"))
    found = _found(lowered, ["doc_id", "page_no"])
    return _as_facts(found, ["doc_id", "page_no"]).where(F.col("value").isNotNull())


def regex_facts(page_text: DataFrame, table_cells: DataFrame | None = None,
                pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Fields found in whole documents: the first match of a pattern counts, even when it is not a number."""
    parts = document_parts(page_blocks(page_text, table_cells), pages_per_part)
    own = F.lower("text")
    # Lowered separately, and measured as regexp_instr counts: in UTF-16 units.
    units = (F.octet_length(F.encode(own, "UTF-16BE")) / 2).cast("int")
    lowered = parts.select("doc_id", "part_no", F.concat(own, F.lower("ahead")).alias("_t"), units.alias("_own"))
    found = _found(lowered, ["doc_id", "part_no"], within=F.col("_own"))
    first = _as_facts(found, ["doc_id", "part_no"]).groupBy("doc_id", "field").agg(F.min_by("value", "part_no").alias("value"))
    return first.where(F.col("value").isNotNull())


def bureau_flags(page_text: DataFrame, table_cells: DataFrame | None = None,
                 pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Days-past-due values (the first five), whether any exceeds 30, mention flag and red-flag phrases.

    Where a part ends in "dpd" and the next begins with another "dpd" within five characters, the number
    behind both is listed twice; the flags are not affected.
    """
    t = F.col("_t")
    parts = document_parts(page_blocks(page_text, table_cells), pages_per_part).select(
        "doc_id", "part_no", F.lower("text").alias("_t"), F.lower("ahead").alias("_ahead"))
    inside = F.regexp_extract_all(t, F.lit(fv.DPD_PATTERN), F.lit(1))
    # A mention at the very end of a part finds its number at the start of the next one.
    tail = F.regexp_extract(t, r"dpd[^0-9]{0,5}\z", 0)
    across = F.nullif(F.regexp_extract(F.concat(tail, "_ahead"), "^" + fv.DPD_PATTERN, 1), F.lit(""))
    numbers = F.concat(inside, F.array_compact(F.array(F.when(tail != "", across))))
    marked = parts.select(
        "doc_id", "part_no", numbers.alias("_numbers"),
        contains_any("_t", fv.DPD_MENTIONS).alias("_mention"),
        *[t.contains(k).alias(f"_flag{i}") for i, k in enumerate(fv.BUREAU_RED_FLAGS)],
    )
    # A number too long for a bigint certainly exceeds 30.
    late = F.exists("_numbers", lambda n: F.coalesce(n.try_cast("bigint") > 30, F.lit(True)))
    flags = F.array_compact(F.array(*[F.when(F.bool_or(f"_flag{i}"), k) for i, k in enumerate(fv.BUREAU_RED_FLAGS)]))
    per_doc = marked.groupBy("doc_id").agg(
        (F.bool_or(F.size("_numbers") > 0) | F.bool_or("_mention")).alias("has_dpd"),
        F.bool_or(late).alias("cibil_risk"),
        flags.alias("red_flags"),
    )
    # Five values need at most the first five parts that have any, so the lists below stay short.
    w = Window.partitionBy("doc_id").orderBy("part_no")
    leading = (
        marked.where(F.size("_numbers") > 0)
        .select("doc_id", "part_no", F.slice("_numbers", 1, DPD_SHOWN).alias("_n"))
        .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= DPD_SHOWN)
        .groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("part_no", "_n"))).getField("_n")).alias("_n"))
    )
    shown = F.transform(F.slice(F.col("_n"), 1, DPD_SHOWN), lambda n: n.try_cast("bigint"))
    empty = F.array().cast("array<bigint>")
    return per_doc.join(leading, "doc_id", "left").select(
        "doc_id", "has_dpd", F.coalesce(shown, empty).alias("dpd_values"), "cibil_risk", "red_flags")


def scanned_docs(page_text: DataFrame) -> DataFrame:
    """A document is scanned when its first pages hold little text for its number of pages."""
    head = F.coalesce(F.sum(F.when(F.col("page_no") <= SCAN_PAGES, F.length("text"))), F.lit(0))
    return page_text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), head.alias("head_chars")).withColumn(
        "scanned", F.col("head_chars") < F.col("n_pages") * SCAN_CHARS)


def key_pages(page_text: DataFrame) -> DataFrame:
    """Pages worth a closer look: of long documents the first three and last two within the first ten; of
    scanned ones the first eight."""
    docs = scanned_docs(page_text)
    early = page_text.where(F.col("page_no") <= IMAGE_BUDGET).select("doc_id", "page_no")  # at most ten rows per document
    wanted = F.when(F.col("scanned"), F.col("page_no") <= SCANNED_BUDGET).otherwise(
        (F.col("n_pages") >= LONG_DOC) & ((F.col("page_no") <= 3) | (F.col("page_no") > F.col("n_pages") - 2)))
    return early.join(docs, "doc_id").where(wanted).select("doc_id", "page_no", "scanned")


def confidence_of(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low")


def image_confidence_of(n: Column) -> Column:
    return F.when(n >= 3, "high").otherwise("medium")


def confidence(facts: DataFrame) -> DataFrame:
    """Distinct fields per document and the confidence they give, for text and for image documents."""
    n = F.countDistinct("field")
    return facts.groupBy("doc_id").agg(n.alias("n_fields")).select(
        "doc_id", "n_fields", confidence_of(F.col("n_fields")).alias("confidence"),
        image_confidence_of(F.col("n_fields")).alias("image_confidence"))


def extraction_summary(page_text: DataFrame, facts: DataFrame) -> DataFrame:
    """Method, pages processed, number of fields and confidence per document."""
    counts = facts.groupBy("doc_id").agg(F.countDistinct("field").alias("n_fields"))
    n = F.coalesce("n_fields", F.lit(0).cast("bigint"))
    return scanned_docs(page_text).join(counts, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("scanned"), "vision_scanned").otherwise("text_tables").alias("method"),
        F.when(F.col("scanned"), F.least("n_pages", F.lit(SCANNED_BUDGET))).otherwise(F.col("n_pages")).alias("pages_processed"),
        n.alias("n_fields"),
        confidence_of(n).alias("confidence"),
    )
