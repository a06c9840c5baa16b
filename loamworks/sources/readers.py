"""Schemas, readers and writers: layouts, knowledge bases, uploads, JSON lines and the job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "struct<x0: double, y0: double, x1: double, y1: double>"
LINE = f"struct<text: string, bbox: {BBOX}, confidence: double>"
STYLE = "struct<font: string, size: double, bold: boolean>"
BLOCK = f"struct<role: string, text: string, bbox: {BBOX}, page: int, reading_order: int, confidence: double, style: {STYLE}, lines: array<{LINE}>>"
PAIR = "struct<label: string, value: string>"
TABLE = (
    f"struct<title: string, headers: array<string>, rows: array<array<string>>, page: int, kind: string, pairs: array<{PAIR}>, bbox: {BBOX}, "
    "n_cols: int, n_rows: int, source_pages: array<int>, continues_from: boolean, continues_to: boolean, confidence: double>"
)
FIGURE = f"struct<bbox: {BBOX}, page: int, caption: string, image_ref: string, confidence: double>"
PAGE = (
    "struct<page_number: int, page_label: string, width: double, height: double, rotation: int, source: string, is_scanned: boolean, "
    f"blocks: array<{BLOCK}>, tables: array<{TABLE}>, figures: array<{FIGURE}>>"
)
#: A parsed document. Fields that the input lacks are null and count as empty.
DOCUMENT = f"doc_id string, filename string, page_count int, toc array<struct<level: int, title: string, page: int>>, pages array<{PAGE}>"
PRECEDENT = "struct<anda_number: string, product_name: string, deficiency_text: string, similarity_score: double>"
#: A finding.
FINDING = (
    "doc_id string, ord long, title string, detail string, category string, severity string, tier string, evidence_class string, confidence double, evidence string, "
    f"section string, page int, table_ref string, source string, guidance_refs array<string>, precedents array<{PRECEDENT}>, novel boolean, out_of_distribution boolean, challenge_note string"
)


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents from JSON, one a file or one a line."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def explode_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_ord, page: the pages in order."""
    return docs.select("doc_id", F.posexplode("pages").alias("page_ord", "page"))


def blocks(docs: DataFrame) -> DataFrame:
    b = explode_pages(docs).select("doc_id", "page_ord", F.col("page.page_number").alias("page_number"), F.col("page.height").alias("page_height"), F.posexplode("page.blocks").alias("block_ord", "b"))
    return b.select("doc_id", "page_ord", "block_ord", "page_number", "page_height", "b.*")


def tables(docs: DataFrame) -> DataFrame:
    t = explode_pages(docs).select("doc_id", "page_ord", F.col("page.page_number").alias("page_number"), F.col("page.height").alias("page_height"), F.posexplode("page.tables").alias("table_ord", "t"))
    return t.select("doc_id", "page_ord", "table_ord", "page_number", "page_height", "t.*")


def grid_rows(docs: DataFrame) -> DataFrame:
    """The rows of all grids: doc_id, page_ord, table_ord, row_ord, page_number, title, headers, row."""
    t = tables(docs).where(F.coalesce("kind", F.lit("grid")) != "key_value")
    return t.select("doc_id", "page_ord", "table_ord", "page_number", "title", "headers", F.posexplode("rows").alias("row_ord", "row"))


def toc(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode("toc").alias("toc_ord", "e")).select("doc_id", "toc_ord", "e.level", "e.title", "e.page")


# Standard names of knowledge-base columns, in order of priority, each with the words that one of its spellings holds.
KB_COLUMNS = (
    ("anda_number", (("anda", "#"), ("anda", "number"))),
    ("product_name", (("product", "name"),)),
    ("dosage_form", (("dosage",),)),
    ("cmc_section", (("section", "cmc"),)),
    ("deficiency_type", (("deficiency", "type"),)),
    ("category", (("=category",), ("=category_of_deficiency",))),
    ("cohort_year", (("cohort",),)),
    ("deficiency_text", (("=deficiency",), ("deficiency", "text"), ("deficiency", "description"), ("deficiency", "detail"))),
    ("deficiency_response", (("deficiency", "response"),)),
    ("response_date", (("response", "date"),)),
)


def kb_name(column: str) -> str:
    """The standard name of a knowledge-base column, or the column's own in snake case."""
    low = column.lower()
    has = lambda word: low == word[1:] if word[0] == "=" else word in low
    return next((name for name, ways in KB_COLUMNS if any(all(map(has, way)) for way in ways)), low.strip().replace(" ", "_"))


def kb(df: DataFrame) -> DataFrame:
    """A knowledge base with standard column names, all strings, without rows that are wholly empty."""
    named = {c: kb_name(c) for c in df.columns}
    seen: set[str] = set()
    keep = [c for c in df.columns if not (named[c] in seen or seen.add(named[c]))]
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(named[c]) for c in keep])
    return out.where(F.coalesce(*[F.col(f"`{c}`") for c in out.columns]).isNotNull())


def embedding_text(product: Column, kind: Column, section: Column, said: Column) -> Column:
    """What is embedded of a record: its non-empty parts between bars."""
    return F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (product, kind, section, said)])


def zipped(names: Column, values: Column) -> Column:
    """A map of a row's values by the names at their places; null where their numbers differ."""
    return F.when(F.size(names) == F.size(values), F.map_from_arrays(names, values))


def qualified(name: str, catalog: str = "", schema: str = "") -> str:
    """A table's name with its catalog and schema, each quoted."""
    return ".".join(f"`{x.replace('`', '``')}`" for x in (catalog, schema, name) if x)


def replace_table(df: DataFrame, name: str) -> None:
    """Writes a table anew: its old rows and columns go."""
    df.write.mode("overwrite").saveAsTable(name)


def health(probes: dict) -> dict[str, str]:
    """`up`, or why not, for each named probe (a function without arguments), and `status`: ok if all are up, else degraded."""
    out = {}
    for name, probe in probes.items():
        try:
            probe()
            out[name] = "up"
        except Exception as e:  # noqa: BLE001 - a failing part is what is asked for
            out[name] = f"down: {type(e).__name__}"
    return out | {"status": "ok" if all(v == "up" for v in out.values()) else "degraded"}


def embeddings_from_json(df: DataFrame, key: str = "record_id", c: str = "embedding") -> DataFrame:
    return df.select(key, F.from_json(c, "array<float>").alias(c))


def uploads(spark: SparkSession, path: str, most: int = 50 << 20, least: int = 100) -> DataFrame:
    """Files with the status an upload of them gets: 200, 400 (no PDF, or too small) or 413 (too large). Contents are not read."""
    df = spark.read.format("binaryFile").load(path).select("path", "length")
    status = F.when(~F.lower("path").endswith(".pdf"), 400).when(F.col("length") > most, 413).when(F.col("length") < least, 400).otherwise(200)
    return df.withColumn("status", status)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def job_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
