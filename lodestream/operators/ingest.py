"""Pages to lines to chunks: printed documents of one or more files, and the summary of what was read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import chunking, cleanup, index, legal


def numbered_pages(pages: DataFrame) -> DataFrame:
    """Pages ``doc_id, file, page, ...`` with ``page`` counted on over the document's files, in order of their names."""
    counts = pages.groupBy("doc_id", "file").agg(F.max("page").alias("pages"))
    offsets = cleanup.continue_pages(counts).select(F.col("doc_id").alias("_doc"), F.col("file").alias("_file"), "page_offset")
    rows = pages.join(offsets, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("file") == F.col("_file")))
    return rows.select(*(F.col(c) if c != "page" else (F.col("page") + F.col("page_offset")).cast("int").alias("page") for c in pages.columns))


def recognised_pages(pages: DataFrame, ocr: Callable[[], Callable[[dict], str]] | None = None) -> DataFrame:
    """Pages (doc_id, file, page, text, has_images) with ``lines``, cleaned, and ``needs_ocr``.

    A page with images and hardly any text needs recognition; ``ocr`` makes an engine on the executor, which is given the
    page's row and returns its text. Without an engine the page stays flagged.
    """
    rows = pages.withColumn("lines", F.coalesce(X.page_lines("text"), F.array().cast("array<string>")))
    rows = rows.withColumn("needs_ocr", cleanup.needs_ocr(F.col("lines"), F.coalesce("has_images", F.lit(False))))
    if ocr is None:
        return rows
    kept = [c for c in pages.columns if c != "text"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = ocr()
        for frame in frames:
            yield frame.assign(text=[engine(r) for r in frame.to_dict("records")])

    found = rows.where("needs_ocr").select(*pages.columns).mapInPandas(read, pages.schema)
    found = found.withColumn("lines", X.page_lines("text")).withColumn("needs_ocr", F.lit(False))
    return rows.where("NOT needs_ocr").select(*kept, "text", "lines", "needs_ocr").unionByName(found)


def printed_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, pos, text, page`` of recognised pages: no furniture, broken words joined over the whole document, pages
    counted on over its files. Recurring edge lines are looked for in each file."""
    rows = pages.select("doc_id", "file", "page", "lines", F.array_join("lines", "\n").alias("text"), F.concat_ws("\x00", F.col("doc_id").cast("string"), "file").alias("_file"))
    keys = index.running_lines(rows, "_file", "page", "text").groupBy(F.col("doc").alias("_file")).agg(F.collect_list("line_key").alias("running"))
    rows = numbered_pages(rows.join(keys, "_file", "left").select("doc_id", "file", "page", cleanup.strip_furniture(F.col("lines"), F.col("running")).alias("lines")))
    lines = rows.select("doc_id", "page", F.posexplode("lines").alias("at", "text"))
    lines = lines.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at")))
    joined = cleanup.dehyphenate(lines.select("doc_id", "pos", "text", "page"))
    return joined.where(F.trim("text") != "")


def markdown_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, pos, text, page`` of pages with ``markdown``: no inline marks, no recognition."""
    rows = numbered_pages(pages.select("doc_id", "file", "page", X.page_lines(X.strip_markdown_inline("markdown")).alias("lines")))
    lines = rows.select("doc_id", "page", F.posexplode("lines").alias("at", "text"))
    return lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at")).alias("pos"), "text", "page")


def document_lines(pages: DataFrame) -> DataFrame:
    """Lines of printed documents: legal ones line by line, others from their Markdown where they have it."""
    plain = printed_lines(pages)
    counts = legal.article_counts(legal.legal_paragraphs(plain))
    is_legal = counts.where(F.col("articles") >= legal.MIN_ARTICLES).select("doc_id")
    marked = pages.where(F.col("markdown").isNotNull()).select("doc_id").distinct().join(is_legal, "doc_id", "left_anti")
    return plain.join(marked, "doc_id", "left_anti").unionByName(markdown_lines(pages.join(marked, "doc_id", "left_semi")))


def languages(lines: DataFrame) -> DataFrame:
    """``doc_id, language`` from each document's first blocks."""
    first = lines.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("_at") <= X.LANGUAGE_BLOCKS)
    blocks = first.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("b"))
    return blocks.select("doc_id", X.detect_language(X.language_sample("b")).alias("language"))


def chunked(lines: DataFrame, manifest: DataFrame | None = None, max_tokens: int = chunking.MAX_TOKENS, overlap: float = chunking.OVERLAP) -> DataFrame:
    """Chunks of ``doc_id, pos, text, page`` lines with their language and, from a manifest (doc_id, title, so_hieu, kind,
    status, amended_by, amended_articles), their metadata and whether their article was amended."""
    chunks = legal.chunk_documents(lines, None, max_tokens, overlap).join(languages(lines), "doc_id", "left")
    if manifest is None:
        return chunks
    known = manifest.select("doc_id", *(F.col(c) for c in ("title", "so_hieu", "kind", "status", "amended_by")))
    return legal_amended(chunks, manifest).join(known, "doc_id", "left")


def legal_amended(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    from lodestream.operators import gold

    return gold.mark_amended(chunks, manifest)


def ingest_summary(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``doc_id, structure, articles, chunks, mean_tokens, max_tokens`` and, with recognised pages, ``pages, ocr_pages``."""
    found = chunks.groupBy("doc_id", "structure").agg(F.count_distinct("article").alias("articles"), F.count("*").alias("chunks"), F.round(F.avg("token_count"), 4).alias("mean_tokens"), F.max("token_count").alias("max_tokens"))
    if pages is None:
        return found
    return found.join(pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("needs_ocr").alias("ocr_pages")), "doc_id", "full")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder of JSON lines for each document."""
    chunks.write.mode("overwrite").partitionBy("doc_id").json(path)
