"""Page lines of printed documents: furniture out, words broken at line ends joined, pages numbered on over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------
GAZETTE_HEADER = r"^CÔNG BÁO/Số [0-9 +]+/Ngày [0-9]{1,2}-[0-9]{1,2}-[0-9]{4}(?: [0-9]+)?$"
CONTINUED_FROM = r"^\(Tiếp theo Công báo số [0-9 +]+\)$"
CONTINUED_IN = r"^\(Xem tiếp Công báo số [0-9 +]+\)$"
SIGNATURE_START, SIGNATURE_REST = r"^(Ký bởi|Người ký): ", r"^(Email|Cơ quan|Thời gian ký|Ngày ký): "
#: A signer's name that goes on in a second line: at most this long, with no colon.
NAME_WRAP = 30
EDGE_LINES, FEWEST_CHARS, HYPHENATED_SHARE = 3, 50, 0.01
# --------------------------------------------------------------------------------------------------------------


def edge_key(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), "[0-9]+", "#")


def strip_furniture(lines: Column, running: Column, edge: int = EDGE_LINES) -> Column:
    """A page's lines without what stands up to a continuation mark, headers, signature blocks and running edge lines.

    ``running``: the edge keys of the document that recur (null: none). A signature block is a start line, short lines
    with no colon after it, then known fields. Each line is one letter of a string, in which patterns find the blocks.
    """
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(CONTINUED_FROM), i + 1)), lambda i: i.isNotNull())
    rest = F.when(F.size(marks) > 0, F.slice(lines, F.try_element_at(marks, F.lit(1)) + 1, F.size(lines))).otherwise(lines)

    def letter(x: Column) -> Column:
        short = ~F.contains(x, F.lit(":")) & (F.length(F.trim(x)) <= NAME_WRAP)
        return F.when(x.rlike(SIGNATURE_START), "S").when(x.rlike(SIGNATURE_REST), "R").when(short, "W").otherwise("O")

    letters = F.array_join(F.transform(rest, letter), "")
    names = F.regexp_replace(letters, r"S|(?!^)\GW", "D")
    found = F.regexp_replace(names, r"D|(?!^)\GR", "D")

    def stays(x: Column, i: Column) -> Column:
        at_edge = (i < edge) | (i >= F.size(rest) - edge)
        recurs = F.coalesce(F.array_contains(running, edge_key(x)), F.lit(False))
        return (F.substring(found, i + 1, F.lit(1)) != "D") & ~x.rlike(GAZETTE_HEADER) & ~x.rlike(CONTINUED_IN) & ~(at_edge & recurs)

    return F.filter(rest, stays)


def needs_ocr(lines: Column, has_images: Column) -> Column:
    return (F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) < FEWEST_CHARS) & has_images


def continue_pages(files: DataFrame, doc: str = "doc_id", order: str = "file", count: str = "pages") -> DataFrame:
    """Adds ``page_offset``: the pages of the document's files before each."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("page_offset", F.coalesce(F.sum(count).over(before), F.lit(0)))


def dehyphenate(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """The lines with words joined that a line end broke; columns as they are. A line may end up empty.

    A line that ends in letters and a hyphen takes the first word of the next one, if that begins in lower case. The
    hyphen stays if the document has the word with it more often than without; if as often, unless more than
    HYPHENATED_SHARE of the document's lines are broken. Only words of broken lines are counted, by one join.

    A line that is nothing but ``word-`` and gives its word to the line before has none left to join: of such lines in a
    row, every second one takes part.
    """
    order, whole = Window.partitionBy(doc).orderBy(pos), Window.partitionBy(doc)
    rows = lines.withColumn("_next", F.lead(text).over(order)).withColumn("_at", F.row_number().over(order))
    broken = F.coalesce(F.col(text).rlike(r"\p{L}-$") & F.col("_next").rlike(r"^\p{Ll}"), F.lit(False))
    rows = rows.withColumn("_broken", broken).withColumn("_after", F.coalesce(F.lag("_broken").over(order), F.lit(False)))
    rows = rows.withColumn("_bare", F.col("_broken") & F.col("_after") & F.col(text).rlike(r"^\p{L}+-$"))
    last = F.max(F.when(~F.col("_bare"), F.col("_at"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_takes", F.col("_broken") & ((F.col("_at") - last) % 2 == 0))
    rows = rows.withColumn("_share", F.avg(F.col("_broken").cast("int")).over(whole))
    left, right = F.regexp_extract(text, r"(\p{L}+)-$", 1), F.regexp_extract("_next", r"^(\p{L}+)", 1)
    rows = rows.withColumn("_right", right).withColumn("_plain", F.lower(F.concat(left, right))).withColumn("_dashed", F.lower(F.concat(left, F.lit("-"), right)))

    asked = rows.where("_takes").select(F.col(doc).alias("_doc"), F.explode(F.array("_plain", "_dashed")).alias("_word")).distinct()
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0)))
    counts = lines.select(F.col(doc).alias("_doc"), words.alias("_word")).join(asked, ["_doc", "_word"], "left_semi").groupBy("_doc", "_word").agg(F.count("*").alias("_n"))
    for name in ("_plain", "_dashed"):
        found = counts.select("_doc", F.col("_word").alias(name), F.col("_n").alias(f"{name}_n")).withColumnRenamed("_doc", f"{name}_doc")
        rows = rows.join(found.withColumnRenamed(name, f"{name}_w"), (F.col(doc) == F.col(f"{name}_doc")) & (F.col(name) == F.col(f"{name}_w")), "left")
    plain, dashed = (F.coalesce(F.col(f"{x}_n"), F.lit(0)) for x in ("_plain", "_dashed"))
    stays = (dashed > plain) | ((dashed == plain) & (F.col("_share") <= HYPHENATED_SHARE))

    gave = F.coalesce(F.lag("_takes").over(order), F.lit(False))
    own = F.when(gave, F.ltrim(F.regexp_replace(text, r"^\p{L}+", ""))).otherwise(F.col(text))
    joined = F.when(F.col("_takes"), F.concat(F.regexp_replace(own, "-$", ""), F.when(stays, "-").otherwise(""), F.col("_right"))).otherwise(own)
    return rows.withColumn("_text", joined).select(*(F.col("_text").alias(text) if c == text else F.col(c) for c in lines.columns))
