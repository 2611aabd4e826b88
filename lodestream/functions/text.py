"""Text functions: Column to Column, within the JVM but for Unicode normal forms, which are made in Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values -------------------------------------------------------------------------------------------------
#: Letters that mark Vietnamese, and the share of letters above which a text is Vietnamese.
VIETNAMESE = "ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
VIETNAMESE_SHARE, LANGUAGE_SAMPLE = 0.05, 20_000
#: Refusals that an abstaining answer begins with.
ABSTENTIONS = ("không tìm thấy trong tài liệu", "not found in the documents")
#: A range in a citation longer than this counts with its two ends only.
LONGEST_RANGE = 10
#: Tags within a line of converted Markdown.
INLINE_TAGS = ("mark", "sub", "sup", "u", "b", "i", "em", "strong", "span")
#: What a line that begins a block begins with: heading, table row, bullet, numbered or lettered item.
BLOCK_START = r"^(#{1,6}\s|\||[-•*+]\s|[“\"]?\(?([0-9]+|[a-zđ])[.)]\s)"
LANGUAGE_BLOCKS = 500
# --------------------------------------------------------------------------------------------------------------

_NUMBER = r"[0-9]+(?:[.,][0-9]+)+"
_WORD = r"[\p{L}\p{N}_]+"
_BREAK = r"[.,;:!?()\[\]{}“”\"…\n]"


#: White space of all kinds: the JVM's own class has ASCII only.
_SPACE = r"[\p{Z}\s\x1C-\x1F\x85]"


def _normalised(texts: pa.Array, form: str) -> pa.Array:
    """Python's own normal forms: Arrow's function gave wrong texts for long strings. Most texts are in the form already."""
    values = texts.to_pylist()
    if all(x is None or x.isascii() or unicodedata.is_normalized(form, x) for x in values):
        return texts
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize(form, x) for x in values], texts.type)


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return _normalised(texts, "NFC")


@F.arrow_udf(StringType())
def _compatible(texts: pa.Array) -> pa.Array:
    return _normalised(texts, "NFKC")


def nfc(text: Column | str) -> Column:
    return _composed(_col(text))


def nfkc(text: Column | str) -> Column:
    return _compatible(_col(text))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _parts(text: Column | str) -> Column:
    """Lower-cased words and break characters in one pass, so that neighbours in the array are neighbours in the text."""
    return _all(F.lower(nfc(text)), f"{_NUMBER}|{_WORD}|{_BREAK}")


def _is_word(part: Column) -> Column:
    return part.rlike(r"^[\p{L}\p{N}_]")


def unigrams(text: Column | str) -> Column:
    """Lower-cased words; a number with inner separators is one word."""
    return _all(F.lower(nfc(text)), f"{_NUMBER}|{_WORD}")


def bigrams(text: Column | str) -> Column:
    """Neighbouring words with no break character between them."""
    return _pairs(_parts(text))


def _pairs(parts: Column) -> Column:
    last = F.greatest(F.size(parts) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(parts, 1, last), F.slice(parts, 2, last), lambda a, b: F.when(_is_word(a) & _is_word(b), F.concat_ws(" ", a, b)))
    return F.filter(pairs, lambda p: p.isNotNull())


def terms(text: Column | str) -> Column:
    return F.concat(unigrams(text), bigrams(text))


def tokenised(rows: DataFrame, text: str, *keep: str | Column) -> DataFrame:
    """``keep, words, pairs`` of each row: its words and its bigrams, from one pass over the text.

    The pass is a column of its own that is used more than once, so the optimiser doesn't inline it."""
    parted = rows.select(*keep, _parts(text).alias("_parts"))
    kept = [c for c in parted.columns if c != "_parts"]
    return parted.select(*kept, F.filter("_parts", _is_word).alias("words"), _pairs(F.col("_parts")).alias("pairs"))


def token_count(text: Column | str) -> Column:
    """Tokens as words and single punctuation characters: a countable stand-in for a model's tokenizer."""
    return F.size(_all(_col(text), r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def truncate_tokens(text: Column | str, most: int) -> Column:
    """The text's first ``most`` white-space words and an ellipsis, if it has more."""
    words = F.split(F.regexp_replace(_col(text), rf"^{_SPACE}+|{_SPACE}+$", ""), rf"{_SPACE}+")
    return F.when(F.size(words) <= most, _col(text)).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(" …")))


def clean_text(text: Column | str) -> Column:
    """Composed; line ends to ``\\n``, control characters out, runs of blanks of any kind to one, no blanks around lines and no
    blank lines."""
    c = F.regexp_replace(nfc(text), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", "")
    c = F.regexp_replace(c, r"[\p{Z}\t]*\n[\p{Z}\t\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"[\p{Z}\t]+", " "), r"^[ \n]+|[ \n]+$", "")


def expand_ligatures(text: Column | str) -> Column:
    pairs = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, _col(text))


def fix_replacement_chars(text: Column | str) -> Column:
    """U+FFFD: a dash between blanks, an apostrophe within a word, nothing elsewhere."""
    c = F.regexp_replace(_col(text), f"(?<={_SPACE})\ufffd(?={_SPACE})", "–")
    c = F.regexp_replace(c, "(?<=[\\p{L}\\p{N}_])\ufffd(?=[\\p{L}\\p{N}_])", "’")
    return F.replace(c, F.lit("\ufffd"), F.lit(""))


def strip_markdown_inline(text: Column | str) -> Column:
    """No raised notes, inline tags, emphasis marks and quote marks; headings, bullets and tables stay.

    Doubled marks go wherever they are, single ones only in pairs that enclose text and don't touch words outside, so
    ``snake_case`` and a lone asterisk stay."""
    quoted = F.regexp_replace(_col(text), r"(?m)^>[ \t]?", "")
    tags = rf"<sup>[^\n]*?</sup>|<(?:/\s*)?(?:{'|'.join(INLINE_TAGS)})(?:\s[^>]*)?/?>"
    plain = F.regexp_replace(F.regexp_replace(quoted, tags, ""), r"([*_])\1", "")
    outside = r"[\p{L}\p{N}_*]"
    return F.regexp_replace(plain, rf"(?<!{outside})([*_])((?:(?!\1)[^\n])+)\1(?!{outside})", "$2")


def page_lines(text: Column | str) -> Column:
    """Cleaned, non-blank lines of a page."""
    c = fix_replacement_chars(expand_ligatures(clean_text(text)))
    return F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) > 0)


def normalize_for_match(text: Column | str) -> Column:
    """In compatible composed form, without soft hyphens, white space collapsed."""
    return collapse(F.replace(nfkc(text), F.lit("\u00ad"), F.lit("")))


def collapse(text: Column | str) -> Column:
    """Runs of white space of any kind to one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), rf"{_SPACE}+", " "))


def language_sample(blocks: Column | str) -> Column:
    """The first ``LANGUAGE_BLOCKS`` of an array of blocks, a line each."""
    return F.array_join(F.slice(_col(blocks), 1, LANGUAGE_BLOCKS), "\n")


def detect_language(text: Column | str, letters: str = VIETNAMESE, share: float = VIETNAMESE_SHARE, yes: str = "vi", no: str = "en") -> Column:
    sample = F.lower(F.substring(_col(text), 1, LANGUAGE_SAMPLE))
    every = F.length(F.regexp_replace(sample, r"[^\p{L}]", ""))
    marked = F.length(F.regexp_replace(sample, f"[^{letters}]", ""))
    return F.when((every > 0) & (marked / F.greatest(every, F.lit(1)) > share), yes).otherwise(no)


def content_hash(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def point_id(user: Column | str, doc: Column | str, hashed: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", _col(user), _col(doc), _col(hashed)), 256)


def starts_block(line: Column | str) -> Column:
    return _col(line).rlike(BLOCK_START)


def embedding_text(title: Column, number: Column, path: Column, text: Column) -> Column:
    """One line of title (number) and heading path, then the text."""
    head = F.concat_ws(" | ", F.concat(title, F.when(number.isNotNull(), F.concat(F.lit(" ("), number, F.lit(")"))).otherwise("")), F.when(F.length(path) > 0, path))
    return F.when(F.length(head) > 0, F.concat_ws("\n", head, text)).otherwise(text)


# Citations, labels, prompts -----------------------------------------------------------------------------------

_GROUP = r"\[[0-9]+(?:\s*[,;\-–]\s*[0-9]+)*(?:\s*[,;:]\s*[^\]0-9\s][^\]]*)?\]"


def parse_citations(text: Column | str) -> Column:
    """Cited numbers in order, each once. ``[1, 3]`` and ``[1-3]`` count; of a long or chained range, the ends."""
    groups = _all(_col(text), _GROUP)
    parts = F.flatten(F.transform(groups, lambda g: _all(F.regexp_replace(g, r"[,;:]\s*[^\]0-9\s][^\]]*\]", "]"), r"[0-9]+(?:\s*[-–]\s*[0-9]+)*")))

    def numbers(part: Column) -> Column:
        ends = F.transform(_all(part, r"[0-9]+"), lambda x: x.try_cast("int"))
        lo, hi = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when((F.size(ends) == 2) & (hi >= lo) & (hi - lo <= LONGEST_RANGE), F.sequence(lo, F.greatest(lo, F.least(hi, lo + LONGEST_RANGE)))).otherwise(F.array_distinct(F.array(lo, hi)))

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def malformed_citations(text: Column | str) -> Column:
    """Citation groups with text after their numbers, and chained ranges."""
    return F.filter(_all(_col(text), _GROUP), lambda g: g.rlike(r"[,;:]\s*[^\]0-9\s]") | g.rlike(r"[0-9]\s*[-–]\s*[0-9]+\s*[-–]"))


def strip_citations(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\s*" + _GROUP, "")


def is_abstention(text: Column | str) -> Column:
    """The answer, in any case and with any marks before it, begins with a refusal."""
    c = F.lower(F.regexp_replace(collapse(nfc(text)), r"^[ *_#>\"']+", ""))
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(x)) for x in ABSTENTIONS])


def page_range(page: Column, page_end: Column) -> Column:
    """One page, or the first and the last; null without a page."""
    return F.when(page.isNull() | page_end.isNull() | (page_end == page), page.cast("string")).otherwise(F.concat_ws("–", page, page_end))


def section_label(path: Column | str) -> Column:
    """The heading path without what stands above the article."""
    parts = F.split(_col(path), " > ")
    at = F.array_position(F.transform(parts, lambda x: x.rlike(r"(?i)^(Điều|Article)\s+[0-9]+")), True)
    return F.array_join(F.when(at > 0, F.slice(parts, F.greatest(at.cast("int"), F.lit(1)), F.size(parts))).otherwise(parts), " > ")


def citation_label(number: Column, title: Column, doc_id: Column, section: Column, pages: Column, vi: bool = False) -> Column:
    blank = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws(", ", F.coalesce(blank(number), blank(title), doc_id), blank(section), F.concat(F.lit("trang " if vi else "page "), pages))


def escape_html(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), c)


def format_document(index: Column, title: Column, text: Column, **attributes: Column) -> Column:
    """A numbered document block with its title and further attributes (those that are null or empty are left out);
    document tags in the text are made harmless."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<(/?)(documents?)\b", "‹$1$2")
    named = {"index": index.cast("string"), "title": title, **attributes}
    head = F.concat_ws(" ", *[F.when(F.length(c) > 0, F.concat(F.lit(f'{name}="'), escape_html(c), F.lit('"'))) for name, c in named.items()])
    return F.concat(F.lit("<document "), head, F.lit(">\n"), safe, F.lit("\n</document>"))
