"""Line dedup: exact set-similarity join of lines, in DataFrame functions only.

A line (text between newlines) is the set of its distinct words, runs of characters other than ASCII white space; words are
compared by 64-bit hashes. Lines are ordered by document id (null ids first), text hash and line number. A line goes if any
earlier line has a Jaccard similarity of ``PERCENT`` / 100 or more to it, whether or not that one goes itself; lines without
words stay as they are.

1. *Rarity.* Words are counted over all lines in ``BUCKETS`` hash buckets; the buckets' ranks, by the logarithm of their
   counts, are a table of fixed size, which goes into the plan as a literal. Words are ordered by rank, then by hash.
2. *Classes.* Equal sets (two 64-bit hashes of the ordered keys, which hold 56 bits of each word's hash; so sets that differ
   are taken for equal only if they are so in all other words) are one class, at the first position; later lines of a class go. A class keeps its size, the prefix of its ordered keys and a parity bitmap of 64 bits of all its keys.
3. *Prefix, length and positional filters.* Sets x and y, |x| >= |y|, that match share ceil(t/(1+t) (|x|+|y|)) words or
   more; so their rarest common word is among the first |x| - ceil(t|x|) + 1 of x and the first
   |y| - ceil(2t/(1+t) |y|) + 1 of y, |y| >= t|x|, and at their places enough words are left. The bitmaps bound the
   overlap from above: for each bit that they differ in there is a word that isn't shared.
4. *First round.* Each row of the shorter prefixes (y's) is held against the earliest class of its word only; so a group
   of any size costs as many pairs as it has rows. The rows of a frequent word are dealt over ``PARTS`` parts by id, each
   with an earliest class of its own, so no task gathers them. Classes that match an earlier one are settled: they go.
5. *Second round.* The longer prefixes are joined with the shorter ones of classes that aren't larger (of equal size: that
   are earlier), so each pair is met in one way; the later class of a pair must not be settled.
6. *Verification.* The whole lines of the pairs that are left are fetched from their texts and their sets compared.

Broadcast are tables of at most ``SMALL`` rows, which are counted first; larger ones are joined by a shuffle.

Defined results: a null text stays null, an empty one empty; an empty table gives an empty table. Repeated rows of one id and
text are one document for this, and get the same text; rows of one id and different texts are different documents, in the
order of their texts' hashes. Of equal lines the first in the order stays. ``\r`` belongs to no word but to its line. A
very long line is one row. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, discard, load, materialize, release

PERCENT = 80
BUCKETS = 1 << 18
#: Rows of a broadcast table at most: 64 bytes each or less.
SMALL = 1 << 18
PARTS = 16
#: The last rank: 45 times the mean count or more. Words of it are frequent.
TOP = 15
FREQUENT = TOP
#: From so many words on, the words of one half of all hashes have a parity bitmap of their own besides that of all words: one
#: of 64 bits can't tell lines that share a long passage from similar ones, as many of the words that differ meet in a bit.
WIDE = 48
#: A character of a word.
WORD = "[^\\x20\\x09-\\x0D]"
_LOW = (1 << 56) - 1


def _words(text: str | Column, spaced: str | Column | None = None) -> Column:
    """The words; ``spaced`` is the text with blanks for line ends. A text with no other white space is split at blanks,
    which takes no pattern."""
    other = F.lit(False)
    for c in "\t\r\x0b\x0c":
        other = other | F.contains(text, F.lit(c))
    return F.array_remove(F.when(other, F.split(text, SPACE_CLASS)).otherwise(F.split(text if spaced is None else spaced, " ")), "")


def _bucket(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - (BUCKETS.bit_length() - 1)).cast("int")


def rarity(docs: DataFrame) -> list[int]:
    """For each bucket its rank, 0 to 15, in half octaves from a quarter of the mean count on; 16 of them in each number."""
    words = docs.select(F.explode_outer(_words(F.col("text"), F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word")).where(F.col("word").isNotNull())
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).agg(F.count("*").alias("n"))
    # eight buckets in a row: 2 * log2 of each count, and the sum of their counts
    half_octaves = F.call_function("shiftleft", F.floor(2 * F.log2("n")).cast("long") + 1, (F.col("bucket") % 8 * 8).cast("int"))
    rows = counts.groupBy(F.floor(F.col("bucket") / 8).cast("int").alias("at")).agg(F.bit_or(half_octaves).alias("logs"), F.sum("n").alias("n")).collect()  # BUCKETS / 8 at most
    least = math.floor(2 * math.log2(max(1, sum(r.n for r in rows)) / BUCKETS)) - 3
    ranks = [0] * (BUCKETS // 16)
    for row in rows:
        for i, log in enumerate((row.logs & (1 << 64) - 1).to_bytes(8, "little")):
            ranks[row["at"] // 2] |= min(TOP, max(0, log - least)) << 4 * (row["at"] % 2 * 8 + i)
    return [r - (1 << 64) if r >> 63 else r for r in ranks]


def _hashes(line: str) -> Column:
    return F.array_distinct(F.transform(_words(F.col(line)), lambda word: F.xxhash64(word)))


def _documents(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, th, first`` of each document (id and text hash), and bits ``b``: the line ``pos`` of a document has the id
    ``first + pos``, which ascends with the document's id (null first), the text hash and the line's number, and
    ``first`` is a multiple of 2 ** b."""
    texts = docs.where(F.col("text").isNotNull())
    each = texts.groupBy("doc_id", F.xxhash64("text").alias("th")).agg(F.max(F.octet_length("text")).alias("n"))
    ordered = each.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    numbered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    most = numbered.agg(F.max(part).alias("part"), F.max(row).alias("row"), F.max("n").alias("n")).first()
    bits = [int(x or 0).bit_length() for x in most]  # a text has no more line ends than bytes
    if sum(bits) > 63:
        bits[2] = int(texts.agg(F.max(F.size(F.split("text", "\n")))).first()[0]).bit_length()
    if sum(bits) > 63:
        raise ValueError("more documents and lines than 63 bits can number")
    first = F.shiftleft(F.shiftleft(part, bits[1]).bitwiseOR(row), bits[2])
    return numbered.select("doc_id", "th", first.alias("first")), bits[2]


def classes_of(docs: DataFrame, ranks: list[int], percent: int = PERCENT) -> DataFrame:
    """``id, doc_id, th, pos, n, sig, bits, more`` of each class; ids ascend with the first positions."""
    table = F.split(F.lit(" ".join(map(str, ranks))), " ").cast("array<bigint>")
    order, _ = _documents(docs)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), "text")
    lines = texts.select("doc_id", "th", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(WORD))

    def key(h: Column) -> Column:
        sixteen = F.get(table, F.shiftrightunsigned(h, 68 - (BUCKETS.bit_length() - 1)).cast("int"))
        place = F.shiftrightunsigned(h, 62 - (BUCKETS.bit_length() - 1)).bitwiseAND(F.lit(60)).cast("int")
        rank = F.call_function("shiftright", sixteen, place).bitwiseAND(F.lit(TOP))
        return F.shiftleft(rank, 56).bitwiseOR(h.bitwiseAND(F.lit(_LOW)))

    keyed = lines.select(F.struct("doc_id", "th", "pos").alias("at"), F.sort_array(F.transform(_hashes("line"), key)).alias("keys"))
    n = F.size("keys")
    prefix = F.slice("keys", 1, n - F.floor((n * percent + 99) / 100).cast("int") + 1)

    def parity(one: Callable[[Column], Column]) -> Column:
        place = lambda k: F.shiftright(k, 20).bitwiseAND(F.lit(63)).cast("int")
        return F.aggregate("keys", F.lit(0).cast("long"), lambda found, k: found.bitwiseXOR(F.call_function("shiftleft", one(k), place(k))))

    every, half = parity(lambda k: F.lit(1).cast("long")), parity(lambda k: F.shiftright(k, 26).bitwiseAND(F.lit(1)))
    made = {"n": n, "sig": prefix, "bits": every, "more": F.when(n >= WIDE, half).otherwise(0)}
    rows = keyed.select("at", F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), *(c.alias(name) for name, c in made.items()))
    first = rows.groupBy("h1", "h2").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in made))
    placed = first.join(_small(order.withColumnsRenamed({"doc_id": "d", "th": "t"})), F.col("at.doc_id").eqNullSafe(F.col("d")) & (F.col("at.th") == F.col("t")))
    out = materialize(placed.select((F.col("first") + F.col("at.pos")).alias("id"), "at.doc_id", "at.th", "at.pos", *made), "classes")
    discard(order)
    return out


def _small(table: DataFrame) -> DataFrame:
    """``table`` to be broadcast, if it has so few rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def _least(percent: int) -> Column:
    """The length of the prefix that a class needs as the smaller one of a pair."""
    return F.floor(F.col("n") * (100 - percent) / (100 + percent)).cast("int") + 1


def _rows(classes: DataFrame, percent: int, short: bool) -> DataFrame:
    """``key, id, at, bits, more`` of the index: ``at`` holds, from the top, whether the class is open, its size and the key's place.

    ``short``: only of the shorter prefix, see ``_least``."""
    sig = F.slice("sig", 1, _least(percent)) if short else F.col("sig")
    opened = F.col("open").cast("long") if "open" in classes.columns else F.lit(1).cast("long")
    rows = classes.select("id", "n", "bits", "more", opened.alias("open"), F.posexplode_outer(sig).alias("rk", "key"))
    at = F.shiftleft("open", 62).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 31)).bitwiseOR(F.col("rk").cast("long"))
    return rows.select("key", "id", at.alias("at"), "bits", "more")


def _size(at: str) -> Column:
    return F.shiftright(at, 31).bitwiseAND(F.lit((1 << 31) - 1))


def _open(at: str) -> Column:
    return F.shiftright(at, 62) == 1


def _may_match(percent: int, x: str, y: str) -> Column:
    """x and y: prefixes of the columns of two rows of one key. Length, prefix, positional and bitmap filters."""
    (xn, xrk), (yn, yrk) = ((_size(f"{c}at"), F.col(f"{c}at").bitwiseAND(F.lit((1 << 31) - 1))) for c in (x, y))
    fits = (xn * 100 >= yn * percent) & (yn * 100 >= xn * percent)
    for left in (xn - xrk, yn - yrk):
        fits = fits & (left * (100 + percent) >= (xn + yn) * percent)
    alls, halves = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("bits", "more"))
    differ = F.when((xn >= WIDE) & (yn >= WIDE), F.bit_count(halves) + F.bit_count(alls.bitwiseXOR(halves))).otherwise(F.bit_count(alls))
    return fits & ((xn + yn) * (100 - percent) >= differ * (100 + percent))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``id`` of classes that match an earlier class, of the pairs ``early, late``."""
    ids = materialize(pairs.select(F.col("early").alias("id")).union(pairs.select("late")).distinct(), "ids")
    asked = classes.join(_small(ids), "id", "left_semi").select(F.col("doc_id").alias("asked_doc"), F.col("th").alias("asked_th"), "pos", "id")
    places = materialize(asked.groupBy("asked_doc", "asked_th").agg(F.collect_list(F.struct("pos", "id")).alias("asked")), "places")
    # the text is split below the join, once, so that each asked line is a look-up in the split text
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    met = texts.join(_small(places), F.col("doc_id").eqNullSafe(F.col("asked_doc")) & (F.col("th") == F.col("asked_th")))
    taken = met.select(F.explode_outer(F.transform("asked", lambda a: F.struct(a.id.alias("id"), F.get(F.col("lines"), a.pos).alias("line")))).alias("a"))
    found = materialize(taken.select("a.id", "a.line").groupBy("id").agg(F.first("line").alias("line")).select("id", _hashes("line").alias("hashes")), "lines")
    rows = pairs.join(found.select(F.col("id").alias("late"), F.col("hashes").alias("x")), "late").join(found.select(F.col("id").alias("early"), F.col("hashes").alias("y")), "early")
    shared = F.size(F.array_intersect("x", "y"))
    matched = rows.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent)
    out = materialize(matched.select(F.col("late").alias("id")).distinct(), "matched")
    discard(ids, places, found)
    return out


def _first_round(classes: DataFrame, percent: int) -> DataFrame:
    """``early, late``: each class with the earliest of each of its words, where they may match."""
    part = F.when(F.shiftright("key", 56) >= FREQUENT, F.col("id") % PARTS).otherwise(0)
    by_key = Window.partitionBy("key", part).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = _rows(classes, percent, True).withColumn("e", F.first(F.struct("id", "at", "bits", "more")).over(by_key)).where(F.col("id") > F.col("e.id"))
    held = held.select(F.col("id").alias("late"), F.col("e.id").alias("early"), *(F.col(c).alias(f"x{c}") for c in ("at", "bits", "more")), *(F.col(f"e.{c}").alias(f"y{c}") for c in ("at", "bits", "more")))
    return materialize(held.where(_may_match(percent, "x", "y")).select("early", "late").distinct(), "pairs")


def _flagged(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """The classes and whether they are ``open``."""
    return classes.join(_small(settled.withColumn("done", F.lit(True))), "id", "left").withColumn("open", F.col("done").isNull()).drop("done")


def _second_round(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``early, late``: each open class with all earlier ones of its words that it may match, but for ``pairs``."""
    x, y = (_rows(classes, percent, short).select("key", *(F.col(c).alias(f"{s}{c}") for c in ("id", "at", "bits", "more"))) for s, short in (("x", False), ("y", True)))
    xn, yn, later = _size("xat"), _size("yat"), F.col("xid") > F.col("yid")
    once = (xn > yn) | ((xn == yn) & later)
    met = x.join(y, "key").where(once & _may_match(percent, "x", "y") & F.when(later, _open("xat")).otherwise(_open("yat")))
    more = met.select(F.least("xid", "yid").alias("early"), F.greatest("xid", "yid").alias("late")).distinct()
    return materialize(more.join(pairs, ["early", "late"], "left_anti"), "pairs")


def kept_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, th, kept``: the numbers (from 0) of the lines with words that stay, by document (id and text hash).

    Each step is a function, so that its plans are gone, and their shuffle files can go, when the next one begins.
    """
    spark = docs.sparkSession
    classes = classes_of(docs, rarity(docs), percent)
    release(spark)
    pairs = _first_round(classes, percent)
    release(spark)
    settled = _verified(docs, classes, pairs, percent)
    more = _second_round(_flagged(classes, settled), pairs, percent)
    release(spark)
    gone = settled if more.isEmpty() else settled.union(_verified(docs, classes, more, percent))
    stays = classes.join(_small(gone), "id", "left_anti").select("doc_id", "th", "pos")
    return stays.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("kept"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are but ``text`` without the lines that go."""
    kept = kept_lines(docs.select("doc_id", "text"), percent).select(F.col("doc_id").alias("id"), "th", "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("th")), "left")
    rows = rows.select("row", "kept", F.split("row.text", "\n").alias("lines"))  # used twice, so it's made once
    wordless = F.filter(F.transform("lines", lambda line, i: F.when(~line.rlike(WORD), i)), lambda i: i.isNotNull())
    numbers = F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), wordless))
    text = F.array_join(F.transform(numbers, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.size("kept") == F.size("lines"), F.col("row.text")).otherwise(text)
    return rows.select(*(F.when(F.col("row.text").isNotNull(), text).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``text`` without the lines that go, ``n_lines`` (before)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    return dedup_lines(docs)
