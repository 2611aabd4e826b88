"""N-gram Jaccard join: token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct shingles (three lower-cased words; fewer words: the sequence).
Documents with equal sets are one class; classes are joined.

*Order.* Shingles are ordered by rarity: by the count of their bucket among ``BUCKETS`` hash buckets, counted over all
documents, then by hash. Buckets well above the mean make the class of frequent shingles, all others that of rare ones.

*Prefixes.* At a threshold t, sets x and y that link share at least ceil(t * |x|) shingles, so at most
miss = |x| - ceil(t * |x|) of x are not in y. A prefix of x that has r rare shingles is enough if r > miss: then one of
them is in y, and as the order is the same for both, in y's prefix as well. If x hasn't so many rare ones, the prefix is
extended by frequent shingles, dealt by hash over c sub-classes: losing miss shingles can't leave every sub-class with
fewer than two unless the sum of (size - 1) over sub-classes, plus r, is at most miss. So the prefix grows until that
sum passes miss, and pairs of shingles within a sub-class are indexed instead of single ones. c grows with the size of
the set (it is a power of two by size level; a set is indexed at the levels of all sizes that its smaller partner may
have), which keeps the number of pairs in proportion to the set.

*Candidates.* Index keys that only one class has are dropped by an aggregation. Each other class of a key is paired with
the key's hub (the class with the fewest keys that nobody else has), verified, and components are found. Only keys whose classes are then still in different
components are joined with themselves, across components alone. So a large group of near copies costs as many pairs as it
has members, and no link between different components is missed.

*Uniqueness bound.* A single key that only one class has is a shingle that no set whose prefix ends later has. A pair goes
if both sets have more such keys than the shingles they may lack; this is tested within the joins that make the pairs.

*Verification.* Pairs whose prefixes already differ too much go first (an exact bound, see ``_plausible``). Then exact: set sizes and intersections of the whole sets.

Defined results: null, empty and wordless texts have 0 shingles and are their own component. Null doc_ids are never the
smallest if there is another id. Rows with equal ids are joined by their texts like any others; only the id and text
columns are read, so others, whatever their names, play no part (:func:`one_of_each` passes them on). A Jaccard index
equal to the threshold links (ties). A very long text is hashed alone, and one task holds its set. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import Hasher
from .linear import mixed
from .shared import count_array, discard, load, materialize, release, sliced, utf8

WORDS = 3
PERCENT = 90
BUCKETS = 1 << 20
#: A shingle is frequent if its bucket has so many more than the mean, and ten standard deviations.
FREQUENT = 64
#: Sub-classes of frequent shingles for sets of size s: 2 ** floor(log2 s) / SUBCLASS, 1 at least.
SUBCLASS = 32
#: Bytes of texts that are hashed at once.
_CHUNK = 1 << 18


def shingles(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, given those of its words; of fewer words, one of them all."""
    if not len(h):
        return h
    k = min(words, len(h))
    return mixed(*(h[i : len(h) - k + 1 + i] for i in range(k)), salt=k)


def word_runs(texts: list[bytes | None], hasher: Hasher) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, in order. About ``_CHUNK`` bytes are hashed at once, a longer text alone."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size + len(texts[at] or b"") <= _CHUNK):
            parts.append((texts[at] or b"").lower())
            size += len(parts[-1]) + 1
            at += 1
        starts, h = hasher(b"\n".join(parts))
        yield from np.split(h, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in parts[:-1]])))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def rarity(texts: DataFrame, words: int = WORDS) -> tuple[np.ndarray, int]:
    """For each bucket, four times the binary logarithm of its count; from which value on a shingle is frequent."""

    def counter():
        hasher = Hasher()

        def add(batch: pa.RecordBatch, counts: np.ndarray) -> None:
            for part in sliced(iter([batch])):
                found = [shingles(h, words) for h in word_runs(utf8(part.column(0)), hasher)]
                np.add.at(counts, _bucket(np.concatenate(found)), 1)

        return add

    counts = count_array(texts.where(F.col("text").isNotNull()).select("text"), counter, BUCKETS)
    mean = counts.mean()
    limit = mean + max(FREQUENT, 10 * math.sqrt(mean))
    logs = np.minimum(255, 4 * np.log2(counts + 1.0)).astype(np.uint8)
    return logs, int(4 * math.log2(limit + 1)) + 1


def least_shared(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def signature(found: np.ndarray, logs: np.ndarray, frequent: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """Index keys of a set given as its sorted distinct hashes, single shingles first, and the number of these."""
    n = len(found)
    rank = logs[_bucket(found)]
    ordered = found[np.lexsort((found, rank))]
    rare = int((rank < frequent).sum())
    need = n - least_shared(n, percent) + 1
    singles = ordered[: min(rare, need)]
    if rare >= need:
        return singles, need
    rest, out = ordered[rare:], [np.zeros(0, np.uint64)]
    for level in {size.bit_length() - 1 for size in (least_shared(n, percent), n)}:
        classes = max(1, (1 << level) // SUBCLASS)
        sub = (rest % np.uint64(classes)).astype(np.int64)
        first = np.zeros(len(rest), bool)
        first[np.unique(sub, return_index=True)[1]] = True
        enough = np.nonzero(np.cumsum(~first) >= need - rare)[0]
        end = int(enough[0]) + 1 if len(enough) else len(rest)
        for c in np.unique(sub[:end]).tolist():
            own = np.sort(rest[:end][sub[:end] == c])
            if len(own) > 1:
                a, b = np.triu_indices(len(own), 1)
                out.append(mixed(own[a], own[b], salt=1000 + level))
    return np.concatenate([singles, np.unique(np.concatenate(out))]), rare


def _print(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signed(texts: DataFrame, logs: np.ndarray, frequent: int, words: int, percent: int) -> DataFrame:
    """``doc_id, n, print, keys, singles`` of each row; ``print`` is null for an empty set."""
    sent = texts.sparkSession.sparkContext.broadcast(logs)  # BUCKETS bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), sent.value
        for batch in sliced(batches):
            sizes, prints, keys, singles = [], [], [], []
            for h in word_runs(utf8(batch.column(1)), hasher):
                found = np.unique(shingles(h, words))
                sizes.append(len(found))
                prints.append(_print(found) if len(found) else None)
                made, single = signature(found, table, frequent, percent) if len(found) else (found, 0)
                keys.append(made.view(np.int64))
                singles.append(single)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(singles, pa.int64())], names=["doc_id", "n", "print", "keys", "singles"])

    return texts.mapInArrow(sign, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n long, print binary, keys array<long>, singles long")


def _sets(texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``node, found`` (the whole set) of the given classes ``node, doc_id, print``, from their documents' texts.

    A bitmap of fixed size passes over most documents that aren't asked for before they are split into words; the join
    on ``print`` decides.
    """
    places = 1 << 20

    def counter():
        def add(batch: pa.RecordBatch, counts: np.ndarray) -> None:
            np.add.at(counts, batch.column(0).to_numpy() & (places - 1), 1)

        return add

    wanted = count_array(classes.select(F.xxhash64("doc_id").alias("at")), counter, places) > 0
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), sent.value
        for batch in sliced(batches):
            batch = batch.filter(pa.array(table[batch.column(0).to_numpy() & (places - 1)]))
            found = [np.unique(shingles(h, words)) for h in word_runs(utf8(batch.column(1)), hasher)]
            yield pa.RecordBatch.from_arrays([pa.array([_print(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["print", "found"])

    made = texts.select(F.xxhash64("doc_id").alias("at"), "text").mapInArrow(make, "print binary, found array<long>")
    return made.join(classes.select("node", "print"), "print").groupBy("node").agg(F.first("found").alias("found"))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs ``a, b`` that can't link as their prefixes share too little.

    Of the prefix that ends earlier, every shingle that isn't in the other prefix isn't in the other set at all, so there
    are no more of them than the set's size less the overlap that the pair needs. Which one ends earlier isn't known
    here, so a pair goes if this fails for both. Sets with pairs of shingles in their prefixes are passed on.
    """
    sides = [classes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.when(F.col("singles") == F.size("keys"), F.col("keys")).alias(f"p{k}")) for k in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b")
    both = F.size(F.array_intersect("pa", "pb"))
    needed = _needed("na", "nb", percent)
    fits = (F.size("pa") - both <= F.col("na") - needed) | (F.size("pb") - both <= F.col("nb") - needed)
    return rows.where(F.col("pa").isNull() | F.col("pb").isNull() | fits).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = materialize(classes.join(nodes, "node", "left_semi").select("node", "doc_id", "print"), "asked")
    sets = materialize(_sets(texts, asked, words), "sets")
    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    found = materialize(rows.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b"), "verified")
    discard(asked, sets)
    return found


def _needed(n: str, m: str, percent: int):
    """Column: how many shingles sets of these sizes share at least if they link."""
    return F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")


def _may_link(percent: int):
    """Columns n, u, plain and m, v, smooth of two sets: their sizes, how many single keys of each nobody else has, and
    whether single keys are all that each has.

    Of the prefix that ends earlier, a key that no other prefix has is a shingle that the other set doesn't have. A prefix
    with pairs of frequent shingles ends later than any rare shingle, so all unique keys of the other set count.
    """
    needed = _needed("n", "m", percent)
    one, other = F.col("u") <= F.col("n") - needed, F.col("v") <= F.col("m") - needed
    return (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (one | other) & (F.col("smooth") | one) & (F.col("plain") | other)


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    logs, frequent = rarity(texts, words)
    rows = materialize(_signed(texts, logs, frequent, words, percent), "signed")
    classes = rows.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("singles").alias("singles"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    release(docs.sparkSession)
    entries = classes.select("node", "singles", F.posexplode_outer("keys").alias("at", "key")).select("key", "node", (F.col("at") < F.col("singles")).alias("single"), F.least("at", F.col("singles").cast("int")).alias("at"))
    common = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    shared = materialize(entries.join(common, "key"), "shared")
    own = shared.where("single").groupBy("node").agg(F.count("*").alias("found"))
    lone = classes.select("node", "n", "singles", (F.col("singles") == F.size("keys")).alias("plain")).join(own, "node", "left")
    lone = materialize(lone.select("node", "n", (F.col("singles") - F.coalesce("found", F.lit(0))).alias("u"), "plain"), "sizes")
    other = lone.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("u").alias("v"), F.col("plain").alias("smooth"))
    known = materialize(shared.join(lone, "node").select("key", "node", "at", "n", "u", "plain"), "known")
    discard(shared)
    release(docs.sparkSession)
    # the class that has least of its own, such as the text that near copies were made from, stands for its key
    hubs = known.groupBy("key").agg(F.min(F.struct("u", "node")).alias("hub")).select("key", F.col("hub.node").alias("a"))
    first_pairs = known.join(hubs, "key").where("node <> a").select(F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).distinct()
    first_pairs = first_pairs.join(lone.withColumnRenamed("node", "b"), "b").join(other, "a")
    pairs = materialize(first_pairs.where(_may_link(percent)).select("a", "b"), "pairs")
    links = _verified(materialize(_plausible(pairs, classes, percent), "pairs"), texts, classes, words, percent)
    found = connected_components(links)
    release(docs.sparkSession)

    # what is left: keys whose classes are in different components
    placed = materialize(known.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "placed")
    mixed_keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    open_rows = materialize(placed.join(mixed_keys, "key", "left_semi"), "open")
    left = open_rows.select("key", F.col("node").alias("a"), "at", "n", "u", "plain", F.col("c").alias("ca"))
    right = open_rows.select("key", F.col("node").alias("b"), F.col("at").alias("to"), F.col("n").alias("m"), F.col("u").alias("v"), F.col("plain").alias("smooth"), F.col("c").alias("cb"))
    # a pair is made at its first common single key, or at a pair of frequent shingles if it has no common single key:
    # all before that isn't shared
    ahead = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) >= _needed("n", "m", percent)
    more = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ahead & _may_link(percent)).select("a", "b").distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        further = _verified(materialize(_plausible(more, classes, percent), "pairs"), texts, classes, words, percent)
        found = connected_components(links.union(further)) if not further.isEmpty() else found

    placed = classes.select("node", "print", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_print = placed.join(ids, "component").select("print", "component_id")
    kind = rows.schema["doc_id"].dataType
    full = rows.where("n > 0").join(of_print, "print").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").cast(kind).alias("component_id"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are, without all but one of each group: a row with the group's smallest id.

    Rows are told apart by id (nulls last) and text, so rows of one id with different texts stay or go each by its own
    text. Of rows with equal id and text one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("digest")).alias("key")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key)
    groups = materialize(similar_groups(keyed.select("key", "row.text"), words, percent, id_col="key"), "groups")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("key")).distinct()
    kept = keyed.join(gone, "key", "left_anti")
    repeated = groups.where(F.col("n_shingles") > 0).groupBy(F.col("doc_id").alias("key")).count().where("count > 1").select("key")
    if repeated.isEmpty():
        return kept.select("row.*")
    again = Window.partitionBy("key").orderBy(*[F.col("row").getField(c) for c in docs.columns if c != "doc_id"])
    alone = kept.join(repeated, "key", "left_semi").withColumn("nth", F.row_number().over(again)).where("nth = 1").drop("nth")
    return kept.join(repeated, "key", "left_anti").unionByName(alone).select("row.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(load(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN c USING (doc_id) GROUP BY doc_id
"""
