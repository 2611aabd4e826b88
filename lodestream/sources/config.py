"""Manifests, gold sets and settings."""

from __future__ import annotations

import hashlib
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "doc_id string, pair_id string, title string, so_hieu string, language string, kind string, issued_date date, effective_date date, status string, amended_by array<string>, amended_articles array<string>, amends array<string>, files array<string>"
GOLD = "id string, question string, language string, type string, reference_answer string, gold_sources array<struct<doc_id:string,page:int,quote:string>>, history array<struct<role:string,content:string>>, tags array<string>, reviewed boolean"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a JSON manifest: an array of them, or one object for each."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold set of JSON lines: ``line`` numbers from 1, ``error`` has the line as it is where it doesn't parse."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{GOLD}, error string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"})
    rows = text.select((F.col("line") + 1).alias("line"), parsed.alias("r")).select("line", "r.*")
    rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.format_string("line %d: %s", "line", "error")))
    empty = {c: F.coalesce(c, F.array()) for c in ("gold_sources", "history", "tags")}
    return rows.withColumns(empty).withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def write_gold(items: DataFrame, path: str) -> None:
    """JSON lines without null or empty fields; ``reviewed`` is always there."""
    slim = items.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("gold_sources", "history", "tags")})
    slim.drop("error", "line").write.option("ignoreNullFields", True).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def override(settings: dict, changes: list[str]) -> dict:
    """The settings with ``a.b=value`` changes, values in TOML. Each must name a setting; ``config_version`` must change too."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in settings.items()}
    for change in changes:
        name, _, value = change.partition("=")
        *path, last = name.strip().split(".")
        at = out
        for key in path:
            at[key] = dict(at[key])
            at = at[key]
        if last not in at:
            raise KeyError(name.strip())
        at[last] = tomllib.loads(f"v = {value}")["v"]
    if changes and out.get("config_version") == settings.get("config_version"):
        raise ValueError("changed settings need another config_version")
    return out


def read_settings(path: str, changes: list[str] = ()) -> dict:
    with open(path, "rb") as f:
        return override(tomllib.load(f), list(changes))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_result(rows: DataFrame, folder: str, config_version: str, kind: str, date: str, number: int = 1, partial: bool = False, dirty: bool = False) -> str:
    """One JSON line of result under a name of date, configuration, kind and number. Results of code that isn't committed
    are refused, unless the run is partial."""
    if dirty and not partial:
        raise ValueError("results are kept of committed code only")
    path = f"{folder.rstrip('/')}/{date}_{config_version}_{kind}{f'-{number}' if number > 1 else ''}{'_partial' if partial else ''}.json"
    rows.withColumns({"config_version": F.lit(config_version), "date": F.lit(date)}).coalesce(1).write.json(path)
    return path


def check_files(wanted: DataFrame, digests: DataFrame) -> DataFrame:
    """``filename, state`` of files (filename, sha256: null if not known): current, differs or missing among ``file_digests``."""
    have = digests.select(F.regexp_extract("path", "[^/]+$", 0).alias("filename"), F.col("sha256").alias("_have"))
    rows = wanted.join(have, "filename", "left")
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("sha256").isNull() | (F.col("sha256") == F.col("_have")), "current").otherwise("differs")
    return rows.select("filename", state.alias("state"))


def fetch_files(wanted: DataFrame, opener, magic: bytes = b"%PDF-") -> DataFrame:
    """``filename, content, error`` of files (filename, url, sha256): ``opener()`` makes a function from URL to bytes on the
    executor. What doesn't begin with ``magic`` or has another digest is an error, and the others go on."""

    def get(frames):
        read = opener()
        for frame in frames:
            out = []
            for name, url, digest in frame[["filename", "url", "sha256"]].itertuples(index=False):
                try:
                    data = read(url)
                    found = hashlib.sha256(data).hexdigest()
                    error = "no PDF" if not data.startswith(magic) else f"sha256 is {found}" if digest and digest != found else None
                except Exception as problem:  # openers raise what they like; the file is reported
                    data, error = None, str(problem)
                out.append((name, data if error is None else None, error))
            yield pd.DataFrame(out, columns=["filename", "content", "error"])

    return wanted.select("filename", "url", "sha256").mapInPandas(get, "filename string, content binary, error string")


# Review files ---------------------------------------------------------------------------------------------------

REVIEWED, NOTE = "Reviewed", "Note:"


def render_review(items: DataFrame) -> DataFrame:
    """``id, text``: a Markdown section for each item, with a box to tick and room for a note."""
    turns = F.array_join(F.transform("history", lambda h: F.concat(F.lit("> **"), h["role"], F.lit(":** "), h["content"])), "\n")
    sources = F.array_join(F.transform("gold_sources", lambda s: F.concat(F.lit("- `"), s["doc_id"], F.lit("` p. "), F.coalesce(s["page"].cast("string"), F.lit("?")), F.lit(": “"), s["quote"], F.lit("”"))), "\n")
    head = F.concat(F.lit("## "), F.concat_ws(" · ", "id", "type", "language", F.nullif(F.array_join("tags", ", "), F.lit(""))))
    box = F.concat(F.lit("- ["), F.when(F.col("reviewed"), "x").otherwise(" "), F.lit(f"] {REVIEWED}"))
    parts = [head, box, F.nullif(turns, F.lit("")), F.concat(F.lit("**Question:** "), "question"), F.concat(F.lit("**Answer:** "), F.coalesce("reference_answer", F.lit(""))), F.coalesce(F.nullif(sources, F.lit("")), F.lit("(no source)")), F.lit(NOTE)]
    return items.select("id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("text"))


def parse_review(files: DataFrame) -> DataFrame:
    """``id, ticked, note`` of each section of review files (text)."""
    sections = files.select(F.posexplode(F.split("text", r"(?m)^## ")).alias("at", "s")).where(F.col("at") > 0)
    note = F.trim(F.regexp_extract("s", rf"(?ms)^{NOTE}(.*)\z", 1))
    return sections.select(F.regexp_extract("s", r"^\S+", 0).alias("id"), F.col("s").rlike(rf"(?m)^- \[[xX]\] {REVIEWED}").alias("ticked"), F.regexp_replace(note, r"^\s+|\s+$", "").alias("note"))


def apply_review(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items with ``reviewed`` as decided (ticked and without a note; not in the file: as it was), and ``id, note`` of
    those to mend."""
    found = decisions.select("id", "ticked", "note")
    rows = items.join(found, "id", "left").withColumn("reviewed", F.coalesce(F.col("ticked") & (F.col("note") == ""), "reviewed"))
    return rows.select(*items.columns), items.select("id").join(found.where("note <> ''"), "id").select("id", "note")
