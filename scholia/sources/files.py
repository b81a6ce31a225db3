"""Sources and sinks: dictionaries, pasted text, progress files, bundles, catalogs and Markdown exports."""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a pasted text that are accepted.
MOST_TEXT = 2_000_000
PROGRESS = (
    "kind string, version int, device string, exported_at string, lookups "
         "array<struct<uid:string,headword:string,meaning:string,source:string,looked_at:string,sentence:string>>, "
    "reviews array<struct<uid:string,headword:string,rating:int,reviewed_at:string,device:string>>, positions "
         "array<struct<paper_id:string,sentence:string,item_id:string,offset:double,updated_at:string,device:string>>, " ""
    "marks array<struct<uid:string,paper_id:string,sentence:string,note:string,updated_at:string,deleted:int,device:string>>"
)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, lower, mean) of a TSV file: heads before the first tab, split at commas; lines without a tab are passed over."""
    rows = spark.read.text(path).filter(F.instr("value", "\t") > 0)
    at = F.instr("value", "\t")
    heads = F.explode(F.split(F.substring("value", F.lit(1), at - 1), ",")).alias("word")
    return rows.select(heads, F.trim(F.substring("value", at + 1,
        F.length("value"))).alias("mean")).select(F.trim("word").alias("word"), "mean").filter("word <> ''").select("word",
        F.lower("word").alias("lower"), "mean")


def write_dictionary_shards(words: DataFrame, path: str) -> None:
    """Writes a dictionary by first ASCII letter, so that a lookup reads one folder."""
    initial = F.substring("lower", 1, 1)
    words.withColumn("initial", F.when(initial.rlike("^[a-z]$"), initial).otherwise("_")).repartition("initial",
        F.pmod(F.xxhash64("lower"), F.lit(8))).write.partitionBy("initial").parquet(path)


def import_texts(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, title, text) of texts (title, text) that are new to the catalog: not blank, not too long, once each. The id is the first
    8 hex digits of the SHA-256, which different texts share now and then: texts are told apart by their title and the whole
    hash, and so is what a catalog (id, title, text) has; a catalog of ids alone has all texts of its ids."""
    rows = texts.select(F.coalesce("title", F.lit("")).alias("title"), F.trim("text").alias("text")).filter((F.length("text") > 0)
         & (F.length("text") <= MOST_TEXT))
    sha = F.sha2(F.concat_ws("\n", "title", "text"), 256).alias("sha")
    rows = rows.select("title", "text", sha).dropDuplicates(["sha", "title"]).withColumn("id", F.substring("sha", 1, 8))
    if "text" in catalog.columns:
        known, key = catalog.select(F.coalesce("title", F.lit("")).alias("title"), sha), ["sha", "title"]
    else:
        known, key = catalog.select("id"), ["id"]
    return rows.join(known, key, "left_anti").select("id", "title", "text")


#: Words of a heading at most, words of one without a number at most, and the deepest level.
MOST_WORDS, MOST_LONE, DEEPEST = 12, 8, 3


def headings(text_lines: DataFrame, capitals: str = r"\p{Lu}\p{Lt}") -> DataFrame:
    """Adds level and heading to lines (doc_id, n, line) of pasted text; both are null where a line is no heading.

    Markdown's hashes give the level themselves. Any other heading is short, names something and doesn't end like a
    sentence or a clause. If it begins with a section number and a capital, the number's parts give the level; without
    one it stands alone between a blank line (or the start) and a blank line or a capital, one of `capitals`.
    """
    w = Window.partitionBy("doc_id").orderBy("n")
    line = F.trim("line")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    capital = lambda c: F.trim(c).rlike(f"^[{capitals}]")
    words = F.split(line, r"\s+")
    hashes, rest = F.length(F.regexp_extract(line, "^#*", 0)), F.regexp_extract(line, r"^#+\s+(\S.*?)\s*#*$", 1)
    number = F.regexp_replace(words[0], r"\.$", "")
    parts = F.when(F.forall(F.split(number, r"\."), lambda x: x.rlike("^[0-9]+$")), F.size(F.split(number, r"\.")))
    phrase = (F.size(words) <= MOST_WORDS) & ~F.substring(line, -1, 1).isin(*".!?,;:") & line.rlike("[A-Za-z]")
    lone = blank(F.lag("line").over(w)) & (blank(F.lead("line").over(w)) | capital(F.lead("line").over(w)))
    plain = F.when(parts.isNotNull() & F.coalesce(capital(words[1]), F.lit(False)), F.least(parts, F.lit(DEEPEST))).when(lone
        & (F.size(words) <= MOST_LONE) & (capital(line) | line.rlike("^[0-9]")), 1)
    level = F.when(hashes.between(1, DEEPEST) & (rest != ""), hashes).when(phrase, plain)
    out = text_lines.withColumn("level", level.cast("int"))
    return out.withColumn("heading", F.when(F.col("level").isNotNull(), F.coalesce(F.nullif(rest, F.lit("")), line)))


#: Characters of a progress file at most, and the version that is read.
MOST_PROGRESS, VERSION = 20_000_000, 1


def read_progress(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) progress files, one JSON document a file. accepted are (file, and what PROGRESS names); rejected are
    (file, reason): size (over MOST_PROGRESS characters, not parsed), json, kind, version, reviews or lookups (one of them lacks
    what it needs, or a rating isn't 1 to 4)."""
    return checked_progress(spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path")))


def checked_progress(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) progress documents (file, value), as `read_progress` has them. A pack of documents, Parquet with these
    columns, holds those of many learners in a few files."""
    raw = documents.select("file", "value")
    raw = raw.withColumn("large", F.length("value") > MOST_PROGRESS).withColumn("value", F.when(~F.col("large"), F.col("value")))
    rows = raw.select("file", "large", F.try_parse_json("value").isNull().alias("broken"), F.from_json("value",
        PROGRESS).alias("x")).select("file", "large", "broken", "x.*")
    filled = lambda x, *names: F.forall(F.array(*[x[n] for n in names]), lambda v: v.isNotNull())
    review = lambda x: filled(x, "uid", "headword", "reviewed_at") & F.coalesce(x["rating"].between(1, 4), F.lit(False))
    fine = lambda rows, test: F.coalesce(F.forall(rows, test), F.lit(True))
    reason = (
        F.when(F.col("large"), "size").when(F.col("broken"), "json").when(~F.coalesce(F.col("kind") == "progress", F.lit(False)),
            "kind").when(~F.coalesce(F.col("version") == VERSION, F.lit(False)), "version")
        .when(~fine("reviews", review), "reviews").when(~fine("lookups", lambda x: filled(x, "uid", "headword", "meaning", "looked_at")), "lookups")
    )
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason", "broken", "large"), rows.filter("reason is not null").select("file", "reason")


def own_progress(lookups: DataFrame, reviews: DataFrame, device: str) -> tuple[DataFrame, DataFrame]:
    """What a device exports: all lookups, and its own reviews only."""
    return lookups, reviews.filter(F.col("device") == device)


#: Records of a progress file at most: what a learner has more goes to further files, as merges go by uid and not by file.
MOST_RECORDS = 20_000


def progress_documents(tables: dict[str, DataFrame], owner: str, most: int = MOST_RECORDS) -> DataFrame:
    """(owner, _file, a list for each table) of the learners in tables, each of which has the column `owner`: one row of at most
    about `most` records for each file, so that no learner's records are gathered whole however many there are. Records
    are dealt to a learner's files by a hash of all their columns; rows without an owner are passed over."""
    tables = {name: df.filter(F.col(owner).isNotNull()) for name, df in tables.items()}
    sizes = reduce(DataFrame.unionByName, [df.select(owner) for df in tables.values()]).groupBy(owner).agg(F.count("*").alias("_n"))
    many = sizes.filter(F.col("_n") > most).withColumn("_files", F.ceil(F.col("_n") / most)).drop("_n")
    lists = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != owner]
        file = F.pmod(F.xxhash64(*columns), F.coalesce("_files", F.lit(1))).alias("_file")
        rows = df.join(many, owner, "left").select(owner, file, F.struct(*columns).alias("x"))
        lists.append(rows.groupBy(owner, "_file").agg(F.array_sort(F.collect_list("x")).alias(name)))
    return reduce(lambda x, y: x.join(y, [owner, "_file"], "full"), lists)


def write_progress(device: str, tables: dict[str, DataFrame], owner: str, exported_at: str, path: str, packed: bool = False) -> None:
    """Writes the progress files of a device: of each learner (a column `owner` of all tables) its lookups, positions and marks,
    and of the reviews the device's own, as JSON documents in a folder for each; or, packed, as rows of a pack."""
    tables = {**tables, "reviews": tables["reviews"].filter(F.col("device") == device)}
    head = [F.lit("progress").alias("kind"), F.lit(VERSION).alias("version"), F.lit(device).alias("device"), F.lit(exported_at).alias("exported_at")]
    docs = progress_documents(tables, owner).select(owner, "_file", F.to_json(F.struct(*head, *tables)).alias("value"))
    if packed:
        pack(docs, owner).write.mode("overwrite").parquet(path)
    else:
        docs.write.partitionBy(owner, "_file").mode("overwrite").text(path)


def pack(docs: DataFrame, owner: str) -> DataFrame:
    """(file, value) of documents (owner, _file, value): file is the place that each would have in a folder of its own."""
    return docs.select(F.concat(F.lit(f"/{owner}="), F.col(owner).cast("string"), F.lit("/_file="), F.col("_file").cast("string")).alias("file"), "value")


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables of a bundle as Parquet folders of a new version, and then a line of the manifest that names it. A reader
    sees the last version that is complete, whatever a write leaves unfinished."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    line = spark.createDataFrame([(version, time.time_ns(), sorted(tables))], "version string, written long, names array<string>")
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle's last version, by name."""
    manifest = spark.read.schema("version string, written long, names array<string>").json(f"{path}/manifest")
    last = manifest.orderBy(F.desc("written")).first()
    return {n: spark.read.parquet(f"{path}/{last.version}/{n}") for n in last.names}


def ingest(existing: DataFrame, incoming: DataFrame, key: str, origin: str) -> DataFrame:
    """existing (key, ..., origin) with the rows of a bundle in place of its own of the same key; new ones are marked by where
    they come from, those that were there keep their origin."""
    once = incoming.dropDuplicates([key]).join(existing.select(key, F.col("origin").alias("_had")), key,
        "left").withColumn("origin", F.coalesce("_had", F.lit(origin)))
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(once.select(*existing.columns))


def read_shard(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(word, lower, mean) of some words from a sharded dictionary: only the folders of their first letters are read."""
    low = [w.lower() for w in words]
    initials = sorted({w[:1] if w[:1].isascii() and w[:1].isalpha() else "_" for w in low})
    return spark.read.parquet(path).filter(F.col("initial").isin(initials) & F.col("lower").isin(low)).select("word", "lower", "mean")


def find_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the PDF files in a folder and those below it, but for folders and files below it whose name
    begins with a dot. No content is read."""
    return _pdfs(spark, path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _pdfs(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    root = re.sub(r"^[A-Za-z0-9]+:(//[^/]*)?", "", path).rstrip("/")
    below = F.substring("path", F.instr("path", root) + len(root), F.length("path"))
    return found.filter(~below.rlike(r"/\.[^/]"))


#: Sizes up to which each is a condition of its own for the scan; beyond, the scan takes the range from least to greatest.
MOST_SIZES = 500


def originals(spark: SparkSession, path: str, papers: DataFrame) -> DataFrame:
    """(paper_id, path, modified, files) of papers (paper_id, size, sha): the files that `find_pdfs` finds with a paper's size and
    SHA-256, of which the oldest counts (a tie: the least path), and how many there are. Content is read only of files whose
    size some paper has, or lies in the range of these; papers without a file give no row."""
    wanted = papers.select("size").dropna().distinct()
    sizes = [r["size"] for r in wanted.limit(MOST_SIZES + 1).collect()]
    if not sizes:
        return spark.createDataFrame([], "paper_id string, path string, modified timestamp, files long")
    if len(sizes) <= MOST_SIZES:
        fits = reduce(lambda x, y: x | y, [F.col("length") == n for n in sizes])
    else:
        low, high = wanted.agg(F.min("size"), F.max("size")).first()
        fits = (F.col("length") >= low) & (F.col("length") <= high)
    found = _pdfs(spark, path).filter(fits).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha"))
    each = papers.select("paper_id", "size", "sha").join(found, ["size", "sha"]).groupBy("paper_id")
    best = each.agg(F.min(F.struct("modified", "path")).alias("x"), F.count("*").alias("files"))
    return best.select("paper_id", "x.path", "x.modified", "files")


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Papers' meta files, newest first; unreadable ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("imported_at"))


def marks_markdown(marks: DataFrame) -> DataFrame:
    """(paper_id, markdown) of marks (paper_id, place, section, sentence, translated, note), as `reading.marks_in_order` has
    them: quotes in order with their translations, a heading where the section changes, notes below. A reader's marks in
    one paper are what bounds the text."""
    w = Window.partitionBy("paper_id").orderBy("place")
    changed = F.coalesce(F.col("section") != F.lag("section").over(w), F.lit(True))
    quote = F.concat(F.lit("> "), F.col("sentence"), F.when(F.coalesce("translated", F.lit("")) != "", F.concat(F.lit("\n>\n> "),
         F.col("translated"))).otherwise(""))
    note: Column = F.when(F.coalesce(F.trim("note"), F.lit("")) != "", F.concat(F.lit("\n\n"), F.trim("note"))).otherwise("")
    item = F.concat(F.when(changed, F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"))).otherwise(""), quote, note)
    rows = marks.withColumn("item", item).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("x"))
    return rows.select("paper_id", F.array_join(F.transform("x", lambda i: i["item"]), "\n\n").alias("markdown"))


def pdf_date(raw: Column) -> Column:
    """A PDF date (D:YYYYMMDDhhmmss, later parts may lack) as a timestamp; null where it is none."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(raw, r"^D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?", i),
        F.lit("")), F.lit(default))
    return F.try_to_timestamp(F.concat(part(1, "x"), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4,
         "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00")))
