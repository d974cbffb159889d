"""Day files, event lines, mail boxes, archives and folders; partition writes and refreshes."""

from __future__ import annotations

import email
import email.header
import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import note_title
from ..functions.titles import auto_title, is_placeholder
from ..functions.urls import canonical_url, host, html_to_text, is_url, site, with_scheme
from ..operators.entries import SCHEMA, missing

TRAIL = T.StructType([T.StructField(n, T.StringType()) for n in ("at", "kind", "app", "window", "url", "text")])


def read_days(spark: SparkSession, folder: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """Day files, each a JSON array; fields beyond the schema stay out, missing ones are null."""
    return spark.read.schema(schema).json(folder, multiLine=True, pathGlobFilter="*.json")


def read_trail(spark: SparkSession, folder: str) -> DataFrame:
    """Event lines; a line that was cut off or isn't JSON is skipped."""
    rows = spark.read.schema(T.StructType([*TRAIL.fields, T.StructField("_corrupt_record", T.StringType())])).json(folder, pathGlobFilter="*.jsonl", mode="PERMISSIVE")
    return rows.where(F.col("_corrupt_record").isNull() & F.col("at").isNotNull()).drop("_corrupt_record").withColumn("at", F.to_timestamp("at"))


def write_entries(e: DataFrame, path: str, partition: str = "date_key") -> None:
    """Replaces just the partitions that ``e`` has rows for."""
    e.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def with_defaults(rows: DataFrame) -> DataFrame:
    """``rows`` in the entry schema: what is missing is null, a day follows from the time, nothing is
    pinned, and lists are empty."""
    have = set(rows.columns)
    out = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])
    at = F.coalesce("created_at", F.current_timestamp())
    return out.withColumns({"created_at": at, "date_key": F.coalesce("date_key", F.date_format(at, "yyyy-MM-dd")), "pinned": F.coalesce("pinned", F.lit(False)), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def append_entries(rows: DataFrame, path: str, partition: str = "date_key") -> None:
    with_defaults(rows).write.mode("append").partitionBy(partition).parquet(path)


def notes(texts: DataFrame) -> DataFrame:
    """Typed texts (id, created_at, text) as records, titled by their first line."""
    return with_defaults(texts.withColumns({"type": F.lit("note"), "title": note_title(F.col("text"))}))


def links(rows: DataFrame, origin: str = "") -> DataFrame:
    """Addresses (id, created_at, url, title) as records, without what only tracks; an address that has
    no title is titled by its site."""
    url = canonical_url(with_scheme(F.col("url")))
    return with_defaults(rows.withColumn("url", url).withColumns({"type": F.lit("url"), "origin": F.lit(origin), "title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), host(F.col("url")))}))


def bookmarks(rows: DataFrame) -> DataFrame:
    return links(rows, "bookmark").withColumn("pinned", F.lit(True))


def recordings(rows: DataFrame) -> DataFrame:
    """Sound files (id, created_at, path, text) as records."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    return with_defaults(rows.withColumns({"type": F.lit("audio"), "mime": F.coalesce(F.col("mime") if "mime" in rows.columns else F.lit(None), F.lit("audio/wav")), "title": name}))


def copied(rows: DataFrame) -> DataFrame:
    """Copied texts (id, created_at, text) as records: an address alone is a link, the rest notes."""
    is_link = is_url(F.col("text"))
    return with_defaults(rows.withColumns({"type": F.when(is_link, "url").otherwise("note"), "url": F.when(is_link, with_scheme(F.col("text"))), "origin": F.lit("clipboard"), "title": note_title(F.col("text"))}))


def enriched(e: DataFrame) -> DataFrame:
    """``e`` with what each type's records need: titles that say something for all, addresses in one
    form for links, and a status for those that hold nothing to read."""
    title = auto_title(F.col("title"), F.col("text"), app=F.col("app"), tags=F.col("tags"))
    return e.withColumns({
        "title": F.when((F.col("type") == "url") & is_placeholder(F.col("title")), F.coalesce(F.nullif(site(F.col("url")), F.lit("")), title)).otherwise(title),
        "url": F.when(F.col("type") == "url", canonical_url(F.col("url"))).otherwise(F.col("url")),
        "status": F.when(F.col("type").isin("pdf", "audio") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "error").otherwise(F.col("status")),
    })


def read_recaps(spark: SparkSession, folder: str) -> DataFrame:
    """day, text of a folder of one file a day (yyyy-MM-dd.md)."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.md$", 1)
    return rows.select(day.alias("day"), F.col("value").alias("text")).where("day <> ''")


def write_sidecar(lines: DataFrame, path: str) -> None:
    """Recognised lines (id, date_key, lines) beside their records, a day's at a time."""
    write_entries(lines.select("id", "date_key", "lines"), path)


def with_sidecar(e: DataFrame, sidecar: DataFrame) -> DataFrame:
    """``e`` with its lines, null where there are none."""
    return e.join(sidecar.select("id", "lines"), "id", "left")


def sniff(name: Column, members: Column, texts: Sequence[str] = (".md", ".txt", ".html", ".csv"), least: int = 3) -> Column:
    """What a dropped file is: an export (an archive with ``least`` texts or more), a mail box, a
    text, or just a file.  ``members`` are an archive's names, else null."""
    low = F.lower(name)
    inside = F.size(F.filter(members, lambda m: F.lower(m).rlike("(" + "|".join(re.escape(t) for t in texts) + ")$")))
    return F.when(F.endswith(low, F.lit(".zip")) & (F.coalesce(inside, F.lit(0)) >= least), "export").when(F.endswith(low, F.lit(".mbox")), "mail").when(low.rlike("(" + "|".join(re.escape(t) for t in texts) + ")$"), "text").otherwise("file")


def read_dropped(spark: SparkSession, path: str) -> DataFrame:
    """path, title, text of all that can be read below a folder: texts, archives' members, mails."""
    texts = read_folder(spark, path).select("path", "title", "text")
    inside = read_zips(spark, path).select(F.concat_ws("!", "path", "member").alias("path"), F.col("member").alias("title"), "text")
    mails = read_mbox(spark, path).select(F.concat_ws("!", "path", F.col("n").cast("string")).alias("path"), F.col("subject").alias("title"), F.col("body").alias("text"))
    return texts.unionByName(inside).unionByName(mails)


def delete_entries(spark: SparkSession, path: str, ids: DataFrame, staging: str, partition: str = "date_key") -> None:
    """Rewrites the partitions that hold one of ``ids``; a partition left empty is dropped by
    the next full write.  The new rows are staged first, as a plan can't overwrite what it reads."""
    e = spark.read.parquet(path)
    days = e.join(ids, "id", "left_semi").select(partition).distinct()
    e.join(days, partition, "left_semi").join(ids, "id", "left_anti").write.mode("overwrite").parquet(staging)
    write_entries(spark.read.parquet(staging), path, partition)


def files_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, stamp (time and size) of the files below ``folder``; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).drop("content")
    return f.select("path", F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("stamp"))


def refresh_plan(now: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed or new files, vanished files) between two manifests."""
    return missing(now, indexed, ["path", "stamp"]), missing(indexed.select("path"), now, ["path"])


def decode_header(value: str | None) -> str:
    """A mail header in plain text; unknown character sets are read as Latin-1."""
    if not value:
        return ""
    out = []
    for part, charset in email.header.decode_header(value):
        if isinstance(part, bytes):
            try:
                part = part.decode(charset or "utf-8", "replace")
            except LookupError:
                part = part.decode("latin-1")
        out.append(part)
    return " ".join("".join(out).split())


def split_mbox(text: str) -> list[str]:
    """Messages of a mail box: a line "From address ..." begins one."""
    parts = re.split(r"(?m)^From \S+ .*\n", text.replace("\r\n", "\n"))
    return [p for p in parts[1:] if p.strip()]


def parse_message(raw: str) -> dict[str, str | None]:
    """subject, sender, date, message id and body: plain text first, else HTML."""
    m = email.message_from_string(raw)
    plain, rich = "", ""
    for part in m.walk():
        if part.get_content_maintype() != "text" or part.get_filename():
            continue
        data = part.get_payload(decode=True) or b""
        try:
            body = data.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            body = data.decode("latin-1")
        if part.get_content_subtype() == "html":
            rich = rich or body
        else:
            plain = plain or body
    return {"subject": decode_header(m["subject"]), "sender": decode_header(m["from"]), "date": m["date"], "message_id": m["message-id"], "body": plain.strip(), "html": "" if plain.strip() else rich}


MAIL = "path string, n int, subject string, sender string, date string, message_id string, body string, html string"


def read_mbox(spark: SparkSession, path: str, pattern: str = "*.mbox") -> DataFrame:
    """One row a message.  A box is one text; very large boxes should be split before."""
    boxes = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, text in zip(batch["path"], batch["value"], strict=True):
                rows = [{"path": p, "n": k, **parse_message(raw)} for k, raw in enumerate(split_mbox(text or ""))]
                if rows:
                    yield pd.DataFrame(rows)

    rows = boxes.mapInPandas(run, MAIL)
    return rows.withColumn("body", F.when(F.col("body") == "", html_to_text(F.col("html"))).otherwise(F.col("body"))).drop("html")


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{md,txt,html,csv}") -> DataFrame:
    """path, title, text of all text files below a folder; export ids at names' ends are cut."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.url_decode(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\+", "%2B"))
    title = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,8}$", ""), r"\s+[0-9a-f]{32}$", ""))
    return rows.select(F.col("_metadata.file_path").alias("path"), title.alias("title"), F.col("value").alias("text"))


def read_zips(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".txt", ".html", ".csv"), least: int = 3) -> DataFrame:
    """path, member, text of archives that hold ``least`` text files or more."""
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                names = [n for n in archive.namelist() if n.lower().endswith(suffixes)]
                for n in names if len(names) >= least else ():
                    yield pd.DataFrame({"path": [p], "member": [n], "text": [archive.read(n).decode("utf-8", "replace")]})

    return zips.mapInPandas(run, "path string, member string, text string")
