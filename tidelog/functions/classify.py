"""What a record is and where it came from, as expressions over the entry schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BROWSERS
from .text import text_of
from .urls import site, site_in_title

# The origins that stand for themselves, and the buckets in order.
ORIGINS = ("clipboard", "bookmark", "browser", "notion", "gmail")
BUCKETS = ("clip", "shot", "saved", "file", "voice")
MIME_FORMATS = (
    (r"^image/", "image"), (r"^audio/", "audio"), (r"^video/", "video"), (r"pdf", "pdf"),
    (r"msword|wordprocessingml|opendocument\.text|rtf", "doc"), (r"excel|spreadsheetml|opendocument\.spreadsheet|csv", "sheet"),
    (r"powerpoint|presentationml|opendocument\.presentation", "slides"), (r"zip|x-tar|gzip|x-7z|x-rar", "archive"),
    (r"uri-list", "link"), (r"^text/", "text"),
)
SUFFIX_FORMATS = {
    "image": "png jpg jpeg gif webp heic svg", "audio": "mp3 wav m4a webm aac flac", "video": "mp4 mov mkv avi", "pdf": "pdf",
    "doc": "doc docx rtf pages", "sheet": "xls xlsx csv numbers", "slides": "ppt pptx key", "archive": "zip tar gz 7z rar", "text": "txt md json html",
}


def entry_source(origin: Column, kind: Column) -> Column:
    return F.when(origin.isin(*ORIGINS), origin).when(kind == "screenshot", "screenshot").when(kind == "audio", "voice").otherwise("other")


def entry_bucket(origin: Column, kind: Column, pinned: Column) -> Column:
    """Total and disjoint: the buckets' counts add up to all records."""
    return (
        F.when(F.coalesce(pinned, F.lit(False)) | origin.isin("bookmark", "browser"), "saved")
        .when(origin == "clipboard", "clip").when(kind == "screenshot", "shot").when(kind == "audio", "voice").otherwise("file")
    )


def entry_format(mime: Column, path: Column, kind: Column) -> Column:
    m = F.lower(F.split_part(text_of(mime), F.lit(";"), F.lit(1)))
    suffix = F.lower(F.regexp_extract(text_of(path), r"[^.]\.([A-Za-z0-9]+)$", 1))
    out = F.when(m.rlike(MIME_FORMATS[0][0]), MIME_FORMATS[0][1])
    for pattern, name in MIME_FORMATS[1:]:
        out = out.when(m.rlike(pattern), name)
    for name, suffixes in SUFFIX_FORMATS.items():
        out = out.when(suffix.isin(*suffixes.split()), name)
    return out.when(kind == "note", "text").when(kind == "url", "link").otherwise("other")


def entry_origin(url: Column, app: Column, window: Column) -> Column:
    """The site; for a browser the site that its title names; the app; else "?"."""
    s, a = site(url), F.trim(text_of(app))
    return F.coalesce(F.nullif(s, F.lit("")), F.when(a.rlike(BROWSERS), F.nullif(site_in_title(window), F.lit(""))), F.when(~a.rlike(BROWSERS), F.nullif(a, F.lit(""))), F.lit("?"))


def file_kind(path: Column, fmt: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(text_of(path), r"\.([A-Za-z0-9]{1,8})$", 1), F.lit("")), fmt))


def entry_sub(bucket: Column, fmt: Column, origin: Column, kind: Column) -> Column:
    """The second level: files by kind, saved things by format, the rest by where from."""
    return F.when(bucket == "file", kind).when(bucket == "saved", fmt).otherwise(origin)
