"""URL columns: hosts, sites, normal forms, media kinds."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import POST_PATHS, POST_VIEW, SECOND_LEVEL, SITES, TRACKING
from .text import text_of


def is_url(c: Column) -> Column:
    return F.trim(text_of(c)).rlike(r"(?i)^(https?://)?[a-z0-9-]+(\.[a-z0-9-]+)+(:\d+)?([/?#]\S*)?$")


def with_scheme(c: Column) -> Column:
    t = F.trim(text_of(c))
    return F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text_of(c), r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def base_host(c: Column) -> Column:
    """The registrable part: two labels, three where the second-level one is generic."""
    parts = F.split(host(c), r"\.")
    n = F.size(parts)
    generic = F.get(parts, n - 2).isin(*SECOND_LEVEL) & (F.length(F.get(parts, n - 1)) == 2)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), n - F.when(generic, 2).otherwise(1)), F.lit(3)), ".")


def site(c: Column, names: Mapping[str, str] = SITES) -> Column:
    """The name of a known site, by full host and then by registrable part; else that part."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, host(c)), F.try_element_at(table, base_host(c)), F.nullif(base_host(c), F.lit("")), F.lit(""))


def site_in_title(c: Column, names: Mapping[str, str] = SITES) -> Column:
    low = F.lower(text_of(c))
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in dict.fromkeys(names.values())], F.lit(""))


def norm_url(c: Column) -> Column:
    """http(s) only, without fragment and trailing slash; anything else is empty."""
    t = F.trim(text_of(c))
    return F.when(t.rlike(r"(?i)^https?://"), F.regexp_replace(F.regexp_replace(t, "#.*$", ""), "/+$", "")).otherwise("")


def canonical_url(c: Column, tracking: str = TRACKING) -> Column:
    """``norm_url`` without tracking parameters."""
    n = norm_url(c)
    query = F.split_part(n, F.lit("?"), F.lit(2))
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).rlike(tracking))
    path = F.regexp_replace(F.split_part(n, F.lit("?"), F.lit(1)), "/+$", "")
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def _as_post(c: Column) -> Column:
    """The canonical address less what hangs off a post, if it is one of its site; else null."""
    clean = canonical_url(c)
    path, query = F.split_part(clean, F.lit("?"), F.lit(1)), F.regexp_extract(clean, r"(\?.*)$", 1)
    whole = F.regexp_replace(path, POST_VIEW, "")
    host = F.lower(F.regexp_extract(clean, r"(?i)^https?://([^/:?#]+)", 1))
    is_post = reduce(lambda a, b: a | b, [host.rlike(site) & whole.rlike(post) for site, post in POST_PATHS.items()])
    return F.when(is_post, F.concat(whole, query))


def post_url(page: Column, found: Column | None = None) -> Column:
    """Where a saved post lives: the page it was saved on if that is a post, else the address that was ``found``
    in it, else the page; sub-views, fragments and tracking go, other parameters stay."""
    if found is None:
        return F.coalesce(_as_post(page), canonical_url(page))
    return F.coalesce(_as_post(page), _as_post(found), F.nullif(canonical_url(found), F.lit("")), canonical_url(page))


def media_kind(url: Column, mime: Column | None = None, size: Column | None = None) -> Column:
    """stream, segment, video, audio, image, or null; small images are none."""
    path = F.lower(F.regexp_replace(text_of(url), r"[?#].*$", ""))
    kind = text_of(mime) if mime is not None else F.lit("")
    small = F.coalesce(size < 4096, F.lit(False)) if size is not None else F.lit(False)
    return (
        F.when(path.rlike(r"\.(m3u8|mpd)$") | kind.rlike(r"(?i)mpegurl|dash\+xml"), "stream")
        .when(path.rlike(r"\.(ts|m4s)$"), "segment")
        .when(path.rlike(r"\.(mp4|webm|mov|mkv|m4v)$") | kind.rlike(r"(?i)^video/"), "video")
        .when(path.rlike(r"\.(mp3|m4a|aac|ogg|oga|wav|flac)$") | kind.rlike(r"(?i)^audio/"), "audio")
        .when(~small & (path.rlike(r"\.(png|jpe?g|gif|webp|avif|heic|svg)$") | kind.rlike(r"(?i)^image/")), "image")
    )


def base_name(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text_of(url), r"[?#].*$", ""), r"([^/]+)/*$", 1)


def clean_title(c: Column, peel: int = 4) -> Column:
    """A page title without trailing site names, peeled at most ``peel`` times."""
    out = F.trim(text_of(c))
    for _ in range(peel):
        out = F.regexp_replace(out, r"(?<=.{8})\s+[|·–—-]\s+[^|·–—-]{1,30}$", "")
    return out


def deep_link(kind: str, id_: Column) -> Column:
    return F.concat(F.lit(f"tidelog://{kind}/"), F.url_encode(id_.cast("string")))


def parse_deep_link(c: Column) -> Column:
    kind = F.regexp_extract(text_of(c), r"^tidelog://(entry|day|search)/([^/?#]+)$", 1)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.url_decode(F.regexp_extract(text_of(c), r"^tidelog://(entry|day|search)/([^/?#]+)$", 2)).alias("id")))


def safe_name(c: Column, most: int = 80) -> Column:
    t = F.trim(F.regexp_replace(text_of(c), r'[\\/:*?"<>|\x00-\x1F]+', "_"))
    return F.coalesce(F.nullif(F.substring(t, 1, most), F.lit("")), F.lit("untitled"))


# The entities that pages use by name.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decode_entities(c: Column) -> Column:
    """Character references, by number and by the common names, as characters.  "&amp;" comes last,
    so nothing is decoded twice; a number that is no character stays as it is."""
    t = text_of(c)
    numbered = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?:\d{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))

    def character(ref: Column) -> Column:
        hexed = F.when(ref.rlike("^&#[xX]"), F.regexp_extract(ref, "^&#[xX](.+);$", 1)).otherwise(F.conv(F.regexp_extract(ref, r"^&#(\d+);$", 1), 10, 16))
        code = F.conv(hexed, 16, 10).cast("long")
        good = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        return F.when(good, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")).otherwise(ref)

    out = F.aggregate(numbered, t, lambda acc, ref: F.replace(acc, ref, character(ref)))
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def html_to_text(c: Column, most: int | None = None) -> Column:
    """A quick text view of a page: scripts and comments out, blocks to lines, the common
    entities decoded."""
    t = F.regexp_replace(text_of(c), r"(?is)<(script|style|head|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/ul|/ol|/table)\b[^>]*>", "\n")
    t = decode_entities(F.regexp_replace(t, r"(?s)<[^>]*>", " "))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))), lambda x: x != "")
    out = F.array_join(lines, "\n")
    return F.substring(out, 1, most) if most else out


def html_title(c: Column) -> Column:
    return F.trim(decode_entities(F.regexp_extract(text_of(c), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_description(c: Column) -> Column:
    """What a page says about itself: its description, or what it gives to those who link it."""
    t = text_of(c)
    name = r"""(?:name|property)\s*=\s*["'](?:og:)?description["']"""
    content = r"""content\s*=\s*["']([^"']*)["']"""
    first, second = F.regexp_extract(t, rf"(?is)<meta\b[^>]*{name}[^>]*{content}", 1), F.regexp_extract(t, rf"(?is)<meta\b[^>]*{content}[^>]*{name}", 1)
    return F.trim(decode_entities(F.when(first != "", first).otherwise(second)))
