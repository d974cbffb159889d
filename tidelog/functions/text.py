"""Text columns: clean-up, measures, snippets, chunks, titles, check digits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import CHUNK_CHARS, CHUNK_LEAST, CHUNK_STRIDE

LETTER = r"\p{L}"
HAN = r"[\p{IsHan}]"


def text_of(c: Column) -> Column:
    """A missing text is an empty one."""
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def first_line(c: Column) -> Column:
    return F.trim(F.split_part(text_of(c), F.lit("\n"), F.lit(1)))


def letters(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(LETTER))


def has_words(c: Column) -> Column:
    """Two Latin words of two letters or more, or four Han characters."""
    t = text_of(c)
    return (F.regexp_count(t, F.lit(r"[A-Za-z]{2,}")) >= 2) | (F.regexp_count(t, F.lit(HAN)) >= 4)


def enough_text(c: Column, lines: int = 3, least: int = 60) -> Column:
    """So many lines with a letter, and so many letters in all; a Han letter counts twice."""
    t = text_of(c)
    lettered = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(LETTER)))
    return (lettered >= lines) & (letters(t) + F.regexp_count(t, F.lit(HAN)) >= least)


def says_something(title: Column, text: Column, least: int = 8) -> Column:
    return letters(F.concat_ws(" ", title, text)) >= least


def tidy_title(c: Column) -> Column:
    """A window title without spinner glyphs, terminal sizes and unread counters."""
    t = F.regexp_replace(text_of(c), r"[\x{2800}-\x{28FF}◐◓◑◒✳✶✻✽●○⏳]", "")
    t = F.regexp_replace(t, r"\s+[—–-]\s+\d{2,4}[x×]\d{2,4}\s*$", "")
    t = F.regexp_replace(t, r"^\s*\(\d+\+?\)\s*|\s*\(\d+\+?\)\s*$", "")
    return squeeze(t)


def trim_window_title(title: Column, app: Column) -> Column:
    """The title without a trailing " - App"; a title that is just the app's name is empty."""
    t, a = F.trim(text_of(title)), F.trim(text_of(app))
    tail = [F.concat(F.lit(f" {dash} "), a) for dash in "-–—"]
    out = t
    for end in tail:
        out = F.when((a != "") & F.endswith(out, end), F.substring(out, F.lit(1), F.length(out) - F.length(end))).otherwise(out)
    return F.when(F.lower(out) == F.lower(a), "").otherwise(F.trim(out))


def note_title(c: Column, most: int = 60, least: int = 24) -> Column:
    """The first line; one that is too long is cut after its last punctuation from ``least``
    on, else at the limit."""
    line = first_line(c)
    head = F.substring(line, 1, most)
    cut = F.regexp_extract(head, rf"^(.{{{least},}}[.,;:!?。，；：！？])", 1)
    return F.when(F.length(line) <= most, line).when(cut != "", cut).otherwise(head)


def clip(c: Column, most: int) -> Column:
    """At most ``most`` characters, ended at a space where there is one in the last third."""
    t = squeeze(c)
    head = F.substring(t, 1, most)
    at_space = F.regexp_extract(head, rf"^(.{{{most * 2 // 3},}})\s\S*$", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(at_space != "", at_space).otherwise(head), F.lit("…")))


def snippet(c: Column, needle: Column | str, around: int = 90) -> Column:
    """``around`` characters on either side of the first hit; the head where there is none."""
    t = squeeze(c)
    at = F.instr(F.lower(t), F.lower(F.lit(needle) if isinstance(needle, str) else needle))
    return F.substring(t, F.greatest(at - around, F.lit(1)), F.lit(2 * around))


def window_around(c: Column, needles: Sequence[str], width: int, back: int = 24) -> Column:
    """The ``width`` characters around the earliest needle: a third of them stand before it, from just behind a
    space if there is one within ``back`` characters.  Short texts stay; without a needle, or with
    one near the beginning, it is the head."""
    t = squeeze(c)
    low = F.lower(t)
    at = F.array_min(F.filter(F.array(*[F.instr(low, n.lower()) for n in needles]), lambda i: i > 0)) if needles else F.lit(None).cast("int")
    first = at - width // 3  # from 1; at least the ``width / 2`` before the needle are more than a third
    near = F.substring(t, F.greatest(first - back, F.lit(1)), F.least(first, F.lit(back + 1)))
    space = F.instr(F.reverse(near), " ")
    start = F.when(space > 0, first - space + 2).otherwise(first)
    around = F.concat(F.lit("…"), F.substring(t, start, F.lit(width)))
    return F.when(F.length(t) <= width, t).when(at.isNull() | (at - 1 < width / 2), F.substring(t, 1, width)).otherwise(around)


def reading_text(title: Column, body: Column, summary: Column | None = None) -> Column:
    """What a record is cut into pieces from: title and body, else a summary in the body's place; ``body``
    is best a text without furniture (``hygiene.stripped``)."""
    head = F.trim(text_of(title))
    inner = squeeze(body)
    if summary is not None:
        inner = F.when(inner == "", squeeze(summary)).otherwise(inner)
    return F.concat_ws("。", F.nullif(head, F.lit("")), F.nullif(inner, F.lit("")))


def chunks(c: Column, chars: int = CHUNK_CHARS, stride: int = CHUNK_STRIDE, most: int | None = None, least: int = CHUNK_LEAST) -> Column:
    """Overlapping pieces of a text: array of (seq, chunk), at most ``most`` where that is given,
    none shorter than ``least``; a text that fits is one piece."""
    piece = F.lit(rf"(?s)(?=(.{{1,{chars}}})).{{1,{stride}}}")

    def cut(t: Column) -> Column:
        n = F.greatest(F.lit(0), F.ceil((F.length(t) - chars) / stride)).cast("int") + 1
        # One pass over the text: a match is a stride long and looks ahead for its whole piece.
        found = F.slice(F.regexp_extract_all(t, piece, F.lit(1)), F.lit(1), n if most is None else F.least(F.lit(most), n))
        return F.transform(found, lambda x, i: F.struct(i.alias("seq"), x.alias("chunk")))

    # Bound as a variable, so that the text is squeezed once.
    return F.filter(F.transform(F.array(squeeze(c)), cut)[0], lambda x: F.length(x["chunk"]) >= least)


def chunk_hash(c: Column, model: str, chars: int = CHUNK_CHARS, stride: int = CHUNK_STRIDE) -> Column:
    """Names the content, the model and the cutting, so that any change asks for new vectors."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit(model), F.lit(f"{chars}/{stride}"), squeeze(c))), 1, 16)


def occurrences(hay: Column, term: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(term), F.lit("")))) / len(term)).cast("long")


def line_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def menuish(c: Column) -> Column:
    """A short line that is no sentence and no longer phrase with a comma: navigation rather than
    prose.  Lines with Han letters are short with up to eight of them, others under five words."""
    t = F.trim(text_of(c))
    han = F.regexp_count(t, F.lit(HAN))
    short = F.when(han > 0, han <= 8).otherwise(F.size(F.split(t, r"\s+")) < 5)
    phrase = t.rlike("[，,、]") & (F.length(t) > 18)
    return (F.length(t) <= 44) & short & ~phrase & ~t.rlike(r"[.!?。！？;；]$")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """Unicode's composed form.  Texts below U+0300 are composed already and don't leave the JVM (Python sees
    a null in their place); batches of nothing else cost next to nothing."""
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)), c)


def copy_identity(kind: Column, payload: Column) -> Column:
    """What a copied thing is the same by: its kind and a digest of its normalised text; composed and
    decomposed spellings are the same."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(nfc(text_of(payload)), "\r\n?", "\n"), r"[ \t]+", " "))
    prefix = F.when(kind == "image", "pic:").when(kind == "url", "url:").otherwise("txt:")
    return F.concat(prefix, F.md5(norm))


def mod97(digits: Column) -> Column:
    """Remainder of a long decimal string by 97, folded digit by digit."""
    each = F.filter(F.split(digits, ""), lambda x: x != "")
    return F.aggregate(each, F.lit(0), lambda acc, d: (acc * 10 + d.cast("int")) % 97)


def iban_ok(c: Column) -> Column:
    t = F.upper(F.replace(text_of(c), F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))
    digits = F.array_join(F.transform(F.filter(F.split(turned, ""), lambda x: x != ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")
    return t.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (mod97(digits) == 1)


def id18_ok(c: Column) -> Column:
    """An 18-character identity number: a birth date from 1900 to 2100 at characters 7 to 14, and
    a check character by weights 2^(17-i) mod 11, 10 written X."""
    t = F.upper(text_of(c))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(16)), F.lit(0), lambda acc, i: acc + F.substring(t, i + 1, F.lit(1)).cast("int") * (F.pow(F.lit(2), 17 - i).cast("int") % 11))
    want = F.substring(F.lit("10X98765432"), total % 11 + 1, F.lit(1))
    born = F.try_to_timestamp(F.substring(t, 7, 8), F.lit("yyyyMMdd"))
    real = born.isNotNull() & F.substring(t, 7, 4).between("1900", "2100")
    return F.when(t.rlike(r"^\d{17}[0-9X]$"), (F.substring(t, 18, 1) == want) & real).otherwise(False)


def card_ok(c: Column) -> Column:
    """13 to 19 digits (spaces and dashes aside) of an issuer's range, not one digit repeated, with
    a right check digit."""
    digits = F.regexp_replace(text_of(c), "[ -]", "")
    return digits.rlike(r"^(?!(\d)\1+$)[2-6]\d{12,18}$") & F.call_function("luhn_check", digits)


def clean_text(c: Column) -> Column:
    """Recognised text without the gaps that stand between Han letters."""
    return F.regexp_replace(text_of(c), r"(?<=\p{IsHan})[ \t]+(?=\p{IsHan})", "")


def hamming(a: Column, b: Column, size_a: Column | None = None, size_b: Column | None = None) -> Column:
    """Distance of two 64-bit picture fingerprints; null (no distance) for pictures of other sizes."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return apart if size_a is None or size_b is None else F.when(size_a.eqNullSafe(size_b), apart)
