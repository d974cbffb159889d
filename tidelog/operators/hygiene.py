"""Text hygiene: repeated lines, menus, boilerplate views, redaction, duplicates, echoes.

Originals stay as they are: everything here returns a view.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import KEPT_SHARE, LINE_DOCS, LINE_MOST, LINE_REPEAT, MENU_LINES, MENU_RUN
from ..functions.text import card_ok, iban_ok, id18_ok, line_key, menuish, text_of


#: So many furniture lines go to the tasks as a set (each is under a hundred characters).
FURNITURE_IN_TASKS = 20_000


def furniture(e: DataFrame, id_col: str = "id", least: int = LINE_DOCS, most_chars: int = LINE_MOST) -> DataFrame:
    """line, df: short lines that stand in ``least`` records or more, once counted in each; digits
    and punctuation alone are none."""
    keys = F.array_distinct(F.transform(F.split(text_of(F.col("text")), "\n"), line_key))
    rows = e.select(F.explode(keys).alias("line")).where((F.length("line") >= 2) & (F.length("line") <= most_chars) & ~F.col("line").rlike(r"^[\d\p{P}\s]+$"))
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def doc_lines(e: DataFrame, id_col: str = "id") -> DataFrame:
    """id, n_lines, line_no, line, key: one row a line, for work on lines at scale."""
    cut = e.select(F.col(id_col).alias("id"), F.split(text_of(F.col("text")), "\n").alias("_lines"))
    rows = cut.select("id", F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("line_no", "line"))
    return rows.withColumn("key", line_key(F.col("line")))


def _starts(rows: str, field: str = "key") -> Column:
    """Where the groups of equal ``field`` begin in a sorted array column."""
    return F.array_compact(F.transform(rows, lambda x, i: F.when((i == 0) | (F.get(rows, i - 1)[field] != x[field]), i)))


def _size(k: Column, begin: Column, rows: str = "_s", starts: str = "_b") -> Column:
    """The size of group ``k``, which begins at ``begin``."""
    return F.coalesce(F.get(starts, k + 1), F.size(rows)) - begin


def without_repeats(e: DataFrame, id_col: str = "id", repeat: int = LINE_REPEAT) -> DataFrame:
    """id, line_no, line, key: the lines of each record less those whose key stands ``repeat`` times in it, and
    later copies.  All in the record's own row, by sorting its (key, line): nothing is shuffled."""
    cut = e.select(F.col(id_col).alias("id"), F.explode(F.array(F.split(text_of(F.col("text")), "\n"))).alias("_l"))
    rows = cut.select("id", F.explode(F.array(F.sort_array(F.transform("_l", lambda x, i: F.struct(line_key(x).alias("key"), i.alias("no"), x.alias("line")))))).alias("_s"))
    rows = rows.select("id", "_s", F.explode(F.array(_starts("_s"))).alias("_b"))
    first = F.transform("_b", lambda b, k: F.when(F.get("_s", b)["key"] == "", F.slice("_s", b + 1, _size(k, b))).when(_size(k, b) < repeat, F.array(F.get("_s", b))))
    return rows.select("id", F.inline(F.flatten(F.array_compact(first)))).select("id", F.col("no").alias("line_no"), "line", "key")


def without_menus(lines: DataFrame, run: int = MENU_RUN) -> DataFrame:
    """``lines`` with menu: whether a line belongs to a run of ``run`` or more menu-like lines of
    its record.  Blank lines neither break a run nor count."""
    blank, like = F.trim("line") == "", menuish(F.col("line"))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"_like": ~blank & like, "_stop": ~blank & ~like})
    cut = marked.withColumn("_run", F.sum(F.col("_stop").cast("int")).over(w))
    n = F.sum(F.col("_like").cast("int")).over(Window.partitionBy("id", "_run"))
    return cut.withColumn("menu", ~F.col("_stop") & (n >= run)).drop("_like", "_stop", "_run")


def _raw(text: Column) -> Column:
    return F.regexp_replace(text_of(text), r"^\s+|\s+$", "")


def _chosen(kept: float) -> list[Column]:
    """view, text: the first of _full, _soft and _raw that keeps enough."""
    enough = lambda v: F.length(text_of(F.col(v))) >= kept * F.length("_raw")
    view = F.when(enough("_full"), "full").when(enough("_soft"), "soft").otherwise("raw")
    return [view.alias("view"), F.when(view == "full", text_of(F.col("_full"))).when(view == "soft", text_of(F.col("_soft"))).otherwise(F.col("_raw")).alias("text")]


def _menu_marks(lines: str, run: int) -> Column:
    """For each line M if it belongs to a run of ``run`` or more menu-like lines, else another letter.  A
    record's lines are spelled as letters (S ends a run, L is menu-like, B is blank), cut at S."""
    letter = F.transform(lines, lambda x: F.when(F.trim(x) == "", "B").when(menuish(x), "L").otherwise("S"))
    runs = F.split(F.array_join(letter, ""), "S")
    told = F.transform(runs, lambda r: F.when(F.length(F.replace(r, F.lit("B"), F.lit(""))) >= run, F.translate(r, "BL", "MM")).otherwise(r))
    return F.split(F.array_join(told, "S"), "")


def stripped(e: DataFrame, furniture_lines: DataFrame | None = None, id_col: str = "id", run: int = MENU_RUN, kept: float = KEPT_SHARE, repeat: int = LINE_REPEAT, most_chars: int = LINE_MOST, least_lines: int = MENU_LINES, in_tasks: int = FURNITURE_IN_TASKS) -> DataFrame:
    """id, view, text: the text less furniture (the lines of ``furniture_lines``), lines that stand
    ``repeat`` times in it and later copies, without menus (full) or with them (soft), or as it
    is (raw): the first that keeps ``kept`` of the characters.  Lines above ``most_chars`` are no
    repeats, and records under ``least_lines`` lines have no menus.  Ids must be unique; blank
    lines go from the views, and texts are trimmed.

    All is done in the record's own row.  Furniture goes to the tasks as a set if it is at most ``in_tasks``
    lines (a size that is looked at first).  More of it meets numbers of the records' lines in a join, and
    each record gets its own of them; lines never travel."""
    known: list[str] = []
    own = F.lit(None).cast("array<string>")
    if furniture_lines is not None:
        known = [r["line"] for r in furniture_lines.select("line").distinct().limit(in_tasks + 1).collect()]
        if len(known) > in_tasks:
            e, known, own = _with_own_furniture(e, furniture_lines, id_col), [], F.col("_own")
    cut = e.select(F.col(id_col).alias("id"), _raw(F.col("text")).alias("_raw"), own.alias("_own"), F.explode(F.array(F.split(text_of(F.col("text")), "\n"))).alias("_l"))
    rows = cut.select("id", "_raw", "_own", "_l", F.explode(F.array(_menu_marks("_l", run))).alias("_m"))
    line = F.transform("_l", lambda x, i: F.struct(line_key(x).alias("key"), i.alias("no"), F.trim(x).alias("t"), ((F.get("_m", i) == "M") & (F.size("_l") >= least_lines)).alias("menu")))
    lines = F.filter(line, lambda x: (x["key"] != "") & ~x["key"].isin(*known)) if known else F.filter(line, lambda x: (x["key"] != "") & ~F.coalesce(F.array_contains("_own", x["key"]), F.lit(False)))
    rows = rows.select("id", "_raw", F.explode(F.array(F.sort_array(lines))).alias("_s"))
    rows = rows.select("id", "_raw", "_s", F.explode(F.array(_starts("_s"))).alias("_b"))
    groups = F.transform("_b", lambda b, k: F.slice("_s", b + 1, _size(k, b)))
    rows = rows.select("id", "_raw", F.explode(F.array(F.filter(groups, lambda g: (F.size(g) < repeat) | (F.length(g[0]["key"]) > most_chars)))).alias("_g"))
    joined = lambda firsts: F.array_join(F.transform(F.sort_array(F.array_compact(firsts)), lambda x: x["t"]), "\n")
    at = lambda x: F.struct(x["no"].alias("no"), x["t"].alias("t"))
    soft = joined(F.transform("_g", lambda g: at(g[0])))
    free = joined(F.transform("_g", lambda g: F.get(F.transform(F.filter(g, lambda x: ~x["menu"]), at), F.lit(0))))
    return rows.select("id", "_raw", soft.alias("_soft"), free.alias("_full")).select("id", *_chosen(kept))


def _with_own_furniture(e: DataFrame, furniture_lines: DataFrame, id_col: str) -> DataFrame:
    """``e`` with _own: the lines of ``furniture_lines`` that stand in each record (null: none).  A record's lines
    travel as numbers; what meets brings the furniture's own text, so equal numbers of other lines do no harm."""
    lines = furniture_lines.select("line").distinct().select(F.xxhash64("line").alias("_h"), "line")
    numbers = F.array_distinct(F.transform(F.split(text_of(F.col("text")), "\n"), lambda x: F.xxhash64(line_key(x))))
    met = e.select(id_col, F.explode(numbers).alias("_h")).join(lines, "_h")
    return e.join(met.groupBy(id_col).agg(F.collect_set("line").alias("_own")), id_col, "left")


@dataclass(frozen=True)
class Secret:
    """``pattern`` finds what is masked, behind ``lead``, which stays; ``valid`` is a check of it,
    and with ``free`` it may not be a piece of an address or a path (a "/" before it in its word)."""

    kind: str
    pattern: str
    lead: str = ""
    strict: bool = False
    valid: str | None = None
    free: bool = False

    @property
    def regex(self) -> str:
        return f"({self.lead}){self.pattern}" if self.lead else FREE + self.pattern if self.free else self.pattern


FREE = r"(?=[0-9A-Z])(?<!/\S{0,200})"
# What stands in place of each kind.
MASKS = {"pem": "[private key]", "key": "[api key]", "secret": "[secret]", "code": "[code]", "card": "[card number]", "id": "[id number]", "iban": "[iban]", "email": "[email]", "phone": "[phone]"}
# Formats of keys as their publishers document them, by publisher.
KEY_FORMATS = {
    "Amazon Web Services, access key id": r"AKIA[0-9A-Z]{16}",
    "GitHub, tokens": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "GitLab, personal access token": r"glpat-[A-Za-z0-9_-]{20,}",
    "Google Cloud, API key": r"AIza[0-9A-Za-z_-]{35}",
    "Hugging Face, user access token": r"hf_[A-Za-z0-9]{34,}",
    "npm, access token": r"npm_[A-Za-z0-9]{36,}",
    "OpenAI and other model services, secret key": r"sk-[A-Za-z0-9_-]{20,}",
    "RFC 7519, JSON web token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "Slack, tokens": r"xox[abeprs]-[A-Za-z0-9-]{10,}",
    "Stripe, API keys": r"(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{24,}",
}
# How card numbers are grouped in print (ISO/IEC 7812 allows 12 to 19 digits; the issuers' own
# layouts), and the shape of an IBAN (ISO 13616: country, check digits, up to 30 characters in fours).
CARD_LAYOUTS = ((4, 6, 5), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3), (4, 4, 4, 4), (4, 4, 4, 5), (4, 4, 4, 6), (4, 4, 4, 7))
CARD_DIGITS = (13, 19)
IBAN_REST = (8, 31)
# The words by which a secret names itself.
SECRET_NAMES = ("password", "passwd", "passphrase", "secret", "token", "api key", "密码", "口令", "授权码")
CODE_NAMES = ("verification code", "security code", "one time code", "otp", "验证码", "校验码", "动态码")


def _spelled(names: Sequence[str]) -> str:
    return "|".join(n.replace(" ", r"[\s_-]?") for n in names)


def _grouped() -> str:
    """Card numbers in groups, all parted by the same sign; longer last groups are tried first."""
    layouts = sorted(CARD_LAYOUTS, reverse=True)
    marked = [rf"\d{{{first}}}(?<s{k}>[ -])" + rf"\k<s{k}>".join(rf"\d{{{n}}}" for n in rest) for k, (first, *rest) in enumerate(layouts)]
    return "(?:" + "|".join(marked) + ")"


def _iban() -> str:
    least, most = IBAN_REST[0] // 4, IBAN_REST[1] // 4
    return rf"\b[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{least},{most}}}(?: ?[A-Z0-9]{{1,3}})?\b"


def _secrets() -> tuple[Secret, ...]:
    """The rules in the order in which they apply; a later one leaves masks alone."""
    fence = lambda end: rf"-----{end} (?:[A-Z]+ )?PRIVATE KEY-----"
    formats = "|".join(KEY_FORMATS.values())
    # A name may go on (aws_secret_access_key); "key" by itself names nothing, some_key does.
    name = rf"(?:(?:{_spelled(SECRET_NAMES)})(?:[_-][a-z0-9]+)*|[a-z0-9][_-]key)"
    new = r"(?!\[[a-z ]+\])"
    return (
        Secret("pem", rf"{fence('BEGIN')}[\s\S]*?{fence('END')}"),
        Secret("key", rf"(?<![A-Za-z0-9_])(?:{formats})"),
        Secret("key", rf"{new}[\w.~+/=-]{{16,}}", lead=r"\bBearer\s+"),
        Secret("secret", rf"{new}[^\s:@/]+(?=@)", lead=r"\b[a-z][a-z0-9+.-]*://[^\s:@/]+:"),
        Secret("secret", rf"{new}[^\s&#\"']{{6,}}", lead=rf"(?i)[?&;/][^\s?&;/=]{{0,60}}?{name}="),
        Secret("secret", rf"{new}[^\s\"']{{6,}}", lead=rf"(?i){name}\s*[:：=]\s*[\"']?"),
        Secret("code", r"\d{4,8}(?!\d)", lead=rf"(?i)(?:{_spelled(CODE_NAMES)})[^\n\d]{{0,12}}"),
        Secret("card", rf"(?<![\d.]){_grouped()}(?![\d.])", valid="card", free=True),
        Secret("card", rf"(?<![\d.])\d{{{CARD_DIGITS[0]},{CARD_DIGITS[1]}}}(?![\d.])", valid="card", free=True),
        Secret("id", r"(?<![0-9A-Za-z])\d{17}[\dXx](?![0-9A-Za-z])", valid="id18", free=True),
        Secret("iban", _iban(), valid="iban", free=True),
        Secret("email", r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", strict=True),
        Secret("phone", r"(?<![\d+])(?:\+\d{1,3}(?:[ -]?\d){8,14}|\(\d{3}\) ?\d{3}-\d{4}|07\d{3}[ -]?\d{6}|1[3-9]\d{9})(?!\d)", strict=True),
    )


SECRETS = _secrets()
VALID = {"card": card_ok, "iban": iban_ok, "id18": id18_ok}
LEVELS = ("off", "secrets", "all")


def _rules(level: str) -> list[Secret]:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    return [] if level == "off" else [s for s in SECRETS if level == "all" or not s.strict]


def _found(t: Column, s: Secret) -> Column:
    hits = F.regexp_extract_all(t, F.lit(s.regex), F.lit(0))
    return F.filter(hits, VALID[s.valid]) if s.valid else hits


def _mask(t: Column, hits: Column, s: Secret) -> Column:
    """All places of the rule, or those whose match is among the valid ones.  A valid match is
    sought again under the rule's own conditions, so equal digits inside an address stay."""
    if not s.valid:
        return F.regexp_replace(t, s.regex, ("$1" if s.lead else "") + MASKS[s.kind])
    around = (FREE + r"(?<![\d.A-Za-z])\Q", r"\E(?!\.?[\dA-Za-z])")
    return F.aggregate(F.array_distinct(hits), t, lambda a, x: F.regexp_replace(a, F.concat(F.lit(around[0]), x, F.lit(around[1])), F.lit(MASKS[s.kind])))


def masked(text: Column, level: str = "secrets") -> Column:
    """The text with each secret masked; rules apply in order, so what one has masked no
    later one sees.  Checked numbers are masked one by one, as only valid ones go."""
    out = text_of(text)
    for s in _rules(level):
        out = _mask(out, _found(out, s), s)
    return out


def redact(e: DataFrame, level: str = "secrets", text: str = "text") -> DataFrame:
    """``e`` with masked and hits (kind -> number).  Before each rule a generator of one row
    keeps the steps apart, so that no rule's work is repeated inside the next one's."""
    out = e.withColumns({"masked": text_of(F.col(text)), "_hits": F.array().cast("array<string>")})
    for s in _rules(level):
        rest = [F.col(f"`{c}`") for c in out.columns if c != "_hits"]
        found = out.select(F.inline(F.array(F.struct(*rest, "_hits", _found(F.col("masked"), s).alias("_found")))))
        out = found.withColumns({"_hits": F.concat("_hits", F.array_repeat(F.lit(s.kind), F.size("_found"))), "masked": F.when(F.size("_found") > 0, _mask(F.col("masked"), F.col("_found"), s)).otherwise(F.col("masked"))}).drop("_found")
    counts = F.aggregate("_hits", F.create_map().cast("map<string,int>"), lambda m, h: F.map_concat(F.map_filter(m, lambda k, v: k != h), F.create_map(h, F.coalesce(m[h], F.lit(0)) + 1)))
    return out.withColumn("hits", counts).drop("_hits")


def hits_line(hits: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.map_keys(hits)), lambda k: F.concat(k, F.lit("×"), hits[k].cast("string"))), ", ")


def exact_groups(e: DataFrame, key: Column) -> DataFrame:
    """key, n, first id of everything that is there twice or more; hot keys sum map-side."""
    return e.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") > 1)


def recent_copies(rows: DataFrame, key: Column, at: str, id_col: str, window_s: int = 120) -> DataFrame:
    """Copies of something copied within ``window_s`` before; a chain of copies is one copy."""
    w = Window.partitionBy("_k").orderBy(at, id_col)
    t = rows.withColumn("_k", key)
    before = F.lag(at).over(w)
    return t.withColumn("_b", before).where(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_b").cast("timestamp")) <= window_s * 1_000_000).drop("_k", "_b")


def echoes(e: DataFrame, questions: DataFrame, question: str = "text", least: int = 8, shingle: int = 4) -> DataFrame:
    """Ids of records that contain a question (case and white space aside).  A containment
    join: candidates share the question's first ``shingle`` words, found by an equi join, and
    only they are compared; shorter questions join on what words they have."""
    words = lambda c: F.filter(F.split(F.lower(text_of(F.col(c))), r"\s+"), lambda x: x != "")
    q = questions.select(words(question).alias("_w")).where(F.length(F.array_join("_w", "")) >= least).select("_w", F.least(F.size("_w"), F.lit(shingle)).alias("_n"))
    q = q.select(F.array_join(F.slice("_w", 1, F.col("_n")), " ").alias("_key"), F.array_join("_w", " ").alias("_q"), "_n").distinct()
    lengths = sorted(r["_n"] for r in q.select("_n").distinct().collect())  # ``shingle`` numbers at most
    # A generator of one row, so that the words are an attribute and cut only once.
    d = e.select(F.inline(F.array(F.struct(F.col("id"), words("text").alias("_w"))))).where(F.size("_w") > 0)

    def grams(n: int) -> Column:
        return F.transform("_w", lambda x, i: F.concat_ws(" ", x, *[F.get("_w", i + k) for k in range(1, n)]))

    runs = F.concat(*[grams(n) for n in lengths]) if lengths else F.array().cast("array<string>")
    keys = d.select("id", F.explode(F.array_distinct(runs)).alias("_key"))
    hit = keys.join(q, "_key").select("id", "_q").distinct()
    whole = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    rows = hit.join(d.select("id", whole.alias("_t")), "id").where(F.contains("_t", F.concat(F.lit(" "), F.col("_q"), F.lit(" "))))
    return rows.select("id").distinct()


def not_echo(e: DataFrame, questions: Sequence[str]) -> Column:
    """The same for a query's few own questions, as a predicate."""
    flat = F.regexp_replace(F.lower(text_of(F.col("text"))), r"\s+", "")
    keys = [k for q in questions if len(k := "".join(q.lower().split())) >= 8]
    return ~reduce(lambda a, b: a | b, [F.contains(flat, F.lit(k)) for k in keys], F.lit(False))
