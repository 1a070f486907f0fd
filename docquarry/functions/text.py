"""Text functions on columns.  Everything is a composition of built-in functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The expressions below are part of the expected behaviour.
WORD = r"[\p{L}\p{N}_]+"
TRIM = r"^\s+|\s+$"
DATE_FORMATS = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yy", "dd-MM-yy")
#: The shapes of the six formats, which keep a lenient parser from taking one for another.
_DATE_SHAPES = (
    r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$",
    r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{1,2}-\d{1,2}-\d{2}$",
)
DIGITS = r"^\d+$"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
YEAR = r"^(?:19|20)\d{2}$"
COURSE_CODE = r"(?i)^[a-z]{2,}\d{3,}[a-z0-9-]*$"
GENDERS = ("nam", "nu", "male", "female", "m", "f")
BULLET, LONE_O = r"(?m)^(\s*)[•▪‣◦]\s+", r"(?m)^(\s*)o\s+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE_NUMBER = r"(?mi)^\s*(?:(?:Page|Trang)\s+)?\d+\s*$"
HEADING_3 = r"(?m)^(\s*)(\d+\.\d+\.\d+)(?!\.\d)[ \t:\.]*(\S.*)$"
HEADING_2 = r"(?m)^(\s*)(\d+\.\d+)(?!\.\d)[ \t:\.]*(\S.*)$"


@lru_cache
def _accents() -> tuple[str, str]:
    """Characters to replace and their bases; combining marks have none and so go."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, TRIM, "")


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks (canonical decomposition; letters such as d with stroke stay)."""
    return F.translate(c, *_accents())


def normalize_text(c: Column) -> Column:
    """Lower-case letters a-z and digits; anything else is one space between words; null as empty."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c.cast("string"), F.lit("")))), r"[^a-z0-9]+", " "))


def compact_text(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def tokenize(c: Column, min_length: int = 2) -> Column:
    """Lower-case words of letters, digits and underscores, at least ``min_length`` long."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0)), lambda t: F.length(t) >= min_length)


def looks_like_person(c: Column) -> Column:
    parts = F.split(normalize_text(c), " ")
    return F.size(parts).between(2, 6) & ~F.exists(parts, lambda p: p.rlike(DIGITS)) & F.forall(parts, lambda p: F.length(p) >= 2)


def looks_like_date(c: Column) -> Column:
    return c.cast("string").rlike(DATE)


def looks_like_year(c: Column) -> Column:
    return strip(c.cast("string")).rlike(YEAR)


def looks_like_age(c: Column) -> Column:
    return F.coalesce(to_float(c).between(10, 100), F.lit(False))


def looks_like_course_code(c: Column) -> Column:
    return strip(c.cast("string")).rlike(COURSE_CODE)


def looks_like_gender(c: Column) -> Column:
    return normalize_text(c).isin(*GENDERS)


def to_float(c: Column) -> Column:
    """The number a text spells, null where it spells none."""
    return strip(c.cast("string")).try_cast("double")


def parse_date(c: Column) -> Column:
    """The first ten characters in the first of six formats that fits, else null."""
    head = F.substring(strip(c.cast("string")), 1, 10)
    tries = [F.when(head.rlike(shape), F.try_to_timestamp(head, F.lit(_lenient(fmt)))) for shape, fmt in zip(_DATE_SHAPES, DATE_FORMATS)]
    return F.coalesce(*tries)


def _lenient(fmt: str) -> str:
    return fmt.replace("dd", "d").replace("MM", "M")


def contains_ignoring_case(c: Column, value: str) -> Column:
    """``LOWER(CAST(x AS STRING)) LIKE LOWER('%value%')``; % and _ in the value are wildcards."""
    return F.lower(c.cast("string")).like(f"%{value.lower()}%")


def contains_all(c: Column, values: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [contains_ignoring_case(c, v) for v in values], F.lit(True))


def clean_bullets(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, BULLET, "$1- "), LONE_O, "$1- ")


def clean_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def clean_page_numbers(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("``"), F.lit("")), PAGE_NUMBER, "")


def numeric_headings(c: Column) -> Column:
    """``1.2 Title`` and ``1.2.3 Title`` lines become headings of level 2 and 3."""
    three = F.regexp_replace(c, HEADING_3, "$1### $2 $3")
    return F.regexp_replace(three, HEADING_2, "$1## $2 $3")


def join_hard_breaks(c: Column) -> Column:
    """Lines that go on in the next one are joined by a space, paragraph by paragraph.

    A line stands alone after one that ends in ``.?!:>]``, before a numbered item, and next to a
    heading, list item, quote or comment.
    """
    marks = ("#", "<!--", "-", "*", ">")
    starts = lambda x: reduce(lambda a, b: a | b, [x.startswith(m) for m in marks])

    def paragraph(p: Column) -> Column:
        lines = F.split(p, "\n", -1)

        def step(acc: Column, line: Column) -> Column:
            last = F.regexp_replace(F.element_at(acc, -1), r"\s+$", "")
            here = F.regexp_replace(line, r"^\s+", "")
            alone = (last == "") | (here == "") | last.rlike(r"[.?!:>\]]$") | here.rlike(r"^\d+\.") | starts(last) | starts(here)
            joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), here)))
            return F.when(alone, F.concat(acc, F.array(here))).otherwise(joined)

        return F.array_join(F.aggregate(F.slice(lines, F.lit(2), F.size(lines)), F.slice(lines, 1, 1), step), "\n")

    return F.array_join(F.transform(F.split(c, "\n\n", -1), paragraph), "\n\n")


def sanitize_markdown(c: Column) -> Column:
    text = numeric_headings(clean_page_numbers(clean_bullets(clean_control(F.coalesce(c, F.lit(""))))))
    return strip(F.regexp_replace(join_hard_breaks(text), r"\n{3,}", "\n\n"))


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\x00", "")


def json_object(c: Column) -> Column:
    """The outermost ``{...}`` of a text that may be fenced or surrounded by words."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)


def mask(c: Column, shown: int = 4) -> Column:
    """The last characters of a secret after stars; short ones are starred as a whole."""
    return F.when(F.length(c) <= shown, F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(c, F.lit(shown))))


def escape_html(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def strip_citations(c: Column) -> Column:
    """Without ``[cite: 1, 2]`` and ``[cite_start]`` marks."""
    return strip(F.regexp_replace(c, r"\s*\[cite[^\]]*\]", ""))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
