"""Text functions: escaping, splitting, tolerant parsing, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTML escapes; the ampersand must come first. Fixed values.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
#: Texts that count as true. Fixed values.
TRUE_WORDS = ("true", "1", "yes")
#: Languages whose pages live under a prefix; the default one has none. Fixed values.
PREFIXED_LANGUAGES = ("th", "zh")
DEFAULT_LANGUAGE = "en"


def html_escape(s: Column) -> Column:
    for raw, safe in HTML_ESCAPES:
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def trimmed(s: Column) -> Column:
    """Without white space at either end; Spark's trim takes blanks only."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def is_blank(s: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(s, F.lit("")).rlike(r"^\s*$")


def words(s: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def acronym_markup(s: Column) -> Column:
    """Every word with its first character in a span, the rest escaped, joined by one space."""
    return F.array_join(F.transform(words(s), lambda w: F.concat(F.lit('<span class="acronym-letter">'), F.substring(w, 1, 1), F.lit("</span>"), html_escape(F.substr(w, F.lit(2))))), " ")


def initials(s: Column) -> Column:
    return F.array_join(F.transform(words(s), lambda w: F.substring(w, 1, 1)), "")


def comma_list(s: Column) -> Column:
    """Trimmed parts between commas that aren't blank."""
    return F.filter(F.transform(F.split(s, ","), trimmed), lambda x: x != "")


def choice_list(s: Column) -> Column:
    """As comma_list, with line ends as separators too."""
    return F.filter(F.transform(F.split(s, r"[,\r\n]+"), trimmed), lambda x: x != "")


def as_flag(s: Column) -> Column:
    """True for a few words only; a cast would take others too."""
    return F.coalesce(F.lower(s).isin(*TRUE_WORDS), F.lit(False))


def or_default(s: Column, default: Column | str) -> Column:
    """default where s is null or empty."""
    return F.coalesce(F.nullif(s, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def is_given(x: Column) -> Column:
    """Whether a template shows a value: not null, empty, zero or false."""
    return F.coalesce(~x.cast("string").isin("", "0", "0.0", "false"), F.lit(False))


def float_or(s: Column, fallback: float) -> Column:
    """The number that a text begins with, else the fallback."""
    number = F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(float(fallback)))


def duration_ms(s: Column, fallback: float) -> Column:
    """A CSS time in milliseconds: 'ms' first, then 's', then a bare number; blank, zero and what is no number give the fallback."""
    t = trimmed(F.coalesce(s, F.lit("")))
    number = float_or(t, float("nan"))
    bare = F.when(F.isnan(number) | (number == 0), F.lit(float(fallback))).otherwise(number)
    return F.when(t == "", F.lit(float(fallback))).when(t.endswith("ms"), number).when(t.endswith("s"), number * 1000).otherwise(bare)


def has_part(s: Column, part: str) -> Column:
    """Whether a text has the part; null has none."""
    return F.coalesce(F.contains(s, F.lit(part)), F.lit(False))


def language_of_path(path: Column, languages=PREFIXED_LANGUAGES) -> Column:
    """The language whose prefix a path begins with, else the default one."""
    found = F.regexp_extract(path, rf"^/({'|'.join(languages)})(/|$)", 1)
    return or_default(found, DEFAULT_LANGUAGE)


def scan_path(book: Column, page: Column) -> Column:
    """archive/book/page.jpg, the page number with three digits or more."""
    digits = page.cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return F.concat_ws("/", F.lit("archive"), book, F.concat(padded, F.lit(".jpg")))


def scan_parts(path: Column) -> Column:
    """Struct of book and page of a scan path; nulls for other paths."""
    pattern = r"^archive/([^/]+)/(\d+)\.jpg$"
    return F.struct(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).alias("book"), F.regexp_extract(path, pattern, 2).try_cast("bigint").alias("page"))


def field_name(label: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_"), r"^_|_$", "")


def rendition(spec: Column) -> Column:
    """Struct of operation, width, height and format of an image spec like `fill-1920x1080 format-webp`, `width-400` or `scale-50`.

    With width, height and scale stands one number: the width, the height, or per cent of both, and the other field is null.
    """
    number = lambda pattern: F.regexp_extract(spec, pattern, 1).try_cast("int")
    both, width, height, scale = r"\b(?:fill|max|min)-", r"\bwidth-(\d+)\b", r"\bheight-(\d+)\b", r"\bscale-(\d+)\b"
    return F.struct(
        F.nullif(F.regexp_extract(spec, r"\b(fill|max|min|width|height|scale|original)\b", 1), F.lit("")).alias("operation"),
        F.coalesce(number(both + r"(\d+)x\d+"), number(width), number(scale)).alias("width"),
        F.coalesce(number(both + r"\d+x(\d+)"), number(height), number(scale)).alias("height"),
        F.nullif(F.regexp_extract(spec, r"\bformat-(\w+)", 1), F.lit("")).alias("format"),
    )


def hashed_name(name: Column, content: Column) -> Column:
    """File name with twelve digits of its content's hash before the extension."""
    digest = F.substring(F.md5(content), 1, 12)
    return F.concat(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.lit("."), digest, F.regexp_extract(name, r"(\.[^.]*)$", 1))


def has_thai(s: Column) -> Column:
    """Whether a text has a character of the Thai block."""
    return F.coalesce(s, F.lit("")).rlike("[\\u0E01-\\u0E5B]")
