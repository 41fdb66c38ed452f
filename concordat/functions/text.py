"""String functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for a search.
STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would should could may might can this that these those it its which what when where who how if than then so just not "
    "all any some such no nor too very only also"
).split()


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def normalised(text: Column | str) -> Column:
    """Lower-case ASCII letters and digits, single blanks between words; other letters are dropped."""
    kept = F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def alnum_key(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]", "")


def tokens(text: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores of any script; null and blank texts have none."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.split(spaced, " "), F.array().cast("array<string>")))


def keywords(text: Column | str) -> Column:
    """Tokens longer than two characters that are no stopwords."""
    return F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def sentences(text: Column | str) -> Column:
    """Parts between full stops, exclamation and question marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(text), "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(_col(text)) / 4)


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.trim(_col(text)), r"\s+"), lambda w: w != ""))


def cache_key(prefix: str, text: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.md5(_col(text)))


def snippet(text: Column | str, limit: int = 200) -> Column:
    """The first characters, marked where the text goes on."""
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)


def formula_id(text: Column | str) -> Column:
    return F.left(F.trim(F.translate(_col(text), "$\\", "")), F.lit(50))


def text_id(text: Column | str, limit: int = 80) -> Column:
    return F.trim(F.left(_col(text), F.lit(limit)))


def title_case(text: Column | str) -> Column:
    return F.initcap(F.replace(_col(text), F.lit("_"), F.lit(" ")))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A text with ``{name}`` replaced by values; a missing value is an empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
