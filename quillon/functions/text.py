"""String helpers with the exact blank, truth and padding rules of the findings model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as blanks around a text. U+0085 and U+180E are not among them.
BLANKS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim_blanks(text: Column) -> Column:
    """Strip every kind of blank from both ends; null stays null."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def truthy(text: Column) -> Column:
    """Present and not empty. Never null, so it can be negated."""
    return F.coalesce(text != "", F.lit(False))


def present(text: Column) -> Column:
    """The text if it is present and not empty, else null."""
    return F.when(truthy(text), text)


def or_empty(text: Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(text, F.lit(""))


def pad_end(text: Column, width: int) -> Column:
    """Pad with blanks to ``width``; a longer text stays whole."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def iso_utc(moment: Column) -> Column:
    """A timestamp as ISO-8601 in UTC with milliseconds; the session's time zone has to be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def letters_and_digits(text: Column) -> Column:
    """The letters and digits of a text in lower case; empty if there are none, null for null."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
