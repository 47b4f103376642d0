"""Reading VARIANT values without coercion: a value of another type than asked for counts as absent."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Appended to a document to tell trailing text from a whole document.
_END = "quillon-end-of-document"


def parse_json(text: Column) -> Column:
    """The document as VARIANT, or null if the text isn't one valid JSON document.

    The parser alone accepts text behind the document. Parsed as the first entry of a list whose second is known, a
    document with anything behind it is no longer a valid list of two.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    listed = F.try_variant_get(pair, "$", "array<variant>")
    whole = (F.size(listed) == 2) & (F.try_variant_get(pair, "$[1]", "string") == _END) & ~F.contains(text, F.lit(_END))
    # a text that holds the mark itself can't be told apart that way; it is parsed as it is
    return F.when(whole, F.get(listed, F.lit(0))).when(F.contains(text, F.lit(_END)), F.try_parse_json(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def kind(value: Column) -> Column:
    """'STRING', 'BIGINT', 'OBJECT<...>', 'ARRAY<...>' and so on; null for an absent value."""
    return F.schema_of_variant(value)


def is_record(value: Column) -> Column:
    """Whether the value is an object or an array. Never null."""
    return F.coalesce(kind(value).startswith("OBJECT") | kind(value).startswith("ARRAY"), F.lit(False))


def as_array(value: Column, path: str = "$") -> Column:
    """The array at ``path``, or null."""
    return F.try_variant_get(value, path, "array<variant>")


def as_text(value: Column, path: str = "$") -> Column:
    """The text at ``path`` if a JSON string is there, else null."""
    text = lambda found: F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))
    return text(value) if path == "$" else let(F.try_variant_get(value, path, "variant"), text)


def as_number(value: Column, path: str = "$") -> Column:
    """The finite number at ``path`` as a double, else null."""


    def number(found: Column) -> Column:
        value = F.try_variant_get(found, "$", "double")
        numeric = kind(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
        return F.when(numeric & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)

    return number(value) if path == "$" else let(F.try_variant_get(value, path, "variant"), number)
