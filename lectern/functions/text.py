"""String functions over columns. All but nfc and clip_tokens stay in the JVM. A null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it, for a Java character class under (?U).
SPACE = r"\s\x1C-\x1F"
#: The characters that token sets treat as blanks, fixed values.
PUNCTUATION = ".,;:()[]\"'¿?¡!\n\t"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def nfc(c: Column) -> Column:
    """Canonical composition. Spark has none, so an Arrow function runs over batches.

    Within it only texts with a character from U+0300 on become Python strings, as composition leaves all others as they are; a batch without one is handed back untouched.
    """

    @F.arrow_udf("string")
    def compose(s: pa.Array) -> pa.Array:
        import unicodedata

        import pyarrow.compute as pc

        may = pc.fill_null(pc.match_substring_regex(s, "[^\\x{00}-\\x{2FF}]"), False)
        if not pc.any(may).as_py():
            return s
        return pc.replace_with_mask(s, may, pa.array([unicodedata.normalize("NFC", x) for x in s.filter(may).to_pylist()], s.type))

    return compose(c)


def undo_mojibake(c: Column) -> Column:
    """The whole string read again as UTF-8 if it is Latin-1 and then strictly valid; otherwise unchanged."""
    bytes_ = F.encode(F.when(~c.rlike(r"[^\x00-\xFF]"), c), "ISO-8859-1")
    again = bytes_.cast("string")
    return F.when(F.is_valid_utf8(again), again).otherwise(c)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, "[​-‏‪-‮]", "")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def expand_ligatures(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))


def squeeze_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def normalize(c: Column, compose: bool = True) -> Column:
    """Cleaning of extracted text, in this order; composition first, so what the repair brings is not composed again."""
    for step in (*([nfc] if compose else []), undo_mojibake, strip_invisible, strip_controls, expand_ligatures, squeeze_lines, squeeze_spaces, strip):
        c = step(c)
    return c


def fold_heading(c: Column) -> Column:
    """Stripped, in lower case, with the five acute vowels and ñ plain; other accents stay."""
    return F.translate(F.lower(strip(c)), "áéíóúñ", "aeioun")


def plain(c: Column) -> Column:
    return F.translate(F.lower(c), PUNCTUATION, " " * len(PUNCTUATION))


def token_set(c: Column) -> Column:
    """Distinct tokens; null gives an empty array."""
    return F.array_distinct(F.filter(F.split(F.coalesce(plain(c), F.lit("")), rf"(?U)[{SPACE}]+"), lambda x: x != ""))


def first_token(c: Column) -> Column:
    return F.try_element_at(F.filter(F.split(c, rf"(?U)[{SPACE}]+"), lambda x: x != ""), F.lit(1))


def clip_words(c: Column, most: int) -> Column:
    """At most `most` words, parted by single spaces; the fallback where no tokenizer is given."""
    return F.array_join(F.slice(F.split(c, " "), 1, most), " ")


def clip_tokens(c: Column, most: int, encoder: Callable[[], object]) -> Column:
    """The text of the first `most` tokens. encoder() gives, in a worker, an object with encode(str) and decode(list)."""

    @F.pandas_udf("string")
    def clip(s: pd.Series) -> pd.Series:
        e = encoder()
        return s.map(lambda x: x if x is None or len(ids := e.encode(x)) <= most else e.decode(ids[:most]))

    # a token has a character at least, so shorter texts needn't be encoded
    return F.when(F.length(c) <= most, c).otherwise(clip(c))


def uid(document: Column, chunk: Column) -> Column:
    return F.concat(document, F.lit("_"), chunk)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.]*$", "")


def fixed(c: Column, digits: int, least: int | None = None) -> Column:
    """A double with `digits` decimals (at least `least`, further zeros dropped), rounded half to even on its exact binary value: 2.675 gives 2.67, 0.0625 gives 0.062."""
    least = digits if least is None else least
    shape = "0" + ("." + "0" * least + "#" * (digits - least) if digits else "")
    return F.call_function("format_number", c.cast("double"), F.lit(shape))


def html_text(c: Column) -> Column:
    """The text of an HTML page: scripts, styles, comments and tags out, the five named entities read, blanks squeezed."""
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(c, rf"(?U)[{SPACE}]+", " "))
