"""Text columns: names, keys, slugs, search and contact rules.

Everything here is a native column expression, except ``strip_accents_exact``, the same by the Unicode library.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shiftledger.functions.domain import MISSING_DISPLAY
from shiftledger.session import ship_with_tasks

ship_with_tasks(__name__)

# Every character that counts as white space in a name.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# The accent map of the operator key.
KEY_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ"
KEY_PLAIN = "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC"

# Display class per status, keyed by the lower-cased status.
STATUS_CLASS = {
    "realizado total": "ok",
    "realizado parcial": "warn",
    "não realizado": "danger",
    "nao realizado": "danger",
    "não se aplica": "muted",
    "nao se aplica": "muted",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def none_if_blank(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_token(c: Column | str) -> Column:
    blanks = F.translate(strip(c), WHITESPACE, " " * len(WHITESPACE))
    return F.substring_index(blanks, " ", 1)


def operator_key(c: Column | str) -> Column:
    """First token, unaccented and lower-cased; '' for a null or blank name."""
    return F.coalesce(F.lower(F.translate(first_token(c), KEY_ACCENTED, KEY_PLAIN)), F.lit(""))


def match_key(c: Column | str) -> Column:
    """Trimmed upper-case raw text: the key that plan and records are matched on."""
    return F.upper(F.coalesce(strip(c), F.lit("")))


def _plain(text: str) -> str:
    """Full decomposition (NFKD) without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for ``translate``: letters with one plain base, then the marks to delete; and the letters that become several."""
    letters, bases, marks, several = [], [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        base = _plain(char)
        if base == char:
            continue
        if len(base) == 1:
            letters.append(char)
            bases.append(base)
        elif base:
            several[char] = base
        else:
            marks.append(char)
    return "".join(letters + marks), "".join(bases), several


def _ranges(chars: list[str]) -> str:
    """The characters as the inside of a regex class."""
    codes, out = sorted(map(ord, chars)), []
    start = last = codes[0]
    for code in [*codes[1:], None]:
        if code != last + 1 if code is not None else True:
            out.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = code
        last = code
    return "".join(out)


_COMMON = 0x2100  # most names use characters below this one only


def strip_accents(c: Column | str) -> Column:
    """Remove accents natively: NFKD without combining marks, over all of Unicode.

    Plain names stay, and names of common characters go through a short table of ``translate``. The table of all letters, and
    the replacement one by one of ligatures, syllables and other letters that become several, are only for the names that need them.
    """
    accented, plain, several = _accent_tables()
    name, many = _col(c), _ranges(list(several))
    lower = [(a, plain[i] if i < len(plain) else "") for i, a in enumerate(accented) if ord(a) < _COMMON]
    lower.sort(key=lambda pair: not pair[1])  # marks to delete come last
    common = F.translate(name, "".join(a for a, _ in lower), "".join(p for _, p in lower))
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    pieces = F.regexp_extract_all(name, F.lit(f"([{many}]|[^{many}]+)"), F.lit(1))
    spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    rare = F.when(name.rlike(f"[{many}]"), spelled).otherwise(name)
    is_common = name.rlike(rf"^[\x00-\x{{{_COMMON - 1:x}}}]*$") & ~name.rlike(f"[{many}]")
    return F.coalesce(
        F.when(name.rlike(r"^[\x00-\x7f]*$"), name).when(is_common, common).otherwise(F.translate(rare, accented, plain)), F.lit("")
    )


@F.pandas_udf(StringType())
def strip_accents_exact(names: pd.Series) -> pd.Series:
    """Full NFKD decomposition without combining marks (ligatures, Hangul and so on)."""

    return names.map({n: _plain(n) for n in names.dropna().unique()}).fillna("")


def slug(c: Column | str) -> Column:
    """Unaccented lower-case letters and digits only."""
    return F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]", "")


def space_token(c: Column | str) -> Column:
    """Text before the first blank of the untrimmed name."""
    return F.substring_index(_col(c), " ", 1)


def matches(c: Column | str, term: str) -> Column:
    """Case-insensitive search; the term is a regular expression; null never matches."""
    return F.coalesce(_col(c).rlike("(?iu)" + term), F.lit(False))


def username_clean(c: Column | str) -> Column:
    lowered = F.replace(F.lower(strip(F.coalesce(_col(c), F.lit("")))), F.lit(" "), F.lit("_"))
    return F.regexp_replace(lowered, r"[^\p{L}\p{N}_]", "")


def email_valid(c: Column | str) -> Column:
    """'@' present and '.' in the part after the last '@'; an empty address is accepted."""
    address = strip(c)
    shaped = address.contains("@") & F.substring_index(address, "@", -1).contains(".")
    return F.coalesce((_col(c) == "") | shaped, F.lit(True))


def title_name(c: Column | str) -> Column:
    """Capitalize every run of letters."""
    runs = F.regexp_extract_all(F.lower(strip(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def initials(c: Column | str) -> Column:
    """First letters of the first two words; 'U' without a name."""
    words = F.slice(F.split(title_name(c), r"\s+"), 1, 2)
    letters = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.coalesce(F.nullif(letters, F.lit("")), F.lit("U"))


def display_value(c: Column | str) -> Column:
    """Text for a table cell; the dash for missing values and their spellings."""
    text = strip(c)
    missing = text.isNull() | F.lower(text).isin("", "nan", "none", "nat")
    return F.when(missing, MISSING_DISPLAY).otherwise(text)


def status_class(c: Column | str) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(STATUS_CLASS), F.lower(strip(c))), F.lit("muted")
    )
