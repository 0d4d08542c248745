"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over the text once and stops only at anchors: at-signs, plus signs, digits,
``://`` and words that announce an identifier. From an anchor a local parser walks outwards and settles the span's bounds,
then the span is validated. Base kinds give exactly the leftmost non-overlapping matches of their patterns:
a match can only start at the bounds its parser walks to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shiftledger.llm.common import id_and_text, ship, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DIGITS = re.compile(r"[0-9]+").match
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
#: Behind a scheme: a name or password before the host makes an address personal.
_USER_AT_HOST = re.compile(r"[^\s/?#@]+@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?").match
#: What stands between a cue and its value. White space is read once and never given back.
_TO_NUMBER = re.compile(r"[\x20\t]*+(?:number|no\.?|nr\.?|num\.?)?[\x20\t]*+[:=#]?[\x20\t]*+").match
_TO_VALUE = re.compile(r"[\x20\t]*+[:=][\x20\t]*+[\"']?").match
_NUMBER = re.compile(r"[A-Z]{0,2}[0-9]+(?:[\x20-]?[A-Z]*[0-9]+)*").match
_VALUE = re.compile(r"[A-Za-z0-9_/+=-]+").match
#: The longest account number that is looked at; 34 characters with a separator before each are the most that can be valid.
_NUMBER_CHARS = 80
_VALUE_CHARS = 12  # the shortest secret
_IBAN_CHARS = 34
_ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "ssn", "passport")
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(code: str) -> bool:
    """ISO 13616: country and check digits moved to the end, letters as 10 to 35, remainder 1 by 97."""
    code = re.sub(r"[\x20-]", "", code)
    return len(code) <= _IBAN_CHARS and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, "digit")
    automaton.add_word("@", "at")
    automaton.add_word("+", "plus")
    automaton.add_word("://", "scheme")
    for kind, cues in (("account", _ACCOUNT_CUES), ("secret", _SECRET_CUES)):
        for cue in cues:
            for spelling in {cue, cue.upper(), cue.capitalize()}:
                automaton.add_word(spelling, kind)
    automaton.make_automaton()
    return automaton


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind; code points, end exclusive."""
    found: set[tuple[int, int, int]] = set()
    email_end = ip_end = card_end = phone_end = digits_end = value_end = 0
    for at, what in _anchors().iter(text):
        if what == "digit":
            if at < digits_end:
                continue
            digits_end = _DIGITS(text, at).end()
            if at >= ip_end and (m := _IP(text, at)):
                ip_end = m.end()
                # Leading zeros may be many: compare as text before as numbers.
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    found.add((at, 1, ip_end))
            if at >= card_end and (m := _CARD(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.add((at, 2, card_end))
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN(text, at + 1)):
                email_end = m.end()
                found.add((start, 0, email_end))
        elif what == "plus":
            if at >= phone_end and (m := _PHONE(text, at)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.add((at, 3, phone_end))
        elif what == "scheme":
            start = at - 2
            while start and text[start - 1] in _SCHEME:
                start -= 1
            if start < at - 2 and (m := _USER_AT_HOST(text, at + 1)):
                found.add((start, 5, m.end()))
        elif what == "account":
            start = _TO_NUMBER(text, at + 1).end()
            # Cues may stand inside one another's numbers, so none reads far.
            m = _NUMBER(text, start, start + _NUMBER_CHARS + 1)
            if m and m.end() - start <= _NUMBER_CHARS:
                code = m.group()
                if code[:2].isalpha() and code[2:4].isdigit():
                    valid = iban(code)
                else:
                    valid = 6 <= sum(c.isdigit() for c in code) <= 34
                if valid:
                    found.add((start, 4, m.end()))
        elif m := _TO_VALUE(text, at + 1):
            start = m.end()
            if start >= value_end:  # else the run that holds the start is known already
                value_end = run.end() if (run := _VALUE(text, start)) else start
            if value_end - start >= _VALUE_CHARS:
                found.add((start, 6, value_end))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row; spans are an array of (kind, start, end) in order.

    Null, empty and blank texts have none. Rows that repeat are answered each for itself, ids may be null, other columns are ignored. Spans of
    different kinds may overlap, and a cue inside another's value adds a span with the same end; within a base kind they never overlap. Texts are read whole, in
    time that grows with their length: a run of any one character costs no more than other text. Account numbers of more than 80 characters are none.
    """
    kind = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)] for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found, shape)], names=["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, kind)


def masked(docs: DataFrame) -> DataFrame:
    """The rows with personal data masked in ``text`` and, where there is such a column, ``n_chars`` counted anew.

    Rows (repeated ones too), other columns and null texts stay as they are. Spans that overlap become one mask, named after the first.
    """
    ship(docs.sparkSession)
    schema = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = dict(zip(part.schema.names, part.columns))
            texts = [t if t is None else mask(t, find(t)) for t in part["text"].to_pylist()]
            columns["text"] = pa.array(texts, schema.field("text").type)
            if "n_chars" in columns:
                counted = [n if t is None else len(t) for t, n in zip(texts, part["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(counted, schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans and all spans as text."""
    say = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.concat_ws(",", F.transform(base, say)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", say)).alias("spans"),
    )
