"""Documents that go to the edges: nulls in every column, empty, blank and long texts, repeated rows, clashing columns."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "keep_id string, n_tokens string, ids string, score string, part string, run string, class string, bucket string, spans string, row string"
)


def documents(spark, rows):
    """Rows as (id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * 10))
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 9)))
    long = " ".join(word() for _ in range(9000))
    return [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n\x0b\x0c\r ", "fr", None),
        (5, long, "fr", "a"), (6, long + " end", "fr", "b"), (7, "The quick brown fox\njumps over the lazy  dog.", "en", None),
        (8, "The quick brown fox jumps over the lazy dog.", None, "c"), (8, "The quick brown fox jumps over the lazy dog.", None, "c"),
        (None, "no id here, 12345 <|endoftext|> x", "en", "a"), (None, None, None, None),
        (9, "日本語 ½ ١٢ \x85\x1c a\xa0b", "de", "c"), (10, "!!! ... 123 --", "de", "c"), (11, "x" * 700, "de", "c"),
        (12, "don't STOP we'll  see   it's\n\n ok ", "en", "d"), (13, "a", "es", "d"), (-14, "a b c d", "es", "d"),
    ]


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
