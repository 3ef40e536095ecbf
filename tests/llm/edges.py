"""Tables of awkward rows: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))

#: columns named like those the operators use inside
DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key long, fp long, value string, a long, b long, bucket int, "
    "place string, size int, quality int, keep string, item_id long, component_id long, spans string, score double, __id long, n int"
)
_REST = (None,) * (len(DOC_SCHEMA.split(",")) - 5)


def doc(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *_REST)


def documents(spark, rows=None):
    if rows is None:
        rows = [
            doc(1, "The quick brown fox jumps over the lazy dog again and again."), doc(2, None), doc(3, ""), doc(4, " \t\n"), doc(None, "An id is missing here."),
            doc(5, "The quick brown fox jumps over the lazy dog again and again."), doc(5, "The quick brown fox jumps over the lazy dog again and again."),
            doc(6, LONG, None, None), doc(7, f"before {PASSAGE} after one"), doc(8, f"other words here {PASSAGE} and more words"), doc(9, "1234 %%% ***", "de", None),
            doc(10, "Ünïcödé ñ 日本語 text 😀", "fr", ""), doc(None, None, None, None), doc(11, "x", "en", "t"), doc(5, "same id but quite another text than that of the others"),
        ]
    return spark.createDataFrame(rows, DOC_SCHEMA)
