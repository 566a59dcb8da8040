"""Small inputs and brute-force helpers of the llm tests."""
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def edge_docs(spark, extra=()):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "one two", "en", None, 7),
            (5, long, "en", "b", len(long)), (6, long, "en", "b", len(long)), (None, "no id here at all", "de", "b", None),
            (7, "same row", "en", "a", 8), (7, "same row", "en", "a", 8), *extra]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
