import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns whose names clash with results."""

    def build(rows, extra=True):
        full = [(*r, "en", "src0")[:4] if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("kept", "keep_id", "size", "id", "row", "digest", "fp", "text_hash", "shard", "n_words", "words", "blob", "rank", "copies", "quality", "toxic", "__id", "__hash", "__copy", "__digest", "__source", "__doc_id", "todo", "rules", "winner", "members"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows and ids, a very long text, ties."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "délta", "epsilon,", "password=abcdefghijkl1", "zeta", "0123456789abcdef01"]
    long_text = " ".join(rng.choice(words) + str(rng.randint(0, 5000)) for _ in range(60_000))
    line = "This line is long enough to be counted as a passage."
    lines = "\n".join([line, " " + line.upper() + "\t", "short", f"unique {line}"])
    return [
        (1, None, None, None),
        (2, "", "en", None),
        (3, "", None, "a"),
        (4, " \t\n\r ", "en", "a"),
        (None, "null id", "en", "a"),
        (None, "null id", "en", "a"),
        (5, lines, "en", "a"),
        (6, lines, "en", "b"),
        (7, lines, "de", "b"),
        (8, lines + "\n", "de", "b"),
        (9, "x\n" + line, "de", "b"),
        (10, lines, "de", "b"),
        (10, lines, "de", "b"),
        (10, "another text with the same id", "de", "b"),
        (11, long_text, "en", "c"),
        (12, "one", "en", "c"),
        (13, "<|endoftext|> ends <|endoftext|>", "en", "c"),
        (14, "  two  words\n\n\nand  more text ", "en", "c"),
        (15, "x" * 20_000, "en", None),
        (2**62, "large id", "en", "d"),
    ]
