import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))



@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, columns named like the operators' own."""
    base = "the cat sat on the mat and looked at the dog over there in the garden while rain fell on the old house"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, base, "en", "s"), (2, base, "en", "s"), (2, base, "en", "s"), (3, None, "en", "s"), (4, "", None, None), (5, "  \n\t ", "en", None),
        (None, base, "en", "s"), (None, None, None, None), (6, long, "en", "s"), (7, long + " tail", "fr", "s"), (8, "a    b\n\nc\x00d\x0b", "fr", "s"),
        (9, "le chat est sur la table avec le chien et la maison", "fr", "s"), (10, "1234 5678 !!", "en", "s"), (11, base.replace(" ", "\n"), "en", "s"),
        (12, "中文 مرحبا \U0001f600", None, "s"), (13, base, "en", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["row", "fp", "n", "m", "id", "a", "b", "digest", "recipe", "t", "keep", "kept", "score", "component_id", "items", "ids", "k1", "y", "__h", "text_key", "slots"]
    for i, name in enumerate(clash):
        df = df.withColumn(name, __import__("pyspark").sql.functions.lit(i))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
