import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


def lower(text):
    """A-Z alone in lower case."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Nulls, empty and long texts, repeats, and columns that clash with those the operators use.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again until it is night in the town", "en", "a", 5),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "the quick brown fox jumps over the lazy dog again and again until it is night in the town", "en", "a", 5),
    (4, "other words under the same id", "en", None, 1),
    (None, "the quick brown fox jumps over the lazy dog again and again until it is night in the town", "de", "b", 5),
    (5, "word " * 30000, "en", "b", 150000),
    (6, " \n\t ", "en", "b", 3),
    (7, "Élan ÀB straße 日本語 the quick brown fox jumps over the lazy dog again and again until x", "fr", "b", 9),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("tag", "spans", "block", "shard", "slot", "score", "label", "fp", "n_words", "bucket", "record", "tokens", "rate", "ids", "component_id")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, COLUMNS).select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
