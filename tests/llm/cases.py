"""Small documents that are awkward in one way each, with clashing extra columns."""

import random
import re

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, n long"


def rows(pairs):
    return [(i, t, None, "s", None, 7, "x", -1) for i, t in pairs]


def docs(spark, pairs):
    return spark.createDataFrame(rows(pairs), DOCS)


def clashing(docs):
    """The same documents with columns called as helpers of the operators are."""
    names = ["_id", "_ID_", "_position", "_sha", "_doc_id", "component_id", "held", "part", "tree"]
    return docs.withColumns({name: F.lit(None).cast("bigint") for name in names})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]


def prose(rng: random.Random, n: int, letters="abcdefgé") -> str:
    return " ".join(
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)
    )


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Hello"),
    (5, "hello"),
    (6, "HELLO"),
    (6, "HELLO"),
    (None, "hello"),
    (None, "only without an id"),
    (7, "ÀB àb"),
    (8, "àB àb"),
    (9, "x" * 100_000),
    (10, "word " * 30_000),
    (11, "word " * 30_000),
    (12, "a b  c \x00d 🙂"),
]
