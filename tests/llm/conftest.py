import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from duelbook.llm.common import prepare as prepare_llm

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_helpers import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns of other tables that operators might use for themselves.
CLASHING = ("node", "key", "component", "removal", "language_id", "score", "sequence_id", "shard", "slot", "host", "p", "row", "_doc", "_key", "text_key", "arc", "media")


@pytest.fixture(scope="session")
def llm(spark):
    return prepare_llm(spark)


def awkward_rows():
    """Nulls in every column, empty and white texts, a very long one, ties, repeated rows and ids."""
    rng = random.Random(5)
    base = words(rng, 60)
    long = words(rng, 40_000, 5000)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", None, None, None), (4, None, "de", "b", 0), (5, "", None, "b", 0),
        (6, " \t\n ", "fr", None, 4), (7, long, "en", "c", 9), (8, "one two three", "es", "c", 3), (9, "one two three", "es", "c", 3),
        (None, base, "en", "a", 1), (None, "only here " + words(rng, 30), None, None, None), (10, "Ärger, été! 日本語   naïve &lt; [x]", "xx", "d", 5),
        (2, words(rng, 20), "en", "a", 2), (11, "a" * 3000, "en", "e", 3000),
    ]


@pytest.fixture(scope="session")
def awkward(llm):
    df = llm.createDataFrame(awkward_rows(), SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def nothing(llm):
    return llm.createDataFrame([], SCHEMA)
