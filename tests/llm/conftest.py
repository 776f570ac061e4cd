import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import types as T

import tidemark

# workers of a test session need no copy of the package
cloudpickle.register_pickle_by_value(tidemark)

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion "
    "for the young king who lives beyond the misty mountains with his old and loyal friends"
)
#: Names that the operators use inside, as extra columns.
CLASHES = "row size unit block number copy shard key kept score possible bits cell t doc v root n part"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES.split()],
    ]
)


def doc(doc_id, text, source="a"):
    extra = dict.fromkeys(CLASHES.split(), "x")
    return Row(doc_id=doc_id, text=text, lang="en", source=source, n_chars=None, **extra)


def varied(i):
    words = PROSE.split()
    return " ".join(f"{w}{(i * 7 + k * k) % 97}" if k % 3 == i % 3 else w for k, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rows = [doc(i, varied(i), f"s{i % 4}") for i in range(30)]
    rows += [
        doc(100, PROSE),
        doc(101, "  " + PROSE.replace(" ", " \n\t")),  # equal once normalised
        doc(102, PROSE + " end"),  # near copy
        doc(103, None),
        doc(104, ""),
        doc(105, " \n\t "),
        doc(106, "short"),
        doc(106, "short"),  # the same row again
        doc(106, "another text under the same id"),
        doc(None, PROSE, None),
        doc(None, None, None),
        doc(107, "café über \U0001f600 " * 5, ""),
        doc(108, (PROSE + "\n") * 400, "long"),
        doc(109, "mail bob@example.com, call +1 (202) 555-0143, ip 10.0.0.1, card 4111 1111 1111 1111"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
