import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (
    "keep_id group_size kept rank node text_hash row copy _part gram slice k1 k2 k3 bucket component rows cells "
    "size p leaf entities token kind value original put hub u v low high key n rare piece length start pair"
).split()


def edge_rows():
    """Rows that go wrong easily: NULLs, blanks, very long texts, repeats, ties, hot sources and lines."""
    random.seed(5)
    word = lambda: "".join(random.choice(["ba", "ko", "lu", "mi", "re", "tan"]) for _ in range(random.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(9)
    base = [prose(60) for _ in range(6)]
    texts = [None, "", " \t\n\x0b ", "x", "\n\n", "ÀÉ naïve 日本語 😀 text", "Z" * 30000, prose(12000), "\n".join([shared] * 70 + ["own line"])]
    texts += [f"{shared}\n{prose(20)}\nend {i}" for i in range(4)]
    texts += base + base[:3] + [base[0].replace(" ", "  "), base[1] + " tail", base[2] + " one two", base[3].upper()]
    rows = [(i, t, ["en", "fr", None][i % 3], ["hot", "hot", "b", None][i % 4], 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, base[4], "en", "hot", 1), (None, None, None, None, None), (13, base[5], None, "b", None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return frame.withColumns({name: F.lit("clash") for name in CLASHING}).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


SMALL = "/root/testdata/sf0.001"
