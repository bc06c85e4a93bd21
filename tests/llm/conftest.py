import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed + i) % 5) for i in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, name string, lo long, items string, `a.b` int"


@pytest.fixture(scope="session")
def docs(spark):
    """Ordinary rows, copies, repeated rows, ties, nulls in every column, empty and very long texts, clashing column names."""
    rows = [(i, prose(i, 12 + i % 40), "en", f"s{i % 4}", i, 1.0, "n", 1, "x", 2) for i in range(60)]
    rows += [(100 + i, prose(3, 30), "en", "s0", i, None, None, None, None, None) for i in range(40)]  # copies
    rows += [rows[5], rows[5], rows[7]]  # repeated rows
    rows += [(None, prose(200, 20), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(200, None, "en", "s1", 0, 0.0, "", 0, "", 0), (201, "", "en", None, 0, 0.0, "", 0, "", 0), (202, " \n\t ", "de", "s1", 0, 0.0, "", 0, "", 0)]
    rows += [(203, prose(9, 30_000), "en", "s2", 1, 0.0, "", 0, "", 0), (204, "x" * 200_000, "en", "s2", 1, 0.0, "", 0, "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
