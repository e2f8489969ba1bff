import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, salt string, n_words long, token string, component_id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    prose = " ".join(word * 6)
    extra = (1, "x", 2, "t", 3)
    rows = [
        (1, prose, "en", "src0", 10, *extra),
        (1, prose, "en", "src0", 10, *extra),
        (2, prose.upper(), "en", "src0", 10, *extra),
        (3, None, None, None, None, *extra),
        (None, prose + " more", "de", None, None, *extra),
        (4, "", "xx", "src1", 0, *extra),
        (5, " \n\t\x0b\x0c\r ", "fr", "src2", 7, *extra),
        (6, "é ñ 漢字 <|endoftext|> ▁ \x00 token=abcdef123  ", "es", "src3", None, *extra),
        (7, "lone", "en", "src3", 4, *extra),
        (8, "lone", "en", "src3", 4, *extra),
        (9, "The cat sat on the mat, and that is it. " * 20_000, "en", "src0", None, *extra),
        (10, "\n".join(f"w{k} the of and to a in w{k * 7} that it was" for k in range(400)), "en", "src11", None, *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
