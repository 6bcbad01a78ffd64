import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words string, _row int, path string, node int, size int"


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def given(real):
    """doc_id -> text of the small table."""
    return {r.doc_id: r.text for r in real.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, ties, repeated rows, a long text, and extra columns with clashing names."""
    prose = " ".join(f"word{i} and thing{i * 7 % 31}" for i in range(60))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, prose), (6, prose), (6, prose), (7, "token = 'abcDEF123456'"), (8, "é" * 50 + " 日本語 12!"),
             (None, prose), (None, None), (9, " ".join(f"w{i % 997}x{i}" for i in range(40_000))), (10, "x" * 30_000), (11, "<|endoftext|> a<|endoftext|>b")]
    rows = [(i, t, None if k % 3 else "en", None, None if t is None else len(t), None, None, 5, None, None, 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
