import pytest
from cases import LONG, make


@pytest.fixture(scope="session")
def odd_rows():
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "Hello world, it's 42 naïve cafés!"), (5, "hello World, it's 42 naïve cafés!"),
        (6, LONG), (7, LONG), (8, "漢字 🙂   x"), (4, "Hello world, it's 42 naïve cafés!"), (None, "no id"), (9, "ÉCOLE"), (10, "école"), (11, "<|endoftext|> <s>"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
