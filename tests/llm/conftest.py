import random

import pytest

#: Texts that every operator must bear: nulls, empty, white space, one word, repeats, odd signs, and a very long one.
EDGES = [None, "", "   \n\t", "word", "Two words", "a b c", "x" * 70_000, "<|endoftext|> and <|endoftext|>", "tab\tand\x0bvt\x1cfs é ü 漢字 \U0001f600", "One two. Three four!\n\nFive six?"]


def sentence(rng, n=9):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)).capitalize() + "."


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    texts = [" ".join(sentence(rng) for _ in range(rng.randint(4, 25))) for _ in range(n)]
    texts += texts[:4]  # exact copies
    for t in texts[4:10]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts.append(" ".join(sentence(rng) for _ in range(900)))  # a long one
    return texts + EDGES


@pytest.fixture(scope="session")
def rows():
    return [(i, t, ["s0", "s1", None][i % 3]) for i, t in enumerate(corpus())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with columns that clash with names the operators use, a row without id, and one row twice."""
    more = [(None, rows[0][1], "s0"), rows[5], rows[5]]
    return spark.createDataFrame([(*r, 7, "b", 0.5) for r in [*rows, *more]], "doc_id long, text string, source string, n_tokens int, band string, rank double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
