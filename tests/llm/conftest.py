import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: the same with columns whose names the operators use inside
CLASHING = SCHEMA + ", score double, size long, bucket int, `row` int, part int, kept boolean, level int, component long"


def corpus(seed=3, n=60):
    """Small documents with copies, near copies, shared passages, nulls, blanks and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeghilnorstuéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 30, 80, 200]))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [texts[7], texts[7], texts[11].upper()]
    for k in range(8):
        words = texts[10].split(" ")
        words[(k * 17) % len(words)] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [None, "", "  \n ", None, "a", "a a a a a a a a a a a a a a a a a a a a a a a a a", " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    return [(i, t, ("en", "de", None)[i % 3], ("s2", "s1", None, "s0")[i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus in shuffled order over several partitions, with clashing extra columns."""
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, True, 5, 6) for r in mixed], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def repeated(spark, docs):
    """Every row twice, and two rows without an id."""
    extra = spark.createDataFrame([(None, "no id here", None, None, None, 0.5, 1, 2, 3, 4, True, 5, 6), (None, None, None, None, None, 0.5, 1, 2, 3, 4, True, 5, 6)], CLASHING)
    return docs.unionByName(docs).unionByName(extra)
