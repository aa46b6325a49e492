import random

import pytest

RANDOM = random.Random(7)
WORDS = "the of river stone house green walks under light cold water seven never again bright moon falls over hill and dale".split()


def prose(n, rng=RANDOM):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, empties, odd white space and other scripts."""
    rng = random.Random(3)
    base = [prose(rng.randint(1, 120), rng) for _ in range(60)]
    passage = prose(40, rng)
    out = list(base)
    out += [base[k] for k in (0, 0, 1, 5)]
    for k in range(10, 22):
        words = base[k].split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [f"{base[k]} {passage} {base[k + 1]}" for k in range(30, 40)]
    out += ["", " ", "\n\t", None, "a", "a b", "A  B", "a b ", "x" * 300, "ab" * 200, "日本語 テキスト " * 30, base[3].upper(), base[3].replace(" ", "\n")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(3 * k + 1, t, None if k % 11 == 0 else "src%d" % (k % 4), "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, keep_id string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
