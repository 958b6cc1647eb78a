import random
import re

import pytest

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=120):
    """Rows with the cases that every operator has to stand: nulls, empty, very long, equal, near-equal and repeated."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in", "is"] * 20 + [f"w{i}x" for i in range(400)] + ["Straße", "ÉTÉ", "ñandú"]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)) + "."
    common = sentence(30)
    texts = []
    for i in range(n):
        lines = [sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), common)
        texts.append("\n".join(lines))
    for i in range(0, n, 5):  # near copies with a word or a few changed
        w = texts[i].split(" ")
        for _ in range(rng.randint(1, 1 + len(w) // 30)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + ["", None, "   \n\t ", "one", "one two", "a b c", "same " * 60, "\n".join(["the same line of words"] * 5), " ".join(f"long{i % 977}" for i in range(30_000)), "x" * 5000]
    texts += ["a b c\x0bd\x0ce\rf", "!!! *** ||| $$$ " * 20, "ALL CAPS TEXT!! " * 30]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 3, texts[j], [None, "en", "fr"][j % 3], [None, "a", "b", "b", "b", "B"][j % 6], len(texts[j] or "")) for i, j in enumerate(order)]
    return rows + [rows[7], (None, texts[1], "en", "a", 5), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with more columns, named like what the operators make or use."""
    from pyspark.sql import functions as F

    names = ["_row", "_size", "_copies", "_src", "score", "_score", "kept", "host", "rule", "shard", "slot", "d", "t", "n", "token", "item_id", "_item", "_doc", "_hash", "_gone", "_lines", "_bad", "removed_lines", "component_id", "node", "_w", "_m", "_n", "_id", "x", "job"]
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
