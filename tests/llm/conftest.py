import random

import pytest

#: Texts that every operator must take: null, empty, blank, short, long, repeated, of any script.
ODD = [
    None, "", " \n\t ", "one", "two words", "a b c", "A B C", "x" * 5000, "word " * 3000, "tab\tseparated\x0bvertical\x0cfeed\rreturn", "ÄÖÜ straße naïve 你好 世界 🙂🙂",
    "no-break space and em space", "line\nline\nline\n\nother", "MIT License and Apache License", "<|endoftext|> special", "á combining", "#*$%&|<>" * 10,
]

SYLLABLES = "an er on the in re ti st of and ing ha to or nd th en ed is it".split()


def invented(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))))
        out.append("\n" if k % 17 == 16 else " ")
    return "".join(out)


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(SYLLABLES) + "x"
    return " ".join(words)


def corpus(seed: int = 1, n: int = 120) -> list[str | None]:
    """Invented texts with exact and near copies, shared passages and odd ones."""
    rng = random.Random(seed)
    base = [invented(rng, rng.randint(5, 160)) for _ in range(n)]
    passage = invented(rng, 40)
    out: list[str | None] = list(base)
    out += [rng.choice(base) for _ in range(n // 4)]
    out += [near(rng, rng.choice(base), rng.randint(1, 4)) for _ in range(n // 2)]
    out += [invented(rng, 30) + " " + passage + " " + invented(rng, 20) for _ in range(n // 4)]
    out += ODD + ODD
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
