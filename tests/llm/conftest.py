from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def vocabulary(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeghilnorstuéüñ") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def awkward_texts() -> list[str | None]:
    """Nulls, blanks, ties, copies, near copies, shared passages, odd white space, a very long word and text."""
    rng = random.Random(7)
    vocab = vocabulary(400)

    def prose(n: int) -> list[str]:
        return [rng.choice(vocab) for _ in range(n)]

    base, passage = prose(150), " ".join(prose(60))
    out = [None, None, "", "   \n\t ", "one", "one two three", "A b c\x0bD", "x" * 900, "ab" * 2000,
           "<|endoftext|> is text, it's so  \n\n two   spaces ", "日本語 テキスト。 混ぜる café ＡＢＣ\r\n🙂 ok"]
    out += [" ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(12):
        near = list(base)
        for _ in range(1 + k % 4):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        out.append(" ".join(near))
    for _ in range(6):
        out.append(" ".join(prose(rng.randint(5, 40))) + "\n" + passage + "\n" + " ".join(prose(rng.randint(5, 40))))
    out += ["same line here\n" * 30 + " ".join(prose(20)), " ".join(prose(3000)), " ".join(prose(12)) + " ###" * 30]
    out += [" ".join(prose(rng.randint(1, 200))) for _ in range(30)]
    return out


@pytest.fixture(scope="session")
def texts():
    return awkward_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The awkward texts under unordered ids, with clashing extra columns."""
    ids = random.Random(3).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts)], DOCS)
    from pyspark.sql import functions as F
    return df.select("*", F.lit("x").alias("sketch"), F.lit(1).alias("kept"), F.lit("k").alias("key"),
                     F.lit(None).cast("string").alias("score"), F.lit(3).alias("n_words"), F.lit(2).alias("bucket"))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs) -> dict:
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
