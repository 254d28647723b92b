"""Small tables with the cases that every operator defines: nulls, empties, ties, repeats, clashing names."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, bucket int, score double, size long, tag string, "
          "chunk string, at int, kind string, component_id long, uid int")


def _words(rng, n):
    return [rng.choice("aeiou") + rng.choice("bcdfgklmnprst") * rng.randint(1, 2) + rng.choice(["", "ing", "ed", "or", "ßä", "é"]) for _ in range(n)]


def texts():
    """(doc_id, text) rows with copies, near copies, shared passages, secrets and edge cases."""
    rng = random.Random(5)
    base = [" ".join(_words(rng, rng.randint(30, 260))) for _ in range(40)]
    passage = " ".join(_words(rng, 60))
    rows = [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, base[3]) for i in range(6)]
    for i in range(12):
        w = base[5].split(" ")
        for _ in range(2):
            w[rng.randrange(len(w))] = "edited" + str(i)
        rows.append((300 + i, " ".join(w)))
    rows += [(400 + i, f"{' '.join(_words(rng, 40))}\n{passage}\n{' '.join(_words(rng, 30))}") for i in range(9)]
    rows += [(500, ""), (501, None), (502, None), (503, "one two"), (504, "ONE\tTwo"), (505, "   \n\t "), (506, "a" * 3000),
             (507, "Tion " * 700), (508, "\U0001F600 日本語 <|endoftext|> end's  \r\n\r\n WARC/1.1"), (509, "x"), (None, base[7]), (None, None),
             (510, "long " + " ".join(_words(rng, 4000))), (511, "a b c d e f g h"), (512, "A B C D E F G H i j k l"),
             (511, "a b c d e f g h"), (513, base[2] + " " + base[2]), (513, base[9])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from rankfold.llm.common import prepare

    prepare(spark)
    full = [(i, t, None, "s", None, 1, 0.5, 3, "t", "c", 0, "k", -1, 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
