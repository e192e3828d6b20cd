import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns with names that the operators use inside.
CLASH = "_row string, _t string, _h1 string, _salt string, _size string, node string, gram string, band string, place string, size string, score double, _lines string, _gone string, spans string, ids string, r string, key string, _doc string, _digest string, spare array<string>"
VOCABULARY = [a + b + c for a in ("ba", "tor", "mi", "kel", "su") for b in ("na", "lo", "", "vin") for c in ("r", "st", "m", "ka")]


def prose(rng, words):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(words))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    plain = [prose(rng, n) for n in (3, 12, 60, 61, 200, 400)]
    texts = [None, "", " \n\t \x0b", "one", "two words", long, long, "x" * 100_000, "spam " * 20_000, "the same line again\n" * 4_000, "é" * 300 + " straße ÄÖ \U0001f600 <|endoftext|> ▁ <s>", *plain, plain[4], plain[5] + " more", "\n\n", "tail\n" + plain[3]]
    rows = [(i * 3, t, None if i == 2 else "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], rows[0], (None, plain[2], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a documents table with further columns of clashing names."""

    def make(rows):
        rows = [(*r, *["?"] * 10, 0.5, *["?"] * 8, ["?"]) for r in rows]
        return spark.createDataFrame(rows, f"{DOCUMENT}, {CLASH}")

    return make


@pytest.fixture(scope="session")
def texts_frame(frame):
    """Texts as documents with ids 10, 11 and so on, dealt over partitions."""
    return lambda texts, first=10: frame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]).repartition(3)


@pytest.fixture(scope="session")
def tables(spark, frame, tmp_path_factory):
    """Folders with documents and labels: odd rows, and none."""

    def write(name, rows, labels):
        at = tmp_path_factory.mktemp(name)
        frame(rows).repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        return str(at)

    odd = odd_rows()
    return {"odd": (write("odd", odd, [(3 * i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (6, None, None), (9, 0, 1), (9, 0, 1), (77_777, 0, 1)]), odd), "empty": (write("empty", [], []), [])}
