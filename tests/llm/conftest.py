import random

import pytest

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo wu".split() for b in "bel dor fin gat hum jol kim las".split()]
#: id, text of awkward rows: nulls, empty and blank texts, repeats, one very long text.
ODD = [
    (None, None), (None, "an id is missing here"), (1, None), (2, ""), (3, "   \n\t\n "), (4, "x"), (4, "x"), (5, "same id"), (5, "another text"), (6, "\x00​👍🏽 é <|endoftext|>"),
    (7, "\n".join("the same long line of text that comes again and again, number" for _ in range(5))), (8, " ".join("w%d" % (i % 997) for i in range(60_000))), (9, "a" * 50_000),
]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """id, text: prose with exact and near copies."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(0, 40, 4):
        rows.append((100 + i, base[i]))
        words = base[i].split()
        for k in range(6):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "zz%d" % rng.randrange(99)
            rows.append((200 + 10 * i + k, " ".join(copy)))
    return rows


@pytest.fixture(scope="session")
def table_of(spark):
    """Rows to a table with columns that clash with the operators' own names."""

    def make(rows, id_column="doc_id", text_column="text"):
        schema = f"{id_column} long, {text_column} string, key string, sum string, node int, n_words string, kept string, lang string, source string, n_chars long"
        return spark.createDataFrame([(i, t, "k", "s", 1, "w", "?", "en", "src", len(t or "")) for i, t in rows], schema)

    return make


@pytest.fixture
def folder(spark, table_of, tmp_path):
    """A folder of tables, as the queries read them."""

    def make(rows, benchmark=((1, "one two three four five six seven"),), pages=()):
        table_of(list(rows)).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return make
