"""Every query over empty tables, nulls, repeated rows, very long texts and columns with clashing names."""

import random

import pytest

import corpus_pipeline
from cladeframe.llm import queries

KINDS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn int, role string, text string",
}
CLASHING = ("key", "kind", "bucket", "src", "payload", "row", "id", "size", "digest", "__key", "rep", "comp", "a", "b", "class")
TABLE = {name: "pages" if name.startswith("op7") else "conversations" if name.startswith(("op9", "op11")) else "documents" for name in queries.QUERIES}
QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}


def odd_rows():
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    long, text = words(70000), words(90)
    docs = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text, None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0)]
    docs += [(4, long, "en", "t", 1), (5, long + " end", "en", "t", 1), (6, "x" * 300000, "en", "t", 1), (None, None, None, None, None), (7, " \n\t", "en", "s", 3)]
    docs += [(i, words(60), "en", "s", 9) for i in range(8, 14)]
    pages = [(1, "u", text * 9), (1, "u", text * 9), (2, None, text * 9), (None, None, None), (3, "u\r\nv", long), (4, "u", "")]
    talks = [(1, 0, "user", text), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, None, None), (None, None, None, None), (3, 0, "assistant", "")]
    return {"documents": docs, "pages": pages, "conversations": talks}


def write(spark, folder, rows, extra=False):
    for name, kind in KINDS.items():
        frame = spark.createDataFrame(rows[name], kind)
        if extra:
            from pyspark.sql import functions as F

            frame = frame.withColumns({c: F.lit("clash") for c in CLASHING if c not in frame.columns})
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rows = odd_rows()
    made = {"empty": write(spark, tmp_path_factory.mktemp("empty"), {k: [] for k in KINDS})}
    made["odd"] = write(spark, tmp_path_factory.mktemp("odd"), rows)
    made["clash"] = write(spark, tmp_path_factory.mktemp("clash"), rows, extra=True)
    return made


def plain(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(spark, folders, name):
    # conversation -1 is the chat query's own
    assert QUERIES[name](spark, folders["empty"]).count() == (1 if name.startswith("op9") else 0)


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows_and_clashing_columns(spark, folders, name):
    got = plain(QUERIES[name](spark, folders["odd"]))
    assert got == plain(QUERIES[name](spark, folders["clash"]))
    if name in ("op8_best_fit", "pipeline"):  # a row for each piece
        assert got
    elif name == "op11_repair":
        assert len(got) == len({r[0] for r in odd_rows()["conversations"]})
    elif name == "op13_collocations":  # only the words of repeated texts are frequent, no phrase is
        assert not got
    else:
        rows = odd_rows()[TABLE[name]]
        assert len(got) == (len({r[0] for r in rows}) + 1 if name.startswith("op9") else len(rows))
