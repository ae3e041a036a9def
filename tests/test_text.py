import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillvec.functions import text as T
from quillvec.operators.chunking import chunk, chunk_source
from quillvec.plans import corpus_sql

LONG_WORD = "x" * 1500
TWENTY_WORDS = " ".join(["word"] * 4) + "."  # 20 characters

EDGES = [
    "",
    "   \n\n \t ",
    "We met Mr. Smith today. He said hello to us.",
    "Use short forms e.g. this one here. Then carry on reading.",
    "exactly10c. exactly10c. nine c9c. twelve chars",
    "a" * 20,
    "a" * 21,
    "First block here is long enough.\n\nSecond block here is long enough.",
    "tiny\n\nOnly this block counts because the other one is tiny.",
    "One sentence only, without any break at all " + LONG_WORD,
    ("alpha " * 170).strip() + "x" * 5,
    ("beta " * 205).strip(),
    "y" * 1024,
    "y" * 1025,
    ("Longer sentence number one with many words in it. " * 40).strip(),
    "Separated\x1cby a file mark.\x1cNext sentence goes here now.",
    "Non breaking space here. Another sentence follows here.",
    "Emoji \U0001f600 sentence one is here. \U0001f600 Second sentence \U0001f600\U0001f600 is here!",
    "Does it split? Yes it does! And then it goes on and on",
    "Ends with abbreviation U.S. Army units are mentioned here.",
    "Spaces.    Many spaces follow the stop here.   And again here.",
    "Line one of text.\nLine two of text is here.\nLine three of text.",
    "Été Dr. Who came. Äl. Sometimes not. Naïve cafés abound here.",
    ("w" * 1023 + " ") * 3,
    " ".join(["z" * 600] * 5) + ". " + "short end of it all",
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(EDGES)))
    return con


def rows(df):
    return sorted((r.doc_id, r.pos, r.text) for r in df.select("doc_id", "pos", "text").collect())


@pytest.mark.parametrize(
    ("granularity", "options", "oracle"),
    [
        ("sentence", {}, "chunk_sentences"),
        ("paragraph", {}, "chunk_paragraphs"),
        ("paragraph", {"paragraph_delimiter": "\n"}, "chunk_paragraphs_delim"),
    ],
)
def test_edges_agree_with_sql(edges, duck, granularity, options, oracle):
    found = rows(chunk(edges, granularity, **options))
    wanted = duck.execute(corpus_sql.ORACLES[oracle]).df()[["doc_id", "pos", "text"]]
    assert found == sorted(wanted.itertuples(index=False, name=None))


def test_random_texts_agree_with_sql(spark):
    rng = random.Random(3)
    bits = ["Mr.", "e.g.", "U.S.", "Dr. ", "word", "Été", "ñandú", "9.5", "a_b.c.", "日本。", "?", "!",
            ".", "...", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\u00a0", "\u2003", "\x1d", "\u0085", ",",
            "Zx.", "zX.", "\U0001d538.", "x" * 90, "long words here and there " * 9]
    made = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 90))))
            for i in range(400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", made)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    for granularity, oracle in (("sentence", "chunk_sentences"), ("paragraph", "chunk_paragraphs")):
        wanted = con.execute(corpus_sql.ORACLES[oracle]).df()[["doc_id", "pos", "text"]]
        assert rows(chunk(df, granularity)) == sorted(wanted.itertuples(index=False, name=None))
    pieces = df.select("doc_id", F.posexplode(T.wrap(T.strip(F.col("text")))).alias("pos", "text"))
    wanted = con.execute(corpus_sql.ORACLES["chunk_wrap"]).df()[["doc_id", "pos", "text"]]
    assert rows(pieces) == sorted(wanted.itertuples(index=False, name=None))


def sentences_of(spark, text, **kw):
    return spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t"), **kw)).first()[0]


def test_abbreviations_do_not_end_sentences(spark):
    assert sentences_of(spark, "We met Mr. Smith today. He said hello.") == [
        "We met Mr. Smith today.",
        "He said hello.",
    ]
    assert sentences_of(spark, "Use e.g. this one here. Then stop reading.") == [
        "Use e.g. this one here.",
        "Then stop reading.",
    ]


def test_length_limits(spark):
    assert sentences_of(spark, "b" * 20) == []  # a block must exceed 20
    assert sentences_of(spark, "b" * 21) == ["b" * 21]
    ten, nine = "abcdefghi.", "abcdefgh."
    assert sentences_of(spark, f"{ten} {nine} {ten}") == [ten, ten]


def test_wrap_keeps_every_word(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(text,)], "t string")
    pieces = df.select(T.wrap(F.col("t"), 100)).first()[0]
    assert " ".join(pieces) == text
    assert all(len(p) <= 100 for p in pieces)


def test_wrap_hard_cut(spark):
    df = spark.createDataFrame([("q" * 2500,)], "t string")
    assert [len(p) for p in df.select(T.wrap(F.col("t"))).first()[0]] == [1024, 1024, 452]


def test_delimited_paragraphs_are_not_limited(spark):
    big = "p" * 3000
    df = spark.createDataFrame([(f"{big}\n\n{big}",)], "t string")
    assert df.select(T.paragraphs(F.col("t"))).first()[0] == [big, big]


def test_messages_pass_whole(spark):
    df = spark.createDataFrame([(0, "  hi. there. "), (1, " \x1c ")], "doc_id long, text string")
    assert rows(chunk_source(df, "messages")) == [(0, 0, "hi. there.")]


def test_unknown_granularity(edges):
    with pytest.raises(ValueError):
        chunk(edges, "word")


def test_chunking_needs_no_python(edges):
    plan = chunk(edges, "paragraph")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
