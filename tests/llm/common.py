"""Documents that try what an operator may meet, and the words rule in plain Python."""

import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("key", T.LongType()), T.StructField("_text", T.StringType())])


def odd_texts():
    return [
        None,
        "",
        " ",
        "\n\n \t",
        "a",
        "One two three four five six seven.",
        "x " * 3000,
        "the cat  sat\n on the\r\nmat  \t end ",
        " leading and trailing ",
        "tabs\tand\x0bother\x0cwhite space   here",
        "Ünïcödé wörds ñandú straße ½ ² ª º \U0001f600 漢字 русский",
        "it's they'll I'd we've 'quoted' 12345 6_7 a_b __x__",
        "special <|endoftext|> inside",
        "control \x00 \x1c \x85 chars",
        "#*$%&|<> " * 5,
        "line\nline\nline\n\nother\nline",
        "a b c d e f a b c d e f g a b c d e",
        "mail a.b@c.de or x@y, 1.2.3.4 and 300.1.1.1, 4111 1111 1111 1111 and +1 (555) 123-4567.",
    ]


def frame(spark, texts, start=0):
    """Rows with extra columns whose names clash with names used inside operators."""
    return spark.createDataFrame([(i + start, t, "en", 7, "own") for i, t in enumerate(texts)], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample_texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
