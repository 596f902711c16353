"""Every operator on very long texts, on columns named like its own, on nulls in any column, and on repeated rows."""

import pytest
from pyspark.sql import functions as F

from epochal.llm import decontam, pii, quality, queries, rlz, rules, simhash, similar, suffixes, tokencount, tokens
from epochal.llm.packing import pack_binary

from .common import SF, odd_texts

NAMES = "_text __text _words _lines _w _b _s _z _y _f _i _c k1 k2 h at own content node root fingerprint n_words spans ids start piece anchor place score held_out text_key _id __id".split()


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def bench(spark):
    return spark.createDataFrame([(1, "what did the old baker sell in her small shop on the hill"), (2, None), (None, "a b c")], "item_id long, text string")


OPERATORS = {
    "packing": lambda s, d: pack_binary(d, queries.TOKENIZER, with_ids=False).drop("sequence_id"),
    "pii": lambda s, d: pii.find_personal_data(d),
    "rules": lambda s, d: rules.apply_policy(rules.ledger(d), "v3"),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "decontam": lambda s, d: decontam.contaminated(d, bench(s)),
    "tokens": lambda s, d: tokencount.count_tokens(d, queries.TOKENIZER),
    "bytes": lambda s, d: suffixes.remove_repeated_bytes(d),
    "words": lambda s, d: rlz.remove_repeated_words(d),
}


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_repeated_rows(spark, name):
    """Extra columns change nothing, whatever they are called and even if all of them are null."""
    docs = spark.createDataFrame([*enumerate(odd_texts()), (3, "a"), (3, "a"), (None, "no id"), (None, None)], "doc_id long, text string")
    more = docs
    for k, n in enumerate(NAMES):
        more = more.withColumn(n, F.lit(k) if k % 2 else F.lit(None).cast("string"))
    run = OPERATORS[name]
    want, got = rows_of(run(spark, docs)), rows_of(run(spark, more))
    assert got == want and (name in ("packing", "decontam") or len(want) == docs.count())


@pytest.mark.parametrize("keep", ["quality", "simhash", "similar", "decontam", "pii"])
def test_filters_keep_columns(spark, keep):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for k, n in enumerate(NAMES):
        docs = docs.withColumn(n, F.lit(k) if k % 2 else F.lit(None).cast("string"))
    got = {
        "quality": lambda: quality.keep_good(docs, labels(spark), max_documents=200),
        "simhash": lambda: simhash.keep_one(docs),
        "similar": lambda: similar.keep_one_similar(docs),
        "decontam": lambda: decontam.decontaminate(docs, bench(spark)),
        "pii": lambda: pii.redact(docs),
    }[keep]()
    rows = got.collect()
    assert got.columns == docs.columns and rows and all(r[n] == (k if k % 2 else None) for r in rows for k, n in enumerate(NAMES))


LONG = {"words": "word and other " * 100_000, "letters": "a" * 1_000_000, "lines": "x\n" * 200_000}


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, name):
    docs = spark.createDataFrame(list(enumerate(LONG.values())), "doc_id long, text string")
    rows = OPERATORS[name](spark, docs).collect()
    by = {r.doc_id: r for r in rows}
    if name == "packing":
        n = {k: len(tokens.encoder(queries.TOKENIZER).ids(t)) + 1 for k, t in enumerate(LONG.values())}
        assert {k: sum(r.length for r in rows if r.doc_id == k) for k in n} == n
    elif name == "tokens":
        assert [by[k].n_tokens for k in range(3)] == [len(tokens.encoder(queries.TOKENIZER).exact.encode(t, add_special_tokens=False)) for t in LONG.values()]
    elif name == "rules":
        assert [by[k].n_words for k in range(3)] == [300_000, 1, 200_000] and by[0].n_repeat_words == 300_000 and by[2].n_dup_lines == 199_999
    elif name == "bytes":
        assert [by[k].n_removed for k in range(3)] == [1_500_000, 1_000_000, 400_000]
    elif name == "words":
        assert [by[k].n_removed for k in range(3)] == [300_000, 0, 200_000]
    elif name == "simhash":
        assert [by[k].fingerprint for k in range(3)] == [f"{simhash.fingerprint(t):016x}" for t in LONG.values()]
    else:
        assert len(rows) == (0 if name == "decontam" else 3)


def test_quality_of_very_long_texts(spark):
    docs = spark.createDataFrame(list(enumerate(LONG.values())), "doc_id long, text string")
    train = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id > 2")
    got = quality.score(docs.unionByName(train), labels(spark), max_documents=200).where("doc_id <= 2").collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
