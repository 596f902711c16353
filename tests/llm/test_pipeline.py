"""The pipeline's stages against brute force on a small table, and what it does with odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from epochal.llm import pii, quality, simhash
from epochal.llm.queries import TOKENIZER
from epochal.llm.tokens import encoder

from .common import SF, frame, odd_texts
from .test_simhash import brute_components, brute_fingerprint
from .test_similar import brute_kept


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    good = by_name["quality"](spark, docs, SF)
    scored = {r.doc_id: r.predicted for r in quality.score(docs, labels).collect()}
    rows = good.collect()
    assert good.columns == docs.columns and {r.doc_id for r in rows} == {d for d, p in scored.items() if p == 1}
    one = by_name["near_duplicates"](spark, good, SF)
    kept = one.collect()
    assert one.columns == docs.columns and sorted(r.doc_id for r in kept) == brute_kept([(r.doc_id, r.text) for r in rows])
    clean = by_name["decontamination"](spark, one, SF)
    texts = {r.doc_id: " ".join(r.text.split()) for r in kept}
    leaks = {d for d, t in texts.items() for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if " ".join(b.text.split()) in t}
    left = clean.collect()
    assert clean.columns == docs.columns and leaks and not leaks & {r.doc_id for r in left} and len(left) >= len(kept) - 2 * len(leaks) - 3
    private = by_name["personal_data"](spark, clean, SF)
    masked = {r.doc_id: r for r in private.collect()}
    assert private.columns == docs.columns and set(masked) == {r.doc_id for r in left}
    for r in left:
        found = pii.find_base(r.text)
        assert not pii.find_base(masked[r.doc_id].text) and masked[r.doc_id].n_chars == len(masked[r.doc_id].text)
        assert (masked[r.doc_id].text == r.text) == (not found)
    pieces = by_name["packing"](spark, private, SF).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids.setdefault(p.doc_id, []).extend(p.ids)
    assert ids == {d: [*encoder(TOKENIZER).exact.encode(r.text, add_special_tokens=False).ids, 1] for d, r in masked.items()}


def test_stages_with_clashing_names(spark):
    """Columns whose names operators use for themselves come through every stage as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_text", "__text", "_id", "__id", "content", "_content", "root", "text_key", "k1", "k2", "h"]
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    left = kept.collect()
    assert len(left) > 50 and all(r[n] == i for r in left for i, n in enumerate(names))


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    drop = lambda df: sorted(map(str, df.drop("sequence_id").collect()))
    assert drop(docs) == drop(corpus_pipeline.run(spark, SF))


def test_keep_one_of_odd_rows(spark):
    texts = [*odd_texts(), "One two three four five six seven.", None, "ONE two three four five six seven."]
    df = frame(spark, texts).unionByName(frame(spark, ["a", "a"], 4)).unionByName(frame(spark, ["another text of its own, said twice"] * 1, 900)).unionByName(frame(spark, ["another text of its own, said twice"], 900))
    df = df.unionByName(frame(spark, ["no id one two three"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = df.collect()
    prints = [((r.doc_id if r.doc_id is not None else 10**9), brute_fingerprint(r.text)) for r in rows]
    want = brute_components(prints)
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 10**9) for r in kept) == sorted({want[f] for _, f in prints})
    assert simhash.keep_one(df).columns == df.columns
