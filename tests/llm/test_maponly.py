"""Packing, token counts, rules and personal data against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from epochal.llm import pii, queries, rules
from epochal.llm.packing import binary_lengths, pack_binary
from epochal.llm.tokencount import count_tokens

from .common import SF, frame, odd_texts, sample_texts, words

EXACT = Tokenizer.from_file(queries.TOKENIZER)


def corpus(spark):
    docs = [(i, t) for i, t in enumerate(odd_texts())] + [(i + 1000, t) for i, t in sample_texts(spark)]
    return docs, frame(spark, odd_texts()).select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in docs if i >= 1000], "doc_id long, text string"))


def test_packing_equals_library(spark):
    docs, df = corpus(spark)
    rows = {}
    sequences = set()
    for r in pack_binary(df, queries.TOKENIZER, with_ids=True).collect():
        rows.setdefault(r.doc_id, []).append(r)
        assert r.sequence_id not in sequences and r.offset == 0 and r.length == 1 << r.bucket <= 2048
        sequences.add(r.sequence_id)
    for i, t in docs:
        ids = EXACT.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(rows[i], key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_binary_lengths():
    assert binary_lengths(1, 8) == [1] and binary_lengths(27, 8) == [8, 8, 8, 2, 1] and sum(binary_lengths(12345, 2048)) == 12345
    with pytest.raises(ValueError):
        pack_binary(None, "", max_length=1000)


def test_counts_equal_library(spark):
    docs, df = corpus(spark)
    got = {r.doc_id: r for r in count_tokens(df, queries.TOKENIZER, cache_entries=50).collect()}
    for i, t in docs:
        n = len(EXACT.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), (i, t)


def test_minus_signs_and_disguised_domains(spark):
    texts = ["call +1 555\u2212123\u22124567 now", "card 4111\u22121111\u22121111\u22121111", "write jane at ex\u0430mple.com", "look at example.com", "meet at the caf\u00e9 or at example.com"]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert got[0].startswith("phone:5:") and got[1].startswith("card:5:") and got[2] == "email:6:25" and not got[3] and not got[4]


def test_both_tiers(spark):
    """Tier one holds lengths of frequent pre-tokens of every script, and counts do not depend on what the tiers hold."""
    from epochal.llm import tokencount

    texts = ["the straightforwardness of it " * 5, "привет мир 你好 " * 7, "ก ข ค привет", "a <|endoftext|> b", "x\u2003y", "Ġ natural", ""]
    plain, exact = tokencount.frequent_lengths(frame(spark, texts), queries.TOKENIZER)
    assert plain[" straightforwardness"] > 1 and any(n > 1 for n in exact.values()) and len(exact) > 5
    for sample in (0, 1, 2000):
        got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, texts), queries.TOKENIZER, sample_documents=sample).collect()}
        assert got == {i: len(EXACT.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def brute_rules(t):
    t = t or ""
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    docs, df = corpus(spark)
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(df), "v1").collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), (i, t)
        assert r.kept == (r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words)


def test_ablation(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (3,), (2,), (16,)], "failed long")
    got = {r.rule: r for r in rules.ablation(df, "v1").collect()}
    assert (got["few_words"].n_failed, got["few_words"].n_only, got["few_words"].n_kept_without) == (3, 2, 4)
    assert (got["repeated_windows"].n_failed, got["repeated_windows"].n_only, got["repeated_windows"].n_kept_without) == (2, 1, 3)


def brute_base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_rules_equal_patterns(spark):
    import random

    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "@", ".", "1", "25", "+", "-", " ", "(", "x", "4111111111111111", "@b.c", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(20000)]
    for t in made + [t or "" for t in odd_texts()] + [t for _, t in sample_texts(spark)]:
        assert pii.find_base(t) == brute_base(t), t


def test_personal_data_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op2_personal_data"](spark, SF).collect()}
    for i, t in sample_texts(spark):
        base = brute_base(t)
        assert got[i].base_sha256 == hashlib.sha256(pii.join_spans(base).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write to jane.doe (at) example (dot) com now", 0, "jane.doe (at) example (dot) com"),
        ("write to jane at example dot com now", 0, "jane at example dot com"),
        ("write to jane [at] mail[dot]example[dot]org.", 0, "jane [at] mail[dot]example[dot]org"),
        ("mail jаne@exаmple.com today", 0, "jаne@exаmple.com"),
        ("call +1 five five five one two three four five six seven please", 3, "+1 five five five one two three four five six seven"),
        ("call plus one 555 123 4567 please", 3, "plus one 555 123 4567"),
        ("card ４１１１１１１１１１１１１１１１ ok", 2, "４１１１１１１１１１１１１１１１"),
        ("host one nine two dot 168 dot one dot one up", 1, "one nine two dot 168 dot one dot one"),
        ("zero​width a​b@c​d.com", 0, "a​b@c​d.com"),
    ],
)
def test_disguises_map_back(text, kind, found):
    spans = pii.find_disguised(text, pii.find_base(text))
    assert [text[s:e] for s, k, e in spans if k == kind] == [found]


def test_disguises_reach_query_and_redaction(spark):
    card, signs = "4111{0}1111{0}1111{0}1111", ["\u00a0", "\u202f", *map(chr, range(0x2000, 0x200B)), "\ufe63"]
    texts = [f"card {card.format(c)} ok" for c in signs] + [f"jane{at}example{dot}com" for at, dot in ("\ufe6b.", "@\ufe52")]
    texts += ["card " + "".join(chr(zero + int(d)) for d in "4111111111111111") for zero in (0x09E6, 0x0E50, 0x1040)]
    texts += ["jane\u2028dot\x0bdoe\u2028at\u2028example\u2028dot\u2028com", "call plus one (555) 123-4567", "call +one (555) 123-4567", "one\x0btwo f\u0131ve s\u0130x"]
    df = frame(spark, texts)
    got = {r.doc_id: r.n_disguised for r in pii.find_personal_data(df).collect()}
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == 1 and "[" in masked[i], (t, got[i], masked[i])
    assert got[len(texts) - 1] == 0


def test_every_changed_character_opens_the_gate():
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    opened = pc.match_substring_regex(pa.array(chars), pii.disguise_pattern()).to_pylist()
    assert opened == [pii._plain_char(c) != c for c in chars]


def test_clean_text_has_no_spans(spark):
    for t in ["meet me at the dot of noon", "one two buckle my shoe", "look at example.com", "Seven of nine at dot"]:
        assert pii.find_disguised(t, pii.find_base(t)) == [], t
    for i, t in sample_texts(spark):
        assert pii.find_disguised(t, pii.find_base(t)) == [], t


def test_redact_keeps_other_columns(spark):
    df = frame(spark, [*odd_texts(), "x a@b.cd y"])
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[len(odd_texts())].text == "x [EMAIL] y" and got[0].text is None and {(r.key, r["_text"]) for r in got.values()} == {(7, "own")}


def test_empty_tables(spark):
    df = frame(spark, [])
    assert pack_binary(df, queries.TOKENIZER).count() == count_tokens(df, queries.TOKENIZER).count() == rules.ledger(df).count() == pii.find_personal_data(df).count() == pii.redact(df).count() == 0
