"""The queries of this subpackage over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .shared import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_binary

    return pack_binary(table(spark, sf_dir, "documents"), TOKENIZER, max_length=2048, end_id=1, with_ids=False)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_policy, ledger

    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), "v3")
    base = "failed & 3 != 0"
    return rows.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{base} as base_failed", "kept", "failed")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, limit=512)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeated_bytes

    return remove_repeated_bytes(table(spark, sf_dir, "documents"), window=400)


def op9_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rlz import remove_repeated_words

    return remove_repeated_words(table(spark, sf_dir, "documents"), window=35)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(spark, table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_personal_data": op2_personal_data,
    "op3_rule_ledger": op3_rule_ledger,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_suffix_repeats": op8_suffix_repeats,
    "op9_substring_repeats": op9_substring_repeats,
    "op10_warc": op10_warc,
}
_WHITE = r"[ \t\n\x0B\f\r]+"
ORACLE_SQL: dict[str, str] = {
    "op3_rule_ledger": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '{_WHITE}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
        g AS (SELECT r, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] || chr(10) || w[i+3] || chr(10) || w[i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
        h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
        p AS (SELECT r, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM h) GROUP BY r),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WHITE}', '', 'g')) AS BIGINT) AS word_chars,
              CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
              coalesce(p.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
              length(t) - length(replace(t, '!', '')) AS n_exclaims FROM w LEFT JOIN p USING (r)),
        f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
              + CASE WHEN 2 * n_upper > n_letters AND n_letters > 0 THEN 8 ELSE 0 END + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END
              + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 95 = 0 AS kept, failed FROM f
    """,
    "op8_suffix_repeats": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        g AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS g FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)),
        h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
        s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM h)) GROUP BY r, run),
        e AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
        t AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM e JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
    """,
    "op9_substring_repeats": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_WHITE}'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
        c AS (SELECT DISTINCT r, i + k AS p FROM h, (SELECT unnest(range(35)) AS k)),
        u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN c USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, CASE WHEN n >= 1000 AND count(*) OVER (PARTITION BY d) > 1 THEN max(page_id) OVER (PARTITION BY d) END AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
    """,
}
