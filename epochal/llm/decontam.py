"""Benchmark decontamination by template canonicalisation, in Spark's own functions only.

Texts and benchmark items become sequences of canonical words: punctuation around a word is dropped, case is folded, and
numbers, units and names become typed placeholders. Windows of ``WINDOW`` canonical words are hashed; the windows of all
documents are joined with those of the benchmark. Windows of one document and item that lie on one diagonal are one alignment,
and in it the values behind the placeholders must be consistent: a value of the item always meets the same value of the
document. So a question that was copied, or copied with other numbers and names, is found, and unrelated texts that share a
template are not.

Whether a word is a name depends on its case and on the word before, so every window has a second key, in which names are words
in lower case and only numbers and units are placeholders: copies in capitals, and copies that begin inside a sentence, share
it. Where numbers and units are more than two words in five, the second key is of the exact words in lower case, values included.
All windows of a document and item count together.

A document is contaminated by an item if consistent alignments cover ``LEAST_WINDOWS`` of the item's windows, or all where it
has fewer; for windows met by their template, of those that hold three literal words in five. Items of three to seven words are one window of their own length. Shorter items cannot be
told from common phrases inside a text; a document holds one if it has these words and no others. Items without words are left out. Null and empty texts match nothing. Rows that share a doc_id count as one document. Rows whose doc_id is
null count as one document for each text and appear with a null doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, text_of, unused, without

WINDOW, LEAST_ITEM, LEAST_WINDOWS = 8, 3, 5
#: Benchmark windows up to this number are broadcast.
BROADCAST_WINDOWS = 1_000_000
#: Units in the forms that texts use.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs hz khz mhz w kw v kb mb gb tb k c f usd eur gbp meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches feet foot gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degrees".split()
_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\\\]^_`{|}~¡¿«»“”‘’…–—"
_SEP = "\\u001f"


def _kind(literal: str, number: str, unit: str, name: str) -> str:
    """SQL of what stands for the word ``b`` at ``i`` of ``_b``, words without the punctuation around them; ``_w`` are the words.

    Comparisons of whole words against single characters look at the first byte alone, which spares a regular expression per
    word.
    """
    units = ", ".join(f"'{u}'" for u in UNITS)
    capital = "((b >= 'A' and b < '[') or (b >= 'À' and left(b, 1) != lower(left(b, 1))))"
    return (
        f"case when b >= '0' and b < ':' then {number} "
        f"when i > 0 and _b[i - 1] >= '0' and _b[i - 1] < ':' and lower(b) in ({units}) then {unit} "
        f"when {capital} and i > 0 and right(_w[i - 1], 1) not in ('.', '!', '?', ':') then {name} else {literal} end"
    )


def _bare(rows: DataFrame) -> DataFrame:
    words = r"filter(split(_text, '[ \\t\\n\\x0B\\f\\r]+'), w -> w != '')"
    clean = "((w >= 'a' and w < '{') or (w >= 'A' and w < '[') or (w >= '0' and w < ':') or (w >= 'À' and w < 'ɐ')) and right(w, 1) between 'a' and 'z'"
    return rows.withColumn("_w", F.expr(words)).withColumn("_b", F.expr(f"transform(_w, w -> if({clean}, w, btrim(w, '{_PUNCTUATION}')))"))


#: What stands for numbers, units and names in sequences of hashes.
_NUMBER, _UNIT, _NAME = 1, 2, 3
_FOLDED = f"if(s.z = {_NAME}, s.y, s.z)"


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``_text`` gain sequences of hashes: ``_z``, the canonical words; ``_y``, the words in lower case; and
    ``_f``, the canonical words with names as words. Words that were punctuation alone drop."""
    kind = _kind("xxhash64(lower(b))", f"{_NUMBER}L", f"{_UNIT}L", f"{_NAME}L")
    both = f"filter(transform(_b, (b, i) -> named_struct('z', {kind}, 'y', if(b = '', null, xxhash64(lower(b))))), s -> s.y is not null)"
    out = _bare(rows).withColumn("_s", F.expr(both)).drop("_w", "_b", "_text")
    return out.withColumn("_f", F.expr(f"transform(_s, s -> {_FOLDED})")).withColumn("_z", F.expr("_s.z")).withColumn("_y", F.expr("_s.y")).drop("_s")


def values(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``_text`` gain the same sequences as texts, ``_c`` and ``_x``, and ``_v``: the value behind each
    placeholder, null for other words."""
    kind = _kind("lower(b)", "'#number'", "'#unit'", "'#name'")
    made = f"filter(transform(_b, (b, i) -> named_struct('w', {kind}, 'v', lower(b))), c -> c.w != '')"
    out = _bare(rows).withColumn("_cv", F.expr(made)).drop("_w", "_b", "_text")
    value = "if(c.w in ('#number', '#unit', '#name'), c.v, null)"
    return out.withColumn("_c", F.expr("transform(_cv, c -> c.w)")).withColumn("_x", F.expr("transform(_cv, c -> c.v)")).withColumn("_v", F.expr(f"transform(_cv, c -> {value})")).drop("_cv")


def _valued(length: int) -> str:
    """Whether numbers and units are more than two words in five of a window; always so in windows below ``LEAST_ITEM``.

    The unit that a window may begin with is a word there, since it is a unit by the word before the window.
    """
    if length < LEAST_ITEM:
        return "true"
    held = [f"if(_f[_i] = {_NUMBER}, 1, 0)", *(f"if(_f[_i + {k}] between {_NUMBER} and {_UNIT}, 1, 0)" for k in range(1, length))]
    return f"({' + '.join(held)}) * 5 > {2 * length}"


def _windows(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """Every window of those lengths of the sequences of ``coded`` under its keys: keys, at, length, kind, h.

    Kind 0 is the template. Kind 1 takes names as words, or all words where ``_valued`` is true; it is left out where both are
    the same. Windows below ``LEAST_ITEM`` are whole sequences.

    Places are made first and windows hashed from them, in generated code; a lambda over windows would be interpreted. The outer
    form keeps the optimizer from making the sequences twice to filter.
    """
    rows = rows.selectExpr(*keys, "_z", "_y", "_f", "explode_outer(if(size(_z) = 0, cast(array() as array<int>), sequence(0, size(_z) - 1))) as _i").where("_i is not null")
    hashed, pairs = [], []
    for n in lengths:
        inside = f"_i + {n} <= size(_z)" if n >= LEAST_ITEM else f"size(_z) = {n} and _i = 0"
        folded = f"xxhash64(if(_f[_i] = {_UNIT}, _y[_i], _f[_i]), slice(_f, _i + 2, {n - 1}))"
        hashed += [f"if({inside}, xxhash64(_z[_i], slice(_z, _i + 2, {n - 1})), null) as _t{n}", f"if({inside}, if({_valued(n)}, xxhash64('=', slice(_y, _i + 1, {n})), {folded}), null) as _g{n}"]
        pairs += [f"_t{n}", f"if(_t{n} = _g{n}, null, _g{n})"]
    found = rows.selectExpr(*keys, "_i as at", *hashed).selectExpr(*keys, "at", f"posexplode(array({', '.join(pairs)})) as (_p, h)").where("h is not null")
    length = F.expr(f"array({', '.join(map(str, lengths))})[_p div 2]") if len(lengths) > 1 else F.lit(lengths[0])
    return found.select(*keys, "at", length.alias("length"), F.expr("_p % 2").alias("kind"), "h")


def _slots(at: str, length: int | str, kind: str) -> str:
    """The values behind the placeholders of a window under a kind of key; none for kind 2, exact words."""
    inside = f"transform(slice(_v, {at} + 2, {length} - 1), (v, i) -> if(_c[{at} + 1 + i] = '#name', null, v))"
    folded = f"concat(array(if(_c[{at}] = '#number', _v[{at}], null)), {inside})"
    return f"array_join(case {kind} when 0 then slice(_v, {at} + 1, {length}) when 1 then {folded} else cast(array() as array<string>) end, '{_SEP}')"


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _text_key() -> Column:
    """What tells rows with a null doc_id apart; the same for all others."""
    return F.when(F.col("doc_id").cast("long").isNull(), F.xxhash64(text_of())).otherwise(F.lit(0).cast("long"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document (doc_id) and item (item_id) that share consistent windows.

    n_windows: windows of the item that were met; item_windows: its windows; changed: some value behind a placeholder is another
    one; contaminated: as defined above.

    The pass over all texts makes hashes alone. Values are made in a second pass for the documents that have a hit.
    """
    return _keyed_matches(docs, benchmark).drop("text_key")


def _asked(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """The windows of all items: item_id, q_at, length, kind (2: exact words), h and the values behind them; and their lengths."""
    items = values(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("_text")))
    code = f"case c when '#number' then {_NUMBER}L when '#unit' then {_UNIT}L when '#name' then {_NAME}L else xxhash64(c) end"
    items = items.withColumn("_z", F.expr(f"transform(_c, c -> {code})")).withColumn("_y", F.expr("transform(_x, x -> xxhash64(x))")).withColumn("_f", F.expr(f"zip_with(_z, _y, (z, y) -> if(z = {_NAME}, y, z))"))
    items = items.withColumn("_n", F.expr(f"least(size(_c), {WINDOW})"))
    lengths = sorted(r["_n"] for r in items.select("_n").where("_n > 0").distinct().collect())  # at most eight numbers
    asked = None
    for n in lengths:
        literal = f"aggregate(slice(_c, q_at + 1, {n}), 0, (a, c) -> a + if(startswith(c, '#'), 0, 1)) * 5 >= {3 * n}" if n >= LEAST_ITEM else "false"
        own = _windows(items.where(f"_n = {n}"), ["item_id", "_c", "_v", "_z", "_y", "_f"], [n]).withColumnRenamed("at", "q_at").where(f"kind = 1 or {literal}")
        own = own.withColumn("_i", F.col("q_at")).withColumn("kind", F.expr(f"if(kind = 1 and {_valued(n)}, 2, kind)"))
        own = own.select("item_id", "q_at", "length", "kind", "h", F.expr(_slots("q_at", n, "kind")).alias("q_values"))
        asked = own if asked is None else asked.unionByName(own)
    if asked is None:
        asked = items.selectExpr("item_id", "0 as q_at", "0 as length", "0 as kind", "0L as h", "'' as q_values").limit(0)
    return durable(asked, "asked"), lengths or [WINDOW]


def _keyed_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``matches`` with ``text_key``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _id().alias("k1"), F.xxhash64(text_of()).alias("k2"), text_of().alias("_text"))
    asked, lengths = _asked(benchmark)
    few = asked.count() <= BROADCAST_WINDOWS
    found = _windows(coded(rows.drop("doc_id")), ["k1", "k2"], lengths).drop("length").withColumnRenamed("kind", "d_kind")
    # a row that came twice has its windows once
    hits = durable(found.join(F.broadcast(asked) if few else asked, "h").drop("h").withColumn("as_kind", F.greatest("kind", "d_kind")), "hits").distinct()
    ids = hits.select("k1", "k2").distinct()
    some = ids.count() <= BROADCAST_WINDOWS
    held = values(rows.join(F.broadcast(ids) if some else ids, ["k1", "k2"], "left_semi").select("k1", "k2", "doc_id", "_text")).dropDuplicates(["k1", "k2"]).drop("_x")
    # the values of each place once, however many items meet it: bounded by the document's words
    place = ["k1", "k2", "at", "length", "as_kind"]
    per = hits.select(*place).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "length", "as_kind")).alias("_h"))
    made = "transform(_h, h -> named_struct('at', h.at, 'length', h.length, 'as_kind', h.as_kind, 'values', %s))" % _slots("h.at", "h.length", "h.as_kind")
    met = held.join(per, ["k1", "k2"]).select("k1", "k2", "doc_id", F.expr(f"inline({made})"))
    hits = durable(hits.join(met, place).select("k1", "k2", "doc_id", "item_id", "q_at", "kind", (F.col("at") - F.col("q_at")).alias("diagonal"), "q_values", "values"), "alignments")
    key = ["k1", "k2", "item_id", "diagonal"]
    # in one alignment a value of the item meets one value of the document
    both = F.arrays_zip(F.split("q_values", _SEP).alias("q"), F.split("values", _SEP).alias("d"))
    met = hits.where("q_values != ''").select(*key, F.explode(both).alias("p")).select(*key, F.col("p.q").alias("q"), F.col("p.d").alias("d"))
    met = met.groupBy(*key, "q").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    slots = met.groupBy(*key).agg(F.max(F.expr("lo is distinct from hi")).alias("broken"), F.max(F.expr("q is distinct from lo")).alias("changed"))
    whole = hits.join(slots, key, "left").where("not coalesce(broken, false)")
    # windows of the item count once, in however many alignments they are met
    pairs = whole.groupBy("doc_id", F.expr("if(doc_id is null, k2, 0L)").alias("text_key"), "item_id").agg(
        F.count_distinct("q_at").alias("n_windows"), F.count_distinct(F.expr("if(kind = 0, q_at, null)")).alias("by_template"), F.coalesce(F.max("changed"), F.lit(False)).alias("changed")
    )
    sizes = asked.groupBy("item_id").agg(F.count_distinct("q_at").alias("item_windows"), F.count_distinct(F.expr("if(kind = 0, q_at, null)")).alias("templates"))
    enough = f"n_windows >= least({LEAST_WINDOWS}, item_windows) or (templates > 0 and by_template >= least({LEAST_WINDOWS}, templates))"
    return pairs.join(sizes, "item_id").select("doc_id", "text_key", "item_id", "n_windows", "item_windows", "changed", F.expr(enough).alias("contaminated"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents with the items they hold."""
    return matches(docs, benchmark).where("contaminated").drop("contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that hold no benchmark item."""
    own = unused(docs, "id", "text")
    found = _keyed_matches(docs, benchmark).where("contaminated").select(_id().alias(own[0]), F.col("text_key").alias(own[1]))
    return without(docs.withColumns({own[0]: _id(), own[1]: _text_key()}), found, own).select(*docs.columns)
