"""Benchmark leaks: copies, copies with other values, and texts that only look alike."""

import random

from pyspark.sql import functions as F

from epochal.llm import decontam

from .common import SF, frame, odd_texts, words

ITEM = "Yesterday the baker Anna sold 12 loaves at 3 euros each and then bought 5 kg of flour for her small shop in town, how much money did Anna keep?"


def found(spark, texts, items=(ITEM,)):
    bench = spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(items)], "item_id long, text string, _c int")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(frame(spark, texts), bench).collect()}


def test_copies_and_changed_copies(spark):
    changed = ITEM.replace("Anna", "Berta").replace("12", "40").replace("3 euros", "9 dollars").replace("5 kg", "7 lb")
    broken = ITEM.replace("baker Anna", "baker Berta").replace("did Anna", "did Clara")
    texts = [*odd_texts(), "Before. " + ITEM + " After that nothing.", changed, ITEM.upper(), ITEM.replace(" ", "&&& "), broken, "the baker sold loaves at a price and then bought flour for the shop"]
    n = len(odd_texts())
    got = found(spark, texts)
    assert {k[0] - n for k in got if k[0] >= n} >= {0, 1, 3} and not any(k[0] < n or k[0] == n + 5 for k in got)
    assert got[(n, 100)].n_windows == got[(n, 100)].item_windows and not got[(n, 100)].changed and got[(n + 1, 100)].changed
    assert (n + 4, 100) not in got  # one name of the item became two


def test_names_outside_latin(spark):
    items = ["вчера пекарь Анна продала двенадцать булок в лавке", "χθες ο φούρναρης Νίκος πούλησε δώδεκα ψωμιά", "hôm qua bà Ấn bán mười ổ bánh"]
    changed = [items[0].replace("Анна", "Ольга"), items[1].replace("Νίκος", "Γιώργος"), items[2].replace("Ấn", "Ẩm")]
    got = found(spark, changed, items)
    assert set(got) == {(0, 100), (1, 101), (2, 102)} and all(r.changed for r in got.values())


def test_copies_in_other_case(spark):
    short = "What did the old baker Anna sell in her shop"
    texts = [ITEM.upper(), ITEM.title(), ITEM.lower(), "And then he asked\n" + short + ", of all", short.upper(), ITEM.upper().replace("12", "40"), "Question 5\nDays pass in a small town"]
    got = found(spark, texts, (ITEM, short, "Days pass in a small town"))
    assert set(got) == {(0, 100), (1, 100), (2, 100), (3, 101), (4, 101), (5, 100), (6, 102)}
    assert all(r.n_windows == r.item_windows for r in got.values()) and [k for k, r in got.items() if r.changed] == [(5, 100)]


def test_items_of_values(spark):
    items = ["Compute 12 + 7 - 3 * 9 + 14 - 2 * 8 + 31", "Anna Berta Clara Dora Emil Fritz Gustav Hanna Ida", "1 2 4 8 16 32 64", "Forty two", "Why?"]
    texts = ["Now compute 12 + 7 - 3 * 9 + 14 - 2 * 8 + 31 at once.", items[1].upper(), "It goes 1 2 4 8 16 32 64 and on.", " forty  TWO.", "why", "it is forty two", "compute 13 + 7 - 3 * 9 + 15 - 2 * 8 + 31", "Why not?"]
    got = found(spark, texts, items)
    assert set(got) == {(i, 100 + i) for i in range(5)} and not any(r.changed for r in got.values())


def test_one_window_many_times(spark):
    """A window that a document repeats is one window of the item, however often it is met."""
    window = " ".join(ITEM.split()[:8])
    got = {r.doc_id: r for r in decontam.matches(frame(spark, [(window + " and so on ") * 5, ITEM]), spark.createDataFrame([(100, ITEM)], "item_id long, text string")).collect()}
    assert got[0].n_windows == 1 and not got[0].contaminated and got[1].contaminated


def test_names_with_few_words_between(spark):
    """No window of the item has three literal words in five; copied as it is, it is found."""
    item = "12 Anna 4 Bob 5 Carl 9 Dora 3 Emil 7 Fred 1 Gerd 8"
    assert set(found(spark, ["Say " + item + " now", "12 Anna 4 Bob 5 Carl 9 Dora 8 Olga"], [item])) == {(0, 100)}


def brute_matches(docs, items):
    """(doc_id, item_id) of contaminated pairs, word by word in plain Python, for texts in ASCII."""
    import string

    def code(text):
        out, w = [], words(text)
        bare = [x.strip(string.punctuation) for x in w]
        for i, b in enumerate(bare):
            kind = ""
            if b[:1].isdigit():
                kind = "#number"
            elif i and bare[i - 1][:1].isdigit() and b.lower() in decontam.UNITS:
                kind = "#unit"
            elif i and b[:1].isupper() and w[i - 1][-1] not in ".!?:":
                kind = "#name"
            if b:
                out.append((kind or b.lower(), b.lower()))
        return out

    def keys(c, i, n):
        """Both keys of a window, each with the places that are slots."""
        win = c[i : i + n]
        slot = [k if k.startswith("#") else "" for k, _ in win]
        folded = ["" if s == "#name" or (s == "#unit" and j == 0) else s for j, s in enumerate(slot)]
        if n < 3 or 5 * sum(map(bool, folded)) > 2 * n:
            second = ("=", *(x for _, x in win)), [False] * n
        else:
            second = tuple(s or x for s, (_, x) in zip(folded, win)), list(map(bool, folded))
        first = tuple(k for k, _ in win), list(map(bool, slot))
        return first, second

    found = set()
    for item_id, text in items:
        q = code(text)
        n = min(len(q), 8)
        if not n:
            continue
        asked = []
        for j in range(len(q) - n + 1):
            first, second = keys(q, j, n)
            if n >= 3 and 5 * first[1].count(False) >= 3 * n:
                asked.append((j, 0, *first))
            asked.append((j, 1, *second))
        for doc_id, t in docs:
            d = code(t)
            if n < 3 and len(d) != n:
                continue
            by = {}
            for i in range(len(d) - n + 1):
                for own in keys(d, i, n):
                    for j, kind, key, slots in asked:
                        if key == own[0]:
                            by.setdefault(i - j, []).append((j, kind, [k for k in range(n) if slots[k] and own[1][k]]))
            met, template = set(), set()
            for diagonal, rows in by.items():
                pairs = {(q[j + k][1], d[j + diagonal + k][1]) for j, _, ks in rows for k in ks}
                if len({a for a, _ in pairs}) == len(pairs):
                    met |= {j for j, _, _ in rows}
                    template |= {j for j, kind, _ in rows if not kind}
            sizes = len({j for j, *_ in asked}), len({j for j, kind, *_ in asked if not kind})
            if met and (len(met) >= min(5, sizes[0]) or sizes[1] and len(template) >= min(5, sizes[1])):
                found.add((doc_id, item_id))
    return found


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["the", "baker", "sold", "loaves", "at", "euros", "each", "kg", "of", "flour", "Anna", "Bob", "12", "5", "3.5", "in", "town.", "How", "much?"]
    items = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 14])))) for i in range(25)]
    texts = []
    for _ in range(250):
        own = [rng.choices(vocabulary, k=rng.randint(0, 8))]
        for _, t in rng.sample(items, rng.randint(0, 2)):
            w = t.split()
            change = {x: rng.choice(["Clara", "7", "Dora", x, x]) for x in set(w)}
            w = [change[x] if rng.random() < 0.9 and (x[0].isdigit() or x in ("Anna", "Bob")) else x for x in w]
            own.append([x.upper() for x in w] if rng.random() < 0.2 else w)
            own.append(rng.choices(vocabulary, k=rng.randint(0, 4)))
        texts.append(" ".join(x for part in own for x in part))
    want = brute_matches(list(enumerate(texts)), items)
    assert len(want) > 60 and set(found(spark, texts, [t for _, t in items])) == want


def test_rows_without_id(spark):
    w = ITEM.split()
    texts = [ITEM, "clean", None, " ".join(w[:10]), " ".join(w[8:18])]  # the last two hold three windows each
    docs = frame(spark, texts).withColumn("doc_id", F.lit(None).cast("long")).unionByName(frame(spark, [ITEM, "clean"]))
    bench = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    assert sorted(map(str, (r.doc_id for r in decontam.contaminated(docs, bench).collect()))) == ["0", "None"]
    left = decontam.decontaminate(docs, bench)
    want = [(None, t) for t in texts[1:]] + [(1, "clean")]
    assert left.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, want))


def test_short_items_and_nulls(spark):
    got = found(spark, ["why does it rain so", "Well. Why does it rain? So.", None], ["why does it rain", "a b", None, ""])
    assert set(got) == {(0, 100), (1, 100)}
    assert not found(spark, [], [ITEM]) and not found(spark, [ITEM], [])


def test_planted_passages(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    plain = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    want = {(d, b.item_id) for b in bench.collect() for d, t in plain.items() if " ".join(b.text.split()) in t}
    assert want <= got
    # besides exact passages, only what word by word comparison finds too
    items = {b.item_id: b.text for b in bench.collect()}
    for d, i in got - want:
        assert (d, i) in brute_matches([(d, plain[d])], [(i, items[i])])
    left = decontam.decontaminate(docs, bench)
    assert {r.doc_id for r in left.collect()} == set(plain) - {d for d, _ in got} and left.columns == docs.columns


def test_stays_in_spark(spark, capsys):
    sf = SF
    decontam.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
