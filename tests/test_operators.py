"""Operators on small fixtures, and against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import align as AL
from lexloom.operators import filters as O
from lexloom.operators import relations as R
from lexloom.operators import spelling as SP
from lexloom.plans import lexicon_queries as LQ
from lexloom.plans import relational_queries as RQ
from lexloom.sources import catalog as CA
from lexloom.sources import html as H
from lexloom.sources import lines as L
from lexloom.sources import sinks as K
from lexloom.streaming import buckets as B


@pytest.mark.parametrize(("word", "dictionary", "known"), [("берашка", ["бер"], True), ("балаш", ["боал"], True), ("ламага", ["лоам"], True), ("биерага", ["бер"], True), ("йоьду", ["воьду"], True), ("дӏадеша", ["деша"], False)])
def test_known_forms(spark, word, dictionary, known):
    w = spark.createDataFrame([(word,)], "word string")
    d = spark.createDataFrame([(x,) for x in dictionary], "word string")
    assert (SP.known(w, d).count() > 0) == known


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_words_brute_force(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choice("абв") for _ in range(rng.randint(1, 6))) for _ in range(120)})
    left, right = words[:40], words[30:]
    got = {tuple(r) for r in SP.near(spark.createDataFrame([(x,) for x in left], "word string"), spark.createDataFrame([(x,) for x in right], "word string")).collect()}
    assert got == {(a, b, _distance(a, b)) for a in left for b in right if _distance(a, b) <= 2}


def test_context(spark):
    texts = spark.createDataFrame([(1, "а б"), (2, "")], "id int, t string")
    uni = spark.createDataFrame([("а", 10), ("б", 20)], "word string, n int")
    none = spark.createDataFrame([], "w1 string, w2 string")
    rows = SP.context(texts, "id", "t", uni, none).collect()
    assert [(r.id, r.position, r.bigram) for r in rows] == [(1, 0, "а б")] and abs(rows[0].score - 1 / 12) < 1e-12
    more = uni.unionByName(spark.createDataFrame([("в", 1000)], "word string, n int"))
    assert SP.context(texts, "id", "t", more, none).count() == 0
    assert SP.context(texts, "id", "t", uni.where("n < 0"), none).count() == 0


def test_related_words(spark):
    words = [("стена",), ("стенка",), ("стенд",), ("стен",), ("стенать",), ("дом",), ("домик",), ("стена",)]
    d = spark.createDataFrame(words, "word string")
    got = {(r.word, r.rank): r.related for r in SP.related_words(d.distinct(), d, 2).collect()}
    assert got == {(w, k): r for w in ("стена", "стенка", "стенд", "стен", "стенать") for k, r in enumerate([x for x in ("стен", "стена", "стенд") if x != w][:2], 1)}


def test_as_of(spark):
    left = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 5.0), ("k", 3, 9.0), ("z", 4, 1.0)], "k string, id int, t double")
    right = spark.createDataFrame([("k", 5.0, "a"), ("k", 12.0, "b")], "k string, y double, v string")
    loose = {r.id: r.v for r in R.as_of(left, right, ["k"], "t", "y", ["v"], tolerance=3.0).collect()}
    assert loose == {1: None, 2: "a", 3: "b", 4: None}
    strict = {r.id: r.v for r in R.as_of(left, right, ["k"], "t", "y", ["v"], strict=True).collect()}
    assert strict == {1: None, 2: None, 3: "a", 4: None}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=20))
def test_disjoint_pairs(flags):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "g int, pos int, f boolean")
    got = sorted(r.pos for r in R.disjoint_pairs(df, ["g"], "pos", F.col("f")).collect())
    want, i = [], 0
    while i < len(flags):
        if flags[i]:
            want.append(i)
            i += 1
        i += 1
    assert got == want


def test_eras(spark):
    from lexloom.functions.profile import MAP_ERAS, TIMELINE_ERAS

    df = spark.createDataFrame([(1916,), (1917,), (1991,), (None,), (1900,), (1901,)], "y int")
    assert [r.e for r in df.select(R.era_of(F.col("y"), TIMELINE_ERAS, False).alias("e")).collect()] == ["imperial", "soviet", "modern", "imperial", "imperial", "imperial"]
    got = {(r.y, r.era) for r in R.in_eras(df.where("y in (1900, 1901)"), F.col("y"), MAP_ERAS).collect()}
    assert got == {(1900, 1), (1900, 5), (1901, 2), (1901, 5)}


def test_filters(spark):
    df = spark.createDataFrame([(1, 1990, "a"), (2, None, "a")], "id int, y int, c string")
    assert O.period_and_category(df, F.col("y"), F.col("c"), first=2000).count() == 2
    assert O.period_and_category(df, F.col("y"), F.col("c"), first=2000, lenient=True).count() == 0
    assert O.period_and_category(df, F.col("y"), F.col("c"), 1980, 2000).count() == 1
    codes = spark.createDataFrame([("x" * 2000, "inh", "ru"), ("x" * 2001, "inh", "ru"), (" ", "inh", "ru"), ("x", "en", "ru"), ("x", "ru", "ru"), (None, None, None)], "t string, a string, b string")
    assert [r.c for r in codes.select(O.request_code(F.col("t"), F.col("a"), F.col("b"), ("inh", "ru"), 2000).alias("c")).collect()] == ["ok", "too_long", "empty", "bad_lang", "same_lang", "empty"]
    assert spark.range(1).select(O.ratio_between(F.lit("aa"), F.lit("aaaaa")).alias("r")).first().r is False


def test_split_counts(spark):
    n = R.hashed_rank_split(spark.range(4000), "id", 42, 5, 5).groupBy("split").count()
    assert {r.split: r["count"] for r in n.collect()} == {"train": 3600, "dev": 200, "test": 200}
    n = R.hashed_rank_split(spark.range(1000), "id", 42, 5, 5).groupBy("split").count()
    assert {r.split: r["count"] for r in n.collect()} == {"train": 800, "dev": 100, "test": 100}


def test_band_alignment():
    e = np.eye(5)
    assert [(i, j) for i, j, _ in AL.band_align(e, e, 8)] == [(k, k) for k in range(5)]
    assert [(i, j) for i, j, _ in AL.band_align(e[[0, 2, 3]], e, 8)] == [(0, 0), (1, 2), (2, 3)]
    assert AL.band_align(e[:0], e, 8) == []
    assert AL.band_align(e[:1], np.eye(5, 5), 0) == AL.band_align(e[:1], np.eye(5, 5), 0)


def test_length_alignment(spark):
    assert AL.length_align([20, 30], [20, 30]) == [(0, 1, 0, 1), (1, 1, 1, 1)]
    assert AL.length_align([40], [20, 20]) == [(0, 1, 0, 2)]
    df = spark.createDataFrame([(1, ["a" * 40], ["b" * 20, "c" * 20]), (2, None, ["x"]), (3, [], [])], "d int, a array<string>, b array<string>")
    assert AL.align_lengths(df, "d", "a", "b").count() == 0


def test_verses(spark):
    page = "КОРТА 1\n1. one\nmore\n79. late\nКОРТА 2\n80. later\n1. first\n2. second"
    rows = AL.parse_verses(spark.createDataFrame([(1, page), (2, None)], "d int, t string"), "d", "t", "КОРТ[АН]*").collect()
    assert {(r.chapter, r.verse): r.text for r in rows} == {(1, 1): "one more", (1, 79): "late", (1, 80): "later", (2, 1): "first", (2, 2): "second"}


def write_tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_verses_full(spark, tmp_path):
    texts = [
        "Простой стих.", "Стих, с запятой: «и кавычкой» – ё, ӏ, 12!", "первая строка\nвторая,\n\n третья", "\n с пустой строки", "скан 1 ~ № |шум|", "без точки",
        "до главы\nКОРТА 9\nпосле неё", "один\n4. другой\nдальше", "", "  ", None,
    ]
    rows = [(k, t, "verse", f"{2 + k % 3}:{1 + k * 2}") for k, t in enumerate(texts)] + [(50, "нет ссылки", "verse", None), (51, "плохая", "verse", "7")]
    d = write_tables(spark, tmp_path, parallel_ing_rus=(rows, "pair_id bigint, ing string, pair_type string, verse_ref string"))
    want = set()
    for k, t, _, ref in rows:
        if t is None or ref is None or ":" not in ref or not t.strip():
            continue
        (chapter, verse), head = map(int, ref.split(":")), None
        held, at = {}, (chapter if verse <= 5 else 1, verse)
        head = None if verse <= 5 else chapter
        for line in (x.strip() for x in t.split("\n")):
            number = line.split(".")[0]
            if line.startswith("КОРТА"):
                head = int(line.split()[1])
            elif line and number.isdigit():
                at = (head if head and int(number) <= 5 else at[0], int(number))
                held.setdefault(at, []).append(line.split(". ", 1)[1])
            elif line:
                held.setdefault(at, []).append(line)
        want |= {(k, *a, " ".join(x)) for a, x in held.items()}
    got = [tuple(r) for r in LQ.QUERIES["G11_parse_verses"](spark, d).select("pair_id", "chapter", "verse", "text").collect()]
    assert set(got) == want and len(got) == len(want) == 9


def test_unseen_bigrams(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["дом", "лес", "река", "гора", "поле", "снег", "ветер", "дождь"]) for _ in range(rng.randint(1, 5)))) for k in range(40)] + [(90, None), (91, "")]
    d = write_tables(spark, tmp_path, parallel_ing_rus=(rows, "pair_id bigint, ing string"))
    n = Counter(b for _, t in rows if t for b in zip(t.split(), t.split()[1:]))
    got = [tuple(r) for r in RQ.QUERIES["J18_unseen_bigrams"](spark, d).select("w1", "w2").collect()]
    assert len(got) == len(set(got)) > 5 and set(got) == {b for b, c in n.items() if c == 1}


def test_resplit(spark, tmp_path):
    a, b = "Первое предложение стоит здесь.", "Второе предложение идёт за ним."
    rows = [
        (1, f"\nДЕНИ НАРТ\n{a} {b}", f"НАРТ И ДЕНЬ\n{a} {b}"),  # title pair and two sentences
        (2, f"ДЕНИ\n{a}", f"{a}"),  # one side only: no title pair
        (3, "НАРТ\nодно длинное начало без конца", "НАРТ\n" + "кто? что? где? " * 2),  # nothing aligns: bodies without titles
        (4, "НАРТ", "ГЕРОЙ"), (5, "1 2 3\n" + a, "4 5\n" + a), (6, None, "НАРТ"), (7, "", ""),
    ]
    d = write_tables(spark, tmp_path, parallel_ing_rus=([(*r, "bilingual_para") for r in rows], "pair_id bigint, ing string, rus string, pair_type string"))
    got = [tuple(r) for r in LQ.QUERIES["C16_resplit"](spark, d).select("pair_id", "ing", "rus").collect()]
    want = {(1, "ДЕНИ НАРТ", "НАРТ И ДЕНЬ"), (1, a, a), (1, b, b), (2, a, a), (3, "НАРТ", "НАРТ"), (3, "одно длинное начало без конца", "кто? что? где? кто? что? где?"), (4, "НАРТ", "ГЕРОЙ"), (5, "1 2 3 " + a, "4 5 " + a)}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("matches", [True, False])
def test_corpus_bleu(spark, tmp_path, matches):
    rng = random.Random(12)
    ing, rus = (["а" + x * 3 for x in "бвгдежзклм"], ["о" + x * 3 for x in "бвгдежзклм"])
    meaning = dict(zip(ing, [*rus[:8], "два слова", rus[0]])) if matches else dict(zip(ing, "абвгдежзик"))
    rows = []
    for k in range(60):
        w = [rng.choice(ing) for _ in range(rng.randint(1, 9))]
        r = [y for x in w for y in meaning[x].split()] if matches else [rus[0] for _ in w]
        r += [rng.choice(rus) for _ in range(rng.randint(0, 3))]
        rows.append((k, ", ".join(w).capitalize(), ", ".join(r) + ".", rng.choice(["word_pair", "sentence", None])))
    rows += [(90, None, "дом", "word_pair"), (91, "дом", None, "word_pair"), (92, "", "дом", "verse")]
    d = write_tables(spark, tmp_path, parallel_ing_rus=(rows, "pair_id bigint, ing string, rus string, pair_type string"), translations=(list(meaning.items()), "word string, translation string"))
    hits, alls, h_len, r_len = [0] * 4, [0] * 4, 0, 0
    for _, i, r, _ in rows:
        if i is None or r is None:
            continue
        h = [y for x in i.lower().replace(",", " ,").split() for y in meaning.get(x, x).split()]
        r = r.lower().replace(",", " ,").replace(".", " .").split()
        h_len, r_len = h_len + len(h), r_len + len(r)
        for n in range(4):
            left = [tuple(r[k : k + n + 1]) for k in range(len(r) - n)]
            for k in range(len(h) - n):
                alls[n] += 1
                if (g := tuple(h[k : k + n + 1])) in left:
                    left.remove(g)
                    hits[n] += 1
    penalty = 1.0 if h_len >= r_len else math.exp(1 - r_len / h_len)
    logs, half = 0.0, 1.0
    for n in range(4):
        half = half if hits[n] else half / 2
        logs += math.log((hits[n] or half) / alls[n])
    want = penalty * math.exp(logs / 4)
    got = sorted(LQ.QUERIES["A18_corpus_bleu"](spark, d).collect())
    assert (hits[3] > 0) == matches and h_len < r_len
    assert [r.n for r in got] == [1, 2, 3, 4]
    assert [r.precision for r in got] == pytest.approx([h / n for h, n in zip(hits, alls)], abs=1e-6)
    assert all(r.bleu == pytest.approx(want, abs=1e-6) and r.brevity_penalty == pytest.approx(penalty, abs=1e-6) for r in got)


def test_token_bucket(spark):
    df = spark.createDataFrame([("a", 0.0, i) for i in range(31)] + [("a", 2.0, 31), ("a", 2.0, 32)], "k string, t double, e int")
    got = {r.e: r.allowed for r in B.allow(df, "k", "t", "e").collect()}
    assert sum(got[i] for i in range(31)) == 30 and got[31] and not got[32]


def test_token_bucket_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", float(i // 4), i) for i in range(20)], "k string, t double, e int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, t double, e int").parquet(src)
    q = B.allow_stream(stream, "k", "t", "e", 3.0, 0.5).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = B.allow(spark.read.parquet(src), "k", "t", "e", 3.0, 0.5)
    assert {tuple(r) for r in spark.table("bucket").collect()} == {tuple(r) for r in batch.collect()}


def test_append_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(" a ", "b"), ("c", " "), (None, "d")], "word string, translation string").coalesce(1).write.json(src)
    stream = spark.readStream.schema("word string, translation string").json(src)
    B.append_valid(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in spark.read.schema("word string, translation string").json(str(tmp_path / "out")).collect()] == [("a", "b")]


def test_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('### head\n{"a": 1}\n\n{"a": \n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in L.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    (tmp_path / "doc.txt").write_text("слово " * 50, encoding="utf-8")
    (tmp_path / "tiny.txt").write_text("x", encoding="utf-8")
    docs = L.read_documents(spark, str(tmp_path / "*.txt")).collect()
    assert [r.slug for r in docs] == ["doc"]
    assert spark.range(1).select(L.decoded(L.encoded(F.lit("Ёлка — да"), "cp1251"), "cp1251").alias("t")).first().t == "Ёлка — да"
    html = "<head><title>x</title></head><p>a <b>b</b></p><script>no</script>c"
    assert H.visible_text(spark.createDataFrame([(1, html), (2, None)], "i int, h string"), "i", "h").orderBy("i").collect()[0].text == "a b\nc"
    rows = spark.range(1).select(CA.catalog_rows(F.lit("<tr><td><a href='/u/'>T</a> 20.92 Мб 7 загрузок 01.02.2003</td></tr>")).alias("r")).first().r
    assert tuple(rows[0]) == ("T", "/u/", "20.92 Мб", 7, "01.02.2003")


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, source string")
    new = spark.createDataFrame([(9, "a")], "id int, source string")
    assert sorted(r.id for r in K.replace_values(old, new, "source", ["a"]).collect()) == [2, 3, 9]
    assert sorted(r.id for r in K.replace_by(old, new, ["source"]).collect()) == [2, 3, 9]
    K.write_words(spark.createDataFrame([("b",), ("a",)], "word string"), str(tmp_path / "w"), "head")
    lines = next((tmp_path / "w").glob("part-*")).read_text(encoding="utf-8").split()
    assert lines == ["#", "head", "a", "b"]
    path = str(tmp_path / "by")
    K.write_by_source(old.where("source is not null"), path)
    K.write_by_source(new, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 9]


def test_prepare_needs_enough(spark):
    from lexloom.plans.lexicon_queries import prepare

    made = prepare(spark.createDataFrame([(1, "a", "b")], "pair_id int, ing string, rus string"), "pair_id", 42, 5, 5)
    with pytest.raises(Exception, match="at least 200 pairs"):
        made.collect()


def test_align_texts(spark):
    a = ["Старый мастер построил дом.", "Весёлый сосед купил лодку.", "Вечером пошёл снег."]
    docs = spark.createDataFrame([(1, a, a), (2, a, [a[0], a[2]]), (3, [], a), (4, None, a)], "id int, a array<string>, b array<string>")
    got = {(r.id, r.ing, r.rus) for r in AL.align_texts(docs, "id", "a", "b").collect()}
    assert got == {(1, x, x) for x in a} | {(2, a[0], a[0]), (2, a[2], a[2])}


def test_whole_or_aligned(spark, tmp_path):
    one = "Старый мастер построил большой дом у реки."
    four = " ".join(f"{x} мастер построил большой дом у реки." for x in ("Старый", "Новый", "Добрый", "Сильный"))
    rows = [(1, four, four, "poem"), (2, one, one, "prose"), (3, four, four, "prose"), (4, four, one, None), (5, "мало", "мало", "prose"), (6, None, one, "prose")]
    d = write_tables(spark, tmp_path, parallel_ing_rus=(rows, "pair_id bigint, ing string, rus string, pair_type string"))
    got = [tuple(r) for r in LQ.QUERIES["C15_whole_or_aligned"](spark, d).select("pair_id", "kind").collect()]
    assert sorted(got) == [(1, "whole"), (2, "whole"), *[(3, "sentence")] * 4, (4, "prose")]


def test_cleaned_dictionary(spark):
    pairs = spark.createDataFrame([("а", "один два три четыре пять шесть"), ("б", "дом"), ("в", "в"), ("г", "семь два три четыре пять шесть")], "word string, translation string")
    known = spark.createDataFrame([("б", "дом")], "word string, translation string")
    assert {r.word for r in LQ.cleaned_dictionary(pairs, known).collect()} == {"а", "б", "г"}
    labels = spark.createDataFrame([("а", "B"), ("б", "B")], "word string, label string")
    assert {r.word for r in LQ.cleaned_dictionary(pairs, known, labels).collect()} == {"б", "г"}


def test_numbered_sections_brute_force(spark):
    from lexloom.functions import words as W

    rng = random.Random(21)
    pieces = ["1", "2.", " 17 ", "345", "4567", "12. с текстом", "Это строка текста, и она достаточно длинна.", "коротко", "", "ещё одна длинная строка без точки в конце"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(80)]

    def sections(text):
        found, now = [], None
        for line in text.split("\n"):
            t = line.strip()
            n = t.removesuffix(".")
            if n.isdigit() and len(n) <= 3:
                now = [int(n), []]
                found.append(now)
            elif now:
                now[1].append(line)
        return [(n, "\n".join(x).strip()) for n, x in found if len("\n".join(x).strip()) >= 30]

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [(x.num, x.body) for x in r.s] for r in df.select("id", W.numbered_sections(F.col("t")).alias("s")).collect()}
    assert got == {k: sections(t) for k, t in enumerate(texts)}


def test_container_paragraphs(spark):
    pages = [
        (1, '<p>before</p><div class="cm-single-description"><p>first paragraph</p><p>short</p><div><p>second  <b>bold</b>\n one</p></div></div><p>after all of it</p>', "first paragraph\n\nsecond bold one"),
        (2, "<p>no container at all</p>", ""),
        (3, '<div class="cm-single-description"></div><p>after all of it</p>', ""),
    ]
    df = spark.createDataFrame([(k, h) for k, h, _ in pages] + [(4, None)], "id int, html string")
    got = {r.id: r.text for r in H.container_paragraphs(df, "id", "html").collect()}
    assert got == {**{k: t for k, _, t in pages}, 4: None}  # paragraphs of ten characters or fewer are left out
