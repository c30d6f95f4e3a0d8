"""Text operators: edge cases (null, empty, long, ties, repeated rows, other columns), round trips, brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import p1_scan as P1
from lexloom.llm import p2_sentences as P2
from lexloom.llm import p5_language as P5
from lexloom.llm import p6_encoding as P6
from lexloom.llm import p7_alignment as P7
from lexloom.llm import p8_tokens as P8
from lexloom.llm import p9_leaks as P9
from lexloom.llm import p10_quality as P10

RUS = "В селе старый мастер построил новую мельницу, а потом весёлый сосед купил тёмную лодку у реки. "
PROSE = RUS + "Вчера усталый путник заметил красную крышу за рекой. Осенью моя бабушка рассказала длинную историю о старом городе. Потом дети нашли в овраге железный ключ и отдали его учителю. "


def bits_of(*texts):
    total = np.full((P6.SIZE, P6.SIZE), 0.05)
    for t in texts:
        a = P6._TABLE[np.frombuffer(t.encode("utf-16-le"), dtype=np.uint16)].astype(int)
        np.add.at(total, (a[:-1], a[1:]), 1)
    return -np.log2(total / total.sum(axis=1, keepdims=True))


# ---- problem 1


SCANNED = "вечӏера кхолем мартад хьарга шоргар кхиерта наьйхерг дуолад берзалой".split()


def vocabulary(spark):
    return spark.createDataFrame([(w, 50 - i) for i, w in enumerate(SCANNED)], "w string, n bigint")


def corrected(spark, rows, words=None):
    df = spark.createDataFrame(rows, "id bigint, t string, text string, form string, seen int")
    laid = P1.pages(df, "id", "t").withColumn("table_name", F.lit("x"))
    return P1.corrections(laid, words if words is not None else vocabulary(spark), np.zeros(P1.PAIRS, dtype=np.int32))


def test_automaton_brute_force():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("абвг") for _ in range(rng.randint(1, 7))) for _ in range(200)})
    trie = P1.Trie(words, [1] * len(words))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for q in ["абв", "а", "ггггггг", "абвгабв"]:
        for k in (0, 1, 2):
            assert {(words[i], d) for i, d in trie.within(list(q), k)} == {(w, distance(q, w)) for w in words if distance(q, w) <= k}


def test_candidates_can_win():
    # every word that the neighbours could make the cheapest comes out, however far
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("абвгд") for _ in range(rng.randint(3, 8))) for _ in range(300)})
    counts = [rng.choice([1, 3, 40, 10**6]) for _ in words]
    trie = P1.Trie(words, counts)
    for q in words[:40]:
        form = q[:1] + "b" + q[2:]
        readings = P1.units(form)
        costs = {}
        for r in readings:
            for i, d in trie.within(r, 2 if len(r) > 5 else 1):
                costs[words[i]] = min(costs.get(words[i], 1e9), P1.EDIT * d - math.log10(counts[i]))
        least = min(costs.values())
        assert dict(trie.candidates(form)) == {w: c for w, c in costs.items() if c <= least + 2 * P1.BESIDE}


def test_scan_repair(spark):
    text = "Вечӏера кхо­\nлем мартад.\n— 12 —\nХьаpга шоргар кхиеpта\nДАКЪА II. ХЬАРГА КХОЛЕМ 12\nнаьйхерг дуолад."
    whole, joined, furniture, suspects = P1.Reader().read(text)
    assert (joined, furniture, [s[2] for s in suspects]) == (1, 2, ["Хьаpга", "кхиеpта"])
    assert whole == "Вечӏера кхолем мартад. Хьаpга шоргар кхиеpта наьйхерг дуолад."
    assert all(whole[at : at + size] == form for at, size, form, _, _ in suspects)
    rows = [(1, text, "x", "y", 2), (1, text, "x", "y", 2)]
    assert {(r.row_id, r.word) for r in corrected(spark, rows).collect()} == {(1, "Хьарга"), (1, "кхиерта")}
    # the words come from the vocabulary: with an empty one nothing is noise
    assert corrected(spark, rows, vocabulary(spark).where("n < 0")).count() == 0


@pytest.mark.parametrize("text", ["", "Вечӏера\nкхолем мартад.", "ХЬАРГА КХОЛЕМ\nВечӏера мартад.\nШоргар.", "х1ара т1а д1адахар", "Шоргар, XIX дуолад.", "В 1817 г. (см. стр. 12)", "α/β ≈ ½", "3-гӏа мартад"])
def test_no_scan_noise(text):
    assert P1.Reader().read(text)[1:] == (0, 0, [])


def test_forms_that_are_meant(spark):
    # a form that the corpus uses as it stands is beaten only by a word that is far commoner
    rows = [(k, "Хьарга А4 мартад, шopгар.", None, None, None) for k in range(30)]
    words = spark.createDataFrame([("ач", 20), ("шоргар", 900)], "w string, n bigint")
    assert {r.word for r in corrected(spark, rows, words).collect()} == {"шоргар"}


def test_grid(spark):
    # the same candidates however the vocabulary and the forms are cut
    rng = random.Random(6)
    words = spark.createDataFrame([("".join(rng.choice("абвгд") for _ in range(6)), 3) for _ in range(200)], "w string, n bigint").dropDuplicates(["w"])
    forms = spark.createDataFrame([(f"{a}b{c}гд{a}",) for a in "абвгд" for c in "абвгд"], "form string")
    one = {r.form: {o.w: o.cost for o in r.options} for r in P1.retrieve(forms, words).collect()}
    cut = {r.form: {o.w: o.cost for o in r.options} for r in P1.retrieve(forms, words, 30, 4).collect()}
    least = {f: min(o.values()) for f, o in one.items()}
    assert {f: {w: c for w, c in o.items() if c <= least[f] + 2 * P1.BESIDE} for f, o in cut.items()} == one and len(one) > 10


def test_retrieval_over_shards(spark):
    # what is found in one part of the vocabulary bounds the search in every other: no word that can't win comes out
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("абвгм") for _ in range(rng.choice([1, 2, 3, 6, 6, 7, 8]))) for _ in range(400)})
    words += ["абвгм" * 6, "абвгм" * 6 + "а", "бвгм" * 500]
    counts = [rng.choice([1, 3, 40, 10**6]) for _ in words]
    forms = [w[:1] + "b" + w[2:] for w in words[::5]] + ["абвгм" * 3 + "b" + "абвгм" * 3, "бвгm" + "бвгм" * 499 + "б"]
    trie = P1.Trie(words, counts)
    exact = {f: dict(c) for f in forms if (c := trie.candidates(f))}
    left, right = spark.createDataFrame([(f,) for f in sorted(set(forms))], "form string"), spark.createDataFrame(list(zip(words, counts)), "w string, n bigint")
    for cut in ((), (30, 4)):
        got = {r.form: {o.w: o.cost for o in r.options} for r in P1.retrieve(left, right, *cut).collect()}
        assert got.keys() == exact.keys() and all(got[f].keys() == exact[f].keys() for f in got) and len(got) > 50
        assert all(abs(got[f][w] - c) < 1e-9 for f in got for w, c in exact[f].items())
    for k in range(3):
        for f in forms:
            near = {words[i] for r in P1.units(f) if k < 2 or len(r) > 5 for i, _ in trie.within(r, k)}
            assert all(P1.form_keys(f, k) & P1.word_keys(w, k) for w in near)
    assert P1.retrieve(left, right.where("n < 0")).count() == 0 and P1.retrieve(left.where("form = ''"), right).count() == 0


def test_scan_frame(spark):
    rows = [(1, None, "x", "f", 1), (2, "", "x", "f", 1), (3, "кхоле-\nмаш мартад", "x", "f", 1), (3, "кхоле-\nмаш мартад", "x", "f", 1)]
    df = spark.createDataFrame(rows, "id bigint, t string, text string, form string, joined int")
    assert [(r.row_id, r.joined) for r in P1.pages(df, "id", "t").collect()] == [(3, 1), (3, 1)]
    assert P1.pages(df.where("id < 0"), "id", "t").count() == 0
    words, pairs = P1.counts((df, "t"))
    assert {r.w: r.n for r in words.collect()} == {"мартад": 2, "кхоле": 2, "маш": 2} and pairs.sum() == 4
    assert P1.counts((df.where("id < 0"), "t"))[0].count() == 0


# ---- problem 2


def cut(text, han=None):
    out, at = [], 0
    for e in P2.boundaries(text, han):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "parts",
    [
        ["В 1879 г. Иванов построил дом.", "Потом продал его в 1880 г.", "Дом стоит."],
        ["1837 ш. Шитцизороро маьна шоргар.", "Цо бор частаб 1999 ш.", "Из бехинад."],
        ["«Он пришёл. Она ушла», — сказал Пётр.", "Все молчали."],
        ["Пётр сказал: «Он пришёл. Она ушла…»", "Все молчали?!", "Да…"],
        ["Сказку закрыл проф. Х.Б. Гурравур.", "Купил хлеб, сыр и т. д.", "Ушёл за 33.35 рубля (см. стр. 12)."],
        ['"The old clerk left?" asked the rider.', "Dr. M. Bravewell built 74.2 miles of road, i.e. the copper one."],
        ["孩子说：“昨天农夫修好了小的桥。”", "今天老师打开了新的塔！"],
        ["أمس رسم الشاعر الطريق الأبيض؟", "اليوم فتح الباب ۝", "مساء رسم الحارس"],
        ["დღეს თეთრი მწყემსიმა პატარა ქალაქი იპოვა.", "გუშინ ახალი წიგნი იყიდა!"],
    ],
)
def test_boundaries(parts):
    assert cut(" ".join(parts)) == parts


def test_boundary_layout():
    assert cut("ПЕРВАЯ ГЛАВА\nОн пришёл\nдомой. Ушёл") == ["ПЕРВАЯ ГЛАВА", "Он пришёл\nдомой.", "Ушёл"]
    assert cut("Заглавие\n\nТекст без точки\n\nЕщё") == ["Заглавие", "Текст без точки", "Ещё"]
    assert P2.boundaries("") == [] and P2.boundaries(" \n ") == []
    assert P2.boundaries("  а. ") == [4]
    assert len(P2.boundaries("Он ушёл. " * 20000)) == 20000


def han_sentence(rng):
    return rng.choice(["昨天", "今天", "后来", "有一次"]) + rng.choice(["老师", "农夫", "邻居", "老人"]) + rng.choice(["打开", "画", "修好", "找到"]) + "了" + rng.choice(["古老的", "白色的", "小的"]) + rng.choice(["石墙", "铜灯", "花园", "山路"])


def test_unmarked_han(spark):
    rng = random.Random(9)
    rows = [(k, "".join(han_sentence(rng) + rng.choice("。！？") for _ in range(rng.randint(1, 4)))) for k in range(200)] + [(900, None), (901, ""), (902, "текст")]
    df = spark.createDataFrame(rows, "k int, t string")
    han = P2.Han(*P2.han_lexicon(df, "t"))
    assert "".join(han.words("昨天老师打开了白色的石墙")) == "昨天老师打开了白色的石墙" and len(han.words("昨天老师打开了白色的石墙")) < 12
    for _ in range(40):
        own = [han_sentence(rng) for _ in range(rng.randint(2, 4))]
        flat = "".join(own)
        assert cut(flat, han) == own and cut(flat) == [flat]
        assert cut("“" + flat + "”老人说。" + own[0] + "。", han)[-1] == own[0] + "。"
    # marked ends stay where they are, and texts of other scripts as they were
    marked = "昨天老师画了小的铜灯。今天农夫找到了石墙？"
    assert cut(marked, han) == cut(marked) == ["昨天老师画了小的铜灯。", "今天农夫找到了石墙？"]
    assert cut("Он пришёл. Ушёл.", han) == ["Он пришёл.", "Ушёл."]
    none = P2.Han(*P2.han_lexicon(df.where("k > 899"), "t"))
    assert cut("昨天老师画了灯", none) == ["昨天老师画了灯"]


def test_segment_frame(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Да. Нет."), (3, "Да. Нет.")], "k bigint, t string")
    assert sorted((r.k, r.start_pos, r.end_pos) for r in P2.segment(df, ["k"], "t").collect()) == [(3, 1, 3), (3, 1, 3), (3, 5, 8), (3, 5, 8)]


# ---- problem 5


def test_language_model():
    rng = random.Random(3)
    vocab = {0: "хьарга шоргар вечӏера кхолем мартад наьйхерг".split(), 1: "который построил мельницу весёлый сосед лодку".split(), 2: "the old miller built a quiet tower".split()}
    rows = []
    for k in range(240):
        y = k % 3
        label = (y + 1) % 3 if k % 20 == 0 else y  # wrong labels
        rows.append(([rng.choice(vocab[y]) for _ in range(6)], label, k))
    model = P5.fit(rows)
    right = sum(int(model.probabilities([rng.choice(vocab[y]) for _ in range(5)]).argmax() == y) for y in (0, 1, 2) for _ in range(40))
    assert right >= 114 and 0.05 < model.temperature < 10.1
    lab = P5.Labeller(model, None)
    found = lab.segments("Хьарга шоргар вечӏера кхолем. Мартад наьйхерг шоргар. The old miller built a tower. A quiet tower built the miller.")
    assert [s[2] for s in found] == ["ing", "eng"] and all(0 < s[3] <= 1 for s in found)
    assert lab.segments(None) == [] and lab.segments("  ") == [] and lab.segments("123 ...") == []
    # places are those of the stored text, also where it was restored
    good = "Хьарга шоргар вечӏера кхолем. "
    stored = good + RUS.strip().encode().decode("cp1251", "replace").replace("\ufffd", "?") + " " + good.strip()
    lab = P5.Labeller(model, bits_of(PROSE * 20))
    for a, b, _, _ in lab.segments(stored):
        assert (a == 1 or stored[a - 2].isspace()) and (b == len(stored) or stored[b].isspace())
    place = P5.places("абв РіРґ кл", "абв гд кл")
    assert [place(0), place(3), place(4), place(5, True), place(7), place(8, True)] == [0, 3, 4, 7, 9, 10]
    with pytest.raises(ValueError):
        P5.fit([])


def test_one_language_as_by_sentences():
    rng = random.Random(8)
    vocab = ["хьарга шоргар вечӏера кхолем мартад наьйхерг".split(), "который построил мельницу весёлый сосед лодку".split(), "the old miller built quiet tower".split()]
    rows = [([rng.choice(vocab[k % 3]) for _ in range(6)], k % 3, k) for k in range(240)]
    lab = P5.Labeller(P5.fit(rows), None)
    for k in range(60):
        own = [k % 3] * 5
        if k % 4 == 0:
            own[rng.randrange(5)] = (k + 1) % 3  # one sentence of another language
        text = " ".join(" ".join(rng.choice(vocab[y]) for _ in range(rng.randint(4, 7))).capitalize() + "." for y in own)
        found = lab.segments(text)
        lab.one_language, kept = (lambda t: None), lab.one_language
        assert [s[2] for s in lab.segments(text)] == [s[2] for s in found]
        lab.one_language = kept


# ---- problem 6


@pytest.mark.parametrize(("view", "true"), [("cp1251", "utf-8"), ("latin-1", "utf-8"), ("cp1252", "cp1251"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("mac-cyrillic", "cp1251")])
def test_encoding_round_trip(view, true):
    rep = P6.Repairer(bits_of(RUS * 20, RUS.upper()))
    garbled = RUS.strip().encode(true).decode(view)
    fixed, gain = rep.repair(garbled)
    assert fixed == RUS.strip() and gain >= P6.MIN_GAIN
    inner = RUS + garbled  # a stretch of it
    assert rep.repair(inner)[0] == RUS + RUS.strip()


def test_nested_encoding():
    rep = P6.Repairer(bits_of(RUS * 20))
    twice = RUS.strip().encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert rep.repair(twice)[0] == RUS.strip()


@pytest.mark.parametrize("layers", [1, 2])
def test_many_stretches(layers):
    """Every stretch is restored, in one block of pieces and over several."""
    rep = P6.Repairer(bits_of(RUS * 20))
    garbled = RUS.strip()
    for _ in range(layers):
        garbled = garbled.encode("utf-8").decode("latin-1")
    for n in (13, 60):
        fixed, gain = rep.repair(" ".join([RUS + garbled] * n))
        assert fixed == " ".join([RUS + RUS.strip()] * n)
        assert gain == pytest.approx(n * rep.repair(RUS + garbled)[1])


@pytest.mark.parametrize("text", [RUS, RUS.upper(), "«Größe été»", "α/β ≈ ½", "╔══╗ Дом ╚══╝", "Ђура, Ћетков.", "№ 5 ± 0,5°", "©®™", ""])
def test_not_garbled(text):
    rep = P6.Repairer(bits_of(RUS * 20, RUS.upper() * 5, "Дом Ђура "))
    assert rep.repair(text) == (text, 0.0)


def test_encoding_frame(spark):
    bits = bits_of(RUS * 20)
    df = spark.createDataFrame([(1, None), (2, ""), (3, RUS), (4, RUS.encode("utf-8").decode("latin-1"))], "id bigint, t string")
    assert [r.id for r in P6.fix(df, "id", "t", bits).collect()] == [4]
    assert P6.fix(df, "id", "t", bits, only_garbled=False).count() == 4
    assert P6.fix(df.where("id > 9"), "id", "t", bits).count() == 0
    assert P6.model(P6.bigram_counts(df.where("id > 9"), "t")).shape == (P6.SIZE, P6.SIZE)


# ---- problem 7


def dense(s):
    """Masses by the plain scaling of the whole table with its null sentences."""
    n, m = s.shape
    kernel = np.exp(-np.block([[1 - s, np.full((n, 1), P7.NULL_COST)], [np.full((1, m), P7.NULL_COST), np.zeros((1, 1))]]) / P7.EPSILON)
    r, c, v = np.append(np.ones(n), m), np.append(np.ones(m), n), np.ones(m + 1)
    for _ in range(5000):
        u = r / (kernel @ v)
        v = c / (kernel.T @ u)
    return (u[:, None] * kernel * v)[:n, :m]


def sparse(s):
    i, j = np.nonzero(s > P7.FAINT)
    out = np.zeros(s.shape)
    out[i, j] = P7.transport(i, j, s[i, j], *s.shape)
    return out


def test_transport():
    s = np.array([[0.9, 0.1, 0.0], [0.0, 0.8, 0.0]])
    m = sparse(s)
    assert m[0, 0] > 0.9 and m[1, 1] > 0.9 and m[:, 2].max() < 0.05
    assert sparse(np.array([[0.7, 0.7]])).sum() <= 1.0 + 1e-6
    rng = np.random.default_rng(3)
    for _ in range(30):
        s = rng.random(rng.integers(1, 9, 2)) ** 3
        assert np.abs(sparse(s) - dense(s)).max() < 0.02


def test_cosines_brute_force():
    rng = random.Random(4)
    a, b = ([{rng.choice("abcdefgh"): rng.random() + 0.1 for _ in range(rng.randint(0, 4))} for _ in range(12)] for _ in range(2))
    got = dict(zip(zip(*(map(int, x) for x in P7.cosines(a, b)[:2])), P7.cosines(a, b)[2]))
    for i, u in enumerate(a):
        for j, v in enumerate(b):
            c = sum(x * v.get(k, 0) for k, x in u.items()) / ((sum(x * x for x in u.values()) * sum(x * x for x in v.values())) ** 0.5 or 1)
            assert ((i, j) in got) == (c > P7.FAINT) and abs(got.get((i, j), c) - c) < 1e-9


def test_long_pairs(spark):
    # a book of many lines needs no table of all pairs of lines, and the dictionary comes in any order
    rng = random.Random(7)
    words = ["сл" + "".join(rng.choice("абвгдежз") for _ in range(4)) for _ in range(3000)]
    entries = [(w, "пер" + w[2:]) for w in words]
    pairs = spark.createDataFrame([(k, " ".join(words[k : k + 5]), " ".join("пер" + w[2:] for w in words[k : k + 5])) for k in range(40)] + [(99, "слово " * 400, "перевод " * 300)], "i int, a string, b string")
    lexica = [P7.learn(pairs, spark.createDataFrame(e, "word string, translation string"), "i", "a", "b") for e in (entries, entries[::-1])]
    assert lexica[0].of == lexica[1].of and "слово" in lexica[0].of
    assert len(P7.pieces(["а"] * 400, ["б"] * 300)) == 7 and sum(len(x) for x, _ in P7.pieces(["а"] * 400, ["б"] * 300)) == 400
    lines = [rng.sample(words, 6) for _ in range(3000)]
    order = sorted(range(3000), key=lambda k: k + rng.randint(-3, 3))
    links = P7.align("\n".join(" ".join(x) for x in lines), "\n".join(" ".join("пер" + w[2:] for w in lines[k]) for k in order), lexica[0])
    right = {(k + 1, j + 1) for j, k in enumerate(order)}
    found = {(i, j) for i, j, _ in links}
    assert len(found & right) > 2900 and len(found - right) < 150


def test_counts_of_all_pairs(spark):
    # words, stems and their meetings are counted over all pairs: a word of three pairs among 21,000 has its translation
    rng = random.Random(9)
    words = ["".join(rng.choice("абвгдежз") for _ in range(6)) for _ in range(300)]
    pairs = [(" ".join(x := rng.sample(words, 3)), " ".join("п" + w for w in x)) for _ in range(21_000)]
    for k in range(30):
        for at in rng.sample(range(len(pairs)), 3):
            pairs[at] = (f"{pairs[at][0]} редко{'ъ' * (k + 1)}", f"{pairs[at][1]} {chr(0x430 + k) * 5}")
    pairs += [("", "пусто"), ("слово", ""), ("слово " * 130, "перевод " * 90)]
    entries = [("бор", "лес"), ("бор", "роща")]
    df, dictionary = spark.createDataFrame([(k, *x) for k, x in enumerate([*pairs, (None, "нет")])], "i int, a string, b string").repartition(3), spark.createDataFrame(entries, "word string, translation string")
    exact = P7.Lexicon(pairs, entries)
    for block in (P7.BLOCK, 5000):
        lex = P7.learn(df, dictionary, "i", "a", "b", block)
        assert (lex.of, lex.left, lex.rarity, lex.unseen) == (exact.of, exact.left, exact.rarity, exact.unseen)
    assert sum(1 for k in range(30) if exact.of.get("редко" + "ъ" * (k + 1))) == 30
    none = P7.learn(df.where("i < 0"), dictionary.where("word = ''"), "i", "a", "b")
    assert (none.of, none.left, none.rarity) == ({}, {}, {})


def test_alignment():
    lex = P7.Lexicon([("хьарга шоргар", "дом построил"), ("хьарга мартад", "дом купил"), ("кхолем шоргар", "сад построил"), ("кхолем мартад", "сад купил")] * 3, [("бор", "лес")])
    a = "Ивановало хьарга шоргар.\nПетровало бор мартад. Сидоровало кхолем шоргар.\n\nЛишний хьо."
    b = "Сидоров построил сад.\nИванов построил дом.\nПётр ушёл.\nПетров купил лес."
    links = {(i, j) for i, j, _ in P7.align(a, b, lex)}
    assert {(1, 2), (2, 1), (2, 4)} <= links and all(i != 4 for i, _ in links)
    assert P7.align(None, b, lex) == [] and P7.align("", b, lex) == [] and P7.align("\n", "\n", lex) == []


# ---- problem 8


@pytest.fixture(scope="module")
def encoder():
    return P8.Encoder(P8.load_ranks(P8.tokenizer_path()))


@pytest.mark.parametrize("text", ["", " ", "\n\n  ", "hello world", "Хьарга шоргар, вечӏера!", "<|endoftext|>", "a" * 500, "🙂👩‍👩‍👧", "don't 12345", "孩子说：“昨天”", "\u0000￿"])
def test_tokens_against_library(encoder, text):
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P8.PATTERN, mergeable_ranks=encoder.fst.ranks, special_tokens={})
    assert encoder.encode(text) == ref.encode_ordinary(text)
    assert P8.decode(encoder.encode(text), encoder.fst.token) == text


def test_tokens_random(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P8.PATTERN, mergeable_ranks=encoder.fst.ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("абвeth гӏ 1.,\nꙮ🙂") for _ in range(rng.randint(1, 60)))
        assert encoder.encode(text) == ref.encode_ordinary(text)


def test_utf8_machine():
    rng = random.Random(6)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xD0, 0x90, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xC0, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        d = P8.Utf8Decoder()
        k = rng.randint(0, len(data))
        assert d.feed(data[:k]) + d.feed(data[k:]) + d.end() == data.decode("utf-8", "replace")


def test_token_frame(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello", 5), (3, "hello", 5)], "doc_id bigint, text string, ids int")
    rows = sorted((r.doc_id, list(r.ids)) for r in P8.encode_texts(df, "doc_id", "text", P8.tokenizer_path()).collect())
    assert rows == [(1, []), (2, []), (3, [31373]), (3, [31373])]
    assert P8.encode_texts(df.where("doc_id > 9"), "doc_id", "text", P8.tokenizer_path()).count() == 0
    enc = P8.encode_texts(df, "doc_id", "text", P8.tokenizer_path())
    assert sorted(r.text for r in P8.decode_ids(enc, "doc_id", "ids", P8.tokenizer_path()).collect()) == ["", "", "hello", "hello"]


# ---- problem 9


def test_leaks_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"слово{c}" for c in "абвгд"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 14)))) for k in range(12)] + [(98, None), (99, "")]
    docs = [(k, " ".join(rng.choice([*vocab, "чужое"]) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(70, None), (71, ""), (0, "повтор")]
    want = set()
    for d, t in docs:
        w = (t or "").split()
        for i, s in items:
            v = (s or "").split()
            if any(w[a : a + 4] == v[b : b + 4] for a in range(len(w) - 3) for b in range(len(v) - 3)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)).withColumn("i", F.lit(1))
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = P9.find_leaks(df, it, 4).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        w, v = dict(docs)[r.doc_id] if r.doc_id else docs[0][1], dict(items)[r.item_id]
        assert " ".join(w.split()[r.first_word - 1 : r.first_word - 1 + r.n_words]) in v
    assert P9.find_leaks(df, it.where("item_id > 200"), 4).count() == 0
    assert P9.find_leaks(df.where("doc_id > 200"), it, 4).count() == 0


def test_leak_words():
    assert P9.item_words("Т1ехьа ТӀЕХЬА тIехьа, ёлка_Елка") == ["тӏехьа"] * 3 + ["елка", "елка"]


def test_leaks_in_slices(monkeypatch):
    # a passage in every text, and runs of one word: the same matches however the hits are cut
    rng = random.Random(13)
    words = [f"слово{c}" for c in "абвгд"]
    items = P9.Items([(k, " ".join(rng.choice(words[: 1 + k]) for _ in range(40))) for k in range(5)], 4)
    texts = [" ".join(rng.choice(words[: 1 + k % 5]) for _ in range(60)) for k in range(30)] + [None, ""]
    whole = [x.tolist() for x in P9.leaks_in(texts, items, 4)]
    monkeypatch.setattr(P9, "SLICE", 37)
    assert [x.tolist() for x in P9.leaks_in(texts, items, 4)] == whole and len(whole[0]) > 30
    assert [x.tolist() for x in P9.leaks_in([], items, 4)] == [[], [], [], []]


# ---- problem 10


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, None),
        ("Серебряная сестра узнала сельский,\nВерный мастер заметил местный\nЗнаменитый плотник покрасил тихий,\nСтарый брат увидел." * 2, None),
        ("\n".join(f"слово{c} — значение" for c in "абвгд"), "list"),
        ("\n".join(f"{k}) Название, Имя" for k in range(1, 9)), "list"),
        ("\n".join(f"Имя{k} | {k} | 7{k}.5 | -" for k in range(6)), "table"),
        ("\n".join(f"{k};{k * 7};дом;{k * 3}" for k in range(1, 7)), "table"),
        ("~[=_=#{_\\|[|^^]^+>$/%_]<$}/%/%_}$" * 5, "junk"),
        ('<div class="c"><a href="/p/1">4</a></div> ' * 20, "junk"),
        ("рпмчс нмнжчб дздмрбш ьдлгдршч цжй фзнъхрьъ щшвхйцтъ", "junk"),
        ("одна фраза опять " * 30, "junk"),
        (PROSE + "\n1 | 2 | 3\n4 | 5 | 6\n7 | 8 | 9", None),
        ("", None),
        ("   \n", None),
    ],
)
def test_kinds(text, kind):
    assert P10.Stats(text, frozenset()).kind == kind


def test_stats_frame(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "Да и нет.", "z")], "doc_id bigint, text string, kind string")
    words = spark.createDataFrame([("rus", "и"), ("rus", None), ("rus", "и")], "lang string, word string")
    rows = {r.doc_id: r for r in P10.text_stats(docs, words).collect()}
    assert rows[1].n_words == 0 and rows[2].kind is None
    assert rows[3].n_words == 3 and abs(rows[3].common_share - 1 / 3) < 1e-9 and rows[3].end_punct_share == 1.0
    assert P10.text_stats(docs.where("doc_id > 9"), words).count() == 0


def padded(rows, gap="  "):
    widths = [max(map(len, c)) for c in zip(*rows)]
    return "\n".join(gap.join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


WORDS = [("яблоко", "красное", "сладкое"), ("груша", "жёлтая", "мягкая"), ("слива", "тёмно-синяя", "кислая"), ("айва", "светлая", "твёрдая"), ("вишня", "алая", "терпкая")]
LONG = [(a + " очень спелая", b + " снаружи и внутри", c + " на вкус осенью") for a, b, c in WORDS]
VERSE = ["Белый снег лежит на крыше,", "Ветер спит,", "Голос матери всё тише,", "Дом молчит,", "За рекой дымок кудрявый,", "Путь далёк,", "Над замёрзшею дубравой", "Огонёк."]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (padded(WORDS), "table"),  # words under each other, no numbers
        (padded([tuple(c.rjust(12) for c in r) for r in WORDS]), "table"),
        (padded(WORDS, " "), "table"),  # one blank beside the longest cell
        (padded(LONG, " | "), "table"),
        ("\n".join("| ".join(r) for r in LONG), None),
        # entries over two lines: by indents, and by lengths
        ("\n".join(f"- {'бава' * k}\n    {'ваба' * k} и не другое" for k in range(1, 9)), "list"),
        ("\n".join(f"{a}\nплод {b} и {c} на вкус осенью" for a, b, c in WORDS), "list"),
        # the same shapes in verse and prose
        ("\n".join(VERSE), None),
        ("\n".join(("    " if k % 2 else "") + x for k, x in enumerate(VERSE)), None),
        ("\n".join("  ".join(PROSE.split()[k : k + 7]) for k in range(0, 35, 7)), None),
        ("\n".join(" ".join(PROSE.split()[k : k + 7]).replace(" ", "   ", 2) for k in range(0, 35, 7)), None),
    ],
)
def test_layout(text, kind):
    assert P10.Stats(text, frozenset()).kind == kind


def test_layout_measures():
    assert P10.agreement(padded(WORDS).split("\n"), "  ") == 1.0
    assert P10.agreement(["a;bb;c", "aaa;b;c", "aaaaa;b;c"], ";") < 0.5
    assert P10.agreement(["a\tb", "aaaa\tb"], "\t") == 1.0
    for p in (2, 3, 5):
        period, corr = P10.indent_period([" " * (4 * (k % p > 0)) + "слово" for k in range(6 * p)])
        assert period == p and corr > P10.PERIODIC
    assert P10.indent_period(["слово"] * 9) == (0, 0.0) and P10.indent_period([]) == (0, 0.0)
    s = P10.Stats("\n".join(f"{a}\n  {b}" for a, b, _ in WORDS), frozenset())
    assert s.indent_period == 2 and s.indent_corr > P10.PERIODIC
