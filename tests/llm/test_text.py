import random

import pytest
from pyspark.sql import functions as F

from figmill.llm import bpe, pack, spam

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(), special_tokens={})


def texts():
    rng = random.Random(10)
    marks = list("abcdefgh  \n\t'’.,-_=0123456789ACGTäéß的图标量—☆​\xa0　😀́")
    made = ["".join(rng.choices(marks, k=rng.randrange(1, 60))) for _ in range(250)]
    runs = ["=" * 700, "a" * 333, "0123456789" * 60, "ACGT" * 80, " " * 50 + "x", "的" * 200, "█" * 150, "".join(rng.choices("ACGT", k=900)), "".join(rng.choices("0123456789", k=900)), "ÃÂ" * 90]
    return [*made, *runs, "I'll we've IT'S 'tis", "<|endoftext|> x", "", None, "   ", "\r\n\r\n", "é" * 3, "word " * 2000]


@pytest.mark.parametrize("codes", [0, 5, 1 << 15])
def test_same_ids(spark, reference, codes):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "i int, text string, ids string")
    got = {r["i"]: r["ids"] for r in bpe.encode(df, most_codes=codes).collect()}
    assert {i: reference.encode_ordinary(t or "") for i, t in rows} == got


def test_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in texts() if t], "text string")
    e = bpe.Encoder()
    assert bpe.encode(df).where(~e.decode(F.col("ids")).eqNullSafe(F.encode("text", "UTF-8"))).count() == 0
    assert spark.range(1).select(e.decode(F.array(F.lit(-1)))).first()[0] is None
    assert bpe.encode(df.limit(0)).count() == 0


def test_patterns_use_every_item():
    rng = random.Random(11)
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        found = pack.patterns(counts, 64)
        assert all(sum(s * n for s, n in p.items()) <= 64 for p, _ in found)
        assert {s: sum(p.get(s, 0) * k for p, k in found) for s in counts} == counts
    assert pack.patterns({}, 64) == []


def test_best_two_fit():
    # 60 leaves 40; the greedy 35 gives way to 20 + 20, which fill it.
    assert ({60: 1, 20: 2}, 1) in pack.patterns({60: 1, 35: 1, 20: 2}, 100)


def test_pack(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([1, 7, 7, 7, 20, 45, 64, 65, 200])) for i in range(4000)] + [(9000, 0), (9001, None), (9002, -3)]
    df = spark.createDataFrame(rows, "doc int, tokens int").withColumn("piece", F.lit("clash"))
    got = [tuple(r) for r in pack.pack(df, "doc", "tokens", 64).collect()]
    fill, whole = {}, {}
    for container, doc, piece, size in got:
        fill[container] = fill.get(container, 0) + size
        whole.setdefault(doc, []).append((piece, size))
    assert max(fill.values()) <= 64 and set(fill) == set(range(len(fill)))
    assert {d: sum(s for _, s in p) for d, p in whole.items()} == {d: t for d, t in rows if t and t > 0}
    assert all([s for _, s in sorted(p)] == ([64] * ((t - 1) // 64) + [t - (t - 1) // 64 * 64]) for d, t in rows if t and t > 0 for p in [whole[d]])
    assert len(fill) <= 1.02 * sum(fill.values()) / 64
    again = pack.pack(df.repartition(7), "doc", "tokens", 64)
    assert {tuple(r) for r in again.collect()} == set(got)
    assert pack.pack(df.limit(0), "doc", "tokens", 64).count() == 0


PROSE = {
    "en": "The samples were kept in the dark for two days and then measured again, because the first run had not been stable at all. ",
    "de": "Die Proben wurden nach zwei Tagen erneut gemessen, weil der erste Lauf nicht stabil war und die Werte aus dem Rahmen fielen. ",
    "fr": "Les échantillons ont été mesurés après deux jours, car la première série n'est pas restée stable pendant le séchage. ",
    "es": "Las muestras se midieron después de dos días, porque la primera serie no fue estable durante el secado en el horno. ",
    "zh": "样品在干燥两天后重新测量,因为第一次实验的结果并不稳定。低于阈值的数值被视为缺失,并从统计中剔除。",
}
STUFFED = [
    "cheap figures, figure maker, bar chart, free chart, Figure Maker, heatmap, roc curve, box plot, BAR CHART, poster print, plot theme, graph paper",
    "\n".join(f"box plot 2026 part {i}" for i in range(20, 60)),
    "".join(f"- [violin plot best](http://shop.figdepot{i}.test/page/set{i})\n" for i in range(15)),
    "".join(f'<li><a href="https://cdn.axisfarm.example/tag{i}">poster hd</a></li>\n' for i in range(15)),
    " ".join(f"#GraphPaper{i} #heat_map" for i in range(12)),
    "图片放大 火山图 图表模板 在线作图 " * 12,
    "nuage de points | mapa de calor | modèle gratuit | affiche | étiquette | " * 5,
    "图片放大 | 火山图 | 热图 | 柱状图 | " * 8 + "样品的相对丰度明显升高(P = 0.133)。\n" + "热图\n柱状图\n" * 15,
    PROSE["en"] + "line graph ☆ volcano plot ☆ diagram app ☆ figure editing ☆ " * 8,
]
PLAIN = [
    *(p * 4 for p in PROSE.values()),
    "import numpy as np\nfig, ax = plt.subplots()\nax.plot(x, y0, color='grey', label='AB-1')\nax.set_xlabel('strain')\n" * 5,
    ">AB12 fragment\n" + "\n".join("".join(random.Random(i).choices("ACGT", k=60)) for i in range(20)),
    "DAB-1 | VHR22 | KKX-3\n" + "\n".join(f"{i}.213 | {i}.77 | 12.{i}" for i in range(30)),
    "a Fit of albedo against merin, R² = 2.1. b Share of model lakes with small strain. c Ranked effects on decay rate; dashed line, 6.89. " * 3,
    "1. Survey Team 9. Each point is one of 30 lakes. J. Inv. Fig. 12, 34–50 (2004). doi:10.5555/ref.1\n" * 6,
    "ζα³±⁻∞µαβ→²η≤β√ε δ Ω≥µ²Åθα√µεζ²αηγ× " * 8,
    "5954155807446507" * 20,
    PROSE["en"] * 3 + "cheap figures, figure maker, bar chart, free chart, heatmap, roc curve",
]


#: Frames of sentences; {} are words made for the test, so that only the frames' own words are frequent.
FRAMES = {
    "en": ["The {} of the {} was kept in the {} and then the {} were measured again.", "It is the {} that we have on the {}, but not the {} of a {}.", "We found that the {} is in the {} and that a {} was near the {}."],
    "de": ["Die {} der {} wurde in der {} gemessen und die {} war nicht stabil.", "Wir haben die {} mit der {} in einer {} gesehen, und das {} ist nicht die {}.", "Das {} ist in der {} und die {} war auf der {}."],
    "fr": ["La {} de ce {} est dans le {} et les {} ont été mesurés.", "Nous avons vu que le {} est sur la {} et que les {} ne sont pas là.", "Les {} ont été vus après le {}, car une {} est dans un {}."],
    "es": ["La {} de este {} se midió en el {} y los {} no fueron {}.", "El {} es lo que se ve en un {} y en la {} de los {}.", "Los {} y las {} son el {} que se tiene en una {}."],
    "zh": ["样品的{}被测量了,并且{}的结果是{}。", "我们的{}和{}是{}中的,也是{}的。", "该{}的{}与{}的{}为一。"],
}
LETTERS = {"zh": "水木金土石田禾竹米虫鱼马牛羊鸟犬日月星云雨风雪江河湖海松柏梅兰菊桃李杏梨枣瓜豆麦稻"}


def prose_pages(pages=60, seed=20):
    rng = random.Random(seed)
    out = []
    for lang, frames in FRAMES.items():
        letters = LETTERS.get(lang, "bdfgklmnprstvz")
        word = lambda: "".join(rng.choice(letters) + ("" if lang in LETTERS else rng.choice("aeiou")) for _ in range(rng.randrange(2, 4)))  # noqa: B023, E731
        for _ in range(pages):
            sentences = [f.format(*[word() for _ in range(f.count("{}"))]) for f in rng.choices(frames, k=rng.randrange(6, 20))]
            out.append((" ".join(sentences), lang))
    return out


FOREIGN = [
    "Учёные измерили рост клеток новым способом и тщательно сравнили полученные результаты с прежними данными. ",
    "Bilim insanları hücrelerin büyümesini yeni bir yöntemle ölçtü ve sonuçları önceki verilerle dikkatle karşılaştırdı. ",
    "Naukowcy zmierzyli wzrost komórek nową metodą i starannie porównali otrzymane wyniki z wcześniejszymi danymi. ",
    "قاس العلماء نمو الخلايا بطريقة جديدة وقارنوا النتائج بعناية مع البيانات السابقة في المختبر. ",
    "研究者は新しい方法で細胞の成長を測定し、その結果を以前のデータと注意深く比較しました。",
]
BREAKS = spam.breaks([w for ws in ("the of was were in and for then again had not been at", "die der und wurden nach weil war aus dem", "les ont été après car la est pas le", "las se de porque no fue en el", "并 的") for w in ws.split()])


def corpus():
    """(rows, ids of stuffed pages): each stuffed page in three slightly different texts, so that its words are known."""
    rows = prose_pages()
    stuffed = range(len(rows), len(rows) + 3 * len(STUFFED))
    rows += [(f"{p} {k}", lang) for p in STUFFED for k, lang in enumerate(("en", None, "und"))]
    return rows + [(p, "en") for p in PLAIN * 3], set(stuffed)


def found_in(spark, rows):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string").withColumn("size", F.lit(1)).withColumn("key", F.lit("clash"))
    return {r["doc_id"] for r in spam.stuffed_pages(df).collect()}


def test_stuffed_share(spark):
    df = spark.createDataFrame([(t,) for t in STUFFED[:-3] + PLAIN if t not in FOREIGN], "text string")
    shares = [r[0] for r in df.select(spam.stuffed_share(F.col("text"), F.lit(BREAKS))).collect()]
    assert [s > 0.5 for s in shares] == [True] * len(STUFFED[:-3]) + [False] * len(PLAIN)


def test_stuffed_pages(spark):
    rows, stuffed = corpus()
    got = found_in(spark, [*rows, ("", None), (None, "en"), (" \n", "en"), ("x", None)])
    assert len(got & stuffed) >= 0.85 * len(stuffed) and got <= stuffed
    empty = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert spam.stuffed_pages(empty).count() == 0


def test_other_languages_and_copies(spark):
    """Sentences in languages without a reference are not found, and copies of a stuffed page with words of prose, as a third of all rows, are not the norm."""
    rows, stuffed = corpus()
    foreign = [(s * 4, lang) for s in FOREIGN for lang in ("en", None)]
    copies = range(len(rows) + len(foreign), len(rows) + len(foreign) + len(rows) // 2)
    got = found_in(spark, rows + foreign + [(f"{STUFFED[-1]} 0", "en")] * len(copies))
    assert set(copies) <= got <= stuffed | set(copies)
    # By itself the check would take a sentence of an unknown language for keywords.
    share = spark.createDataFrame([(FOREIGN[1] * 4,)], "text string").select(spam.stuffed_share(F.col("text"), F.lit(BREAKS)))
    assert share.first()[0] > 0.5


def test_no_labels_and_few_pages(spark):
    rows, _ = corpus()
    rows = [(i, t) for i, (t, lang) in enumerate(rows) if i < 60 or t.startswith(STUFFED[1])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r["doc_id"] for r in spam.stuffed_pages(df).collect()} == {i for i, _ in rows if i >= 60}
    assert spam.stuffed_pages(df.limit(20)).count() == 0  # fewer texts than make a reference


def test_page_shapes(spark):
    df = spark.createDataFrame([("The the the THE of of heatmap", "en"), ("heatmap heatmap", None), ("heatmap heatmap", "de"), ("?!", "en")], "text string, label string")
    got = {r["size"]: r for r in spam.page_shapes(df).collect()}
    assert set(got) == {7, 2} and got[7]["slope"] < -1 and (got[2]["slope"], got[2]["copies"], got[2]["label"]) == (0.0, 2, "de")
    assert [tuple(w) for w in got[7]["words"]] == [("heatmap", 1), ("of", 2), ("the", 4)]


def test_checks_only_what_can_be_found(spark):
    """Runs that all together are no more than half of a page are not looked at; a page's decision is the same."""
    marked = PROSE["en"] * 3 + "cheap figures, figure maker, bar chart, free chart, heatmap, roc curve, box plot, graph paper, poster print, plot theme"
    df = spark.createDataFrame([(marked,), (spam.CUT + STUFFED[0],), ("\n \t" + STUFFED[0] + "\r\n",), (STUFFED[0],)], "text string")
    shares = [r[0] for r in df.select(spam.stuffed_share(F.col("text"), F.lit(BREAKS))).collect()]
    assert shares[0] == 0.0 and all(s > 0.5 for s in shares[1:])


def test_words_with_and_without_han(spark):
    df = spark.createDataFrame([(" The the, théâtre_2a X-ray²! 😀a",), ("a图b热图 a",), ("?!",), ("",)], "text string")
    got = [r[0] and [tuple(w) for w in r[0]] for r in df.select(spam.word_counts(F.col("text"))).collect()]
    assert got == [[("2a", 1), ("a", 1), ("ray²", 1), ("the", 2), ("théâtre", 1), ("x", 1)], [("a", 2), ("b", 1), ("图", 2), ("热", 1)], None, None]
