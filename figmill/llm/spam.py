"""Keyword-stuffed and link-list pages, told from same-language prose by rank-frequency curves.

Nothing about a language is given: what prose looks like is learnt from the corpus, each distinct text counted once, so
that copies shift nothing.

1. SQL windows fit the rank-frequency curve of each distinct text: slope and residual of log frequency over log rank.
2. The texts of a language whose curve is not extreme among those of comparable length are its first prose. The head of
   the prose's own curve, the words that make up its first HEAD tokens and are rarer in the other texts, are
   the reference. Texts diverge where the head's share of their tokens is far below that of prose of the same
   language and a comparable length. Head and divergence are learnt from each other in ROUNDS.
3. Pages with an extreme slope, residual or divergence are flagged, and only these are checked exactly: found are those
   more than half of whose characters are runs of words without a word of the reference.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figmill.llm import common as C
from figmill.sources.tables import Stage

HAN = "\\u4e00-\\u9fff"
TOKEN = rf"[{HAN}]|[a-z0-9[\p{{L}}\p{{N}}&&[^{HAN}]]]++"
#: Fewest distinct texts of a language that make a reference; pages of other languages are never found.
REFERENCE_TEXTS = 30
#: Words are of the head while the more frequent ones make up less than this share of the prose's tokens.
HEAD = 0.32
#: Least share of a word among the tokens of a language's texts to be looked at; it bounds them to 1,000 a language.
HEAD_WORD = 0.001
#: How many times more frequent in prose than in diverging texts a word of the head is, round by round, and than in the pages found first.
ROUNDS, FOUND_RATIO = (1.3, 2.0, 2.0), 6.0
FEW_TOKENS = 1000
#: Robust deviations from the median beyond which a slope or residual is extreme.
EXTREME = 3.0
#: Part of the usual share of the head below which texts are no prose to learn from, and below which pages are flagged.
NOT_PROSE, FLAGGED = 0.5, 0.7
#: A page is in the reach of the corpus if so much of its words is known from so many distinct texts.
KNOWN_SHARE, KNOWN_TEXTS = 0.4, 3
#: A Han run of more than this many characters is a clause, not a keyword.
HAN_KEYWORD = 7
HAN_PER_WORD = 2.2
#: Words without a word of the reference that make a run; fewer suffice where the run is nearly the whole page.
RUN_WORDS, PAGE_RUN_WORDS, PAGE_SHARE = 16, 10, 0.9
STUFFED_SHARE = 0.5
#: Fewest letters of a word on average, a Han character counting as two; runs of single letters are symbols.
WORD_LETTERS = 2.2

#: Names before an equals sign that are markup.
ATTRIBUTES = ["href", "content", "name", "class"]
#: Two noncharacters of one category and width: the one marks where runs end, the other stands for it in texts.
CUT, NO_CUT = "\ufffe", "\uffff"

_KEY = ["key", "key2"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def word_counts(text: Column) -> Column:
    """Array of (word, n) of the distinct lower-cased words of a text, in order; sorted and counted within the row."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(begins, lambda b: F.transform(b, lambda p, j: F.struct(F.get(s, p).alias("word"), (F.coalesce(F.get(b, j + 1), F.size(s)) - p).alias("n"))))

    # Without a Han character, words are what separators leave, and a split makes fewer objects than a search.
    lowered = F.lower(text)
    split = F.array_remove(F.split(lowered, r"[^a-z0-9\p{L}\p{N}]++"), "")
    found = F.when(text.rlike(f"[{HAN}]"), F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))).otherwise(split)
    return _let(F.sort_array(found), lambda s: F.when(F.size(s) > 0, runs(s)))


def _text_keys(text: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(text).alias("key"), F.hash(text).alias("key2")]


def page_shapes(texts: DataFrame) -> DataFrame:
    """key, key2, copies, label, size, slope, residual, words of each distinct text of (text, label).

    slope and residual (root mean square) are those of the least-squares line of log frequency over log rank, words of
    equal frequency taking their mean rank. Copies are reduced to one row within each task, so that a text with a third
    of all rows sends one row a task; that is the only shuffle, and counting and all windows keep to it. label is the greatest of the labels of a text. Texts without a word have no row.
    """
    keyed = texts.select(*_text_keys(F.col("text")), "label", "text")
    once = keyed.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max("label").alias("label"), F.first("text").alias("text"))
    once = once.select(*_KEY, "copies", "label", word_counts(F.col("text")).alias("words"))
    # Equal frequencies are counted within the row by the same kind of fold, so windows see a few rows a text; the words that occur once, most of them, need no sorting.

    def classes(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(begins, lambda b: F.transform(b, lambda p, j: F.struct(F.get(s, p).alias("n"), (F.coalesce(F.get(b, j + 1), F.size(s)) - p).alias("k"))))

    def all_classes(more: Column) -> Column:
        once_only = F.array(F.struct(F.lit(1).alias("n"), (F.size("words") - F.size(more)).alias("k")))
        several = F.when(F.size(more) > 0, classes(more)).otherwise(F.slice(once_only, 1, 0))
        return F.concat(several, F.when(F.size(more) < F.size("words"), once_only).otherwise(F.slice(once_only, 1, 0)))

    several = F.sort_array(F.transform(F.filter("words", lambda w: w["n"] > 1), lambda w: w["n"]), False)
    rows = once.select(*_KEY, "copies", "label", "words", F.posexplode(_let(several, all_classes)).alias("pos", "class"))
    rows = rows.select(*_KEY, "copies", "label", F.when(F.col("pos") == 0, F.col("words")).alias("words"), "class.n", "class.k")
    upto = F.sum("k").over(W.partitionBy(*_KEY).orderBy(F.desc("n")))
    points = rows.withColumn("x", F.log(upto - (F.col("k") - 1) / 2)).withColumn("y", F.log("n"))
    sums = {"k": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") ** 2, "xy": F.col("x") * F.col("y"), "yy": F.col("y") ** 2}
    fit = points.groupBy(*_KEY).agg(F.max("copies").alias("copies"), F.max("label").alias("label"), F.first("words", True).alias("words"), F.sum(F.col("n") * F.col("k")).alias("size"), *[F.sum(F.col("k") * v).alias(f"s_{c}") for c, v in sums.items()])
    mean_x, mean_y = F.col("s_x") / F.col("s_k"), F.col("s_y") / F.col("s_k")
    var_x, var_y = F.col("s_xx") / F.col("s_k") - mean_x**2, F.col("s_yy") / F.col("s_k") - mean_y**2
    cov = F.col("s_xy") / F.col("s_k") - mean_x * mean_y
    slope = F.when(var_x > 1e-9, cov / var_x).otherwise(0.0)
    fit = fit.withColumn("slope", slope).withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), var_y - F.col("slope") * cov)))
    return fit.select(*_KEY, "copies", "label", "size", "slope", "residual", "words")


def _extreme(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``extreme``: whether slope or residual is far from the median of the same label and size octave.

    Medians and quartiles are kept for labels and octaves of REFERENCE_TEXTS texts, a table of a few hundred rows.
    """
    quarter = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c)
    norms = shapes.groupBy("label", "octave").agg(F.count("*").alias("texts"), quarter("slope"), quarter("residual")).where(F.col("texts") >= REFERENCE_TEXTS)
    norms = norms.select("label", "octave", F.col("slope").alias("q_slope"), F.col("residual").alias("q_residual"))
    far = lambda c: (F.col(c) - F.col(f"q_{c}")[1]) / F.greatest(F.lit(0.02), (F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]) / 1.349)
    extreme = (F.abs(far("slope")) > EXTREME) | (far("residual") > EXTREME)
    return shapes.join(F.broadcast(norms), ["label", "octave"], "left").withColumn("extreme", F.coalesce(extreme, F.lit(False))).drop("q_slope", "q_residual")


def _heads(counted: DataFrame, ratio: float) -> dict[str, list[str]]:
    """label -> the head of its prose's rank-frequency curve, of rows (label, word, prose, other): tokens in prose and elsewhere.

    At most 1 / HEAD_WORD words of a label are ranked, so windows and the driver see a bounded table.
    """
    totals = counted.groupBy("label").agg(F.sum("prose").alias("all_prose"), F.sum("other").alias("all_other"))
    rows = counted.join(F.broadcast(totals), "label").where(F.col("prose") > HEAD_WORD * F.col("all_prose"))
    before = F.sum("prose").over(W.partitionBy("label").orderBy(F.desc("prose"), "word")) - F.col("prose")
    rows = rows.withColumn("before", before).where(F.col("before") <= HEAD * F.col("all_prose"))
    # Few other tokens are little evidence against a word, so that they count as among FEW_TOKENS more.
    enough = F.col("prose") / F.col("all_prose") >= ratio * F.col("other") / (F.col("all_other") + FEW_TOKENS)
    rows = rows.where(enough & F.col("word").rlike(r"\p{L}")).select("label", "word").collect()
    heads: dict[str, list[str]] = {}
    for label, word in sorted(tuple(r) for r in rows):
        heads.setdefault(label, []).append(word)
    return heads


def _sums(known: DataFrame, listed: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """label, word and tokens as ``name`` of the labelled texts in ``keys``; all words that aren't ``listed`` count as the word ''."""
    words = known.join(C.broadcast_if_small(keys, 1_000_000), _KEY, "left_semi").select("label", F.explode("words").alias("w"))
    words = words.select("label", "w.word", "w.n").join(F.broadcast(listed.withColumn("own", F.col("word"))), "word", "left")
    return words.groupBy("label", F.coalesce("own", F.lit("")).alias("word")).agg(F.sum(F.col("n").cast("long")).alias(name))


def _masses(shapes: DataFrame, texts: DataFrame, heads: dict[str, list[str]]) -> DataFrame:
    """The ``texts`` with ``language``, the reference with most tokens in a text (the first label on a tie), and ``mass``, their share.

    The heads are looked up by a broadcast join with one column a label, so that only a text's words of a head are kept
    and summed up where they stand, and two rows a text are shuffled: these sums and what is known of the text.
    """
    labels = sorted(heads)
    listed = {w: [int(w in heads[label]) for label in labels] for ws in heads.values() for w in ws}
    columns = [f"__m{i}" for i in range(len(labels))]
    flags = shapes.sparkSession.createDataFrame([(w, *listed[w]) for w in sorted(listed)], "word string, " + ", ".join(f"{c} int" for c in columns))
    own = {"copies": "long", "size": "long", "octave": "int", "extreme": "boolean"}  # no strings: these would make the aggregation sort
    words = shapes.select(*_KEY, F.explode("words").alias("w")).select(*_KEY, "w.word", "w.n").join(F.broadcast(flags), "word")
    words = words.select(*_KEY, *[F.lit(None).cast(t).alias(c) for c, t in own.items()], *[(F.col("n") * F.col(c)).alias(c) for c in columns])
    rows = words.unionByName(texts.select(*_KEY, *own, *[F.lit(0).alias(c) for c in columns]))
    sums = rows.groupBy(*_KEY).agg(*[F.max(c).alias(c) for c in own], *[F.sum(c).alias(c) for c in columns])
    most = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    language = F.coalesce(*[F.when(F.col(c) == F.col("most"), F.lit(label)) for c, label in zip(columns, labels, strict=True)])
    return sums.withColumn("most", most).select(*_KEY, *own, language.alias("language"), (F.col("most") / F.col("size")).alias("mass"))


def _relative(texts: DataFrame, prose: Column) -> DataFrame:
    """``texts`` with ``relative``, their mass over the median of prose of the language and size octave (of the language, where these are few)."""
    middle = F.percentile_approx("mass", 0.5, 1000)
    sized = texts.where(prose).groupBy("language", "octave").agg(F.count("*").alias("texts"), middle.alias("usual")).where(F.col("texts") >= REFERENCE_TEXTS)
    whole = texts.where(prose).groupBy("language").agg(middle.alias("usual_any"))
    both = texts.join(F.broadcast(sized.drop("texts")), ["language", "octave"], "left").join(F.broadcast(whole), "language", "left")
    return both.withColumn("relative", F.col("mass") / F.greatest(F.lit(1e-9), F.coalesce("usual", "usual_any", F.lit(1.0)))).drop("usual", "usual_any")


def _trie(words: set[str]) -> str:
    """An alternation of words that shares their beginnings."""
    tree: dict = {}
    for w in sorted(words):
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def text(node: dict) -> str:
        if set(node) == {""}:
            return ""
        parts = [ch + text(sub) for ch, sub in node.items() if ch]
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + "?" if "" in node else body

    return text(tree)


def breaks(words: list[str]) -> str:
    """A pattern of what ends a run of keywords: words of a reference, elisions and contractions, and Han clauses.

    A word is matched with the character before it, which is no part of a run either: so most places in a text, those
    within words, fail at the first character. A text needs a blank before its first word.
    """
    one_han = [w for w in words if len(w) == 1 and "一" <= w <= "鿿"]
    latin = {w for w in words if w not in one_han}
    latin |= {x for w in latin for x in (w.capitalize(), w.upper())}  # faster than matching without regard to case
    edge = r"\p{L}\p{N}"
    ends = [rf"(?:{_trie(latin)})(?![{edge}])"] if latin else []
    out = [rf"[^{edge}](?=\p{{L}})(?:{'|'.join([*ends, "(?<=['’])"])})", rf"[{HAN}]{{{HAN_KEYWORD + 1},}}"]
    if one_han:
        out.append(rf"(?=[{HAN}])[{HAN}]{{0,{HAN_KEYWORD}}}[{''.join(one_han)}][{HAN}]*")
    return "|".join(out)


def _once(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _page(text: Column) -> Column:
    """plain, the text without markup names and the frames of Markdown links, and size, its characters without blanks around."""

    def where(text: Column, marks: list[str], then: Column) -> Column:
        """A search for a few bytes first, as most texts have no markup."""
        return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks]), then).otherwise(text)

    # Another character without a meaning stands in for CUT, which is then only what is put in.
    plain = where(text, [CUT], F.translate(text, CUT, NO_CUT))
    plain = _once(plain, lambda p: where(p, ["]("], F.regexp_replace(p, r"\[([^\]\n]*)\]\(([^)\s]*)\)", " $1  $2 ")))
    plain = _once(plain, lambda p: where(p, ["<", *(f"{a}=" for a in ATTRIBUTES)], F.regexp_replace(p, rf"</?[a-zA-Z][a-zA-Z0-9]*\b|(?=[{''.join(a[0] for a in ATTRIBUTES)}])\b(?:{'|'.join(ATTRIBUTES)})=", " ")))
    return _once(plain, lambda p: F.struct(p.alias("plain"), F.length(F.btrim(p, F.lit(" \t\n\x0b\f\r"))).alias("size")))


def stuffed_share(text: Column, pattern: Column) -> Column:
    """Share of a page's characters in runs of keywords, links or tags; 0 for null and blank texts, and where all runs together are no more than STUFFED_SHARE.

    ``pattern`` (of ``breaks``) ends runs. Runs of mostly numbers, brackets, symbols, coded names or unbroken sequences
    are tables, code, references or data and do not count.
    """
    return _page_share(_page(text), pattern)


def _page_share(page: Column, pattern: Column) -> Column:
    """stuffed_share of a text as ``_page`` gives it."""

    def counted(run: Column, pattern: str) -> Column:
        return F.regexp_count(run, F.lit(pattern))

    def of(run: Column, kind: str) -> Column:
        """How many characters are of a class; no match becomes a string of its own, as it does where matches are counted."""
        return F.length(run) - F.length(F.regexp_replace(run, f"{kind}++", ""))

    def text_like(run: Column, n: Column) -> Column:
        counts = F.struct(of(run, r"\p{L}").alias("letters"), of(run, r"[\p{N}&&[^\p{No}]]").alias("digits"), (n["latin"] + n["han_runs"]).alias("words"), (counted(run, rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}&&[^{HAN}]]") + n["han_runs"]).alias("named"))

        def check(c: Column) -> Column:
            spelled = c["letters"] + n["han"] >= WORD_LETTERS * c["named"]
            codes = counted(run, r"(?<![\p{L}\p{N}])[A-Z]{2,4}-?[0-9]")
            words = (c["digits"] <= c["letters"]) & spelled & (c["named"] >= 0.45 * c["words"]) & (codes <= 0.1 * c["words"])
            signs = of(run, r"[\p{No}[\p{Sm}&&[^\x00-\x7f←-⇿]]]")
            plain_share = F.when(c["digits"] > 0, 0.385).otherwise(0.55)
            unbroken = F.length(F.array_join(F.regexp_extract_all(run, F.lit(r"[\p{L}\p{N}&&[^" + HAN + r"]]{26,}"), F.lit(0)), ""))
            return words & (signs <= 0.15 * c["letters"]) & (c["letters"] >= plain_share * of(run, r"\S")) & (of(run, r"[()\[\]{}]") <= 0.015 * F.length(run)) & (unbroken <= 0.4 * F.length(run))

        return _once(counts, check)

    def stuffed(run: Column, size: Column) -> Column:
        counts = F.struct(of(run, f"[{HAN}]").alias("han"), counted(run, f"[{HAN}]+").alias("han_runs"), counted(run, rf"[\p{{L}}\p{{N}}&&[^{HAN}]]+").alias("latin"))

        def judge(n: Column) -> Column:
            words = n["latin"] + F.greatest(n["han_runs"].cast("double"), n["han"] / HAN_PER_WORD)
            long_enough = (words >= RUN_WORDS) | ((words >= PAGE_RUN_WORDS) & (F.length(run) >= PAGE_SHARE * size))
            return F.when(long_enough, F.when(text_like(run, n), F.length(run)))

        return _once(counts, judge).cast("long")

    def share(page: Column) -> Column:
        size = page["size"]
        # One character ends runs, so that the pattern is compiled once for texts of one language in a row, which a split doesn't.
        pieces = F.filter(F.split(F.regexp_replace(F.concat(F.lit(" "), page["plain"]), pattern, F.lit(CUT)), CUT), lambda s: F.length(s) >= 2 * PAGE_RUN_WORDS)
        # Trimming only shortens, so that most pieces need none.
        trimmed = F.transform(pieces, lambda s: F.regexp_replace(s, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", ""))
        runs = F.filter(trimmed, lambda s: F.length(s) >= 2 * PAGE_RUN_WORDS)
        most = lambda rs: F.aggregate(rs, F.lit(0).cast("long"), lambda total, s: total + F.length(s))
        total = lambda rs: F.aggregate(rs, F.lit(0).cast("long"), lambda total, s: total + F.coalesce(stuffed(s, size), F.lit(0)))
        return _once(runs, lambda rs: F.when(most(rs) > STUFFED_SHARE * size, total(rs) / size))

    return F.coalesce(_once(page, share), F.lit(0.0))


def _share(heads: dict[str, list[str]]) -> Column:
    """stuffed_share of the text of ``page`` by the reference of ``language``."""
    pattern = F.lit(None).cast("string")
    for label, ws in sorted(heads.items()):
        pattern = F.when(F.col("language") == label, F.lit(breaks(ws))).otherwise(pattern)
    return _page_share(F.col("page"), pattern)


@dataclass
class Flagged:
    """What the fit says: the texts of languages with a reference, the frequent words, the sums of these, the texts that are no prose, the flagged ones, and the references."""

    known: DataFrame
    listed: DataFrame
    totals: DataFrame
    others: DataFrame
    flagged: DataFrame
    heads: dict[str, list[str]]


def _label(documents: DataFrame, lang: str) -> Column:
    """The first two letters of the language as given, null for none; one label for all where there is no such column."""
    if lang not in documents.columns:
        return F.lit("")
    given = F.lower(F.trim(F.col(lang).cast("string")))
    return F.when(~given.isin("", "und", "unknown", "none", "null"), F.left(given, F.lit(2)))


def flag(documents: DataFrame, text: str = "text", lang: str = "lang") -> Flagged | None:
    """The distinct texts with an extreme slope, residual or divergence; None where no language has a reference."""
    usable = documents.where(F.col(text).rlike(r"[\p{L}\p{N}]")).select(F.col(text).alias("text"), _label(documents, lang).alias("label"))
    shapes = Stage(page_shapes(usable).withColumn("octave", F.floor(F.log2("size")).cast("int"))).df
    labels = shapes.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("texts"))
    labels = labels.where(F.col("texts") >= REFERENCE_TEXTS).select("label")
    # 64 bits stand for the texts of a word: so many bits are so many distinct texts at least, copies or not.
    words = shapes.select("label", F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"), F.explode("words").alias("w"))
    words = words.groupBy("label", F.col("w.word").alias("word")).agg(F.sum(F.col("w.n").cast("long")).alias("n"), F.bit_or("bit").alias("bits"))
    words = Stage(words).df
    named = words.join(F.broadcast(labels), "label")
    totals = named.groupBy("label").agg(F.sum("n").alias("total"))
    often = named.join(F.broadcast(totals), "label").where(F.col("n") > HEAD_WORD / 2 * F.col("total"))
    often = sorted(r[0] for r in often.select("word").distinct().collect())
    if not often:
        return None
    # From here on only the words that may be of a head are told apart, at most 2 / HEAD_WORD a label, and one for all others.
    listed = shapes.sparkSession.createDataFrame([(w,) for w in often], "word string")
    own = F.when(F.col("word").isin(often), F.col("word")).otherwise("")
    totals = Stage(named.groupBy("label", own.alias("word")).agg(F.sum("n").alias("total"))).df
    known = shapes.join(F.broadcast(labels), "label")
    texts = shapes.drop("words").join(F.broadcast(labels.withColumn("known", F.lit(True))), "label", "left")
    texts = Stage(_extreme(texts.withColumn("label", F.when(F.col("known"), F.col("label"))).drop("known"))).df
    others, heads, judged = texts.where("extreme").select(*_KEY), {}, texts
    for ratio in ROUNDS:
        counted = totals.join(_sums(known, listed, "other", others), ["label", "word"], "left").withColumn("other", F.coalesce("other", F.lit(0)))
        heads = _heads(counted.withColumn("prose", F.col("total") - F.col("other")), ratio)
        if not heads:
            return None
        out = C.broadcast_if_small(others, 1_000_000).withColumn("out", F.lit(True))
        massed = Stage(_masses(shapes, texts, heads).join(out, _KEY, "left")).df
        judged = Stage(_relative(massed, F.col("out").isNull()).drop("out")).df
        others = judged.where(F.col("relative") < NOT_PROSE).select(*_KEY)
    flagged = judged.where(F.col("extreme") | (F.col("relative") < FLAGGED)).select(*_KEY, "copies", "language")
    return Flagged(known, listed, totals, others, _known(shapes, words, often, Stage(flagged).df), heads)


def _known(shapes: DataFrame, words: DataFrame, often: list[str], flagged: DataFrame) -> DataFrame:
    """The ``flagged`` texts at least KNOWN_SHARE of whose words (by tokens) are in KNOWN_TEXTS distinct texts or more.

    Others are in a language, or made of names, that the corpus has nothing to compare with. The commonest words are
    looked up within the row; each of the others is a small part of all tokens, so none is a hot key of the join.
    """
    known = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).where(F.bit_count("bits") >= KNOWN_TEXTS).select("word", F.lit(1).alias("known"))
    common = F.broadcast(words.sparkSession.createDataFrame([(w,) for w in often], "word string"))
    mine = shapes.join(C.broadcast_if_small(flagged, 1_000_000), _KEY, "left_semi")
    mine = mine.select(*_KEY, F.explode("words").alias("w")).select(*_KEY, "w.word", "w.n").where(F.col("word") >= "a")  # not those that begin with a digit
    often_known = F.broadcast(known.join(common, "word"))
    rest = mine.join(common, "word", "left_anti").join(C.broadcast_if_small(known, 1_000_000), "word", "left")
    both = mine.join(common, "word", "left_semi").join(often_known, "word", "left").unionByName(rest)
    share = both.groupBy(*_KEY).agg((F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / F.sum("n")).alias("share"))
    return Stage(flagged.join(share.where(F.col("share") >= KNOWN_SHARE).select(*_KEY), _KEY)).df


def stuffed_pages(documents: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id of each page that is mostly stuffed keywords, links or tags.

    Null and blank texts are never found; copies count on their own; whole texts are read; an id is given once for each
    of its found rows. Languages are those of the column ``lang`` by their first two letters (all one where there is
    none); pages with a null or wrong label go by the reference that fits them best. Pages of a language with fewer than
    REFERENCE_TEXTS distinct texts, or of words that the corpus doesn't know, can't be told from prose and are not found.

    The flagged texts are checked with the references of the fit; the references are then learnt anew against the
    pages found, which are mostly keywords, and decide in a second check.
    """
    none = documents.select(id_column).limit(0)
    fit = flag(documents, text, lang)
    if fit is None:
        return none
    rows = documents.where(F.col(text).rlike(r"[\p{L}\p{N}]")).select(id_column, F.col(text).alias("text"))
    texts = C.skew_lookup(rows.select("text", *_text_keys(F.col("text"))).withColumnRenamed("key2", "own"), fit.flagged, "key", "copies").where("own = key2")
    texts = texts.groupBy(*_KEY).agg(F.first("language").alias("language"), F.first("text").alias("text")).select(*_KEY, "language", _page(F.col("text")).alias("page"))
    texts = Stage(texts.sortWithinPartitions("language")).df
    first = Stage(texts.where(_share(fit.heads) > STUFFED_SHARE).select(*_KEY)).df
    # Prose is what is neither far from it by the fit nor found.
    counted = fit.totals.join(_sums(fit.known, fit.listed, "odd", fit.others.union(first).distinct()), ["label", "word"], "left")
    counted = counted.join(_sums(fit.known, fit.listed, "other", first), ["label", "word"], "left").fillna(0, ["odd", "other"])
    heads = _heads(counted.withColumn("prose", F.col("total") - F.col("odd")), FOUND_RATIO)
    heads = {label: heads.get(label) or words for label, words in fit.heads.items()}
    found = texts.where(_share(heads) > STUFFED_SHARE).select(*_KEY)
    found = Stage(fit.flagged.join(found, _KEY).select(*_KEY, "copies")).df
    keyed = rows.select(id_column, *_text_keys(F.col("text"))).withColumnRenamed("key2", "own")
    return C.skew_lookup(keyed, found, "key", "copies").where("own = key2").select(id_column)
