"""Encoding of texts by a byte-level BPE vocabulary with Spark higher-order functions only.

Bytes are held as the Latin-1 characters of the same number, so a token is a short string. A rank map, token to id, is
a literal of RANK_BUCKETS small maps chosen by crc32, as the look-up in a Spark map is a linear search. Distinct words
of the whole corpus are counted, and the CODES most frequent are encoded once by folding ranked merges and sent to the
texts as a literal, too; any rarer word is encoded in place by the same fold. No text is ever shuffled.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.sources.tables import Stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RANK_BUCKETS = 1 << 14
#: Most words whose codes are sent to executors in a literal; it bounds what the driver collects.
CODES = 1 << 16
#: Longest word (in characters) among these; longer ones are rare and are encoded in place.
CODE_LENGTH = 64
#: Not a Latin-1 character, so no token has it.
MARK = "Ā"
#: Words of over LONG bytes are folded CHUNK bytes at a time, each chunk with the last REDO tokens before it.
LONG, CHUNK, REDO = 96, 24, 4
#: The pre-tokenizer's pattern with Unicode white space; alternatives that begin with other characters may change places.
WORDS = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id, which is also the rank of the merge that makes the token."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _buckets(pairs, buckets: int, value: str) -> Column:
    """A literal of ``buckets`` maps; a key is in the map of its crc32."""
    maps: list[dict] = [{} for _ in range(buckets)]
    for key, x in pairs:
        maps[zlib.crc32(key.encode()) % buckets][key] = x
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), f"array<map<string,{value}>>")


def _find(maps: Column, key: Column, buckets: int) -> Column:
    at = F.crc32(key.cast("binary")).bitwiseAND(buckets - 1).cast("int")
    return F.try_element_at(F.get(maps, at), key)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a fold over nothing that ends in body. (transform() would copy the result.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _borders(ranks: dict[bytes, int]) -> str:
    """A zero-width pattern of places before a UTF-8 lead byte that no token reaches across, whatever surrounds them."""
    reach = defaultdict(set)
    for token in ranks:
        for a, b in zip(token, token[1:]):
            reach[b].add(a)
    alike = defaultdict(list)
    for b in range(0xC2, 0xF5):
        alike[frozenset(reach[b])].append(b)
    code = lambda xs: "".join(f"\\x{{{x:x}}}" for x in sorted(xs))
    return "(?s)(?<=.)(?:" + "|".join(f"(?=[{code(bs)}])" + (f"(?<![{code(before)}])" if before else "") for before, bs in alike.items()) + ")"


class Encoder:
    """Expressions over one vocabulary; ids are those of the file.

    ``ranks`` is the literal bound to a lambda variable: each mention of the literal itself would be a copy of its own
    in every task.
    """

    def __init__(self, path: str = VOCABULARY):
        self.ranks = vocabulary(path)
        self.literal = _buckets(((t.decode("latin-1"), r) for t, r in self.ranks.items()), RANK_BUCKETS, "int")
        self.borders = _borders(self.ranks)

    def _merge(self, parts: Column, ranks: Column) -> Column:
        """parts with every pair of the lowest rank merged, left to right; null if no pair has a rank."""

        def merged(found: Column) -> Column:
            def at(i: Column) -> Column:
                x, y = F.get(parts, i - 1), F.get(parts, i)
                joined = F.concat(F.lit(MARK), F.array_join(parts, MARK * 2), F.lit(MARK))
                joined = F.replace(joined, F.concat(F.lit(MARK), x, F.lit(MARK * 2), y, F.lit(MARK)), F.concat(F.lit(MARK), x, y, F.lit(MARK)))
                return F.split(F.trim(joined, F.lit(MARK)), MARK * 2)

            return F.when(F.array_min(found).isNotNull(), _let(F.array_position(found, F.array_min(found)).cast("int"), at))

        return _let(F.transform(parts, lambda x, i: _find(ranks, F.concat(x, F.get(parts, i + 1)), RANK_BUCKETS)), merged)

    def _fold(self, piece: Column, ranks: Column) -> Column:
        """Tokens of a byte string: merges are folded over its bytes until no pair has a rank."""
        start = F.struct(F.split(piece, "").alias("parts"), F.lit(False).alias("done"))

        def step(state: Column, _: Column) -> Column:
            go = _let(self._merge(state["parts"], ranks), lambda new: F.struct(F.coalesce(new, state["parts"]).alias("parts"), new.isNull().alias("done")))
            return F.when(state["done"], state).otherwise(go)

        return F.aggregate(F.sequence(F.lit(1), F.length(piece) + 1), start, step)["parts"]

    def _fold_long(self, piece: Column, ranks: Column) -> Column:
        """The same tokens with work in proportion to the length.

        Tokens are those of the whole if every two neighbours are the tokens of the two joined. Each chunk is folded with
        the last tokens before it; where the first new token and its left neighbour fail this test, all so far is folded anew.
        """

        def step(state: Column, chunk: Column) -> Column:
            kept = F.slice(state, F.lit(1), F.greatest(F.size(state) - REDO, F.lit(0)))

            def join(keep: Column) -> Column:
                redone = F.array_join(F.slice(state, F.size(keep) + 1, F.lit(REDO)), "")

                def check(new: Column) -> Column:
                    left, right = F.element_at(keep, -1), F.get(new, F.lit(0))
                    apart = F.size(keep) == 0
                    same = F.when(apart, True).otherwise(self._fold(F.concat(left, right), ranks) == F.array(left, right))
                    return F.when(same, F.concat(keep, new)).otherwise(self._fold(F.concat(F.array_join(state, ""), chunk), ranks))

                return _let(self._fold(F.concat(redone, chunk), ranks), check)

            return _let(kept, join)

        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length(piece) - 1) / CHUNK).cast("int")), lambda i: F.substring(piece, i * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, F.array().cast("array<string>"), step)

    def word_ids(self, word: Column, ranks: Column) -> Column:
        """Ids of one non-empty word of the pattern."""
        rank = lambda s: _find(ranks, s, RANK_BUCKETS)
        folded = lambda s: F.when(F.length(s) > LONG, self._fold_long(s, ranks)).otherwise(self._fold(s, ranks))
        piece_ids = lambda s: _let(rank(s), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(F.transform(folded(s), rank)))
        as_bytes = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        # split() would compile the borders anew for each word; regexp_replace() compiles them once.
        marked = F.when(_ascii(word), word).otherwise(F.regexp_replace(as_bytes, self.borders, MARK))
        return F.flatten(F.transform(F.split(marked, MARK), piece_ids))

    def encode_word(self, word: Column) -> Column:
        return _let(self.literal, lambda ranks: self.word_ids(word, ranks))

    def decode(self, ids: Column) -> Column:
        """The binary text of an array of ids: its pieces one after another. Ids outside the vocabulary give null."""
        pieces = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.decode("latin-1")
        literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        found = F.transform(ids, lambda i: F.get(literal, i))
        text = F.encode(F.array_join(found, ""), "ISO-8859-1")
        return F.when(~F.exists(found, lambda x: x.isNull()), text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def dictionary(documents: DataFrame, encoder: Encoder, text: str = "text", most: int = CODES) -> DataFrame:
    """word, ids of the most frequent words of all texts, at most ``most``, all that occur more than a number of times.

    Words are counted over all texts. That number is read from the counts of words by sixteenths of an octave of their
    frequency, a table of at most a thousand rows, so nothing is sorted.
    """
    counted = documents.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = counted.where(F.length("word") <= CODE_LENGTH).withColumn("octave", F.floor(F.log2("n") * 16).cast("int"))
    counted = Stage(counted.repartition(documents.sparkSession.sparkContext.defaultParallelism, "word")).df
    total, least = 0, None
    for r in counted.groupBy("octave").agg(F.count("*").alias("n")).orderBy(F.desc("octave")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["octave"]
    frequent = counted.where(F.col("octave") >= least if least is not None else F.lit(False)).select("word")
    return frequent.select("word", encoder.encode_word(F.col("word")).alias("ids"))


def encode(documents: DataFrame, text: str = "text", ids: str = "ids", path: str = VOCABULARY, most_codes: int = CODES) -> DataFrame:
    """``documents`` with the token ids of ``text`` in a column ``ids`` (which replaces one of that name).

    Empty and null texts give an empty array; strings that look like special tokens are ordinary text; texts of any
    length are encoded whole. Repeated rows keep their number.
    """
    encoder = Encoder(path)
    rows = dictionary(documents.where(F.length(text) > 0), encoder, text, most_codes).toPandas()
    buckets = 1 << max(4, len(rows).bit_length() - 2)  # each map is an object that every task unpacks
    codes = _buckets(zip(rows["word"], map(list, map(map, repeat(int), rows["ids"])), strict=True), buckets, "array<int>")
    every = words(F.col(text))

    def of_words(ranks: Column, c: Column) -> Column:
        return F.flatten(F.transform(every, lambda w: F.coalesce(_find(c, w, buckets), encoder.word_ids(w, ranks))))

    nothing = F.array().cast("array<int>")
    found = _let(encoder.literal, lambda ranks: _let(codes, lambda c: of_words(ranks, c)))
    return documents.withColumn(ids, F.when(F.length(text) > 0, found).otherwise(nothing))
