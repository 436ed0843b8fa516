"""Byte-level BPE as Spark expressions.

A text is cut into words by the vocabulary's published pattern. The corpus's distinct words are
counted, the most frequent of them are merged once by a fold over their byte tokens, and the texts
are rewritten word by word: a frequent word by its ids, any other by the same fold where it stands.
No text is shuffled. Merge ranks and frequent words are literals of the plan; both are bounded, the
one by the vocabulary and the other by :data:`HEAD_WORDS`, whatever the corpus holds.

Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import json
import os
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.runtime import cut

#: The characters of Unicode's White_Space property, as a class body.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the published word pattern of the byte_bpe_50k vocabulary, with that class for white space.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{WHITE}\p{{L}}\p{{N}}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Words of more bytes than this are folded rank by rank instead of pair by pair.
PAIR_BYTES = 96
#: At most so many of the corpus's most frequent words travel as a literal with their ids.
HEAD_WORDS = 20_000
#: Ids as characters: one code point each, from here on (ids of the vocabulary end below the surrogates).
FIRST_CHAR = 0x100


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file; ``folder`` or TOKENIZER_DIR names another folder."""
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


load_ranks = lru_cache(maxsize=4)(read_ranks)


def merge_word(ranks: dict[bytes, int], parts: list[bytes], limit: int) -> list[bytes]:
    """Merge the lowest-ranked neighbours, leftmost first, while their rank is below ``limit``."""
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass(frozen=True)
class MergeTable:
    """Open-addressed table of (left id, right id) -> merged id as one literal array: the pair in the high bits, the merged id in the low 16, -1 where free."""

    slots: str
    mask: int
    mix: tuple[int, int]
    probes: int
    byte_ids: tuple[int, ...]
    size: int


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    ranks = read_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            two = merge_word(ranks, [bytes([b]) for b in token], rank)
            if len(two) == 2:
                pairs[(ranks[two[0]], ranks[two[1]])] = rank
    size = 1 << (len(pairs) * 2).bit_length()
    mix = (40503, 9973)
    slots, far = [-1] * size, 0
    for (a, b), rank in sorted(pairs.items(), key=lambda x: x[1]):
        h, n = (a * mix[0] + b * mix[1]) & (size - 1), 1
        while slots[h] >= 0:
            h, n = (h + 1) & (size - 1), n + 1
        slots[h], far = (a << 32) | (b << 16) | rank, max(far, n)
    return MergeTable(json.dumps(slots, separators=(",", ":")), size - 1, mix, far, tuple(ranks[bytes([b])] for b in range(256)), max(ranks.values()) + 1)


def words_of(text: Column | str) -> Column:
    """The words of a text; of a null text none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def _literal(js: str, kind: str) -> Column:
    return F.from_json(F.lit(js), kind)


def _rank_of(table: MergeTable, slots: Column, left: Column, right: Column) -> Column:
    """Id of the merge of two ids, null where there is none; ``slots`` holds the literal array."""
    key = F.shiftleft(left.cast("long"), 16).bitwiseOR(right.cast("long"))
    slot = left.cast("long") * table.mix[0] + right * table.mix[1]
    out = None
    for n in range(table.probes):
        here = F.get(slots["k"], (slot + n).bitwiseAND(F.lit(table.mask)).cast("int"))
        hit, rank = F.shiftright(here, 16) == key, here.bitwiseAND(F.lit(65535)).cast("int")
        out = (F.when(hit, rank) if out is None else out.when(hit, rank)).when(here < 0, F.lit(None).cast("int"))
    return out


def fold_ids(word: Column, table: MergeTable) -> Column:
    """Ids of one word: a fold that merges the lowest-ranked pair until none is left.

    The accumulator holds the tokens and the rank of every neighbouring pair; a merge looks up
    only the two ranks that it changes.
    """
    # bound once as a lambda's argument, so that the plan holds a single copy
    literal = F.array(
        F.struct(
            _literal(table.slots, "array<bigint>").alias("k"), _literal(json.dumps(table.byte_ids), "array<int>").alias("b"),
            F.split(F.lit("".join(chr(FIRST_CHAR + i) for i in range(table.size))), "").alias("c"),
        )
    )
    return F.get(F.transform(literal, lambda lit: F.when(F.octet_length(word) <= PAIR_BYTES, _fold(word, table, lit)).otherwise(_fold_by_rank(word, table, lit))), F.lit(0))


def _fold(word: Column, table: MergeTable, lit: Column) -> Column:
    raw = F.decode(word.cast("binary"), "ISO-8859-1")
    tokens = F.transform(F.split(raw, ""), lambda c: F.get(lit["b"], F.ascii(c)))

    def ranks(t: Column) -> Column:
        return F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: _rank_of(table, lit, F.get(t, i), F.get(t, i + 1)))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        t, r = acc["t"], acc["r"]
        new = F.get(r, i - 1)
        n = F.size(t)
        before = F.when(i > 1, F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.array(_rank_of(table, lit, F.get(t, i - 2), new)))).otherwise(F.array().cast("array<int>"))
        after = F.when(i + 1 < n, F.concat(F.array(_rank_of(table, lit, new, F.get(t, i + 1))), F.slice(r, i + 2, F.greatest(n - i - 2, F.lit(0))))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.concat(F.slice(t, F.lit(1), i - 1), F.array(new), F.slice(t, i + 2, F.greatest(n - i - 1, F.lit(0)))).alias("t"), F.concat(before, after).alias("r"))

    def round_(acc: Column, _: Column) -> Column:
        low = F.array_min(acc["r"])
        # the inner fold runs once, with the place of the lowest rank, or not at all
        places = F.when(low.isNotNull(), F.array(F.array_position(acc["r"], low).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, acc, step)

    start = F.transform(F.array(tokens), lambda t: F.struct(t.alias("t"), ranks(t).alias("r")))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1))), F.get(start, F.lit(0)), round_)
    return done["t"]


def _fold_by_rank(word: Column, table: MergeTable, lit: Column) -> Column:
    """The same fold for long words: the tokens are a string of one character each, and a step merges
    every place of the lowest rank at once, left to right, as pairs of a later rank can't come before it.

    The work is the word's length times the number of different merges in it, not the length squared.
    """
    none = F.array().cast("array<int>")

    def ranked(text: Column) -> Column:
        chars = F.split(text, "")
        at = lambda c: F.ascii(c) - FIRST_CHAR
        two = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.struct(_rank_of(table, lit, at(a), at(b)).alias("r"), F.concat(a, b).alias("ab")))
        return F.array_min(F.filter(F.when(F.size(chars) > 1, two), lambda x: x["r"].isNotNull()))

    def state(text: Column) -> Column:
        return F.get(F.transform(F.array(text), lambda t: F.struct(t.alias("t"), ranked(t).alias("low"))), F.lit(0))

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc["low"].isNull(), acc).otherwise(state(F.replace(acc["t"], acc["low"]["ab"], F.get(lit["c"], acc["low"]["r"]))))

    raw = F.decode(word.cast("binary"), "ISO-8859-1")
    start = F.array_join(F.transform(F.split(raw, ""), lambda c: F.get(lit["c"], F.get(lit["b"], F.ascii(c)))), "")
    done = F.aggregate(F.sequence(F.lit(1), F.octet_length(word) - 1), state(start), step)
    return F.when(F.octet_length(word) > 1, F.transform(F.split(done["t"], ""), lambda c: F.ascii(c) - FIRST_CHAR)).otherwise(none)


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) of every distinct word of a text column with the number of texts that hold it."""
    return texts.select(F.explode(F.array_distinct(words_of(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(counts: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """The rows of ``counts`` down to the lowest class of frequency that keeps them at ``most`` or fewer.

    Classes are eighths of a doubling, so the histogram that the driver sees has a few hundred rows.
    Words over PAIR_BYTES are never among them, which bounds the bytes as well.
    """
    short = counts.where(F.octet_length("word") <= PAIR_BYTES).withColumn("class", F.floor(8 * F.log2("n")).cast("int"))
    kept, lowest = 0, 1 << 20
    for cls, n in sorted(((r["class"], r["count"]) for r in short.groupBy("class").count().collect()), reverse=True):
        kept += n
        if kept > most:
            break
        lowest = cls
    return short.where(F.col("class") >= lowest).drop("class")


def _lookup(words: DataFrame, most: int = HEAD_WORDS):
    """word -> ids (null for a word that isn't there) as an expression over a literal of hashed buckets.

    The buckets are written as JSON by the executors, under the number that the expression will
    compute, so the driver only puts them into a row.
    """
    size = 1 << max(1, most).bit_length()
    slot = F.hash("word").bitwiseAND(F.lit(size - 1))
    entry = F.to_json(F.create_map("word", "ids"))
    filled = words.select(slot.alias("slot"), F.substr(entry, F.lit(2), F.length(entry) - 2).alias("entry")).groupBy("slot").agg(F.concat_ws(",", F.collect_list("entry")).alias("entry"))
    buckets = [""] * size
    for at, text in filled.collect():
        buckets[at] = text
    literal = _literal("[{" + "},{".join(buckets) + "}]", "array<map<string,array<int>>>")
    return lambda w: F.try_element_at(F.get(literal, F.hash(w).bitwiseAND(F.lit(size - 1))), w)


def encode(docs: DataFrame, key: str, text: str, path: str | None = None, count_only: bool = False, head_words: int = HEAD_WORDS) -> DataFrame:
    """(key, ids), or (key, n_tokens) with ``count_only``; one row for each row of ``docs``, repeated keys included.

    ``head_words`` bounds the literal of frequent words and changes no id: a word outside it is
    folded in its text. Plans that hold literals of a vocabulary have no place in a description, so
    ``spark.sql.maxPlanStringLength`` is set to 20,000 in the session.
    """
    table = merge_table(path or vocabulary_path())
    _short_descriptions(docs)
    counts = cut(word_counts(docs, text))
    find = _lookup(cut(frequent_words(counts, head_words).select("word", fold_ids(F.col("word"), table).alias("ids"))), head_words)
    ids = lambda w: F.coalesce(find(w), fold_ids(w, table))
    if count_only:
        return docs.select(key, F.aggregate(words_of(text), F.lit(0), lambda n, w: n + F.size(ids(w))).alias("n_tokens"))
    return docs.select(key, F.flatten(F.transform(words_of(text), ids)).alias("ids"))


def _short_descriptions(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", "20000")


def decode(encoded: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the binary pieces of the ids, put together and read as UTF-8."""
    ranks = load_ranks(path or vocabulary_path())
    _short_descriptions(encoded)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = _literal(json.dumps(pieces), "array<string>")
    return encoded.select(key, F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "")), "UTF-8").alias("text"))
