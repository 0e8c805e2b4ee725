"""Spelling variant grouping: words one edit apart, by an index of variable-length grams, and what they are forms of.

A dictionary holds the grams that words are taken apart into: each place of a word gives the longest gram of the
dictionary that starts there. Frequent grams are in it with longer ones that start with them, so that no list gets long. For each
word the most grams that one edit can change is worked out; near words share all but so many of its grams, with their
places, so only its rarest lists, one more than can be changed, have to be merged. What is met there is verified.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placeframe.llm.scratch import release, table

#: Grams have at least and at most so many code points.
SHORT, LONG = 2, 4
#: A gram that no more words have than this isn't made longer; and how many longer ones the dictionary may hold. Where
#: there would be more, the first number is doubled until there aren't: that makes lists longer, and loses nothing.
RARE, MOST_GRAMS = 32, 1 << 17
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Words or grams that one task holds before it passes its counts on.
MOST_HELD = 500_000
#: Both ends of a word, as code points that no word has.
FIRST, LAST = "\x02", "\x03"

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # in UTF-8 with A-Z in lower case: a-z and U+00C0 to U+00FF


def _runs(data: bytes) -> Counter:
    if len(data) < 1 << 20:
        return Counter(_RUN.findall(data))
    return Counter(m.group() for m in _RUN.finditer(data))


def _counted(held: Counter, least: int) -> pa.RecordBatch:
    words = pa.array(list(held), pa.binary()).cast(pa.string())
    batch = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
    held.clear()
    return batch.filter(pc.greater_equal(pc.utf8_length(words), least))


def _words(batches: Iterable[pa.RecordBatch], least: int, damaged: int | None) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            runs = _runs(text.lower())
            if damaged:
                begun = zlib.crc32(f"{name}:".encode())
                for run in [run for run in runs if zlib.crc32(run, begun) % damaged == 0]:
                    n, whole = runs.pop(run), run.decode()
                    at = zlib.crc32(run, begun) % len(whole)
                    held[(whole[:at] + whole[at + 1 :]).encode()] += n
            held.update(runs)
        if len(held) > MOST_HELD:
            yield _counted(held, least)
    yield _counted(held, least)


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damaged: int | None = None) -> DataFrame:
    """word and n (long): runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, with their number in all texts.

    Only words of `least_chars` code points and `least_count` occurrences on. With `damaged`, errors are planted: where that number
    divides h, the crc32 of `<doc_id>:<run>`, all occurrences of the run in that document lose the code point h % length.
    Null texts have no words; a null doc_id is empty in h; repeated rows count each time. Tasks pass counts on.
    """
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(partial(_words, least=least_chars, damaged=damaged), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- the dictionary and the grams of a word ---


@dataclass(frozen=True)
class Grams:
    """A dictionary: which grams longer than SHORT it holds, and in how many words frequent grams stand."""

    longer: frozenset[str]
    words_with: dict[str, int]

    @property
    def openings(self) -> frozenset[str]:
        return frozenset(g[:k] for g in self.longer for k in range(SHORT, len(g)))

    @property
    def endings(self) -> frozenset[str]:
        return frozenset(g[-k:] for g in self.longer for k in range(SHORT, len(g)))


def padded(word: str) -> str:
    return f"{FIRST}{word}{LAST}"


def taken_apart(s: str, longer: frozenset[str]) -> list[tuple[int, int]]:
    """Where the grams of s start and end: the longest of the dictionary at each place, or one of SHORT code points,
    without those that lie inside another."""
    out, end = [], 0
    for p in range(len(s) - SHORT + 1):
        e = next((p + k for k in range(min(LONG, len(s) - p), SHORT, -1) if s[p : p + k] in longer), p + SHORT)
        if e > end:
            out.append((p, e))
            end = e
    return out


def most_changed(s: str, grams: list[tuple[int, int]], openings: frozenset[str], endings: frozenset[str]) -> int:
    """The most grams of s that one replaced or inserted code point can change (a deletion changes no more than a
    replacement).

    Those that hold the place change. One to its left changes only if a longer gram might start at it or before it and go on
    over the place: if what stands there up to the place opens a gram of the dictionary. To its right likewise with endings.
    """
    starts = [p for p, _ in grams]
    n, worst = len(s), 0
    for left, right in [(i, i + 1) for i in range(1, n - 1)] + [(i, i) for i in range(1, n)]:
        first = next((j for j in range(max(0, left - LONG + 1), left - SHORT + 1) if s[j:left] in openings), n)
        last = next((e for e in range(min(n, right + LONG - 1), right + SHORT - 1, -1) if s[right:e] in endings), -1)
        near = grams[bisect_left(starts, left - LONG) : bisect_right(starts, right + LONG)]
        worst = max(worst, sum(p >= first if e <= left else e <= last if p >= right else True for p, e in near))
    return worst


def _gram_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])
        held.clear()
        return batch

    for batch in batches:
        for word in batch.column(0).to_pylist():
            s = padded(word)
            held.update({s[p : p + k] for k in range(SHORT, LONG + 1) for p in range(len(s) - k + 1)})
            if len(held) > MOST_HELD:
                yield rows()
    yield rows()


def dictionary(found: DataFrame, rare: int = RARE, most: int = MOST_GRAMS) -> Grams:
    """The grams worth having for the words of `found`.

    A longer gram is in it if more than `rare` words have what it starts with, and it isn't among the rarest of those that
    start alike, which together no more than `rare` words have.
    """
    grams = table(found.select("word").mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    longer = grams.where(F.length("gram") > SHORT).select("gram", "n", F.expr("substring(gram, 1, length(gram) - 1)").alias("opening"))
    opening = grams.where(F.length("gram") < LONG).select(F.col("gram").alias("opening"), F.col("n").alias("opened"))
    # grams that start alike are at most as many as there are letters
    rarest = F.sum("n").over(Window.partitionBy("opening").orderBy("n", "gram").rowsBetween(Window.unboundedPreceding, 0))
    longer = table(longer.join(opening, "opening").select("gram", "n", F.least("opened", rarest).alias("level")), "longer")
    steps = [rare << k for k in range(40)]
    sizes = longer.agg(*(F.count_if(F.col("level") > x).alias(f"s{x}") for x in steps)).first()
    level = next(x for x in steps if sizes[f"s{x}"] <= most)
    kept = longer.where(F.col("level") > level).select("gram", "n").collect()
    short = grams.where((F.length("gram") == SHORT) & (F.col("n") > level)).select("gram", "n").collect()
    release(grams, longer)
    return Grams(frozenset(r.gram for r in kept), {r.gram: r.n for r in (*kept, *short)})


# --- the index and its lists ---

_ENTRIES = T.StructType([T.StructField("asks", T.BooleanType()), T.StructField("key", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("letters", T.LongType()), T.StructField("loose", T.IntegerType())])
_KINDS = (pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())


def _key(kind: int, length: int, p: int, gram: str) -> str:
    return f"{kind}{length}.{p}{gram}"


def _questions(kind: int, s: str, grams: list[tuple[int, int]], changed: int, words_with: dict[str, int]) -> Iterator[str]:
    """Lists that a near word of s, as long or longer by one, can't all be missing from: the rarest grams, one more than can be
    changed, at their places, or one further on in a longer word."""
    for p, e in sorted(grams, key=lambda x: (words_with.get(s[x[0] : x[1]], 0), x))[: changed + 1]:
        yield _key(kind, len(s), p, s[p:e])
        yield _key(kind, len(s) + 1, p, s[p:e])
        yield _key(kind, len(s) + 1, p + 1, s[p:e])


def _letters(word: str) -> int:
    """Which letters a word has, by their last six bits. One edit takes one away and brings one in at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_ENTRIES.names)


def _short_grams(s: str) -> list[tuple[int, int]]:
    return [(p, p + SHORT) for p in range(len(s) - SHORT + 1)]


def _short_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word a row for each of its grams of SHORT code points."""
    for batch in batches:
        out: list[tuple] = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s, letters = padded(word), _letters(word)
            out += [(False, _key(1, len(s), p, s[p:e]), word, n, letters, None) for p, e in _short_grams(s)]
        yield from _rows(out)


def _entries(batches: Iterable[pa.RecordBatch], grams: Grams) -> Iterator[pa.RecordBatch]:
    """For each word a row for each of its lists, and for each list it asks. A word all of whose grams one edit might
    change asks by grams of SHORT code points (kind 1), of which one edit changes two at most; loose is its length then."""
    openings, endings = grams.openings, grams.endings
    for batch in batches:
        out: list[tuple] = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s, letters = padded(word), _letters(word)
            own = taken_apart(s, grams.longer)
            changed = most_changed(s, own, openings, endings)
            out += [(False, _key(0, len(s), p, s[p:e]), word, n, letters, None) for p, e in own]
            if len(own) > changed:
                out += [(True, k, word, n, letters, None) for k in _questions(0, s, own, changed, grams.words_with)]
            else:
                out += [(True, k, word, n, letters, len(word)) for k in _questions(1, s, _short_grams(s), SHORT, grams.words_with)]
        yield from _rows(out)


def near_pairs(found: DataFrame, rare: int = RARE, most: int = MOST_GRAMS) -> DataFrame:
    """word, n, other, other_n: each pair of words exactly one edit apart, once.

    found: word (distinct, not null, of 3 code points at least) and n. A table written to the shared folder.
    """
    grams = dictionary(found, rare, most)
    entries = table(found.mapInArrow(partial(_entries, grams=grams), _ENTRIES), "entries")
    # a word without a gram that is sure to stay has few grams, so few code points: fewer than 2 LONG * LONG
    loose = sorted(r.loose for r in entries.where("loose IS NOT NULL").select("loose").distinct().collect())
    short = found.where(F.length("word").isin([*loose, *(k + 1 for k in loose)])).select("word", "n").mapInArrow(_short_lists, _ENTRIES)
    lists = entries.where("NOT asks").unionByName(short).select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("letters").alias("other_letters"), "key")
    asked = entries.where("asks").select("word", "n", "letters", "key")
    # met and verified in one step: what is met goes nowhere
    once = (F.length("word") < F.length("other")) | (F.col("word") < F.col("other"))
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2
    met = asked.join(lists, (asked.key == lists.key) & alike & once & (F.levenshtein("word", "other", 1) == 1))
    out = table(met.select("word", "n", "other", "other_n").distinct(), "pairs")
    release(entries)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word that has a form, forms followed to the last. Each step at least doubles n, so there
    are at most 62; each round doubles how far they are followed."""
    now = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        then = table(now.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(now)
        now = then.select("word", "root")
        now._scratch_path = then._scratch_path
        if not then.where("moved").limit(1).count():
            return now


def group_variants(found: DataFrame, factor: int = 2, rare: int = RARE, most: int = MOST_GRAMS) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) for each row of found (word, distinct, and n).

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    the largest n, of equal ones the smallest in code-point order, if that n is at least `factor` times its own (2 or more, so
    that forms can't go round); else null, and form_n too. root: forms followed to the last, the word itself if it has
    none. All near words are found, whatever the length or the frequency of their grams. An empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    found = table(found.select("word", "n"), "words")
    pairs = near_pairs(found, rare, most)
    each = F.array(F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    near = pairs.select(F.inline(each)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    enough = -F.col("best.minus") >= factor * F.col("n")
    made = found.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"),
    )
    made = table(made, "forms")
    release(pairs, found)
    return made.join(_roots(made.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
