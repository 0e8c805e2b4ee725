"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from placeframe.llm import queries, spelling

R = random.Random(11)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_groups(n: dict[str, int], factor: int = 2) -> dict[str, tuple]:
    out = {}
    form = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) <= 1 and edits(w, v) == 1]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = len(near)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w], n[form[w]] if form[w] else None)
    return out


def damaged_words(rows, one_in=97, chars=5, least=3) -> dict[str, int]:
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: k for w, k in c.items() if len(w) >= chars and k >= least}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("rare", "most"), [(1, 1 << 17), (4, 1 << 17), (2, 40), (10**6, 1 << 17)])
def test_groups_meet_brute_force(spark, rare, most):
    """Words of few letters, so that grams are frequent, and of endings alike; with short, long and accented ones."""
    words = {"".join(R.choice("abc") for _ in range(R.randrange(3, 9))) for _ in range(150)}
    words |= {"".join(R.choice("xyzàé") for _ in range(4)) + R.choice(["tion", "ment", "s"]) for _ in range(80)}
    words |= {w[:k] + R.choice("abcq") + w[k + R.randrange(2) :] for w in list(words) for k in [R.randrange(len(w))]}
    words |= {"a" * k for k in range(5, 12)} | {"ab" * 300, "ab" * 299 + "a", "ab" * 150 + "q" + "ab" * 150}
    n = {w: R.choice([3, 3, 4, 7, 15, 40, 200]) for w in words if len(w) >= 3}
    found = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.group_variants(found, rare=rare, most=most)) == plain_groups(n)


def test_bound_on_changed_grams_holds():
    """After any replaced or inserted code point at least all but most_changed grams stand where they stood, or one further on."""
    for _ in range(400):
        longer = set()
        for _ in range(R.randrange(25)):
            g = "".join(R.choice("abc") for _ in range(R.randrange(3, spelling.LONG + 1)))
            longer |= {g[:k] for k in range(3, len(g) + 1)}
        grams = spelling.Grams(frozenset(longer), {})
        s = spelling.padded("".join(R.choice("abc") for _ in range(R.randrange(1, 12))))
        own = spelling.taken_apart(s, grams.longer)
        bound = spelling.most_changed(s, own, grams.openings, grams.endings)
        for i in range(1, len(s)):
            for c in "abcd":
                t = s[:i] + c + s[i:]
                theirs = {(p, t[p:e]) for p, e in spelling.taken_apart(t, grams.longer)}
                assert sum((p, s[p:e]) in theirs or (p + 1, s[p:e]) in theirs for p, e in own) >= len(own) - bound
                if i < len(s) - 1:
                    t = s[:i] + c + s[i + 1 :]
                    theirs = {(p, t[p:e]) for p, e in spelling.taken_apart(t, grams.longer)}
                    assert sum((p, s[p:e]) in theirs for p, e in own) >= len(own) - bound


def test_words_and_planted_errors(spark):
    vocabulary = ["Alpha", "beta", "Gammas", "Étude", "étude", "naïve", "a×b÷cde", "don't", "x" * 40, "Ābeyond", "Zz"]
    rows = [(i, " ".join(R.choice(vocabulary) for _ in range(60))) for i in range(60)] + [(70, None), (71, ""), (None, "Alpha Alpha " * 3), (5, "Gammas\tGammas\nGammas"), (5, "Gammas\tGammas\nGammas")]
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, word string").repartition(4)
    plain = [("" if i is None else i, t) for i, t in rows]
    for one_in in (97, 3):
        assert {r.word: r.n for r in spelling.words(docs, damaged=one_in).collect()} == damaged_words(plain, one_in)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == damaged_words(plain, 1 << 40)


def test_a_very_long_text_and_an_empty_table(spark):
    text = "lengthy " * 300_000
    assert [(r.word, r.n) for r in spelling.words(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [("lengthy", 300_000)]
    assert spelling.group_variants(spelling.words(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_query_meets_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = damaged_words(rows)
    made = rows_of(queries.QUERIES["op11_spelling_variants"](spark, sf))
    assert {w: v[2] for w, v in made.items()} == n
    # brute force by deletion neighbourhoods: words one edit apart share a word with one code point less
    by: dict[str, set] = {}
    for w in n:
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by.setdefault(v, set()).add(w)
    near = {w: set() for w in n}
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and edits(a, b) == 1:
                    near[a].add(b)
                    near[b].add(a)
    assert {w: v[3] for w, v in made.items()} == {w: len(x) for w, x in near.items()}
    for w, (form, root, _, _, form_n) in made.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        assert form == (best if best and n[best] >= 2 * n[w] else None)
        assert form_n == (n[form] if form else None)
        assert root == (made[form][1] if form else w)
