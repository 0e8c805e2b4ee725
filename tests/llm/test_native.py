"""Quality rules, line dedup, preference formatting and mixing against plain Python on small, odd inputs."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placeframe.llm import chat, jaccard, linededup, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 700}" for i in range(3000))


def docs(spark, texts, source="s"):
    rows = [(i, t, "en", source if i % 3 else None, len(t or ""), True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, "a b c a b c", "a a a a", "x\ny\nx\n \n\n", "é#|\x0b z <b>", LONG, "a b c d a b", "one\ttwo\r\nthree", "a b c a b c"]


def test_measures_meet_plain_python(spark):
    made = quality.text_measures(docs(spark, TEXTS)).orderBy("doc_id").collect()
    for r, t in zip(made, TEXTS, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t), t


def test_common_lines_deplete(spark):
    own = [f"{' '.join(f'own{i}x{k}' for k in range(60))}\nShared menu line" for i in range(8)]
    empty = [f" shared MENU line\n{' '.join(f'pad{k}' for k in range(60))}\nlast{i}" for i in range(8)]
    made = {r.doc_id: r for r in quality.judge(docs(spark, own + empty)).collect()}
    assert all(made[i].kept and made[i].n_common_lines == 1 and made[i].n_common == 3 for i in range(8))
    # of the documents without a source there are too few to share the long line
    assert {i for i in range(8, 16) if not made[i].kept} == {i for i in range(8, 16) if i % 3}
    kept = quality.keep_good(docs(spark, own + empty))
    assert kept.columns == DOCS.replace(",", "").split()[::2] and kept.count() == 8 + 3
    clean = {r.doc_id: r.text for r in quality.without_common_lines(docs(spark, own + empty + [None])).collect()}
    assert clean[1] == own[1].split("\n")[0] and clean[8] == "last0" and clean[16] is None
    assert quality.judge(docs(spark, own).limit(0)).count() == 0


def test_repeated_ids_are_one_document_of_a_host(spark):
    body = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(1, f"{body} {i}\nmenu", "s", 5) for i in range(6)] + [(None, f"{body}\nmenu", "s", 5)] * 6, "doc_id long, text string, source string, host int")
    made = quality.judge(d).collect()
    assert len(made) == 12 and all(r.n_common_lines == 0 and r.host == 5 for r in made)


def test_lines_meet_plain_python(spark):
    texts = [f"Menu \nbody {i}\n\tMENU" for i in range(4)] + ["menu", "", None, "\n\n", "body 1"]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    made = linededup.drop_common_lines(docs(spark, texts), least_documents=3).orderBy("doc_id").collect()
    for r, t in zip(made, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 1 and count[key(x)] >= 3)]
        assert (r.kept_text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept)), t
    out = linededup.dedup_lines(docs(spark, texts), 3)
    assert out.columns == docs(spark, texts).columns and out.where("text IS NULL").count() == 1
    assert linededup.drop_common_lines(docs(spark, texts).limit(0)).count() == 0


def test_repeated_ids_are_one_document(spark):
    d = spark.createDataFrame([(1, "x")] * 10 + [(None, "x"), (2, "x"), (None, "y")], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.drop_common_lines(d, 3).collect()} == {0}
    assert sorted(r.n_dropped for r in linededup.drop_common_lines(d, 2).collect()) == [0] + [1] * 12


CLASHES = ["_lines", "_t1", "_t2", "_drop", "n_lines", "n_dropped", "kept_text", "host", "copy", "place", "block", "n_tokens", "row", "id", "t1", "key", "anchors", "component_id", "kept", "places", "n_words"]


def test_columns_of_any_name_pass(spark):
    given = docs(spark, [*TEXTS, " ".join(f"good{k}" for k in range(80))]).drop("kept").select("*", *(F.lit(7 + i).alias(c) for i, c in enumerate(CLASHES)))
    want = {c: 7 + i for i, c in enumerate(CLASHES)}
    for stage in (quality.keep_good, linededup.dedup_lines, mixing.mixed, jaccard.keep_one, quality.without_common_lines):
        out = stage(given)
        assert out.columns == given.columns
        rows = out.collect()
        assert rows and all(r[c] == v for r in rows for c, v in want.items()), stage


def turn(pair, side, n, role, text):
    return (pair, side, n, role, text, "other")


def test_preferences_share_the_prompt(spark):
    rows = [turn(1, s, 0, "user", "hi") for s in ("chosen", "rejected")]
    rows += [turn(1, "chosen", 1, "assistant", "good"), turn(1, "rejected", 1, "assistant", "bad"), turn(1, "chosen", 2, "user", "ok")]
    rows += [turn(2, "chosen", 0, "user", "alone"), turn(3, "chosen", 0, None, None), turn(3, "rejected", 0, None, None), turn(None, "chosen", 0, "user", "x")]
    d = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string, prompt string")
    made = {r.pair_id: r for r in chat.preferences(d).withColumns({"c": chat.rendered("chosen"), "r": chat.loss_text("rejected")}).collect()}
    assert set(made) == {1, 2, 3}
    assert made[1].n_prompt_turns == 1 and made[1].prompt == "<|user|>\nhi<|end|>\n"
    assert made[1].c == "<|assistant|>\ngood<|end|>\n<|user|>\nok<|end|>\n" and made[1].r == "bad<|end|>\n"
    assert [s.loss for s in made[1].chosen] == [False, True, False, False]
    assert made[2].n_prompt_turns == 0 and made[2].rejected == []
    assert made[3].n_prompt_turns == 1 and made[3].chosen == []
    assert chat.preferences(d.limit(0)).count() == 0


def test_mixture_keeps_all_and_repeats_the_rare(spark):
    rows = [(i, "w " * 9, "big" if i < 80 else "small") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix(d, repetition=2.0, block_tokens=50).toPandas()
    assert set(made.doc_id) == set(range(100))
    by = made.groupby("source").doc_id.count()
    assert by["big"] == 80 and by["small"] == 40
    first = made[made["place"] < 500_000_000].groupby("source").doc_id.count()
    assert abs(first["big"] - 40) <= 1 and abs(first["small"] - 20) <= 1
    sources = mixing.source_tokens(d.withColumns({"host": F.col("source"), "n_tokens": F.lit(10)}))
    assert mixing.exponent(sources, repetition=2.0) == pytest.approx(0.5, abs=1e-6)
    assert mixing.exponent(sources, entropy=1.0) == pytest.approx(0.0, abs=1e-3)


def test_mixture_meets_plain_python(spark):
    rows = [(i, "w " * (1 + i % 13), "abcd"[(i * i) % 7 % 4]) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix(d, repetition=1.5, block_tokens=40).toPandas()
    total = Counter()
    for i, text, source in rows:
        total[source] += len(text.split()) + 1
    share = {s: n / sum(total.values()) for s, n in total.items()}
    # the smallest-difference exponent by a fine scan, and the budgets it gives
    a = max(x / 20000 for x in range(20001) if max(share[s] ** (x / 20000 - 1) for s in share) / min(share[s] ** (x / 20000 - 1) for s in share) > 1.5)
    scale = max(n ** (1 - a) for n in total.values())
    for s, own in made.groupby("source"):
        limit = total[s] ** a * scale
        assert limit - 15 <= own.n_tokens.sum() <= limit + 15
        ordered = own.sort_values(["copy", "block", "place"])
        before = ordered.n_tokens.cumsum() - ordered.n_tokens
        assert (ordered.place.to_numpy() - before.to_numpy() / limit * 1e9).max() < 2e5 and ordered.place.is_monotonic_increasing
        assert (own.groupby("doc_id").copy.nunique() == own.groupby("doc_id").size()).all()


def test_mixture_of_odd_tables(spark):
    d = spark.createDataFrame([(1, None, None, 7), (1, None, None, 7), (2, "", "a", 7)], "doc_id long, text string, source string, copy int")
    assert mixing.mixed(d).columns == d.columns and mixing.mixed(d).count() >= 3
    assert mixing.mixed(d.limit(0)).count() == 0
    assert mixing.mix(d, budget=0).count() == 0


#: Two lines whose 64-bit xxHash is the same for the seeds 42 and that of hash("second", ...): found on purpose.
COLLIDE = ["]>.c$#$\"~,[-]+2+s?krm6ds1y<0ro0`~~u6dth2^@k!9~s#$@\\;7_3:]b[t6hyp", "k<q$~=sz~,[-]+2+s?krm6ds1y<0ro0`.\"*?2!&y^@k!9~s#$@\\;7_3:]b[t6hyp"]


def test_lines_and_windows_whose_hashes_meet_are_told_apart(spark):
    x, y = COLLIDE
    assert spark.range(1).select(F.xxhash64(F.lit(x)) == F.xxhash64(F.lit(y))).first()[0]
    d = spark.createDataFrame([(i, x if i < 9 else y, "s") for i in range(10)], "doc_id long, text string, source string")
    assert all(r.n_dropped == 0 for r in linededup.drop_common_lines(d).collect())
    words = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(0, f"{x} p q {words} {y} p q", "s"), (1, f"{x} p q {words} {y} p q {words} {x} p q", "s")], "doc_id long, text string, source string")
    made = {r.doc_id: r.n_repeat_words for r in quality.text_measures(d).collect()}
    assert made == {i: measures(r.text)[4] for i, r in enumerate(d.orderBy("doc_id").collect())} and made[0] == 0


def test_documents_of_mostly_common_lines_are_depleted(spark):
    body = " ".join(f"w{k}" for k in range(60))
    texts = [f"{body} own{i}\nmenu\n" + (f"footer\n \nown{i}" if i % 2 else "footer\n ") for i in range(8)]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: r.kept for r in quality.judge(d).collect()} == {i: i % 2 == 1 for i in range(8)}
