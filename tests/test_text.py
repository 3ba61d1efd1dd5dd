"""Text functions on hand-derived cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waraq.functions import correction, distance, text
from waraq.functions.rules import CORRECTIONS, KEPT_AFTER_AAL, KEPT_AFTER_MAL, MARK_CLOSE, MARK_OPEN, SIMILAR_LETTERS


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "given_, want",
    [("مُحَكَّمَةٌ", "محكمه"), ("إأآا", "اااا"), ("ىي", "يي"), ("ؤئء", "ويء"), ("ـٱ", "ـٱ"), ("", ""), ("abc", "abc"), (None, None)],
)
def test_normal_form(spark, given_, want):
    assert one(spark, text.normalize(F.col("x")), x=given_) == want


@pytest.mark.parametrize("given_, want", [("ab كتاب، 12", ["كتاب،"]), ("كتابـ ٣", ["كتابـ", "٣"]), ("none", []), ("", [])])
def test_tokens(spark, given_, want):
    assert one(spark, text.tokens(F.col("x")), x=given_) == want


@pytest.mark.parametrize("given_, want", [(" a b \n", "a b"), ("\x1f\x1cx", "x"), ("   ", ""), ("a\n", "a")])
def test_strip(spark, given_, want):
    assert one(spark, text.strip(F.col("x")), x=given_) == want == given_.strip()


def test_words(spark):
    assert one(spark, text.words(F.col("x")), x=" a b \n c ") == ["a", "b", "c"]
    assert one(spark, text.words(F.col("x")), x="") == []


@pytest.mark.parametrize("n, native", [(50, False), (51, True)])
def test_page_kind_counts_solid_characters(spark, n, native):
    assert one(spark, text.is_native(F.col("x")), x=" \n".join("x" * n)) is native


@pytest.mark.parametrize(
    "a, b, want",
    [("م", "ن", 0.5), ("ن", "م", 1.0), ("ا", "ابجده", 999.0), ("", "ابج", 3.0), ("كتاب", "كتاب", 0.0), ("كتاب", "لتاب", 0.5), ("محكمه", "محكم", 1.0), ("بب", "تث", 1.0)],
)
def test_distance(spark, a, b, want):
    assert one(spark, distance.weighted_distance(F.col("a"), F.col("b")), a=a, b=b) == want
    assert distance.distances([a], [b])[0] == want


def brute_distance(a, b):
    if abs(len(a) - len(b)) > 3:
        return 999.0
    row = [float(j) for j in range(len(b) + 1)]
    for i, c in enumerate(a):
        new = [i + 1.0]
        for j, d in enumerate(b):
            cost = 0 if c == d else 0.5 if d in SIMILAR_LETTERS.get(c, "") else 1
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + cost))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ابتثجحسشمن", max_size=7), st.text("ابتثجحسشمن", max_size=7))
def test_batched_distance_is_the_distance(a, b):
    assert distance.distances([a], [b])[0] == brute_distance(a, b)


def test_prefilter_loses_no_pair(spark):
    import random

    rng = random.Random(4)
    letters = "".join(SIMILAR_LETTERS)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice(SIMILAR_LETTERS.get(c, c) + c) if rng.random() < 0.8 else rng.choice(letters) for c in a) + rng.choice(["", "", "م"])
        rows.append((a, b))
    frame = spark.createDataFrame(rows, "a string, b string")
    near = distance.may_be_within(distance.letter_classes(F.col("a")), distance.letter_classes(F.col("b")))
    got = frame.select(near.alias("near"), distance.weighted_distance(F.col("a"), F.col("b")).alias("native"), distance.pair_distance(F.col("a"), F.col("b")).alias("batched")).collect()
    assert [r.native for r in got] == [brute_distance(a, b) for a, b in rows] == [r.batched for r in got]
    assert all(r.near for r in got if r.native <= 2)
    assert not all(r.near for r in got)


def test_excerpt(spark):
    def cut(raw, nq):
        return one(spark, text.excerpt(F.col("raw"), text.normalize(F.col("raw")), F.col("nq")), raw=raw, nq=nq)

    assert cut("سطر\n  كتابة هنا  \nكتابة", "كتابه") == "كتابة هنا"
    assert cut("x" * 400 + " كتاب", "كتاب") == "x" * 300
    spanning = "ا" * 100 + "\n" + "ب" * 100
    assert cut(spanning, "ا\nب") == spanning[19:182].replace("\n", " ")
    assert cut("abc", "zzz") == ""


def test_highlight(spark):
    def mark(t, q):
        return one(spark, text.highlight(F.col("t"), F.col("q")), t=t, q=q)

    assert mark("كتاب و كتاب", "كتاب") == f"{MARK_OPEN}كتاب{MARK_CLOSE} و كتاب"
    assert mark("كتابة كتابه", "كتابة") == f"{MARK_OPEN}كتابة{MARK_CLOSE} {MARK_OPEN}كتابه{MARK_CLOSE}"
    assert mark("كتاب", "كتاب كتاب") == f"{MARK_OPEN * 2}كتاب{MARK_CLOSE * 2}"
    assert mark("no", "كتاب") == "no" and mark("كتاب", "") == "كتاب"


CASCADE = [
    (2, "كتـــاب", "كتاب"),
    (3, "قانونيهة، يهة", "قانونية، ية"),
    (3, "يهةس", "يهةس"),
    (4, "ا*+ب ++ ", "ا ب   "),
    (4, "x*ا", "x*ا"),
    (5, "االعمل باال االا", "الاعمل باال الاا"),
    (6, "استقبلا، لا ملا", "استقبال، لا ملا"),
    (7, "احملا", "المحا"),
    (8, "املادة امل", "المادة امل"),
    (9, "احلكم فاحلكم اول", "الحكم فاحلكم الو"),
    (9, "دالخ", "داخل"),
    (10, "واإلدارة لإلدارة", "والإدارة للإدارة"),
    (11, "اإلدارة", "الإدارة"),
    (12, "باألمر لألمر", "بالأمر للأمر"),
    (13, "الاأمر", "الأمر"),
    (14, "ألعمال ألزم ألزم،ب ألزموا", "الأعمال ألزم الأزم،ب الأزموا"),
    (14, "س\nألعمال", "س\nالأعمال"),
    (15, "القغضاء قغضقغض", "القضاء قضقغض"),
    (16, "ال يجوز\nال ب خال ب", "لا يجوز\nلا ب خال ب"),
    (17, "مالحظ مالي مالك", "ملاحظ مالي مالك"),
    (18, "إعالن اعالم اعالاعالن", "إعلان اعالم اعالاعالن"),
]


@pytest.mark.parametrize("step, given_, want", CASCADE)
def test_cascade_steps(spark, step, given_, want):
    assert one(spark, correction.STEPS[step](F.col("x")), x=given_) == want


def test_dictionary_in_order(spark):
    assert one(spark, correction.dictionary(F.col("x")), x="الاستقلال") == "الاستقلاللل"  # entries are part of their own right forms
    assert one(spark, correction.applied(F.col("x")), x="الاستقلال") == ["الاستقلا→الاستقلال", "استقلا→استقلال"]
    assert one(spark, correction.applied(F.col("x")), x="محكمـة") == ["محكمـة→محكمة"]
    assert one(spark, correction.dictionary(F.col("x"), ()), x="محكمـة") == "محكمـة"
    text_ = "رمق هاذا مالحظات"
    want = text_
    for wrong, right in CORRECTIONS:
        want = want.replace(wrong, right)
    assert one(spark, correction.dictionary(F.col("x")), x=text_) == want


def test_dictionary_fires_what_a_plain_fold_fires(spark):
    """Texts put together from pieces of entries, so that entries bring about, hide and overlap each other."""
    rng = random.Random(9)
    pieces = [x for pair in CORRECTIONS for x in pair]
    texts = []
    for _ in range(4000):
        parts = [rng.choice([x, x[: rng.randint(1, len(x))], x[-rng.randint(1, len(x)) :]]) for x in rng.choices(pieces, k=rng.randint(1, 5))]
        texts.append(rng.choice(["", " "]).join(parts))
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "plain", None]], "x string").repartition(8)
    for r in rows.select("x", correction.dictionary(F.col("x")).alias("t"), correction.applied(F.col("x")).alias("done")).collect():
        want, done = r.x, []
        for wrong, right in CORRECTIONS if r.x is not None else ():
            if wrong in want:
                want, done = want.replace(wrong, right), [*done, f"{wrong}→{right}"]
        assert (r.t, r.done or []) == (want, done), r.x


@pytest.mark.parametrize("step, pattern, kept", [(17, "(م)ال([ء-غف-ي])", KEPT_AFTER_MAL), (18, "([إا]ع)ال([ء-غف-ي])", KEPT_AFTER_AAL)])
def test_steps_with_exempt_letters_on_any_text(spark, step, pattern, kept):
    """Private-use characters are text like any other; hits that overlap are taken from left to right."""
    rng = random.Random(step)
    texts = ["".join(rng.choice(["مال", "عال", "اعال", "م", "ا", "ل", "ع", "إ", "ب", "ي", "ك", "\ue000", "\ue002", " "]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", correction.STEPS[step](F.col("x")).alias("t")).collect()
    for r in got:
        assert r.t == re.sub(pattern, lambda m: m[0] if m[2] in kept else f"{m[1]}لا{m[2]}", r.x), r.x


def test_guards_change_nothing(spark):
    rng = random.Random(2)
    pieces = [*correction.NEEDED[3], "احل", "امل", "ال ", "اال", "الاأ", "أل", "قغض", "يهة ", "*", "مال", "عال", "لا ", "واإل", " ", "\n", "ب", "كتاب", "ـ"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(2000)]
    plain = correction.dictionary(F.col("x"))
    for k in sorted(correction.STEPS):
        plain = correction.STEPS[k](plain)
    rows = spark.createDataFrame([(t,) for t in texts], "x string").repartition(8)
    assert rows.select("x", plain.alias("a"), correction.correct_text(F.col("x")).alias("b")).filter("not (a <=> b)").collect() == []
