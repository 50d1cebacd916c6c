"""Column functions against known values."""

import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions import intervals as iv
from gridloom.functions import schedule, text
from gridloom.functions.patterns import CellType, StringPattern, classify
from gridloom.plans.constraints import Algebra, Location, child_region, parent_region
from gridloom.plans.ranges import Span


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(("raw", "want"), [("М А Т Е М А Т И К А", "МАТЕМАТИКА"), ("И Н.   Я З Ы К", "ИН. ЯЗЫК"), ("wo   rd  12   w o r d 2", "wo rd 12 word2"), ("plain words", "plain words"), ("", ""), ("a", "a")])
def test_sparse_words(spark, raw, want):
    assert one(spark, text.fix_sparse_words(F.lit(raw)))[0] == want


def test_text(spark):
    r = one(spark, text.preprocessed(F.lit("  a  b\n\n c \t")), text.remove_spaces_around_hypen(F.lit("a - b -c")), text.joined_letters(F.array(*map(F.lit, ["a", "b", "cd", "e"]))), text.preprocessed(F.lit(None).cast("string")), text.mask(F.lit("Аб1")))
    assert list(r) == ["a b c", "a-b-c", ["ab", "cd", "e"], None, "Яя#"]


PATTERNS = [("abc+", "", "start", "abccX"), ("[oо]", "I", "start", "O"), (r"(?P<day>\d\d)\.(\d\d)", "", "both", "05.11"), (r"\d+\Z", "", "", "a12"), ("[a[]b", "", "start", "[b"), ("b", "", "end", "aab"), ("x y", "", "start", "x  y"), ("a{2}", "", "start", "aaa"), ("a{,2}b", "", "start", "aab"), ("é", "I", "start", "É")]


@pytest.mark.parametrize(("p", "flags", "anchors", "s"), PATTERNS)
def test_patterns_match_as_in_python(spark, p, flags, anchors, s):
    sp = StringPattern(p, 0.8, pattern_flags=flags, anchors=anchors)
    clean = re.sub(r"\s{2,}", " ", s.strip())
    bits = re.I if flags else 0
    m = re.compile(p, bits)
    want = {"start": m.match, "both": m.fullmatch, "": m.search, "end": re.compile(f"(?:{p})\\Z", bits).search}[anchors](clean)
    got = one(spark, sp.match(F.lit(s), "t", 0))[0]
    assert (got is None) == (want is None)
    if want:
        assert got.matched == want[0] and abs(got.precision - 0.8 * len(want[0]) / len(clean)) < 1e-9


def test_syntaxes(spark):
    spaced = StringPattern("a b   c", 0.5, pattern_syntax="re-spaces")
    assert spaced.regex == r"a\s*b\sc"
    assert StringPattern(r"\L+", 0.5, pattern_syntax="re+letters").regex == "[A-ZА-ЯЁa-zа-яё]+"
    plain = StringPattern("a.b", 1.0, pattern_syntax="plain")
    assert one(spark, plain.match(F.lit(" a.b "), "t", 0))[0] and one(spark, plain.match(F.lit("axb"), "t", 0))[0] is None
    named = StringPattern(r"(?P<a_b>\d)(?P<c>\w)", 1.0, captures=["c", "a_b"])
    assert one(spark, named.match(F.lit("1x"), "t", 0))[0].captures == {"c": "x", "a_b": "1"}
    with pytest.raises(ValueError):
        StringPattern("", 0.5)


def test_classifier_order(spark):
    types = [CellType("low", [StringPattern("a+", 0.5), StringPattern("a", 0.9)]), CellType("b", [StringPattern("aa", 0.9)]), CellType("c", [StringPattern("aa", 0.9)])]
    got = one(spark, classify(F.lit("aa"), types))[0]
    # Of a type the surest alternative that matches counts, even if another covers more.
    assert [(m.cell_type, m.precision) for m in got] == [("b", 0.9), ("c", 0.9), ("low", 0.45)]
    assert one(spark, classify(F.lit(None).cast("string"), types))[0] == []


def box(*v):
    return iv.box(*map(F.lit, v))


def test_distances(spark):
    far = box(0, 0, 2, 2), box(5, 4, 6, 6)
    r = one(spark, iv.distance_to_touch(*far), iv.distance_to_overlap(*far), iv.distance_to_contact(*far), iv.distance_by_axis(*far))
    assert (r[0], r[1], r[2], tuple(r[3])) == (5, 8, 6, (4, 8))
    inside = box(0, 0, 9, 9), box(2, 2, 3, 3)
    assert list(one(spark, iv.distance_to_overlap(*inside), iv.distance_to_contact(*inside), iv.nested(*inside))) == [0, 0, True]


def test_regions(spark):
    child = box(20, 1, 40, 5)
    cases = [
        (Location.parse("left", True), True, (20, 20, 40, None, None, 1, 5, None)),
        (Location.parse("right, bottom", True), True, (None, 20, 40, 40, None, 1, 5, 5)),
        (Location.parse({"top": 0, "left": "0..1", "right": "0..2"}, True), True, (19, 20, 40, 42, 1, 1, 5, None)),
        (Location.parse({"top": 7, "left": "*", "right": "*", "bottom": "*"}, False), False, (None, None, None, None, 12, 12, None, None)),
        (Location.parse({"right": "3..10", "top": "*"}, False), False, (None, None, 10, 17, None, None, None, None)),
        (None, True, (None, 20, 40, None, None, 1, 5, None)),
    ]
    for loc, inner, want in cases:
        assert tuple(one(spark, parent_region(child, loc, inner))[0]) == want
    parent = parent_region(box(0, 0, 10, 10), Location.parse("left, right, top, bottom", True), True)
    assert tuple(one(spark, child_region(parent, Location.parse("left", True), True))[0]) == (0, 0, None, 10, 0, None, None, 10)


def test_location_holds_where_the_region_says(spark):
    loc = Location.parse({"left": "0..2", "top": "1"}, False)
    r = one(spark, loc.holds(box(5, 5, 9, 9), box(2, 2, 4, 4)), loc.holds(box(5, 5, 9, 9), box(2, 2, 6, 4)))
    assert list(r) == [True, False]
    r = one(spark, Location(margin={"left": Span(0, 1)}).holds(box(5, 5, 9, 9), box(2, 2, 4, 4)))
    assert r[0] is True


def test_interval_columns(spark):
    p, q = iv.Pair(F.lit(1), F.lit(None).cast("int")), iv.lit_pair(Span(3, 5))
    i, u, m = iv.intersect(p, q), iv.union(p, q), iv.minus(q, iv.lit_pair(Span(1, 2)))
    r = one(spark, i.start, i.stop, u.start, u.stop, m.start, m.stop, iv.includes(p, q), iv.before(iv.lit_pair(Span(0, 2)), q), iv.before(p, q))
    assert list(r) == [3, 5, 1, None, 1, 4, True, True, False]


def test_algebra_columns(spark):
    b = {"this": box(1, 2, 4, 8), "parent": box(0, 0, 10, 10)}
    for expr, want in [("w == 3 and h == 6", True), ("0 < this_l < parent_r - 5", True), ("max(this_l, 3) + min(1, 2) == 4", True), ("(l if w > 9 else t) == 2", True), ("not (abs(l - r) == 3)", False), ("r // 3 == 1", True)]:
        assert one(spark, Algebra(expr).over_boxes(b))[0] is want
    with pytest.raises(KeyError):
        Algebra("other_l > 0").over_boxes(b)


@pytest.mark.parametrize(("raw", "want"), [("5.11", ["05.11.2025"]), ("5.2.", ["05.02.2026"]), ("01.09.02.10", ["01.09.2025", "02.10.2025"]), ("3.2025.10", ["03.10.2025"]), ("11.25.2025", ["25.11.2025"]), ("32.01", []), ("x", []), ("", [])])
def test_dates(spark, raw, want):
    assert one(spark, schedule.single_date(F.lit(raw), F.lit("2025–2026")))[0] == want


def test_schedule(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    r = one(
        spark,
        schedule.dates(arr("5.11; 5.11,06.11..7.11", None), F.lit(None).cast("string")),
        schedule.hour_ranges(arr("5 - 8 час.", "1-2", "3 - 4", "1 до 3", "вечер", "")),
        schedule.distinct_places(arr("А 101", "а101", "", "Б")),
        schedule.teachers_without_places(arr("Ив..  ов ;", "а 101", None), arr("А101")),
        schedule.dates_in_place(F.lit("А-101 5.11, 7.11.2025"), F.lit("2025-2026")),
        schedule.lesson_kind(F.lit("Лаб. раб."), arr("1-2"), F.lit(3)),
        schedule.lesson_kind(F.lit(None).cast("string"), arr("1-2", "3-4"), F.lit(6)),
        schedule.groups_between(arr("a", "b", "c"), F.lit("b"), F.lit("c")),
        schedule.weekday_index(F.lit("b"), arr("a", "b")),
        schedule.title(F.lit("фастив магистров и бакалавриат 2020-2021"), F.lit("магистратура")),
    )
    assert r[0] == ["05.11.2025", "06.11.2025", "07.11.2025"] and r[1] == ["5-6", "7-8", "1-2", "3-4", "1-3", "вечер"]
    assert r[2] == ["А 101", "Б"] and r[3] == ["Ив. ов"] and tuple(r[4]) == (["05.11.2025", "07.11.2025"], "А-101")
    assert list(r)[5:9] == ["лабораторная работа", "лабораторная работа", ["b", "c"], 1]
    assert r[9] == "ФАСТИВ и 2025-2026 магистратура"
