"""What needs no Spark: ranges, packing, clusters, grammars."""

import random
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.operators.clusters import connected, divided, touch
from gridloom.operators.packing import best_choice, clash_sets, compatible_combinations
from gridloom.plans.constraints import Algebra, Location, variable
from gridloom.plans.grammar import Overlap, read_grammar
from gridloom.plans.ranges import Span, flexibility, parse_size, parse_span, split_counts


@pytest.mark.parametrize(("text", "span"), [("3", (3, 3)), ("3+", (3, None)), ("3-", (None, 3)), ("-3+", (-3, None)), ("3..5", (3, 5)), ("3, 5", (3, 5)), ("*", (None, None)), ("* .. 5", (None, 5)), ("-5, *", (-5, None))])
def test_span_notation(text, span):
    assert parse_span(text) == Span(*span)


def test_bad_notation():
    for text in ("", "a", "5..3", "3..", "4x4"):
        with pytest.raises(ValueError):
            parse_span(text)
    assert parse_size("4+ x 1..2") == (Span(4, None), Span(1, 2)) == parse_size("4+ х 1..2")


@pytest.mark.parametrize(("total", "least", "most", "parts"), [(7, 3, 5, [4, 3]), (131, 15, 20, [20, 20, 20, 20, 20, 16, 15]), (2, 3, 5, []), (10, 5, 5, [5, 5]), (11, 5, 5, [5, 5]), (6, 4, 5, [5])])
def test_split_counts(total, least, most, parts):
    assert split_counts(total, least, most) == parts


spans = st.tuples(st.none() | st.integers(-9, 9), st.none() | st.integers(-9, 9)).filter(lambda t: None in t or t[0] <= t[1]).map(lambda t: Span(*t))


@given(spans, spans, st.integers(-20, 20))
def test_span_laws(a, b, v):
    i = a.intersect(b)
    assert (i is not None and v in i) == (v in a and v in b)
    if v in a or v in b:
        assert v in a.union(b)
    assert (a + b) - b == (a + b) + (-b)
    assert a.includes(b) == (b.intersect(a) == b)
    assert not a.before(b) or i is None


def test_flexibility():
    assert Span(1, 3).flexibility == 3 and Span(1).flexibility == 999 and Span().flexibility == 999_999
    assert flexibility([Span(), Span(), Span()]) == 999_999_999


def test_location_forms():
    assert Location.parse("left", True).padding == {"left": Span(0, 0), "top": Span(0), "right": Span(0), "bottom": Span(0)}
    out = Location.parse("left", False)
    assert out.margin == {"left": Span(0), "top": Span(None, -1), "bottom": Span(None, -1)} and not out.padding
    mixed = Location.parse({"margin-top": "2", "padding_left": "*"}, True)
    assert mixed.margin == {"top": Span(2, 2)} and mixed.padding["left"] == Span()


def test_algebra_shapes():
    a = Algebra("this_l == 3 and this_w <= parent_w")
    assert a.variables == ["this_l", "this_w", "parent_w"] and a.assigned() == {"this_l": "3"}
    assert variable("some_name_bottom") == ("some_name", "b")
    assert a.replaced({"parent_w": 7}).variables == ["this_l", "this_w"]


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 3), st.integers(1, 9)), max_size=10))
def test_packing_is_best(rows):
    """Against a search over all subsets."""
    cells = [range(a, a + n) for a, n, _ in rows]
    clashes = clash_sets(len(rows), cells)
    chosen = best_choice(clashes, lambda i: (rows[i][2],))
    assert all(not clashes[i] & set(chosen) for i in chosen)
    best = 0
    for k in range(len(rows) + 1):
        for some in combinations(range(len(rows)), k):
            if all(j not in clashes[i] for i, j in combinations(some, 2)):
                best = max(best, sum(rows[i][2] for i in some))
    assert sum(rows[i][2] for i in chosen) == best


def test_combinations_are_maximal():
    clashes = clash_sets(4, compatible=lambda i, j: (i + j) % 2 == 0)
    assert compatible_combinations(clashes) == [[0, 2], [1, 3]]
    assert compatible_combinations([]) == [[]]


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25, unique=True), st.integers(0, 3))
def test_connected_groups(points, gap):
    boxes = [(x, y, x + 1, y + 1) for x, y in points]
    label = list(range(len(boxes)))
    for _ in boxes:
        for i, j in combinations(range(len(boxes)), 2):
            if touch(boxes[i], boxes[j]) <= gap:
                label[i] = label[j] = min(label[i], label[j])
    want = sorted(sorted(i for i in range(len(boxes)) if label[i] == k) for k in set(label))
    assert sorted(connected(boxes, Span(0, gap), "corner")) == want


def test_division():
    row = [(x, 0, x + 1, 1) for x in range(31)]
    parts = divided(row, list(range(31)), Span(1), (Span(1, 4), Span(1, 4)), True, Span(0, 0), "side")
    assert len(parts) == 8 and sorted(i for p in parts for i in p) == list(range(31)) and max(map(len, parts)) == 4
    counted = divided(row, list(range(31)), Span(4, 6), None, True, Span(0, 0), "side")
    assert sorted(map(len, counted), reverse=True) == [6, 6, 6, 6, 4] or sum(map(len, counted)) == 31
    assert divided(row, list(range(31)), Span(4, 6), None, False, Span(0, 0), "side") == []
    assert divided(row[:2], [0, 1], Span(4, 6), None, True, Span(0, 0), "side") == []


def _grammar():
    types = [{"a": {"patterns": [{"pattern": "a"}]}}]
    return read_grammar({"cell_types": types, "patterns": {"a": {"kind": "cell", "content_type": "a", "extends": ["base"]}, "base": {"kind": "general"}, "row": {"kind": "array", "item_pattern": "base"}, "root": {"kind": "area", "root": True, "inner": {"r": {"pattern": "row"}, "own": {"pattern_definition": {"kind": "array", "item_pattern": "a"}}}}, "lost": {"kind": "unknown"}}})


def test_grammar_waves():
    g = _grammar()
    assert g.waves() == [["a"], ["base", "root.own[inline]"], ["row"], ["root"]] and g.root == "root"
    assert g.bases("a") == ["base"] and g.extensions("base") == ["a"] and g.can_extend("a", "base")
    assert "lost" not in g.patterns


def test_grammar_errors():
    with pytest.raises(ValueError):
        read_grammar({"patterns": {"x": {"kind": "array", "item_pattern": "none"}}})
    with pytest.raises(ValueError):
        read_grammar({"patterns": {"x": {"kind": "array", "item_pattern": "y"}, "y": {"kind": "array", "item_pattern": "x"}}}).waves()


def test_includes(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "types.yml").write_text("cell_types: [{n: {patterns: [{pattern: '[0-9]+'}]}}]")
    (tmp_path / "base.yml").write_text("patterns: {n: {kind: cell, content_type: n, confidence: 0.5}}")
    (tmp_path / "deep/main.yml").write_text("include_grammars: [base.yml]\ncell_types_filepath: types.yml\npatterns: {n: {kind: cell, content_type: n}}")
    g = read_grammar(tmp_path / "deep/main.yml")
    assert g.patterns["n"].confidence == 1.0 and [t.name for t in g.effective_cell_types()] == ["n"]


def test_overlap_config():
    assert Overlap.parse(None).mode == "none" and Overlap.parse({}).mode == "full"
    assert Overlap.parse({"mode": "partial", "resolution": ["width-min", "bad"]}).criteria == [("width", -1)]
    assert Overlap.parse({"resolution": ["bad"]}).mode == "none"


def test_big_cluster_is_shuffle_proof():
    rng = random.Random(3)
    boxes = [(x, y, x + 1, y + 1) for x in range(16) for y in range(16)]
    rng.shuffle(boxes)
    parts = divided(boxes, list(range(256)), Span(16, 16), (Span(4, 4), Span(4, 4)), True, Span(0, 0), "corner")
    assert len(parts) == 16


def test_packing_of_long_chains_is_exact():
    """Chains of hundreds of elements, against a plain recurrence."""
    rng = random.Random(6)
    for n in (60, 300):
        worth = [rng.randint(1, 9) for _ in range(n)]
        cells = [range(i, i + 2) for i in range(n)]
        order = list(range(n))
        rng.shuffle(order)
        chosen = best_choice(clash_sets(n, [cells[i] for i in order]), lambda k: (worth[order[k]],))
        take, skip = 0, 0
        for w in worth:
            take, skip = skip + w, max(take, skip)
        assert sum(worth[order[k]] for k in chosen) == max(take, skip)
        assert all(abs(order[a] - order[b]) > 1 for a, b in combinations(chosen, 2))


def partitions(cells, fits):
    """The fewest members left out, then the fewest parts, over all sets of disjoint connected fitting parts."""
    cells = tuple(sorted(cells, key=lambda c: (c[1], c[0])))
    if not cells:
        return 0, 0
    first, rest = cells[0], cells[1:]
    out, n = partitions(rest, fits)
    best = (out + 1, n)
    for k in range(len(rest) + 1):
        for some in combinations(rest, k):
            part = (first, *some)
            if fits(part):
                out, n = partitions(tuple(c for c in rest if c not in some), fits)
                best = min(best, (out, n + 1))
    return best


def joined(part):
    seen, todo = {part[0]}, [part[0]]
    while todo:
        x, y = todo.pop()
        for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if c in part and c not in seen:
                seen.add(c)
                todo.append(c)
    return len(seen) == len(part)


def shapes():
    rng = random.Random(9)
    out = [[(x, y) for x in range(w) for y in range(h)] for w, h in ((1, 7), (4, 2), (3, 3), (8, 1))]
    while len(out) < 14:
        shape = {(0, 0)}
        while len(shape) < rng.randint(5, 8):
            x, y = rng.choice(sorted(shape))
            shape.add(rng.choice([(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]))
        out.append(sorted(shape))
    return out


def test_division_by_size_is_best():
    """All parts are whole windows' groups; against a search over all sets of parts."""
    for shape in shapes():
        boxes = [(x, y, x + 1, y + 1) for x, y in shape]
        for size in ((Span(1, 2), Span(1, 2)), (Span(2, 3), Span(1, 1)), (Span(1, 3), Span(2, 2))):
            got = divided(boxes, list(range(len(boxes))), Span(1), size, True, Span(0, 0), "side")
            wide, high = (max(v) - min(v) + 1 for v in zip(*shape))
            if wide < size[0].start or high < size[1].start:
                assert got == []
                continue
            members = [i for p in got for i in p]
            assert len(set(members)) == len(members) and all(joined([shape[i] for i in p]) for p in got)

            def fits(part):
                l, t, r, b = min(x for x, _ in part), min(y for _, y in part), max(x for x, _ in part) + 1, max(y for _, y in part) + 1
                inside = [c for c in shape if l <= c[0] < r and t <= c[1] < b]
                return (r - l) in size[0] and (b - t) in size[1] and joined(list(part)) and all(c in part or not any(abs(c[0] - q[0]) + abs(c[1] - q[1]) == 1 for q in part) for c in inside)

            assert (len(shape) - len(members), len(got)) == partitions(shape, fits), (shape, size)


def test_division_by_count():
    """Connected parts of wanted counts, each cell once; on lines and rectangles as many cells as can be."""
    for shape in shapes():
        boxes = [(x, y, x + 1, y + 1) for x, y in shape]
        for least, most in ((2, 3), (3, 4), (1, 4)):
            if len(shape) <= most:
                continue
            got = divided(boxes, list(range(len(boxes))), Span(least, most), None, True, Span(0, 0), "side")
            members = [i for p in got for i in p]
            assert len(set(members)) == len(members) and all(least <= len(p) <= most and joined([shape[i] for i in p]) for p in got)
            left = partitions(shape, lambda part: least <= len(part) <= most and joined(list(part)))[0]
            square = len(shape) == len({x for x, _ in shape}) * len({y for _, y in shape})
            assert len(shape) - len(members) == left or not square, (shape, least, most)
            assert len(members) >= (len(shape) - left) * 0.6


def test_span_make():
    assert Span.make(3) == Span(3, 3) == Span.make(Span(3, 3)) and Span.make("2+") == Span(2, None) == Span.make((2, None))
    assert Span(2, None).is_open and not Span(1, 4).is_open and Span(4, 4).point == 4 and Span(1, 4).point is None
