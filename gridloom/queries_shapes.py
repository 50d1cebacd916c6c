"""Named queries, with SQL, of the algebra of ranged segments and of points and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import intervals as iv
from gridloom.functions import shapes
from gridloom.functions import schedule
from gridloom.functions.text import joined_letters
from gridloom.operators import grid
from gridloom.plans.constraints import Algebra, box_is_sound, inside_container, relation_test
from gridloom.queries import PAIRS, _pairs, _t, query

SEGMENTS = """x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 END AS a0, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 11 + p_size % 6 END AS a1,
  CASE WHEN p_size % 3 <> 0 THEN p_partkey % 11 + p_size % 9 - 1 END AS b0, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 11 + p_size % 9 + p_partkey % 3 END AS b1 FROM part),
s AS (SELECT p.k, p.a0, p.a1, p.b0, p.b1, q.a0 AS c0, q.a1 AS c1, q.b0 AS d0, q.b1 AS d1 FROM x p JOIN x q ON q.k = p.k + 1
  WHERE coalesce(p.b0 <= p.b1, true) AND coalesce(p.a0 <= p.b1, true) AND coalesce(q.b0 <= q.b1, true) AND coalesce(q.a0 <= q.b1, true))"""


def _segments(spark, d):
    """Neighbours of ``part`` as two ranged segments: their table, and both."""
    k, s = F.col("p_partkey"), F.col("p_size")
    ends = {"0": F.when(k % 5 != 0, k % 11), "1": F.when(k % 4 != 0, k % 11 + s % 6), "2": F.when(s % 3 != 0, k % 11 + s % 9 - 1), "3": F.when(k % 7 != 0, k % 11 + s % 9 + k % 3)}
    p, q = (_t(spark, d, "part").select(k.alias(f"{n}k"), *[c.alias(n + i) for i, c in ends.items()]) for n in "pq")
    made = [iv.Segment(iv.Pair(F.col(n + "0"), F.col(n + "1")), iv.Pair(F.col(n + "2"), F.col(n + "3"))) for n in "pq"]
    good = lambda x: iv.valid(x.b) & iv.valid(shapes.maximal(x))
    return p.join(q, F.col("qk") == F.col("pk") + 1).where(good(made[0]) & good(made[1])), *made


def _ends(s: iv.Segment):
    return [c.cast("long").alias(n) for c, n in zip((*s.a, *s.b), ("a0", "a1", "b0", "b1"))]


@query(f"""WITH {SEGMENTS}, f AS (SELECT *, coalesce(greatest(a0, b0) <= least(a1, b1), true) AND NOT (a0 IS NULL AND a1 IS NULL) AND NOT (b0 IS NULL AND b1 IS NULL) AS fix FROM s)
SELECT k, a0, CASE WHEN fix AND a1 IS NULL THEN b0 ELSE a1 END AS a1, CASE WHEN fix AND b0 IS NULL THEN a1 ELSE b0 END AS b0, b1 FROM f""")
def ranged_repair(spark, d):
    """Inner ends left open are closed by one another."""
    t, p, _ = _segments(spark, d)
    fixed = shapes.repaired(p)
    return t.where(fixed.ok).select(F.col("pk").alias("k"), *_ends(fixed.segment))


@query(f"WITH {SEGMENTS} SELECT k, a0, coalesce(a1, a0) AS a1, coalesce(b0, b1) AS b0, b1 FROM s")
def ranged_materialise(spark, d):
    t, p, _ = _segments(spark, d)
    return t.select(F.col("pk").alias("k"), *_ends(shapes.materialised(p)))


@query(f"""WITH {SEGMENTS}, m AS (SELECT *, greatest(a1, a0) AS u0, least(b0, b1) AS u1, greatest(c1, c0) AS v0, least(d0, d1) AS v1 FROM s),
h AS (SELECT *, coalesce(a1 <= b0, true) AND coalesce(u0 <= u1, true) AS hu, coalesce(c1 <= d0, true) AND coalesce(v0 <= v1, true) AS hv FROM m),
w AS (SELECT *, CASE WHEN hu AND hv THEN least(u0, v0) WHEN hu THEN u0 WHEN hv THEN v0 END AS w0, CASE WHEN hu AND hv THEN greatest(u1, v1) WHEN hu THEN u1 WHEN hv THEN v1 END AS w1, greatest(a0, c0) AS o0, least(b1, d1) AS o1 FROM h WHERE hu OR hv)
SELECT k, o0 AS a0, greatest(w0, o0) AS a1, least(w1, o1) AS b0, o1 AS b1 FROM w WHERE coalesce(w0 <= w1, true) AND coalesce(o0 <= o1, true) AND coalesce(greatest(w0, o0) <= least(w1, o1), true)""")
def ranged_combine(spark, d):
    """Two segments' definite parts grown together within what is possible for both."""
    t, p, q = _segments(spark, d)
    both = shapes.combined(p, q)
    return t.where(both.ok).select(F.col("pk").alias("k"), *_ends(both.segment))


@query(f"""WITH {SEGMENTS}, m AS (SELECT k, a0, b1, c0, d1, coalesce(a1, a0) AS a1, coalesce(b0, b1) AS b0, coalesce(c1, c0) AS c1, coalesce(d0, d1) AS d0 FROM s),
u AS (SELECT k, CASE WHEN a0 IS NOT NULL AND c0 IS NOT NULL THEN least(a0, c0) END AS o0, CASE WHEN b1 IS NOT NULL AND d1 IS NOT NULL THEN greatest(b1, d1) END AS o1,
  CASE WHEN a1 IS NOT NULL AND c1 IS NOT NULL THEN least(a1, c1) END AS i0, CASE WHEN b0 IS NOT NULL AND d0 IS NOT NULL THEN greatest(b0, d0) END AS i1 FROM m)
SELECT k, o0 AS a0, greatest(i0, o0) AS a1, least(i1, o1) AS b0, o1 AS b1 FROM u""")
def ranged_union(spark, d):
    t, p, q = _segments(spark, d)
    return t.select(F.col("pk").alias("k"), *_ends(shapes.united(p, q)))


@query(f"""WITH {SEGMENTS} SELECT k, CASE WHEN a0 IS NOT NULL AND c0 IS NOT NULL THEN least(a0, c0) END AS a0, CASE WHEN a1 IS NOT NULL AND c1 IS NOT NULL THEN greatest(a1, c1) END AS a1,
  CASE WHEN b0 IS NOT NULL AND d0 IS NOT NULL THEN least(b0, d0) END AS b0, CASE WHEN b1 IS NOT NULL AND d1 IS NOT NULL THEN greatest(b1, d1) END AS b1 FROM s
WHERE coalesce(greatest(a0, c0) <= least(a1, c1), true) AND coalesce(greatest(b0, d0) <= least(b1, d1), true)""")
def ranged_union_of_ends(spark, d):
    t, p, q = _segments(spark, d)
    both = shapes.united_ends(p, q)
    return t.where(both.ok).select(F.col("pk").alias("k"), *_ends(both.segment))


_IN = "({0}0 IS NULL OR coalesce({1}0 >= {0}0, false)) AND ({0}1 IS NULL OR coalesce({1}1 <= {0}1, false))"
_HELD = "(a0 IS NULL OR coalesce({0}0 >= a0, false)) AND (b1 IS NULL OR coalesce({0}1 <= b1, false))"


@query(f"WITH {SEGMENTS} SELECT k, {_IN.format('a', 'c')} AND {_IN.format('b', 'd')} AS covered, {_HELD.format('c')} AND {_HELD.format('d')} AS held FROM s")
def ranged_covers(spark, d):
    t, p, q = _segments(spark, d)
    return t.select(F.col("pk").alias("k"), shapes.covers(p, q).alias("covered"), shapes.holds(p, q).alias("held"))


@query(f"""WITH {PAIRS}, c AS (SELECT pk, greatest(pl - 2, ql - 3) AS xa0, least(pl, ql) AS i0, greatest(pr, qr) AS i1, least(pr + 3, qr + 2) AS xb1, greatest(pt - 1, qt - 1) AS ya0, least(pt, qt) AS j0, greatest(pb, qb) AS j1, least(pb + 4, qb + 1) AS yb1 FROM pq)
SELECT pk, xa0, greatest(xa0, i0) AS xa1, least(xb1, i1) AS xb0, xb1, ya0, greatest(ya0, j0) AS ya1, least(yb1, j1) AS yb0, yb1 FROM c
WHERE xa0 <= xb1 AND ya0 <= yb1 AND greatest(xa0, i0) <= least(xb1, i1) AND greatest(ya0, j0) <= least(yb1, j1)""")
def ranged_box_combine(spark, d):
    p, q = F.col("p"), F.col("q")
    rb = lambda b, l, r, t, u: iv.ranged_box(iv.Segment(iv.Pair(b["l"] - l, b["l"]), iv.Pair(b["r"], b["r"] + r)), iv.Segment(iv.Pair(b["t"] - t, b["t"]), iv.Pair(b["b"], b["b"] + u)))  # noqa: E731, E741
    both = _pairs(spark, d).withColumn("rb", shapes.combined_boxes(rb(p, 2, 3, 1, 4), rb(q, 3, 2, 1, 1))).where("rb is not null")
    return both.select("pk", *[F.col(f"rb.{f}").cast("long").alias(f) for f in iv.RANGED])


@query(f"""WITH {PAIRS} SELECT pk, ql - pl AS inner_left, pr - qr AS inner_right, pl - qr AS outer_left, ql - pr AS outer_right, greatest(pl - qr, ql - pr) AS outer_,
  'A ' || CASE WHEN pl = ql AND pr = qr THEN 'совпадает с' WHEN pr < ql THEN 'на удалении сверху от' WHEN pl > qr THEN 'на удалении снизу от' WHEN pr = ql THEN 'примыкает сверху к' WHEN pl = qr THEN 'примыкает снизу к'
  WHEN pl = ql AND pr < qr THEN 'включается, примыкая сверху, в' WHEN pl = ql THEN 'включает примыкающее сверху' WHEN pr = qr AND pl > ql THEN 'включается, примыкая снизу, в' WHEN pr = qr THEN 'включает примыкающее снизу'
  WHEN pl > ql AND pr < qr THEN 'входит в' WHEN pl < ql AND pr > qr THEN 'включает' ELSE 'пересекается с' END || ' B' AS words FROM pq""")
def segment_description(spark, d):
    """Inner offsets and outer gaps of two segments, and their relation in the words for columns."""
    ends = [F.col(f"{n}.{e}") for n in "pq" for e in "lr"]
    kind = shapes.described(iv.relation(*ends), F.lit("A"), F.lit("B"), vertical=True)
    o = _pairs(spark, d).select("pk", shapes.offsets(*ends).alias("o"), kind.alias("words"))
    return o.select("pk", *[F.col(f"o.{c}").cast("long").alias(n) for c, n in (("inner_left", "inner_left"), ("inner_right", "inner_right"), ("outer_left", "outer_left"), ("outer_right", "outer_right"), ("outer", "outer_"))], "words")


@query("""WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 9 END AS a, CASE WHEN p_partkey % 3 <> 1 THEN p_size % 5 END AS n, CASE WHEN p_partkey % 3 <> 2 OR p_size % 4 = 0 THEN p_partkey % 9 + p_size % 6 END AS b FROM part)
SELECT k, coalesce(a, b - n) AS a, coalesce(n, b - a) AS n, coalesce(b, a + n) AS b, NOT (a IS NOT NULL AND n IS NOT NULL AND b IS NOT NULL AND a + n <> b) AS ok FROM x""")
def partial_box(spark, d):
    """A box's side from the two of its start, size and end that are known, and whether all three agree."""
    k, s = F.col("p_partkey"), F.col("p_size")
    side = shapes.deduced(F.when(k % 3 != 0, k % 9), F.when(k % 3 != 1, s % 5), F.when((k % 3 != 2) | (s % 4 == 0), k % 9 + s % 6))
    return _t(spark, d, "part").select(k.alias("k"), *[c.cast("long").alias(n) for c, n in zip(side[:3], "anb")], side.ok.alias("ok"))


@query(f"WITH {PAIRS} SELECT pk, least(pl, qr) AS l, least(pt, qb) AS t, greatest(pl, qr) AS r, greatest(pt, qb) AS b FROM pq")
def box_from_points(spark, d):
    p, q = F.col("p"), F.col("q")
    return _pairs(spark, d).select("pk", shapes.box_between(p["l"], p["t"], q["r"], q["b"]).alias("x")).select("pk", *[F.col(f"x.{c}").cast("long").alias(c) for c in "ltrb"])


@query(f"""WITH {PAIRS}, e AS (SELECT pk, pl, pt, CAST(x AS INT) AS px, CAST(y AS INT) AS py FROM pq, range(0, 40) tx(x), range(0, 40) ty(y) WHERE x >= pl AND x < pr AND y >= pt AND y < pb)
SELECT pk, px, py, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pk ORDER BY px DESC, py DESC) AS INT) AS pos FROM e) WHERE px <> pl OR py <> pt""")
def box_points_ordered(spark, d):
    """A box's points up each column, columns from the right, without the top left one."""
    boxes = _pairs(spark, d).select("pk", "p.*")
    return grid.ordered_points(boxes, "up", "left", exclude_top_left=True).select("pk", "px", "py", F.col("pos").cast("int").alias("pos"))


@query(f"""WITH {PAIRS}, c AS (SELECT pk, pl < ql AS a, pb - pt >= 2 AS b, pl <= ql AND pt <= qt AND qr <= pr AND qb <= pb AS held, pr - pl AS w, ql FROM pq)
SELECT pk, a AND b AS both_, a OR b AS either, a <> b AS one_, NOT a AS none_, held, true AS sound, w * 2 - 1 > ql AND w % 2 = 1 AS named FROM c""")
def algebra_logic(spark, d):
    """Conditions joined, negated and renamed; what holds for any box, and for one in another."""
    a, b = Algebra("p_l < q_l"), Algebra("p_h >= 2")
    named = Algebra("x * k - 1 > other_l and x % 2 == 1").replaced({"x": "p_w", "k": 2, "other_l": "q_l"})
    tests = {"both_": a.joined(b, "and"), "either": a.joined(b, "or"), "one_": a.joined(b, "xor"), "none_": a.negated(), "held": inside_container("q", "p"), "sound": box_is_sound("p"), "named": named}
    boxes = {"p": F.col("p"), "q": F.col("q")}
    return _pairs(spark, d).select("pk", *[t.over_boxes(boxes).alias(n) for n, t in tests.items()])


@query(f"WITH {PAIRS} SELECT pk, pl = ql AS same, pl < ql AS below, ql - pl > 1 AS far, abs(ql - pl) = 2 AS two_off, ql - pl >= 3 AS three_on FROM pq")
def number_relations(spark, d):
    forms = {"same": "=", "below": "<", "far": "<<", "two_off": "<2>", "three_on": "<3+<"}
    return _pairs(spark, d).select("pk", *[relation_test(s)(F.col("p.l"), F.col("q.l")).alias(n) for n, s in forms.items()])


@query("SELECT n_nationkey AS k, n_name || ',II,' || n_name AS joined FROM nation")
def joined_single_letters(spark, d):
    """Texts of single letters become one text each time they stand together."""
    letters = F.split("n_name", "")
    texts = F.concat(letters, F.array(F.lit("II")), letters)
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array_join(joined_letters(texts), ",").alias("joined"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'Ann,Bob' ELSE 'Ann,R-' || p_size || ',Bob' END AS teachers, 'R-' || p_size || ',S' AS places FROM part""")
def teachers_and_places(spark, d):
    """A teacher who is spelt as a place is none; places that differ in blanks and case are one."""
    room = F.concat(F.lit("R-"), F.col("p_size").cast("string"))
    people = F.array(F.lit("Ann"), room, F.lit("Bob"))
    rooms = F.when(F.col("p_size") % 2 == 0, F.array(room, F.lit("S"))).otherwise(F.array(F.lit("S")))
    places = schedule.distinct_places(F.array(room, F.lower(room), F.lit("S"), F.lit(" s")))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(schedule.teachers_without_places(people, rooms), ",").alias("teachers"), F.array_join(places, ",").alias("places"))
