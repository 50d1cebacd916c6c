"""More named queries, with SQL: arrays with gaps and breakdown, boxes, spans, and timetable fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import intervals as iv
from gridloom.functions import schedule
from gridloom.functions.patterns import StringPattern
from gridloom.operators import grid, reports
from gridloom.plans.ranges import Span
from gridloom.queries import EV, PAIRS, _array, _boxes, _pairs, _t, events, islands, matched, query
from gridloom.sources.grids import as_cells

GAPS = """g AS (SELECT *, CASE WHEN x - lag(x) OVER w <= {step} THEN 0 ELSE 1 END AS new FROM ev WHERE content IN ('click', 'view') WINDOW w AS (PARTITION BY doc_id, y ORDER BY x)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, y ORDER BY x) AS island FROM g),
total AS (SELECT doc_id, count(*) AS total FROM i GROUP BY doc_id),
a AS (SELECT doc_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, count(*) AS n FROM i GROUP BY doc_id, y, island)"""


@query(f"WITH {EV}, {GAPS.format(step=3)} SELECT doc_id, l, t, r, b, round(1 - 0.5 / n, 6) AS precision FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1")
def array_gap(spark, d):
    return _boxes(matched(spark, d, _array(gap="0..2")).lookup("arr"))


@query(f"""WITH RECURSIVE {EV}, c AS (SELECT doc_id, x, y, y * 1000 + x AS id FROM ev WHERE content = 'purchase'),
e AS (SELECT p.doc_id, p.id AS a, q.id AS b FROM c p JOIN c q ON p.doc_id = q.doc_id AND abs(p.x - q.x) + abs(p.y - q.y) <= 1),
r(doc_id, a, b) AS (SELECT doc_id, a, b FROM e UNION SELECT r.doc_id, r.a, e.b FROM r JOIN e ON r.doc_id = e.doc_id AND r.b = e.a),
g AS (SELECT doc_id, a, min(b) AS g FROM r GROUP BY ALL),
total AS (SELECT doc_id, count(*) AS total FROM c GROUP BY doc_id)
SELECT c.doc_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, round(1 - 0.5 / count(*), 6) AS precision
FROM c JOIN g ON c.doc_id = g.doc_id AND c.id = g.a JOIN total ON c.doc_id = total.doc_id WHERE total > 1 GROUP BY c.doc_id, g.g HAVING count(*) >= 2""")
def array_fill_side(spark, d):
    """Connected by whole sides: cells that meet at a corner are apart."""
    return _boxes(matched(spark, d, _array(direction="fill", item_pattern="purchase", distance_kind="side")).lookup("arr"))


@query(f"""WITH RECURSIVE {EV}, {islands('x', 'click', 'view')},
p AS (SELECT doc_id, t, b, l AS place, n AS rest, CASE WHEN n = 5 THEN 3 ELSE least(n, 4) END AS took FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1
  UNION ALL SELECT doc_id, t, b, place + took, rest - took, CASE WHEN rest - took = 5 THEN 3 ELSE least(rest - took, 4) END FROM p WHERE rest > took)
SELECT doc_id, CAST(place AS INT) AS l, t, CAST(place + took AS INT) AS r, b, round(1 - 0.5 / took, 6) AS precision FROM p""")
def array_breakdown_count(spark, d):
    """Runs broken down to two to four cells each, from the left, the fewest parts."""
    return _boxes(matched(spark, d, _array(item_count="2..4", allow_breakdown=True)).lookup("arr"))


@query(f"""WITH {EV}, {islands('x', 'click', 'view')}
SELECT doc_id, CAST(l + 3 * k AS INT) AS l, t, CAST(least(l + 3 * k + 3, r) AS INT) AS r, b, round(1 - 0.5 / (least(l + 3 * k + 3, r) - l - 3 * k), 6) AS precision
FROM a JOIN total USING (doc_id), range(0, 1000) tk(k) WHERE l + 3 * k < r AND total > 1""")
def array_breakdown_size(spark, d):
    """Runs broken down to parts at most three cells wide, none left out, the fewest parts."""
    return _boxes(matched(spark, d, _array(item_count="1+", size="3- x 1", allow_breakdown=True)).lookup("arr"))


@query(f"WITH {EV}, {islands('x', 'click', 'view')}, w AS (SELECT doc_id, l, t, r, b, 1 - 0.5 / n AS p FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1) SELECT doc_id, l, t FROM w QUALIFY p >= 0.9 * max(p) OVER (PARTITION BY doc_id)")
def matches_near_best(spark, d):
    return reports.near_best(matched(spark, d, _array()).lookup("arr"), "doc_id").select("doc_id", "l", "t")


@query(f"WITH {EV} SELECT doc_id, x, y FROM ev WHERE content = 'error' AND x > 0")
def grid_find_all(spark, d):
    return grid.find_cells(events(spark, d), (F.col("content") == "error") & (F.col("x") > 0)).select("doc_id", "x", "y")


@query("SELECT n_regionkey AS doc_id, n_name AS content, CAST(n_nationkey * 4 AS INT) AS x FROM nation WHERE n_nationkey * 4 <= 30 AND n_nationkey * 4 + 3 > 30")
def grid_merged_cell_at(spark, d):
    """A cell of three columns is found by each of its points."""
    cells = as_cells(_t(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") * 4).alias("x"), F.lit(2).alias("y"), F.col("n_name").alias("content")), w=3, h=2)
    return grid.cell_at(cells, 30, 3).select("doc_id", "content", "x")


@query(f"WITH {PAIRS} SELECT pk, CAST(i AS INT) AS corner, CAST(CASE WHEN i IN (0, 3) THEN pl ELSE pr END AS INT) AS px, CAST(CASE WHEN i < 2 THEN pt ELSE pb END AS INT) AS py FROM pq, range(0, 4) c(i)")
def box_corners(spark, d):
    return grid.corners(_pairs(spark, d).select("pk", "p.*")).select("pk", "corner", "px", "py")


@query("SELECT p_partkey AS k, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 7, p_size % 5, p_size, p_partkey) AS INT) AS pos FROM part")
def box_ordering(spark, d):
    p = _t(spark, d, "part").select("p_brand", F.col("p_partkey").alias("k"), (F.col("p_partkey") % 7).alias("l"), (F.col("p_size") % 5).alias("t"), (F.col("p_partkey") % 7 + F.col("p_size")).alias("r"), (F.col("p_size") % 5 + F.col("p_partkey")).alias("b"))
    return grid.box_order(p, "p_brand").select("k", "pos")


@query(f"""WITH {PAIRS} SELECT pk, abs(pl - ql) + abs(pt - qt) AS steps, round(sqrt((pl - ql) ** 2 + (pt - qt) ** 2), 6) AS line,
  greatest(0, ql - pl, pl - qr) + greatest(0, qt - pt, pt - qb) AS outside, 2 * (pr - pl + pb - pt) AS around, (pr - pl) * (pb - pt) AS area,
  ql >= pl AND qt >= pt AND qr <= pr AND qb <= pb AS holds FROM pq""")
def box_measures(spark, d):
    p, q = F.col("p"), F.col("q")
    return _pairs(spark, d).select(
        "pk", iv.manhattan(p["l"], p["t"], q["l"], q["t"]).cast("long").alias("steps"), F.round(iv.euclid(p["l"], p["t"], q["l"], q["t"]), 6).alias("line"),
        iv.point_to_box(p["l"], p["t"], q).cast("long").alias("outside"), iv.perimeter(p).cast("long").alias("around"), iv.box_area(p).cast("long").alias("area"), iv.nested(p, q).alias("holds"),
    )


@query(f"WITH {PAIRS} SELECT pk, greatest(pl, ql) AS a, least(pr, qr) AS b FROM pq WHERE greatest(pl, ql) <= least(pr, qr)")
def segment_intersection(spark, d):
    p, q = F.col("p"), F.col("q")
    both = _pairs(spark, d).withColumn("s", iv.shared_segment(p["l"], p["r"], q["l"], q["r"])).where("s is not null")
    return both.select("pk", F.col("s.a").cast("long").alias("a"), F.col("s.b").cast("long").alias("b"))


SPANS = """s AS (SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS a, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + p_partkey % 9 END AS b,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 40 END AS c, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 40 + p_size % 6 END AS d FROM part)"""


@query(f"""WITH {SPANS} SELECT k, (a IS NULL OR coalesce(c >= a, false)) AND (b IS NULL OR coalesce(d <= b, false)) AS holds, coalesce(b < c, false) AS ahead,
  a - d AS less_a, b - c AS less_b, CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN least(a, c) END AS all_a, CASE WHEN b IS NOT NULL AND d IS NOT NULL THEN greatest(b, d) END AS all_b,
  least(a, c) AS some_a, greatest(b, d) AS some_b, coalesce(greatest(a, c) <= least(b, d), true) AS meet, (a IS NULL OR 20 >= a) AND (b IS NULL OR 20 <= b) AS has20 FROM s""")
def span_relations(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    p = iv.Pair(F.when(size % 4 != 0, size), F.when(size % 3 != 0, size + key % 9))
    q = iv.Pair(F.when(key % 5 != 0, key % 40), F.when(key % 7 != 0, key % 40 + size % 6))
    less, every, some = iv.minus(p, q), iv.union(p, q), iv.union_limited(p, q)
    long = lambda c, n: c.cast("long").alias(n)
    return _t(spark, d, "part").select(
        key.alias("k"), iv.includes(p, q).alias("holds"), iv.before(p, q).alias("ahead"), long(less.start, "less_a"), long(less.stop, "less_b"),
        long(every.start, "all_a"), long(every.stop, "all_b"), long(some.start, "some_a"), long(some.stop, "some_b"), iv.valid(iv.intersect(p, q)).alias("meet"), iv.contains(p, F.lit(20)).alias("has20"),
    )


@query(f"""WITH {PAIRS}, r AS (SELECT pk, greatest(pl, ql - 2) AS xa0, least(pl + 3, ql + 1) AS xa1, greatest(pr - 1, qr - 2) AS xb0, least(pr + 2, qr + 4) AS xb1 FROM pq),
n AS (SELECT pk, greatest(xa0, xb0 - 4) AS xa0, least(xa1, xb1 - 2) AS xa1, greatest(xb0, xa0 + 2) AS xb0, least(xb1, xa1 + 4) AS xb1 FROM r)
SELECT * FROM n WHERE xa0 <= xa1 AND xb0 <= xb1 AND xa0 <= xb1""")
def ranged_segments(spark, d):
    """Two ranged segments' ends intersected and narrowed to lengths of two to four."""
    p, q = F.col("p"), F.col("q")
    one = iv.Segment(iv.Pair(p["l"], p["l"] + 3), iv.Pair(p["r"] - 1, p["r"] + 2))
    two = iv.Segment(iv.Pair(q["l"] - 2, q["l"] + 1), iv.Pair(q["r"] - 2, q["r"] + 4))
    s = iv.restricted_by_size(iv.intersect_ends(one, two), Span(2, 4))
    ends = [c.cast("long").alias(n) for c, n in zip((*s.a, *s.b), ("xa0", "xa1", "xb0", "xb1"))]
    return _pairs(spark, d).where(iv.segment_valid(s)).select("pk", *ends)


@query("SELECT p_partkey, regexp_extract(p_name, '^([a-z]+) ([a-z]+)', 1) AS first, regexp_extract(p_name, '^([a-z]+) ([a-z]+)', 2) AS second FROM part WHERE regexp_matches(p_name, '^[a-z]+ [a-z]+')")
def match_spaced_pattern(spark, d):
    """Two blanks of a ``re-spaces`` pattern stand for some white space; flags and named groups of the pattern hold."""
    p = StringPattern(r"(?P<first>[A-Z]+)  (?P<second>[A-Z]+)", 1.0, pattern_syntax="re-spaces", pattern_flags="I")
    m = p.match(F.regexp_replace("p_name", " ", " \t "), "name", 0)
    return _t(spark, d, "part").where(m.isNotNull()).select("p_partkey", m["captures"]["first"].alias("first"), m["captures"]["second"].alias("second"))


@query("""SELECT p_partkey AS k, ['лабораторная работа', 'практика', 'практика', 'лекция', CASE WHEN p_size % 2 = 0 AND p_size >= 6 THEN 'лабораторная работа' ELSE 'лекция' END][p_size % 5 + 1] AS kind,
  'Б-' || p_size AS room, p_name || ' A.B.' AS teacher, CAST(p_size % 6 AS INT) AS day, CASE WHEN p_size % 3 = 0 THEN 'b,c' ELSE '' END AS groups, upper(replace(p_type, ' ', '')) AS key FROM part""")
def lesson_fields(spark, d):
    size = F.col("p_size")
    word = F.get(F.array(*map(F.lit, ["Лаб. раб.", "пр. зан.", "ПРАКТИКА", "лекция №1", "-"])), (size % 5).cast("int"))
    hours = F.when(size % 2 == 0, F.array(F.lit("1-2"), F.lit("3-4"))).otherwise(F.array(F.lit("1-2")))
    days = F.array(*map(F.lit, "012345"))
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("k"), schedule.lesson_kind(word, hours, size).alias("kind"), schedule.clean_room(F.concat(F.lit("Б---"), size.cast("string"))).alias("room"),
        schedule.clean_teacher(F.concat(F.lit(" ;"), F.col("p_name"), F.lit("  A..B. ,"))).alias("teacher"), schedule.weekday_index((size % 6).cast("string"), days).alias("day"),
        F.array_join(schedule.groups_between(F.array(*map(F.lit, "abc")), F.when(size % 3 == 0, F.lit("b")).otherwise(F.lit("z")), F.lit("c")), ",").alias("groups"), schedule.compare_key(F.col("p_type")).alias("key"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') || ',' || strftime(o_orderdate, '%d.%m.') || CASE WHEN month(o_orderdate) > 6 THEN '2025' ELSE '2026' END AS dates, 'А-' || o_custkey || ', Б' AS place FROM orders""")
def place_dates(spark, d):
    """Dates inside a place's text, one with its year, and the place without them."""
    o = _t(spark, d, "orders")
    raw = F.concat(F.lit(" А-"), F.col("o_custkey").cast("string"), F.lit(", Б "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit("; "), F.date_format("o_orderdate", "dd.MM"))
    found = o.select("o_orderkey", schedule.dates_in_place(raw, F.lit("2025-2026")).alias("x"))
    return found.select("o_orderkey", F.array_join("x.dates", ",").alias("dates"), "x.place")


@query("""SELECT o_orderkey, CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '.' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || strftime(o_orderdate, '.%Y') END || ',' ||
  CASE WHEN month(o_orderdate) > 6 THEN strftime(o_orderdate, '%d.%m.2025') ELSE strftime(o_orderdate, '%d.%m.2026') END || ',01.09.2025' || ',' || strftime(o_orderdate, '%d.%m.%Y') AS d FROM orders WHERE strftime(o_orderdate, '%d.%m') <> '01.09' AND day(o_orderdate) <> month(o_orderdate) AND year(o_orderdate) NOT IN (2025, 2026)""")
def odd_dates(spark, d):
    """Month before day, two dates glued together, and a year between day and month."""
    o = _t(spark, d, "orders").where("date_format(o_orderdate, 'dd.MM') <> '01.09' and day(o_orderdate) <> month(o_orderdate) and year(o_orderdate) not in (2025, 2026)")
    raw = F.array(F.date_format("o_orderdate", "MM.dd.yyyy"), F.date_format("o_orderdate", "dd.MM.'1.9'"), F.date_format("o_orderdate", "d.yyyy.M"), F.lit("40.13"), F.lit("1.2.3"))
    found = schedule.dates(raw, F.lit("2025–2026"))
    # A day over 12 after its month is turned round, so both spellings are one date there.
    full = F.date_format("o_orderdate", "dd.MM.yyyy")
    return o.select("o_orderkey", F.array_join(F.when(F.dayofmonth("o_orderdate") > 12, F.concat(found, F.array(full))).otherwise(found), ",").alias("d"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.') || CASE WHEN month(o_orderdate) > 6 THEN '2025' ELSE '2026' END || ',by request,01.09.2025,02.09.2025,soon' AS d FROM orders""")
def explicit_dates(spark, d):
    """Dates set by hand: two of them glued together, and words that are none, which stay."""
    o = _t(spark, d, "orders")
    raw = F.array(F.concat(F.date_format("o_orderdate", "d.M"), F.lit("; by request,")), F.lit("01.09.02.09"), F.lit(None).cast("string"), F.lit(" soon.\n"))
    return o.select("o_orderkey", F.array_join(schedule.explicit_dates(raw, F.lit("2025-2026")), ",").alias("d"))
