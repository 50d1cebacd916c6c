"""Named queries, with SQL, of workbooks, contents, reports and lessons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import export, reports
from gridloom.queries import EV, NEAR, PAIR, SPOT, _area, _array, _dealt, _t, events, islands, matched, query
from gridloom.sources.grids import as_cells, table_cells
from gridloom.sources.workbook import workbooks
from gridloom.sources.xlsx import xlsx_cells
from gridloom.staging import staged

RUNS = f"{EV}, {islands('x', 'click', 'view')}, runs AS (SELECT a.*, (SELECT 1) FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1)"


def _read_back(made):
    return xlsx_cells(made.select(F.col("doc_id").cast("string").alias("path"), "content"))


@query("""WITH o AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS y FROM part)
SELECT p_brand AS doc_id, y, 0 AS x, p_name AS content FROM o UNION ALL SELECT p_brand, y, 1, p_type FROM o UNION ALL SELECT p_brand, y, 2, CAST(p_size AS VARCHAR) FROM o""")
def xlsx_round_trip(spark, d):
    """A table's grids written as workbooks and read again."""
    cells = table_cells(_t(spark, d, "part"), "p_brand", ["p_partkey"], ["p_name", "p_type", "p_size"])
    return _read_back(workbooks(cells)).select("doc_id", "y", "x", "content")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(n_nationkey * 4 AS INT) AS x, 2 AS y, 3 AS w, 2 AS h, n_name || ' <&' AS content, ['F4A6A0', 'A9D8A0', NULL][n_nationkey % 3 + 1] AS colour FROM nation
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), CAST(n_nationkey * 4 AS INT), 9, 1, 1, 'plain', NULL FROM nation""")
def xlsx_merged_styles(spark, d):
    """Merged and single cells, some of them coloured, written and read again."""
    n = _t(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") * 4).cast("int").alias("x"), "n_name", "n_nationkey")
    wide = as_cells(n.select("doc_id", "x", F.lit(2).alias("y"), F.concat("n_name", F.lit(" <&")).alias("content")), w=3, h=2)
    cells = wide.unionByName(as_cells(n.select("doc_id", "x", F.lit(9).alias("y"), F.lit("plain").alias("content"))))
    paint = n.where("n_nationkey % 3 < 2").select("doc_id", "x", F.lit(2).alias("y"), F.when(F.col("n_nationkey") % 3 == 0, "F4A6A0").otherwise("A9D8A0").alias("colour"), F.concat(F.lit("note "), "n_name").alias("note"))
    return _read_back(workbooks(cells, paint)).select("doc_id", "x", "y", "w", "h", "content", F.col("style.background_color").alias("colour"))


@query(f"WITH {EV}, f AS (SELECT doc_id, content AS pattern, min(y * 4294967296 + x) AS o FROM ev GROUP BY ALL) SELECT doc_id, pattern, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY o, pattern) - 1) % 11 AS INT) AS colour FROM f")
def pattern_colours(spark, d):
    return reports.colours(matched(spark, d, {}).all())


@query(f"WITH {RUNS} SELECT doc_id, l, t, n, r - l AS width, l AS first FROM runs")
def match_components(spark, d):
    """A match as JSON: its box, the number of its components and the first one's place."""
    m = matched(spark, d, _array(), stage=True)
    every = staged(m.all(), "all")
    j = reports.serialised(every).join(every.where("pattern = 'arr'").select("doc_id", "match_id", "l", "t"), ["doc_id", "match_id"])
    at = lambda p, n: F.get_json_object("json", p).cast("long").alias(n)
    return j.select("doc_id", "l", "t", at("$.component_count", "n"), at("$.box.width", "width"), at("$.components[0].box.left", "first"))


@query(f"WITH {RUNS} SELECT doc_id, l, t, n, 'click,view' AS kinds FROM runs WHERE (SELECT count(DISTINCT content) FROM i WHERE i.doc_id = runs.doc_id AND i.y = runs.t AND i.x >= runs.l AND i.x < runs.r) = 2")
def match_trees(spark, d):
    """The nested JSON of arrays of two kinds of items."""
    m = matched(spark, d, _array(), stage=True)
    j = reports.trees(staged(m.all(), "all"), m.lookup("arr"), 1)
    j = j.withColumn("x", F.from_json("json", "box struct<left:int,top:int>, components array<struct<name:string,match:struct<pattern:string,components:array<string>>>>"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("x.components.match.pattern"))), ",")
    return j.select("doc_id", F.col("x.box.left").alias("l"), F.col("x.box.top").alias("t"), F.size("x.components").cast("long").alias("n"), kinds.alias("kinds")).where("kinds = 'click,view'")


@query(f"WITH {EV} SELECT doc_id, 0 AS wave, count(*) AS total, count(*) FILTER (content = 'click') AS clicks FROM ev GROUP BY doc_id")
def wave_summaries(spark, d):
    """The first wave's report of each document: all its matches, and those of one pattern."""
    m = matched(spark, d, {}, stage=True)
    every = staged(m.all(), "all")
    j = reports.summaries(every, every, "doc_id", "wave").where("wave = 0")
    listed = F.size(F.from_json(F.get_json_object("json", "$.matches"), "array<string>")).cast("long")
    return j.select("doc_id", "wave", listed.alias("total"), F.coalesce(F.get_json_object("json", "$.pattern_counts.click").cast("long"), F.lit(0).cast("long")).alias("clicks"))


@query(f"WITH {RUNS} SELECT doc_id, l, t, r - l AS width, (SELECT string_agg(content, ',' ORDER BY x) FROM i WHERE i.doc_id = runs.doc_id AND i.y = runs.t AND i.x >= runs.l AND i.x < runs.r) AS items FROM runs")
def positioned_content(spark, d):
    """Contents with their boxes: an array's items beside its own."""
    m = reports.positioned(matched(spark, d, _array()).lookup("arr"), {"arr": "array"})
    x = m.withColumn("x", F.from_json("content", "`@box` struct<left:int,top:int,width:int>, `@items` array<string>"))
    return x.select("doc_id", F.col("x.`@box`.left").alias("l"), F.col("x.`@box`.top").alias("t"), F.col("x.`@box`.width").alias("width"), F.array_join("x.`@items`", ",").alias("items"))


@query(f"""WITH {RUNS} SELECT doc_id, l, t, 'k' AS fixed, (SELECT string_agg((x - l + 1) || '=' || content, ',' ORDER BY x) FROM i WHERE i.doc_id = runs.doc_id AND i.y = runs.t AND i.x >= runs.l AND i.x < runs.r) AS items FROM runs""")
def static_content(spark, d):
    """Static data beside an array's content, and its items numbered."""
    m = matched(spark, d, _array(static_data={"fixed": "k"}, index_items=True)).lookup("arr")
    x = m.withColumn("x", F.from_json("content", "fixed string, `@content` array<struct<`@index_in_array`:int,`@content`:string>>"))
    items = F.transform("x.`@content`", lambda i: F.concat_ws("=", i["@index_in_array"].cast("string"), i["@content"]))
    return x.select("doc_id", "l", "t", "x.fixed", F.array_join(items, ",").alias("items"))


@query(f"WITH {EV} SELECT c.doc_id, c.x AS l, c.y AS t FROM ev c JOIN ev p ON c.doc_id = p.doc_id AND c.y = p.y AND p.x = c.x - 1 WHERE c.content = 'click' AND p.content = 'error'")
def area_outer_adjacent(spark, d):
    """An outer component that lies right beside the area."""
    m = matched(spark, d, _area(SPOT, {"other": {"pattern": "error", "location": {"left": 0}}}))
    return m.lookup("area").select("doc_id", "l", "t")


@query(f"WITH {EV} SELECT c.doc_id, c.x AS l, c.y AS t FROM ev c WHERE c.content = 'click' AND EXISTS (SELECT 1 FROM ev p WHERE c.doc_id = p.doc_id AND c.y = p.y AND p.content = 'error' AND c.x - p.x - 1 BETWEEN 1 AND 2)")
def area_outer_margin(spark, d):
    """An outer component one or two cells away."""
    m = matched(spark, d, _area(SPOT, {"other": {"pattern": "error", "location": {"left": "1..2"}}}))
    return m.lookup("area").select("doc_id", "l", "t")


_LEFT = "EXISTS (SELECT 1 FROM ev p WHERE p.doc_id = c.doc_id AND p.y = c.y AND p.x < c.x AND p.content = 'purchase')"


@query(f"WITH {EV} SELECT doc_id, x AS l, y AS t, 0.5::DOUBLE AS strict, CASE WHEN {_LEFT} THEN 0.75 ELSE 0.5 END::DOUBLE AS lax FROM ev c WHERE content = 'click'")
def component_threshold(spark, d):
    """A component whose matches are less sure than it asks for is as good as absent."""
    weak = {"weak": {"kind": "cell", "content_type": "purchase", "confidence": 0.5}}
    both = []
    for name, least in (("strict", 0.6), ("lax", 0.4)):
        m = matched(spark, d, weak | _area(SPOT, {"other": {"pattern": "weak", "location": NEAR["other"]["location"], "optional": True, "precision_threshold": least}}))
        both.append(m.lookup("area").select("doc_id", "l", "t", F.round("precision", 6).alias(name)))
    return both[0].join(both[1], ["doc_id", "l", "t"])


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS doc_id, 'OVERLAP_RESOLUTION_UNEXPECTED_MODE' AS code, 'act2' AS pattern_name, 'some' AS actual FROM events")
def overlap_mode_issue(spark, d):
    """A mode of overlaps that nobody knows is a warning in each document."""
    m = matched(spark, d, {"act2": {"kind": "general", "overlap": {"mode": "some"}}})
    return m.issues().select("doc_id", "code", "pattern_name", "actual")


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN n < 9 THEN 1 ELSE 0 END AS warnings, 0 AS errors, CASE WHEN n < 9 THEN CAST(n AS VARCHAR) END AS actual FROM n""")
def diagnostics_json(spark, d):
    """Each document's diagnostics, of those without issues or matches too; a pattern that stands there too seldom is one."""
    spot = {"pattern": "signup", "location": "left, right, top, bottom"}
    m = matched(spark, d, {"one": {"kind": "area", "count_in_document": "9+", "inner": {"s": spot}}})
    j = reports.diagnostics(m.issues(), events(spark, d))
    at = lambda p: F.get_json_object("json", p)
    return j.select("doc_id", at("$.summary.warnings").cast("int").alias("warnings"), at("$.summary.errors").cast("int").alias("errors"), at("$.issues[0].actual").alias("actual"))


@query(f"WITH {EV} SELECT a.doc_id, a.x AS l, a.y AS t, '{{\"a\":\"view\",\"b\":\"click\"}}' AS content FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.y = b.y AND b.x = a.x + 1 WHERE a.content = 'view' AND b.content = 'click'")
def area_content(spark, d):
    """An area's content by the names of its components, in the order of search."""
    return matched(spark, d, _area(PAIR, size="2 x 1")).lookup("area").select("doc_id", "l", "t", "content")


@query("""SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_type || ' II' ELSE p_name || ' ' || p_type || ' end' END AS subject,
  CASE p_size % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a,b,c' WHEN 2 THEN 'x,y' ELSE 'a,c' END AS groups,
  'лекция' AS kind, p_brand || ' A.' AS teachers, 'R-' || p_size AS places, '1-2' AS hours, CAST(p_size % 6 AS INT) AS day, CASE WHEN p_partkey % 20 >= 10 THEN 'second_week' ELSE 'first_week' END AS week, '06.11.2025,07.03.2026' AS dates FROM part""")
def lessons(spark, d):
    """Lessons from contents in which names and groups lie in all the usual ways."""
    s = F.col("p_size") % 4
    js = lambda **f: F.to_json(F.struct(*[v.alias(k) for k, v in f.items()]))
    name, kind = F.col("p_name"), F.col("p_type")
    one = lambda c: F.struct(c.alias("group"))
    plain = js(discipline=name, group=one(F.lit("b")))
    listed = js(discipline=F.array(F.struct(name.alias("discipline")), F.struct(kind.alias("discipline"))), first_group=one(F.lit("a")), last_group=one(F.lit("c")))
    named = js(discipline_name=F.struct(F.array(kind, F.lit("II")).alias("discipline")), groups=F.array(F.lit("x"), F.lit("y"), F.lit("x")))
    nested = F.concat(F.lit('{"m2":{"discipline":['), js(discipline=kind), F.lit(',{"m1":{"discipline_name":" end "}}],"group":{"group":"a"}},"m1":'), js(discipline=name, groups=F.array(F.lit("c"))), F.lit("}"))
    discipline = F.when(s == 0, plain).when(s == 1, listed).when(s == 2, named).otherwise(nested)
    day = F.get(F.array(*map(F.lit, export.WEEK_DAYS)), (F.col("p_size") % 6).cast("int"))
    frame = F.concat(F.lit('{"discipline":'), discipline, F.lit(',"hour_begin":'), js(hour_range=F.lit("1-2"), week_day=day), F.lit(',"teacher":'), F.expr("to_json(array(p_brand || '  A.. ;'))"), F.lit(',"room":'), F.expr("to_json(array('R--' || p_size))"), F.lit("}"))
    content = F.concat(F.lit('{"frame":'), frame, F.lit(',"explicit_dates":"6.11, 07.03.2026","lesson_kind":"лекц."}'))
    rows = _dealt(_t(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), content.alias("content"), (F.col("p_partkey") % 20).cast("int").alias("t"), (F.col("p_partkey") % 20 + 4).cast("int").alias("b"), F.array(*map(F.lit, "abc")).alias("known_groups"), F.lit(10).alias("week1_bottom"), F.lit("2025-2026").alias("years"))
    x = export.lessons(rows)
    text = lambda c, n: F.array_join(F.col(f"lesson.{c}"), ",").alias(n)
    return x.select(F.col("doc_id").alias("k"), "lesson.subject", text("participants.student_groups", "groups"), "lesson.kind", text("participants.teachers", "teachers"), text("places", "places"), text("hours", "hours"), F.col("lesson.week_day_index").cast("int").alias("day"), "lesson.week", text("holds_on_date", "dates"))
