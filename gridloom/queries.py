"""Named queries of the grid operators over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import intervals as iv
from gridloom.functions import schedule, text
from gridloom.functions.patterns import CellType, StringPattern
from gridloom.operators import classify, export, grid, reports
from gridloom.operators.arrays import indexed_items
from gridloom.plans.constraints import Algebra, Location, Size, relation_test
from gridloom.plans.engine import Matched, run
from gridloom.plans.grammar import read_grammar
from gridloom.plans.ranges import Span
from gridloom.sources.grids import as_cells, table_cells, text_cells
from gridloom.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DAY0 = "2024-01-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key over as many tasks as a shuffle has: few tasks read a small file, however long each row takes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def events(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a grid: a row a day, the day's events side by side, their types as contents."""
    e = _t(spark, d, "events")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("doc_id"), F.datediff(F.to_date("ts"), F.lit(DAY0).cast("date")).alias("y"), (F.row_number().over(w) - 1).alias("x"), F.col("event_type").alias("content"))
    return as_cells(rows)


EV = """ev AS (SELECT user_id AS doc_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS INT) AS y,
  CAST(row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS INT) AS x, event_type AS content FROM events)"""

_plain = lambda p, c=1.0: {"pattern": p, "pattern_syntax": "plain", "confidence": c}
TYPES = [{n: {"patterns": [_plain(n)]}} for n in ("click", "view", "error", "purchase", "signup")]
CELLS = {n: {"kind": "cell", "content_type": n, "extends": ["act"] if n in ("click", "view") else []} for n in ("click", "view", "error", "purchase", "signup")} | {"act": {"kind": "general"}}


def matched(spark: SparkSession, d: str, patterns: dict, stage: bool = False) -> Matched:
    """The events' grids matched by the cell patterns of event types and others.

    Areas read the cells and themselves many times over, so they are always staged.
    """
    stage = stage or any(p["kind"] == "area" for p in patterns.values())
    return run(read_grammar({"cell_types": TYPES, "patterns": CELLS | patterns}), events(spark, d), everything=True, stage=stage)


def _boxes(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "l", "t", "r", "b", F.round("precision", 6).alias("precision"))


# Scans


@query("""SELECT doc_id, CAST(y - 1 AS INT) AS y, CAST(x - 1 AS INT) AS x, content FROM (
  SELECT doc_id, y, unnest(string_split(line, ' ')) AS content, generate_subscripts(string_split(line, ' '), 1) AS x FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line,
           generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS y FROM documents)) WHERE content <> ''""")
def scan_text_grid(spark, d):
    return text_cells(_t(spark, d, "documents"), "doc_id", "text", " ").select("doc_id", "y", "x", "content")


@query("""SELECT doc_id, 0 AS y, CAST(x - 1 AS INT) AS x, content FROM (SELECT n_nationkey AS doc_id, unnest(string_split(n_name, '')) AS content,
  generate_subscripts(string_split(n_name, ''), 1) AS x FROM nation)""")
def scan_char_grid(spark, d):
    return text_cells(_t(spark, d, "nation"), "n_nationkey", "n_name", "").select("doc_id", "y", "x", "content")


@query("""WITH o AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS y FROM part)
SELECT p_brand AS doc_id, y, 0 AS x, p_name AS content FROM o UNION ALL SELECT p_brand, y, 1, p_type FROM o UNION ALL SELECT p_brand, y, 2, CAST(p_size AS VARCHAR) FROM o""")
def table_to_grid(spark, d):
    return table_cells(_t(spark, d, "part"), "p_brand", ["p_partkey"], ["p_name", "p_type", "p_size"]).select("doc_id", "y", "x", "content")


@query("SELECT DISTINCT trim(p_type) AS content FROM part WHERE trim(p_type) <> ''")
def unique_values(spark, d):
    return grid.unique_values(table_cells(_t(spark, d, "part"), "p_brand", ["p_partkey"], ["p_type"]))


# Grids


@query(f"WITH {EV} SELECT doc_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM ev GROUP BY doc_id")
def grid_bounding_box(spark, d):
    return grid.bounding_boxes(events(spark, d))


@query(f"WITH {EV} SELECT doc_id, x, y, content FROM ev WHERE x < 3 AND y >= 2 AND y < 9")
def grid_region_view(spark, d):
    return grid.view(events(spark, d), 0, 2, 3, 9).select("doc_id", "x", "y", "content")


@query(f"WITH {EV}, bb AS (SELECT doc_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM ev GROUP BY doc_id) SELECT doc_id, greatest(l, 1) AS l, greatest(t, 5) AS t, least(r, 3) AS r, least(b, 40) AS b FROM bb WHERE greatest(l, 1) < least(r, 3) AND greatest(t, 5) < least(b, 40)")
def grid_clipped_regions(spark, d):
    return grid.clipped_regions(events(spark, d), 1, 5, 3, 40)


@query(f"WITH {EV} SELECT doc_id, content FROM ev WHERE x = 1 AND y = 7")
def grid_cell_at(spark, d):
    return grid.cell_at(events(spark, d), 1, 7).select("doc_id", "content")


@query(f"WITH {EV} SELECT doc_id, x, y, content FROM ev WHERE x >= 2 AND x < 4 AND y >= 3 AND y < 6")
def grid_look_outside(spark, d):
    return grid.look_outside(events(spark, d), "right", 0, 3, 2, 6, 2).select("doc_id", "x", "y", "content")


@query(f"WITH {EV} SELECT doc_id, x, y, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x DESC) AS INT) AS pos FROM ev")
def grid_iterate_left_up(spark, d):
    return grid.ordered(events(spark, d), "left", "up").select("doc_id", "x", "y", "pos")


@query(f"WITH {EV} SELECT doc_id, x, y FROM ev WHERE content = 'error' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY y, x) = 1")
def grid_find_first(spark, d):
    return grid.find_cell(events(spark, d), F.col("content") == "error").select("doc_id", "x", "y")


@query("SELECT n_nationkey AS doc_id, CAST(x AS INT) AS px, CAST(y AS INT) AS py FROM nation, range(n_regionkey, n_regionkey + 3) tx(x), range(n_nationkey, n_nationkey + 2) ty(y)")
def box_points(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_regionkey").alias("l"), F.col("n_nationkey").alias("t"), (F.col("n_regionkey") + 3).alias("r"), (F.col("n_nationkey") + 2).alias("b"))
    return grid.points(n).select("doc_id", "px", "py")


# Strings


def _texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s{2,}', ' ', 'g')) AS h FROM documents")
def preprocess_shrink(spark, d):
    return _texts(spark, d).select("doc_id", F.md5(text.preprocessed(F.col("text")).cast("binary")).alias("h"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS s FROM part")
def preprocess_remove_spaces(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.remove_all_spaces(F.col("p_name")).alias("s"))


@query("SELECT p_partkey, regexp_replace(p_name || ' - ' || p_type, '\\s*-\\s*', '-', 'g') AS s FROM part")
def preprocess_hyphen(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.remove_spaces_around_hypen(F.concat_ws(" - ", "p_name", "p_type")).alias("s"))


@query("SELECT n_nationkey, n_name AS s FROM nation")
def preprocess_sparse(spark, d):
    n = _t(spark, d, "nation")
    spaced = F.array_join(F.transform(F.split("n_name", " "), lambda w: F.array_join(F.split(w, ""), " ")), "   ")
    return n.select("n_nationkey", F.trim(text.fix_sparse_words(F.regexp_replace(spaced, " +$", ""))).alias("s"))


@query("SELECT regexp_replace(regexp_replace(regexp_replace(p_brand || ' ' || p_type, '[0-9]', '#', 'g'), '[A-Z]', 'W', 'g'), '[a-z]', 'w', 'g') AS shape, count(*) AS n FROM part GROUP BY 1")
def mask_histogram(spark, d):
    return _t(spark, d, "part").groupBy(text.mask(F.concat_ws(" ", "p_brand", "p_type")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


# Classification

WORD_TYPES = [
    CellType("short", [StringPattern("[a-z]{1,3}", 0.6, anchors="both")]),
    CellType("word", [StringPattern("[a-z]+", 0.8), StringPattern("[A-Z][a-z]+", 0.7)]),
    CellType("number", [StringPattern("[0-9]{2}", 0.9, anchors="both")]),
    CellType("ending", [StringPattern("[a-z]{2}", 0.5, anchors="end")]),
    CellType("first", [StringPattern("[a-z]", 0.51)]),
    CellType("pair", [StringPattern("[a-z]{2}", 0.49)]),
    CellType("last", [StringPattern("[a-z]", 0.48, anchors="end")]),
    CellType("any", [StringPattern("[A-Za-z].*", 0.35)]),
]
WORDS = "(SELECT DISTINCT unnest(string_split(p_name || ' ' || p_type || ' ' || p_size, ' ')) AS content FROM part)"


def _words(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")), " ")).alias("content")).distinct().select(F.lit(1).alias("doc_id"), F.xxhash64("content").alias("cell_id"), "content")


CLASSIFIED = f"""m AS (SELECT content, cell_type, precision, ord FROM (SELECT content, unnest([
  {{'cell_type': 'short', 'ord': 0, 'precision': CASE WHEN regexp_full_match(content, '[a-z]{{1,3}}') THEN 0.6 END}},
  {{'cell_type': 'word', 'ord': 1, 'precision': CASE WHEN regexp_matches(content, '^[a-z]+') THEN 0.8 * length(regexp_extract(content, '^[a-z]+')) / length(content) WHEN regexp_matches(content, '^[A-Z][a-z]+') THEN 0.7 * length(regexp_extract(content, '^[A-Z][a-z]+')) / length(content) END}},
  {{'cell_type': 'number', 'ord': 2, 'precision': CASE WHEN regexp_full_match(content, '[0-9]{{2}}') THEN 0.9 END}},
  {{'cell_type': 'ending', 'ord': 3, 'precision': CASE WHEN regexp_matches(content, '[a-z]{{2}}$') THEN 0.5 * 2 / length(content) END}},
  {{'cell_type': 'first', 'ord': 4, 'precision': CASE WHEN regexp_matches(content, '^[a-z]') THEN 0.51 / length(content) END}},
  {{'cell_type': 'pair', 'ord': 5, 'precision': CASE WHEN regexp_matches(content, '^[a-z]{{2}}') THEN 0.49 * 2 / length(content) END}},
  {{'cell_type': 'last', 'ord': 6, 'precision': CASE WHEN regexp_matches(content, '[a-z]$') THEN 0.48 / length(content) END}},
  {{'cell_type': 'any', 'ord': 7, 'precision': CASE WHEN regexp_matches(content, '^[A-Za-z]') THEN 0.35 END}}], recursive := true) FROM {WORDS}) WHERE precision IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY round(precision, 9) DESC, ord) <= 5)"""


@query(f"WITH {CLASSIFIED} SELECT content, cell_type, round(precision, 6) AS precision, CAST(row_number() OVER (PARTITION BY content ORDER BY precision DESC, ord) AS INT) AS rank FROM m")
def classify_cells_top5(spark, d):
    return classify.cell_matches(_words(spark, d), WORD_TYPES).select("content", "cell_type", F.round("precision", 6).alias("precision"), "rank")


@query(f"WITH {CLASSIFIED} SELECT a.cell_type AS a, b.cell_type AS b, count(*) AS n FROM m a JOIN m b ON a.content = b.content AND a.cell_type < b.cell_type WHERE a.precision >= 0.5 AND b.precision >= 0.5 GROUP BY ALL")
def conflict_pairs(spark, d):
    return classify.conflicts(classify.cell_matches(_words(spark, d), WORD_TYPES))


@query(f"WITH {CLASSIFIED}, r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY precision DESC, ord) AS rank FROM m) SELECT cell_type, count(*) AS n, count(*) FILTER (rank = 1) AS best FROM r GROUP BY 1")
def type_statistics(spark, d):
    return classify.type_statistics(classify.cell_matches(_words(spark, d), WORD_TYPES))


@query(f"WITH {CLASSIFIED} SELECT w.content FROM {WORDS} w WHERE w.content NOT IN (SELECT content FROM m)")
def unmatched_cells(spark, d):
    w = _words(spark, d)
    return classify.unmatched(w, classify.cell_matches(w, WORD_TYPES)).select("content")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(year(l_shipdate) AS VARCHAR) AS year, lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0') AS month FROM lineitem")
def extract_captures(spark, d):
    li = _t(spark, d, "lineitem")
    p = StringPattern(r"(?P<year>\d{4})-(?P<month>\d\d)-", 1.0, captures=["year", "month"])
    m = p.match(F.date_format("l_shipdate", "yyyy-MM-dd"), "date", 0)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", m["captures"]["year"].alias("year"), m["captures"]["month"].alias("month"))


# Cell patterns and unions


@query(f"WITH {EV} SELECT doc_id, x AS l, y AS t, x + 1 AS r, y + 1 AS b, 1.0::DOUBLE AS precision FROM ev WHERE content = 'purchase'")
def terminal_match(spark, d):
    return _boxes(matched(spark, d, {}).lookup("purchase"))


@query(f"WITH {EV} SELECT doc_id, content AS pattern, x AS l, y AS t FROM ev WHERE content IN ('click', 'view')")
def general_union(spark, d):
    return matched(spark, d, {}).lookup("act").select("doc_id", "pattern", "l", "t")


@query(f"WITH {EV} SELECT doc_id, x AS l, y AS t FROM ev WHERE content IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE content WHEN 'click' THEN 0 ELSE 1 END, y, x) <= 3")
def match_limit(spark, d):
    return matched(spark, d, {}).first("act", 3).select("doc_id", "l", "t")


# Arrays

ISLANDS = """i AS (SELECT *, {lead} - row_number() OVER (PARTITION BY doc_id, {cross} ORDER BY {lead}) AS island FROM ev WHERE content IN ({types})),
a AS (SELECT doc_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, count(*) AS n FROM i GROUP BY doc_id, {cross}, island),
total AS (SELECT doc_id, count(*) AS total FROM i GROUP BY doc_id)"""


def islands(lead: str, *types: str) -> str:
    return ISLANDS.format(lead=lead, cross="y" if lead == "x" else "x", types=", ".join(f"'{t}'" for t in types))


def _array(**fields) -> dict:
    return {"arr": {"kind": "array", "item_pattern": "act", "direction": "row", "item_count": "2+"} | fields}


@query(f"WITH {EV}, {islands('x', 'click', 'view')} SELECT doc_id, l, t, r, b, round(1 - 0.5 / n, 6) AS precision FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1")
def array_row(spark, d):
    return _boxes(matched(spark, d, _array()).lookup("arr"))


@query(f"WITH {EV}, {islands('y', 'click', 'view')} SELECT doc_id, l, t, r, b, round(1 - 0.5 / n, 6) AS precision FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1")
def array_column(spark, d):
    return _boxes(matched(spark, d, _array(direction="column")).lookup("arr"))


@query(f"""WITH {EV}, rows_ AS (WITH {islands('x', 'click', 'view')} SELECT *, 0 AS way FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
cols AS (WITH {islands('y', 'click', 'view')} SELECT *, 1 AS way FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
both_ AS (SELECT *, count(*) OVER (PARTITION BY doc_id, way) AS many FROM (SELECT * FROM rows_ UNION ALL SELECT * FROM cols))
SELECT doc_id, l, t, r, b, round(1 - 0.5 / n, 6) AS precision FROM both_ QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY many, way) = 1""")
def array_auto(spark, d):
    return _boxes(matched(spark, d, _array(direction="auto")).lookup("arr"))


@query(f"""WITH RECURSIVE {EV}, c AS (SELECT doc_id, x, y, y * 1000 + x AS id FROM ev WHERE content = 'purchase'),
e AS (SELECT p.doc_id, p.id AS a, q.id AS b FROM c p JOIN c q ON p.doc_id = q.doc_id AND greatest(0, abs(p.x - q.x) - 1) + greatest(0, abs(p.y - q.y) - 1) = 0),
r(doc_id, a, b) AS (SELECT doc_id, a, b FROM e UNION SELECT r.doc_id, r.a, e.b FROM r JOIN e ON r.doc_id = e.doc_id AND r.b = e.a),
g AS (SELECT doc_id, a, min(b) AS g FROM r GROUP BY ALL),
total AS (SELECT doc_id, count(*) AS total FROM c GROUP BY doc_id)
SELECT c.doc_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, round(1 - 0.5 / count(*), 6) AS precision
FROM c JOIN g ON c.doc_id = g.doc_id AND c.id = g.a JOIN total ON total.doc_id = c.doc_id WHERE total > 1 GROUP BY c.doc_id, g.g HAVING count(*) >= 2""")
def array_fill(spark, d):
    return _boxes(matched(spark, d, _array(item_pattern="purchase", direction="fill")).lookup("arr"))


@query(f"WITH {EV}, {islands('x', 'click', 'view')} SELECT doc_id, l, t, r, b, round(1 - 0.5 / n, 6) AS precision FROM a JOIN total USING (doc_id) WHERE n BETWEEN 2 AND 3 AND total > 1")
def array_count_filter(spark, d):
    return _boxes(matched(spark, d, _array(item_count="2..3")).lookup("arr"))


@query(f"WITH {EV}, {islands('x', 'click', 'view')} SELECT doc_id, l, t, r, b, round(1 - 0.5 / n, 6) AS precision FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1 AND r - l = 2")
def array_size_filter(spark, d):
    return _boxes(matched(spark, d, _array(size="2 x 1")).lookup("arr"))


@query(f"WITH {EV}, {islands('x', 'click', 'view')} SELECT doc_id, x AS l, y AS t, CAST(row_number() OVER (PARTITION BY doc_id, y, island ORDER BY x) AS INT) AS index_in_array FROM i JOIN total USING (doc_id) WHERE total > 1 QUALIFY count(*) OVER (PARTITION BY doc_id, y, island) >= 2")
def array_index_items(spark, d):
    m = matched(spark, d, _array(index_items=True))
    return indexed_items(m.lookup("arr")).join(m.lookup("act").select("doc_id", "match_id", "l", "t"), ["doc_id", "match_id"]).select("doc_id", "l", "t", "index_in_array")


@query(f"WITH {EV}, {islands('x', 'click', 'view')} SELECT doc_id, n, count(*) AS arrays FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1 GROUP BY ALL")
def array_lengths(spark, d):
    return matched(spark, d, _array()).lookup("arr").groupBy("doc_id", F.size("children").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("arrays"))


# Areas


def _area(inner: dict, outer: dict | None = None, **fields) -> dict:
    return {"area": {"kind": "area", "inner": inner} | ({"outer": outer} if outer else {}) | fields}


PAIR = {"a": {"pattern": "view", "location": "left, top, bottom"}, "b": {"pattern": "click", "location": "right, top, bottom"}}
SPOT = {"spot": {"pattern": "click", "location": "left, right, top, bottom"}}
NEAR = {"other": {"pattern": "purchase", "location": {"left": "0+"}}}
LEFT = "LEFT JOIN (SELECT c.doc_id, c.x, c.y, max(p.x) AS px FROM ev c JOIN ev p ON c.doc_id = p.doc_id AND c.y = p.y AND p.content = 'purchase' AND p.x < c.x WHERE c.content = 'click' GROUP BY ALL) p USING (doc_id, x, y)"


@query(f"WITH {EV} SELECT a.doc_id, a.x AS l, a.y AS t, a.x + 2 AS r, a.y + 1 AS b, 1.0::DOUBLE AS precision FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.y = b.y AND b.x = a.x + 1 WHERE a.content = 'view' AND b.content = 'click'")
def area_inner_join(spark, d):
    return _boxes(matched(spark, d, _area(PAIR, size="2 x 1")).lookup("area"))


@query(f"WITH {EV} SELECT doc_id, x AS l, y AS t, 'purchase#' || CAST(y * 4294967296 + px AS VARCHAR) AS child FROM ev {LEFT} WHERE content = 'click' AND px IS NOT NULL")
def area_outer_nearest(spark, d):
    m = matched(spark, d, _area(SPOT, NEAR)).lookup("area")
    return m.select("doc_id", "l", "t", F.filter("children", lambda c: c["name"] == "other")[0]["child"].alias("child"))


@query(f"WITH {EV} SELECT doc_id, x AS l, y AS t, CASE WHEN px IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS precision FROM ev {LEFT} WHERE content = 'click'")
def area_optional(spark, d):
    return matched(spark, d, _area(SPOT, {"other": NEAR["other"] | {"optional": True}})).lookup("area").select("doc_id", "l", "t", F.round("precision", 6).alias("precision"))


@query(f"WITH {EV} SELECT doc_id, x AS l, y AS t FROM ev {LEFT} WHERE content = 'click' AND px IS NULL")
def area_negative_weight(spark, d):
    return matched(spark, d, _area(SPOT, {"other": NEAR["other"] | {"optional": True, "weight": -10}})).lookup("area").select("doc_id", "l", "t")


@query(f"WITH {EV} SELECT a.doc_id, a.x AS l, a.y AS t FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.y = b.y AND b.x = a.x + 1 WHERE a.content = 'view' AND b.content = 'view'")
def area_symmetric(spark, d):
    return matched(spark, d, _area({"a": {"pattern": "view"}, "b": {"pattern": "view"}}, size="2 x 1", allows_overlapping=True)).lookup("area").select("doc_id", "l", "t")


@query(f"WITH {EV} SELECT a.doc_id, a.x AS l, a.y AS t, round((1.0 + 3 * 1.0) / 4, 6)::DOUBLE AS precision FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.x = b.x AND b.y = a.y + 1 WHERE a.content = 'error' AND b.content = 'signup'")
def area_score(spark, d):
    parts = {"a": {"pattern": "error", "location": "left, right, top"}, "b": {"pattern": "signup", "location": "left, right, bottom", "weight": 3}}
    return matched(spark, d, _area(parts, size="1 x 2", allows_overlapping=True)).lookup("area").select("doc_id", "l", "t", F.round("precision", 6).alias("precision"))


@query(f"WITH {EV}, {islands('x', 'click', 'view')} SELECT doc_id, CAST(l + 2 * k AS INT) AS l, t, CAST(l + 2 * k + 2 AS INT) AS r, b, 1.0::DOUBLE AS precision FROM a, range(0, 1000) tk(k) WHERE l + 2 * k + 2 <= r")
def area_packing(spark, d):
    """Overlapping areas settled by the solver: of a run of cells as many pairs as it holds, as far left as may be."""
    return _boxes(matched(spark, d, _area({"a": {"pattern": "act"}, "b": {"pattern": "act"}}, size="2 x 1")).lookup("area"))


@query(f"""WITH {EV}, {islands('x', 'click', 'view')}, s AS (SELECT doc_id, x, y FROM ev WHERE content = 'signup'),
nx AS (SELECT s.doc_id, s.x, s.y, min(a.l) AS l FROM s JOIN a ON a.doc_id = s.doc_id AND a.t = s.y AND a.l > s.x GROUP BY ALL),
f AS (SELECT doc_id, y, l, min(x) AS x FROM nx GROUP BY ALL),
m AS (SELECT f.doc_id, f.x, f.y, f.l, count(*) AS items FROM f JOIN ev e ON e.doc_id = f.doc_id AND e.y = f.y AND e.x > f.x AND e.content IN ('click', 'view') GROUP BY ALL)
SELECT m.doc_id, m.x AS l, m.y AS t, a.r, m.y + 1 AS b, round((1 + CASE WHEN items = 1 THEN 1 ELSE 1 - 0.5 / a.n END) / 2, 6)::DOUBLE AS precision FROM m JOIN a ON a.doc_id = m.doc_id AND a.t = m.y AND a.l = m.l""")
def array_in_context(spark, d):
    """An array searched in the region that an area's other component leaves: the first run after a head, and of heads with the same run the first."""
    parts = {"head": {"pattern": "signup", "location": "left, top, bottom"}, "rest": {"pattern": "run", "location": "right, top, bottom"}}
    run_ = {"run": {"kind": "array-in-context", "item_pattern": "act", "direction": "row", "item_count": "1+"}}
    return _boxes(matched(spark, d, run_ | _area(parts, size="2+ x 1")).lookup("area"))


@query()
def array_breakdown(spark, d):
    """Connected groups broken down to at most four cells; tests compare it with known grids."""
    return _boxes(matched(spark, d, _array(direction="fill", item_count="2..4", allow_breakdown=True)).lookup("arr"))


# Overlaps, counts, reports


@query(f"""WITH {EV}, r AS (WITH {islands('x', 'click', 'view')} SELECT * FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
c AS (WITH {islands('y', 'click', 'view')} SELECT * FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
s AS (SELECT doc_id, x AS l, y AS t, x + 1 AS r, y + 1 AS b FROM ev WHERE content = 'view'),
u AS (SELECT doc_id, l, t, r, b FROM r UNION ALL SELECT doc_id, l, t, r, b FROM c UNION ALL SELECT * FROM s)
SELECT doc_id, l, t, r, b FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.doc_id = u.doc_id AND o.l = u.l AND o.t = u.t AND o.r >= u.r AND o.b >= u.b AND (o.r - o.l) * (o.b - o.t) > (u.r - u.l) * (u.b - u.t))""")
def overlap_full(spark, d):
    arrays = {n: {"kind": "array", "item_pattern": "act", "direction": n, "item_count": "2+", "extends": ["any"]} for n in ("row", "column")}
    lone = {"lone": {"kind": "area", "inner": {"v": {"pattern": "view", "location": "left, right, top, bottom"}}, "extends": ["any"]}}
    return matched(spark, d, arrays | lone | {"any": {"kind": "general", "overlap": {"mode": "full", "resolution": ["area-max"]}}}, stage=True).lookup("any").select("doc_id", "l", "t", "r", "b")


@query(f"""WITH {EV}, r AS (WITH {islands('x', 'click', 'view')} SELECT * FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
c AS (WITH {islands('y', 'click', 'view')} SELECT * FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
u AS (SELECT doc_id, l, t, r, b, n, 0 AS way FROM r UNION ALL SELECT doc_id, l, t, r, b, n, 1 FROM c)
SELECT doc_id, l, t, r, b FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.doc_id = u.doc_id AND o.way <> u.way AND o.n > u.n
  AND ((o.l = u.l AND o.t = u.t) OR (o.r = u.r AND o.t = u.t) OR (o.r = u.r AND o.b = u.b) OR (o.l = u.l AND o.b = u.b)))""")
def overlap_partial(spark, d):
    # A row and a column that share an end cell share a corner, and neither lies in the other.
    arrays = {n: {"kind": "array", "item_pattern": "act", "direction": n, "item_count": "2+", "extends": ["any"]} for n in ("row", "column")}
    return matched(spark, d, arrays | {"any": {"kind": "general", "overlap": {"mode": "partial", "resolution": ["area-max"]}}}, stage=True).lookup("any").select("doc_id", "l", "t", "r", "b")


@query(f"""WITH {EV}, n AS (SELECT doc_id, count(*) AS n FROM ev WHERE content = 'signup' GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'PATTERN_COUNT_MISMATCH' AS code, CAST(n AS VARCHAR) AS actual FROM n WHERE n > 12
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'MATCH_LIMIT_APPLIED', CAST(n AS VARCHAR) FROM n WHERE n > 12""")
def count_in_document_check(spark, d):
    spot = {"pattern": "signup", "location": "left, right, top, bottom"}
    m = matched(spark, d, {"one": {"kind": "area", "count_in_document": "12-", "inner": {"s": spot}}})
    return m.issues().select("doc_id", "code", "actual")


@query(f"WITH {EV}, n AS (SELECT doc_id, count(*) AS n FROM ev WHERE content = 'signup' GROUP BY doc_id) SELECT count(*) FILTER (n > 12) * 2 AS warnings, 0::BIGINT AS errors FROM n")
def severity_counts(spark, d):
    spot = {"pattern": "signup", "location": "left, right, top, bottom"}
    m = matched(spark, d, {"one": {"kind": "area", "count_in_document": "12-", "inner": {"s": spot}}})
    return m.issues().agg(F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors"))


@query(f"WITH {EV} SELECT a.doc_id, a.x AS l, a.y AS t FROM ev a WHERE a.content = 'view' AND NOT EXISTS (SELECT 1 FROM ev b WHERE a.doc_id = b.doc_id AND a.y = b.y AND b.x = a.x + 1 AND b.content = 'click')")
def unused_matches(spark, d):
    m = matched(spark, d, _area(PAIR, size="2 x 1"), stage=True)
    return reports.unused(staged(m.all(), "all"), m.lookup("area"), 1, ["view"]).select("doc_id", "l", "t")


@query(f"""WITH {EV}, r AS (WITH {islands('x', 'click', 'view')} SELECT * FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
c AS (WITH {islands('y', 'click', 'view')} SELECT * FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1),
u AS (SELECT doc_id, l, t, r, b, n FROM r UNION ALL SELECT doc_id, l, t, r, b, n FROM c)
SELECT ev.doc_id, x AS px, y AS py, round(max(1 - 0.5 / n), 6)::DOUBLE AS precision FROM ev JOIN u ON ev.doc_id = u.doc_id AND x >= l AND x < r AND y >= t AND y < b GROUP BY ALL""")
def best_match_per_cell(spark, d):
    arrays = {n: {"kind": "array", "item_pattern": "act", "direction": n, "item_count": "2+", "extends": ["any"]} for n in ("row", "column")}
    return reports.best_per_cell(matched(spark, d, arrays | {"any": {"kind": "general"}}).lookup("any")).select("doc_id", "px", "py", F.round("precision", 6).alias("precision"))


@query(f"WITH {EV}, {islands('x', 'click', 'view')} SELECT doc_id, l, t, 'arr: ' || (r - l) || 'x1, ' || printf('%.2f', 1 - 0.5 / n) AS note FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1")
def annotate_positions(spark, d):
    m = matched(spark, d, _array()).lookup("arr")
    return reports.annotations(m)


@query(f"WITH {EV}, {islands('x', 'click', 'view')}, w AS (SELECT doc_id, count(*) AS n FROM a JOIN total USING (doc_id) WHERE n >= 2 AND total > 1 GROUP BY 1) SELECT doc_id, 'arr' AS pattern, n FROM w UNION ALL SELECT doc_id, content, count(*) FROM ev GROUP BY ALL")
def wave_counts(spark, d):
    return reports.counts(matched(spark, d, _array()).all()).select("doc_id", "pattern", "n")


# Intervals and boxes


def _pairs(spark, d):
    a, b = (_t(spark, d, "part").select(F.col("p_partkey").alias(f"{n}k"), iv.box(F.col("p_partkey") % 7, F.col("p_size") % 5, F.col("p_partkey") % 7 + F.col("p_size") % 4 + 1, F.col("p_size") % 5 + F.col("p_partkey") % 3 + 1).alias(n)) for n in "pq")
    return a.join(b, F.col("qk") == F.col("pk") + 1)


PAIRS = """x AS (SELECT p_partkey AS k, p_partkey % 7 AS l, p_size % 5 AS t, p_partkey % 7 + p_size % 4 + 1 AS r, p_size % 5 + p_partkey % 3 + 1 AS b FROM part),
pq AS (SELECT p.k AS pk, p.l AS pl, p.t AS pt, p.r AS pr, p.b AS pb, q.l AS ql, q.t AS qt, q.r AS qr, q.b AS qb,
  (q.l >= p.l AND q.t >= p.t AND q.r <= p.r AND q.b <= p.b) OR (p.l >= q.l AND p.t >= q.t AND p.r <= q.r AND p.b <= q.b) AS nest,
  greatest(0, p.l - q.r, q.l - p.r) AS gx, greatest(0, p.t - q.b, q.t - p.b) AS gy FROM x p JOIN x q ON q.k = p.k + 1)"""


@query(f"""WITH {PAIRS} SELECT pk, gx + gy AS touch, CASE WHEN nest THEN 0 ELSE least(abs(pl - ql) + abs(pt - qt), abs(pr - qr) + abs(pt - qt), abs(pr - qr) + abs(pb - qb), abs(pl - ql) + abs(pb - qb)) END AS overlap,
CASE WHEN nest THEN 0 ELSE least(gx + least(pb - pt, qb - qt) + CASE WHEN gy > 0 THEN gy ELSE -greatest(0, least(pb, qb) - greatest(pt, qt)) END,
  gy + least(pr - pl, qr - ql) + CASE WHEN gx > 0 THEN gx ELSE -greatest(0, least(pr, qr) - greatest(pl, ql)) END) END AS contact FROM pq""")
def box_distances(spark, d):
    p, q = F.col("p"), F.col("q")
    return _pairs(spark, d).select("pk", iv.distance_to_touch(p, q).alias("touch"), iv.distance_to_overlap(p, q).alias("overlap"), iv.distance_to_contact(p, q).alias("contact"))


@query(f"WITH {PAIRS} SELECT pk, pl < qr AND ql < pr AND pt < qb AND qt < pb AS over, greatest(pl, ql) AS l, least(pr, qr) AS r, (greatest(pr, qr) - least(pl, ql)) * (greatest(pb, qb) - least(pt, qt)) AS area FROM pq WHERE greatest(pl, ql) <= least(pr, qr) AND greatest(pt, qt) <= least(pb, qb)")
def box_overlaps(spark, d):
    p, q = F.col("p"), F.col("q")
    both = _pairs(spark, d).select("pk", iv.overlaps(p, q).alias("over"), iv.box_intersect(p, q).alias("i"), iv.box_area(iv.box_union(p, q)).alias("area"))
    return both.where("i is not null").select("pk", "over", "i.l", "i.r", "area")


@query(f"""WITH {PAIRS} SELECT CASE WHEN pl = ql AND pr = qr THEN 'equal' WHEN pr < ql THEN 'before' WHEN pl > qr THEN 'after' WHEN pr = ql THEN 'touches_before' WHEN pl = qr THEN 'touches_after'
WHEN pl = ql AND pr < qr THEN 'starts' WHEN pl = ql THEN 'started_by' WHEN pr = qr AND pl > ql THEN 'finishes' WHEN pr = qr THEN 'finished_by' WHEN pl > ql AND pr < qr THEN 'inside' WHEN pl < ql AND pr > qr THEN 'covers'
WHEN pl < ql THEN 'overlaps_before' ELSE 'overlaps_after' END AS kind, count(*) AS n FROM pq GROUP BY 1""")
def segment_relations(spark, d):
    return _pairs(spark, d).groupBy(iv.relation(F.col("p.l"), F.col("p.r"), F.col("q.l"), F.col("q.r")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, least(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END, 30) AS stop, CASE WHEN p_size % 3 = 0 THEN true ELSE p_size >= 12 END AS ok, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 5 END AS sum_stop FROM part")
def interval_algebra(spark, d):
    p = iv.Pair(F.lit(0), F.when(F.col("p_size") % 3 != 0, F.col("p_size")))
    return _t(spark, d, "part").select("p_partkey", iv.intersect(p, iv.lit_pair(Span(None, 30))).stop.alias("stop"), iv.contains(p, F.lit(12)).alias("ok"), iv.plus(p, iv.lit_pair(Span(1, 5))).stop.alias("sum_stop"))


@query(f"WITH {PAIRS} SELECT count(*) AS n FROM pq WHERE pl - ql BETWEEN -2 AND 1 AND pr - pl BETWEEN 1 AND 3 AND pb - pt >= 2")
def constraint_filter(spark, d):
    rows = _pairs(spark, d).where(Location({"left": Span(-1, 2)}).holds(F.col("q"), F.col("p")) & Size.parse("1..3 x 2+").holds(F.col("p")))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS} SELECT pk FROM pq WHERE pl <= ql AND ql < pr AND NOT (abs(pt - qt) > 2 OR greatest(pb, qb) = 4)")
def algebra_filter(spark, d):
    test = Algebra("p_l <= q_left < p_r and not (abs(p_t - q_t) > 2 or max(p_b, q_b) == 4)")
    return _pairs(spark, d).where(test.over_boxes({"p": F.col("p"), "q": F.col("q")})).select("pk")


@query(f"WITH {PAIRS} SELECT pk FROM pq WHERE ql - pl BETWEEN 1 AND 3")
def arithmetic_relation(spark, d):
    return _pairs(spark, d).where(relation_test("<1..3<")(F.col("p.l"), F.col("q.l"))).select("pk")


# Timetable functions


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.') || CASE WHEN month(o_orderdate) > 6 THEN '2025' ELSE '2026' END AS d FROM orders""")
def normalise_dates(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.array_join(schedule.dates(F.array(F.date_format("o_orderdate", "d.M"), F.date_format("o_orderdate", "dd.MM;")), F.lit("2025-2026")), ",").alias("d"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size || '-' || (p_size + 1) || ',' || (p_size + 2) || '-' || (p_size + 3)) ELSE (p_size || '-' || (p_size + 2)) END AS h FROM part")
def hour_ranges(spark, d):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + 3).cast("string"), F.lit(" час."))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" до "), (F.col("p_size") + 2).cast("string")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(schedule.hour_ranges(F.array(raw)), ",").alias("h"))


@query("SELECT p_partkey, p_name || CASE WHEN upper(replace(p_name, ' ', '')) = upper(replace(p_type, ' ', '')) THEN '' ELSE '|' || p_type END AS s FROM part")
def distinct_places(spark, d):
    places = F.array("p_name", F.upper("p_name"), "p_type", F.concat(F.lit(" "), F.col("p_type")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(schedule.distinct_places(places), "|").alias("s"))


@query("SELECT n_nationkey, 'ФЭВТ 2025-2026 1 семестр ' || n_name || ' бакалавриат' AS s FROM nation")
def normalise_title(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", schedule.title(F.concat(F.lit(" ФЭВТ  2024 - 2025 2 семестр "), F.col("n_name")), F.lit("бакалавриат")).alias("s"))


@query("SELECT n_nationkey, CAST(n_nationkey % 7 + 1 AS VARCHAR) AS course, 'ХТФ' AS faculty, 'магистратура' AS scope FROM nation")
def schedule_metadata(spark, d):
    path = F.concat(F.lit("/data/Магистратура/ХФ "), (F.col("n_nationkey") % 7 + 1).cast("string"), F.lit(" курс.xlsx"))
    m = schedule.schedule_metadata(path, F.col("n_name"))
    return _t(spark, d, "nation").select("n_nationkey", m["course"].alias("course"), m["department_shortname"].alias("faculty"), m["scope"].alias("scope"))


@query("""WITH d AS (SELECT DISTINCT user_id AS doc_id, date_trunc('day', ts) AS day FROM events),
x AS (SELECT doc_id, day, 1 + week(day) % 2 AS week, isodow(day) - 1 AS wd, strftime(day, '%Y-%m') AS month FROM d),
y AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY month) - 1 AS month_index FROM x)
SELECT doc_id, CASE week WHEN 1 THEN 'first_week' ELSE 'second_week' END AS week, CAST(wd AS INT) AS week_day_index, CAST(month_index AS INT) AS month_index,
  string_agg(CAST(day(day) AS VARCHAR), ',' ORDER BY day) AS days FROM y WHERE wd < 6 GROUP BY ALL""")
def calendar_groups(spark, d):
    day = F.date_trunc("day", "ts")
    days = _t(spark, d, "events").select(F.col("user_id").alias("doc_id"), day.alias("day")).distinct()
    day = F.col("day")
    days = days.select("doc_id", (1 + F.weekofyear(day) % 2).alias("week"), F.coalesce(F.get(F.array(*map(F.lit, export.WEEK_DAYS)), F.weekday(day)), F.lit("?")).alias("week_day"), F.date_format(day, "yyyy-MM").alias("month"), F.dayofmonth(day).cast("string").alias("month_day"), F.unix_date(day.cast("date")).alias("ord"))
    weeks = export.calendar(days).select("doc_id", F.explode("weeks").alias("week", "days")).select("doc_id", "week", F.explode("days").alias("x"))
    return weeks.select("doc_id", "week", "x.week_day_index", F.explode("x.calendar").alias("c")).select("doc_id", "week", "week_day_index", "c.month_index", F.array_join("c.month_days", ",").alias("days"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every user's grid parsed: pairs of a view and the click after it, and runs of both."""
    m = run(read_grammar({"cell_types": TYPES, "patterns": CELLS | _array() | _area(PAIR, size="2 x 1")}), events(spark, d), everything=True)
    return m.all().select("doc_id", "pattern", "l", "t", "r", "b", "precision", "content")


QUERIES["parse_event_grids"] = flagship
SQL["parse_event_grids"] = f"""WITH {EV}, {islands('x', 'click', 'view')}
SELECT doc_id, content AS pattern, x AS l, y AS t, x + 1 AS r, y + 1 AS b, 1.0::DOUBLE AS precision, '"' || content || '"' AS content FROM ev
UNION ALL SELECT a.doc_id, 'arr', l, t, r, b, 1 - 0.5::DOUBLE / n, (SELECT '[' || string_agg('"' || content || '"', ',' ORDER BY x) || ']' FROM i WHERE i.doc_id = a.doc_id AND i.y = a.t AND i.x >= a.l AND i.x < a.r)
  FROM a JOIN total ON a.doc_id = total.doc_id WHERE n >= 2 AND total > 1
UNION ALL SELECT p.doc_id, 'area', p.x, p.y, p.x + 2, p.y + 1, 1.0, '{{"a":"view","b":"click"}}' FROM ev p JOIN ev q ON p.doc_id = q.doc_id AND p.y = q.y AND q.x = p.x + 1 WHERE p.content = 'view' AND q.content = 'click'"""
