"""Timetable export: lessons from the contents of matched lesson areas, and one JSON document for each timetable.

Contents are JSON texts as the matcher makes them. A value may be a text, a list, or an object that holds
the text under a known name; lists of either are read item by item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import schedule

#: Weekdays in the order of their index, and the names of weeks by their number.
WEEK_DAYS = ["ПОНЕДЕЛЬНИК", "ВТОРНИК", "СРЕДА", "ЧЕТВЕРГ", "ПЯТНИЦА", "СУББОТА"]
WEEKS = {1: "first_week", 2: "second_week"}


def _none() -> Column:
    return F.array().cast("array<string>")


def at(content: Column, *paths: str) -> Column:
    """The first of the paths that a JSON text has: a text as it is, anything else as JSON."""
    return F.coalesce(*[F.get_json_object(content, f"$.{p}") for p in paths])


def texts(value: Column, *names: str) -> Column:
    """All texts of a JSON value, in order; objects give what they hold under one of the names."""

    def leaf(x: Column) -> Column:
        inner = at(x, *names) if names else F.lit(None).cast("string")
        listed = lambda i: F.when(i.startswith("["), F.from_json(i, "array<string>")).otherwise(F.array(i))
        return F.when(x.startswith("{"), schedule.let(inner, listed)).otherwise(F.array(x))

    items = lambda v: F.when(v.startswith("["), F.flatten(F.transform(F.from_json(v, "array<string>"), leaf))).otherwise(leaf(v))
    clean = F.transform(F.coalesce(schedule.let(value, items), _none()), lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.filter(clean, lambda t: t != "")


#: How deep parts of a discipline may lie in one another.
DEPTH = 6


def parts(value: Column, *names: str) -> Column:
    """All JSON values under the first of the names that an object has, in lists and in objects of parts m1, m2, ... too, in order.

    Each of DEPTH passes opens every list and object found so far; a text is left as it is. Objects with
    none of the names and no parts have no values.
    """
    numbered = lambda x: F.filter(F.map_entries(F.from_json(x, "map<string,string>")), lambda e: e["key"].rlike(r"^m\d+$"))

    def opened(x: Column) -> Column:
        places = F.array_sort(F.transform(numbered(x), lambda e: F.struct(F.substr(e["key"], F.lit(2)).try_cast("int").alias("i"), e["value"].alias("v"))))
        held = schedule.let(at(x, *names), lambda inner: F.when(inner.isNotNull(), F.array(inner)).otherwise(F.transform(places, lambda e: e["v"])))
        listed = F.from_json(x, "array<string>")
        return F.when(x.startswith("{"), F.coalesce(held, _none())).when(x.startswith("["), F.coalesce(listed, F.array(x))).otherwise(F.array(x))

    out = F.array(value)
    for _ in range(DEPTH):
        out = F.flatten(F.transform(F.filter(out, lambda x: x.isNotNull()), opened))
    return out


def subject(content: Column) -> Column:
    """A lesson's subject from its frame's discipline, wherever in it the parts of its name lie; null where there is none."""
    found = F.transform(parts(at(content, "frame.discipline"), "discipline", "discipline_name"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    text = F.array_join(F.filter(found, lambda t: (t != "") & ~t.startswith("{")), " ")
    return schedule.let(text, lambda t: F.when(t != "", t))


def groups(content: Column, known: Column) -> Column:
    """A lesson's groups: one, a range within the document's groups, a list, or those of the discipline's parts, each once."""

    def ranged(d: Column, otherwise: Callable[[Column], Column]) -> Column:
        ends = F.array(at(d, "first_group.group"), at(d, "last_group.group"))
        return schedule.let(ends, lambda e: F.when(e[0].isNotNull() & e[1].isNotNull(), schedule.groups_between(known, e[0], e[1])).otherwise(otherwise(d)))

    def nested(d: Column) -> Column:
        inner = F.when(d.startswith("{"), F.map_values(F.map_filter(F.from_json(d, "map<string,string>"), lambda k, v: k.rlike(r"^m\d+$"))))
        own = lambda m: texts(at(m, "group.group", "groups", "group"), "group.group", "group")
        return F.flatten(F.transform(F.coalesce(inner, _none()), lambda m: F.coalesce(ranged(m, own), _none())))

    def several(d: Column) -> Column:
        listed = lambda g: F.when(g.isNotNull(), F.array_distinct(texts(g, "group.group", "group"))).otherwise(F.array_distinct(nested(d)))
        return schedule.let(at(d, "groups", "group"), listed)

    def read(d: Column) -> Column:
        return schedule.let(at(d, "group.group"), lambda one: F.when(one.isNotNull(), F.array(one)).otherwise(ranged(d, several)))

    return schedule.let(at(content, "frame.discipline"), read)


def _hours(content: Column) -> Column:
    own = texts(at(content, "explicit_hours"), "hour_range")
    frame = F.concat(texts(at(content, "frame.hour_begin"), "hour_range"), texts(at(content, "frame.hour_end"), "hour_range"))
    one, inner = texts(at(content, "frame.hour_1"), "hour_range"), texts(at(content, "frame.discipline.hour_begin"), "hour_range")
    held = lambda c: schedule.let(c, lambda v: F.when(F.size(v) > 0, v))
    return F.coalesce(held(own), held(frame), held(one), inner)


def lessons(found: DataFrame) -> DataFrame:
    """Lesson records from (doc_id, content, t, b, known_groups, week1_bottom, years).

    Columns: doc_id, lesson (a struct of the export's fields) and error. A lesson without a subject, groups
    or hours has a null record and says why; others of its document are not affected.
    """
    c = F.col("content")
    people = texts(F.coalesce(at(c, "teacher", "teachers"), at(c, "teacher_burst"), at(c, "frame.teacher")), "teacher", "teachers")
    rooms = F.transform(texts(F.coalesce(at(c, "room", "rooms"), at(c, "room_burst"), at(c, "frame.room")), "room", "rooms"), schedule.clean_room)
    day = F.coalesce(*[schedule.weekday_index(at(c, p), F.array(*map(F.lit, WEEK_DAYS))) for p in ("frame.hour_begin.week_day", "frame.discipline.hour_begin.week_day")], F.lit(0))
    week = F.when(F.col("week1_bottom").isNotNull() & (F.col("t") >= F.col("week1_bottom")), WEEKS[2]).otherwise(WEEKS[1])
    explicit = F.flatten(F.transform(texts(at(c, "explicit_dates"), "date", "dates"), lambda d: F.split(F.replace(d, F.lit("\\n"), F.lit(",")), "[\n,]")))
    raw = found.select("doc_id", "t", subject(c).alias("subject"), groups(c, F.coalesce("known_groups", _none())).alias("groups"), people.alias("people"), rooms.alias("rooms"), _hours(c).alias("hours"), day.alias("day"), week.alias("week"), explicit.alias("explicit"), at(c, "frame._explicit_lesson_kind", "frame.lesson_kind", "lesson_kind").alias("kind"), (F.col("b") - F.col("t")).alias("height"), "years")
    error = F.when(F.col("subject").isNull(), "no subject").when(F.size("groups") == 0, "no groups").when(F.size("hours") == 0, "no hours")
    # Dates that stand in a place's text are the lesson's; what is left is the place.
    split = raw.withColumn("placed", F.transform("rooms", lambda r: schedule.dates_in_place(r, F.col("years")))).withColumn("ranges", schedule.hour_ranges(F.col("hours")))
    places = schedule.distinct_places(F.transform("placed", lambda p: p["place"]))
    dates = F.array_distinct(F.concat(schedule.dates(F.col("explicit"), F.col("years")), F.flatten(F.transform("placed", lambda p: p["dates"]))))
    record = F.struct(
        F.col("subject").alias("subject"),
        schedule.lesson_kind(F.col("kind"), F.col("ranges"), F.col("height")).alias("kind"),
        F.struct(schedule.teachers_without_places(F.col("people"), F.col("rooms")).alias("teachers"), F.col("groups").alias("student_groups")).alias("participants"),
        places.alias("places"),
        F.col("ranges").alias("hours"),
        F.col("day").alias("week_day_index"),
        F.col("week").alias("week"),
        dates.alias("holds_on_date"),
    )
    return split.select("doc_id", "t", F.when(error.isNull(), record).alias("lesson"), error.alias("error"))


def calendar(days: DataFrame) -> DataFrame:
    """(doc_id, weeks, months) from (doc_id, week, week_day, month, month_day, ord): days by week, weekday and month, in order."""
    months = days.where("month is not null").groupBy("doc_id", "month").agg(F.min("ord").alias("o")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "month"))), lambda m: m["month"]).alias("months"))
    known = days.join(months, "doc_id").withColumn("month_index", schedule.weekday_index(F.col("month"), F.col("months")))
    per_month = known.groupBy("doc_id", "week", "week_day", "month_index").agg(F.min("ord").alias("o"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "month_day"))), lambda d: d["month_day"]).alias("month_days"))
    shaped = F.transform(F.array_sort(F.collect_list(F.struct("o", "month_index", "month_days"))), lambda m: F.struct(m["month_index"].alias("month_index"), m["month_days"].alias("month_days")))
    per_day = per_month.groupBy("doc_id", "week", "week_day").agg(shaped.alias("calendar"))
    index = schedule.weekday_index(F.col("week_day"), F.array(*map(F.lit, WEEK_DAYS)))
    per_week = per_day.where(index.isNotNull()).groupBy("doc_id", "week").agg(F.array_sort(F.collect_list(F.struct(index.alias("week_day_index"), "calendar"))).alias("days"))
    name = F.when(F.col("week") == 1, WEEKS[1]).when(F.col("week") == 2, WEEKS[2])
    weeks = per_week.where(name.isNotNull()).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(name.alias("name"), "days"))).alias("weeks"))
    return weeks.join(months, "doc_id")


def documents(titles: DataFrame, made: DataFrame, calendars: DataFrame) -> DataFrame:
    """(doc_id, json): each timetable as one JSON document.

    ``titles`` has doc_id, original_title and path; documents without lessons or a calendar have empty
    ones. Lessons come in the order of their place.
    """
    metadata = schedule.schedule_metadata(F.col("path"), F.col("original_title"))
    grid = made.where("lesson is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("t", "lesson"))).alias("rows"))
    whole = titles.join(grid, "doc_id", "left").join(calendars, "doc_id", "left")
    rows = F.coalesce(F.transform("rows", lambda r: r["lesson"]), F.array().cast(made.schema["lesson"].dataType.simpleString().join(["array<", ">"])))
    when = F.struct(F.coalesce("weeks", F.create_map().cast(calendars.schema["weeks"].dataType)).alias("weeks"), F.array(*map(F.lit, WEEK_DAYS)).alias("week_days"), F.coalesce("months", _none()).alias("months"))
    return whole.select("doc_id", F.to_json(F.struct(schedule.title(F.col("original_title"), metadata["scope"]).alias("title"), metadata.alias("metadata"), F.struct(rows.alias("grid"), when.alias("datetime")).alias("table"))).alias("json"))
