"""Timetable export from lesson contents."""

import json

from pyspark.sql import functions as F

from __spark_entry__ import queries
from gridloom.functions import schedule
from gridloom.operators import export


def test_export(spark):
    full = {"frame": {"discipline": {"discipline": ["Математический", "анализ"], "first_group": {"group": "А-2"}, "last_group": {"group": "А-3"}}, "hour_begin": {"hour_range": "5 - 8 час.", "week_day": "СРЕДА"}, "teacher": "Ив..  ов И.И. ;", "room": "А--101 5.11"}, "explicit_dates": "6.11, 07.11.2025"}
    burst = {"teacher": [{"teacher": "П"}, "В 5"], "room": {"rooms": ["В5", "в 5", "Б"]}, "explicit_hours": "1-2", "frame": {"discipline": {"discipline_name": "Физика", "group": {"group": "А-1"}}, "_explicit_lesson_kind": "Лаб."}}
    rows = [("d", json.dumps(c, ensure_ascii=False), t, t + 4, ["А-1", "А-2", "А-3"], 10, "2025-2026") for t, c in ((3, full), (12, burst), (20, {"frame": {}}))]
    found = spark.createDataFrame(rows, "doc_id string, content string, t int, b int, known_groups array<string>, week1_bottom int, years string")
    made = export.lessons(found)
    got = {r.t: r for r in made.collect()}
    a, b = got[3].lesson, got[12].lesson
    assert (a.subject, a.kind, a.week_day_index, a.week, a.hours) == ("Математический анализ", "лекция", 2, "first_week", ["5-6", "7-8"])
    assert a.participants.student_groups == ["А-2", "А-3"] and a.participants.teachers == ["Ив. ов И.И."]
    assert a.places == ["А-101"] and a.holds_on_date == ["06.11.2025", "07.11.2025", "05.11.2025"]
    assert (b.kind, b.week, b.places, b.participants.teachers) == ("лабораторная работа", "second_week", ["В5", "Б"], ["П"])
    assert got[20].lesson is None and got[20].error == "no subject"
    days = spark.createDataFrame([("d", 1, "СРЕДА", "сентябрь", "3", 1), ("d", 1, "СРЕДА", "октябрь", "1", 3), ("d", 1, "СРЕДА", "сентябрь", "17", 2), ("d", 2, "ВТОРНИК", "октябрь", "7", 4), ("d", 2, "?", "октябрь", "8", 5)], "doc_id string, week int, week_day string, month string, month_day string, ord int")
    titles = spark.createDataFrame([("d", "фэвт 2 курс 2024-2025", "/x/Магистратура/ФЭВТ 2.xlsx"), ("e", None, None)], "doc_id string, original_title string, path string")
    out = {r.doc_id: json.loads(r.json) for r in export.documents(titles, made, export.calendar(days)).collect()}
    d = out["d"]
    assert d["title"] == "фэвт 2 курс 2025-2026 магистратура" and d["metadata"]["course"] == "2" and len(d["table"]["grid"]) == 2
    assert d["table"]["datetime"]["months"] == ["сентябрь", "октябрь"]
    assert d["table"]["datetime"]["weeks"]["first_week"] == [{"week_day_index": 2, "calendar": [{"month_index": 0, "month_days": ["3", "17"]}, {"month_index": 1, "month_days": ["1"]}]}]
    assert out["e"]["table"]["grid"] == [] and out["e"]["title"] == ""


def test_a_value_is_worked_out_once():
    """Lessons took time by how often each part of a text was split anew."""
    assert str(schedule.single_date(F.col("raw"), F.col("years"))).count("split(") == 1
    assert str(export._hours(F.col("content"))).count("get_json_object") == 15


def test_lessons_of_a_small_file_are_dealt_out(spark, tmp_path):
    """A file that one task reads."""
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert queries()["lessons"](spark, str(tmp_path)).rdd.getNumPartitions() == 4
