"""Text transformations of cell contents, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end, by Unicode's notion of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def shrink_extra_inner_spaces(c: Column) -> Column:
    """Each run of two or more white-space characters becomes a space; a single one stays what it is."""
    return F.regexp_replace(c, r"(?U)\s{2,}", " ")


def remove_all_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def remove_spaces_around_hypen(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s*-\s*", "-")


def fix_sparse_words(c: Column) -> Column:
    """Joins words whose letters are set apart by spaces; gaps twice as wide as the narrowest part words.

    A text changes only where twice its spaces are at least its length less one, and some gap lies between
    two letters or digits.
    """
    spaces = F.length(c) - F.length(remove_all_spaces(c))
    gaps = F.regexp_extract_all(c, F.lit(r"(?U)\b\s+\b"), F.lit(0))
    width = F.array_min(F.transform(gaps, lambda g: F.length(g))) * 2
    parts = F.split(c, F.concat(F.lit("[ ]{"), width.cast("string"), F.lit("}")))
    words = F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"(?U)\s+", "")), lambda w: w != "")
    sparse = (spaces > 0) & (spaces * 2 >= F.length(c) - 1) & (F.size(gaps) > 0)
    return F.when(sparse, F.array_join(words, " ")).otherwise(c)


#: Transformations that a pattern may name; register others with ``register``.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "shrink_extra_inner_spaces": shrink_extra_inner_spaces,
    "remove_all_spaces": remove_all_spaces,
    "remove_spaces_around_hypen": remove_spaces_around_hypen,
    "fix_sparse_words": fix_sparse_words,
}


def register(name: str, transform: Callable[[Column], Column]) -> None:
    """Adds a transformation under a name."""
    TRANSFORMS[name] = transform


def apply(how: str | Callable[[Column], Column], c: Column) -> Column:
    return (TRANSFORMS[how] if isinstance(how, str) else how)(c)


def preprocessed(c: Column, names: list[str] | None = None) -> Column:
    """The named transformations in order, then stripped and shrunk."""
    for name in names or []:
        c = apply(name, c)
    return shrink_extra_inner_spaces(strip(c))


def mask(c: Column) -> Column:
    """The shape of a text: digits become #, Cyrillic letters Я and я, Latin ones W and w."""
    for pattern, sign in (("[0-9]", "#"), ("[А-ЯЁ]", "Я"), ("[а-яё]", "я"), ("[A-Z]", "W"), ("[a-z]", "w")):
        c = F.regexp_replace(c, pattern, sign)
    return c


def joined_letters(texts: Column) -> Column:
    """An array's texts with runs of single characters joined into one text each."""
    step = F.aggregate(
        texts,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run")),
        lambda acc, t: F.when(F.length(t) == 1, F.struct(acc["out"].alias("out"), F.concat(acc["run"], t).alias("run"))).otherwise(
            F.struct(F.concat(acc["out"], F.when(acc["run"] != "", F.array(acc["run"])).otherwise(F.array().cast("array<string>")), F.array(t)).alias("out"), F.lit("").alias("run"))
        ),
        lambda acc: F.concat(acc["out"], F.when(acc["run"] != "", F.array(acc["run"])).otherwise(F.array().cast("array<string>"))),
    )
    return step
