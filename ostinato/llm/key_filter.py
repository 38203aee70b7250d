"""A filter that tells most rows that can't meet a table from those that may, before anything is shuffled."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.runtime import persist_table

#: Bits for each wanted row, and the most words of 64 bits: 2^20 of them are 1.3e7 rows' worth, and about 50 MB when broadcast.
#: Beyond that the filter holds back more and more rows wrongly; they are shuffled then, and results stay the same.
ROW_BITS, MAX_WORDS = 16, 1 << 20


def _mask(columns: list[str]) -> F.Column:
    """Three of a word's 64 bits."""
    h = F.xxhash64(*columns, F.lit(1))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, k).bitwiseAND(63).cast("int"))
    return one(0).bitwiseOR(one(6)).bitwiseOR(one(12))


def marked(rows: DataFrame, columns: list[str], wanted: DataFrame, names: list[str], mark: str = "_maybe") -> DataFrame:
    """rows with ``mark``: false only where no row of ``wanted`` has these columns' values under these names (of equal types).

    The filter's size follows the number of wanted rows, up to MAX_WORDS. ``mark`` is the only name that rows must not have.
    """
    n = wanted.count()
    words = min(MAX_WORDS, 1 << max(10, (n * ROW_BITS // 64).bit_length()))
    word, bits = _fresh([*rows.columns, mark])
    place = lambda c: F.pmod(F.xxhash64(*c), F.lit(words))
    filled = wanted.select(place(names).alias(word), _mask(names).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    # at most ``words`` rows
    joined = rows.withColumn(word, place(columns)).join(F.broadcast(filled), word, "left")
    asked = _mask(columns)
    return joined.withColumn(mark, F.coalesce(F.col(bits).bitwiseAND(asked) == asked, F.lit(False))).drop(word, bits)


def _fresh(taken: list[str], n: int = 2) -> list[str]:
    """Names that aren't taken, whatever their case."""
    low = {t.lower() for t in taken}
    free = (f"_f{k}" for k in count() if f"_f{k}" not in low)
    return [next(free) for _ in range(n)]


def without(rows: DataFrame, columns: list[str], gone: DataFrame, names: list[str], keys: DataFrame) -> DataFrame:
    """rows whose columns' values aren't those of a row of ``gone``, the others without a shuffle.

    ``keys`` holds the values of all rows' columns, under the same names as in rows, and nothing wide. A first filter lets rows by
    that can't be in gone; those that it held back wrongly are found among the keys, and a second filter finds them among the
    rows. Only rows that both filters doubt are joined. A row with a null in these columns stays.
    """
    mark = _fresh(rows.columns, 1)[0]
    wanted = gone.select([F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])
    null = F.lit(False)
    for c in columns:
        null = null | F.col(c).isNull()
    held = marked(keys.select(columns), columns, wanted, columns, mark).where(mark).select(columns)
    wrong = persist_table(held.where(~null).join(wanted, columns, "left_anti").distinct(), "wrongly-held")
    told = marked(rows, columns, wanted, columns, mark)
    sure = told.where(~F.col(mark) | null).drop(mark)
    doubted = marked(told.where(F.col(mark) & ~null).drop(mark), columns, wrong, columns, mark).where(mark).drop(mark)
    return sure.select(rows.columns).unionAll(doubted.join(wrong, columns, "left_semi").select(rows.columns))
