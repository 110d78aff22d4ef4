"""Places of pattern matches in a text, with built-in functions only.

Spark gives the matches and the gaps between them, but not where they are; starts are running
sums of the lengths of both. Lengths and places count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM_BLOCK = 256


def _scan(values: Column, base: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running fold of a short array, starting from `base`."""
    empty = F.struct(base.cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("sums"))

    def take(acc: Column, x: Column) -> Column:
        total = step(acc["total"], x)
        return F.struct(total.alias("total"), F.concat(acc["sums"], F.array(total)).alias("sums"))

    return F.aggregate(values, empty, take, lambda acc: acc["sums"])


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running fold (a sum, a maximum; 0 is neutral) of an array of bigint of any length, in blocks, so that appending stays cheap."""
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / SUM_BLOCK)).cast("int")),
        lambda i: F.slice(values, i * SUM_BLOCK + 1, F.lit(SUM_BLOCK)),
    )
    totals = _scan(F.transform(blocks, lambda b: F.aggregate(b, zero, step)), zero, step)
    return F.flatten(F.transform(blocks, lambda b, i: _scan(b, F.when(i == 0, zero).otherwise(F.get(totals, i - 1)), step)))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x)


SPAN = "array<struct<start: bigint, end: bigint, value: string, part: string>>"


def with_matches(df: DataFrame, name: str, text: str, pattern: str, group: int = 0) -> DataFrame:
    """Add `name`: start, end, text and one group of every leftmost, non-overlapping match.

    The pattern must not match an empty string. A null text has no matches.
    """
    found = df.withColumns(
        {
            "_all": F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")),
            "_part": F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")) if group else F.lit(None),
        }
    )
    found = found.withColumn("_gaps", F.when(F.size("_all") > 0, F.split(text, pattern, -1)))
    steps = F.transform("_all", lambda x, i: (F.length(F.get("_gaps", i)) + F.when(i > 0, F.length(F.get("_all", i - 1))).otherwise(0)).cast("bigint"))
    found = found.withColumn("_steps", F.when(F.size("_all") > 0, steps))
    found = found.withColumn("_starts", F.when(F.size("_all") > 0, running_sums(F.col("_steps"))))
    spans = F.transform(
        "_all",
        lambda x, i: F.struct(
            F.get("_starts", i).alias("start"),
            (F.get("_starts", i) + F.length(x)).alias("end"),
            x.alias("value"),
            (F.get("_part", i) if group else F.lit(None).cast("string")).alias("part"),
        ),
    )
    return found.withColumn(name, F.when(F.size("_all") > 0, spans).otherwise(F.array().cast(SPAN))).drop("_all", "_part", "_gaps", "_steps", "_starts")


def overlaps(start: Column, end: Column, others: Column) -> Column:
    """Whether a span meets one of an array of spans."""
    return F.exists(others, lambda o: (o["start"] < end) & (start < o["end"]))


def written(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_replaced(df: DataFrame, name: str, text: str, spans: str) -> DataFrame:
    """Add `name`: the text with each stretch of overlapping spans replaced by the label of its first span.

    `spans`: array of structs with `start`, `end` and `label`, sorted by start.
    """
    some = F.size(spans) > 0
    df = df.withColumn("_reach", F.when(some, running(F.transform(spans, lambda s: s["end"].cast("bigint")), lambda a, x: F.greatest(a, x))))
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("at"), s["label"].alias("label")))
    heads = F.filter(numbered, lambda s: (s["at"] == 0) | (s["start"] >= F.get("_reach", s["at"] - 1)))
    df = df.withColumn("_heads", F.when(some, heads))

    def end(i: Column) -> Column:
        """Where the stretch before head `i` ends."""
        return F.when(i == 0, F.lit(0)).otherwise(F.get("_reach", F.get("_heads", i)["at"] - 1)).cast("int")

    def piece(s: Column, i: Column) -> Column:
        return F.concat(F.substring(F.col(text), end(i) + 1, s["start"].cast("int") - end(i)), s["label"])

    pieces = F.array_join(F.transform("_heads", piece), "")
    tail = F.substring(F.col(text), F.element_at("_reach", -1).cast("int") + 1, F.length(text))
    return df.withColumn(name, F.when(some, F.concat(pieces, tail)).otherwise(F.col(text))).drop("_reach", "_heads")
