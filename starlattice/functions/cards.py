"""Header cards as SQL expressions: 80-character lines to typed columns, CONTINUE lines joined by a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The grammar of a card's value field.
STRING = r"^\s*'((?:[^']|'')*+)'"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[EeDd][+-]?[0-9]+)?"
COMPLEX = rf"^\s*\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)"


def parse_cards(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with key, kind, v_string, v_bool, v_int, v_float, v_re and v_im of each 80-character line.

    kind is string, logical, integer, real, complex, empty, commentary or bad (a value that follows no rule; its typed
    columns are null, and the query goes on). Exponents may be written with D. Integers beyond 64 bits have no v_int but
    stay in v_string as digits. Null lines have null columns.
    """
    text = F.col(line)
    long_key = F.rlike(text, F.lit("^HIERARCH .*="))
    rows = df.withColumn("_long", long_key).withColumns({
        "key": F.when(F.col("_long"), F.upper(F.trim(F.substring_index(F.substr(text, F.lit(10)), "=", 1)))).otherwise(F.upper(F.rtrim(F.substr(text, F.lit(1), F.lit(8))))),
        "_field": F.when(F.col("_long"), F.substr(text, F.instr(text, "=") + 1)).when(F.substr(text, F.lit(9), F.lit(2)) == "= ", F.substr(text, F.lit(11))),
    })
    field = F.col("_field")
    remark = F.col("key").isin("COMMENT", "HISTORY", "") | field.isNull()
    rows = rows.withColumn("_body", F.trim(F.substring_index(field, "/", 1)))
    body = F.col("_body")
    kind = (
        F.when(text.isNull(), F.lit(None).cast("string")).when(remark, "commentary").when(F.rlike(field, F.lit(STRING)), "string").when(F.rlike(field, F.lit(COMPLEX)), "complex")
        .when(body == "", "empty").when(body.isin("T", "F"), "logical").when(F.rlike(body, F.lit("^[+-]?[0-9]+$")), "integer").when(F.rlike(body, F.lit(f"^{NUMBER}$")), "real").otherwise("bad")
    )
    rows = rows.withColumn("kind", kind)
    of = lambda name, value: F.when(F.col("kind") == name, value)
    real = lambda c: F.regexp_replace(c, "[Dd]", "E").try_cast("double")
    whole = body.try_cast("bigint")
    return rows.withColumns({
        "v_string": F.coalesce(of("string", F.rtrim(F.replace(F.regexp_extract(field, STRING, 1), F.lit("''"), F.lit("'")))), of("integer", F.when(whole.isNull(), body))),
        "v_bool": of("logical", body == "T"), "v_int": of("integer", whole), "v_float": of("real", real(body)),
        "v_re": of("complex", real(F.regexp_extract(field, COMPLEX, 1))), "v_im": of("complex", real(F.regexp_extract(field, COMPLEX, 2))),
    }).drop("_long", "_field", "_body")


def join_continued(cards: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows (key, value) whose value ends in & take the values of the CONTINUE rows that follow."""
    w = Window.partitionBy(*group).orderBy(order)
    start = F.when(F.col("key") != "CONTINUE", 1).otherwise(0)
    runs = cards.withColumn("_run", F.sum(start).over(w))
    piece = F.regexp_replace("value", "&$", "")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("v")))), lambda x: x["v"]), "")
    return runs.groupBy(*group, "_run").agg(F.min(order).alias(order), F.min_by("key", order).alias("key"), whole.alias("value")).drop("_run")


def pivot_keys(cards: DataFrame, group: list[str], keys: list[str], value: str) -> DataFrame:
    """One column for each key; the first of several cards counts."""
    first = lambda k: F.min(F.when(F.col("key") == k, F.struct("card_index", value)))[value]
    return cards.groupBy(*group).agg(*[first(k).alias(k.lower()) for k in keys])
