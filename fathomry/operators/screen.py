"""Rows of a wide table whose key is wanted, without shuffling the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions import paths as P
from fathomry.operators.graph import dropped, freed, staged

#: Bytes of keys that are broadcast as they are; beyond that a bitmap of their hashes is, of at most 2^27 bits (16 MB).
KEYS, BITS, PER_KEY, ROW = 32_000_000, 1 << 27, 16, 1 << 15


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among ``wanted``'s, and, with very many keys, few others: join exactly once rows are narrow.

    Few keys (by a count of their bytes) are broadcast, which is exact. Of more a bitmap is; with more keys than it is made for
    it lets more rows pass, never fewer.
    """
    return told(rows, {key: wanted}).where(F.col(f"__{key}")).select(*rows.columns)


def told(rows: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with a column ``__key`` for each key of ``wanted``: false if it surely is none of those of its table's first
    column, true if it is or, with very many of them, may be. A null key is none."""
    for key, table in wanted.items():
        rows = _told(rows, _keys(table, key), key)[0]
    return rows


def held(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``among`` without others: what a bitmap lets pass is joined, and nothing is where the keys are few."""
    keys = _keys(wanted, key)
    found, sure = _told(rows, keys, key)
    found = found.where(F.col(f"__{key}")).select(*rows.columns)
    return found if sure else found.join(keys.withColumnRenamed("__k", key).distinct(), key, "left_semi").select(*rows.columns)


def lacking(rows: DataFrame, unwanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is none of ``unwanted``'s; those that surely aren't are not shuffled."""
    keys = _keys(unwanted, key)
    seen, sure = _told(rows, keys, key)
    out = seen.where(~F.col(f"__{key}")).select(*rows.columns)
    return out if sure else out.unionByName(seen.where(F.col(f"__{key}")).join(keys.withColumnRenamed("__k", key), key, "left_anti").select(*rows.columns))


def flagged(rows: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: whether ``key`` is among ``wanted``'s, each of which is there once; the rest is not shuffled."""
    keys = _keys(wanted, key)
    seen, sure = _told(rows, keys, key)
    seen = seen.withColumnRenamed(f"__{key}", name)
    near = seen.where(F.col(name)).drop(name).join(keys.withColumnRenamed("__k", key).withColumn(name, F.lit(True)), key, "left")
    return seen if sure else seen.where(~F.col(name)).unionByName(near.withColumn(name, F.coalesce(name, F.lit(False))))


def below(rows: DataFrame, places: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path is or lies below one of ``places``, of which none lies in another (see ``outermost``)."""
    return held(rows.withColumn("__top", F.explode(P.prefixes(column, 1))), places, "__top").select(*rows.columns)


def outermost(places: DataFrame) -> DataFrame:
    """Those of the directories (the first column) that lie in no other, each once; written once."""
    name = places.columns[0]
    each = staged(places.where(F.col(name).isNotNull()).distinct(), "places")
    inner = held(each.select(F.col(name).alias("x"), F.explode(P.prefixes(name)).alias("top")), each.withColumnRenamed(name, "top"), "top")
    out = staged(each.join(inner.select(F.col("x").alias(name)).distinct(), name, "left_anti"), "outermost")
    dropped(each)
    return out


def _keys(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(table.columns[0] if key not in table.columns else key).alias("__k"))


def _told(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """See ``told``; and whether what it tells is exact."""
    with freed(rows.sparkSession):
        size = keys.agg(F.count("__k").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("__k").cast("string"))), F.lit(0)).alias("b")).first()
        if size["b"] > KEYS:
            size = keys.distinct().agg(F.count("__k").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("__k").cast("string"))), F.lit(0)).alias("b")).first()
    if size["b"] <= KEYS:
        few = keys.where("__k is not null").distinct().withColumn("__hit", F.lit(True))
        return rows.join(F.broadcast(few), F.col(key) == F.col("__k"), "left").select(*rows.columns, F.coalesce("__hit", F.lit(False)).alias(f"__{key}")), True
    bits = ROW
    while bits < BITS and bits < size["n"] * PER_KEY:
        bits *= 2
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    maps = keys.where("__k is not null").select(F.floor(at("__k") / ROW).cast("int").alias("__row"), (at("__k") % ROW).alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("m"))
    # As numbers of eight bytes, the first the highest: a look at one copies nothing, and binary would be copied whole.
    words = F.transform(F.sequence(F.lit(0), F.lit(ROW // 64 - 1)), lambda i: F.conv(F.hex(F.call_function("substring", F.col("m"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    maps = maps.select("__row", words.alias("__map"))
    placed = rows.withColumns({"__row": F.floor(at(key) / ROW).cast("int"), "__bit": (at(key) % ROW).cast("int")}).join(F.broadcast(maps), "__row", "left")
    hit = F.expr("getbit(get(__map, shiftright(__bit, 6)), (7 - (shiftright(__bit, 3) & 7)) * 8 + (__bit & 7)) = 1")
    return placed.select(*rows.columns, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)).alias(f"__{key}")), False
