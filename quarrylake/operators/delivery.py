"""Messages delivered more than once: exactly one delivery of each message is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY, _SALT, _RANK = "__delivery_key", "__delivery_salt", "__delivery_rank"


def _clear(df: DataFrame) -> DataFrame:
    """Internal names are reserved: columns of that name are left out."""
    return df.drop(_KEY, _SALT, _RANK)


def message_key(c: Column) -> Column:
    """Identifier without outer blanks, tabs, CR, LF and in lower case; empty is null."""
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n"))), F.lit(""))


def best_first(attempts: str = "attempts", lease: str = "lease_until", tie: str = "delivery_id") -> list[Column]:
    """Most attempts, then latest lease, then smallest delivery; nulls rank lowest."""
    return [F.col(attempts).desc_nulls_last(), F.col(lease).desc_nulls_last(), F.col(tie).asc_nulls_last()]


def surplus_deliveries(df: DataFrame, key: Column, order: Sequence[Column], salt_on: Sequence[str], salts: int = 32) -> DataFrame:
    """Every delivery that isn't the first of its message in `order`; columns as given.

    Two ranks: within (key, salt), which already names most losers of a hot key in `salts`
    parallel tasks, then over the at most `salts` winners of a key. No task ever holds more than
    1/salts of the copies of one message. `salt_on` are columns that tell copies apart.

    Null or empty keys equal nothing and are never surplus. `order` must be total; full ties
    (repeated rows) leave one of them. An empty table gives no rows; extra columns pass through.
    """
    keyed = _clear(df).withColumn(_KEY, key).where(F.col(_KEY).isNotNull())
    salted = keyed.withColumn(_SALT, F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    first = salted.withColumn(_RANK, F.row_number().over(Window.partitionBy(_KEY, _SALT).orderBy(*order)))
    second = first.where(F.col(_RANK) == 1).withColumn(_RANK, F.row_number().over(Window.partitionBy(_KEY).orderBy(*order)))
    return first.where(F.col(_RANK) > 1).unionByName(second.where(F.col(_RANK) > 1)).drop(_KEY, _SALT, _RANK)


def kept_deliveries(df: DataFrame, key: Column, order: Sequence[Column], salt_on: Sequence[str], salts: int = 32) -> DataFrame:
    """One delivery of each message, and every delivery without an identifier."""
    keyed = _clear(df).withColumn(_KEY, key)
    salted = keyed.where(F.col(_KEY).isNotNull()).withColumn(_SALT, F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    first = salted.withColumn(_RANK, F.row_number().over(Window.partitionBy(_KEY, _SALT).orderBy(*order))).where(F.col(_RANK) == 1)
    second = first.withColumn(_RANK, F.row_number().over(Window.partitionBy(_KEY).orderBy(*order))).where(F.col(_RANK) == 1)
    return second.drop(_SALT, _RANK).unionByName(keyed.where(F.col(_KEY).isNull())).drop(_KEY)


def admit(batch: DataFrame, stored: DataFrame, key: str, order: Sequence[Column], salt_on: Sequence[str], salts: int = 32) -> DataFrame:
    """Rows of a new batch whose message isn't stored yet, one per message.

    `key` is a column of both tables. Stored identifiers are made distinct before the join
    (map-side), and the batch is ranked before it, so that neither side has a hot key in the
    anti-join. Rows of the batch without identifier are admitted; those in `stored` match nothing.
    """
    one = kept_deliveries(batch, message_key(F.col(key)), order, salt_on, salts).withColumn(_KEY, message_key(F.col(key)))
    seen = stored.select(message_key(F.col(key)).alias(_KEY)).where(F.col(_KEY).isNotNull()).distinct()
    return one.join(seen, _KEY, "left_anti").drop(_KEY)
