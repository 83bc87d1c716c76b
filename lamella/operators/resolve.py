"""Last-writer-wins: logs into live views, and look-ups and ordered scans of them.

The one rule: for each key the row with the greatest (seq, ord) wins, and only then are tombstones dropped. A NULL value
is data until that moment. Keys are grouping keys, so any predicate on the key goes below the aggregate to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.bounds import bounds, within
from lamella.functions.model import to_bytes


def resolve(log: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """(key, value) of the newest write of each key of ``log`` (key, value, seq, ord).

    One exchange on the key after a partial aggregate, so a key written a million times sends a row for each task.
    """
    newest = log.groupBy("key").agg(F.max_by("value", F.struct("seq", "ord")).alias("value"))
    return newest if keep_tombstones else newest.filter(F.col("value").isNotNull())


def resolve_unique(log: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """``resolve`` where (key, seq, ord) is unique and seq, ord fit 43 and 20 bits: the greatest position by a hash aggregate of
    one number, then a semi-join back on key and position, whose hash spreads even one hot key. It reads the log twice."""
    at = F.shiftleft(F.col("seq"), 20) + F.col("ord")
    rows = log.select("key", "value", at.alias("_at"))
    won = rows.groupBy("key").agg(F.max("_at").alias("_at"))
    newest = rows.join(won, ["key", "_at"], "left_semi").select("key", "value")
    return newest if keep_tombstones else newest.filter(F.col("value").isNotNull())


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Tables (key, value) as one log; a later table is newer."""
    logs = [t.select("key", "value", F.lit(i).cast("long").alias("seq"), F.lit(0).cast("long").alias("ord")) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, logs)


def merge(tables: list[DataFrame]) -> DataFrame:
    """Ordered union: for equal keys the last table wins; tombstones stay."""
    if not tables:
        raise ValueError("nothing to merge")
    return resolve(stacked(tables), keep_tombstones=True)


def last_wins(df: DataFrame) -> DataFrame:
    """(key, value) of a batch (key, value, ord): the last row of each key; of rows equal in ``ord`` too, the greatest value, with a
    deletion below all. A key that occurs twice without an ``ord`` has no last row, and the run fails."""
    x = df.groupBy("key").agg(F.max_by("value", F.struct("ord", "value")).alias("value"), F.count(F.lit(1)).alias("n"), F.count("ord").alias("ranked"))
    said = F.raise_error(F.concat(F.lit("a key occurs twice in a batch without ord: "), F.hex("key")))
    return x.select("key", F.when((F.col("n") > 1) & (F.col("ranked") < F.col("n")), said).otherwise(F.col("value")).alias("value"))


def unique(df: DataFrame) -> DataFrame:
    """(key, value), failing when it runs on a key that occurs twice."""
    x = df.groupBy("key").agg(F.max_by("value", F.lit(1)).alias("value"), F.count(F.lit(1)).alias("n"))
    return x.select("key", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("a key occurs twice: "), F.hex("key")))).otherwise(F.col("value")).alias("value"))


def scan(view: DataFrame, start: str | bytes | None = None, end: str | bytes | None = None, prefix: str | bytes | None = None, ordered: bool = True) -> DataFrame:
    """The rows of a seek, half-open range or prefix, by key; ``ordered`` False spares the sort."""
    low, high = bounds(start, end, prefix)
    if low is not None and high is not None and low >= high:
        found = view.filter(F.lit(False))
    else:
        found = view.filter(within(low, high))
    return found.orderBy("key") if ordered else found


def get_entry(raw: DataFrame, key: str | bytes) -> DataFrame:
    """One row (key, found, deleted, value) of a raw view: absent, deleted and live are three answers."""
    one = raw.filter(F.col("key") == F.lit(bytearray(to_bytes(key)))).agg(F.count("*").alias("n"), F.max_by("value", F.lit(1)).alias("value"))
    return one.select(F.lit(bytearray(to_bytes(key))).alias("key"), (F.col("n") > 0).alias("found"), ((F.col("n") > 0) & F.col("value").isNull()).alias("deleted"), "value")


#: Up to so many keys, of so many bytes together, a look-up sends them to every task; beyond, both sides are exchanged by key.
SENT_KEYS, SENT_BYTES = 200_000, 16 << 20


class Wanted:
    """The different keys of a bulk look-up: their bounds, and a filter for anything with a column ``key``."""

    def __init__(self, keys: DataFrame) -> None:
        self.keys = keys.select("key").filter("key IS NOT NULL").distinct()
        x = keys.agg(F.count("key"), F.coalesce(F.sum(F.length("key")), F.lit(0)), F.hex(F.min("key")), F.hex(F.max("key"))).first()
        self.low, self.high = (None, None) if x[2] is None else (bytes.fromhex(x[2]), bytes.fromhex(x[3]) + b"\0")
        self.none, self.few = x[2] is None, x[0] <= SENT_KEYS and x[1] <= SENT_BYTES

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows of the keys. As a filter of ``key`` it may stand below ``resolve``: its bounds reach the scan, and with few keys
        nothing but their rows is exchanged; else rows are exchanged by key once, which grouping by key then uses."""
        if self.none:
            return rows.filter(F.lit(False))
        return rows.filter(within(self.low, self.high)).join(F.broadcast(self.keys) if self.few else self.keys, "key", "left_semi")


def multi_get(live: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key, other columns) with ``found`` and ``value``."""
    return answered(Wanted(keys).of(live.select("key", "value")), keys)


def answered(found: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.drop("value", "found").join(found, "key", "left").withColumn("found", F.col("value").isNotNull())


def multi_has(live: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(Wanted(keys).of(live.select("key")), "key", "left_semi")


def missing(live: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(Wanted(keys).of(live.select("key")), "key", "left_anti")
