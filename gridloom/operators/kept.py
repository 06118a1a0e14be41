"""A ledger kept in a folder: deliveries are settled onto what is stored, look-ups read stored tables with pruning.

Every delivery is one batch. Its accepted ticks, the new states of the consumers and operators it touched, its rejections
and cursors are written as folders of that batch; a marker then commits all of them at once, and readers see committed
batches only. A batch that broke off is written over. Tables are partitioned by batch and by a hash of the key, so that a
look-up reads one bucket of files; a state is the newest row of its key.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import state
from gridloom.operators.settle import OK, settle
from gridloom.shared import file_system, written

BUCKETS = 64  # of a new ledger by default: a look-up reads one, so they should follow the size that is expected
_SCHEMAS = {
    "ticks": "id bigint, event_id string, consumer string, operator string, resource_type string, units_drawn bigint, cost decimal(38,0), meter_sequence bigint, time bigint",
    "rejected": "id bigint, event_id string, consumer string, meter_sequence bigint, verdict string",
    "consumers": "address string, escrow_balance decimal(38,0), total_units_consumed bigint, last_meter_sequence bigint, last_seen bigint",
    "operators": "address string, resource_type string, staked_amount decimal(38,0), total_earned decimal(38,0)",
    "cursors": "key string, value string",
}
_KEYS = {"ticks": "consumer", "rejected": "consumer", "consumers": "address", "operators": "address", "cursors": "key"}


class Ledger:
    """The kept ledger at ``path`` (in a file system that all executors share).

    ``buckets``: into how many parts a new ledger is hashed; an existing one keeps the number it began with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        fs, p = file_system(spark, f"{self.path}/buckets")
        kept = [int(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
        self.buckets = kept[0] if kept else buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @property
    def version(self) -> int:
        """The last committed batch; 0 before the first."""
        fs, p = file_system(self.spark, f"{self.path}/commits")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def _commit(self, batch: int) -> None:
        for marker in (f"{self.path}/buckets/{self.buckets}", f"{self.path}/commits/{batch}"):
            fs, p = file_system(self.spark, marker)
            if not fs.exists(p):
                fs.create(p, False).close()

    def _rows(self, table: str, upto: int | None = None) -> DataFrame:
        """All rows of committed batches, with ``batch`` and ``bucket``."""
        upto = self.version if upto is None else upto
        fs, p = file_system(self.spark, f"{self.path}/{table}")
        schema = T._parse_datatype_string(_SCHEMAS[table]).add("batch", T.IntegerType()).add("bucket", T.IntegerType())
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").filter(F.col("batch") <= upto)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        fields = T._parse_datatype_string(_SCHEMAS[table])
        key = _KEYS[table]
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields), self._bucket(F.col(key)).alias("bucket"))
        # whole buckets in few files; adaptive execution splits those of hot keys
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", key, *(["id"] if "id" in df.columns else []))
        rows.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{table}/batch={batch}")

    def _newest(self, table: str, upto: int | None = None, key: str | None = None) -> DataFrame:
        """The newest row of every key, or of one."""
        rows = self._rows(table, upto)
        name = _KEYS[table]
        if key is not None:
            at = self.spark.range(1).select(self._bucket(F.lit(key))).first()[0]
            rows = rows.filter((F.col("bucket") == at) & (F.col(name) == key))
        rest = [f.name for f in T._parse_datatype_string(_SCHEMAS[table]) if f.name != name]
        newest = rows.groupBy(name).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
        return newest.select(name, *(F.col(f"row.{c}").alias(c) for c in rest))

    def append(self, ticks: DataFrame, cursors: dict[str, str] | None = None, batch: int | None = None) -> DataFrame:
        """Settle a delivery (the columns of 'ticks') onto the ledger; gives its rows' verdicts, written.

        ``id`` must go on from earlier deliveries. ``batch``: a number above the last one's, for example a micro-batch's;
        a batch that is committed already changes nothing and gives no rows. States, ledger and cursors change together.
        """
        last = self.version
        batch = last + 1 if batch is None else batch
        done = batch <= last
        before = self._newest("consumers", last) if last else None
        known = self._rows("ticks", last).select("event_id") if last else None
        initial = before.select(F.col("address").alias("consumer"), "last_meter_sequence") if last else None
        verdicts = written(settle(ticks.limit(0) if done else ticks, initial, known), "verdicts")
        if done:
            return verdicts
        accepted = verdicts.filter(F.col("verdict") == OK)
        consumers, operators = state.consumer_state(accepted), state.operator_state(accepted)
        if last:
            consumers = state.merge_consumers(before, consumers)
            operators = state.merge_operators(self._newest("operators", last), operators)
        tables = {"ticks": accepted, "rejected": verdicts.filter(F.col("verdict") != OK), "consumers": consumers, "operators": operators}
        with ThreadPoolExecutor(len(tables)) as at_once:  # independent jobs over the written verdicts
            for job in [at_once.submit(self._write, df, table, batch) for table, df in tables.items()]:
                job.result()
        self._cursors(cursors, batch)
        self._commit(batch)
        return verdicts

    def _cursors(self, cursors: dict[str, str] | None, batch: int) -> None:
        if cursors:
            self._write(self.spark.createDataFrame([(k, str(v)) for k, v in cursors.items()], _SCHEMAS["cursors"]), "cursors", batch)

    def set_cursor(self, key: str, value: str) -> None:
        """Keep ``value`` under ``key``; the last value wins."""
        batch = self.version + 1
        self._cursors({key: value}, batch)
        self._commit(batch)

    def cursor(self, key: str) -> str | None:
        found = self._newest("cursors", key=key).first()
        return found["value"] if found else None

    def register_operators(self, registrations: DataFrame, order: str | None = None) -> None:
        """Merge (address, resource_type, staked_amount) into the kept operators: resource and stake are replaced, earnings kept."""
        last = self.version
        merged = state.upsert_operators(self._newest("operators", last), registrations, order)
        self._write(merged.join(registrations.select("address").distinct(), "address", "left_semi"), "operators", last + 1)
        self._commit(last + 1)

    def ticks(self) -> DataFrame:
        """The accepted ticks."""
        return self._rows("ticks").drop("batch", "bucket")

    def rejected(self) -> DataFrame:
        return self._rows("rejected").drop("batch", "bucket")

    def consumers(self) -> DataFrame:
        return self._newest("consumers")

    def operators(self) -> DataFrame:
        return self._newest("operators")

    def consumer(self, address: str) -> DataFrame:
        """The consumer's state; empty if it is not known. Reads its bucket only."""
        return self._newest("consumers", key=address)

    def operator(self, address: str) -> DataFrame:
        return self._newest("operators", key=address)

    def _of(self, address: str) -> DataFrame:
        at = self.spark.range(1).select(self._bucket(F.lit(address))).first()[0]
        return self._rows("ticks").filter((F.col("bucket") == at) & (F.col("consumer") == address)).drop("batch", "bucket")

    def history(self, address: str, limit: int | None) -> DataFrame:
        """The consumer's accepted ticks, newest accepted first, with their place. Reads its bucket only."""
        return state.history(self._of(address), address, limit)

    def detail(self, address: str, limit: int | None) -> DataFrame:
        """The consumer's state with its history as an array; empty if it is not known."""
        return state.history_nested(self.consumer(address), self.history(address, limit))


def build(spark: SparkSession, path: str, ticks: DataFrame) -> Ledger:
    """The ledger at ``path``, settled from ``ticks`` if nothing is kept there yet."""
    ledger = Ledger(spark, path)
    if not ledger.version:
        ledger.append(ticks)
    return ledger

