"""Alerts for newly published vulnerabilities as one Structured Streaming job."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gridrisk import constants as C
from gridrisk.operators import community, threat, vulnerabilities as V
from gridrisk.operators.parcels import first_per_key
from gridrisk.sources import readers
from gridrisk.sources.readers import explode_cve_pages, landed_texts, parse_cve_pages
from gridrisk.sources.writers import write_table


# The source forgets no file: its own age limit, a week by default, is set out of reach.
NO_AGE_LIMIT = "36500d"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State on local disk with its changes in the checkpoint, so that it may outgrow an executor's memory.
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: One memory limit for all partitions of the state on an executor, instead of buffers for each.
BOUNDED_STATE = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
#: Listings in a row of the landed table.
CHUNK = 1_000

LISTED = ["cve_id", "description", "cvss_v3_score", "cvss_v3_severity"]
PLACE = [*readers.PLACE, "pos"]
LISTED_SCHEMA = "cve_id string, description string, cvss_v3_score double, cvss_v3_severity string"


def listings(pages: DataFrame) -> DataFrame:
    """Every listing of a CVE on some parsed pages, with the time and place of the page and the place on it."""
    rows = explode_cve_pages(pages, readers.PLACE, place=True)
    return rows.select(
        *PLACE,
        F.col("cve.id").alias("cve_id"),
        V.first_english(F.col("cve.descriptions")).alias("description"),
        V.cvss_pick_v3(F.col("cve.metrics")).alias("m"),
    ).select(*LISTED[:2], "m.cvss_v3_score", "m.cvss_v3_severity", *PLACE)


def listed_cves(pages: DataFrame) -> DataFrame:
    """One row per CVE of some parsed pages; of several, the one listed first by page time and place."""
    first = first_per_key(listings(pages), "cve_id", *[F.col(c).asc() for c in PLACE])
    return first.select(*LISTED)


def first_sights(rows: DataFrame) -> DataFrame:
    """Streaming ``listings`` → one row for each CVE that no earlier batch had, kept as keyed state.

    The state of a CVE is one mark, in the state store's partition of its id; a batch reads the
    marks of its own CVEs only. Of several listings in a batch the first by page time and place
    counts.
    """
    columns, order = LISTED, PLACE

    class FirstSight(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "alerted boolean")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            first = min(rows, key=lambda row: tuple(row[c] for c in order))
            if not self.seen.exists():
                self.seen.update((True,))
                yield Row(**{c: first[c] for c in columns})

        def close(self) -> None:
            pass

    return rows.groupBy("cve_id").transformWithState(FirstSight(), LISTED_SCHEMA, "Append", "None")


def alerts(cves: DataFrame, communities: DataFrame, pressure: DataFrame, n: int = C.ALERT_TOP_N,
           min_cvss: float | None = C.ALERT_MIN_CVSS) -> DataFrame:
    """Top communities of every CVE that passes the alert threshold; batch and stream share it."""
    passing = community.filter_alert_threshold(threat.tag_vendors(cves), min_cvss)
    return community.alert_top_n(community.cve_urgency(passing, pressure), communities, n)


def run_alert_stream(spark: SparkSession, pages_path: str, out_path: str, checkpoint: str, communities: DataFrame,
                     pressure: DataFrame, files_per_batch: int | None = None) -> list[dict]:
    """Process every page file that has arrived, append the alerts and stop.

    Run it on a schedule with the same checkpoint: each run takes only files it has not taken
    before, whatever their modification time, and waits for the whole backlog. Two queries follow
    each other. The first parses the new files, ``files_per_batch`` at a time, and lands their
    listings; a large file of one document a line is read by several tasks. The second takes what
    was landed. Which CVEs were seen is its keyed state in the checkpoint, so it reads the new
    listings and the marks of their CVEs, however long the history. A batch writes into its own
    folder in overwrite mode, and state and files move on together, so a retried batch neither
    loses nor repeats alerts. A CVE whose page arrives late alerts by the listing that arrived
    first. Returns Spark's progress reports of the second query.
    """
    reader = spark.readStream.option("maxFileAge", NO_AGE_LIMIT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    alert_path, listed_path = f"{out_path}/alerts", f"{out_path}/listed"
    # A first, empty batch gives the tables their folders.
    spark.createDataFrame([], ALERT_SCHEMA).write.mode("overwrite").parquet(f"{alert_path}/batch=-1")

    def land(batch: DataFrame, batch_id: int) -> None:
        _chunks(listings(parse_cve_pages(batch))).write.mode("overwrite").parquet(f"{listed_path}/batch={batch_id}")

    def emit(batch: DataFrame, batch_id: int) -> None:
        # Stored before it is used, so that the state is read once however often the alerts need it.
        stored = write_table(batch, f"{out_path}/sights/batch={batch_id}")
        alerts(stored, communities, pressure).write.mode("overwrite").parquet(f"{alert_path}/batch={batch_id}")

    _run(landed_texts(reader, pages_path), land, f"{checkpoint}/files")
    spark.createDataFrame([], CHUNK_SCHEMA).write.mode("ignore").parquet(f"{listed_path}/batch=-1")
    landed = spark.readStream.schema(CHUNK_SCHEMA).option("maxFileAge", NO_AGE_LIMIT).parquet(listed_path)
    new = first_sights(landed.select(F.explode("listed").alias("l")).select("l.*"))
    before = {name: spark.conf.get(name, None) for name in (STATE_PROVIDER, BOUNDED_STATE)}
    spark.conf.set(STATE_PROVIDER, DISK_STATE)
    spark.conf.set(BOUNDED_STATE, "true")
    try:
        query = _run(new, emit, f"{checkpoint}/sights")
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return [json.loads(p.json) for p in query.recentProgress]


def _chunks(rows: DataFrame) -> DataFrame:
    """Listings, up to ``CHUNK`` of them a row."""
    chunk = F.floor(F.monotonically_increasing_id() / CHUNK).alias("chunk")
    own = rows.select(chunk, F.struct(*LISTED, *PLACE).alias("l"))
    return own.groupBy("chunk").agg(F.collect_list("l").alias("listed")).select("listed")


def _run(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, batch by batch, and then the ended query."""
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


CHUNK_SCHEMA = (
    "listed array<struct<cve_id:string,description:string,cvss_v3_score:double,cvss_v3_severity:string,"
    "file_time:timestamp,file_path:string,block:bigint,line:bigint,item:int,pos:int>>"
)
ALERT_SCHEMA = (
    "cve_id string, geo_id string, affected_vendors string, vendor_cyber_pressure double, "
    "solar_readiness double, alert_score double"
)


def read_alerts(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).parquet(f"{out_path}/alerts").drop("batch")
