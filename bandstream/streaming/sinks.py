"""What a streaming query does with each micro-batch."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandstream.operators.joins import enrich
from bandstream.operators.latest import collapse
from bandstream.operators.projection import with_ttl
from bandstream.operators.push import poll_batches, push, push_payload
from bandstream.sources.cdc import accepted, classify, rejected
from bandstream.sources.store import CompactedChangelog

log = logging.getLogger(__name__)

TRIGGER = "200 milliseconds"


def project_into(
    store: CompactedChangelog,
    transport: Callable | None = None,
    ttl_ms: int | None = None,
    clock: Callable[[], float] = time.time,
    upkeep: int | None = None,
):
    """A ``foreachBatch`` function: collapse the batch, store it, push it.

    Storing under the batch id makes a redelivered batch harmless, and an error
    there fails the batch so that it is delivered again.  Pushes hold as many
    records as a listener polls; a failed push is logged and dropped.

    With ``upkeep`` the store is compacted, and what the new base replaces deleted,
    after every that many batches, so its folders and its tail stay bounded.

    With ``ttl_ms`` every row is stored with the ``expires_at`` its write gives
    it; the store's schema then has that column.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = collapse(batch)
        if ttl_ms is not None:
            now = F.lit(int(clock() * 1000)).cast("long")
            rows = with_ttl(rows, now, ttl_ms=ttl_ms)
        store.append(rows, batch_id)
        if upkeep and batch_id % upkeep == upkeep - 1:
            store.compact()
            store.vacuum()

    def write(batch: DataFrame, batch_id: int) -> None:
        if transport is None:
            save(batch, batch_id)
            return
        batch.persist()
        try:
            save(batch, batch_id)
            try:
                push(push_payload(poll_batches(batch)), transport)
            except Exception:
                log.exception("push of batch %s failed", batch_id)
        finally:
            batch.unpersist()

    return write


def append_into(store: CompactedChangelog):
    """A ``foreachBatch`` function that stores every record of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, batch_id)

    return write


def quarantine_into(events: CompactedChangelog, rejects: CompactedChangelog):
    """A ``foreachBatch`` function: captured messages to config events and to rejects.

    A batch is parsed once.  Both outputs are stored under its id, the rejects
    first: a batch that ``events`` has is in ``rejects`` too, and a batch that is
    delivered again leaves both as they were.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = classify(batch).persist()
        try:
            rejects.append(rejected(judged), batch_id)
            events.append(accepted(judged), batch_id)
        finally:
            judged.unpersist()

    return write


def enrich_into(store: CompactedChangelog, table: Callable[[], DataFrame]):
    """A ``foreachBatch`` function: rows with what ``table()`` has for their symbol.

    ``table`` is called for every micro-batch, so a batch sees what the table held
    when it began, and changes of the table show from the next batch on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(enrich(batch, table()), batch_id)

    return write


def start(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "update",
    available_now: bool = False,
    interval: str = TRIGGER,
) -> StreamingQuery:
    """Run ``stream`` into ``each_batch``; resumes from ``checkpoint``."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each_batch)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def batch_metrics(changelog: DataFrame, batch_col: str = "batch") -> DataFrame:
    """Per batch: records, distinct keys, and how many end as upsert or delete."""
    counts = changelog.groupBy(batch_col).agg(F.count("*").alias("records"))
    ends = collapse(changelog, batch_col).groupBy(batch_col).agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("op") == "U").alias("upserts"),
        F.count_if(F.col("op") == "D").alias("deletions"),
    )
    return counts.join(ends, batch_col)


def observed(stream: DataFrame, name: str = "changes") -> DataFrame:
    """Attach record counts to the progress events of a streaming query."""
    return stream.observe(
        name,
        F.count("*").alias("records"),
        F.count_if(F.col("op") == "U").alias("upserts"),
        F.count_if(F.col("op") == "D").alias("deletions"),
    )
