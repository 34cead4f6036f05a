"""Incremental scoring of arriving customer rows with a saved run."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ebbtide import settings as S
from ebbtide.operators.contracts import with_violations
from ebbtide.operators.scoring import scored_records
from ebbtide.sources.runs import ScoringRun


def checked_stream(rows: DataFrame) -> DataFrame:
    """Rows with their rule violations; a row without id is kept as it is and counts as a violation."""
    no_id = F.when(F.col(S.ID).isNull(), F.array(F.lit(f"{S.ID} is missing"))).otherwise(
        F.array().cast("array<string>")
    )
    return with_violations(rows).withColumn("violations", F.concat(no_id, "violations"))


#: Parts that ids are dealt to by their hash; the ids of a part are one state. Fixed for the life of a checkpoint.
PARTS = 4096

REPEATED = f"{S.ID} is repeated"

_WORKING = ["_valid", "_order", "_id", "_now", "_now_ms"]


def _marker(remember_ms):
    """A function over arriving rows that lets one valid row of each id pass and marks all later valid ones.

    Functions that run in tasks are made inside others, so that they travel whole and need no import there.
    """

    def marked(batches, seen, clock):
        """Rows with ``_repeated``. ``seen`` maps ids that have passed to the time of their last row and is updated.

        In one batch the row with the smallest hash passes; one row of each new id is held while the others stream
        through.
        """
        held = None
        for rows in batches:
            clock = max(clock, int(rows["_now_ms"].max()))
            for gone in [i for i, since in seen.items() if since + remember_ms < clock]:
                del seen[gone]
            known = rows["_id"].isin(seen.keys())
            seen.update(dict.fromkeys(rows["_id"][known], clock))
            rows = rows.assign(_repeated=rows["_valid"].astype(bool))
            claiming = rows["_repeated"] & ~known
            if claiming.any():
                claims = rows[claiming] if held is None else pd.concat([held, rows[claiming]])
                claims = claims.sort_values(["_id", "_order"], kind="stable")
                later = claims["_id"].duplicated()
                held = claims[~later]
                rows = pd.concat([rows[~claiming], claims[later]])
            if len(rows):
                yield rows.drop(columns=_WORKING, errors="ignore")
        if held is not None:
            seen.update(dict.fromkeys(held["_id"], clock))
            yield held.assign(_repeated=False).drop(columns=_WORKING, errors="ignore")

    return marked


def _first_of_id(remember_ms):
    """A function over the arriving rows of one id, for streams whose state is keyed by the id itself."""
    marked = _marker(remember_ms)

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs()
        seen = {"": watermark} if state.exists else {}
        yield from marked((rows.assign(_id="") for rows in batches), seen, 0)
        if not state.exists and seen:
            state.update((seen[""],))
        if state.exists:
            state.setTimeoutTimestamp(max(seen[""], watermark) + remember_ms)

    return run


def _first_of_ids(remember_ms):
    """A function over the arriving rows of one part of the ids, whose state is ids and the times of their last rows.

    Ids that are too old are forgotten when a row of their part comes or the oldest one times out.
    """
    marked = _marker(remember_ms)

    def run(key, batches, state):
        watermark = state.getCurrentWatermarkMs()
        seen = dict(zip(*state.get)) if state.exists else {}
        if state.hasTimedOut:
            seen = {i: since for i, since in seen.items() if since + remember_ms >= watermark}
        else:
            yield from marked(batches, seen, watermark)
        if seen:
            state.update((list(seen), list(seen.values())))
            state.setTimeoutTimestamp(max(min(seen.values()) + remember_ms, watermark + 1))
        elif state.exists:
            state.remove()

    return run


def unique_stream(rows: DataFrame, remember_days=30) -> DataFrame:
    """A stream's rows with their violations, where an id that has passed before is one, too.

    Ids are kept as keyed state across batches and restarts, until none of their rows came for ``remember_days`` by
    the batch clock; that clock never runs behind, so no row counts as late and none is dropped. A row that breaks
    a rule does not claim its id: the corrected row may follow. Rows travel as text and get their types back.

    The state's key is a part of the ids, because a call for every single id costs more than its rows; a batch writes
    the ids of every part it has rows of.
    """
    names = rows.columns
    plain = [f.name for f in rows.schema if isinstance(f.dataType, T.AtomicType) and f.dataType != T.BinaryType()]
    as_text = [F.col(f"`{c}`").cast("string").alias(c) if c in plain else F.col(f"`{c}`") for c in names]
    checked = checked_stream(rows)
    order = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in plain])
    is_binary = isinstance(rows.schema[S.ID].dataType, T.BinaryType)
    own = F.hex(S.ID) if is_binary else F.col(S.ID).cast("string")
    keyed = checked.withColumns(
        {
            "_valid": F.size("violations") == 0,
            "_order": order,
            "_id": own,
            "_part": F.pmod(F.when(own.isNull(), order).otherwise(F.xxhash64(own)), F.lit(PARTS)),
            "_now": F.current_timestamp(),
        }
    )
    keyed = keyed.withWatermark("_now", "0 seconds").select(
        *as_text, "_valid", "_order", "_id", "_part", "_now", F.unix_millis("_now").alias("_now_ms")
    )
    fields = [T.StructField(c, T.StringType() if c in plain else rows.schema[c].dataType) for c in names]
    marked = keyed.groupBy("_part").applyInPandasWithState(
        _first_of_ids(int(remember_days * 86_400_000)),
        T.StructType([*fields, T.StructField("_part", T.LongType()), T.StructField("_repeated", T.BooleanType())]),
        "ids array<string>, since array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    typed = marked.select(*[F.col(f"`{c}`").cast(rows.schema[c].dataType).alias(c) for c in names], "_repeated")
    repeated = F.when(F.col("_repeated"), F.array(F.lit(REPEATED))).otherwise(F.array().cast("array<string>"))
    return checked_stream(typed).withColumn("violations", F.concat("violations", repeated)).drop("_repeated")


def scored_stream(rows: DataFrame, run: ScoringRun, k=S.REASONS) -> DataFrame:
    """Valid rows with score, tier, reasons and the id of the run that scored them. Stateless and narrow."""
    valid = checked_stream(rows).filter(F.size("violations") == 0).drop("violations")
    return scored_records(run.score(valid, k)).withColumn("model_run_id", F.lit(run.name))


def quarantined_stream(rows: DataFrame) -> DataFrame:
    return checked_stream(rows).filter(F.size("violations") > 0)


def write_available(stream: DataFrame, path, checkpoint, file_format="parquet"):
    """Process everything that has arrived and stop; the file sink keeps output exactly once across restarts."""
    return (
        stream.writeStream.format(file_format)
        .outputMode("append")
        .option("path", str(path))
        .option("checkpointLocation", str(checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def score_arrivals(rows: DataFrame, run: ScoringRun, folder, k=S.REASONS, remember_days=None):
    """Score a stream into ``<folder>/scored`` and put invalid rows into ``<folder>/quarantine``.

    With ``remember_days`` the rows are first written to ``<folder>/checked``, with repeated ids among the violations;
    both outputs then follow that one decision.
    """
    if remember_days is None:
        valid, invalid = scored_stream(rows, run, k), quarantined_stream(rows)
    else:
        checked = unique_stream(rows, remember_days)
        write_available(checked, f"{folder}/checked", f"{folder}/_checked_progress").awaitTermination()
        decided = rows.sparkSession.readStream.schema(checked.schema).parquet(f"{folder}/checked")
        kept = decided.filter(F.size("violations") == 0).drop("violations")
        valid, invalid = scored_stream(kept, run, k), decided.filter(F.size("violations") > 0)
    queries = [
        write_available(valid, f"{folder}/scored", f"{folder}/_scored_progress"),
        write_available(invalid, f"{folder}/quarantine", f"{folder}/_quarantine_progress"),
    ]
    for query in queries:
        query.awaitTermination()
    return f"{folder}/scored", f"{folder}/quarantine"
