"""Structured Streaming jobs over chat turns.

Each job takes a streaming DataFrame and folders for output and checkpoint, and
returns a started query.  They share the batch column builders, so a drained
stream equals the batch result, however its turns were dealt to micro-batches; what has to be carried from one
micro-batch to the next is kept in a ``BucketStore``.  A micro-batch writes below folders named by its id and overwrites
them, so a replayed one does not duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from parlance.operators import sessions as SE
from parlance.operators import summaries as SM
from parlance.operators.blocks import number_turns
from parlance.operators.decisions import screen_turns, with_call
from parlance.rules import sessions as R
from parlance.session import materialise
from parlance.sources import sinks
from parlance.streaming.store import BucketStore

AVAILABLE_NOW = {"availableNow": True}
#: Event time by which rows may come late: a profile or segment is closed once all its keys have been silent for so long and their lifetime.
DELAY_SECONDS = 86_400
#: Event time between two looks at all state for what has run out.
SWEEP_SECONDS = 3_600

LAST_TURN = "session_id string, ts timestamp, message_id bigint, role string, is_blocked boolean, intent string, tags array<string>, lang string"
PROFILE_FACTS = "user_id string, span bigint, kind string, value string, n bigint, first decimal(38,0), since timestamp, last timestamp"
SUMMARY_FACTS = ("session_id string, kind string, value string, n bigint, first decimal(38,0), last decimal(38,0), last_ts timestamp, "
                 "user_turns bigint, user_chars bigint, replies bigint, was_blocked boolean")
#: What a profile is counted from, apart from the types and values of personal data.
PROFILE_INPUT = ["session_id", "user_id", "ts", "message_id", "role", "intent", "lang_hint", "lang", "tags", "is_blocked", "block_layer"]
PROGRESS = "batch_id bigint, turns bigint, late_turns bigint, watermark timestamp, swept timestamp"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# ---- replies and their messages ----------------------------------------------
def with_stored_call(batch: DataFrame, store: BucketStore, version: int, keep_seconds: int = R.SESSION_TTL_SECONDS) -> DataFrame:
    """``with_call`` for the screened turns of a micro-batch: a message may have come in an earlier one.

    The last turn of each session is stored; that of the batch's sessions takes part in the pairing.  It is forgotten
    ``keep_seconds`` of event time after it was seen, when its bucket is rewritten next.
    """
    columns, buckets = _columns(LAST_TURN), store.touched(batch)
    both = batch.drop("turn").withColumn("_own", F.lit(True)).unionByName(
        store.read(buckets, before=version).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    both = materialise(both, "stream-pairs")
    newest = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("message_id").desc())
    last = both.select(*columns).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    now = F.lit(both.agg(F.max("ts")).first()[0])
    store.write(last.where(F.unix_micros("ts") + keep_seconds * 1_000_000 > F.unix_micros(now)), buckets, version)
    return with_call(number_turns(both, "session_id", "ts", "message_id")).where("_own").drop("_own")


def stream_guardrail(turns: DataFrame, out: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Screen every turn; append audit rows and vault rows by day.

    A reply is given its message's intent, tags and language, also if that came in an earlier micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        screened = materialise(batch, "stream-screened")
        if screened.isEmpty():
            return
        calls = with_stored_call(screened, BucketStore(spark, f"{out}/state", "session_id", LAST_TURN), batch_id)
        for name, rows in (("audit", sinks.audit_rows(calls)), ("vault", sinks.vault_rows(screened))):
            sinks.append_json(rows, f"{out}/{name}/batch={batch_id}", ["event_date"], mode="overwrite")

    return (screen_turns(turns).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


# ---- profiles -----------------------------------------------------------------
def read_progress(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """(batch_id, turns, late_turns, watermark, swept) of the micro-batches so far."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/progress")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], PROGRESS)
    rows = spark.read.schema(PROGRESS).parquet(f"{out}/progress/*")
    return rows if before is None else rows.where(F.col("batch_id") < before)


def _open_segments(facts: DataFrame) -> DataFrame:
    """(user_id, span, segment, ended): the segment that each span of a user lies in and the last turn of that segment."""
    spans = facts.where("kind = 'message'").select("user_id", F.col("span").alias("_hour"), F.col("since").alias("_lo"), F.col("last").alias("_hi"))
    ended = F.max("_hi").over(W.partitionBy("user_id", "segment"))
    return SE.mark_spans(spans, "user_id").withColumn("ended", ended).select("user_id", F.col("_hour").alias("span"), "segment", "ended")


def _fold_segments(facts: DataFrame) -> DataFrame:
    """Profiles by user and segment from facts by span that have ``segment``."""
    keys = ["user_id", "segment"]
    return SE.fold_profile(SE.merge_facts(facts, keys), keys).drop("segment")


def stream_user_profile(turns: DataFrame, out: str, checkpoint: str, trigger: dict = AVAILABLE_NOW, delay_seconds: int = DELAY_SECONDS,
                        sweep_seconds: int = SWEEP_SECONDS) -> StreamingQuery:
    """Profiles with their lifetime: facts of open segments by user and hour in a store, closed profiles appended below ``closed``.

    Facts can be merged, so a micro-batch counts its own turns and rewrites the buckets of its users.  The watermark is
    ``delay_seconds`` behind the newest turn seen; turns older than the one of the batches before are late, and counted in
    ``progress`` instead.  A segment is closed when the watermark is 24 hours behind its last turn, so
    no turn that is not late can belong to it.  All buckets are looked through whenever the watermark has moved on by
    ``sweep_seconds``: users who have fallen silent leave the store.
    """

    found = F.transform("pii", lambda p: F.struct(p["pii_type"], p["value"]))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        screened = materialise(batch.select(*PROFILE_INPUT, found.alias("pii")), "stream-screened")
        so_far = read_progress(spark, out, batch_id).agg(F.max("watermark"), F.max("swept")).first()
        seen = screened.agg(F.max("ts"), F.count(F.lit(1))).first()
        if not seen[1]:
            return
        in_time = screened if so_far[0] is None else screened.where(F.col("ts") >= F.lit(so_far[0]))
        late = 0 if so_far[0] is None else screened.where(F.col("ts") < F.lit(so_far[0])).count()
        calls = with_stored_call(in_time, BucketStore(spark, f"{out}/state/last", "session_id", LAST_TURN), batch_id) if late < seen[1] else in_time
        stepped = spark.range(1).select(F.greatest(F.lit(seen[0]) - F.expr(f"INTERVAL {delay_seconds} SECOND"), F.lit(so_far[0]).cast("timestamp")).alias("w")).first().w
        store = BucketStore(spark, f"{out}/state/facts", "user_id", PROFILE_FACTS)
        sweep = so_far[1] is None or (stepped - so_far[1]).total_seconds() >= sweep_seconds
        buckets = sorted({*store.touched(in_time), *(store.places(batch_id) if sweep else ())})
        stored = store.read(buckets, before=batch_id)
        if late < seen[1]:
            fresh = SE.profile_facts(calls.withColumn("span", SE.span_of("ts")), keys=["user_id", "span"])
            stored = SE.merge_facts(stored.unionByName(fresh), ["user_id", "span"])
        facts = materialise(stored.select(*_columns(PROFILE_FACTS)), "stream-facts")
        closed = F.unix_micros("ended") + R.SESSION_TTL_SECONDS * 1_000_000 <= F.unix_micros(F.lit(stepped))
        marked = facts.join(_open_segments(facts), ["user_id", "span"]).withColumn("closed", closed)
        _fold_segments(marked.where("closed")).write.mode("overwrite").parquet(f"{out}/closed/batch={batch_id}")
        store.write(marked.where("NOT closed").select(*_columns(PROFILE_FACTS)), buckets, batch_id)
        done = [(batch_id, seen[1], late, stepped, stepped if sweep else so_far[1])]
        spark.createDataFrame(done, PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/batch={batch_id}")

    return (screen_turns(turns).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def profiles_on_read(spark: SparkSession, out: str) -> DataFrame:
    """All profiles so far, closed ones and those whose segment is still open; ``segment`` counts each user's from 1."""
    facts = BucketStore(spark, f"{out}/state/facts", "user_id", PROFILE_FACTS).read()
    open_ = _fold_segments(facts.join(_open_segments(facts).drop("ended"), ["user_id", "span"])).withColumn("is_open", F.lit(True))
    closed = spark.read.schema(open_.drop("is_open").schema).parquet(f"{out}/closed/*").withColumn("is_open", F.lit(False))
    return closed.unionByName(open_).withColumn("segment", F.row_number().over(W.partitionBy("user_id").orderBy("created_at")).cast("long"))


# ---- segments -----------------------------------------------------------------
def session_windows(turns: DataFrame, key: str = "user_id", gap: str = "24 hours", watermark: str | None = "1 day"
                    ) -> DataFrame:
    """Session segments by inactivity; the same aggregate in batch and streaming."""
    src = turns if watermark is None else turns.withWatermark("ts", watermark)
    return src.groupBy(key, F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("turns")).drop("w")


def stream_sessions(turns: DataFrame, out: str, checkpoint: str, key: str = "user_id", gap: str = "24 hours",
                    trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Appends each closed segment once, when the watermark passes it; the others are in the query's state (``segments_on_read``)."""
    return (session_windows(turns, key, gap).writeStream.outputMode("append").format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger).start())


def open_segments(spark: SparkSession, checkpoint: str, key: str = "user_id") -> DataFrame:
    """(key, started, ended, turns) of the segments that are still open, from the state of the drained query."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col(f"value.{key}").alias(key), *[F.col(f"value.{c}").alias(c) for c in ("min", "max", "count")]).toDF(
        key, "started", "ended", "turns")


def segments_on_read(spark: SparkSession, out: str, checkpoint: str, key: str = "user_id") -> DataFrame:
    """All segments so far: closed ones from the sink, open ones from the state."""
    closed = spark.read.schema(f"{key} string, started timestamp, ended timestamp, turns bigint").parquet(out)
    return closed.unionByName(open_segments(spark, checkpoint, key).select(*closed.columns))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query has left out because they came behind its watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


# ---- history ------------------------------------------------------------------
def stream_history(turns: DataFrame, out: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Append masked turns; readers take the newest ones per session and drop
    expired sessions (``history_on_read``), which keeps the stream stateless."""
    rows = screen_turns(turns).select("session_id", "user_id", "ts", "message_id", "role", "masked_text")
    return (rows.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def history_on_read(stored: DataFrame, n: int = R.HISTORY_TURNS, as_of: str | None = None,
                    ttl_seconds: int = R.SESSION_TTL_SECONDS) -> DataFrame:
    """Newest ``n`` turns per session.

    With ``as_of`` it is the state at that instant: later turns are not there yet, a session whose last turn
    is older than its lifetime is gone, and so are turns before a silence of that length.
    """
    now = None if as_of is None else F.unix_micros(F.lit(as_of).cast("timestamp"))
    seen = stored if now is None else stored.where(F.unix_micros("ts") <= now)
    w = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("message_id").desc())
    kept = seen.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    if now is not None:
        # at most n turns a session are left: the time to the next turn, or to now, must not reach the lifetime
        wait = F.coalesce(F.lag(F.unix_micros("ts")).over(w), now) - F.unix_micros("ts")
        gone = F.max((F.col("_wait") >= ttl_seconds * 1_000_000).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        kept = kept.withColumn("_wait", wait).withColumn("_gone", gone).where("_gone = 0").drop("_wait", "_gone")
    return kept.drop("_rank")


# ---- summaries ----------------------------------------------------------------
def stream_summaries(turns: DataFrame, out: str, checkpoint: str, trigger: dict = AVAILABLE_NOW,
                     keep_seconds: int = R.SUMMARY_TTL_SECONDS) -> StreamingQuery:
    """Refresh the summary of every session a micro-batch touches.

    A session's facts are stored; a micro-batch adds its own to those in the buckets of its sessions and folds the
    touched sessions again.  It reads no turn but its own.  A session is forgotten ``keep_seconds`` after its last turn,
    the lifetime of its summary, when its bucket is rewritten next.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        screened = materialise(batch.drop("text", "injection_hits"), "stream-screened")
        now = screened.agg(F.max("ts")).first()[0]
        if now is None:
            return
        store = BucketStore(spark, f"{out}/state", "session_id", SUMMARY_FACTS)
        fresh = SM.turn_facts(screened, place=SE.moment(screened, "ts", "message_id"))
        buckets = store.touched(screened)
        facts = materialise(SM.merge_facts(store.read(buckets, before=batch_id).unionByName(fresh)).select(*_columns(SUMMARY_FACTS)), "stream-facts")
        alive = facts.groupBy("session_id").agg(F.max("last_ts").alias("t")).where(
            F.unix_micros("t") + keep_seconds * 1_000_000 > F.unix_micros(F.lit(now))).select("session_id")
        store.write(facts.join(alive, "session_id", "left_semi"), buckets, batch_id)
        touched = facts.join(screened.select("session_id").distinct(), "session_id", "left_semi")
        SM.summary_records(SM.fold_facts(touched)).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/rows/batch={batch_id}")

    return (screen_turns(turns).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
