"""State machines as pure transforms: queue, moderation, settings, audits, revisions. One writer applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import temporal

#: What may follow a publication status.
TRANSITIONS = {("pending", "published"), ("pending", "rejected"), ("published", "archived")}


def enqueue(jobs: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, ids): a key that is queued already gives its old id; equal keys of one batch the smallest new id."""
    fresh = incoming.groupBy("idempotency_key").agg(F.min_by(F.struct(*incoming.columns), "id").alias("j")).select("j.*")
    added = fresh.join(jobs.select("idempotency_key"), "idempotency_key", "left_anti").select(*jobs.columns)
    queue = jobs.unionByName(added)
    ids = incoming.select("idempotency_key").join(queue.select("idempotency_key", F.col("id").alias("queued_id")), "idempotency_key")
    return queue, ids


def recover_leases(jobs: DataFrame, now: str) -> DataFrame:
    """Expired leases: failed when attempts are used up, else queued again."""
    expired = (F.col("state") == "running") & (F.col("lease_expires_at") <= temporal.now_literal(now))
    state = F.when(expired & (F.col("attempts") >= F.col("max_attempts")), "failed").when(expired, "queued").otherwise(F.col("state"))
    clear = lambda c: F.when(expired, None).otherwise(F.col(c)).alias(c)
    return jobs.select(*[state.alias("state") if c == "state" else clear(c) if c.startswith("lease_") else F.col(c) for c in jobs.columns])


def next_job(jobs: DataFrame, now: str, job_type: str | None = None) -> DataFrame:
    ready = jobs.where((F.col("state") == "queued") & (F.col("available_at") <= temporal.now_literal(now)) & (F.col("attempts") < F.col("max_attempts")))
    return (ready if job_type is None else ready.where(F.col("job_type") == job_type)).orderBy("available_at", "created_at", "id").limit(1)


def claim(jobs: DataFrame, owner: str, now: str, lease_s: int) -> DataFrame:
    """jobs with the oldest available one leased to owner."""
    chosen = next_job(jobs, now).select(F.col("id").alias("__c"))
    j = jobs.join(F.broadcast(chosen), F.col("id") == F.col("__c"), "left")
    mine = F.col("__c").isNotNull()
    until = temporal.now_literal(now) + F.make_dt_interval(secs=F.lit(lease_s))
    new = {"state": F.lit("running"), "lease_owner": F.lit(owner), "lease_expires_at": until, "attempts": F.col("attempts") + 1}
    return j.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def _guarded(jobs: DataFrame, job_id: str, owner: str, new: dict) -> DataFrame:
    mine = (F.col("id") == job_id) & (F.col("lease_owner") == owner) & (F.col("state") == "running")
    return jobs.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def heartbeat(jobs: DataFrame, job_id: str, owner: str, now: str, lease_s: int) -> DataFrame:
    return _guarded(jobs, job_id, owner, {"lease_expires_at": temporal.now_literal(now) + F.make_dt_interval(secs=F.lit(lease_s))})


def complete(jobs: DataFrame, job_id: str, owner: str) -> DataFrame:
    return _guarded(jobs, job_id, owner, {"state": F.lit("completed"), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})


def fail(jobs: DataFrame, job_id: str, owner: str, retry_at: str) -> DataFrame:
    """Queued again from retry_at, or failed when attempts are used up."""
    out = F.col("attempts") >= F.col("max_attempts")
    return _guarded(jobs, job_id, owner, {"state": F.when(out, "failed").otherwise("queued"), "available_at": F.when(out, F.col("available_at")).otherwise(temporal.now_literal(retry_at)), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})


def transition(events: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, outcomes) of commands (event_id, target, expected_version, reason, actor), the first per event: allowed
    by the graph, version as expected, a rejection with a reason of 1 to 1000 characters."""
    first = commands.groupBy("event_id").agg(F.min_by(F.struct("target", "expected_version", "reason", "actor"), F.struct("expected_version", "target")).alias("c"))
    j = events.join(first, F.col("id") == F.col("event_id"), "left")
    edge = F.concat_ws(">", "publication_status", F.col("c")["target"])
    reason = F.char_length(F.trim(F.coalesce(F.col("c")["reason"], F.lit(""))))
    outcome = (
        F.when(F.col("c").isNull(), None)
        .when(~edge.isin(*[f"{a}>{b}" for a, b in sorted(TRANSITIONS)]), "invalid_transition")
        .when(F.col("c")["expected_version"] != F.col("record_version"), "version_conflict")
        .when((F.col("c")["target"] == "rejected") & ~reason.between(1, 1000), "reason_required")
        .otherwise("applied")
    )
    j = j.withColumn("outcome", outcome)
    done = F.col("outcome") == "applied"
    new = {"publication_status": F.col("c")["target"], "record_version": F.col("record_version") + 1}
    after = j.select(*[F.when(F.coalesce(done, F.lit(False)), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in events.columns])
    public = done & (F.col("publication_status").isin("published") | F.col("c")["target"].isin("published"))
    rows = j.where("outcome is not null").select(F.col("id").alias("event_id"), F.col("publication_status").alias("before"), F.col("c")["target"].alias("target"), "outcome", F.col("c")["actor"].alias("actor"), F.coalesce(public, F.lit(False)).alias("bumps_revision"))
    lost = commands.select("event_id").distinct().join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti").select("event_id", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("target"), F.lit("not_found").alias("outcome"), F.lit(None).cast("string").alias("actor"), F.lit(False).alias("bumps_revision"))
    return after, rows.unionByName(lost)


def compare_and_set(settings: DataFrame, key: str, expected_version: int, value: str) -> DataFrame:
    hit = (F.col("key") == key) & (F.col("version") == expected_version)
    return settings.select(F.col("key"), F.when(hit, F.lit(value)).otherwise(F.col("value")).alias("value"), F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def append_audits(audits: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, outcomes): created, replayed (same id and content) or conflict (same id, other content)."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != "id")), {"ignoreNullFields": "false"}), 256)
    old = audits.select("id", digest(audits).alias("__old"))
    j = incoming.withColumn("__new", digest(incoming)).join(old, "id", "left")
    outcome = F.when(F.col("__old").isNull(), "created").when(F.col("__old") == F.col("__new"), "replayed").otherwise("conflict")
    j = j.withColumn("outcome", outcome)
    return audits.unionByName(j.where("outcome = 'created'").select(*audits.columns)), j.select("id", "outcome")


def next_revision(current: int, outcomes: DataFrame) -> DataFrame:
    """The public revision after outcomes: one more for each that touches what is public."""
    return outcomes.agg((F.lit(current) + F.count_if("bumps_revision")).cast("long").alias("revision"))


def ledger_errors(requirements: DataFrame, records: DataFrame) -> DataFrame:
    """(id, code): requirement ids that occur twice, records of unknown requirements, requirements without exactly one
    completed record."""
    twice = requirements.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("code"))
    unknown = records.join(requirements.select(F.col("id").alias("requirement_id")), "requirement_id", "left_anti").select(F.col("requirement_id").alias("id"), F.lit("unknown_requirement").alias("code"))
    done = records.where("status = 'completed'").groupBy(F.col("requirement_id").alias("id")).count()
    wrong = requirements.select("id").distinct().join(done, "id", "left").where("coalesce(count, 0) != 1").select("id", F.lit("not_exactly_one_completed").alias("code"))
    return twice.unionByName(unknown).unionByName(wrong)


def same_outcomes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two result tables hold the same rows, in any order."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))


def sliding_window(requests: DataFrame, most: int, window_s: int, client: str = "client", at: str = "at") -> DataFrame:
    """Requests with accepted and retry_after: at most ``most`` accepted ones in any window; rejected ones don't count.
    The decision depends on earlier decisions, so it is a fold: per client and *burst*, a burst being cut where the
    pause since the last request reaches the window (nothing before it can count)."""
    import pandas as pd

    w = Window.partitionBy(client).orderBy(at, "seq")
    pause = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    cut = requests.withColumn("__new", (pause.isNull() | (pause >= window_s * 1_000_000)).cast("int")).withColumn("__burst", F.sum("__new").over(w))
    slim = cut.select(client, "__burst", "seq", F.unix_micros(at).alias("us"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        log: deque[int] = deque()
        out = []
        for seq, us in pdf.sort_values(["us", "seq"])[["seq", "us"]].itertuples(index=False):
            while log and us - log[0] >= window_s * 1_000_000:
                log.popleft()
            if len(log) < most:
                log.append(us)
                out.append((seq, True, None))
            else:
                wait = -(-(window_s * 1_000_000 - (us - log[0])) // 1_000_000)
                out.append((seq, False, max(1, min(60, wait))))
        return pd.DataFrame(out, columns=["seq", "accepted", "retry_after"]).astype({"retry_after": "Int32"})

    # bursts don't touch each other; many short ones share a group, which saves calls
    decided = slim.groupBy(client, F.floor(F.col("__burst") / 256)).applyInPandas(fold, "seq long, accepted boolean, retry_after int")
    return requests.join(decided, "seq")
