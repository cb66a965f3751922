"""High-priority complaints to legal actions and the action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.replies import first_readable, parse_fenced_json
from ..functions.scores import high_priority
from ..functions.text import as_column, fill_template, first_items, iso_timestamp, issue_label, literal
from ..schemas import ACTION, ACTION_LOG
from .corpus import keep_first
from .hotspots import KEYS
from .knn import context_of_hits
from .retrieval import ASKED_BY, retrieve
from .skew import HOT_FLOOR, salted_join
from .vectors import TextModel

_PRIORITY = ["call_id", "pincode", "issue_type", "threat_label", "contractor_name", "work_site", "violence_threatened"]


def enrich(silver: DataFrame, gold: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Complaints with the threat of their hotspot.

    ``gold`` is a stored table, of all its columns or of ``hotspot_labels`` alone. Its counts tell which keys are
    hot, so finding them costs no extra pass over the complaints.
    """
    labels = gold.select(*KEYS, "threat_label", "escalate_immediately")
    return salted_join(silver, labels, KEYS, "left", gold, "total_complaints", floor, ["call_id"])


def high_priority_complaints(silver: DataFrame, gold: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Complaints of hotspots that are HIGH or escalated: only those hotspots take part in the join."""
    labels = high_priority(gold).select(*KEYS, "threat_label", "escalate_immediately")
    joined = salted_join(silver, labels, KEYS, "inner", gold, "total_complaints", floor, ["call_id"])
    return joined.select(*_PRIORITY)


def _advice(values: tuple) -> Column:
    sections, steps, portal, urgency = values
    return F.struct(
        literal(sections).alias("bns_sections_cited"), literal(steps).alias("action_steps"),
        F.lit(portal).alias("government_portal"), F.lit(urgency).alias("urgency"),
    )


def fallback_action(issue: Column | str, normalise: bool = True) -> Column:
    """Advice struct for an issue; the default row for issues without advice of their own."""
    key = issue_label(issue) if normalise else as_column(issue)
    rows = [part for name, values in fixed.ADVICE.items() for part in (F.lit(name), _advice(values))]
    return F.coalesce(F.try_element_at(F.create_map(*rows), key), _advice(fixed.ADVICE[fixed.DEFAULT_ADVICE_ISSUE]))


def with_fallback_action(df: DataFrame, normalise: bool = True) -> DataFrame:
    return df.withColumn("action", fallback_action("issue_type", normalise))


def generic_action(threat: Column | str, wording: str = "batch", strict_case: bool = False) -> Column:
    """Advice struct when a reply cannot be read. ``strict_case`` counts only the spelling "High"."""
    sections, steps, portal = fixed.GENERIC_ADVICE[wording]
    threat = as_column(threat)
    high = (threat == "High") if strict_case else (F.upper(threat) == "HIGH")
    return F.struct(
        literal(sections).alias("bns_sections_cited"), literal(steps).alias("action_steps"),
        F.lit(portal).alias("government_portal"), F.when(high, "HIGH").otherwise("MEDIUM").alias("urgency"),
    )


def with_generic_action(df: DataFrame, wording: str = "batch", strict_case: bool = False) -> DataFrame:
    return df.withColumn("action", generic_action("threat_level", wording, strict_case))


def resolve_action(
    df: DataFrame, reply: str = "reply", chunks: str = "retrieved_chunks", normalise: bool = True
) -> DataFrame:
    """Adds ``action``, ``mode`` and ``retrieved_chunks``: a reply that cites sections wins, else the advice table."""
    usable = F.coalesce(F.size(F.col(reply)["bns_sections_cited"]) > 0, F.lit(False))
    found = F.coalesce(F.col(chunks), F.array().cast("array<string>"))
    return df.withColumns({
        "action": F.when(usable, F.col(reply)).otherwise(fallback_action("issue_type", normalise)),
        "mode": F.when(usable, "rag").otherwise("fallback"),
        "retrieved_chunks": F.when(usable, found).otherwise(F.array().cast("array<string>")),
    })


def resolve_or_generic(df: DataFrame, reply: str = "reply", strict_case: bool = False) -> DataFrame:
    """Adds ``action`` and ``mode``: any readable reply, else the generic advice. Retrieved chunks stay."""
    readable = F.col(reply).isNotNull()
    return df.withColumns({
        "action": F.when(readable, F.col(reply)).otherwise(generic_action("threat_level", "batch", strict_case)),
        "mode": F.when(readable, "rag").otherwise("fallback"),
    })


def flatten_action(df: DataFrame) -> DataFrame:
    """The fields of ``action`` as columns."""
    kept = [c for c in df.columns if c != "action"]
    return df.select(*kept, "action.*")


def to_action_log(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Log rows of text only; ``at`` is the time to record (now by default)."""
    action = F.col("action")

    def joined(values: Column, separator: str) -> Column:
        return F.coalesce(F.array_join(values, separator), F.lit(""))

    pincode = F.col("pincode") if "pincode" in df.columns else F.lit(None)
    return df.select(
        F.col("call_id").cast("string").alias("call_id"),
        F.coalesce(F.nullif(pincode.cast("string"), F.lit("")), F.lit(fixed.SENTINEL_PINCODE)).alias("pincode"),
        "issue_type",
        "threat_level",
        joined(action["bns_sections_cited"], ", ").alias("bns_sections_cited"),
        joined(action["action_steps"], " | ").alias("action_steps"),
        F.coalesce(action["government_portal"], F.lit("")).alias("government_portal"),
        F.coalesce(action["urgency"], F.lit("MEDIUM")).alias("urgency"),
        joined(F.col("retrieved_chunks"), ", ").alias("retrieved_chunks"),
        iso_timestamp(F.current_timestamp() if at is None else at).alias("timestamp"),
    ).select(*ACTION_LOG.fieldNames())


def action_metrics(df: DataFrame) -> DataFrame:
    """call_id, sections_cited, action_steps: how much each action holds."""
    def count(name: str) -> Column:
        return F.coalesce(F.size(F.col("action")[name]), F.lit(0)).alias(name)

    return df.select("call_id", count("bns_sections_cited").alias("sections_cited"), count("action_steps"))


def first_steps(df: DataFrame, size: int = 2) -> DataFrame:
    """call_id and the first steps of each action, for a short view."""
    return df.select("call_id", first_items(F.col("action")["action_steps"], size).alias("first_steps"))


def action_requests(asked: DataFrame, contexts: DataFrame) -> DataFrame:
    """Request table for a chat client, one row per distinct issue and threat level."""
    joined = asked.join(contexts, "query_id", "left")
    return joined.select(*ASKED_BY, "query_id", fill_template(fixed.ACTION_PROMPT).alias("prompt"), "retrieved_chunks")


def contexts_for(actions: DataFrame, model: TextModel, vectors: DataFrame, k: int = 3) -> DataFrame:
    """issue_type, threat_level, query_id, context, retrieved_chunks for every distinct question."""
    hits = retrieve(actions, model, vectors, k)
    return hits.groupBy(*ASKED_BY, "query_id").agg(context_of_hits().alias("c")).select(*ASKED_BY, "query_id", "c.*")


def read_replies(replies: DataFrame, order: str | None = None) -> DataFrame:
    """call_id, raw, parsed of the reply that counts for each call: see ``replies.first_readable``."""
    return first_readable(replies, parse_fenced_json, order)


def failed_replies(read: DataFrame) -> DataFrame:
    """call_id and raw of the read replies (``read_replies``) that ``build_legal_actions`` replaces by advice."""
    return read.filter(F.col("parsed").isNull()).select("call_id", "raw")


def build_legal_actions(
    silver: DataFrame,
    gold: DataFrame,
    replies: DataFrame | None = None,
    contexts: DataFrame | None = None,
    on_failure: str = "advice",
    normalise: bool = True,
    at: Column | None = None,
    order: str | None = None,
) -> DataFrame:
    """Action log rows for all high-priority complaints at once.

    ``replies(call_id, raw)`` are answers of a chat client, read here or already (``read_replies``), ``contexts`` the retrieved chunks per issue
    and threat level. ``on_failure`` picks the advice table or the generic advice for the other rows.
    """
    rows = high_priority_complaints(silver, gold).withColumnRenamed("threat_label", "threat_level")
    if replies is not None:
        read = replies if "parsed" in replies.columns else read_replies(replies, order)
        rows = rows.join(read.select("call_id", F.col("parsed").alias("reply")), "call_id", "left")
    else:
        rows = rows.withColumn("reply", F.lit(None).cast(ACTION))
    if contexts is not None:
        # a row per issue and threat level: small enough for Spark to broadcast, else split by adaptive execution
        rows = rows.join(contexts.select(*ASKED_BY, "retrieved_chunks"), ASKED_BY, "left")
    else:
        rows = rows.withColumn("retrieved_chunks", F.lit(None).cast(T.ArrayType(T.StringType())))
    if on_failure == "advice":
        resolved = resolve_action(rows, normalise=normalise)
    elif on_failure == "generic":
        resolved = resolve_or_generic(rows)
    else:
        raise ValueError("on_failure is 'advice' or 'generic'")
    return to_action_log(resolved, at)


def recent_actions(log: DataFrame, n: int = 10, tie: str = "call_id") -> DataFrame:
    return log.orderBy(F.desc("timestamp"), tie).limit(n)


def latest_per_call(log: DataFrame) -> DataFrame:
    """The newest log row of each call, for logs that were appended to more than once."""
    others = [c for c in log.columns if c not in ("call_id", "timestamp")]
    return keep_first(log, ["call_id"], [F.desc("timestamp"), *others])
