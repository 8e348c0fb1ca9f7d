"""Learning events: idempotent intake, the state they add up to, adaptation, continuity.

A state is decided by few of its events: the last that sets a mastery, the last carried over
from another revision with the passes after it, the last that tells the availability.  So
states are aggregates of latest positions, merged in any order; no key is walked event by
event, and a key of any length is reduced before the shuffle.  Corrections are joined to the
events they reverse first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

KEY = ("learner_id", "project_id", "target_id")
# Tasks that prove more than recall, and the states a mapping may carry over.
QUALIFYING = frozenset("explain_symbol trace_static_relation explain_static_relationship analyze_change_impact separate_fact_inference_unknown".split())
MASTERY = ("unseen", "introduced", "practicing", "demonstrated", "mastered", "needs_review")
STATE_SCHEMA = (
    "learner_id string, project_id string, target_id string, mastery string, availability string, passes long, qualifying_passes long, review_reason string, last_event_id string, events long"
)


def unique_events(events: DataFrame) -> DataFrame:
    """Events without redeliveries: of an idempotency key the smallest event_order and event_id.

    Events without a key are all kept.
    """
    order = Window.partitionBy("idempotency_key").orderBy("event_order", "event_id")
    keyed = events.where("idempotency_key IS NOT NULL").withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")
    return keyed.unionByName(events.where("idempotency_key IS NULL"))


def order_faults(events: DataFrame) -> DataFrame:
    """(event_id, before): events whose order does not rise, or that were made before the one ahead of them."""
    order = Window.partitionBy(*KEY).orderBy("event_order", "event_id")
    prev = F.lag(F.struct("event_order", "created_at", "event_id")).over(order)
    late = (F.col("prev.event_order") >= F.col("event_order")) | (F.col("prev.created_at") > F.col("created_at"))
    return events.select("*", prev.alias("prev")).where(late).select("event_id", F.col("prev.event_id").alias("before"))


OUTCOME = {
    "verdict": "verdict", "task_type": "task_type", "availability": "availability", "mapping": "mapping_status", "from_mastery": "source_mastery_status",
    "from_passes": "source_verified_pass_count", "from_qualifying": "source_qualifying_pass_count", "reverses": "reverses_event_id", "new_verdict": "corrected_verdict",
}


def outcomes(events: DataFrame) -> DataFrame:
    """Events with the fields of their outcome as columns; null where it is no JSON or lacks them."""
    got = {c: F.get_json_object("validated_outcome_json", f"$.{f}") for c, f in OUTCOME.items()}
    got |= {c: got[c].cast("int") for c in ("from_passes", "from_qualifying")}
    return events.select(*KEY, "event_id", "idempotency_key", "event_order", "event_type", "provenance", "task_id", *[v.alias(c) for c, v in got.items()])


def with_verdicts(events: DataFrame) -> DataFrame:
    """``outcomes`` with the verdict and task type of the last correction that reverses an event in place of its own."""
    rows = outcomes(events)
    fixes = (
        rows.where("event_type = 'evaluation_corrected' AND reverses IS NOT NULL")
        .groupBy(F.col("reverses").alias("event_id"))
        .agg(F.max(F.struct("event_order", F.col("event_id").alias("by"), "new_verdict", "task_type")).alias("fix"))
    )
    fixed = lambda own, new: F.when(F.col("fix").isNotNull(), F.col(f"fix.{new}")).otherwise(F.col(own)).alias(own)
    joined = rows.drop("new_verdict", "reverses").join(fixes, "event_id", "left")
    return joined.select(*[c for c in joined.columns if c not in ("fix", "verdict", "task_type")], fixed("verdict", "new_verdict"), fixed("task_type", "task_type"))


# What an event class does to a state; a class that is not named sets nothing.
#: mastery set outright (None: worked out from the passes, or carried over), and the reason for review
SETS = {"pass": (None, ""), "fail": (None, "validated_failure"), "moved": ("needs_review", "revision_"), "carried": (None, ""), "lost": ("needs_review", "revision_")}
#: classes that only lift a state from below: from which states, to which
LIFTS = {"partial": (("unseen", "introduced", "practicing"), "practicing"), "reported": (("unseen",), "introduced")}
EXACT = ("unchanged_exact", "renamed_exact")
SHAKEN = ("changed", "missing", "ambiguous", "stale")


def event_class(kind, provenance, verdict, task, availability, mapping) -> Column:
    """reported, pass, partial, fail, tried, moved, settled, carried, lost, or null for an event that changes nothing."""
    tried = (kind == "attempt_evaluated") & (provenance == "verified_assessment")
    return (
        F.when(provenance == "explicit_self_report", "reported")
        .when(tried & (verdict == "pass") & (task != ""), "pass")
        .when(tried & verdict.isin("partial", "fail"), verdict)
        .when(tried, "tried")
        .when(kind == "revision_revalidated", F.when(F.coalesce(F.nullif(availability, F.lit("")), F.lit("stale")).isin(*SHAKEN), "moved").otherwise("settled"))
        .when((kind == "continuity_state_derived") & (provenance == "revision_continuity"), F.when(mapping.isin(*EXACT), "carried").otherwise("lost"))
    )


def learning_states(events: DataFrame) -> DataFrame:
    """The mastery state of each learner and target after all events, in event order.

    Redeliveries count once, equal orders go by event_id; null keys form keys of their own.
    Late events count where their order puts them.
    """
    c = F.col
    told = F.coalesce(F.nullif("availability", F.lit("")), F.lit("stale"))
    rows = with_verdicts(unique_events(events)).withColumn("did", event_class(c("event_type"), c("provenance"), c("verdict"), c("task_id"), c("availability"), c("mapping")))
    did = lambda *names: c("did").isin(*names)
    at = F.struct("event_order", "event_id").alias("at")
    last = lambda when, *more: F.max(F.when(when, F.struct(at, *more)))
    came = F.when(F.coalesce(c("from_mastery"), F.lit("unseen")).isin(*MASTERY), F.coalesce(c("from_mastery"), F.lit("unseen"))).otherwise("needs_review")
    reason = F.when(did("moved"), F.concat(F.lit("revision_"), told)).when(did("lost"), F.concat(F.lit("revision_"), F.coalesce(F.nullif("mapping", F.lit("")), F.lit("unmapped"))))
    parts = {
        "last": last(F.lit(True)),
        "setter": last(did(*SETS), "did", F.when(did("carried"), came).alias("came"), F.coalesce(reason, F.when(did("fail"), "validated_failure"), F.lit("")).alias("why")),
        "carried": last(did("carried"), F.greatest(F.coalesce("from_passes", F.lit(0)), F.lit(0)).alias("passes"), F.greatest(F.coalesce("from_qualifying", F.lit(0)), F.lit(0)).alias("qualifying")),
        "told": last(did("pass", "partial", "fail", "tried", "moved", "settled", "carried", "lost"), F.when(did("moved", "settled", "carried", "lost"), told).otherwise("current").alias("availability")),
        "partial": last(did("partial")),
        "reported": last(did("reported")),
    }
    # latest positions per task first: a pass counts once a task, and only after what was carried over last
    tasks = written(
        rows.groupBy(*KEY, F.when(did("pass"), c("task_id")).alias("task")).agg(
            F.count("*").alias("n"), *[v.alias(k) for k, v in parts.items()], last(did("pass")).alias("passed"), last(did("pass") & c("task_type").isin(*QUALIFYING)).alias("qualified")
        )
    )
    heads = tasks.groupBy(*KEY).agg(F.sum("n").alias("events"), *[F.max(k).alias(k) for k in parts])
    floor = heads.select(*[c(k).alias(f"_{k}") for k in KEY], c("carried.at").alias("_from"))
    same = [c(k).eqNullSafe(c(f"_{k}")) for k in KEY]
    after = lambda what: c("_from").isNull() | (c(f"{what}.at") > c("_from"))
    held = (
        tasks.where("passed IS NOT NULL").select(*KEY, "passed", "qualified").join(floor, same)
        .groupBy(*[c(f"_{k}") for k in KEY])
        .agg(F.count_if(after("passed")).alias("own"), F.count_if(c("qualified").isNotNull() & after("qualified")).alias("own_qualifying"))
    )
    state = heads.join(held, same, "left")
    passes = F.coalesce("own", F.lit(0)) + F.coalesce("carried.passes", F.lit(0))
    qualifying = F.coalesce("own_qualifying", F.lit(0)) + F.coalesce("carried.qualifying", F.lit(0))
    base = (
        F.when(c("setter").isNull(), "unseen")
        .when(c("setter.did") == "pass", F.when((passes >= 2) & (qualifying >= 1), "mastered").otherwise("demonstrated"))
        .when(c("setter.did") == "fail", F.when(passes > 0, "needs_review").otherwise("practicing"))
        .otherwise(F.coalesce("setter.came", F.lit("needs_review")))
    )
    since = lambda what: c(what).isNotNull() & (c("setter").isNull() | (c(f"{what}.at") > c("setter.at")))
    mastery = c("base")
    for what in ("reported", "partial"):
        mastery = F.when(since(what) & c("base").isin(*LIFTS[what][0]), LIFTS[what][1]).otherwise(mastery)
    return state.withColumn("base", base).select(
        *KEY, mastery.alias("mastery"), F.coalesce("told.availability", F.lit("current")).alias("availability"), passes.cast("long").alias("passes"),
        qualifying.cast("long").alias("qualifying_passes"), F.coalesce("setter.why", F.lit("")).alias("review_reason"), c("last.at.event_id").alias("last_event_id"), "events",
    )


def learner_depth(states: DataFrame) -> DataFrame:
    """(learner_id, targets, a count per state, depth) of each learner."""
    counts = [F.count_if(F.col("mastery") == m).alias(m) for m in MASTERY]
    depth = (
        F.when(F.col("needs_review") > 0, "foundational_review").when(F.col("mastered") > 0, "advanced").when(F.col("demonstrated") > 0, "intermediate").otherwise("novice")
    )
    return states.groupBy("learner_id").agg(F.count("*").alias("targets"), *counts).withColumn("depth", depth)


def review_queue(states: DataFrame, most: int = 16) -> DataFrame:
    """The first ``most`` targets of each learner to look at again, by state, then target."""
    rank = F.lit(len(MASTERY))
    for i, m in enumerate(("needs_review", "practicing", "introduced", "demonstrated", "mastered")):
        rank = F.when(F.col("mastery") == m, i).otherwise(rank)
    order = Window.partitionBy("learner_id").orderBy(rank, "project_id", "target_id")
    return states.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("learner_id", "project_id", "target_id", "mastery", "place")


def next_orders(events: DataFrame) -> DataFrame:
    """(learner_id, project_id, target_id, next_order): the order the next event of a target gets."""
    return events.groupBy(*KEY).agg((F.max("event_order") + 1).alias("next_order"))


def rubric_verdicts(criteria: DataFrame, attempt: str, weight: Column, passed: Column, critical: Column) -> DataFrame:
    """(attempt, ratio, verdict): pass with no critical criterion failed and .8 of the weight, else partial above 0, else fail."""
    ratio = F.round(F.coalesce(F.sum(F.when(passed, weight).otherwise(0.0)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)), 6)
    rows = criteria.groupBy(attempt).agg(ratio.alias("ratio"), F.count_if(critical & ~passed).alias("broken"))
    verdict = F.when((F.col("broken") == 0) & (F.col("ratio") >= 0.8), "pass").when(F.col("ratio") > 0, "partial").otherwise("fail")
    return rows.select(attempt, "ratio", verdict.alias("verdict"))


def continuity(diff: DataFrame) -> DataFrame:
    """(new_id, path, status, target): what became of each path of the older snapshot.

    From a manifest diff: unchanged_exact, renamed_exact, modified or deleted.
    """
    old = F.coalesce("old_path", "path")
    status = F.when(F.col("change") == "unchanged", "unchanged_exact").when(F.col("change") == "renamed", "renamed_exact").otherwise(F.col("change"))
    return diff.where("change != 'added'").select("new_id", old.alias("path"), status.alias("status"), F.when(F.col("change") != "deleted", F.col("path")).alias("target"))


def plan_is_acyclic(steps: int, edges: list[tuple[int, int]]) -> bool:
    """Whether a plan of at most 20 steps and 40 edges has an order."""
    if steps > 20 or len(edges) > 40:
        raise ValueError("a plan has at most 20 steps and 40 edges")
    waiting = dict.fromkeys(range(steps), 0)
    for _, b in edges:
        waiting[b] += 1
    ready = [s for s, n in waiting.items() if n == 0]
    done = 0
    while ready:
        a = ready.pop()
        done += 1
        for x, b in edges:
            if x == a:
                waiting[b] -= 1
                if waiting[b] == 0:
                    ready.append(b)
    return done == steps


def targets(events: DataFrame) -> DataFrame:
    """(learner_id, project_id, target_id, first_seen, last_seen, attempts, evaluations): the targets learners work on."""
    return unique_events(events).groupBy(*KEY).agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.countDistinct("attempt_id").alias("attempts"), F.countDistinct("evaluation_id").alias("evaluations")
    )


def states_of_targets(known: DataFrame, states: DataFrame) -> DataFrame:
    """(learner_id, project_id, target_id, mastery, place): every target with its state, ``unseen`` without one.

    ``place`` orders a learner's targets: by state, the last seen first, then by project and target.
    """
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    rows = known.join(states.select(*[F.col(k).alias(f"_{k}") for k in KEY], "mastery"), same, "left").withColumn("mastery", F.coalesce("mastery", F.lit("unseen")))
    rank = F.array_position(F.array(*map(F.lit, ("needs_review", "practicing", "introduced", "demonstrated", "mastered", "unseen"))), F.col("mastery"))
    order = Window.partitionBy("learner_id").orderBy(rank, F.desc("last_seen"), "project_id", "target_id")
    return rows.select(*KEY, "mastery", F.row_number().over(order).cast("long").alias("place"))


def next_actions(ordered: DataFrame) -> DataFrame:
    """(learner_id, action, project_id, target_id): what a learner does next, from ``states_of_targets``: review, practise, prove, or start."""
    first = ordered.groupBy("learner_id").agg(F.min(F.struct("place", "project_id", "target_id", "mastery")).alias("f"))
    m = F.col("f.mastery")
    action = F.when(m == "needs_review", "review").when(m.isin("practicing", "introduced"), "practise").when(m == "demonstrated", "prove").when(m == "mastered", "done").otherwise("start")
    return first.select("learner_id", action.alias("action"), "f.project_id", "f.target_id")


def last_events(events: DataFrame, most: int = 8) -> DataFrame:
    """(learner_id, event_id, place): the last events of each learner, the latest first."""
    order = Window.partitionBy("learner_id").orderBy(F.desc("created_at"), F.desc("event_order"), F.desc("event_id"))
    return unique_events(events).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("learner_id", "event_id", "place")


def state_audit(stored: DataFrame, made: DataFrame) -> DataFrame:
    """(learner_id, project_id, target_id, fault): stored states against those made anew from the events.

    missing, orphan, stale_mastered (stored as mastered though its availability is not current), or
    the first column that differs: mastery, availability, passes, qualifying_passes,
    review_reason, last_event_id, events.
    """
    columns = ("mastery", "availability", "passes", "qualifying_passes", "review_reason", "last_event_id", "events")
    side = lambda df, p: df.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEY], F.lit(True).alias(f"{p}_is"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    rows = side(stored, "s").join(side(made, "m"), list(KEY), "full")
    fault = F.when(F.col("s_is").isNull(), "missing").when(F.col("m_is").isNull(), "orphan").when((F.col("s_mastery") == "mastered") & (F.col("s_availability") != "current"), "stale_mastered")
    for c in columns:
        fault = fault.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"m_{c}")), c)
    return rows.select(*KEY, fault.alias("fault")).where("fault IS NOT NULL")


def target_checks(known: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, path, status): what became of targets (name, path, digest) between two chunk lists of (name, path, digest).

    Seven statuses, the first that holds: unchanged_exact (same path and digest), renamed_exact
    (the one chunk of that digest, elsewhere), modified (same path and name), moved (the one
    of that name, elsewhere), ambiguous (several of that digest or name), unmapped (nothing
    of it), or invalid_source if the target is not in the older list.  A chunk that several
    targets map to is ambiguous for all of them.
    """
    c = F.col
    has = old.select("name", "path", "digest").distinct().withColumn("there", F.lit(True))
    exact = new.select("name", "path", "digest").distinct().withColumn("same", F.lit(True))
    by_path = new.groupBy("name", "path").agg(F.count("*").alias("at_path"))
    by_digest = new.groupBy("digest").agg(F.countDistinct("path", "name").alias("of_digest"), F.min(F.struct("path", "name")).alias("to_digest"))
    by_name = new.groupBy("name").agg(F.countDistinct("path").alias("of_name"), F.min("path").alias("to_name"))
    rows = known.select("name", "path", "digest").distinct().join(has, ["name", "path", "digest"], "left").join(exact, ["name", "path", "digest"], "left").join(by_path, ["name", "path"], "left").join(by_digest, "digest", "left").join(by_name, "name", "left")
    status = (
        F.when(c("there").isNull(), "invalid_source").when(c("same"), "unchanged_exact").when(c("of_digest") == 1, "renamed_exact").when(c("of_digest") > 1, "ambiguous").when(c("at_path") > 0, "modified")
        .when(c("of_name") == 1, "moved").when(c("of_name") > 1, "ambiguous").otherwise("unmapped")
    )
    to = F.when(status == "renamed_exact", F.concat_ws("\t", "to_digest.path", "to_digest.name")).when(status == "moved", F.concat_ws("\t", "to_name", "name"))
    rows = rows.select("name", "path", status.alias("status"), to.alias("to"))
    clash = F.col("to").isNotNull() & (F.count("*").over(Window.partitionBy("to")) > 1)
    return rows.select("name", "path", F.when(clash, "ambiguous").otherwise(F.col("status")).alias("status"))


def published_states(states: DataFrame, mappings: DataFrame) -> DataFrame:
    """(learner_id, project_id, target_id, mastery, review_reason): states carried into a new revision.

    ``mappings``: the key and a status as of ``target_checks``.  An exact mapping keeps the
    state, a modified target has to be reviewed, any other is left behind.
    """
    exact = F.col("status").isin(*EXACT)
    rows = states.join(mappings.select(*KEY, "status"), list(KEY)).where(exact | (F.col("status") == "modified"))
    return rows.select(*KEY, F.when(exact, F.col("mastery")).otherwise("needs_review").alias("mastery"), F.when(exact, "").otherwise("revision_modified").alias("review_reason"))


def goal_lineage(goals: DataFrame, mappings: DataFrame) -> DataFrame:
    """(learner_id, goal_id, targets, lineage): what becomes of goals (learner_id, goal_id, project_id, target_id) in a new revision.

    carried if every target is mapped exactly, history_only if none is mapped at all, else
    needs_review.
    """
    rows = goals.select("learner_id", "goal_id", "project_id", "target_id").distinct().join(mappings.select(*KEY, "status"), list(KEY), "left")
    exact = F.coalesce(F.col("status").isin(*EXACT), F.lit(False))
    some = exact | F.coalesce(F.col("status").isin("modified", "moved"), F.lit(False))
    out = rows.groupBy("learner_id", "goal_id").agg(F.count("*").alias("targets"), F.bool_and(exact).alias("all"), F.bool_or(some).alias("any"))
    return out.select("learner_id", "goal_id", "targets", F.when(F.col("all"), "carried").when(F.col("any"), "needs_review").otherwise("history_only").alias("lineage"))


def fitted(rows: DataFrame, by: str, order: list[Column], text: Column, most_bytes: int = 16_384) -> DataFrame:
    """The first rows of each group whose texts fit the byte limit together, with ``used`` bytes so far and ``truncated``."""
    window = Window.partitionBy(by).orderBy(*order)
    used = rows.withColumn("used", F.sum(F.octet_length(text)).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return used.withColumn("truncated", F.max("used").over(Window.partitionBy(by)) > most_bytes).where(F.col("used") <= most_bytes)


def task_checks(events: DataFrame, states: DataFrame) -> DataFrame:
    """(learner_id, project_id, target_id, task_id, status): the tasks of the events and whether they still stand.

    ``stale`` if what is known of the target is not current, ``passed`` if an attempt at it passed
    (corrections counted), else ``open``.
    """
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    passed = (F.col("event_type") == "attempt_evaluated") & (F.col("provenance") == "verified_assessment") & (F.col("verdict") == "pass")
    tasks = with_verdicts(unique_events(events)).where("task_id IS NOT NULL").groupBy(*KEY, "task_id").agg(F.bool_or(F.coalesce(passed, F.lit(False))).alias("passed"))
    rows = tasks.join(states.select(*[F.col(k).alias(f"_{k}") for k in KEY], "availability"), same, "left")
    status = F.when(F.coalesce("availability", F.lit("current")) != "current", "stale").when(F.col("passed"), "passed").otherwise("open")
    return rows.select(*KEY, "task_id", status.alias("status"))
