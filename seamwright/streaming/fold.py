"""Learning states as a stream: the events of a learner and target are kept between batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import learning as ln

STATE = "learner_id string, project_id string, target_id string, state string"
FIELDS = ("event_order", "event_id", "event_type", "provenance", "task_id", *ln.OUTCOME)
COLUMNS = [c.split()[0] for c in ln.STATE_SCHEMA.split(", ")]


def stream_states(events: DataFrame) -> DataFrame:
    """Mastery states after each batch, for the keys the batch touched (update mode).

    ``events`` are rows as they are delivered.  The fields that matter of every event of a key
    stay in its state, by idempotency key, so that late events, corrections of earlier batches
    and redeliveries come to what the batch operator makes of the whole table.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[str, list] = json.loads(kept.get[3]) if kept.exists else {}
        for pdf in batches or ():
            rows = pdf.astype(object).where(pdf.notna(), None)
            for e in rows.itertuples(index=False):
                event = [None if v is None else int(v) if f in ("event_order", "from_passes", "from_qualifying") else v for f, v in ((f, getattr(e, f)) for f in FIELDS)]
                name = f"k{e.idempotency_key}" if e.idempotency_key is not None else f"e{e.event_id}"
                if name not in seen or _at(event) < _at(seen[name]):
                    seen[name] = event
        kept.update((*key, json.dumps(seen)))
        yield pd.DataFrame([(*key, *state_of(seen.values()))], columns=COLUMNS)

    return ln.outcomes(events).groupBy(*ln.KEY).applyInPandasWithState(fold, ln.STATE_SCHEMA, STATE, "update", GroupStateTimeout.NoTimeout)


def _at(event: list) -> tuple:
    """Position of an event; nulls come first."""
    return (event[0] is not None, event[0] or 0, event[1] is not None, event[1] or "")


def state_of(events) -> tuple:
    """(mastery, availability, passes, qualifying passes, reason, last event, events) of one key's events."""
    events = sorted(events, key=_at)
    rows = [dict(zip(FIELDS, e)) for e in events]
    fixes = {r["reverses"]: r for r in rows if r["event_type"] == "evaluation_corrected" and r["reverses"] is not None}
    state = {"mastery": "unseen", "availability": "current", "why": ""}
    tasks: dict[str, bool] = {}  # passed, and whether it qualifies
    carried = (0, 0)
    for r in rows:
        fix = fixes.get(r["event_id"])
        verdict, kind = (fix["new_verdict"], fix["task_type"]) if fix else (r["verdict"], r["task_type"])
        did = _class(r, verdict)
        told = r["availability"] or "stale"
        if did == "pass":
            tasks[r["task_id"]] = tasks.get(r["task_id"], False) or kind in ln.QUALIFYING
        if did == "carried":
            tasks, carried = {}, (max(0, r["from_passes"] or 0), max(0, r["from_qualifying"] or 0))
        if did in ln.LIFTS and state["mastery"] in ln.LIFTS[did][0]:
            state["mastery"] = ln.LIFTS[did][1]
        if did in ln.SETS:
            to, why = ln.SETS[did]
            many, good = len(tasks) + carried[0], sum(tasks.values()) + carried[1]
            worked = {
                "pass": "mastered" if many >= 2 and good else "demonstrated",
                "fail": "needs_review" if many else "practicing",
                "carried": (r["from_mastery"] or "unseen") if (r["from_mastery"] or "unseen") in ln.MASTERY else "needs_review",
            }
            state["mastery"] = to or worked[did]
            state["why"] = why + {"moved": told, "lost": r["mapping"] or "unmapped"}.get(did, "")
        if did in ("pass", "partial", "fail", "tried"):
            state["availability"] = "current"
        elif did in ("moved", "settled", "carried", "lost"):
            state["availability"] = told
    last = rows[-1]["event_id"] if rows else None
    return state["mastery"], state["availability"], len(tasks) + carried[0], sum(tasks.values()) + carried[1], state["why"], last, len(rows)


def _class(r: dict, verdict) -> str | None:
    """As ``learning.event_class``, of one event."""
    kind, by = r["event_type"], r["provenance"]
    if by == "explicit_self_report":
        return "reported"
    if (kind, by) == ("attempt_evaluated", "verified_assessment"):
        return "pass" if verdict == "pass" and r["task_id"] else verdict if verdict in ("partial", "fail") else "tried"
    if kind == "revision_revalidated":
        return "moved" if (r["availability"] or "stale") in ln.SHAKEN else "settled"
    if (kind, by) == ("continuity_state_derived", "revision_continuity"):
        return "carried" if r["mapping"] in ln.EXACT else "lost"
    return None


def stream_unique(events: DataFrame, watermark: str = "7 days") -> DataFrame:
    """A stream without redeliveries of an idempotency key within the watermark."""
    return events.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["idempotency_key"])
