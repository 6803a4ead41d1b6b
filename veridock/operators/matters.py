"""Review matters as event logs: an ordered fold of events into state, with snapshots, in batches and in streams.

The fold of one matter is a small function of its state and an event. A batch sorts
events by matter and sequence and streams them through it, so a task holds one
matter's state and never its events. A snapshot is the state itself: folding later
events onto it gives the rows that folding all events gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Event kinds and the fields that their payloads need.
KINDS = {
    "TITLE_CHANGED": {"title"}, "ISSUE_ADDED": {"issue_id", "question", "work_state", "depends_on"}, "ISSUE_STATE_CHANGED": {"issue_id", "work_state"}, "ISSUE_REQUIRED_FACETS_SET": {"issue_id", "required_facet_ids"},
    "SOURCE_BOUND": {"source_id", "sha256"}, "SOURCE_UNBOUND": {"source_id"},
}
OPTIONAL = {"ISSUE_ADDED": {"required_facet_ids"}}
EVENTS = "matter string, sequence long, expected long, kind string, payload string"
VERDICTS = "matter string, sequence long, accepted boolean, code string, revision long, state string"


def opened(title: str = "") -> dict:
    """The state before the first event."""
    return {"title": title, "revision": 0, "sequence": 0, "issues": {}, "sources": {}}


def apply(state: dict, sequence: int, expected: int | None, kind: str, payload: str | None) -> str | None:
    """Change the state by one event; a code, and no change but of the sequence, if it is refused.

    A null ``expected`` accepts any revision.
    """
    if sequence != state["sequence"] + 1:
        return "SEQUENCE_REPEATED" if sequence <= state["sequence"] else "SEQUENCE_GAP"
    state["sequence"] = sequence
    if expected is not None and expected != state["revision"]:
        return "REVISION_MISMATCH"
    if kind not in KINDS:
        return "UNKNOWN_KIND"
    try:
        said = json.loads(payload or "")
    except (ValueError, RecursionError):
        return "INVALID_PAYLOAD"
    if not isinstance(said, dict) or not KINDS[kind] <= set(said) <= KINDS[kind] | OPTIONAL.get(kind, set()):
        return "INVALID_PAYLOAD"
    code = _change(state, kind, said)
    if code is None:
        state["revision"] += 1
    return code


def _change(state: dict, kind: str, said: dict) -> str | None:
    issues, sources = state["issues"], state["sources"]
    if kind == "TITLE_CHANGED":
        state["title"] = said["title"]
    elif kind == "ISSUE_ADDED":
        if said["issue_id"] in issues:
            return "DUPLICATE_ISSUE"
        if set(said["depends_on"]) - set(issues):
            return "UNKNOWN_DEPENDENCY"
        issues[said["issue_id"]] = {k: said.get(k, []) for k in ("question", "work_state", "depends_on", "required_facet_ids")}
    elif kind in ("SOURCE_BOUND", "SOURCE_UNBOUND"):
        if (kind == "SOURCE_BOUND") == (said["source_id"] in sources):
            return "DUPLICATE_SOURCE" if kind == "SOURCE_BOUND" else "UNKNOWN_SOURCE"
        if kind == "SOURCE_BOUND":
            sources[said["source_id"]] = said["sha256"]
        else:
            del sources[said["source_id"]]
    elif said["issue_id"] not in issues:
        return "UNKNOWN_ISSUE"
    elif kind == "ISSUE_STATE_CHANGED":
        issues[said["issue_id"]]["work_state"] = said["work_state"]
    else:
        facets = said["required_facet_ids"]
        if not facets or len(set(facets)) < len(facets):
            return "INVALID_PAYLOAD"
        if issues[said["issue_id"]]["required_facet_ids"]:
            return "FACETS_ALREADY_SET"
        issues[said["issue_id"]]["required_facet_ids"] = facets
    return None


def fold(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Verdicts on events in order, in columns of ``VERDICTS``; the state stands on the last event of each matter.

    ``events`` are in columns of ``EVENTS``; ``snapshot`` (matter, state) is where a
    matter goes on. Events of one sequence number come in order of kind and payload,
    of which the first counts. A matter's events pass through one task, as each
    depends on the one before, but are not held there.
    """
    rows = events.select("matter", "sequence", "expected", "kind", "payload", F.lit(None).cast("string").alias("state")).where("matter IS NOT NULL AND sequence IS NOT NULL")
    if snapshot is not None:
        start = snapshot.select("matter", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("expected"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("payload"), "state")
        rows = rows.unionByName(start)
    ordered = rows.repartition("matter").sortWithinPartitions("matter", F.col("sequence").asc_nulls_first(), "kind", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matter, state, held = None, None, None
        for batch in batches:
            out = []
            for name, sequence, expected, kind, payload, snap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != matter:
                    if held:
                        out.append((*held, json.dumps(state, ensure_ascii=False, sort_keys=True)))
                    matter, state, held = name, opened(), None
                if sequence is None:
                    state = json.loads(snap)
                    continue
                if held:
                    out.append((*held, None))
                code = apply(state, sequence, expected, kind, payload)
                held = (name, sequence, code is None, code, state["revision"])
            yield _batch(out)
        if held:
            yield _batch([(*held, json.dumps(state, ensure_ascii=False, sort_keys=True))])

    return ordered.mapInArrow(run, VERDICTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string())
    names = [c.split()[0] for c in VERDICTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def states(verdicts: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """matter, state after a fold: of matters with events the last, of others that of the snapshot."""
    last = verdicts.where("state IS NOT NULL").select("matter", "state")
    return last if snapshot is None else last.unionByName(snapshot.select("matter", "state").join(last, "matter", "left_anti"))


def stream_fold(events: DataFrame) -> DataFrame:
    """The verdicts of ``fold`` for a stream: each micro-batch goes on where the state store has left a matter."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else opened()
        rows = sorted((tuple(r) for frame in frames for r in frame[["sequence", "expected", "kind", "payload"]].itertuples(index=False)), key=lambda r: (r[0], r[2] or "", r[3] or ""))
        out = []
        for sequence, expected, kind, payload in rows:
            code = apply(state, int(sequence), None if pd.isna(expected) else int(expected), kind, payload)
            out.append((key[0], int(sequence), code is None, code, state["revision"], None))
        text = json.dumps(state, ensure_ascii=False, sort_keys=True)
        group.update((text,))
        if out:
            out[-1] = (*out[-1][:-1], text)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICTS.split(", ")])

    return events.where("matter IS NOT NULL AND sequence IS NOT NULL").groupBy("matter").applyInPandasWithState(advance, VERDICTS, "state string", "append", GroupStateTimeout.NoTimeout)
