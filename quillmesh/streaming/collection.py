"""The citation collection as a stream: keyed state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.collection import ERROR

OUT = "session_id long, seq long, action string, citation_key string, overwrote boolean, size long, accepted boolean"
STATE = "held array<string>"


def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One micro-batch of a session: adds change its entries, an export of a collection that is not empty clears
    them. The state holds the citation keys since the last export; the entries themselves are in the log."""
    held: set[str | None] = set(state.get[0]) if state.exists else set()
    rows = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        overwrote, accepted = False, True
        if r.action == "export":
            accepted, size = bool(held), len(held)
            held = set()
        else:
            text = r.bibtex
            accepted = text is None or bool(text.strip()) and not text.strip().startswith(ERROR)
            if accepted:
                overwrote = r.citation_key in held
                held.add(r.citation_key)
            size = len(held)
        out.append((key[0], r.seq, r.action, r.citation_key, overwrote, size, accepted))
    state.update((list(held),))
    yield pd.DataFrame(out, columns=["session_id", "seq", "action", "citation_key", "overwrote", "size", "accepted"])


def additions(log: DataFrame) -> DataFrame:
    """The outcome of every event of a streaming log, in append mode: whether an add ``overwrote`` an entry, the
    collection's ``size`` after an add or before an export, and whether it was ``accepted``. Within a
    micro-batch events are taken in order of ``seq``; later batches come later."""
    slim = log.select("session_id", "seq", "action", "citation_key", F.col("bibtex"))
    return slim.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
