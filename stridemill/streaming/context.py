"""Streams of steps: recent-action context per task, and retrieval against a fixed model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridemill.operators import scoring
from stridemill.operators.traces import state_text

CONTEXT = (
    "task_id string, t long, env string, goal string, observation string, recent_actions array<string>"
)
STATE = "tasks array<string>, actions array<array<string>>, observations array<string>, seen array<long>"
BUCKETS = 8192


def stream_states(steps: DataFrame, recent: int = 5, idle_ms: int | None = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """State before each arriving step, the streaming twin of ``task_states``.

    Kept per task: the last ``recent`` actions and the last observation, for
    ``idle_ms`` after its latest step (None keeps it, which a run to the end of
    the available data needs: pending timeouts would keep it going). Steps of a task must not arrive in a
    later trigger than their successors; inside a trigger they are put in order.

    Tasks share a state group per hash bucket, so that short tasks cost a call per bucket and not one each. A trigger
    reads and writes the state of the buckets it meets; ``buckets`` stays the same over the life of a query's checkpoint.
    """

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = 0 if idle_ms is None else state.getCurrentProcessingTimeMs()
        known = {}
        if state.exists:
            tasks, *kept = state.get
            known = dict(zip(tasks, zip(*kept, strict=True), strict=True))
        met = {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["task_id", "t"], ignore_index=True)
            tasks = [task if isinstance(task, str) else None for task in rows["task_id"]]
            before, contexts = [], []
            for task, action, seen in zip(tasks, rows["action"], rows["observation"], strict=True):
                actions, observation, _ = met.get(task) or known.get(task) or ([], "", now)
                before.append(observation)
                contexts.append(actions)
                met[task] = ([*actions, action][-recent:], seen, now)
            yield pd.DataFrame({
                "task_id": tasks, "t": rows["t"], "env": rows["env"], "goal": rows["goal"], "observation": before, "recent_actions": contexts,
            })
        # a task that this trigger meets goes on from its state, however late
        kept = {task: held for task, held in known.items() if task not in met and (idle_ms is None or held[2] + idle_ms > now)} | met
        if not kept:
            state.remove()
            return
        state.update((list(kept), *[[held[i] for held in kept.values()] for i in range(3)]))
        if idle_ms is not None:
            state.setTimeoutDuration(max(1, min(held[2] for held in kept.values()) + idle_ms - now))

    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("_bucket")
    return steps.select(bucket, "task_id", "t", "env", "goal", "action", "observation").groupBy("_bucket").applyInPandasWithState(
        advance, CONTEXT, STATE, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def stream_retrieval(
    states: DataFrame, skills: DataFrame, strategy: str, sink: Callable[[DataFrame, int], None], checkpoint: str,
    k: int = 3, level_top_k: dict[str, int] | None = None,
) -> StreamingQuery:
    """Retrieve for every arriving state. Each micro-batch runs the batch retrieval, so results agree with it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select("task_id", "t", state_text(batch).alias("text"))
        sink(scoring.retrieve(asked, skills, strategy, ["task_id", "t"], k, level_top_k), batch_id)

    return states.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
