"""Session memory on a stream: each session keeps its newest turns, within a number of turns and of characters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_TURNS, MOST_CHARS = 6, 1200
OUT = "conv_id bigint, turn bigint, kept bigint, chars bigint"


def trim(history: list[list], most_turns: int = MOST_TURNS, most_chars: int = MOST_CHARS) -> list[list]:
    """The newest ``[turn, size]`` entries that fit; the oldest go first."""
    kept, chars = [], 0
    for turn, size in reversed(history[-most_turns:]):
        chars += size
        if chars > most_chars:
            break
        kept.append([turn, size])
    return kept[::-1]


def remembered(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, kept, chars`` for each turn of a stream (``conv_id, turn, text``): what the session holds once it has come.

    The state of a session is bounded (turn numbers and sizes of six turns); turns of one batch are taken in their order.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = json.loads(state.get[0]) if state.exists else []
        rows = []
        for turn, text in sorted((int(t), x or "") for f in frames for t, x in zip(f["turn"], f["text"], strict=True)):
            history = trim([*history, [turn, len(text)]])
            rows.append((key[0], turn, len(history), sum(size for _, size in history)))
        state.update((json.dumps(history),))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "kept", "chars"])

    return turns.groupBy("conv_id").applyInPandasWithState(update, OUT, "history string", "append", GroupStateTimeout.NoTimeout)
