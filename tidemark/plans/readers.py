"""Readers of drafts (a language model, a rule, a script) over a table: a chain with failover, one outcome a row.

A reader is any function from a row (a dict) to a result (a dict) that can be sent to the tasks. It may return ``None`` (not
mine: the next one is asked) or raise. :class:`Unreadable` ends the row: no other reader is asked. :class:`Refused` says why the reader
takes no rows: a spent quota, a rate, a credential or an unreachable endpoint closes everything behind the same endpoint and credential (its
scope), a model that isn't served closes that reader alone. Any other error gives the next reader its turn and closes nothing. Rows that every
open reader has failed are ``failed``; rows that no open reader took are ``deferred`` and can be asked for again.

What a task has closed it carries to its later rows. What any task of a batch has closed, :meth:`Chain.learn` takes from the outcomes, so
the next batch doesn't ask there again: a service that is down is asked once a task of one batch, not once a task for ever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Reader = Callable[[dict], dict | None]

#: Reasons of a refusal (fixed values): those that close a scope and those that close one reader.
SCOPE_KINDS, READER_KINDS = ("quota", "rate", "auth", "unreachable"), ("auth", "model")
#: The reason that a stopped run names, the gravest first (fixed values).
STOP_KINDS = ("auth", "quota", "rate", "model", "unreachable")


class Unreadable(Exception):
    """The row can't be read by this reader, nor by a later one."""


class Refused(Exception):
    """The reader takes no more rows; ``kind`` says why (``rate`` unless told otherwise)."""

    def __init__(self, message: str = "", kind: str = "rate") -> None:
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Candidate:
    """A reader with its name and its scope, the endpoint and credential that it shares with others; its own name if none is given."""

    name: str
    read: Reader
    scope: str = ""

    @property
    def behind(self) -> str:
        return self.scope or self.name


Closed = tuple[str, str, str]  # what is closed ("scope" or "reader"), its name, and the kind


def _short(error: Exception) -> str:
    return " ".join(str(error).split())[:300]


def _ask(row: dict, candidates: Sequence[Candidate], closed: set[Closed]) -> tuple[str, str | None, str | None, dict | None, list[str]]:
    """``state, answered_by, note, result, turns``; adds to ``closed``."""
    turns: list[str] = []
    note, failed = None if candidates else "no reader", False
    shut = lambda c: next((k for what, name, k in closed if (what, name) in (("reader", c.name), ("scope", c.behind))), None)
    for c in candidates:
        if kind := shut(c):
            note = f"{c.name}: closed"
            turns.append(f"skipped {c.name}: {kind}")
            continue
        try:
            result = c.read(row)
        except Unreadable as e:
            return "failed", c.name, f"Unreadable: {_short(e)}", None, turns
        except Exception as e:  # one reader's error gives the next its turn
            kind = e.kind if isinstance(e, Refused) else type(e).__name__
            closed.update({("scope", c.behind, kind)} if kind in SCOPE_KINDS else set(), {("reader", c.name, kind)} if kind in READER_KINDS else set())
            failed = True
            note = f"{c.name}: {kind}: {_short(e)}"
            turns.append(note)
        else:
            if result is not None:
                return "completed", c.name, None, result, turns
    if failed and not all(shut(c) for c in candidates):
        return "failed", None, note, None, turns
    return "deferred", None, note, None, turns


@dataclass
class Chain:
    """Candidates in the order in which they are asked, and what is closed so far."""

    candidates: Sequence[Candidate]
    closed: set[Closed] = field(default_factory=set)

    def read(self, rows: DataFrame, result: str, *, key: str) -> DataFrame:
        """``key, state, answered_by, note``, the fields of ``result`` (null unless the row was read), ``turns`` (what was tried before) and ``closings``.

        Outcomes come of calls that may cost: write them before they are used twice.
        """
        fields = T._parse_datatype_string(result)
        text, texts = T.StringType(), T.ArrayType(T.StringType())
        closing = T.ArrayType(T.StructType([T.StructField(n, text) for n in ("what", "name", "kind")]))
        heads = [T.StructField("state", text), T.StructField("answered_by", text), T.StructField("note", text)]
        schema = T.StructType([rows.schema[key], *heads, *fields.fields, T.StructField("turns", texts), T.StructField("closings", closing)])
        candidates, before = list(self.candidates), set(self.closed)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            closed = set(before)
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    had = set(closed)
                    state, name, note, got, turns = _ask(row, candidates, closed)
                    new = [dict(zip(("what", "name", "kind"), c, strict=True)) for c in sorted(closed - had)]
                    out.append((row[key], state, name, note, *[(got or {}).get(f.name) for f in fields.fields], turns, new))
                yield pd.DataFrame(out, columns=schema.names)

        return rows.mapInPandas(run, schema)

    def learn(self, outcomes: DataFrame) -> None:
        """Take over what the tasks of a batch have closed: at most a row for each candidate, scope and kind."""
        rows = outcomes.select(F.explode("closings").alias("c")).select("c.*").distinct()
        self.closed |= {(r["what"], r["name"], r["kind"]) for r in rows.collect()}

    def open(self) -> list[str]:
        held = {(what, name) for what, name, _ in self.closed}
        return [c.name for c in self.candidates if ("reader", c.name) not in held and ("scope", c.behind) not in held]

    def stop_kind(self) -> str | None:
        """Why nothing more is asked; null while a candidate is open."""
        kinds = {k for _, _, k in self.closed}
        return None if self.open() else next((k for k in STOP_KINDS if k in kinds), "unreachable")

    def note(self) -> str:
        """The state of every candidate in words; scopes are named by what the caller calls them, so keep credentials out of their names."""
        held = {(what, name): kind for what, name, kind in sorted(self.closed)}
        said = lambda c: f"closed: {held['reader', c.name]}" if ("reader", c.name) in held else "closed with its endpoint" if ("scope", c.behind) in held else "open"
        return "; ".join(f"{c.name} at {c.behind}: {said(c)}" for c in self.candidates)


def read_with(rows: DataFrame, readers: Sequence[tuple[str, Reader]], result: str, *, key: str) -> DataFrame:
    """``key, state, answered_by, note`` and the fields of ``result`` of every row, by a chain of named readers that share nothing."""
    return Chain([Candidate(*r) for r in readers]).read(rows, result, key=key).drop("turns", "closings")
