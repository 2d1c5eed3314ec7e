"""Scorers in processes of their own, so that a call that hangs can be ended and holds up no other."""

from __future__ import annotations

import gc
import multiprocessing
import time
import traceback
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection, wait

import pandas as pd

Scorer = Callable[[pd.Series], pd.Series]

#: Seconds a model may take to be made.
STARTING = 600.0
#: Calls of a task to one model that may be open at once, each in a process of its own.
OPEN = 4
#: The part of its limit after which a call no longer holds up the next.
PATIENCE = 1 / 8


class ScorerUnavailable(Exception):
    """The model could not be reached or took too long. The texts stay as they are."""


class Bounded:
    """Calls a scorer with a limit of ``seconds`` for each text.

    A call past its limit raises ``ScorerUnavailable`` and its process is ended, not waited for;
    the next call starts another. Any other error of the scorer is raised here with its trace.
    """

    def __init__(self, make_scorer: Callable[[str], Scorer], name: str, seconds: float):
        self.make_scorer, self.name, self.seconds = make_scorer, name, seconds
        self.process = self.connection = None

    def ask(self, prompts: list) -> None:
        if self.process is None:
            self._start()
        self.asked, self.limit = len(prompts), self.seconds * max(1, len(prompts))
        self.due = time.monotonic() + self.limit
        self.connection.send(prompts)

    def answers(self, seconds: float) -> list | None:
        """The answers to what was asked; None if they are not there in time but may still come."""
        left = self.due - time.monotonic()
        if seconds < left and not self.connection.poll(seconds):
            return None
        found = self._reply(max(0.0, left))
        if len(found) != self.asked:
            raise RuntimeError(f"{len(found)} answers to {self.asked} prompts")
        return found

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.connection.close()
            self.process = self.connection = None

    def _start(self) -> None:
        # A forked process has the scorer's maker as it is, and needs nothing sent.
        context = multiprocessing.get_context("fork")
        self.connection, theirs = context.Pipe()
        args = (self.make_scorer, self.name, theirs, self.connection)
        self.process = context.Process(target=_serve, args=args, daemon=True)
        self.process.start()
        theirs.close()
        self._reply(STARTING)

    def _reply(self, seconds: float) -> list:
        try:
            if not self.connection.poll(seconds):
                self.close()
                raise ScorerUnavailable
            kind, found = self.connection.recv()
        except EOFError:
            self.close()
            raise RuntimeError("the scorer's process ended") from None
        if kind == "unavailable":
            if found is None:
                self.close()  # the model could not even be made
            raise ScorerUnavailable
        if kind == "error":
            self.close()
            raise RuntimeError(found)
        return found


class Overlapped:
    """Lots of texts put to one model, by one process as long as that answers soon.

    After ``PATIENCE`` of its limit a call is left to its process and another process is asked
    about the next lot, while fewer than ``OPEN`` calls are open. Where a call is ended or raises
    ``ScorerUnavailable`` its texts are asked about one by one, and those that fail alone get None.
    Answers come with their texts' keys, in no order.
    """

    def __init__(self, make_scorer: Callable[[str], Scorer], name: str, seconds: float):
        self.make = lambda: Bounded(make_scorer, name, seconds)
        self.idle: list[Bounded] = []
        self.open: list[tuple[Bounded, list]] = []

    def ask(self, lot: list[tuple[object, str]]) -> Iterator[tuple[object, object]]:
        """The answers that came meanwhile. ``lot`` is of keys and prompts."""
        todo = [lot]
        while todo:
            yield from self._call(todo.pop(), todo)
            yield from self._arrived(todo, OPEN - 1)

    def rest(self) -> Iterator[tuple[object, object]]:
        """The answers still open."""
        todo: list[list] = []
        while self.open or todo:
            if todo:
                yield from self._call(todo.pop(), todo)
            yield from self._arrived(todo, OPEN - 1 if todo else 0)

    def close(self) -> None:
        for scorer in [*self.idle, *(s for s, _ in self.open)]:
            scorer.close()

    def _call(self, lot: list, todo: list) -> Iterator[tuple[object, object]]:
        scorer = self.idle.pop() if self.idle else self.make()
        self.open.append((scorer, lot))
        try:
            scorer.ask([prompt for _, prompt in lot])
        except ScorerUnavailable:
            yield from self._failed(scorer, lot, todo)
            return
        yield from self._settled(scorer, lot, todo, scorer.limit * PATIENCE)

    def _settled(self, scorer: Bounded, lot: list, todo: list, seconds: float) -> Iterator[tuple[object, object]]:
        try:
            found = scorer.answers(seconds)
        except ScorerUnavailable:
            yield from self._failed(scorer, lot, todo)
            return
        if found is not None:
            self._free(scorer)
            yield from zip((key for key, _ in lot), found)

    def _failed(self, scorer: Bounded, lot: list, todo: list) -> Iterator[tuple[object, object]]:
        self._free(scorer)
        if len(lot) == 1:
            yield lot[0][0], None
        else:
            todo.extend([row] for row in lot)

    def _free(self, scorer: Bounded) -> None:
        self.open = [(s, lot) for s, lot in self.open if s is not scorer]
        self.idle.append(scorer)

    def _arrived(self, todo: list, most: int) -> Iterator[tuple[object, object]]:
        """Answers that are there; waits until at most ``most`` calls are open."""
        while True:
            for scorer, lot in self.open:
                yield from self._settled(scorer, lot, todo, 0.0)
            if len(self.open) <= most or todo and most == 0:
                return
            first = min(s.due for s, _ in self.open)
            wait([s.connection for s, _ in self.open], max(0.0, first - time.monotonic()))


def _serve(make_scorer: Callable[[str], Scorer], name: str, connection: Connection, other: Connection) -> None:
    gc.freeze()  # else a collection would copy all pages that are shared with the caller
    other.close()  # else the end of the caller would not be seen here
    try:
        scorer = make_scorer(name)
        connection.send(("ok", []))
    except ScorerUnavailable:
        connection.send(("unavailable", None))
        return
    except BaseException:
        connection.send(("error", traceback.format_exc()))
        return
    while True:
        try:
            prompts = connection.recv()
        except EOFError:
            return
        try:
            found = scorer(pd.Series(prompts, dtype=object))
            connection.send(("ok", [None if pd.isna(a) else a for a in found]))
        except ScorerUnavailable:
            connection.send(("unavailable", []))
        except BaseException:
            connection.send(("error", traceback.format_exc()))
