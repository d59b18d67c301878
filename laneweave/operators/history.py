"""A stretch of edit log, reduced to a shorter log that no state before it can tell from the whole.

Stretches can be reduced apart from each other and put together again, in any
grouping, so a log of any length is folded in parallel. Edits and the undone
are one list with a cursor: undo and redo move the cursor between its ends, an
edit forgets what lies beyond it. Three things make a stretch short:

- what an edit forgets within the stretch goes,
- a removal takes the id's edits out wherever they are, so it only has to be
  kept for what came before the stretch,
- a move that lies between two moves no shorter than itself goes: whatever the
  ends of the list are, the three end where their sum does. What is left of n
  moves are about as many as the root of n.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: An edit puts the cursor at the end: a move up longer than any other.
_TOP = 1 << 62


class History:
    """State before a stretch unknown, or known to be empty (``known``)."""

    def __init__(self, known: bool = False):
        self.known = known
        self.done: list[tuple] = []  # (action, n, id, object) that may touch what came before
        self.gone: dict = {}  # ids removed since the last other entry of ``done``
        self.edits: list = []  # (id, object) after ``done``, None where removed
        self.live = 0
        self.places: dict = {}
        self.moves: list[int] = [_TOP] if known else []

    @classmethod
    def after(cls, current: Iterable[tuple], undone: Iterable[tuple]) -> History:
        """From a state that is known."""
        out = cls(True)
        back = list(undone)
        for e in [*current, *reversed(back)]:
            out._append(e)
        if back:
            out._move(-len(back))
        return out

    def apply(self, action: str, edit_id=None, obj=None, n: int = 1, items: Iterable[tuple] = ()) -> None:
        if action == "undo":
            self._move(-n)
        elif action == "redo":
            self._move(n)
        elif action == "add":
            self._settle()
            self._append((edit_id, obj))
        elif action == "remove":
            self._settle()
            for at in self.places.pop(edit_id, ()):
                if at < len(self.edits) and self.edits[at] is not None and self.edits[at][0] == edit_id:
                    self.edits[at] = None
                    self.live -= 1
            if not self.known:
                self.gone[edit_id] = None
        elif action == "load":
            self.__init__(True)
            self.done.append(("load", 1, None, None))
            for e in items:
                self._append(e)

    def _append(self, e: tuple) -> None:
        self.places.setdefault(e[0], []).append(len(self.edits))
        self.edits.append(e)
        self.live += 1

    def _move(self, step: int) -> None:
        m = self.moves
        if m and (m[-1] < 0) == (step < 0):
            m[-1] = min(m[-1] + step, _TOP)
        else:
            m.append(step)
        while len(m) > 2 and abs(m[-2]) <= min(abs(m[-3]), abs(m[-1])):
            m[-3:] = [max(-_TOP, min(_TOP, m[-3] + m[-2] + m[-1])) if m[-3] != _TOP else _TOP]

    def _settle(self) -> None:
        """An edit follows: what lies beyond the cursor is forgotten."""
        m = self.moves
        if not m or m[0] != _TOP:
            self._flush(m)
        elif len(m) > 1:
            # The first move down is the deepest. It may reach below this stretch.
            if self.known or -m[1] <= self.live:
                self._drop(self.live - self._cursor())
            elif len(m) == 2:
                below = -m[1] - self.live
                self._drop(self.live)
                self._flush([-below])
            else:
                self._flush(m[1:])
        self.moves = [_TOP]

    def _cursor(self) -> int:
        at = self.live
        for step in self.moves[1:] if self.moves[:1] == [_TOP] else self.moves:
            at = max(0, min(self.live, at + step))
        return at

    def _drop(self, n: int) -> None:
        self.live -= n
        while n or (self.edits and self.edits[-1] is None):
            n -= self.edits.pop() is not None

    def _flush(self, moves: list[int]) -> None:
        self.done += self._kept()
        self.gone, self.edits, self.live, self.places = {}, [], 0, {}
        self.done += [("undo" if s < 0 else "redo", abs(s), None, None) for s in moves]

    def _kept(self) -> list[tuple]:
        return [("remove", 1, i, None) for i in self.gone] + [("add", 1, *e) for e in self.edits if e is not None]

    def entries(self) -> Iterator[tuple]:
        """The reduced log: (action, n, id, object)."""
        yield from self.done
        yield from self._kept()
        for s in self.moves:
            if s != _TOP:
                yield ("undo" if s < 0 else "redo", abs(s), None, None)

    def state(self) -> tuple[list[tuple], list[tuple]]:
        """(current, undone), the last undone last; for a history whose start is known."""
        live = [e for e in self.edits if e is not None]
        at = self._cursor()
        return live[:at], live[at:][::-1]
