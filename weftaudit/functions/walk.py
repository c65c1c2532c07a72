"""Walks over the tags of a page that need a stack: linear in the tags, as Arrow functions.

The built-in fold copies its state at each step, which makes a long page quadratic. These
small loops see only tag names, never texts or markup.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Containers whose images are told apart.
PLACES = ("header", "footer", "nav", "article")
_PLACE = "struct<parent:string," + ",".join(f"in_{p}:boolean" for p in PLACES) + ">"


def image_places(marks: list[str], void: frozenset[str], self_ending: frozenset[str]) -> list[dict]:
    """For each ``+img`` the innermost open element and whether the named containers are open.

    Marks are ``+tag`` and ``-tag`` in document order. A closing tag pops to its opener and
    is ignored when there is none, which a count of the open names tells.
    """
    stack: list[str] = []
    opened: dict[str, int] = {}
    out = []
    for mark in marks:
        tag = mark[1:]
        if mark[0] == "+":
            if tag == "img":
                out.append({"parent": stack[-1] if stack else "body", **{f"in_{p}": opened.get(p, 0) > 0 for p in PLACES}})
            if tag not in void and not (tag in self_ending and stack and stack[-1] == tag):
                stack.append(tag)
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag, 0) and tag not in void:
            while True:
                last = stack.pop()
                opened[last] -= 1
                if last == tag:
                    break
    return out


def texts_outside(marks: list[str]) -> list[int]:
    """Places of the ``t`` marks that stand outside all ``+`` ... ``-`` spans; a stray ``-`` counts for nothing."""
    depth, out = 0, []
    for i, mark in enumerate(marks):
        if mark == "+":
            depth += 1
        elif mark == "-":
            depth -= depth > 0
        elif mark == "t" and not depth:
            out.append(i)
    return out


def inputs_of_forms(marks: list[str]) -> list[list[str]]:
    """Ids of the inputs of each form: ``(`` opens a form, ``)`` closes it, other marks are ``i`` and an id."""
    inside, out = False, []
    for mark in marks:
        if mark == "(":
            if not inside:
                out.append([])
            inside = True
        elif mark == ")":
            inside = False
        elif inside and len(mark) > 1:
            out[-1].append(mark[1:])
    return out


def image_places_of(marks: Column, void: list[str], self_ending: list[str]) -> Column:
    v, s = frozenset(void), frozenset(self_ending)
    kind = pa.list_(pa.struct([("parent", pa.string()), *((f"in_{p}", pa.bool_()) for p in PLACES)]))

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([image_places(m or [], v, s) for m in batch.to_pylist()], kind)

    return F.arrow_udf(run, f"array<{_PLACE}>")(marks)


def texts_outside_of(marks: Column) -> Column:
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([texts_outside(m or []) for m in batch.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(marks)


def inputs_of_forms_of(marks: Column) -> Column:
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([inputs_of_forms(m or []) for m in batch.to_pylist()], pa.list_(pa.list_(pa.string())))

    return F.arrow_udf(run, "array<array<string>>")(marks)
