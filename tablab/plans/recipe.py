"""Replayable cleaning/transformation recipes.

A recipe is an ordered list of steps ``(op, args)``.  ``fit(df)`` runs each
step's fit on the output of the previous steps and stores the fitted
constants (fill values, category lists, scaler parameters, bin edges);
``apply(df)`` replays the steps as projections/filters on any table with the
same columns -- including a stream (see ``tablab.streaming``).  Plans are
immutable, so undo is dropping the last step (no table copies), reset is an
empty list, and a step whose fit fails is never recorded.
"""

from __future__ import annotations

import copy
import datetime
import decimal
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tablab.operators import clean as C
from tablab.operators import transform as X


@dataclass
class OpDef:
    apply: Callable  # (df, params, **args) -> DataFrame
    fit: Callable | None = None  # (df, **args) -> params


def _no_fit_apply(fn):
    return lambda df, params, **args: fn(df, **args)


OPS: dict[str, OpDef] = {
    "drop_duplicates": OpDef(_no_fit_apply(C.drop_duplicates)),
    "drop_nulls": OpDef(_no_fit_apply(C.drop_nulls)),
    "drop_columns": OpDef(_no_fit_apply(C.drop_columns)),
    "rename_column": OpDef(_no_fit_apply(C.rename_column)),
    "cast_column": OpDef(_no_fit_apply(X.cast_column)),
    "fill_nulls": OpDef(
        lambda df, params, c, strategy, value=None: C.apply_fill_nulls(df, c, params),
        lambda df, c, strategy, value=None: C.fit_fill_nulls(df, c, strategy, value),
    ),
    "label_encode": OpDef(lambda df, params, c: X.apply_label_encode(df, c, params), X.fit_label_encode),
    "one_hot": OpDef(lambda df, params, c: X.apply_one_hot(df, c, params), X.fit_one_hot),
    "scale": OpDef(lambda df, params, cols, method="standard": X.apply_scale(df, params), X.fit_scale),
    "log_transform": OpDef(lambda df, params, c: X.apply_log_transform(df, c, params), X.fit_log_transform),
    "bin_equal_width": OpDef(
        lambda df, params, c, n=3, labels=None, as_index=False: X.apply_bin_equal_width(df, c, params, as_index),
        lambda df, c, n=3, labels=None, as_index=False: X.fit_bin_equal_width(df, c, n, labels),
    ),
}


# Constants that JSON has no form for travel as text plus type.
_READERS = {
    "date": datetime.date.fromisoformat,
    "datetime": datetime.datetime.fromisoformat,
    "Decimal": decimal.Decimal,
    "bytes": bytes.fromhex,
}


def _typed(value):
    kind = type(value).__name__
    if kind not in _READERS:
        raise TypeError(f"a recipe cannot hold a constant of type {kind}")
    text = value.hex() if kind == "bytes" else str(value) if kind == "Decimal" else value.isoformat()
    return {"$type": kind, "text": text}


def _untyped(obj: dict):
    return _READERS[obj["$type"]](obj["text"]) if set(obj) == {"$type", "text"} else obj


@dataclass
class Step:
    op: str
    args: dict
    params: dict | None = None

    def describe(self) -> str:
        args = ", ".join(f"{k}={v!r}" for k, v in self.args.items())
        line = f"{self.op}(df, {args})"
        if self.params is not None and self.op in ("fill_nulls", "log_transform"):
            line += f"  # fitted: {self.params}"
        return line


@dataclass
class Recipe:
    steps: list[Step] = field(default_factory=list)

    # ------------------------------------------------------------ R1
    def add(self, op: str, **args) -> Recipe:
        """Append an unfitted step (validated by name only; data checks happen
        at fit time).  Returns a new recipe; the original is unchanged."""
        if op not in OPS:
            raise ValueError(f"unknown operation {op!r}; known: {sorted(OPS)}")
        return Recipe(self.steps + [Step(op, dict(args))])

    def fit(self, df: DataFrame) -> Recipe:
        """Fit every step in order on ``df``; returns the fitted recipe.  If a
        step fails, nothing is recorded and the error names the step."""
        fitted: list[Step] = []
        cur = df
        for i, st in enumerate(self.steps):
            d = OPS[st.op]
            try:
                params = d.fit(cur, **st.args) if d.fit else None
                cur = d.apply(cur, params, **st.args)
            except Exception as e:  # re-raise with the failing step
                raise ValueError(f"step {i} ({st.op}) failed: {e}") from e
            fitted.append(Step(st.op, st.args, params))
        return Recipe(fitted)

    def step(self, df: DataFrame, op: str, **args) -> tuple[Recipe, DataFrame]:
        """Interactive use: fit one more step on the current table ``df``
        (the output of this recipe so far) and return (recipe, new table).
        A failing step raises and leaves the recipe as it was."""
        if op not in OPS:
            raise ValueError(f"unknown operation {op!r}")
        d = OPS[op]
        params = d.fit(df, **args) if d.fit else None
        out = d.apply(df, params, **args)
        return Recipe(self.steps + [Step(op, dict(args), params)]), out

    @property
    def fitted(self) -> bool:
        return all(s.params is not None or OPS[s.op].fit is None for s in self.steps)

    def apply(self, df: DataFrame) -> DataFrame:
        """Replay the fitted steps (projections, filters, small joins)."""
        if not self.fitted:
            raise ValueError("recipe is not fitted; call fit(df) first")
        cur = df
        for st in self.steps:
            cur = OPS[st.op].apply(cur, st.params, **st.args)
        return cur

    # ------------------------------------------------------------ R2 / R3
    def undo(self) -> Recipe:
        return Recipe(self.steps[:-1])

    def reset(self) -> Recipe:
        return Recipe([])

    def script(self) -> list[str]:
        """The log: one line per step, in order."""
        return [s.describe() for s in self.steps]

    # ------------------------------------------------------------ R4
    def to_json(self) -> str:
        steps = [{"op": s.op, "args": s.args, "params": s.params} for s in self.steps]
        return json.dumps({"version": 1, "steps": steps}, default=_typed)

    @staticmethod
    def from_json(text: str) -> Recipe:
        data = json.loads(text, object_hook=_untyped)
        steps = []
        for s in data["steps"]:
            if s["op"] not in OPS:
                raise ValueError(f"unknown operation {s['op']!r}")
            steps.append(Step(s["op"], s["args"], s.get("params")))
        return Recipe(steps)

    def copy(self) -> Recipe:
        return copy.deepcopy(self)
