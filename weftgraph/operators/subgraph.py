"""What a task's compute may keep between rounds: a small graph in insertion order, and aggregators."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


class Subgraph:
    """Nodes with neighbours and attributes, in the order they were added."""

    def __init__(self) -> None:
        self._nodes: dict[int, dict[str, Any]] = {}

    def add_node(self, vid: int, attr: Any = None, neighbours: Iterable[int] = ()) -> dict[str, Any]:
        """Adds a node, or returns the one that is there."""
        return self._nodes.setdefault(vid, {"id": vid, "attr": attr, "neighbours": list(neighbours)})

    def add_edge(self, a: int, b: int) -> None:
        """Both ends must be there; an edge is listed once at each end."""
        for x, y in ((a, b), (b, a)):
            if y not in self._nodes[x]["neighbours"]:
                self._nodes[x]["neighbours"].append(y)

    def del_edge(self, a: int, b: int) -> None:
        for x, y in ((a, b), (b, a)):
            if x in self._nodes and y in self._nodes[x]["neighbours"]:
                self._nodes[x]["neighbours"].remove(y)

    def del_node(self, vid: int) -> None:
        """Removes a node and its edges; nothing happens if it isn't there."""
        if self._nodes.pop(vid, None) is not None:
            for node in self._nodes.values():
                if vid in node["neighbours"]:
                    node["neighbours"].remove(vid)

    def has_node(self, vid: int) -> bool:
        return vid in self._nodes

    def get_node(self, vid: int) -> dict[str, Any] | None:
        return self._nodes.get(vid)

    def set_node(self, vid: int, attr: Any = None) -> dict[str, Any]:
        """Adds a node, or sets the attribute of the one that is there; its neighbours stay as they are."""
        node = self.add_node(vid)
        node["attr"] = attr
        return node

    def add_neighbour(self, vid: int, other: int) -> None:
        """Lists other at vid alone, whether or not it is a node here."""
        if other not in self._nodes[vid]["neighbours"]:
            self._nodes[vid]["neighbours"].append(other)

    def nodes(self) -> list[dict[str, Any]]:
        return list(self._nodes.values())

    def __len__(self) -> int:
        return len(self._nodes)

    def rows(self) -> list[dict[str, Any]]:
        """For a state column of type array<struct<id, attr, neighbours>>."""
        return [{**n, "neighbours": list(n["neighbours"])} for n in self.nodes()]

    @classmethod
    def of(cls, rows: Iterable[dict[str, Any]]) -> "Subgraph":
        out = cls()
        for r in rows:
            out.add_node(r["id"], r["attr"], r["neighbours"])
        return out


class Aggregator(ABC):
    """For aggregates that no built-in function states: partials are made in the tasks and merged once each."""

    @abstractmethod
    def initial(self) -> Any: ...

    @abstractmethod
    def step(self, partial: Any, state: dict[str, Any]) -> Any: ...

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, value: Any) -> Any:
        return value

    def over(self, finished: DataFrame) -> Any:
        """The value over finished tasks: a fold in each partition, and merges of these partials on the driver."""
        start, step = self.initial, self.step

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value = start()
            for batch in batches:
                for state in batch.to_pylist():
                    value = step(value, state)
            yield pa.RecordBatch.from_pydict({"partial": pa.array([pickle.dumps(value)], pa.binary())})

        value = start()
        for row in finished.mapInArrow(fold, "partial binary").toLocalIterator():
            value = self.merge(value, pickle.loads(row["partial"]))
        return self.finish(value)
