"""Flows: a graph of typed operators in JSON, checked and compiled into lazy DataFrames."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..frames import map_images
from ..spec import FlowError, find


@dataclass
class Node:
    id: str
    type_id: str
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    #: input port -> (node, output port)
    inputs: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Flow:
    id: str
    nodes: dict[str, Node]

    def order(self) -> list[str]:
        """Every node after what it reads, the least id first where there is a choice; a cycle is an error."""
        needs = {n.id: {s for s, _ in n.inputs.values()} for n in self.nodes.values()}
        if missing := {s for v in needs.values() for s in v} - set(needs):
            raise FlowError(f"no such node: {', '.join(sorted(missing))}")
        users: dict[str, list[str]] = {n: [] for n in needs}
        for n, sources in needs.items():
            for s in sources:
                users[s].append(n)
        ready = [n for n, v in needs.items() if not v]
        heapq.heapify(ready)
        left, out = {n: len(v) for n, v in needs.items()}, []
        while ready:
            n = heapq.heappop(ready)
            out.append(n)
            for u in users[n]:
                left[u] -= 1
                if not left[u]:
                    heapq.heappush(ready, u)
        if len(out) < len(needs):
            raise FlowError(f"cyclic dependency among {', '.join(sorted(set(needs) - set(out)))}")
        return out


def parse(text: str | dict) -> Flow:
    """Both dialects: nodes with `type_id` and `inputs`, or with `type` and a list of `connections`.

    Only booleans, numbers and strings are parameters. Connections whose ends are unknown are left out, as editors
    leave them behind; a node of unknown type is an error.
    """
    raw = json.loads(text) if isinstance(text, str) else text
    nodes: dict[str, Node] = {}
    for n in raw.get("nodes", []):
        type_id = n.get("type_id", n.get("type"))
        find(type_id)
        params = {k: v for k, v in (n.get("params") or {}).items() if isinstance(v, bool | int | float | str)}
        inputs = {p: (s["source_node"], s.get("source_port", "")) for p, s in (n.get("inputs") or {}).items() if isinstance(s, dict) and "source_node" in s}
        nodes[str(n["id"])] = Node(str(n["id"]), type_id, params, n.get("enabled", not n.get("disabled", False)), inputs)
    for c in raw.get("connections", []):
        a, b = str(c.get("fromNode")), str(c.get("toNode"))
        if a not in nodes or b not in nodes:
            continue
        ports = find(nodes[b].type_id).inputs
        to = c.get("toPort", 0)
        to = ports[to] if isinstance(to, int) and to < len(ports) else to
        if to in ports:
            nodes[b].inputs[to] = (a, str(c.get("fromPort", "")))
    return Flow(str(raw.get("id", "flow")), nodes)


def load(path: str) -> Flow:
    return parse(Path(path).read_text(encoding="utf-8"))


def run(flow: Flow, sources: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The output of every node, unevaluated. `sources` feeds input ports that no node feeds, by `node.port` or `port`.

    A chain of image operators with one reader each becomes a single pass over the frames. A disabled node and
    all that depends on it give nothing.
    """
    sources, outputs = sources or {}, {}
    readers: dict[str, int] = {}
    for n in flow.nodes.values():
        for s, _ in n.inputs.values():
            readers[s] = readers.get(s, 0) + 1
    chains: dict[str, tuple[DataFrame, list]] = {}
    for name in flow.order():
        node = flow.nodes[name]
        op = find(node.type_id)
        params = op.bind(node.params)
        if not node.enabled or any(s not in outputs for s, _ in node.inputs.values()):
            continue
        given = {p: outputs[s] for p, (s, _) in node.inputs.items()}
        for p in op.inputs:
            if p not in given:
                source = sources.get(f"{name}.{p}", sources.get(p))
                if source is None:
                    raise FlowError(f"{name}: input {p} is required")
                given[p] = source
        if op.kernel is not None and op.inputs == ("image",):
            before = node.inputs.get("image", (None,))[0]
            base, steps = chains[before] if before in chains and readers.get(before) == 1 else (given["image"], [])
            chains[name] = base, [*steps, partial(op.kernel, **params)]
            outputs[name] = map_images(base, *chains[name][1])
        elif op.family == "geometry":
            source = sources.get(f"{name}.row", sources.get("row"))
            if source is None:
                raise FlowError(f"{name}: a table of parameters is required as row")
            outputs[name] = op.plan(source, **params)
        else:
            outputs[name] = op.plan(**given, **params)
    return outputs
