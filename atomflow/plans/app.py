"""Applications: named generators, workflows, sequencers, splitters and services, and the registry that connects them.

Building an application makes a small plan of named nodes; checking it finds names used twice, services without exactly one
replier and references to nothing; launching it registers each stream as a view, through which other applications reach it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from atomflow.operators.flow import Flow
from atomflow.operators.machines import serve
from atomflow.operators.routing import Sequencer, Splitter

KINDS = ("generators", "workflows", "sequencers", "splitters", "services")


class PlanError(ValueError):
    """An application that can't run."""


class Registry:
    """Streams of launched applications by path: /app/kind/name, with /stream behind generators and workflows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.nodes: dict[str, object] = {}
        self.apps: set[str] = set()

    @staticmethod
    def view(path: str) -> str:
        return "af_" + re.sub(r"\W", "_", path.strip("/"))

    def get(self, path: str):
        """What is registered at a path: a DataFrame, a Sequencer, a Splitter or a service."""
        if path not in self.nodes:
            raise PlanError(f"nothing is registered at {path}")
        return self.nodes[path]

    def stream(self, path: str) -> DataFrame:
        """The stream at a path; for a sequencer, what it merges now."""
        found = self.get(path)
        return found.numbered() if isinstance(found, Sequencer) else found.df if isinstance(found, Flow) else found

    def _add(self, path: str, node: object) -> None:
        if path in self.nodes:
            raise PlanError(f"there is already something at {path}")
        self.nodes[path] = node
        if isinstance(node, DataFrame):
            node.createOrReplaceTempView(self.view(path))


@dataclass
class Service:
    """A request/reply endpoint: the replier turns requests into replies."""

    path: str
    repliers: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def replier(self, f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        self.repliers.append(f)
        return f

    def replier_of(self, events: DataFrame, keys: list[str], on_event: Callable, on_request: Callable, schema: str) -> None:
        """A replier whose events and requests share the memory of their key; see operators.machines.serve."""
        self.repliers.append(lambda requests: serve(events, requests, keys, on_event, on_request, schema))

    def ask(self, requests: DataFrame) -> DataFrame:
        """The requests with their replies."""
        if len(self.repliers) != 1:
            raise PlanError(f"{self.path} has {len(self.repliers)} repliers, not one")
        return self.repliers[0](requests)


class App:
    """Builder of an application. Names that aren't given are $1, $2, ..."""

    def __init__(self, name: str, registry: Registry):
        self.name, self.registry = name, registry
        self.nodes: dict[str, object] = {}
        self.references: list[str] = []
        self.counter, self.frozen = 0, False

    def __enter__(self) -> App:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.launch()

    def _path(self, kind: str, name: str | None) -> str:
        if self.frozen:
            raise PlanError(f"{self.name} is frozen")
        if name is None:
            self.counter += 1
            name = f"${self.counter}"
        path = f"/{self.name}/{kind}/{name}" + ("/stream" if kind in ("generators", "workflows") else "")
        if path in self.nodes:
            raise PlanError(f"{path} is used twice")
        return path

    def generator(self, stream: DataFrame, name: str | None = None) -> DataFrame:
        self.nodes[self._path("generators", name)] = stream
        return stream

    def workflow(self, source: DataFrame | Sequencer, build: Callable[[Flow], Flow | list[Flow]], name: str | None = None) -> DataFrame:
        """A one-input, one-output workflow; if build returns several flows, they share the sink and are united."""
        path = self._path("workflows", name)
        flow = build(Flow(source.numbered() if isinstance(source, Sequencer) else source))
        flows = flow if isinstance(flow, list) else [flow]
        out = flows[0].union(*flows[1:]).sink() if len(flows) > 1 else flows[0].sink()
        self.nodes[path] = out
        return out

    def sequencer(self, *inputs: DataFrame, name: str | None = None, policy: tuple[str, ...] = Sequencer.ROUND_ROBIN) -> Sequencer:
        path = self._path("sequencers", name)
        self.nodes[path] = Sequencer(*inputs, policy=policy)
        return self.nodes[path]

    def splitter(self, stream: DataFrame, name: str | None = None) -> Splitter:
        path = self._path("splitters", name)
        self.nodes[path] = Splitter(stream)
        return self.nodes[path]

    def service(self, name: str | None = None) -> Service:
        path = self._path("services", name)
        self.nodes[path] = Service(path)
        return self.nodes[path]

    def refer(self, path: str):
        """Something that another application has registered."""
        self.references.append(path)
        return self.registry.get(path)

    def connect(self, stream: DataFrame, sequencer: Sequencer) -> None:
        sequencer.connect(stream)

    def check(self) -> None:
        """Finds what would keep the application from running."""
        if self.name in self.registry.apps:
            raise PlanError(f"{self.name} is already running")
        for path, node in self.nodes.items():
            if isinstance(node, Service) and len(node.repliers) != 1:
                raise PlanError(f"{path} has {len(node.repliers)} repliers, not one")
        for path in self.references:
            self.registry.get(path)

    def launch(self) -> App:
        """Checks the plan, freezes it and registers its nodes."""
        self.check()
        self.frozen = True
        self.registry.apps.add(self.name)
        for path, node in self.nodes.items():
            self.registry._add(path, node)
        return self

    def describe(self) -> str:
        """The nodes of the plan, one to a line."""
        return "\n".join(f"{path}: {type(node).__name__}" for path, node in sorted(self.nodes.items()))
