"""Pipelines: ordered stages wired by named or positional streams, validated before any job runs.

A stage is a function from a list of DataFrames to a list of DataFrames. A pipeline composes
stages lazily, so Spark plans across stage borders.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Stage = Callable[[list[DataFrame]], list[DataFrame]]


class PipelineError(ValueError):
    """A pipeline that cannot run as specified."""


@dataclass(frozen=True)
class Registered:
    name: str
    inputs: int
    outputs: int
    run: Stage


class Registry(dict):
    """Stages by name; ``@registry.stage("cat", 1, 1)`` adds one."""

    def stage(self, name: str, inputs: int = 1, outputs: int = 1):
        def add(fn):
            self[name] = Registered(name, inputs, outputs, fn)
            return fn

        return add


@dataclass(frozen=True)
class Io:
    """An input or output of a stage: unnamed (positional), named, or at a URI."""

    name: str | None = None
    uri: str | None = None

    @classmethod
    def parse(cls, spec, source: bool) -> "Io":
        """A string (a URI if it has a ':', else a name) or a mapping of ``name`` and ``uri``."""
        if isinstance(spec, Io):
            io = spec
        elif isinstance(spec, str):
            io = cls(uri=spec) if ":" in spec else cls(name=spec)
        elif isinstance(spec, Mapping):
            if unknown := set(spec) - {"name", "uri"}:
                raise PipelineError(f"unknown keys {sorted(unknown)}")
            io = cls(spec.get("name"), spec.get("uri"))
        else:
            raise PipelineError(f"not an input or output: {spec!r}")
        if source and io.name and io.uri:
            raise PipelineError("an input has a name or a URI, not both")
        if io.uri is not None and io.uri.split(":", 1)[0] not in ("file", "store"):
            raise PipelineError(f"no such scheme: {io.uri}")
        return io


@dataclass(frozen=True)
class Step:
    stage: Registered
    inputs: tuple[Io, ...]
    outputs: tuple[Io, ...]


@dataclass(frozen=True)
class Pipeline:
    name: str
    steps: tuple[Step, ...]
    description: str | None = None
    required: frozenset[str] = field(default_factory=frozenset)
    unnamed: int = 0

    @classmethod
    def parse(cls, config: Mapping, registry: Registry) -> "Pipeline":
        if not config.get("name"):
            raise PipelineError("a pipeline needs a name")
        specs = config.get("processors") or []
        if not specs:
            raise PipelineError("a pipeline needs a processor")
        steps = []
        for spec in specs:
            spec = {"name": spec} if isinstance(spec, str) else spec
            stage = registry.get(spec.get("name"))
            if stage is None:
                raise PipelineError(f"no processor {spec.get('name')!r}")
            sides = []
            for key, n in (("inputs", stage.inputs), ("outputs", stage.outputs)):
                ios = tuple(Io.parse(x, key == "inputs") for x in spec.get(key) or [Io()] * n)
                if len(ios) != n:
                    raise PipelineError(f"{stage.name} has {n} {key}, not {len(ios)}")
                sides.append(ios)
            steps.append(Step(stage, *sides))
        unnamed = sum(1 for i in steps[0].inputs if not i.name and not i.uri)
        made: set[str] = set()
        required: set[str] = set()
        before = None
        for step in steps:
            positional = [k for k, i in enumerate(step.inputs) if not i.name and not i.uri]
            if before is not None and positional and len(before.outputs) < len(positional):
                raise PipelineError(f"{step.stage.name} takes {len(positional)} unnamed inputs, {before.stage.name} makes {len(before.outputs)}")
            required |= {i.name for i in step.inputs if i.name and i.name not in made}
            made |= {o.name for o in step.outputs if o.name}
            before = step
        if unnamed and required:
            raise PipelineError(f"unnamed first inputs cannot be mixed with missing names {sorted(required)}")
        return cls(config["name"], tuple(steps), config.get("description"), frozenset(required), unnamed)

    def run(self, named: Mapping[str, DataFrame] | None = None, unnamed: Sequence[DataFrame] = (), read=None, write=None) -> list[DataFrame]:
        """Compose all stages; returns the last stage's outputs.

        ``read(uri)`` and ``write(uri, df)`` serve URI inputs and outputs.
        """
        named = dict(named or {})
        if missing := self.required - set(named):
            raise PipelineError(f"missing inputs {sorted(missing)}")
        if len(unnamed) != self.unnamed:
            raise PipelineError(f"{self.name} takes {self.unnamed} unnamed inputs, not {len(unnamed)}")
        previous = list(unnamed)
        for step in self.steps:
            at, inputs = 0, []
            for io in step.inputs:
                if io.uri:
                    inputs.append(read(io.uri))
                elif io.name:
                    inputs.append(named[io.name])
                else:
                    inputs.append(previous[at])
                    at += 1
            previous = list(step.stage.run(inputs))
            if len(previous) != step.stage.outputs:
                raise PipelineError(f"{step.stage.name} made {len(previous)} outputs, not {step.stage.outputs}")
            for io, df in zip(step.outputs, previous):
                if io.name:
                    named[io.name] = df
                if io.uri:
                    write(io.uri, df)
        return previous

    def default_outputs(self, outputs: list[DataFrame], defaults: int) -> list[DataFrame]:
        """Outputs for ``defaults`` default places. More outputs than places is an error here."""
        if len(outputs) > defaults:
            raise PipelineError(f"{len(outputs)} outputs for {defaults} places")
        return outputs


REGISTRY = Registry()


@REGISTRY.stage("cat")
def _cat(inputs):
    from lexiquarry.operators.lines import cat

    return [cat(inputs[0])]


@REGISTRY.stage("merge", 2)
def _merge(inputs):
    from lexiquarry.operators.lines import merge

    return [merge(*inputs)]


@REGISTRY.stage("numbered-sections")
def _numbered(inputs):
    from lexiquarry.operators.lines import parse_numbered, split_runs

    return [split_runs(parse_numbered(inputs[0]), ["source"], ["line_no"], "section")]


def run_each(stage: Registered, lines: DataFrame, path: str) -> None:
    """A stage of one input and one output over every file of ``lines`` (source, line_no, line): one output
    folder ``source=..`` a file below the directory ``path``, with its lines in order."""
    if stage.inputs != 1 or stage.outputs != 1:
        raise PipelineError(f"{stage.name} is not a stage of one input and one output")
    fs_path = lines.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(lines.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(fs_path) and not fs.getFileStatus(fs_path).isDirectory():
        raise PipelineError(f"{path} is a file; several sources need a directory")
    out = stage.run([lines])[0]
    out.repartition("source").sortWithinPartitions("source", "line_no").select("source", out["line"].alias("value")).write.partitionBy("source").mode("overwrite").text(path)


def run_text(pipeline: Pipeline, spark, inputs: Mapping[str, str]) -> str:
    """The service call: named input texts in, the first output's lines as one text out.

    The result is a reply to one request and is gathered on the driver in line order.
    """
    from lexiquarry.sources.readers import memory_lines

    frames = {k: memory_lines(spark, {k: v}) for k, v in inputs.items()}
    out = pipeline.run(frames)[0]
    order = [c for c in ("source_no", "source", "line_no") if c in out.columns]
    return "\n".join(r.line for r in out.orderBy(*order).select("line").collect())
