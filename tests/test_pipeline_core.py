import pytest
from lexiquarry.plans.pipeline import REGISTRY, Io, Pipeline, PipelineError, Registry, run_text


@pytest.fixture
def registry():
    r = Registry()
    r.stage("one", 1, 1)(lambda x: x)
    r.stage("two", 2, 1)(lambda x: [x[0]])
    r.stage("fork", 1, 2)(lambda x: [x[0], x[0]])
    r.stage("pick", 2, 2)(lambda x: x)
    r.stage("bad", 1, 2)(lambda x: x)
    return r


def parse(registry, *steps, name="p"):
    return Pipeline.parse({"name": name, "processors": list(steps)}, registry)


def test_io_specs():
    assert Io.parse("plain", True) == Io(name="plain")
    assert Io.parse("file:/tmp/x", False) == Io(uri="file:/tmp/x")
    assert Io.parse({"name": "a"}, True).name == "a"
    assert Io.parse({"name": "a", "uri": "file:/x"}, False) == Io("a", "file:/x")
    for spec, source in (({"name": "a", "uri": "file:/x"}, True), ("ftp:/x", True), (5, True), ({"path": "x"}, True)):
        with pytest.raises(PipelineError):
            Io.parse(spec, source)


def test_validation(registry):
    with pytest.raises(PipelineError):
        parse(registry, name="")
    with pytest.raises(PipelineError):
        parse(registry)
    with pytest.raises(PipelineError):
        parse(registry, "nosuch")
    with pytest.raises(PipelineError):  # two unnamed inputs, one output before
        parse(registry, "one", "two")
    with pytest.raises(PipelineError):  # wrong number of inputs
        parse(registry, {"name": "two", "inputs": ["a"]})
    with pytest.raises(PipelineError):  # unnamed first input with a missing name later
        parse(registry, "one", {"name": "one", "inputs": ["never"]})
    assert parse(registry, "fork", "two").unnamed == 1
    p = parse(registry, {"name": "one", "inputs": ["a"], "outputs": ["b"]}, {"name": "two", "inputs": ["b", "c"]})
    assert p.required == {"a", "c"}


def test_routing(registry):
    p = parse(registry, {"name": "pick", "inputs": ["foo", "bar"], "outputs": ["x", "y"]}, {"name": "one", "inputs": ["x"]}, {"name": "one", "inputs": ["foo"]})
    assert p.run({"foo": "fooey", "bar": "barry"}) == ["fooey"]
    with pytest.raises(PipelineError):
        p.run({"foo": "fooey"})
    q = parse(registry, "fork", "two")
    assert q.run(unnamed=["z"]) == ["z"]
    with pytest.raises(PipelineError):
        q.run()
    with pytest.raises(PipelineError):
        parse(registry, "bad").run(unnamed=["z"])
    with pytest.raises(PipelineError):
        q.default_outputs(["a", "b"], 1)


def test_later_name_wins_and_uris(registry):
    p = parse(registry, {"name": "one", "inputs": ["file:/in"], "outputs": [{"name": "n", "uri": "file:/out"}]}, {"name": "one", "inputs": ["n"], "outputs": ["n"]})
    out = {}
    assert p.run(read=lambda u: f"read {u}", write=out.__setitem__) == ["read file:/in"]
    assert out == {"file:/out": "read file:/in"}


def test_text_service(spark):
    p = Pipeline.parse({"name": "m", "processors": [{"name": "merge", "inputs": ["a", "b"]}, "cat"]}, REGISTRY)
    assert run_text(p, spark, {"a": "1\n2", "b": "3"}) == "1\n2\n3"
