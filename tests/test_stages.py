"""U8: staged scoring with durable tables."""

import pytest
from pyspark.sql import functions as F

from pitwise.operators.stages import Stage, filled, run_stages


def echo(tag, log=None, fail=None):
    """A scorer that wraps its prompt and writes each call to a file."""

    def factory():
        def score(prompts):
            for p in prompts:
                if fail and fail in p:
                    raise ValueError("no answer")
            if log:
                with open(log, "a") as f:
                    f.writelines(f"{tag}|{p}\n" for p in prompts)
            return [f"{tag}<{p}>" for p in prompts]

        return score

    return factory


def frame(spark, n=6):
    return spark.createDataFrame([(k, f"x{k}") for k in range(n)], "id int, text string")


def test_a_stage_reads_any_earlier_output(spark, tmp_path):
    stages = [Stage("a", "{text}", echo("A")), Stage("b", "{id}+{text}", echo("B")), Stage("c", "{a} and {b}", echo("C")), Stage("d", "{a}{c}{a}", echo("D"))]
    got = {r.id: r for r in run_stages(frame(spark), stages, str(tmp_path), keys=["id"], commits=3).collect()}
    assert len(got) == 6
    for k, r in got.items():
        a, b = f"A<x{k}>", f"B<{k}+x{k}>"
        c = f"C<{a} and {b}>"
        assert (r.a, r.b, r.c, r.d) == (a, b, c, f"D<{a}{c}{a}>") and r.d_error is None


def test_resume_calls_no_row_twice(spark, tmp_path):
    """The second stage fails as a job; the next run goes on where it stopped."""
    log = str(tmp_path / "calls")

    def broken():
        raise RuntimeError("no scorer")

    good = [Stage("a", "{text}", echo("A", log)), Stage("b", "{a}", echo("B", log))]
    with pytest.raises(Exception, match="no scorer"):
        run_stages(frame(spark), [good[0], Stage("b", "{a}", broken)], str(tmp_path / "run"), keys=["id"])
    first = run_stages(frame(spark), good, str(tmp_path / "run"), keys=["id"]).collect()
    again = run_stages(frame(spark), good, str(tmp_path / "run"), keys=["id"]).collect()
    assert sorted(first) == sorted(again) and len(first) == 6
    calls = open(log).read().split()
    assert len(calls) == 12 and len(set(calls)) == 12


def test_failed_rows_are_kept_and_tried_again_on_demand(spark, tmp_path):
    run = lambda fail, **kw: {r.id: r for r in run_stages(
        frame(spark, 3), [Stage("a", "{text}", echo("A", fail=fail)), Stage("b", "[{a}]", echo("B"))], str(tmp_path), keys=["id"], batch_size=2, **kw).collect()}
    got = run("x1")
    assert got[1].a is None and "no answer" in got[1].a_error and got[1].b == "B<[]>" and got[0].a == "A<x0>"
    assert run(None)[1].a is None
    assert run(None, retry_errors=True)[1].a == "A<x1>"


def test_braces_nulls_and_repeated_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "{b}", "t"), (2, None, "u"), (2, None, "u"), (None, "z", "v")], "id int, a string, b string")
    assert [r.p for r in df.select(filled("<{a}|{b}>").alias("p")).collect()][:2] == ["<{b}|t>", "<|u>"]
    assert run_stages(df, [Stage("s", "{a}", echo("S"))], str(tmp_path), keys=["id"]).count() == 2
    assert run_stages(df.where(F.lit(False)), [Stage("s", "{a}", echo("S"))], str(tmp_path / "none"), keys=["id"]).count() == 0


@pytest.mark.parametrize(("stages", "text"), [([("s", "{later}"), ("later", "x")], "names"), ([("text", "x")], "another column"), ([("s", "{s}")], "names")])
def test_a_wrong_graph_is_an_error(spark, tmp_path, stages, text):
    with pytest.raises(ValueError, match=text):
        run_stages(frame(spark), [Stage(n, t, echo("S")) for n, t in stages], str(tmp_path), keys=["id"])
