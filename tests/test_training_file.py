"""The training set as JSON lines, and prompts with a cue of one's own."""

import datetime as dt
import json
from pathlib import Path

from pitwise.operators import training as tr

DAY = dt.date(2024, 1, 2)


def test_training_file_round_trip(spark, tmp_path):
    rows = [("a \"quoted\" prompt\nof two lines", "1.5", "train"), ("p", None, "train"), ("é", "-0.25", "test"), ("", "0.0", "test")]
    path = str(tmp_path / "set")
    tr.write_training_set(spark.createDataFrame(rows, "prompt string, completion string, split string"), path)
    back = tr.read_training_set(spark, path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    lines = [json.loads(x) for f in Path(path).glob("split=train/*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 2 and all(set(x) == {"prompt", "completion"} for x in lines)
    assert "PartitionFilters: [isnotnull(split" in back.filter("split = 'test'")._jdf.queryExecution().toString()


def test_empty_training_file(spark, tmp_path):
    path = str(tmp_path / "set")
    tr.write_training_set(spark.createDataFrame([], "prompt string, completion string, split string"), path)
    assert tr.read_training_set(spark, path).count() == 0


def test_cue_ends_the_prompt(spark):
    prompts = spark.createDataFrame([(DAY, "X", "Income: 1\nBalance Sheet: 2")], "as_of date, id string, prompt string")
    pairs = spark.createDataFrame([("X", DAY, 1.23456)], "security string, date date, analyst_estimated_eps double")
    row = tr.training_set(prompts, pairs, cue="Answer in JSON:").first()
    assert row["prompt"] == "Income: 1\nAnswer in JSON:" and row["completion"] == "1.235"
    assert tr.training_set(prompts, pairs).first()["prompt"].endswith(tr.PROMPT_SUFFIX)
