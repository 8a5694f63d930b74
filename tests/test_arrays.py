"""Arrays that many tasks read, against reading files whole."""

import json
import random
from urllib.parse import unquote

from pyspark.sql import functions as F

from pactlake.sources import arrays, records

CASES = {
    "plain": '[{"a": 1}, {"b": {"c": [1, {"d": 2}]}}]', "strings": r'[{"a": "}{][\"", "b\\": "\\"}, 7, "x}y", {"q": "\\\\\""}, [1, {"z": 3}], null]',
    "bom": '﻿[ {"a": 1}\n]\n', "empty": "[]", "blank": " [ \n ] ", "no objects": '[1, "}", [2]]', "objects and more": '[{"a": 1}, 2, 3]',
    "trailing comma": '[{"a": 1},]', "no comma": '[{"a": 1} {"b": 2}]', "open": '[{"a": 1}, {"b": 2}', "text after": '[{"a": 1}] x', "two": '[{"a": 1}][{"b": 2}]',
    "cut string": '[{"a": "b}]', "lone brace": "}", "just text": "hello", "bad element": '[{"a": 1}, {b}, {"c": 2}]', "deep": '[{"a": [[[{"b": {}}]]]}, {}]',
}


def expected(text):
    """Objects by place, places of other elements; None if the file is no array."""
    try:
        values = json.loads(text.lstrip("\ufeff"))
    except ValueError:
        return None
    return ({i: v for i, v in enumerate(values) if isinstance(v, dict)}, [i for i, v in enumerate(values) if not isinstance(v, dict)]) if isinstance(values, list) else None


def test_awkward_arrays(spark, tmp_path):
    for name, text in CASES.items():
        (tmp_path / f"{name}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        good, bad = arrays.array_records(spark, str(tmp_path))
        good, bad = good.select("file", "line", F.to_json("v").alias("v")).collect(), bad.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in CASES.items():
        of = lambda rows, n=name: [r for r in rows if unquote(r.file).endswith(f"/{n}.json")]
        got = {r.line: json.loads(r.v) for r in of(good)}, sorted(r.line for r in of(bad))
        want = expected(text)
        assert got == (({}, [0]) if want is None else want), name
        assert want is not None or [r.kind for r in of(bad)] == ["malformed_line"], name
    # as the reader of whole files has them
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.json").write_text(CASES["strings"])
    whole = records.whole_array(spark, str(tmp_path / "w"))
    parts = arrays.array_records(spark, str(tmp_path / "w"))
    for w, p in zip(whole, parts, strict=True):
        text = lambda d: sorted(tuple(r) for r in d.select("line", F.col("v").cast("string") if "v" in d.columns else F.concat("kind", "detail")).collect())
        assert text(w) == text(p)


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    odd = lambda: "".join(rng.choice('ab{}[]",\\\n é') for _ in range(rng.randrange(30)))
    values = [rng.choice([{"k": i, odd(): odd(), "in": [{"x": odd()}]}, i, odd(), [i, {"y": odd()}]]) for i in range(3000)]
    (tmp_path / "big.json").write_text(json.dumps(values, indent=1, ensure_ascii=False))
    (tmp_path / "other.json").write_text('[{"a": 1}]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        good, bad = arrays.array_records(spark, str(tmp_path))
        good = {(r.file.rsplit("/", 1)[1], r.line): json.loads(r.v) for r in good.select("file", "line", F.to_json("v").alias("v")).collect()}
        places = sorted(r.line for r in bad.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert good == {("big.json", i): v for i, v in enumerate(values) if isinstance(v, dict)} | {("other.json", 0): {"a": 1}}
    assert places == [i for i, v in enumerate(values) if not isinstance(v, dict)]
