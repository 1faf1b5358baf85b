"""Nested metrics against plain recursion over JSON."""

import json
import random

from pyspark.sql import functions as F

from lamina.operators import nested


def leaves(value, path, by_index):
    if isinstance(value, dict) or (by_index and isinstance(value, list)):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from leaves(v, [*path, str(k)], by_index)
    elif value is not None and not isinstance(value, list):
        yield "/".join(path), value


def random_value(r, depth):
    kind = r.randrange(9 if depth else 6)
    if kind > 6:
        return {r.choice("abc_é0") + str(i): random_value(r, depth - 1) for i in range(r.randrange(4))}
    return [None, True, r.randrange(-9, 10**12), r.random() * 1e300, "text ☃", "", [random_value(r, 0) for _ in range(r.randrange(3))]][kind]


def test_any_shape(spark):
    r = random.Random(4)
    values = [random_value(r, 5) for _ in range(120)] + [{}, [], None, {"a": {"b": {"c": {"d": {"e": [[{"f": 1}]]}}}}}]
    rows = [(i, f"k{i}", None if v is None and i % 2 else json.dumps(v)) for i, v in enumerate(values)] + [(0, "k0", json.dumps(values[0]))]
    d = spark.createDataFrame(rows, "pos int, value string, j string").withColumn("m", F.parse_json("j"))  # keys named as the explosion's own columns
    for by_index in (False, True):
        want = []
        for i, k, j in rows:
            for name, v in leaves(json.loads(j) if j is not None else None, ["p"], by_index):
                want.append((i, k, name, None if isinstance(v, str) else float(v), v if isinstance(v, str) else None))
        got = [tuple(x) for x in nested.metric_rows(d.select("pos", F.col("value").alias("key"), "m"), ["pos", "key"], "m", "p", by_index).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert nested.metric_rows(d.limit(0), ["pos"], "m").collect() == []
    assert {x["metric"] for x in nested.metric_rows(spark.range(1).select("id", F.parse_json(F.lit('{"a":{"b":1}}')).alias("m")), ["id"], "m").collect()} == {"a/b"}
