"""Documents read in splits against the JSON library, with a split at every byte."""

import json
import random

import pytest

from geoloom.sources import formats, jsonsplit

TRICKY = ["", "a,b", 'q"u,o', "br{ac,e}s", "[,]", "\\", "back\\\\,slash\\", "line\nbreak,", "é,日本🙂", '{"elements": [{"id": 9}]}', '"elements": [']


def documents(rng, n):
    def value(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind == 0:
            return rng.choice(TRICKY)
        if kind == 1:
            return rng.choice([1, -2.5, None, True])
        if kind == 2:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice([*TRICKY, "elements", "k"]): value(depth - 1) for _ in range(rng.randrange(4))}

    objects = [{"id": k, "v": value(3)} for k in range(n)]
    return objects, {"version": 0.6, "osm3s": {"elements": [{"id": -1}], "x": "a,{"}, "bbox": [1, 2], "elements": objects, "after": [{"id": -2}, {"id": -3}]}


@pytest.mark.parametrize("size", [17, 64, 4096])
def test_objects_cross_any_split(spark, tmp_path, size):
    rng = random.Random(size)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    want = []
    for k, (n, indent) in enumerate([(0, None), (1, 1), (9, None), (14, 2)]):
        objects, document = documents(rng, n)
        want += objects
        (tmp_path / f"d{k}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=k % 2 == 0), encoding="utf-8")
    (tmp_path / "none.json").write_text('{"features": [{"id": 5}]}')
    (tmp_path / "empty.json").write_text("")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [json.loads(r.value) for r in jsonsplit.json_objects(spark, str(tmp_path / "*.json"), "elements").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    order = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert order(got) == order(want)


def test_written_documents_come_back_and_equal_the_whole_file_reader(spark, tmp_path):
    objects = [{"id": k, "type": "way", "tags": {"name": f"a,{k}]"}, "geometry": [{"lon": 1.5, "lat": k}]} for k in range(300)]
    rows = spark.createDataFrame([(json.dumps(o),) for o in objects], "value string").repartition(3)
    jsonsplit.json_documents(rows, "elements", str(tmp_path / "d"))
    jsonsplit.json_documents(rows.limit(0), "elements", str(tmp_path / "n"))
    got = formats.read_elements(spark, str(tmp_path / "d"))
    whole = spark.read.schema(f"elements array<{formats.ELEMENT}>").json(str(tmp_path / "d"), multiLine=True).selectExpr("inline(elements)")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 300
    assert formats.read_elements(spark, str(tmp_path / "n")).count() == 0
