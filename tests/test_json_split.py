"""One JSON object or array read by many tasks equals the json library."""

import json
import random
import tempfile

from pyspark.sql import functions as F

from tessera.sources import json_split as J
from tessera.sources import readers as S


def _word(rnd):
    return "".join(rnd.choice(['a', 'é', '"', '\\', '{', '}', '[', ']', ',', ':', ' ', '\n', '語']) for _ in range(rnd.randint(0, 12)))


def _puzzles(rnd, n):
    grid = lambda: [[rnd.randint(0, 9) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 4))]
    pairs = lambda k: [{"input": grid(), "output": grid()} for _ in range(k)]
    return {f"{i} {_word(rnd)}": {"train": pairs(rnd.randint(0, 3)), "test": pairs(rnd.randint(0, 2))} for i in range(n)}


def _many_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)


def test_objects_and_arrays_in_small_splits(spark):
    rnd = random.Random(3)
    d = tempfile.mkdtemp(prefix="tessera-json-")
    puzzles = _puzzles(rnd, 60)
    solutions = {k: [e["output"] for e in v["test"]] for k, v in puzzles.items()}
    names = [_word(rnd) for _ in range(200)]
    for name, x, indent in (("p", puzzles, None), ("pi", puzzles, 2), ("s", solutions, None), ("n", names, None), ("ni", names, 1)):
        with open(f"{d}/{name}.json", "w") as f:
            json.dump(x, f, indent=indent, ensure_ascii=rnd.random() < 0.5)
            f.write("\n")
    before = [spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")]
    try:
        for size in (257, 2000, 10**6):
            _many_splits(spark, size)
            for name in ("p", "pi"):
                got = J.object_entries(spark, f"{d}/{name}.json")
                back = {}
                for r in got.collect():
                    back |= json.loads(r.value)
                assert back == puzzles and got.count() == len(puzzles)
            if size == 257:
                assert spark.read.option("lineSep", "}").text(f"{d}/p.json").rdd.getNumPartitions() > 10
            back = {}
            for r in J.object_entries(spark, f"{d}/s.json", "]").collect():
                back |= json.loads(r.value)
            assert back == solutions
            for name in ("n", "ni"):
                got = S.read_identifiers_json(spark, f"{d}/{name}.json").orderBy("puzzle_identifier").collect()
                assert [r.puzzle_identifier for r in got] == list(range(200)) and [r.puzzle_name for r in got] == names
        rows = S.read_grid_puzzles(spark, {"training": f"{d}/pi.json"}, whole_file=True)
        assert rows.count() == sum(len(v["train"]) + len(v["test"]) for v in puzzles.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_empty_json(spark):
    d = tempfile.mkdtemp(prefix="tessera-json-")
    for name, text in (("a", "{}"), ("b", ""), ("c", "[]"), ("e", '{"x": {}}')):
        with open(f"{d}/{name}.json", "w") as f:
            f.write(text)
    assert J.object_entries(spark, f"{d}/a.json").count() == 0 and J.object_entries(spark, f"{d}/b.json").count() == 0
    assert J.array_elements(spark, f"{d}/c.json").count() == 0
    assert [r.value for r in J.object_entries(spark, f"{d}/e.json").collect()] == ['{"x": {}}']
