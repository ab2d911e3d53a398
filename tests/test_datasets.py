import json

from pyspark.sql import functions as F

from tessella.functions import signals, text
from tessella.operators import structure
from tessella.sources import datasets

SOURCE = "def total(values, limit):\n    found = 0\n    for i in range(limit):\n        if values[i] > 3:\n            found = found + values[i]\n    return found\n"


def test_loaders_give_one_record(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,code1,code2,similar\n1,"a\nb",c,yes\n2,d,e,0\n3,f,g,3\n4,h,i,\n')
    rows = datasets.load(spark, "code_similarity", str(tmp_path / "s.csv"))
    assert rows.columns == datasets.PAIR
    assert {(r["pair_id"], r["code_a"], r["label"]) for r in rows.collect()} == {("1", "a\nb", 1), ("2", "d", 0), ("3", "f", 1), ("4", "h", None)}
    jam = tmp_path / "jam" / "submissions"
    jam.mkdir(parents=True)
    for n in ("x", "y", "z"):
        (jam / f"{n}.py").write_text(n)
    (tmp_path / "jam" / "ground_truth.json").write_text(json.dumps([{"file_a": "x.py", "file_b": "y.py", "label": 1}, {"file_a": "x.py", "file_b": "z.py", "label": 0}]))
    assert {(r["code_a"], r["code_b"], r["label"]) for r in datasets.load(spark, "code_jam", str(tmp_path / "jam")).collect()} == {("x", "y", 1), ("x", "z", 0)}
    for task in ("1", "2", "3"):
        (tmp_path / "poj" / task).mkdir(parents=True)
        for k in range(4):
            (tmp_path / "poj" / task / f"{k}.txt").write_text(f"{task}-{k}")
    got = datasets.load(spark, "poj104", str(tmp_path / "poj")).collect()
    assert len({r["pair_id"] for r in got}) == len(got) and {r["label"] for r in got} == {0, 1}
    assert all((r["code_a"][0] == r["code_b"][0]) == (r["label"] == 1) and r["code_a"] != r["code_b"] for r in got)
    assert sum(r["label"] for r in got) == 18
    spark.createDataFrame([(1, "int f;", 1), (2, None, 0)], "id int, func string, target int").write.parquet(f"{tmp_path}/d")
    assert [tuple(r) for r in datasets.load(spark, "defects", f"{tmp_path}/d").collect()] == [("defects", "1", "int f;", 1)]


def test_validation_counts_each_fault(spark):
    rows = [("d", "1", "a", "b", 1, 1, "c"), ("d", "1", "b", "a", 1, 0, "c"), ("d", "2", "", "b", None, 9, "c"), ("d", "3", "x", "y", 0, 2, "c")]
    pairs = spark.createDataFrame(rows, "dataset string, pair_id string, code_a string, code_b string, label int, clone_type int, language string")
    meta = spark.createDataFrame([("d", "1", "c", [1], "easy", 4, "s", "l", "f", "")], datasets.METADATA)
    r = datasets.validate(pairs, meta).first()
    assert (r["pairs"], r["empty"], r["unlabelled"], r["bad_types"], r["contradictions"], r["repeated_ids"], r["repeated_texts"], r["size_holds"]) == (4, 1, 1, 1, 2, 1, 1, True)


def test_clones_mean_the_same(spark):
    for kind in (1, 2, 3, 4):
        made = structure.clone(SOURCE, kind, 5)
        own: dict = {}
        exec(made, own)  # the test's own source, not a submission
        assert own["total"]([1, 5, 9], 3) == 14 and made != SOURCE
    assert structure.subtree_hashes(structure.clone(SOURCE, 1)) == structure.subtree_hashes(SOURCE)
    assert structure.clone_type(SOURCE, structure.clone(SOURCE, 2)) == 2
    assert "while" in structure.clone(SOURCE, 4) and structure.clone("def (", 4) == "def ("
    got = spark.createDataFrame([(SOURCE,)], "s string").select(structure.clones(F.col("s"), 2).alias("c"), structure.kinds(F.col("s")).alias("k")).first()
    assert "found" not in got["c"] and "For" in got["k"]


def test_tree_scores(spark):
    other = "def area(w, h):\n    return w * h\n"
    assert structure.tree_distance(SOURCE, SOURCE) == 0 and structure.tree_kernel(SOURCE, SOURCE) == 1
    near, far = structure.clone(SOURCE, 3), other
    assert structure.tree_distance(SOURCE, near) < structure.tree_distance(SOURCE, far) and structure.tree_kernel(SOURCE, near) > structure.tree_kernel(SOURCE, far)
    assert structure.tree_distance("x = 1", "x = 1\ny = 2") == 4 / 9
    df = spark.createDataFrame([(1, 2, SOURCE, near), (1, 3, SOURCE, "def (")], "id_a int, id_b int, x string, y string")
    assert {r["id_b"]: round(r["score"], 3) > 0 for r in structure.compared(df, "edit").collect()} == {2: True, 3: False}


def test_token_forms(spark):
    df = spark.createDataFrame([(["def", "foo", "x", "12", "foo", "if"], "\n".join(map(str, range(30))))], "w array<string>, t string")
    r = df.select(text.normalized_names(F.col("w")).alias("n"), text.without_boilerplate(F.col("w")).alias("b"), text.line_windows(F.col("t")).alias("l"), text.variable_kinds(F.array(*map(F.lit, ["i", "this", "__a__", "MAX_N", "_p", "v"]))).alias("k")).first()
    assert r["n"] == ["def", "__VAR0__", "__VAR1__", "__NUM__", "__VAR0__", "if"] and r["b"] == ["foo", "x", "12", "foo"]
    assert [x.split("\n")[0] for x in r["l"]] == ["0", "20"] and r["l"][0].count("\n") == 24
    assert r["k"] == ["LOOP_VAR", "SELF", "DUNDER", "CONST", "PRIVATE_VAR", "VAR"]
    nodes = spark.createDataFrame([(["A", "B"], ""), (None, "  a\n b"), (["A", "A"], "")], "k array<string>, t string")
    assert [round(x[0], 6) for x in nodes.select(signals.structure(F.col("k"), F.col("t"))).collect()] == [0.0, 0.6, 0.8]
