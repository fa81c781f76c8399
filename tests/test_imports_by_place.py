"""Names that imports lead to, found by place, against all files of each place."""

import random

from pyspark.sql import functions as F

from sparkmem.operators import code

SYMS = "id string, name string, file string, package string, line int"


def test_resolve_by_place(spark):
    draw = random.Random(4)
    files = [f"{a}/{b}/{c}.go" for a in ("src", "lib") for b in ("x", "y", "x/y") for c in ("m", "n", "x")] + ["top.go", "y/n.go"]
    syms = [(f"{f}:{n}", n, f, f.rsplit("/", 2)[-2] if "/" in f else "root", k) for f in files for k, n in enumerate(["main", *draw.sample(["A", "B", "C", "D"], 2)])]
    modules = ["x", "y", "x/y", "src/x", "repo/src/x", "lib/x/y/m", "y/n", "host/lib", "top", "src/x/m", "none"]
    imps = sorted({(f, draw.choice(modules), draw.random() < 0.3, i, l, 1, "") for f in files for i, l in (("*", "*"), ("*", "o"), ("A", "A"), ("B", "k"), ("m", "m")) if draw.random() < 0.7})
    rels = [(f, "main", t, "calls", 1) for f in files for t in ("A", "B", "C", "D", "o.A", "o.D", "k", "m.C")]
    s, i, r = spark.createDataFrame(syms, SYMS), spark.createDataFrame(imps, code.IMPORTED), spark.createDataFrame(rels, code.RELATIONS)
    led = {tuple(x) for x in code.import_targets(i, s).select("file", "local", "imported", "target_file").collect()}
    held = {(f, n): k for k, n, f, _, _ in syms}
    want = {}
    for file, _, target, _, _ in rels:
        called, name = target.split(".")[0], target.split(".")[-1]
        met = [(t, held[t, w]) for f, local, imported, t in led if f == file for w in [imported if local != "*" and name == called and imported not in ("*", "default") else name] if local in (called, "*") and (t, w) in held]
        if met:
            want.setdefault((f"{file}:main", min(met)[1]), 1.0)
    got = {(e.source_id, e.target_id): e.confidence for e in code.resolve(s, r, i).collect()}
    assert {k for k, c in got.items() if c == 1.0} == set(want) and len(want) > 40


def test_a_folder_of_many_files_is_one_place(spark):
    n = 120
    files = [f"src/p{k % 2}/f{k}.go" for k in range(n)]
    syms = spark.createDataFrame([(f"{f}:{x}", x, f, "p", 1) for f in files for x in ("main", "Shared")], SYMS)
    imps = spark.createDataFrame([(f, f"host/src/p{(k + 1) % 2}", False, "*", "other", 1, "") for k, f in enumerate(files)], code.IMPORTED)
    assert code._import_places(imps, code._places(syms.select("file").distinct())).count() == n
    rels = spark.createDataFrame([(f, "main", "other.Shared", "calls", 1) for f in files], code.RELATIONS)
    got = code.resolve(syms, rels, imps).groupBy("target_id").agg(F.count("*").alias("n")).collect()
    assert {r.target_id: r.n for r in got} == {"src/p0/f0.go:Shared": n // 2, "src/p1/f1.go:Shared": n // 2}
