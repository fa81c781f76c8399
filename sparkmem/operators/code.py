"""Code intelligence: symbols, relations and imports of source files, their resolution, and what the graph says.

Extractors read whole files in Arrow batches: Python by its own parser, languages with braces by their blocks, the rest by line patterns.
Everything across files is joins by equal keys."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from . import graph

SYMBOLS = "file string, kind string, name string, parent string, line int, signature string, doc string, complexity int"
RELATIONS = "file string, source string, target string, relation string, line int"

IMPORTED = "file string, module string, near boolean, imported string, local string, line int, source string"

# Declarations by line in languages without braces, as (pattern, kind); the name is the first group.
DECLARATIONS = {
    "fsharp": [(r"^\s*(?:let|and)\s+(?:rec\s+|inline\s+)?([A-Za-z_]\w*)", "function"), (r"^\s*type\s+([A-Za-z_]\w*)", "type"), (r"^\s*module\s+([\w.]+)", "module")],
    "vbnet": [(r"(?i)^\s*(?:(?:public|private|friend|shared)\s+)*(class|module|structure|interface)\s+([A-Za-z_]\w*)", ""), (r"(?i)^\s*(?:(?:public|private|friend|shared)\s+)*(?:sub|function)\s+([A-Za-z_]\w*)", "function")],
    "ruby": [(r"^\s*(class|module)\s+([A-Z]\w*)", ""), (r"^\s*def\s+(?:self\.)?([a-z_]\w*[?!]?)", "function")],
}
_branch = re.compile(r"\b(?:if|for|while|case|catch|elif|except|when)\b|&&|\|\|")


def _python(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    symbols, relations = [], []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            name = getattr(child, "name", None)
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                branches = sum(isinstance(x, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.BoolOp)) for x in ast.walk(child))
                head = name if is_class else f"{name}({', '.join(a.arg for a in child.args.args)})"
                symbols.append((path, "class" if is_class else "method" if parent else "function", name, parent, child.lineno, head, (ast.get_docstring(child) or "")[:200], 1 + branches))
                relations.append((path, parent or path, name, "contains" if parent else "defines", child.lineno))
                if is_class:
                    relations.extend((path, name, ast.unparse(b).split(".")[-1], "extends", child.lineno) for b in child.bases)
                visit(child, name)
            else:
                if isinstance(child, ast.Import):
                    relations.extend((path, path, a.name, "imports", child.lineno) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    relations.extend((path, path, f"{child.module or ''}.{a.name}", "imports", child.lineno) for a in child.names)
                elif isinstance(child, ast.Call) and parent:
                    called = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                    if called:
                        relations.append((path, parent, called, "calls", child.lineno))
                visit(child, parent)

    visit(tree, None)
    return symbols, relations


def _sql(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    symbols, relations, table = [], [], None
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if bare.startswith(("--", "/*")):
            continue
        if m := re.match(r"(?i)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", bare):
            table = m[2].strip('"`').split(".")[-1].strip('"`')
            symbols.append((path, m[1].lower(), table, None, n, bare[:200], "", 1))
            relations.append((path, path, table, "defines", n))
        for m in re.finditer(r"(?i)references\s+([\w.\"`]+)", bare):
            if table:
                relations.append((path, table, m[1].strip('"`').split(".")[-1].strip('"`'), "references", n))
        if bare.endswith(";"):
            table = None
    return symbols, relations


def facts_of(path: str, language: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations of one file."""
    if language == "python":
        return _python(path, text)
    if language == "sql":
        return _sql(path, text)
    if language in blocks.MASKS:
        return blocks.facts(path, language, text)
    symbols, relations = [], []
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        for pattern, kind in DECLARATIONS.get(language, ()):
            if m := re.search(pattern, line):
                name, kind = (m[1], kind) if kind else (m[2], m[1].lower())
                symbols.append([path, kind, name, None, n, line.strip()[:200], "", 1])
                relations.append((path, path, name, "defines", n))
                break
    bounds = [s[4] for s in symbols] + [len(lines) + 1]
    names = {s[2] for s in symbols}
    for k, s in enumerate(symbols):
        body = "\n".join(lines[s[4] : bounds[k + 1] - 1])
        s[7] = 1 + len(_branch.findall(body))
        if s[1] == "function":
            relations.extend((path, s[2], c, "calls", s[4]) for c in dict.fromkeys(re.findall(r"\b([A-Za-z_$][\w$]*)\s*\(", body)) if c in names and c != s[2])
    return [tuple(s) for s in symbols], relations


def _extract(rows_of, schema: str):
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([row for p, l, t in zip(batch["path"], batch["language"], batch["content"], strict=True) for row in rows_of(p, l, t or "")], columns=columns)

    return run


def symbols(files: DataFrame, project: str = "") -> DataFrame:
    """Symbols with ids (digest of project, kind, name, file and line) and the package they are in."""
    found = files.select("path", "language", "content").mapInPandas(_extract(lambda *x: facts_of(*x)[0], SYMBOLS), SYMBOLS)
    package = F.coalesce(F.nullif(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1), F.lit("")), F.lit("root"))
    return found.withColumn("id", symbol_id(F.lit(project), F.col("kind"), F.col("name"), F.col("file"), F.col("line"))).withColumn("package", package)


def relations(files: DataFrame) -> DataFrame:
    return files.select("path", "language", "content").mapInPandas(_extract(lambda *x: facts_of(*x)[1], RELATIONS), RELATIONS)


def imports(files: DataFrame) -> DataFrame:
    """file, module (path without ending), near (from the file's own place), imported name or *, local name, line, source (as written)."""
    return files.select("path", "language", "content").mapInPandas(_extract(blocks.imports, IMPORTED), IMPORTED)


def _endings(path: Column) -> Column:
    """Every ending of a path, with its number of segments."""
    parts = F.split(path, "/")
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("key"), (F.size(parts) - i + 1).alias("parts"))))


def import_targets(imps: DataFrame, syms: DataFrame) -> DataFrame:
    """file, local, imported, target_file of imports that lead to known files, by equal keys only.

    A module is a file without its ending, a folder, or the folder of an index file. Far modules meet the longest ending
    that either side has of the other: packages below a source root, import paths above a repository."""
    files = syms.select("file").distinct()
    bare = F.regexp_replace("file", r"\.[^./]+$", "")
    folder = F.regexp_extract("file", r"^(.*)/[^/]+$", 1)
    whole = files.select("file", F.explode(F.array_distinct(F.array(bare, folder))).alias("key")).where("key != ''")
    asked = imps.withColumn("n", F.xxhash64("file", "module", "imported", "local")).select("n", "file", "local", "imported", "module", "near").distinct()
    names = F.array_compact(F.array("module", F.when(~F.col("imported").isin("*", "default"), F.concat_ws("/", F.nullif("module", F.lit("")), "imported"))))
    asked = asked.select("n", "file", "local", "imported", "near", F.explode(names).alias("module")).where("module != ''")
    held = whole.select(F.col("file").alias("target_file"), "key")
    near = asked.where("near").join(held, F.col("module") == F.col("key")).withColumn("parts", F.size(F.split("module", "/")))
    ends = held.select("target_file", _endings(F.col("key")).alias("e")).select("target_file", F.col("e.key").alias("key"), F.col("e.parts").alias("parts"))
    below = asked.where("not near").join(ends, F.col("module") == F.col("key"))
    above = asked.where("not near").select("n", "file", "local", "imported", "near", _endings(F.col("module")).alias("e")).select("n", "file", "local", "imported", "near", F.col("e.key").alias("module"), F.col("e.parts").alias("parts"))
    above = above.where("parts > 1").join(held, F.col("module") == F.col("key"))
    columns = ["n", "file", "local", "imported", "target_file", "parts"]
    met = near.select(*columns).unionByName(below.select(*columns)).unionByName(above.select(*columns)).where("file != target_file").distinct()
    best = met.groupBy("n").agg(F.max("parts").alias("parts"))
    return met.join(best, ["n", "parts"]).select("file", "local", "imported", "target_file").distinct()


def _places(files: DataFrame) -> DataFrame:
    """file, kind, place: keys by which imports find a file: itself without its ending and its folder, whole or an ending of them."""
    bare, folder = F.regexp_replace("file", r"\.[^./]+$", ""), F.regexp_extract("file", r"^(.*)/[^/]+$", 1)
    whole = files.select("file", F.explode(F.array_distinct(F.array(bare, folder))).alias("place")).where("place != ''")
    ends = whole.select("file", _endings(F.col("place")).alias("e")).select("file", F.lit("ending").alias("kind"), F.col("e.key").alias("place")).distinct()
    return ends.unionByName(whole.select("file", F.lit("whole").alias("kind"), "place"))


def _import_places(imps: DataFrame, places: DataFrame) -> DataFrame:
    """file, local, imported, kind, place of imports: the places of import_targets(), not each of the files there.

    A place counts if it has a file other than the importing one."""
    asked = imps.withColumn("n", F.xxhash64("file", "module", "imported", "local")).select("n", "file", "local", "imported", "module", "near").distinct()
    names = F.array_compact(F.array("module", F.when(~F.col("imported").isin("*", "default"), F.concat_ws("/", F.nullif("module", F.lit("")), "imported"))))
    asked = asked.select("n", "file", "local", "imported", "near", F.explode(names).alias("module")).where("module != ''")
    columns = ["n", "file", "local", "imported", "kind", "place", "parts"]
    parts = F.size(F.split("module", "/")).alias("parts")
    direct = asked.select("n", "file", "local", "imported", F.when(F.col("near"), "whole").otherwise("ending").alias("kind"), F.col("module").alias("place"), parts)
    above = asked.where("not near").select("n", "file", "local", "imported", _endings(F.col("module")).alias("e")).where("e.parts > 1")
    above = above.select("n", "file", "local", "imported", F.lit("whole").alias("kind"), F.col("e.key").alias("place"), F.col("e.parts").alias("parts"))
    held = places.groupBy("kind", "place").agg(F.min("file").alias("low"), F.max("file").alias("high"))
    met = direct.select(*columns).unionByName(above.select(*columns)).join(held, ["kind", "place"]).where("low != high or low != file").select(*columns).distinct()
    best = met.groupBy("n").agg(F.max("parts").alias("parts"))
    return met.join(best, ["n", "parts"]).select("file", "local", "imported", "kind", "place").distinct()


def symbol_id(project: Column, kind: Column, name: Column, file: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit("sym"), project, kind, name, file, line.cast("string")), 256), 1, 32)


def resolve(syms: DataFrame, rels: DataFrame, imps: DataFrame | None = None) -> DataFrame:
    """source_id, target_id, relation, confidence. A target is, in this order, a symbol's id, a name that the file imports (1), a name in the
    same file, in the same package, or of one symbol alone (0.8), or the first of several of that name (0.5).

    Each step joins a table with one row a key, so a name that thousands of symbols have costs no more than another. Of a
    qualified target (a.b), the last part is the name and the first one what the import calls it."""
    first = F.min(F.struct("line", "id"))["id"]
    s = syms.select("id", "name", "file", "package", "line")
    one = F.min(F.struct("file", "line", "id"))["id"]
    in_file = s.groupBy("file", "name").agg(first.alias("in_file"))
    in_package = s.where("package is not null").groupBy("package", "name").agg(one.alias("in_package"))
    anywhere = s.groupBy("name").agg(one.alias("anywhere"), F.count("*").alias("n"))
    own = s.groupBy(F.col("file"), F.col("name").alias("source")).agg(F.min(F.struct("line", "id", "package")).alias("o")).select("file", "source", F.col("o.id").alias("source_id"), F.col("o.package").alias("package"))
    ends = rels.where("relation != 'imports'").join(own, ["file", "source"]).select("file", "package", "source_id", "target", "relation").distinct()
    parts = F.split("target", r"\.")
    ends = ends.withColumns({"name": F.element_at(parts, -1), "called": F.element_at(parts, 1)})
    ends = ends.join(s.select(F.col("id").alias("target"), F.col("id").alias("exact")), "target", "left")
    for table, on in ((in_file, ["file", "name"]), (in_package, ["package", "name"]), (anywhere, ["name"])):
        ends = ends.join(table, on, "left")
    if imps is not None:
        places = _places(s.select("file").distinct())
        led = _import_places(imps, places)
        mine = ends.select("file", "name", "called").distinct()
        by_name = mine.join(led.where("local != '*'").withColumnRenamed("local", "called"), ["file", "called"]).withColumn("wanted", F.when((F.col("name") == F.col("called")) & ~F.col("imported").isin("*", "default"), F.col("imported")).otherwise(F.col("name")))
        by_all = mine.join(led.where("local = '*'").drop("local"), "file").withColumn("wanted", F.col("name"))
        columns = ["file", "name", "called", "kind", "place", "wanted"]
        found = by_name.select(*columns).unionByName(by_all.select(*columns)).distinct()
        # of a name at a place, the first two files: one of them is not the importing one
        nth = F.row_number().over(Window.partitionBy("kind", "place", "wanted").orderBy("target_file"))
        held = in_file.select(F.col("file").alias("target_file"), F.col("name").alias("wanted"), F.col("in_file").alias("at")).join(places.withColumnRenamed("file", "target_file"), "target_file")
        held = held.withColumn("nth", nth).where("nth <= 2").drop("nth")
        found = found.join(held, ["kind", "place", "wanted"]).where("target_file != file").groupBy("file", "name", "called").agg(F.min(F.struct("target_file", "at"))["at"].alias("imported"))
        ends = ends.join(found, ["file", "name", "called"], "left")
    else:
        ends = ends.withColumn("imported", F.lit(None).cast("string"))
    target = F.coalesce("exact", "imported", "in_file", "in_package", "anywhere")
    sure = F.coalesce("exact", "imported").isNotNull()
    guess = F.coalesce("in_file", "in_package").isNull() & (F.col("n") > 1)
    confidence = F.when(sure, 1.0).when(guess, 0.5).otherwise(0.8)
    out = ends.select("source_id", target.alias("target_id"), "relation", confidence.alias("confidence")).where("target_id is not null and source_id != target_id")
    return out.groupBy("source_id", "target_id", "relation").agg(F.max("confidence").alias("confidence"))


def search_symbols(syms: DataFrame, text: str, *, regex: bool = False, kind: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols by how their name, signature or doc meets the query."""
    name, sig, doc = F.lower("name"), F.lower(F.coalesce("signature", F.lit(""))), F.lower(F.coalesce("doc", F.lit("")))
    q = text.lower()
    if regex:
        score = F.when(F.col("name").rlike(f"(?i){text}"), 1.0).when(F.col("signature").rlike(f"(?i){text}"), 0.5).when(F.col("doc").rlike(f"(?i){text}"), 0.25)
    else:
        score = F.when(name == q, 1.0).when(name.startswith(q), 0.8).when(name.contains(q), 0.6).when(sig.contains(q), 0.4).when(doc.contains(q), 0.2)
    out = syms.withColumn("score", score).where("score is not null")
    out = out if kind is None else out.where(F.col("kind") == kind)
    out = out if path is None else out.where(F.col("file").contains(path))
    return out.orderBy(F.desc("score"), "name", "file").limit(limit)


# Names that are no hubs.
NOISE = ["str", "int", "float", "bool", "string", "byte", "error", "nil", "true", "false", "object", "any", "context", "fmt", "time", "os", "io", "log", "sync", "math", "test", "mock", "json", "http"]
# Endings of test files by language, of names in lower case.
TEST_FILES = [r"_test\.go$", r"(^|/)test_[^/]*\.py$", r"_test\.py$", r"\.(test|spec)\.[jt]sx?$", r"tests?\.(java|kt|cs)$", r"/tests/.*\.rs$"]


def is_test_file(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/")).rlike("|".join(TEST_FILES))


def hubs(syms: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Symbols by 1.5 x incoming + outgoing relations, of two at least, without names that every project has."""
    syms = syms.where(~F.lower("name").isin(*NOISE))
    ends = edges.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    per = ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing")).where("incoming + outgoing >= 2")
    return per.withColumn("score", 1.5 * F.col("incoming") + F.col("outgoing")).join(syms.select("id", "name", "file"), "id").orderBy(F.desc("score"), "name", "id").limit(limit)


def package_cohesion(syms: DataFrame, edges: DataFrame) -> DataFrame:
    """package, symbols, inside, cohesion (relations inside over possible ones, 1 at most)."""
    p = syms.select("id", "package")
    inside = edges.join(p.withColumnsRenamed({"id": "source_id", "package": "a"}), "source_id").join(p.withColumnsRenamed({"id": "target_id", "package": "b"}), "target_id").where("a = b").groupBy(F.col("a").alias("package")).agg(F.count("*").alias("inside"))
    per = p.groupBy("package").agg(F.count("*").alias("symbols")).where("symbols >= 2").join(inside, "package", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return per.withColumn("cohesion", F.round(F.least(2 * F.col("inside") / (F.col("symbols") * (F.col("symbols") - 1)), F.lit(1.0)), 3))


def targets(syms: DataFrame, wanted: DataFrame) -> DataFrame:
    """target, rule, root for each wanted name: symbols of the file (0), path ending (1), id (2), name (3), or id or name without case (4); the first rule that meets any."""
    want = wanted.select("target").distinct().withColumn("path", F.translate(F.trim("target"), "\\", "/"))
    parts = F.split("file", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.when(i == 1, 0).otherwise(1).alias("rule"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("path")))
    files = syms.select("file").where("file != ''").distinct().select("file", F.explode(endings).alias("e")).select("file", "e.*")
    by_file = files.join(want, "path").join(syms.select("file", F.col("id").alias("root")), "file").select("target", "rule", "root")
    keys = lambda a, b, c, d: F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), x.alias("key")) for r, x in ((2, a), (3, b), (4, c), (4, d)))))
    i, n, t = F.col("id"), F.col("name"), F.trim("target")
    own = syms.select(i.alias("root"), keys(i, n, F.lower(i), F.lower(n)).alias("k")).select("root", "k.*").distinct()
    asked = want.select("target", keys(t, t, F.lower(t), F.lower(t)).alias("k")).select("target", "k.*").distinct()
    met = by_file.unionByName(own.join(asked, ["rule", "key"]).select("target", "rule", "root"))
    return met.join(met.groupBy("target").agg(F.min("rule").alias("rule")), ["target", "rule"]).select("target", "rule", "root").distinct()


def blast_radius(syms: DataFrame, edges: DataFrame, wanted: DataFrame, hops: int = 3) -> DataFrame:
    """target, id, hop of the symbols that reach a target."""
    roots = targets(syms, wanted)
    near = graph.khop(graph.adjacency(edges, "target_id", "source_id", directed=True), roots.select("root").distinct(), hops)
    return near.join(roots, "root").groupBy("target", "id").agg(F.min("hop").alias("hop")).where("hop > 0")


def impacted_tests(syms: DataFrame, edges: DataFrame, wanted: DataFrame, hops: int = 3) -> DataFrame:
    """target, file, command of the test files that a change of the targets reaches."""
    files = blast_radius(syms, edges, wanted, hops).join(syms.select("id", "file"), "id").select("target", "file").distinct().where(is_test_file(F.col("file")))
    folder = F.regexp_replace("file", r"/[^/]+$", "")
    command = F.when(F.col("file").endswith(".go"), F.concat(F.lit("go test ./"), folder)).when(F.col("file").endswith(".py"), F.concat(F.lit("pytest "), "file")).when(F.col("file").rlike(r"\.[jt]sx?$"), F.concat(F.lit("npx vitest run "), "file")).when(F.col("file").endswith(".rs"), F.lit("cargo test")).otherwise(F.col("file"))
    return files.withColumn("command", command)


def repo_map(syms: DataFrame, edges: DataFrame, budget_tokens: int = 2000) -> DataFrame:
    """file, text: symbols of each file, the most connected files first, while the running size fits the budget."""
    ends = edges.select(F.col("target_id").alias("id"), F.lit(2).alias("w")).unionByName(edges.select(F.col("source_id").alias("id"), F.lit(1).alias("w"))).groupBy("id").agg(F.sum("w").alias("w"))
    first = F.when(F.col("kind").isin("class", "struct", "interface", "type", "enum", "trait"), 0).otherwise(1)
    lines = syms.join(ends, "id", "left").select("file", first.alias("t"), "line", F.coalesce("w", F.lit(0)).alias("w"), F.concat(F.lit("  "), "kind", F.lit(" "), "signature").alias("s"))
    per = lines.groupBy("file").agg(F.sum("w").alias("w"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "line", "s"))), lambda x: x["s"]), "\n").alias("s"))
    text = F.concat_ws("\n", "file", "s")
    size = F.sum(F.octet_length(text) / 4).over(Window.orderBy(F.desc("w"), "file").rowsBetween(Window.unboundedPreceding, 0))  # one row a file
    return per.withColumn("text", text).withColumn("used", size).where(F.col("used") <= budget_tokens).select("file", "text")


def cross_file_cycles(syms: DataFrame, edges: DataFrame, limit: int = 10, longest: int = 8) -> DataFrame:
    """name, files, path of cycles of symbols in more than one file, the shortest first; the path ends where it begins."""
    across = lambda found: found.select("cycle", F.explode("cycle").alias("id")).join(syms.select("id", "file").where("file != ''"), "id").groupBy("cycle").agg(F.count_distinct("file").alias("n")).where("n > 1").limit(limit).count() >= limit
    found = graph.cycles(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target")), longest, enough=across)
    nodes = found.select("cycle", "length", F.posexplode("cycle").alias("n", "id")).join(syms.select("id", "name", "file"), "id", "left")
    shown = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id"))
    per = nodes.groupBy("cycle", "length").agg(F.sort_array(F.collect_set(F.nullif(F.col("file"), F.lit("")))).alias("files"), F.transform(F.sort_array(F.collect_list(F.struct("n", shown.alias("name")))), lambda x: x["name"]).alias("names"))  # as many rows as a cycle has nodes
    path = F.concat("names", F.slice("names", 1, 1))
    return per.where(F.size("files") > 1).orderBy("length", "cycle").limit(limit).select(F.array_join(path, " -> ").alias("name"), "files", path.alias("path"))


def blast_report(syms: DataFrame, edges: DataFrame, wanted: DataFrame, hops: int = 3) -> DataFrame:
    """target, kind (file, symbol, unknown), direct, impacted, files, pct of all symbols, and the number of cross-file cycles that touch it."""
    roots = targets(syms, wanted)
    near = blast_radius(syms, edges, wanted, hops).join(syms.select("id", "file"), "id", "left")
    file = F.nullif(F.col("file"), F.lit(""))
    counts = near.groupBy("target").agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count("*").alias("impacted"), F.count_distinct(file).alias("files"))
    touched = near.select("target", "file").unionByName(roots.join(syms.select(F.col("id").alias("root"), "file"), "root").select("target", "file")).distinct()
    met = cross_file_cycles(syms, edges).select("name", F.explode("files").alias("file")).join(touched, "file").groupBy("target").agg(F.count_distinct("name").alias("cycles"))
    kind = roots.groupBy("target").agg(F.when(F.min("rule") <= 1, "file").otherwise("symbol").alias("kind"))
    out = wanted.select("target").distinct().join(kind, "target", "left").join(counts, "target", "left").join(met, "target", "left").crossJoin(F.broadcast(syms.agg(F.count("*").alias("all"))))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    pct = F.when(F.col("all") > 0, F.round(F.coalesce("impacted", F.lit(0)) / F.col("all") * 100, 2)).otherwise(0.0)
    return out.select("target", F.coalesce("kind", F.lit("unknown")).alias("kind"), zero("direct"), zero("impacted"), zero("files"), pct.alias("pct"), zero("cycles"))


def list_symbols(syms: DataFrame, *, kind: str | None = None, file: str | None = None, name: str | None = None, limit: int = 50) -> DataFrame:
    for column, value in (("kind", kind), ("file", file), ("name", name)):
        syms = syms if value is None else syms.where(F.col(column) == value)
    return syms.orderBy("file", "line", "id").limit(limit)


def symbol_counts(syms: DataFrame) -> DataFrame:
    return syms.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
