"""Extraction from languages with braces, imports, and resolution over joins."""

import pytest
from pyspark.sql import functions as F

from sparkmem.functions import blocks
from sparkmem.operators import code

GO = '''package svc // func notThis() {
import (
	"fmt"
	str "strings"
	. "example.com/x/proj/internal/util"
)
/* type Fake struct { */
type (
	Kind int
	Store struct { path string; m map[string]interface{} }
	Reader interface { Read(p []byte) (n int, err error) }
)
type Opt func(*Store) error
const q = `func hidden() { if x {} }`
func helper(a int) int { for i := range a { s.Do(a); if "if && {" == x && y { return 1 } }; return Clean(a) }
func (s *Store) Save(ctx context.Context, v interface{}) (map[string]interface{}, error) {
	switch v.(type) {
	case int, string:
		helper(1)
	case error:
	default:
	}
	select { case <-ctx.Done(): return nil, nil }
	x := &Opts{A: 1}
	r := '{'
	go func() { fmt.Println("hi") }()
	return a.b.c(x), nil
}
'''


def test_go():
    symbols, relations = blocks.facts("internal/svc/a.go", "go", GO)
    assert [(s[1], s[2], s[3], s[4], s[7]) for s in symbols] == [
        ("module", "a.go", None, 1, 1), ("type", "Kind", None, 9, 1), ("struct", "Store", None, 10, 1), ("interface", "Reader", None, 11, 1), ("type", "Opt", None, 13, 1),
        ("function", "helper", None, 15, 4), ("method", "Save", "Store", 16, 5),
    ]
    assert symbols[6][5] == "func (s *Store) Save(ctx context.Context, v interface{}) (map[string]interface{}, error)"
    got = [r[1:4] for r in relations if r[3] != "defines"]
    assert got == [
        ("Store", "Save", "contains"), ("Save", "Store", "implements"), ("helper", "s.Do", "calls"), ("helper", "Clean", "calls"),
        ("Save", "helper", "calls"), ("Save", "ctx.Done", "calls"), ("Save", "Opts", "instantiates"), ("Save", "fmt.Println", "calls"),
    ]
    assert [r[2] for r in relations if r[3] == "defines"] == [s[2] for s in symbols[1:]]


CASES = {
    "typescript": ("class Cart extends Base<Item> implements Sized, Other {\n constructor(x) { super(x) }\n async add(i: Item): Promise<void> { if (a && b) { this.check(i) } else helper(`{`) }\n}\nexport const make = (a: {b: 1}) => { return new Cart(a) }\nconst short = x => helper(x)\nfunction helper(s): {b: number} { return /[{\"]+/.test(s) ? other.deep(1) : 2 }",
                   [("Cart", None), ("add", "Cart"), ("make", None), ("short", None), ("helper", None)], [("Cart", "Base", "extends"), ("Cart", "Sized", "implements"), ("Cart", "Other", "implements"), ("Cart", "add", "contains"), ("add", "this.check", "calls"), ("add", "helper", "calls"), ("make", "Cart", "instantiates"), ("short", "helper", "calls"), ("helper", "other.deep", "calls")]),
    "rust": ("pub trait Run { fn run(&self) -> u8; }\npub struct Cfg { a: u8 }\nimpl<T: Clone> Run for Cfg { fn run(&self) -> u8 { let s = r#\"fn no() {\"#; if self.a > 0 && ok() { helper::<u8>('{') } else { Cfg::make(3) } } }\nimpl Cfg { pub fn make(a: u8) -> Self { Cfg { a } } }\nfn helper<'a>(x: &'a u8) -> u8 where u8: Copy { vec![1]; *x }",
             [("Run", None), ("run", "Run"), ("Cfg", None), ("run", "Cfg"), ("make", "Cfg"), ("helper", None)], [("Run", "run", "contains"), ("Cfg", "Run", "implements"), ("Cfg", "run", "contains"), ("Cfg", "make", "contains"), ("run", "ok", "calls"), ("run", "helper", "calls"), ("run", "Cfg.make", "calls"), ("make", "Cfg", "instantiates"), ("helper", "vec", "calls")][:8]),
    "java": ("@Service(\"x {\")\npublic final class C<T extends Comparable<T>> extends Base<T> implements Run, Stop<T> {\n @Override public <R> List<R> map(Function<T, R> f) throws IOException { for (T t : xs) { if (ok(t) || no()) f.apply(t); } return new P(1, 2); }\n abstract void later(int a);\n record P(int x, int y) { int sum() { return x + y; } }\n}",
             [("C", None), ("map", "C"), ("later", "C"), ("P", "C"), ("sum", "P")], [("C", "Base", "extends"), ("C", "Run", "implements"), ("C", "Stop", "implements"), ("C", "map", "contains"), ("C", "later", "contains"), ("C", "P", "contains"), ("P", "sum", "contains"), ("map", "ok", "calls"), ("map", "no", "calls"), ("map", "f.apply", "calls"), ("map", "P", "instantiates")]),
    "kotlin": ("data class P(val x: Int = f(2)) : Base(x), Run {\n override fun go(a: Int): Int = helper(a) + 1\n companion object { fun make() = P(1) }\n}\nfun String.shout(): String { return this.upper() }",
               [("P", None), ("go", "P"), ("make", "P"), ("shout", "String")], [("P", "Base", "extends"), ("P", "Run", "implements"), ("P", "go", "contains"), ("P", "make", "contains"), ("String", "shout", "contains"), ("go", "helper", "calls"), ("shout", "this.upper", "calls")]),
    "csharp": ("namespace Acme.Svc {\n public class S : Base, IRun {\n  string p = @\"c:\\{\";\n  public async Task<int> Go(int a) { if (a > 0 && Ok()) { return Helper.Do(a); } return new T(1).X; }\n  int Short() => Calc(2);\n }\n}",
               [("Acme.Svc", None), ("S", None), ("Go", "S"), ("Short", "S")], [("S", "Base", "extends"), ("S", "IRun", "implements"), ("S", "Go", "contains"), ("S", "Short", "contains"), ("Go", "Ok", "calls"), ("Go", "Helper.Do", "calls"), ("Go", "T", "instantiates"), ("Short", "Calc", "calls")]),
    "cpp": ("class S : public Base { public: int go() const { return helper(1); } };\nint acme::S::deep(int x) { if (x) { return '\"'; } for (;;) { step(x); } }",
            [("S", None), ("go", "S"), ("deep", "S")], [("S", "Base", "extends"), ("S", "go", "contains"), ("S", "deep", "contains"), ("go", "helper", "calls"), ("deep", "step", "calls")]),
    "php": ("<?php\nclass A extends B implements C { public function go($x) { if ($x) { return $this->help(\"}\"); } return new Foo($x); } # }\n}\nfunction top() { go(); }",
            [("A", None), ("go", "A"), ("top", None)], [("A", "B", "extends"), ("A", "C", "implements"), ("A", "go", "contains"), ("go", "$this.help", "calls"), ("go", "Foo", "instantiates"), ("top", "go", "calls")]),
    "swift": ("protocol Run { func run() -> Int }\nclass S: Base, Run { func run() -> Int { guard ok() else { return 0 }; return helper(1) } }\nextension S { static func make() -> S { return S() } }",
              [("Run", None), ("run", "Run"), ("S", None), ("run", "S"), ("make", "S")], [("Run", "run", "contains"), ("S", "Base", "implements"), ("S", "Run", "implements"), ("S", "run", "contains"), ("S", "make", "contains"), ("run", "ok", "calls"), ("run", "helper", "calls"), ("make", "S", "calls")]),
}


@pytest.mark.parametrize("language", CASES)
def test_blocks(language):
    text, symbols, relations = CASES[language]
    got, found = blocks.facts("a/b.x", language, text)
    assert [(s[2], s[3]) for s in got[1:]] == symbols
    assert [r[1:4] for r in found if r[3] != "defines"] == relations


@pytest.mark.parametrize(("language", "text"), [("typescript", "{" * 300_000), ("go", "func f() { " * 30_000), ("rust", "impl<" * 20_000), ("java", "public static <T x " * 20_000), ("go", '"' * 100_000), ("cpp", ""), ("php", "/*" * 50_000)])
def test_odd_text_is_quick(language, text):
    assert blocks.facts("a", language, text)[0][0][1] == "module" and blocks.imports("a", language, text) == []


def test_imports():
    each = lambda p, l, t: [x[1:5] for x in blocks.imports(p, l, t)]
    assert each("a/b.go", "go", GO) == [("fmt", False, "*", "fmt"), ("strings", False, "*", "str"), ("example.com/x/proj/internal/util", False, "*", "*")]
    assert each("src/a.ts", "typescript", "import R, { b as c, type D } from '../lib/r'\nimport * as ns from './ns/index.js'\nexport * from './again'") == [
        ("lib/r", True, "default", "R"), ("lib/r", True, "b", "c"), ("lib/r", True, "D", "D"), ("src/ns/index", True, "*", "ns"), ("src/again", True, "*", "*")]
    assert each("src/net/b.rs", "rust", "use crate::util::{self, clean as c, deep::{Inner, *}};\nuse super::base::Thing;") == [
        ("", False, "util", "util"), ("util", False, "clean", "c"), ("util/deep", False, "Inner", "Inner"), ("util/deep", False, "*", "*"), ("src/net/base", True, "Thing", "Thing")]
    assert each("a/m.py", "python", "from .x import f as g, h\nfrom ..y.z import *\nimport k.l as m\nfrom p.q import (r,\n s)") == [
        ("a/x", True, "f", "g"), ("a/x", True, "h", "h"), ("y/z", True, "*", "*"), ("k/l", False, "*", "m"), ("p/q", False, "r", "r"), ("p/q", False, "s", "s")]
    assert each("C.java", "java", "import java.util.List;\nimport static com.acme.Util.*;") == [("java/util", False, "List", "List"), ("com/acme/Util", False, "*", "*")]


def test_resolution(spark):
    files = [
        ("internal/util/clean.go", "go", "package util\nfunc Clean(a int) int { return a }\nfunc Other() {}"),
        ("vendor/old/clean.go", "go", "package old\nfunc Clean(a int) int { return a }"),
        ("cmd/run.go", "go", 'package main\nimport "example.com/x/internal/util"\nfunc Run() { util.Clean(1); local(); shared(); only(); many() }\nfunc local() {}'),
        ("cmd/more.go", "go", "package main\nfunc shared() {}"),
        ("z/a.go", "go", "package z\nfunc only() {}\nfunc many() {}"),
        ("z/y/b.go", "go", "package y\nfunc many() {}"),
        ("web/app.ts", "typescript", "import { go as start } from './lib'\nexport function main() { start() }"),
        ("web/lib.ts", "typescript", "export function go() {}"),
        ("other/lib.ts", "typescript", "export function go() {}"),
        ("src/acme/Use.java", "java", "package acme;\nimport acme.deep.Tool;\nclass Use { void use() { Tool.fix(); } }"),
        ("src/acme/deep/Tool.java", "java", "package acme.deep;\nclass Tool { static void fix() {} }"),
        ("src/acme/near/Tool2.java", "java", "package acme.near;\nclass Tool2 { static void fix() {} }"),
    ]
    df = spark.createDataFrame(files, "path string, language string, content string")
    syms = code.symbols(df).cache()
    edges = code.resolve(syms, code.relations(df), code.imports(df)).where("relation = 'calls'")
    at = syms.select("id", F.concat("file", F.lit("#"), "name").alias("at"))
    got = {(r.a, r.b, r.confidence) for r in edges.join(at.withColumnsRenamed({"id": "source_id", "at": "a"}), "source_id").join(at.withColumnsRenamed({"id": "target_id", "at": "b"}), "target_id").collect()}
    run = "cmd/run.go#Run"
    assert got == {
        (run, "internal/util/clean.go#Clean", 1.0), (run, "cmd/run.go#local", 0.8), (run, "cmd/more.go#shared", 0.8), (run, "z/a.go#only", 0.8), (run, "z/a.go#many", 0.5),
        ("web/app.ts#main", "web/lib.ts#go", 1.0), ("src/acme/Use.java#use", "src/acme/deep/Tool.java#fix", 1.0),
    }
    one = syms.where("name = 'only'").first().id
    exact = spark.createDataFrame([("cmd/run.go", "Run", one, "calls", 1)], code.RELATIONS)
    assert [(r.target_id, r.confidence) for r in code.resolve(syms, exact).collect()] == [(one, 1.0)]


def test_hubs_leave_names_out(spark):
    syms = spark.createDataFrame([("1", "Context", "a"), ("2", "Save", "a"), ("3", "x", "b")], "id string, name string, file string")
    edges = spark.createDataFrame([("3", "1"), ("2", "1"), ("3", "2"), ("1", "2")], "source_id string, target_id string")
    assert [r.name for r in code.hubs(syms, edges).collect()] == ["Save", "x"]
