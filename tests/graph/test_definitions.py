from codeloom.plans import views
from codeloom.sources import definitions as D

TS = """import { helper } from './b';
/* class Ghost {
*/
export function main(a: string): void {
  const s = "function fake() {";
  helper(s); // other()
  if (a) { inner(); }
}
const inner = (x) => {
  return main(x);
};
export class Dog extends Animal implements Pet, Friend {
  bark(n: number): void {
    this.wag();
    obj.run();
  }
  wag() { inner(1); }
}
export interface Pet { name: string }
"""
RUST = """pub struct Cat<'a> { name: &'a str }
impl Animal for Cat<'_> {
    fn speak(&self) -> char { helper(); self.purr(); 'x' }
}
fn helper()
{
    deep('{');
}
"""
PYTHON = "class A(B):\n    def m(self):\n        self.n()\n        free()\n    def n(self):\n        x.y()\ndef free():\n    return _hidden()\ndef _hidden(): pass\n"
FILES = [
    ("/w/a.ts", TS, "typescript"), ("/w/r.rs", RUST, "rust"), ("/w/p.py", PYTHON, "python"), ("/w/b.ts", "export function helper(x) {\n  return x;\n}\n", "typescript"), ("/w/n.ts", None, "typescript"), ("/w/broken.py", "def (", "python"),
    ("/w/J.java", "public class J extends K {\n    public int run(String a) {\n        go();\n        return 1;\n    }\n}\n", "java"), ("/w/m.go", "package m\nfunc Run() {\n\thelp()\n}\nfunc (t *T) go2() {\n}\ntype T struct {\n}\n", "go"),
    ("/w/C.cs", "public class C : D\n{\n    public void Run()\n    {\n        Go();\n    }\n}\n", "csharp"),
]


def test_definitions_and_calls(spark):
    nodes, edges = D.extract(spark.createDataFrame(FILES, "path string, text string, lang string"))
    got = {(r.id, r.type, r.start_line, r.end_line, r.is_exported) for r in nodes.collect()}
    assert got == {
        ("/w/C.cs:C", "class", 1, 7, True), ("/w/C.cs:Run", "method", 3, 6, True), ("/w/J.java:J", "class", 1, 6, True), ("/w/J.java:run", "method", 2, 5, True),
        ("/w/a.ts:main", "function", 4, 8, True), ("/w/a.ts:inner", "function", 9, 11, False), ("/w/a.ts:Dog", "class", 12, 18, True), ("/w/a.ts:bark", "method", 13, 16, True),
        ("/w/a.ts:wag", "method", 17, 17, True), ("/w/a.ts:Pet", "interface", 19, 19, True), ("/w/b.ts:helper", "function", 1, 3, True), ("/w/m.go:Run", "function", 2, 4, True),
        ("/w/m.go:go2", "method", 5, 6, False), ("/w/m.go:T", "class", 7, 8, True), ("/w/p.py:A", "class", 1, 6, True), ("/w/p.py:m", "method", 2, 4, True), ("/w/p.py:n", "method", 5, 6, True),
        ("/w/p.py:free", "function", 7, 8, True), ("/w/p.py:_hidden", "function", 9, 9, False), ("/w/r.rs:Cat", "class", 1, 1, True), ("/w/r.rs:speak", "function", 3, 3, False), ("/w/r.rs:helper", "function", 5, 8, False),
    }
    stub = "@@external:"
    assert {(r.source_id[3:], r.target_id, r.type_relation, r.source_line) for r in D.resolve_edges(nodes, edges).collect()} == {
        ("C.cs:C", stub + "D", "INHERITS", 1), ("C.cs:Run", stub + "Go", "CALLS", 5), ("J.java:J", stub + "K", "INHERITS", 1), ("J.java:run", stub + "go", "CALLS", 3),
        ("a.ts:Dog", "/w/a.ts:Pet", "IMPLEMENTS", 12), ("a.ts:Dog", stub + "Animal", "INHERITS", 12), ("a.ts:Dog", stub + "Friend", "IMPLEMENTS", 12), ("a.ts:bark", "/w/a.ts:wag", "CALLS", 14),
        ("a.ts:inner", "/w/a.ts:main", "CALLS", 10), ("a.ts:main", "/w/b.ts:helper", "CALLS", 6), ("a.ts:main", "/w/a.ts:inner", "CALLS", 7), ("a.ts:wag", "/w/a.ts:inner", "CALLS", 17),
        ("m.go:Run", stub + "help", "CALLS", 3), ("p.py:A", stub + "B", "INHERITS", 1), ("p.py:free", "/w/p.py:_hidden", "CALLS", 8), ("p.py:m", "/w/p.py:n", "CALLS", 3), ("p.py:m", "/w/p.py:free", "CALLS", 4),
        ("r.rs:Cat", stub + "Animal", "IMPLEMENTS", 1), ("r.rs:helper", stub + "deep", "CALLS", 7), ("r.rs:speak", "/w/r.rs:helper", "CALLS", 3),
    }


def test_no_files(spark):
    nodes, edges = D.extract(spark.createDataFrame([], "path string, text string, lang string"))
    assert nodes.count() == 0 and edges.count() == 0


def test_registered_query(spark):
    assert {(r.source_id, r.target_id, r.type_relation, r.source_line) for r in views.x7_call_graph(spark, "").collect()} == {
        ("/ws/a.ts:main", "/ws/b.ts:help", "CALLS", 3), ("/ws/a.ts:Dog", "/ws/b.ts:Animal", "INHERITS", 6), ("/ws/a.ts:bark", "/ws/a.ts:wag", "CALLS", 8), ("/ws/a.ts:wag", "/ws/a.ts:main", "CALLS", 10),
        ("/ws/c.py:m", "/ws/c.py:n", "CALLS", 3), ("/ws/c.py:n", "/ws/c.py:free", "CALLS", 5), ("/ws/d.rs:speak", "/ws/d.rs:help", "CALLS", 3), ("/ws/d.rs:Cat", "/ws/d.rs:Pet", "IMPLEMENTS", 1),
    }
