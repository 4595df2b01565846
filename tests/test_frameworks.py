"""Framework facts on small files of our own, with expectations by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import analyzers, frameworks

REACT = """import React, { useState, use as read } from 'react';
/* useRef( */
// useMemo(() => 1)
export default function Card({ a }: Props) {
  const [x, setX] = useState<string>('');
  return <Suspense fallback={null}><div /></Suspense>;
}
export const useThing = async (x) => read(x);
const Box = (p: P) => <Theme.Provider value={p} />;
const Plain = () => 1;
const List = [1, 2];
class Old extends React.Component {}
class Other extends Base {}
export function use2fa() { return React.useEffect(() => {}); }
"""
CLASSES = """import { Component } from '@angular/core';
@Component({
  selector: 'app-card', standalone: true,
  imports: [CommonModule, CardList],
})
export class CardComponent implements OnInit {
  @Input() size: number;
  @Input({ required: true }) readonly name!: string;
  colour = input.required<string>();
  @Output() changed = new EventEmitter<string>();
  closed = output<void>();
  constructor(private readonly http: HttpClient, @Inject(TOKEN) t: Token, plain) {}
  ngOnInit() { this.ngOnDestroy(); }
}

@Injectable({ providedIn: 'root' })
export class AuthGuard implements CanActivate {}

@Catch(HttpException)
@Injectable()
class ErrorFilter {}

@Module({ imports: [A, forRoot(B)], providers: [C] })
export class AppModule {}

class Bare {}
"""


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_react_components(spark):
    got = frameworks.react_components(frame(spark, ("a.tsx", REACT), ("b.tsx", None), ("c.tsx", "")))
    assert sorted(map(tuple, got.collect())) == sorted([
        ("a.tsx", "Card", "function-component"), ("a.tsx", "useThing", "custom-hook"), ("a.tsx", "Box", "function-component"), ("a.tsx", "Old", "class-component"), ("a.tsx", "use2fa", "custom-hook"),
    ])


def test_react_facts(spark):
    rows = frame(spark, ("a", REACT), ("b", None), ("c", "const m = memo(x); useFormStatus(); useContext(C); use(p)"))
    a, b, c = [r.f for r in rows.select("path", frameworks.react_facts(F.col("text")).alias("f")).orderBy("path").collect()]
    assert a.hooks == ["read", "useEffect", "useState"] and a.context and a.suspense and not a.memoization
    assert b.hooks == [] and not any(b[1:])
    assert c.hooks == ["useContext", "useFormStatus"] and c.memoization and c.context and c.form_status and not c.suspense


def test_decorated_classes(spark):
    got = {r.name: r for r in frameworks.decorated_classes(frame(spark, ("a.ts", CLASSES), ("b.ts", None))).collect()}
    assert sorted(got) == ["AppModule", "AuthGuard", "CardComponent", "ErrorFilter"]
    card = got["CardComponent"]
    assert (card.kind, card.selector, card.standalone, card.module_imports) == ("component", "app-card", True, ["CommonModule", "CardList"])
    assert card.services == ["HttpClient", "Token"] and card.tokens == ["HttpClient", "TOKEN"]
    assert card.inputs == ["size", "name", "colour"] and card.outputs == ["changed", "closed"] and card.hooks == ["ngOnInit"]
    guard, error, module = got["AuthGuard"], got["ErrorFilter"], got["AppModule"]
    assert (guard.kind, guard.nest_kind, guard.nest_layer, guard.provided_in) == ("guard", "guard", "core", "root")
    assert (error.decorators, error.kind, error.nest_kind) == (["Catch", "Injectable"], None, "filter")
    assert (module.nest_kind, module.nest_layer, module.module_imports, module.module_providers) == ("module", "feature", ["A", "B"], ["C"])


def test_a_long_class_is_read_whole(spark):
    body = "@Component({ selector: 'x' })\nexport class Long {\n" + "  a(b) { return (c); }\n" * 40_000 + "  ngOnInit() {}\n}\n"
    r = frameworks.decorated_classes(frame(spark, ("a.ts", body))).first()
    assert r.hooks == ["ngOnInit"] and r.selector == "x"


@pytest.mark.parametrize(
    ("path", "text", "name"),
    [
        ("a/b.ts", "import { C } from '@nestjs/common'", "nestjs"), ("a/b.ts", "import {\n C\n} from '@angular/core'", "angular"), ("a/b.ts", "// import { C } from '@angular/core'", "generic"), ("a/b.html", None, "angular"),
        ("src/app/page.tsx", None, "nextjs"), ("proxy.ts", "", "nextjs"), ("a/b.ts", "import x from 'next/link'", "nextjs"), ("a/b.jsx", None, "react"), ("a/b.js", "<div>", "react"), ("a/b.ts", "<T>x", "generic"),
        ("a/b.py", None, "generic"), ("a/b.png", None, None), (None, "x", None),
    ],
)
def test_who_analyses(spark, path, text, name):
    assert frame(spark, (path, text)).select(analyzers.chosen(F.col("path"), F.col("text"), frameworks.framework_analyzers()).alias("x")).first().x == name


def test_project_claims(spark):
    deps = spark.createDataFrame([("p", "react", "^18.2.0"), ("p", "next", "14.0.0"), ("p", "zustand", "1"), ("p", "redux", "1"), ("p", "@reduxjs/toolkit", "1"), ("p", "left-pad", "1"), ("q", "@angular/core", "~17"), ("q", "jest", None), ("q", "jest", "2"), ("r", "jest", "1")], "project string, name string, version string")
    files = spark.createDataFrame([("p", "src/app/page.tsx"), ("p", "next.config.mjs"), ("q", "angular.json"), ("q", "lib/angular.json")], "project string, path string")
    got = {(r.project, r.framework): r for r in frameworks.project_claims(deps, files).collect()}
    assert sorted(got) == [("p", "nextjs"), ("p", "react"), ("q", "angular")]
    assert got["p", "nextjs"].indicators == ["dep:next", "dep:react", "disk:app-router", "disk:next-config"] and got["p", "nextjs"].state == ["redux", "zustand"]
    assert got["p", "react"].version == "18.2.0" and got["p", "react"].indicators == ["dep:react", "disk:src-directory"]
    assert (got["q", "angular"].version, got["q", "angular"].testing, got["q", "angular"].indicators) == ("17", ["Jest"], ["dep:@angular/core", "disk:angular-json"])


def test_summaries(spark):
    rows = [("a/x.py", "/**\n * Says it.\n */\nclass A", None), ("a/x.py", "abstract class Foo:", "util"), ("a/x.py", "def go(): pass", None), ("a/x.py", "import y\n\n  total = 1", None), ("a/x.py", "import y", None), ("a/x.py", None, "util")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, text string, kind string")
    got = [r.s for r in df.select("i", frameworks.summary(F.lit("python"), F.col("kind"), F.col("path"), F.col("text")).alias("s")).orderBy("i").collect()]
    assert got == ["python code in x.py: Says it.", "python class 'Foo' in x.py.", "python def 'go' in x.py.", "python code in x.py: total = 1...", "python code in x.py: code definition", "python util in x.py"]


def test_class_summaries(spark):
    rows = frameworks.decorated_classes(frame(spark, ("a.ts", CLASSES))).where("kind is not null").withColumn("content", F.lit("export class X { ngOnInit() {} public a() {} canActivate }"))
    got = {r.kind: r.summary for r in frameworks.class_summary(rows).collect()}
    assert got["component"] == "Angular component 'X' (selector: app-card) with ngOnInit, 3 inputs, 2 outputs."
    assert got["guard"] == "Angular route guard 'X' protecting routes."


def test_snippets(spark):
    text = "a\nb\nconst x = signal(1)\nc\nd\ne\nf\nsignal(2)"
    got = frameworks.pattern_snippets(frame(spark, ("a", text), ("b", None), ("c", "effect ("))).collect()
    assert sorted((r.path, r.name, r.snippet) for r in got) == [("a", "Signals", "b\nconst x = signal(1)\nc\nd\ne"), ("c", "Effect", "effect (")]


def test_own_test_frameworks(spark):
    df = frame(spark, ("a", "import ava; cy.get('x')"), ("b", "jest.fn()"))
    assert sorted(map(tuple, analyzers.test_frameworks(df, table=[("unit", "ava", 1, ["import ava"]), ("unit", "tap", 2, ["tap."])]).collect())) == [("a", "unit", "ava")]
    assert sorted(map(tuple, analyzers.test_frameworks(df).collect())) == [("a", "e2e", "cypress"), ("b", "unit", "jest")]
