"""Script declarations, bindings and references."""

import pytest

from lodestone.operators import scripts


def sources(spark, **files):
    rows = [(p.replace("__", "/").replace("_dot_", "."), "typescript", c) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, language string, content string")


def run(spark, files):
    df = spark.createDataFrame([(p, "typescript", c) for p, c in files.items()], "path string, language string, content string")
    none = spark.createDataFrame([], "prefix string, replacement string"), spark.createDataFrame([("@lib/ui", "packages/ui/index.ts")], "name string, entry string")
    return scripts.script_usages(df, *none)


CARD = """
export class UserService {}
class LocalService {}
export default class DefaultService {}
export interface User { id: string }
export type UserID = string
export enum Role { Admin }
export function loadUser() {}
export const saveUser = async () => {}
export function UserCard() { return <div /> }
const LocalCard = () => <span />
function outer() { class Inner {} ; function inner() {} }
// export class Commented {}
const text = "export class Quoted {}" + `class T {}` + (/class R {}/).source
"""

APP = """
import DefaultCard from "./DefaultCard";
import {
  UserCard,
  type CardProps as Props,
} from "./cards";
import * as api from "@weka/api";
import type { User } from "@models/user";
import type DefaultUser from "./DefaultUser";
import "./setup";
import Both, { one, two as three } from "./both";
const lazy = import("./lazy");
const unknown = import(modulePath);
export { UserService as Service } from "./service";
export * from "./models";
export * as all from "./every";
export type { UserRole } from "./roles";
const x = 1, y = 2;
export { x, y as z };
export default x;
"""


def test_declarations(spark):
    declared, _, _ = run(spark, {"src/components/UserCard.tsx": CARD})
    got = {(r["kind"], r["qualified_name"].split("#")[1], r["export_name"]) for r in declared.collect()}
    assert got == {
        ("class", "UserService", "UserService"), ("class", "LocalService", ""), ("class", "DefaultService", "default"), ("interface", "User", "User"), ("type", "UserID", "UserID"), ("enum", "Role", "Role"),
        ("function", "loadUser", "loadUser"), ("function", "saveUser", "saveUser"), ("component", "UserCard", "UserCard"), ("component", "LocalCard", ""), ("function", "outer", ""),
    }
    assert {r["module"] for r in declared.collect()} == {"src/components/UserCard"}


def test_imports_and_exports(spark):
    _, references, _ = run(spark, {"src/App.tsx": APP})
    got = {(r["type"], r["module"], r["target_export"], r["local_name"], r["export_alias"], r["type_only"]) for r in references.collect()}
    assert got == {
        ("imports_value", "./DefaultCard", "default", "DefaultCard", "", False), ("imports_value", "./cards", "UserCard", "UserCard", "", False), ("imports_type", "./cards", "CardProps", "Props", "", True),
        ("imports_namespace", "@weka/api", "*", "api", "", False), ("imports_type", "@models/user", "User", "User", "", True), ("imports_type", "./DefaultUser", "default", "DefaultUser", "", True),
        ("imports_module", "./setup", "*", "", "", False), ("imports_value", "./both", "default", "Both", "", False), ("imports_value", "./both", "one", "one", "", False), ("imports_value", "./both", "two", "three", "", False),
        ("imports_module", "./lazy", "*", "", "", False), ("imports_module", "", "", "", "", False),
        ("reexports_value", "./service", "UserService", "", "Service", False), ("reexports_all", "./models", "*", "", "", False), ("reexports_all", "./every", "*", "", "all", False), ("reexports_type", "./roles", "UserRole", "", "UserRole", True),
        ("exports_local", "src/App", "x", "", "x", False), ("exports_local", "src/App", "y", "", "z", False), ("exports_local", "src/App", "x", "", "default", False),
    }


LIB = "export function load() {}\nexport class Box {}\nexport interface Shape {}\nfunction hidden() {}\nexport { hidden as shown };\nexport default function main() {}\n"
BARREL = "export { load as fetchAll, Box } from './lib';\nexport * from './lib';\nimport main from './lib';\nexport { main as start };\n"
USE = """import { fetchAll, Box, shown, start, missing } from "./barrel";
import * as lib from "./lib";
import type { Shape } from "./lib";
import { ui } from "@lib/ui";
import { gone } from "elsewhere";

function work(value: Shape, { ui: other }): Box {
  fetchAll(value);
  shown();
  const b: Box = new Box();
  helper(b);
  lib.load();
  start(); missing(); gone(); ui();
  lib["load"]();
  return new Unknown();
}
function helper(fetchAll) {
  fetchAll();
  [1].map(shown => shown());
  [1].map((x) => { const start = 1; for (const lib of []) { lib.load(); } return start(); });
  { let helper = 2; helper(); }
  helper();
  lib.load();
  try { } catch (gone) { gone(); }
  const o = { fetchAll() { shown(); }, m(shown) { return shown(); } };
}
class C { run(missing) { missing(); this.fetchAll(); } }
"""


def test_usages(spark):
    declared, _, used = run(spark, {"src/lib.ts": LIB, "src/barrel.ts": BARREL, "src/use.ts": USE, "packages/ui/index.ts": "export const ui = () => 1\n"})
    names = {r["id"]: (r["path"].split("/")[-1].split(".")[0] if "ui" not in r["path"] else "ui", r["name"]) for r in declared.collect()}
    rows = [r for r in used.collect() if r["path"] == "src/use.ts"]
    got = sorted((r["line"], r["type"], r["name"], "/".join(names[r["symbol_id"]]) if r["symbol_id"] else "", r["resolution"], r["reason"].split(" ")[0]) for r in rows)
    assert got == sorted([
        (7, "type_reference", "Shape", "lib/Shape", "EXACT", ""), (7, "type_reference", "Box", "lib/Box", "EXACT", ""), (8, "calls_export", "fetchAll", "lib/load", "EXACT", ""), (9, "calls_export", "shown", "lib/hidden", "EXACT", ""),
        (10, "type_reference", "Box", "lib/Box", "EXACT", ""), (10, "instantiates", "Box", "lib/Box", "EXACT", ""), (11, "calls_local", "helper", "use/helper", "EXACT", ""), (12, "calls_export", "load", "lib/load", "EXACT", ""),
        (13, "calls_export", "start", "lib/main", "EXACT", ""), (13, "calls_export", "missing", "", "UNRESOLVED", ""), (13, "calls_export", "gone", "", "UNRESOLVED", ""), (13, "calls_export", "ui", "ui/ui", "EXACT", ""),
        (14, "calls_export", "lib", "", "UNRESOLVED", "computed"), (15, "instantiates", "Unknown", "", "UNRESOLVED", "constructor"),
        (18, "calls_export", "fetchAll", "", "UNRESOLVED", "lexically"), (19, "calls_export", "shown", "", "UNRESOLVED", "lexically"), (20, "calls_export", "load", "", "UNRESOLVED", "lexically"), (20, "calls_export", "start", "", "UNRESOLVED", "lexically"),
        (21, "calls_local", "helper", "", "UNRESOLVED", "lexically"), (22, "calls_local", "helper", "use/helper", "EXACT", ""), (23, "calls_export", "load", "lib/load", "EXACT", ""), (24, "calls_export", "gone", "", "UNRESOLVED", "lexically"),
        (25, "calls_export", "shown", "lib/hidden", "EXACT", ""), (25, "calls_export", "shown", "", "UNRESOLVED", "lexically"), (27, "calls_export", "missing", "", "UNRESOLVED", "lexically"),
    ])
    owners = {(r["line"], names.get(r["owner_id"], ("", ""))[1]) for r in rows}
    assert {(8, "work"), (20, "helper"), (27, "C")} <= owners and all(o for _, o in owners)
    assert {r["category"] for r in rows} == {"direct_reference", "unresolved"}


@pytest.mark.parametrize("text", ["", "{{{(((", "'unclosed\nexport class A {}", "`open ${", "/* open", "a / b / c", "]})"])
def test_any_text(spark, text):
    declared, _, used = run(spark, {"a.ts": text, "b.ts": None})
    assert declared.count() == ("class A" in text) and used.count() == 0
