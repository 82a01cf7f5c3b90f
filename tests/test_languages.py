import pytest

from lodestrata.sources import code

SAMPLES = {
    "a.cpp": ("namespace box {\nclass Ring : public Base {\n public:\n  int size() const {\n    return n;\n  }\n};\n}\n", {("box", "module"), ("Ring", "class"), ("size", "method")}, {("Base", "implements")}),
    "a.cs": ("namespace Box {\n    public class Ring : Base, IThing {\n        public int Size(int a) {\n            return Count(a);\n        }\n    }\n}\n", {("Box", "module"), ("Ring", "class"), ("Size", "method")}, {("Base", "implements"), ("IThing", "implements"), ("Count", "calls")}),
    "a.kt": ("data class Ring(val n: Int) : Base {\n    fun size(a: Int): Int {\n        return count(a)\n    }\n}\nfun top() = 1\n", {("Ring", "class"), ("size", "method"), ("top", "function")}, {("Base", "implements"), ("count", "calls")}),
    "a.swift": ("protocol Sized {}\nstruct Ring: Sized {\n    func size() -> Int {\n        return count()\n    }\n}\n", {("Sized", "trait"), ("Ring", "struct"), ("size", "method")}, {("Sized", "implements"), ("count", "calls")}),
    "a.rb": ("module Box\n  class Ring < Base\n    include Sized\n    def size?\n      count(1)\n    end\n  end\nend\n", {("Box", "module"), ("Ring", "class"), ("size?", "method")}, {("Base", "implements"), ("Sized", "implements"), ("count", "calls")}),
    "a.tsx": ("export class Ring extends Base implements Sized {\n}\nexport function View(p: Props) {\n  return draw(p);\n}\n", {("Ring", "class"), ("View", "function")}, {("Base", "implements"), ("Sized", "implements"), ("Props", "uses"), ("draw", "calls")}),
    "a.php": ("<?php\nclass Ring extends Base {\n  public function size($a) {\n    return count($a);\n  }\n}\n", {("Ring", "class"), ("size", "method")}, {("Base", "implements")}),
    "a.go": ("package a\n\nfunc (r *Ring) Size() int {\n\treturn count(r)\n}\n", {("Size", "function")}, {("count", "calls")}),
    "a.hlsl": ("struct VSIn { float3 p; };\nfloat4 main(VSIn v)\n{\n  return mul(v.p, 1);\n}\n", {("VSIn", "struct"), ("main", "function")}, {("mul", "calls")}),
    "a.sql": ("CREATE TABLE IF NOT EXISTS rings (id INT);\ncreate or replace function grow(a int)\n", {("rings", "struct"), ("grow", "function")}, set()),
    "a.ex": ("defmodule Box.Ring do\n  def size(a) do\n    count(a)\n  end\nend\n", {("Box.Ring", "module"), ("size", "method")}, {("count", "calls")}),
}


@pytest.mark.parametrize("path", sorted(SAMPLES))
def test_symbols_and_references(path):
    text, symbols, references = SAMPLES[path]
    assert {(s[0], s[1]) for s in code.symbols(path, text)} >= symbols
    assert {(r[0], r[2]) for r in code.references(path, text)} >= references


def test_no_definitions():
    for path in SAMPLES:
        assert code.symbols(path, "") == [] and code.references(path, "") == []
