"""C and C++ sources by running sums, and the table of parsers."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from findweave.sources.clike import parse_clike

FILES = "relative_path string, language string, content binary"

C_SOURCE = """#ifndef NODE_H
#define NODE_H
#include "node.h"
#include <stdlib.h>
/* int ghost(void) { */
int helper(void); // helper2(
static const char *label = "} { int fake(void) {";
typedef struct s_node
{
    void *content;
    struct s_node *next;
} t_node;
struct point { int x; int y; };
enum color { RED, GREEN };
typedef unsigned long size;
t_node *node_new(void *content)
{
    if (content) {
        size n = helper();
        for (int i = 0; i < 3; i++) { use(i, '}'); }
    }
    return make(content);
}
int counter = 0;
int table[] = { 1, 2 };
extern "C" {
int linked(int a) { return helper(); }
}
#endif
"""

CPP_SOURCE = """#include "cache.hpp"
namespace ns {
class Cache : public Base<int> {
public:
    Cache();
    ~Cache();
    int get(int key) { return helper(key); }
    virtual void put(int k) const = 0;
private:
    int size_ = 0;
};
int Cache::peek(int key) { return this->get(key) + std::max(key, 1); }
template <typename T>
T identity(T value) { return value; }
struct Point { int x; };
enum class Color { RED };
namespace inner { void go() { auto s = R"x(} {)x"; run(s); Thing t(3); } }
}
bool operator==(const A& a, const B& b) { return same(a, b); }
"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("a.c", "c", C_SOURCE.encode()), ("b.cpp", "cpp", CPP_SOURCE.encode()), ("c.c", "c", b"int broken( {\n"), ("d.cpp", "cpp", b"class Broken {\n"), ("e.c", "c", b""), ("f.c", "c", None), ("g.py", "python", b"int f(void) {}")]
    return parse_clike(spark.createDataFrame(rows, FILES)).collect()


def of(parsed, path, entry):
    return [r for r in parsed if r["relative_path"] == path and r["entry"] == entry]


def test_c_symbols(parsed):
    got = sorted((r["qualified_name"], r["kind"], r["visibility"], r["start_line"], r["end_line"]) for r in of(parsed, "a.c", "symbol"))
    assert got == sorted([
        ("NODE_H", "macro", None, 2, 2), ("helper", "function", "declaration", 6, 6), ("label", "variable", None, 7, 7), ("s_node", "struct", None, 8, 12), ("t_node", "type_alias", None, 8, 12),
        ("point", "struct", None, 13, 13), ("color", "enum", None, 14, 14), ("size", "type_alias", None, 15, 15), ("node_new", "function", "definition", 16, 23), ("counter", "variable", None, 24, 24),
        ("table", "variable", None, 25, 25), ("linked", "function", "definition", 27, 27),
    ])


def test_signature_and_hash_are_of_the_source(parsed):
    node = next(r for r in of(parsed, "a.c", "symbol") if r["name"] == "node_new")
    text = "\n".join(C_SOURCE.split("\n")[15:23])
    assert node["signature"] == "t_node *node_new(void *content)"
    assert node["content_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_includes(parsed):
    assert sorted((r["target"], r["kind"], r["start_line"]) for r in of(parsed, "a.c", "import")) == [("node.h", "local", 3), ("stdlib.h", "external", 4)]
    assert [(r["target"], r["kind"]) for r in of(parsed, "b.cpp", "import")] == [("cache.hpp", "local")]


def test_calls_have_their_caller(parsed):
    assert sorted((r["name"], r["parent"], r["start_line"]) for r in of(parsed, "a.c", "call")) == [("helper", "linked", 27), ("helper", "node_new", 19), ("make", "node_new", 22), ("use", "node_new", 20)]
    got = sorted((r["name"], r["parent"]) for r in of(parsed, "b.cpp", "call"))
    assert got == [("get", "ns::Cache::peek"), ("helper", "ns::Cache::get"), ("max", "ns::Cache::peek"), ("run", "ns::inner::go"), ("same", "operator==")]


def test_cpp_symbols(parsed):
    got = sorted((r["qualified_name"], r["name"], r["kind"], r["visibility"], r["parent"]) for r in of(parsed, "b.cpp", "symbol"))
    cache = "ns::Cache"
    assert got == sorted([
        (cache, "Cache", "class", None, "ns"), (f"{cache}::Cache", "Cache", "method", "declaration", cache), (f"{cache}::~Cache", "~Cache", "method", "declaration", cache), (f"{cache}::get", "get", "method", "definition", cache),
        (f"{cache}::put", "put", "method", "declaration", cache), (f"{cache}::peek", "peek", "method", "definition", "ns"), ("ns::identity", "identity", "function", "definition", "ns"), ("ns::Point", "Point", "struct", None, "ns"),
        ("ns::Color", "Color", "enum", None, "ns"), ("ns::inner::go", "go", "function", "definition", "ns::inner"), ("operator==", "operator==", "function", "definition", None),
    ], key=lambda r: (r[0], r[1]))
    assert next(r for r in of(parsed, "b.cpp", "symbol") if r["name"] == "identity")["signature"].startswith("template <typename T>")


def test_errors_are_entries(parsed):
    assert [r["relative_path"] for r in sorted(parsed) if r["entry"] == "error"] == ["c.c", "d.cpp"]
    assert not [r for r in parsed if r["relative_path"] in ("e.c", "f.c", "g.py")]


def test_parsers_by_language(spark):
    from findweave.sources import languages

    rows = [("a.c", "c", b"int f(void) { return g(); }"), ("b.py", "python", b"def h():\n    return k()\n"), ("c.go", "go", b"func x() {}")]
    df = spark.createDataFrame(rows, FILES)
    got = sorted((r["relative_path"], r["entry"], r["name"]) for r in languages.parsed(df).collect())
    assert got == [("a.c", "call", "g"), ("a.c", "symbol", "f"), ("b.py", "call", "k"), ("b.py", "symbol", "h")]
    go = lambda files: files.select("relative_path", F.lit("symbol").alias("entry"), F.regexp_extract(F.decode("content", "utf-8"), r"func (\w+)", 1).alias("name"))
    more = languages.parsed(df, {**languages.PARSERS, "go": go})
    assert ("c.go", "symbol", "x") in {(r["relative_path"], r["entry"], r["name"]) for r in more.collect()}
    assert languages.unsupported(df).collect() == [("c.go", "go")]


def test_segments_are_made_once(spark, monkeypatch):
    """Scopes read segments several times; the tokens aren't made anew for each, and few bytes of text still fill all partitions."""
    from findweave.sources import clike

    made, write = [], clike.materialize
    monkeypatch.setattr(clike, "materialize", lambda df, label: made.append((label, df.rdd.getNumPartitions())) or write(df, label))
    files = spark.createDataFrame([(f"f{k}.c", "c", bytearray(b"int f(int a) { return g(a); }\n")) for k in range(40)], "relative_path string, language string, content binary")
    found = clike.parse_clike(files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 0
    assert made == [("segments", int(spark.conf.get("spark.sql.shuffle.partitions")))]
    assert found.where("entry = 'symbol'").count() == found.where("entry = 'call'").count() == 40
