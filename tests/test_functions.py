from pyspark.sql import functions as F

from codeloom.functions.cfunctions import extract_functions, functions_in

SOURCE = '''#include <x.h>
int proto(int);
struct S { int a; };
static int f(int n)
{ char *s = "}"; /* } */ if (n) { return 1; } // }
  return '}'; }
namespace N { class C { public: void m() const { x(); } int k; C() : k(0) {} }; }
int arr[] = { 1, 2 };
extern "C" { void g(void) { } }
enum E { A, B };
#define M(x) do { x } while (0)
unsigned long h(a, b) { return a; }
'''


def test_functions_in():
    found = functions_in(SOURCE)
    assert [line for line, _ in found] == [4, 7, 7, 9, 12]
    codes = [code for _, code in found]
    assert codes[0].startswith("static int f(int n)\n{") and codes[0].endswith("return '}'; }")
    assert codes[1:] == ["void m() const { x(); }", "C() : k(0) {}", "void g(void) { }",
                         "unsigned long h(a, b) { return a; }"]


def test_odd_sources():
    assert functions_in("") == []
    assert functions_in("int f(void) { never closed") == []
    assert functions_in("int a; }}} int f() { }") == [(1, "int f() { }")]
    assert functions_in("#define X \\\n { \nint f() { }")[0][1] == "int f() { }"


def codes(text):
    return [code for _, code in functions_in(text)]


def test_conditional_groups_count_once():
    text = "#if A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n return a; }\nint g() { }\n"
    assert [c.split("(")[0] for c in codes(text)] == ["int f", "int g"]
    assert codes("#if 0\nint f() {\n#else\nint f() { }\n#endif\nint g() { }") == ["int f() { }", "int g() { }"]
    nested = "#ifdef A\n#if B\nint a() { }\n#elif C\nint a() {\n#endif\n#else\n#if D\n}}\n#endif\n#endif\nint g() { }"
    assert codes(nested) == ["int a() { }", "int g() { }"]


def test_open_function_ends_at_the_next_definition():
    text = "int f(int a) {\n if (a) {\n return 1;\n}\nstatic int g(void)\n{ return 2; }\nint h() { }\n"
    assert codes(text) == ["int f(int a) {\n if (a) {\n return 1;\n}", "static int g(void)\n{ return 2; }", "int h() { }"]


def test_literals_with_quotes_and_braces():
    assert codes("int f() { return 1'000; }\nint g() { }") == ["int f() { return 1'000; }", "int g() { }"]
    raw = 'int f() { s = R"x(" } )" )x"; }\nint g() { }'
    assert codes(raw) == [raw.split("\n")[0], "int g() { }"]


def test_heads_of_many_shapes():
    for head in ("T& T::operator=(const T& o)", "bool operator==(A a, B b)", "template <class T = int> T f(T x)",
                 "auto f(int n) -> std::vector<int>", "int f(a, b) int a; char *b;", "void operator()(int x)",
                 "Foo::Foo() : a(1), b{2}", "Foo() : a{1}, b{x, {y}}", "int f(int n) const noexcept"):
        assert codes(f"int before;\n{head} {{ x(); }}\nint after() {{ }}") == [f"{head} {{ x(); }}", "int after() { }"], head
    assert codes("struct S { int f(T) const; int g(a) int_t; int h() { } };") == ["int h() { }"]
    assert codes("int x = f(a) {1}; int g() { }") == ["int g() { }"]


def test_extract_functions_keeps_columns(spark):
    df = spark.createDataFrame([("p/a.c", SOURCE, "p"), ("p/b.c", None, "p")], "path string, text string, project string")
    out = extract_functions(df, keep=["project"])
    assert out.columns == ["file", "fn_no", "start_line", "code", "project"]
    assert out.filter(F.col("project") == "p").count() == 5
