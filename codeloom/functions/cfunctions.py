"""C and C++ function bodies by brace matching."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH_CHARS = 32 << 20

# Pieces of source in which braces and semicolons mean nothing, then the marks that matter.
_PIECES = re.compile(
    r"""(?=[/uULR"0-9' \t#{};()])(?:"""  # how each begins, so that most characters are passed by at once
    r"/\*.*?(?:\*/|\Z)"
    r"|//(?:[^\n\\]|\\.)*"
    r'|\b(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{0,16})\(.*?\)(?P=mark)"'
    r'|"(?:[^"\\\n]|\\.)*"?'
    r"|\b[0-9][\w']*"  # a number, with digit separators
    r"|'(?:[^'\\\n]|\\.)*'?"
    r"|^[ \t]*\#(?:[^\n\\]|\\.)*"
    r"|[{};()])",
    re.S | re.M)
_CONTAINER = re.compile(r"\b(?:namespace|class|struct|union|enum|extern)\b")
_PARAMS_END = re.compile(r"\)[\w\s&*:,()\->\[\]<>]*\Z", re.S)
_NAME_AND_PARAMS = re.compile(r"(?:[A-Za-z_~][\w:~]*|operator\s*\S{1,3})\s*\(")
_ACCESS = re.compile(r"(?:(?:public|private|protected)\s*:\s*)+")
_CONTROL = re.compile(r"\A\s*(?:if|for|while|switch|do|else|return|catch)\b")
_TEMPLATE = re.compile(r"\btemplate\s*<[^<>]*(?:<[^<>]*>[^<>]*)*>")
_OPERATOR = re.compile(r"\boperator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]{1,3})")
# A member of a constructor's list, before its opening brace: ``Foo() : a(1), b``.
_MEMBER = re.compile(r"\)[\w\s]*:(?!:).*[\w>]\s*\Z", re.S)
_COLON = re.compile(r"(?<!:):(?!:)")
# Old style: ``f(a, b) int a; char *b;`` before the brace; names only in the list, then declarations.
_OLD_LIST = r"\A[\w\s*]*\w\s*\(\s*\w+(?:\s*,\s*\w+)*\s*\)\s*"
_OLD_NEXT = re.compile(_OLD_LIST + r"(?:[A-Za-z_][\w\s*,\[\]]*;\s*)*(?P<last>[A-Za-z_]\w*[\s*]+[\w\s*,\[\]]*)\Z")
_OLD_HEAD = re.compile(_OLD_LIST + r"(?:[A-Za-z_][\w\s*,\[\]]*;\s*)+\Z")
_QUALIFIERS = {"const", "volatile", "override", "final", "noexcept", "throw"}
_BRANCH = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b(.*)$", re.M)
# A definition that starts in the first column of a line.
_FRESH = re.compile(r"^(?!(?:if|for|while|switch|do|else|return|catch)\b)[A-Za-z_][\w\s*&:<>,~]*\([^;{}]*\)[^;{}()]*\{", re.M)


def _is_function(head: str) -> bool:
    """Does the text before an opening brace end in a parameter list, as a definition's does?"""
    if _OLD_HEAD.search(head):
        return True
    plain = _OPERATOR.sub("operator_", _TEMPLATE.sub(" ", head))
    return bool(
        _PARAMS_END.search(plain) and _NAME_AND_PARAMS.search(plain)
        and not _CONTROL.match(plain) and "=" not in plain.split("(", 1)[0])


def first_branches(text: str) -> str:
    """The text with all but one branch of each conditional group blanked; line and column stay.

    The first branch stays, of ``#if 0`` the next one.
    """
    out, open_groups = [], []  # of each group: is its branch chosen already, where its blank part begins
    done = 0
    for m in _BRANCH.finditer(text):
        word = m[1]
        if word.startswith("if"):
            dead = word == "if" and m[2].strip() == "0"
            open_groups.append([not dead, m.end() if dead else None])
            continue
        if not open_groups:
            continue
        group = open_groups[-1]
        outer = any(start is not None for _, start in open_groups[:-1])
        if group[1] is not None and not outer:  # the blank part ends here
            out += [text[done:group[1]], re.sub(r"[^\n]", " ", text[group[1]:m.start()])]
            done = m.start()
        if word == "endif":
            open_groups.pop()
        elif group[0]:
            group[1] = m.end()
        else:
            group[0], group[1] = True, None
    return "".join([*out, text[done:]])


def functions_in(text: str) -> list[tuple[int, str]]:
    """(1-based start line, source) of every function definition, in source order.

    Of conditional groups one branch counts. A function that is open at the end of the text goes up to
    the next definition in the first column, and cutting goes on from there.
    """
    shown, found, at = first_branches(text), [], 0
    while at is not None:
        more, left_open = _cut(shown, at)
        found += more
        at = None
        if left_open is not None:
            begin, body = left_open
            fresh = _FRESH.search(shown, body)
            if fresh:
                found.append((begin, begin + len(shown[begin:fresh.start()].rstrip())))
                at = fresh.start()
    return [(text.count("\n", 0, begin) + 1, text[begin:end]) for begin, end in found]


def _cut(text: str, at: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Begin and end of the functions from ``at`` on; begin and body of one that never ends."""
    found = []
    head: list[str] = []          # declaration text since the last boundary, comments left out
    start = last = at             # where the declaration begins; where ``head`` was read up to
    blank = True                  # only whitespace since the boundary
    inside: list[bool] = []       # open braces outside functions: may they hold functions?
    depth = begin = body = 0      # brace depth inside the current function; its start and body
    member = 0                    # brace depth inside a member's initial value
    old = 0                       # end of the last declaration kept for an old-style head

    def boundary(at: int) -> None:
        nonlocal start, last, blank, old
        head.clear()
        start = last = at
        blank, old = True, 0

    for piece in _PIECES.finditer(text, at):
        mark, at, end = piece.group(), piece.start(), piece.end()
        if depth:
            if mark == "{":
                depth += 1
            elif mark == "}":
                depth -= 1
                if not depth:
                    found.append((begin, end))
                    boundary(end)
            continue
        if member:
            member += (mark == "{") - (mark == "}")
            last = end
            continue
        between = text[last:at]
        head.append(between)
        if blank and between.strip():
            start, blank = last + len(between) - len(between.lstrip()), False
        last = end
        if mark.startswith(("/*", "//")):
            head.append(" ")
        elif mark.lstrip().startswith("#"):
            boundary(end)
        elif mark == ";":
            declared = _OLD_NEXT.search("".join(head))
            if not blank and declared and not set(declared["last"].split()) <= _QUALIFIERS:
                head.append(";")
                old = end
            else:
                boundary(end)
        elif mark == "}":
            if inside:
                inside.pop()
            boundary(end)
        elif mark == "{":
            declared = "".join(head)
            if old and not _OLD_HEAD.search(declared):  # after all, what stood before were declarations
                declared = declared.rsplit(";", 1)[1]
                start = old + len(text[old:at]) - len(text[old:at].lstrip())
            if not blank and all(inside) and _MEMBER.search(declared) and _is_function(_COLON.split(declared, maxsplit=1)[0]):
                member = 1
                head.append("()")
            elif not blank and all(inside) and _is_function(declared):
                label = _ACCESS.match(text, start)
                depth, begin, body = 1, label.end() if label else start, end
            else:
                inside.append(bool(_CONTAINER.search(declared)) and "enum" not in declared.split())
                boundary(end)
        else:  # a parenthesis, number or literal belongs to the declaration
            if blank:
                start, blank = at, False
            head.append(mark)
    return found, (begin, body) if depth else None


def extract_functions(sources: DataFrame, path: str = "path", text: str = "text",
                      keep: Sequence[str] = ()) -> DataFrame:
    """(file, fn_no, start_line, code, *keep): one row per function definition, numbered from 0."""
    sources = sources.select(F.col(path).alias("file"), F.col(text).alias("body"), *keep)
    schema = T.StructType([
        sources.schema["file"],
        T.StructField("fn_no", T.IntegerType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("code", T.StringType()),
        *[sources.schema[c] for c in keep]])
    names = schema.fieldNames()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for file, body, *kept in batch.itertuples(index=False, name=None):
                for n, (line, code) in enumerate(functions_in(body or "")):
                    rows.append((file, n, line, code, *kept))
                    held += len(code)
                    if held > _BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return sources.mapInPandas(cut, schema)
