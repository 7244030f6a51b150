"""Parsing of source files to symbols, imports, exports, calls and edges.

Python is parsed exactly, by its own grammar; Go, Java, JavaScript, TypeScript, PHP and Rust are scanned: a lexer with a stack takes out
strings, templates, heredocs and comments, brackets are matched over what is left, and patterns over that code (heads and imports may
run over several lines) give symbols whose blocks end at their own bracket. All other text is one symbol. A file that cannot be
parsed gives a row with ``error`` and the other files go on.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graincode.functions.scalars import file_stem

_SYMBOL = "struct<ord:int,name:string,kind:string,parent:string,signature:string,docstring:string,code:string,start_line:int,end_line:int>"
_IMPORT = "struct<ord:int,module:string,alias:string,names:array<string>,line:int>"
_CALL = "struct<caller:string,callee:string,line:int>"
_PARTS = {"symbols": f"array<{_SYMBOL}>", "imports": f"array<{_IMPORT}>", "exports": "array<string>", "calls": f"array<{_CALL}>"}
#: What a file gives; ``parse`` can be asked for fewer.
PARTS = tuple(_PARTS)
PARSED = "file string, language string, " + ", ".join(f"{k} {v}" for k, v in _PARTS.items()) + ", error string"

#: What is no code, by language: comments, and the forms of strings. Templates and comments that nest are followed by a stack.
_COMMENT, _DOUBLE, _SINGLE = r"//[^\n]*|/\*.*?\*/", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_LEXERS: dict[str, str] = {
    "go": rf"(?P<c>{_COMMENT})|{_DOUBLE}|`[^`]*`|{_SINGLE}",
    "java": rf'(?P<c>{_COMMENT})|"""(?:\\.|.)*?"""|{_DOUBLE}|{_SINGLE}',
    "javascript": rf"(?P<c>{_COMMENT})|{_DOUBLE}|{_SINGLE}|(?P<t>`)|(?P<b>[{{}}])|(?<=[=(,:;!&|?\[{{}}\n])[ \t]*/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])*/[a-z]*",
    "php": rf"(?P<c>{_COMMENT}|#(?!\[)[^\n]*)|<<<[ \t]*(?P<q>[\"']?)(?P<id>\w+)(?P=q)\n.*?^[ \t]*(?P=id)\b|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "rust": rf"(?P<c>//[^\n]*)|(?P<n>/\*)|\bb?r(?P<h>#*)\".*?\"(?P=h)|\"(?:\\.|[^\"\\])*\"|'(?:\\u\{{\w+\}}|\\x\w\w|\\.|[^'\\\n])'",
}
_LEXERS["typescript"] = _LEXERS["javascript"]
FALLBACK = "fallback"  # for languages without patterns of their own, where asked for: what most languages with braces write
_LEXERS[FALLBACK] = rf'(?P<c>{_COMMENT})|"""(?:\\.|.)*?"""|{_DOUBLE}|\'(?:\\.|[^\'\\\n])\''
_COMPILED = {k: re.compile(v, re.S | re.M) for k, v in _LEXERS.items()}
#: The characters at which something that is no code may begin, and what may stand right before one of them and belong to it.
_BEGINS = {k: re.compile(v) for k, v in {"go": "[/\"`']", "java": "[/\"']", "javascript": "[/\"'`{}]", "typescript": "[/\"'`{}]", "php": "[/#<\"']", "rust": "[/\"']", FALLBACK: "[/\"']"}.items()}
_BEFORE = {"javascript": ("/", re.compile(r"[ \t]+\Z")), "typescript": ("/", re.compile(r"[ \t]+\Z")), "rust": ('"', re.compile(r"b?r#*\Z"))}
_NESTED = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)", re.S)

#: Symbol patterns of each language: kind, a head that ends with the name, and what must follow the parameters ('' where there are none).
_NAME, _ANY, _BODY = r"(?P<name>[\w$]+)", r"", r"\s*(?::[^;{{}}=]*(?:\{{[^}}]*\}}[^;{{}}=]*)?)?\{{".replace("{{", "{").replace("}}", "}")
_JAVA = r"(?:@\w+(?:\([^)]*\))?\s+|(?:public|private|protected|static|final|synchronized|abstract|default|native|sealed)\s+)*"
_JS = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|new|else|do|match|loop)\b)"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"?\s*\w*\"?\s+)?"
PATTERNS: dict[str, tuple[tuple[str, str, str | None], ...]] = {
    "go": (("function", rf"^func\s+{_NAME}", _ANY), ("method", rf"^func\s+\(\s*(?:\w+\s+)?\*?(?P<parent>\w+)(?:\[[^\]]*\])?\s*\)\s*{_NAME}", _ANY), ("struct", rf"^type\s+{_NAME}(?:\[[^\]]*\])?\s+struct\b", None), ("interface", rf"^type\s+{_NAME}(?:\[[^\]]*\])?\s+interface\b", None)),
    "java": (("class", rf"^[ \t]*{_JAVA}(?:class|record)\s+{_NAME}", None), ("interface", rf"^[ \t]*{_JAVA}@?interface\s+{_NAME}", None), ("enum", rf"^[ \t]*{_JAVA}enum\s+{_NAME}", None),
             ("method", rf"^[ \t]+{_JAVA}(?:<[^>()]*>\s*)?(?!(?:new|return|else|throw|assert|case|yield|package|import)\b)[\w.]+(?:<[^;(){{}}=]*>)?(?:\[\])*\s+{_NOT}{_NAME}", r"\s*(?:throws\s+[\w., \n]+)?[{;]"), ("method", rf"^[ \t]+{_JAVA}{_NOT}(?P<name>[A-Z]\w*)", r"\s*(?:throws\s+[\w., \n]+)?\{")),
    "javascript": (("function", rf"{_JS}(?:async\s+)?function\s*\*?\s*{_NAME}", _ANY), ("class", rf"{_JS}class\s+{_NAME}", None), ("function", rf"{_JS}(?:const|let|var)\s+{_NAME}\s*(?::[^=;]*)?=\s*(?:async\s*)?(?=[(<])", r"\s*(?::[^;{}=]*)?=>"),
                   ("method", rf"^[ \t]+(?:(?:async|static|get|set|public|private|protected|readonly|override)\s+)*\*?{_NOT}{_NAME}(?=\s*[(<])", _BODY)),
    "php": (("function", rf"^function\s+&?{_NAME}", _ANY), ("class", rf"^[ \t]*(?:(?:abstract|final|readonly)\s+)*class\s+{_NAME}", None), ("interface", rf"^[ \t]*(?:interface|trait)\s+{_NAME}", None), ("enum", rf"^[ \t]*enum\s+{_NAME}", None),
            ("method", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?{_NAME}", _ANY)),
    "rust": (("function", rf"^{_PUB}fn\s+{_NAME}", _ANY), ("struct", rf"^[ \t]*{_PUB}struct\s+{_NAME}", None), ("enum", rf"^[ \t]*{_PUB}enum\s+{_NAME}", None), ("interface", rf"^[ \t]*{_PUB}trait\s+{_NAME}", None),
             ("class", rf"^[ \t]*(?:unsafe\s+)?impl(?:<[^{{;]*?>)?\s+(?:[\w:]+(?:<[^{{;]*?>)?\s+for\s+)?&?(?:mut\s+)?(?:\w+::)*{_NAME}", None), ("method", rf"^[ \t]+{_PUB}fn\s+{_NAME}", _ANY)),
}
PATTERNS["typescript"] = (*PATTERNS["javascript"], ("method", rf"^[ \t]+(?:readonly\s+)?{_NOT}{_NAME}(?=\s*[(<])", r"\s*:[^;{}=]*(?:\{[^}]*\}[^;{}=]*)?;"), ("interface", rf"{_JS}interface\s+{_NAME}", None), ("type_alias", rf"{_JS}type\s+{_NAME}(?:<[^=]*>)?\s*=", None), ("enum", rf"{_JS}(?:const\s+)?enum\s+{_NAME}", None))
PATTERNS[FALLBACK] = (("class", rf"^[ \t]*(?:\w+\s+)*(?:class|object|module)\s+{_NAME}", None), ("struct", rf"^[ \t]*(?:\w+\s+)*struct\s+{_NAME}", None), ("interface", rf"^[ \t]*(?:\w+\s+)*(?:interface|trait|protocol)\s+{_NAME}", None), ("enum", rf"^[ \t]*(?:\w+\s+)*enum\s+{_NAME}", None),
                      ("method", rf"^[ \t]+(?:\w+\s+)*(?:func|fun|def|fn|function)\s+{_NAME}", _ANY), ("function", rf"^(?:\w+\s+)*(?:func|fun|def|fn|function)\s+{_NAME}", _ANY))
#: Imports, over text without comments: they may run over several lines.
IMPORTS: dict[str, str] = {
    "go": r'^[ \t]*(?:import\s+)?(?:(?P<alias>[\w.]+)[ \t]+)?"(?P<module>[^"\n]+)"',
    "java": r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;",
    "javascript": r"""^[ \t]*import\s+(?:type\s+)?(?:(?P<names>[^'";]+?)\s+from\s+)?['"](?P<module>[^'"\n]+)['"]""",
    "php": r"^[ \t]*use\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+?)(?:\\\{(?P<names>[^}]*)\}|\s+as\s+(?P<alias>\w+))?\s*;",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<module>[^;]+);",
    FALLBACK: r"^[ \t]*(?:import|using|require|#include|use)\s+[\"'<]?(?P<module>[\w./:-]+)",
}
IMPORTS["typescript"] = IMPORTS["javascript"]
EXPORT = re.compile(r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class)\s+(\w+)|^\s*export\s+default\s+(\w+)\s*;?\s*$", re.M)
_CALLED = re.compile(r"(?<![\w.])(?:[\w]+(?:\.|::|->))*(\w+)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function func fn def class new match use elif except with and or not in print import async await pub throw Fn FnMut FnOnce typeof yield".split()) - {"print"}


def _signature(kind: str, name: str, params: str, returns: str = "") -> str:
    return f"{kind} {name}" + (f"({params})" if params else "") + (f" -> {returns}" if returns else "")


def _arguments(args: ast.arguments) -> str:
    """As ``ast.unparse``, which is slow: names and plain annotations are put together here."""
    if args.defaults or args.kwonlyargs or args.posonlyargs or args.vararg or args.kwarg:
        return ast.unparse(args)
    out = []
    for a in args.args:
        if a.annotation is not None and not isinstance(a.annotation, ast.Name):
            return ast.unparse(args)
        out.append(a.arg if a.annotation is None else f"{a.arg}: {a.annotation.id}")
    return ", ".join(out)


def parse_python(source: str) -> tuple[list, list, list, list]:
    """Symbols, imports, exports (none) and calls of a Python module."""
    tree, lines = ast.parse(source), source.split("\n")
    symbols, imports, calls = [], [], []

    def visit(node, owner, parent):
        children = []
        for name in node._fields:
            value = getattr(node, name, None)
            if value.__class__ is list:
                children += value
            else:
                children.append(value)
        for child in children:
            if not isinstance(child, ast.AST) or isinstance(child, (ast.expr_context, ast.Constant)):
                continue
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if isinstance(node, ast.ClassDef) else "function"
                start = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                params = "" if is_class else f"({_arguments(child.args)})"
                returns = "" if is_class or not child.returns else child.returns.id if isinstance(child.returns, ast.Name) else ast.unparse(child.returns)
                code = "\n".join(lines[start - 1 : child.end_lineno])
                symbols.append((child.name, kind, parent if kind == "method" else None, _signature(kind, child.name, params, returns), ast.get_docstring(child), code, start, child.end_lineno))
                visit(child, child.name, child.name if is_class else parent)
                continue
            if isinstance(child, ast.Import):
                imports.extend((a.name, a.asname, [], child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append(("." * child.level + (child.module or ""), None, [a.name for a in child.names], child.lineno))
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    calls.append((owner, name, child.lineno))
            visit(child, owner, parent)

    visit(tree, None, None)
    symbols.sort(key=lambda s: (s[6], s[7]))
    return symbols, imports, [], calls


def _blank(text: str) -> str:
    return "\n".join([" " * len(line) for line in text.split("\n")]) if "\n" in text else " " * len(text)


def _next(source: str, at: int, language: str) -> re.Match | None:
    """The first match of the language's lexer from at, tried only where one can begin."""
    lexer, begins = _COMPILED[language], _BEGINS[language]
    sign, before = _BEFORE.get(language, ("", None))
    look = at
    while m := begins.search(source, look):
        k = m.start()
        if before is not None and source[k] == sign:  # what belongs to it begins earlier
            first = k
            while first > at and source[first - 1] in (" \t" if sign == "/" else "#rb"):
                first -= 1
            if first < k and (own := before.search(source[first:k])):
                for p in range(first + own.start(), k):
                    if found := lexer.match(source, p):
                        return found
        if found := lexer.match(source, k):
            return found
        look = k + 1
    return None


def code_only(source: str, language: str) -> tuple[str, str]:
    """source with strings and comments blanked, and with comments alone blanked: places and lines stay."""
    bare, full, at = [], [], 0
    open_at: list[int] = []  # depth of braces at which each open template goes on
    depth, template = 0, False

    def put(text: str, code: bool, string: bool = False) -> None:
        blank = text if code else _blank(text)
        full.append(blank)
        bare.append(text if string else blank)

    while at < len(source):
        if template:  # the text of a template, up to its end or to an expression in it
            m = _TEMPLATE.match(source, at)
            put(m[0], False, True)
            at, template = m.end(), False
            if m[1] == "${":
                open_at.append(depth)
            continue
        m = _next(source, at, language)
        put(source[at : m.start() if m else len(source)], True)
        if m is None:
            break
        at, kind = m.end(), m.lastgroup
        if kind == "b":
            if m[0] == "}" and open_at and open_at[-1] == depth:
                open_at.pop()
                template = True
                put(m[0], False, True)
            else:
                depth += 1 if m[0] == "{" else -1
                put(m[0], True)
        elif kind == "t":
            template = True
            put(m[0], False, True)
        elif kind == "n":  # comments that nest
            level, end = 1, at
            while level and (n := _NESTED.search(source, end)):
                level, end = level + (1 if n[0] == "/*" else -1), n.end()
            end = len(source) if level else end
            put(source[m.start() : end], False)
            at = end
        else:
            put(m[0], False, kind != "c")
    return "".join(full), "".join(bare)


_BRACKET, _OPENS = re.compile(r"[()\[\]{}]"), {")": "(", "]": "[", "}": "{"}


def brackets(code: str) -> dict[int, int]:
    """Where each bracket closes; one that is never closed is left out."""
    pairs, stack = {}, []
    for m in _BRACKET.finditer(code):
        at = m.start()
        opens = _OPENS.get(code[at])
        if opens is None:
            stack.append((code[at], at))
            continue
        for k in range(len(stack) - 1, -1, -1):  # what was left open inside stays open
            if stack[k][0] == opens:
                pairs[stack[k][1]] = at
                del stack[k:]
                break
    return pairs


_STOP = re.compile(r"[{;(\[\n]")
_GOES_ON = re.compile(r"\s*(?:[{)\],.:?&|=]|->|where\b|implements\b|extends\b)")
#: Languages in which a statement may end with its line.
_LINES_END = ("go", "javascript", "typescript", FALLBACK)


def _end(code: str, at: int, pairs: dict[int, int], by_line: bool) -> int:
    """Place of the last character of what begins before at: the end of its block, its semicolon, or (by_line) the end of a line after which nothing of it comes."""
    while m := _STOP.search(code, at):
        if m[0] == "{":
            return pairs.get(m.start(), len(code) - 1)
        if m[0] == ";":
            return m.start()
        if m[0] == "\n" and by_line and not (_GOES_ON.match(code, m.end()) or code[max(at, m.start() - 200) : m.start()].rstrip().endswith(("=", "=>", ",", "|", "&"))):
            return m.start() - 1
        at = pairs.get(m.start(), m.start()) + 1
    return len(code) - 1


def _flat(text: str) -> str:
    """A text of several lines as one, without space inside its brackets and a comma at their ends."""
    return _CLOSE.sub(r"\1", _OPEN.sub(r"\1", " ".join(text.split())))


_OPEN, _CLOSE, _ANGLE, _PAREN = re.compile(r"([({\[]) "), re.compile(r",? ?([)}\]])"), re.compile(r"\s*<"), re.compile(r"\s*\(")


def _params(code: str, at: int, pairs: dict[int, int]) -> tuple[int, int] | None:
    """Place of the parentheses after a name and what generic parameters it has."""
    if m := _ANGLE.match(code, at):
        level, k = 1, m.end()
        while k < len(code) and level and code[k] not in "{;":
            level += {"<": 1, ">": -1}.get(code[k], 0) if code[k - 1 : k + 1] not in ("->", "=>") else 0
            k += 1
        at = k
    m = _PAREN.match(code, at)
    return (m.end() - 1, pairs[m.end() - 1]) if m and m.end() - 1 in pairs else None


class _Around:
    """The symbols around a line, the innermost last, for lines that are asked for in order."""

    def __init__(self, symbols: list[list]):
        self.todo, self.open = sorted(symbols, key=lambda s: s[6], reverse=True), []

    def at(self, line: int) -> list[list]:
        while self.todo and self.todo[-1][6] <= line:
            self.open.append(self.todo.pop())
        while self.open and self.open[-1][7] < line:
            self.open.pop()
        return self.open


#: A word that every match of a head holds: one that is in no group of the head.
_WORD = re.compile(r"(?<=[\^?*+])(?:func|function|type|struct|interface|class|enum|fn|trait|impl)(?=\\s|\\b|\(\?:<)")
_IMPORT_OF = {k: re.compile(v, re.M) for k, v in IMPORTS.items()}


def _word_of(head: str) -> str:
    m = _WORD.search(head)
    return m[0] if m else ""


_HEADS = {k: [(kind, re.compile(head, re.M), None if tail is None else re.compile(tail), _word_of(head)) for kind, head, tail in v] for k, v in PATTERNS.items()}
_GROUP, _NO_TYPE = re.compile(r"^import\s*\(", re.M), re.compile(r"\s*[;,]")


def parse_patterns(source: str, language: str, parts: tuple[str, ...] = PARTS) -> tuple[list, list, list, list]:
    """Symbols, imports, exports and calls by patterns over the code alone; blocks end at their own bracket. What is not among parts is left empty."""
    code, bare = code_only(source, language)
    exports = [a or b for a, b in EXPORT.findall(code)] if language in ("javascript", "typescript") and "exports" in parts and "export" in code else []
    shapes = "symbols" in parts or "calls" in parts or ("imports" in parts and language == "php")
    if not shapes and "imports" not in parts:
        return [], [], exports, []
    pairs, found = brackets(code) if shapes or language == "go" else {}, {}
    lines, by_line = source.split("\n"), language in _LINES_END
    starts = list(accumulate((len(text) + 1 for text in lines[:-1]), initial=0))
    line = lambda at: bisect_right(starts, at)
    for kind, head, tail, word in _HEADS[language] if shapes else ():
        if word not in code:
            continue
        for m in head.finditer(code):
            own, params = line(m.start("name")), None
            if tail is not None:
                params = _params(code, m.end(), pairs)
                t = tail.match(code, params[1] + 1) if params else None
                if t is None:
                    continue
                after = t.end() - 1 if t[0].endswith("{") else params[1] + 1
                if ":" in t[0] and _NO_TYPE.match(code, pairs.get(after, after) + 1):
                    continue  # a type, not a body
            if own not in found:
                begin = line(m.start() + len(m[0]) - len(m[0].lstrip()))
                last = line(_end(code, after if params else m.end("name"), pairs, by_line))
                shown = _flat(source[params[0] : params[1] + 1]) if params and "symbols" in parts else ""
                name = m["name"]
                found[own] = [name, kind, m.groupdict().get("parent"), _signature(kind, name, shown), None, "\n".join(lines[begin - 1 : last]), begin, last]
    symbols = [found[k] for k in sorted(found)]
    around = _Around([s for s in symbols if s[1] in ("class", "struct", "interface", "enum")])
    functions = _Around([s for s in symbols if s[1] in ("function", "method")])
    for s in symbols:
        if s[1] == "method" and s[2] is None:
            owner = next((o for o in reversed(around.at(s[6])) if o[6] < s[6] and s[7] <= o[7]), None)
            s[1], s[2] = ("method", owner[0]) if owner else ("function", None)
    imports, group = [], None
    if language == "go":
        group = [(m.end() - 1, pairs.get(m.end() - 1, len(code))) for m in _GROUP.finditer(code)]
    inside = _Around([s for s in symbols if s[1] in ("class", "interface", "enum")])
    for m in _IMPORT_OF[language].finditer(bare) if "imports" in parts else ():
        word = m.start() + len(m[0]) - len(m[0].lstrip())
        if group is not None and not bare.startswith("import", word) and not any(a < word < b for a, b in group):
            continue  # a string in a line of its own
        if code[word] == " " and bare.startswith(("import", "use", "pub"), word) or language == "php" and inside.at(line(word)):
            continue  # inside a string; a trait that a class uses
        g = m.groupdict()
        names = [" ".join(n.split()) for n in re.sub(r"[{}]", "", g.get("names") or "").split(",") if n.strip()]
        imports.append((_flat(g["module"]), g.get("alias"), names, line(word)))
    named, calls = {(line_, name) for line_, (name, *_) in found.items()}, []
    for i, text in enumerate(code.split("\n") if "calls" in parts else (), 1):
        if "(" not in text:
            continue
        owner = functions.at(i)
        calls.extend((owner[-1][0] if owner else None, n, i) for n in _CALLED.findall(text) if n not in _KEYWORDS and (i, n) not in named)
    return [tuple(s) for s in symbols], imports, exports, calls


def parse_raw(source: str, file: str) -> tuple[list, list, list, list]:
    """A file that isn't blank is one symbol."""
    if not source.strip():
        return [], [], [], []
    name = file.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return [(stem, "file", None, f"file {name}", None, source, 1, source.count("\n") + 1)], [], [], []


#: Files whose results are held at once.
PARSE_ROWS = 1_000


def _one(file: str, language: str | None, source: str | None, fallback: frozenset[str], parts: tuple[str, ...] = PARTS):
    """The four lists of a file, with what is not among parts left out or not, and its error, which does not depend on parts."""
    try:
        language = FALLBACK if language in fallback and language not in PATTERNS and language != "python" else language
        if language == "python":
            return (*parse_python(source or ""), None)
        if language in PATTERNS and (language != FALLBACK or fallback):
            return (*(parse_patterns(source or "", language, parts) if parts else ([], [], [], [])), None)
        return (*parse_raw(source or "", file), None)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], [], [], [], f"{type(e).__name__}: {e}"


def _nested(rows: list[list], kind: pa.ListType) -> pa.ListArray:
    """Lists of texts, or of tuples of a struct's fields, as one column; a first field ord numbers them."""
    offsets = pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32())
    flat = [x for row in rows for x in row]
    own = kind.value_type
    if not pa.types.is_struct(own):
        return pa.ListArray.from_arrays(offsets, pa.array(flat, own), type=kind)
    fields = [own.field(i) for i in range(own.num_fields)]
    columns = list(zip(*flat)) if flat else [[] for f in fields if f.name != "ord"]
    if fields[0].name == "ord":
        columns = [[k for row in rows for k in range(len(row))], *columns]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields), type=kind)


def parse(files: DataFrame, fallback: tuple[str, ...] = (), parts: tuple[str, ...] = PARTS, more: tuple[str, ...] = ()) -> DataFrame:
    """files (file, language, content) to one row a file, with nested results and error. A null content is an empty file.

    Languages of fallback that have no patterns of their own are read by general ones, with a class, struct, interface or enum as the
    parent of what is inside it; without it they are raw text. parts names the results that are asked for: only these are made, and are columns. more names columns of files that stay.
    """
    walked = frozenset(fallback)
    kinds = {k: v for k, v in _PARTS.items() if k in parts}
    ddl = ", ".join(["file string", "language string", *(f"{k} {v}" for k, v in kinds.items()), "error string", *(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in more)])
    schema, places = to_arrow_schema(StructType.fromDDL(ddl)), [PARTS.index(k) for k in kinds]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, PARSE_ROWS):
                batch = whole.slice(lo, PARSE_ROWS)
                files, languages, sources = (batch.column(i).to_pylist() for i in range(3))
                done = [_one(file, language, source, walked, tuple(kinds)) for file, language, source in zip(files, languages, sources)]
                columns = [_nested([x[k] for x in done], schema.field(PARTS[k]).type) for k in places]
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(languages, pa.string()), *columns, pa.array([x[4] for x in done], pa.string()), *batch.columns[3:]], schema=schema)

    return files.select("file", "language", "content", *more).mapInArrow(run, ddl)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("symbols"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("imports"))


def call_edges(parsed: DataFrame) -> DataFrame:
    """A call edge from the enclosing symbol (or the module) to the callee; the last line of equal edges stays."""
    calls = parsed.select("file", F.inline("calls"))
    source = F.concat("file", F.lit("::"), F.coalesce("caller", F.lit("<module>")))
    return calls.groupBy(source.alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("kind"), F.col("file").alias("source_file")).agg(F.max("line").alias("line"))


def import_edges(imports: DataFrame) -> DataFrame:
    """An import edge from the module to what it imports."""
    return imports.groupBy(F.concat("file", F.lit("::<module>")).alias("source"), F.col("module").alias("target"), F.lit("imports").alias("kind"), F.col("file").alias("source_file")).agg(F.max("line").alias("line"))


def raw_symbols(files: DataFrame) -> DataFrame:
    """The one symbol of each file that isn't blank, without Python: for raw text."""
    own = files.where(F.col("content").rlike(r"(?U)\S"))
    base = F.substring_index("file", "/", -1)
    none = F.lit(None).cast("string")
    return own.select(
        "file", F.lit(0).alias("ord"), file_stem(F.col("file")).alias("name"), F.lit("file").alias("kind"), none.alias("parent"), F.concat(F.lit("file "), base).alias("signature"),
        none.alias("docstring"), F.col("content").alias("code"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n", -1)).alias("end_line"), F.octet_length("content").alias("end_byte"),
    )
