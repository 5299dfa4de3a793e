"""Structure of source files: the few node kinds that rules and data flow need.

Python files go through the standard ``ast``; Java, JavaScript, TypeScript, TSX
and Go share one lexer and one structural reader that follows brackets and
statement ends.  Nodes know their text, byte span, line and byte column, their
children in source order, and named fields.  Files with a syntax error give
what could be read and say so.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Deepest nesting that walks go into.
DEPTH = 1024

# Kinds of nodes by role and language.
METHODS = {
    "java": ("method_declaration", "constructor_declaration"),
    "javascript": ("function_declaration", "function_expression", "arrow_function", "method_definition"),
    "python": ("function_definition",),
    "go": ("function_declaration", "method_declaration"),
}
CALLS = {"java": ("method_invocation", "object_creation_expression"), "javascript": ("call_expression",), "python": ("call",), "go": ("call_expression",)}
DECLARATIONS = {"java": ("local_variable_declaration",), "javascript": ("lexical_declaration", "variable_declaration"), "python": (), "go": ("var_spec",)}
ASSIGNMENTS = {"java": ("assignment_expression",), "javascript": ("assignment_expression",), "python": ("assignment",), "go": ("assignment_statement", "short_var_declaration")}
LOOPS = ("while_statement", "do_statement", "for_statement", "enhanced_for_statement", "for_in_statement")
EXTENSIONS = {"java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "go": "go"}


def family(language: str) -> str:
    return "javascript" if language in ("typescript", "tsx") else language


@dataclass(slots=True)
class Node:
    kind: str
    start: int  # in characters
    end: int
    children: list[Node] = field(default_factory=list)
    fields: dict[str, Node] = field(default_factory=dict)
    name: str = ""

    def walk(self, depth: int = 0) -> Iterator[Node]:
        waiting = [(self, depth)]
        while waiting:
            n, at = waiting.pop()
            yield n
            if at < DEPTH:
                waiting += [(c, at + 1) for c in reversed(n.children)]


def _place(n: Node) -> tuple[int, int]:
    return n.start, -n.end


class Tree:
    """A parsed file."""

    def __init__(self, source: str, language: str):
        self.source, self.language, self.family = source, language, family(language)
        self.error = False
        self._lines = [0, *(m.end() for m in re.finditer("\n", source))]
        if self.family == "python":
            self.root = self._python()
        else:
            self.root = Reader(self).file()
            for n in self.root.walk():
                if len(n.children) > 1:
                    n.children.sort(key=_place)

    def text(self, n: Node) -> str:
        return self.source[n.start : n.end]

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at)

    def position(self, at: int) -> tuple[int, int, int]:
        """(byte offset, line, byte column), line and column from 1."""
        line = self.line(at)
        return len(self.source[:at].encode()), line, len(self.source[self._lines[line - 1] : at].encode()) + 1

    def line_text(self, at: int) -> str:
        begin = self.source.rfind("\n", 0, at) + 1
        end = self.source.find("\n", at)
        return self.source[begin : end if end >= 0 else len(self.source)].strip()

    def _python(self) -> Node:
        root = Node("module", 0, len(self.source))
        try:
            parsed = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            self.error = True
            return root
        starts, lines = self._lines, None if self.source.isascii() else self.source.split("\n")

        def at(line: int, byte: int) -> int:
            return starts[line - 1] + len(lines[line - 1].encode()[:byte].decode("utf-8", "ignore"))

        def span(x: ast.AST) -> tuple[int, int]:
            if lines is None:
                return starts[x.lineno - 1] + x.col_offset, starts[x.end_lineno - 1] + x.end_col_offset
            return at(x.lineno, x.col_offset), at(x.end_lineno, x.end_col_offset)

        def placed(nodes: list[Node]) -> list[Node]:
            """Nodes in source order, where the syntax tree may have them in another."""
            if len(nodes) > 1:
                nodes.sort(key=_place)
            return nodes

        def block(body: list[ast.stmt]) -> Node:
            return Node("block", span(body[0])[0], span(body[-1])[1], [visit(s) for s in body])

        def part(n: Node, name: str, child: Node) -> None:
            n.fields[name] = child
            n.children.append(child)

        def visit(x: ast.AST) -> Node:
            # Classes of a parsed tree are never derived ones; the most frequent come first.
            t = type(x)
            if t is ast.Name:
                return Node("identifier", *span(x), name=x.id)
            if t is ast.Constant:
                return Node(_python_kind(x), *span(x))
            if t is ast.Attribute:
                start, end = span(x)
                held, own = visit(x.value), Node("identifier", end - len(x.attr), end, name=x.attr)
                return Node("attribute", start, end, [held, own], {"object": held, "attribute": own})
            if t is ast.Call:
                start, end = span(x)
                called = visit(x.func)
                inner = placed([visit(a) for a in x.args] + [visit(k.value) for k in x.keywords])
                arguments = Node("argument_list", called.end, end, inner)
                return Node("call", start, end, [called, arguments], {"function": called, "arguments": arguments})
            if not hasattr(x, "lineno"):
                n = Node(t.__name__, 0, 0)
                n.children = [visit(c) for c in ast.iter_child_nodes(x) if hasattr(c, "lineno")]
                if n.children:
                    n.start, n.end = n.children[0].start, n.children[-1].end
                placed(n.children)
                return n
            n = Node("", *span(x))
            if t is ast.Assign or t is ast.AnnAssign and x.value is not None:
                n.kind = "assignment"
                part(n, "left", visit(x.targets[0] if t is ast.Assign else x.target))
                part(n, "right", visit(x.value))
            elif t is ast.Return:
                n.kind = "return_statement"
                n.children = [visit(x.value)] if x.value else []
            elif t is ast.FunctionDef or t is ast.AsyncFunctionDef:
                n.kind, n.name = "function_definition", x.name
                args = [*x.args.posonlyargs, *x.args.args, *([x.args.vararg] if x.args.vararg else []), *x.args.kwonlyargs]
                parameters = Node("parameters", n.start, n.start, [Node("identifier", *span(a), name=a.arg) for a in args])
                n.fields["parameters"] = parameters
                n.children = [visit(d) for d in x.decorator_list]
                part(n, "body", block(x.body))
            elif t is ast.Import or t is ast.ImportFrom:
                n.kind = "import_statement" if t is ast.Import else "import_from_statement"
                n.name = ("." * getattr(x, "level", 0)) + (getattr(x, "module", None) or "")
                n.children = [Node("import_specifier", n.start, n.end, name=f"{a.asname or a.name}={a.name}") for a in x.names]
            elif t is ast.ClassDef:
                n.kind, n.name = "class_definition", x.name
                part(n, "body", block(x.body))
            elif t is ast.If:
                n.kind = "if_statement"
                n.children.append(visit(x.test))
                part(n, "consequence", block(x.body))
                if x.orelse:
                    part(n, "alternative", block(x.orelse))
            elif t is ast.While or t is ast.For or t is ast.AsyncFor:
                n.kind = "while_statement" if t is ast.While else "for_statement"
                n.children.append(visit(x.test if t is ast.While else x.iter))
                part(n, "body", block(x.body))
                if x.orelse:
                    n.children.append(block(x.orelse))
            else:
                n.kind = _python_kind(x)
                n.children = placed([visit(c) for c in ast.iter_child_nodes(x) if hasattr(c, "lineno") or isinstance(c, _HELD)])
            return n

        root.children = [visit(s) for s in parsed.body]
        return root


# Kinds of Python's grammar by the classes of its syntax tree, where lower case is not enough.
_PYTHON_KINDS = {
    "Expr": "expression_statement", "Raise": "raise_statement", "Try": "try_statement", "TryStar": "try_statement", "With": "with_statement", "AsyncWith": "with_statement",
    "Assert": "assert_statement", "Delete": "delete_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Pass": "pass_statement", "Break": "break_statement",
    "Continue": "continue_statement", "Match": "match_statement", "ExceptHandler": "except_clause", "AugAssign": "augmented_assignment", "BinOp": "binary_operator", "BoolOp": "boolean_operator",
    "Compare": "comparison_operator", "UnaryOp": "unary_operator", "Dict": "dictionary", "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension",
    "GeneratorExp": "generator_expression", "IfExp": "conditional_expression", "Starred": "list_splat", "NamedExpr": "named_expression", "JoinedStr": "string", "FormattedValue": "interpolation",
}


#: Kinds of constants by the classes of their values, and parts without a place that hold others.
_CONSTANTS = {str: "string", bytes: "string", int: "integer", float: "float", complex: "float", type(None): "none", type(...): "ellipsis"}
_HELD = (ast.comprehension, ast.withitem, ast.match_case, ast.keyword, ast.arguments)


def _python_kind(x: ast.AST) -> str:
    if isinstance(x, ast.Constant):
        return _CONSTANTS.get(type(x.value)) or str(x.value).lower()
    if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not):
        return "not_operator"
    return _PYTHON_KINDS.get(type(x).__name__, type(x).__name__.lower())


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<word>[^\W\d]\w*|[$@][\w$]*|\d[\w.]*)|(?P<op>=>|:=|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|->|::|\.\.\.|[+\-*/%&|^]=|.)""",
    re.S,
)
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "function", "func", "await", "typeof", "throw", "synchronized", "super", "case", "in", "of"}
_GO_WORDS = {"go", "defer", "range"}
_TYPES = ("class", "interface", "enum", "record")
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_CLOSERS = frozenset(_CLOSING.values())


class Reader:
    """Reads tokens of a C-like file into nodes."""

    def __init__(self, tree: Tree):
        self.tree, self.java, self.go = tree, tree.family == "java", tree.family == "go"
        self.calls = CALLS[tree.family]
        self.tok: list[tuple[str, str, int, int]] = [(kind, m[0], *m.span()) for m in _TOKEN.finditer(tree.source) if (kind := m.lastgroup) != "skip"]
        #: Texts of tokens, None for quoted ones.
        self.shown = [None if t[0] == "str" else t[1] for t in self.tok]
        self.pair = self._pairs()
        self.back = {v: a for a, v in self.pair.items()}

    def _pairs(self) -> dict[int, int]:
        pair, stack, shown = {}, [], self.shown
        for i, t in enumerate(shown):
            if t in _CLOSING:
                stack.append(i)
            elif t in _CLOSERS:
                if stack and _CLOSING[shown[stack[-1]]] == t:
                    pair[stack.pop()] = i
                else:
                    self.tree.error = True
        if stack:
            self.tree.error = True
            for i in stack:
                pair[i] = len(self.tok) - 1
        return pair

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.shown) and self.shown[i] in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tok) and self.tok[i][0] == "word"

    def node(self, kind: str, i: int, j: int, **more) -> Node:
        """A node over tokens i to j - 1."""
        start = self.tok[i][2] if i < len(self.tok) else len(self.tree.source)
        return Node(kind, start, self.tok[j - 1][3] if j > i else start, **more)

    def file(self) -> Node:
        root = Node("program", 0, len(self.tree.source))
        root.children = self.statements(0, len(self.tok), "")
        return root

    def statements(self, i: int, end: int, holder: str) -> list[Node]:
        out = []
        while i < end:
            before = i
            i, nodes = self.statement(i, end, holder)
            out += nodes
            i = max(i, before + 1)
        return out

    def end_of(self, i: int, end: int) -> int:
        """The token after a simple statement that begins at i; line ends count where the language has them do so."""
        j, shown, tok, pair, source = i, self.shown, self.tok, self.pair, self.tree.source
        while j < end:
            t = shown[j]
            if t == ";":
                return j
            if t in _CLOSING and j in pair:
                j = min(pair[j], end)
            elif t == "}":
                return j
            if not self.java and j + 1 < end and source.find("\n", tok[j][3], tok[j + 1][2]) >= 0:
                glued = self.tok[j][0] == "op" and self.tok[j][1] not in ")]}" and self.tok[j][1] not in ("++", "--")
                if not glued and not self.is_(j + 1, ".", "?", "+", "&&", "||", ",", ")", "=", ":"):
                    return j + 1
            j += 1
        return end

    def block(self, i: int, end: int, holder: str) -> tuple[int, Node]:
        """A braced block, or one statement."""
        if self.is_(i, "{") and i in self.pair:
            j = self.pair[i]
            n = self.node("block" if self.java or self.go else "statement_block", i, j + 1)
            n.children = self.statements(i + 1, j, holder)
            return j + 1, n
        j, nodes = self.statement(i, end, holder)
        n = self.node("expression_statement", i, max(j, i + 1))
        n.children = nodes
        return j, n

    def statement(self, i: int, end: int, holder: str) -> tuple[int, list[Node]]:
        t = self.shown[i] if i < len(self.shown) else None
        if t in (";", "}", ",", ")"):
            return i + 1, []
        if t == "{" and i in self.pair:
            j, n = self.block(i, end, holder)
            return j, [n]
        if t in ("if", "while", "for", "switch", "catch", "synchronized", "with"):
            return self.control(i, end, holder)
        if t in ("else", "try", "finally", "do", "case", "export"):
            if t == "do":
                j, body = self.block(i + 1, end, holder)
                n = self.node("do_statement", i, j)
                n.fields["body"] = body
                n.children = [body]
                return j, [n]
            return i + 1, []
        if t == "import" and not self.java and not self.go:
            return self.import_(i, end)
        if t == "return":
            j = self.end_of(i + 1, end)
            n = self.node("return_statement", i, j)
            n.children = self.expressions(i + 1, j)
            return j, [n]
        k = i
        while self.word(k) and not self.is_(k, *_TYPES, "function", "func") and self.tok[k][1] in ("public", "private", "protected", "static", "final", "abstract", "export", "default", "async", "declare"):
            k += 1
        if self.is_(k, *_TYPES) and self.word(k + 1):
            return self.type_(i, k, end)
        method = self.method(i, end, holder)
        if method:
            return method
        return self.simple(i, end)

    def control(self, i: int, end: int, holder: str) -> tuple[int, list[Node]]:
        word = self.tok[i][1]
        if self.go or not self.is_(i + 1, "(") or i + 1 not in self.pair:  # Go has no parentheses here
            j = i + 1
            while j < end and not self.is_(j, "{"):
                j = self.pair[j] + 1 if self.is_(j, "(", "[") and j in self.pair else j + 1
            head = (i + 1, j)
        else:
            head, j = (i + 2, self.pair[i + 1]), self.pair[i + 1] + 1
        condition = self.simple_parts(*head)
        j, body = self.block(j, end, holder)
        if word == "if":
            n = self.node("if_statement", i, j)
            n.fields["consequence"] = body
            n.children = [*condition, body]
            if self.is_(j, "else"):
                j, other = self.block(j + 1, end, holder)
                n.fields["alternative"] = other
                n.children.append(other)
                n.end = other.end
            return j, [n]
        inside = self.tok[head[0] : head[1]]
        kind = {"while": "while_statement", "for": "for_statement"}.get(word, f"{word}_statement")
        if word == "for" and not any(t[1] == ";" for t in inside):
            if self.java and any(t[1] == ":" for t in inside):
                kind = "enhanced_for_statement"
            elif not self.go and any(t[1] in ("of", "in") for t in inside):
                kind = "for_in_statement"
        n = self.node(kind, i, j)
        n.fields["body"] = body
        n.children = [*condition, body]
        return j, [n]

    def import_(self, i: int, end: int) -> tuple[int, list[Node]]:
        j = self.end_of(i, end)
        n = self.node("import_statement", i, j)
        text = self.tree.text(n)
        path = re.search(r"""["']([^"']+)["']""", text)
        n.name = path[1] if path else ""
        names = []
        braces = re.search(r"\{([^}]*)\}", text)
        for part in braces[1].split(",") if braces else []:
            words = part.replace("type ", "").split()
            if words:
                names.append(f"{words[-1]}={words[0]}")
        space = re.search(r"\*\s+as\s+([\w$]+)", text)
        if space:
            names.append(f"{space[1]}=*")
        default = re.match(r"import\s+(?:type\s+)?([\w$]+)", text)
        if default and default[1] != "type":
            names.append(f"{default[1]}=default")
        n.children = [Node("import_specifier", n.start, n.end, name=x) for x in names]
        return j, [n]

    def type_(self, i: int, k: int, end: int) -> tuple[int, list[Node]]:
        n = self.node(f"{self.tok[k][1]}_declaration", i, k + 1, name=self.tok[k + 1][1])
        j, mode, above = k + 2, "", {"extends": [], "implements": []}
        while j < end and not self.is_(j, "{"):
            if self.is_(j, "extends", "implements"):
                mode = self.tok[j][1]
            elif self.is_(j, "<"):
                depth = 0
                while j < end:
                    depth += self.is_(j, "<") - self.is_(j, ">")
                    if depth <= 0:
                        break
                    j += 1
            elif mode and self.word(j) and not self.is_(j + 1, "."):
                above[mode].append(self.tok[j][1])
            j += 1
        n.fields |= {m: Node(m, n.start, n.start, name=",".join(v)) for m, v in above.items() if v}
        if j < end and j in self.pair:
            close = self.pair[j]
            body = self.node("class_body", j, close + 1)
            body.children = self.statements(j + 1, close, n.name)
            n.fields["body"] = body
            n.children = [body]
            j = close + 1
        n.end = self.tok[min(j, len(self.tok)) - 1][3]
        return j, [n]

    def method(self, i: int, end: int, holder: str) -> tuple[int, list[Node]] | None:
        """A method or function with a parameter list and a body, or None."""
        k = i
        while self.is_(k, "@") or self.word(k) and self.tok[k][1].startswith("@"):
            k += 1
            if self.is_(k, "(") and k in self.pair:
                k = self.pair[k] + 1
        if self.go or self.is_(k, "function", "async") or self.is_(k + 1, "function"):
            while k < end and not self.is_(k, "func", "function"):
                if self.go or not self.word(k):
                    return None
                k += 1
            k += 1
            if self.is_(k, "*"):
                k += 1
            kind = "function_declaration"
            if self.go and self.is_(k, "(") and k in self.pair:
                k, kind = self.pair[k] + 1, "method_declaration"
            if not (self.word(k) and self.is_(k + 1, "(") and k + 1 in self.pair):
                return None
            name, open_ = self.tok[k][1], k + 1
        elif holder:
            open_ = k
            while open_ < end and self.shown[open_] not in ("(", ";", "{", "}", "="):
                open_ += 1
            if not (self.is_(open_, "(") and open_ in self.pair and self.word(open_ - 1)) or self.tok[open_ - 1][1] in _NOT_NAMES:
                return None
            name = self.tok[open_ - 1][1]
            kind = "method_definition" if not self.java else "constructor_declaration" if name == holder else "method_declaration"
        else:
            return None
        j = self.pair[open_] + 1
        while j < end and not self.is_(j, "{", ";"):
            if not self.go and not self.java and "\n" in self.tree.source[self.tok[j - 1][3] : self.tok[j][2]]:
                return None
            if self.is_(j, "="):
                return None
            j = self.pair[j] + 1 if self.is_(j, "(", "[") and j in self.pair else j + 1
            if self.go and self.is_(j - 1, "struct", "interface") and j in self.pair:
                j = self.pair[j] + 1
        n = self.node(kind, i, min(j + 1, end), name=name)
        n.fields["parameters"] = self.parameters(open_)
        if self.is_(j, "{") and j in self.pair:
            j, body = self.block(j, end, "")
            n.fields["body"] = body
            n.children = [body]
            n.end = body.end
            return j, [n]
        return (j + 1, [n]) if self.java or holder else None

    def parameters(self, open_: int) -> Node:
        close = self.pair[open_]
        out = self.node("parameters", open_, close + 1)
        i = open_ + 1
        while i < close:
            j = i
            while j < close and not self.is_(j, ","):
                j = self.pair[j] + 1 if self.is_(j, "(", "[", "{") and j in self.pair else j + 1
            if j > i:
                p = self.node("formal_parameter" if self.java else "parameter", i, j)
                words = [k for k in range(i, j) if self.word(k)]
                if words:
                    at = words[-1] if self.java else words[0]
                    for k in range(i, j):
                        if self.is_(k, ":", "=", "?") and not self.java:
                            at = max((w for w in words if w < k), default=words[0])
                            break
                    p.name = self.tok[at][1]
                    p.fields["name"] = self.node("identifier", at, at + 1)
                    typed = self.tree.text(p)
                    p.fields["type"] = Node("type", p.start, p.start, name=re.sub(r"<.*", "", typed.split(":")[1].strip() if not self.java and ":" in typed else self.tok[at - 1][1] if self.java and at > i else ""))
                out.children.append(p)
            i = j + 1
        return out

    def simple(self, i: int, end: int) -> tuple[int, list[Node]]:
        j = self.end_of(i, end)
        return j, self.simple_parts(i, j)

    def simple_parts(self, i: int, j: int) -> list[Node]:
        """Declarations, assignments and expressions of tokens i to j - 1."""
        if i >= j:
            return []
        at, k, shown, pair = None, i, self.shown, self.pair
        while k < j:
            t = shown[k]
            if t in ("=", ":=", "+="):
                at = k
                break
            k = pair[k] + 1 if t in _CLOSING and k in pair else k + 1
        declared = self.is_(i, "const", "let", "var")
        if at is None:
            if (declared or self.java and self.word(i) and self.word(j - 1) and j - i >= 2 and not any(self.tok[k][1][0].isdigit() for k in range(i, j)) and all(self.word(k) or self.is_(k, "<", ">", "[", "]", ".", ",") for k in range(i, j))) and not self.is_(i, "return", "throw", "break", "continue", "package", "import"):
                n = self.node(DECLARATIONS[self.tree.family][0], i, j, name=self.tok[i + 1][1] if declared and i + 1 < j else self.tok[j - 1][1])
                return [n]
            return self.expressions(i, j)
        left = self.node("left", i, at)
        typed = self.java and at - i >= 2 and self.word(at - 1) and (self.word(at - 2) or self.is_(at - 2, ">", "]"))
        value = self.node("value", at + 1, j)
        value.children = self.expressions(at + 1, j)
        if declared and not self.go or typed or declared and self.go:
            kind = DECLARATIONS[self.tree.family][0] if not self.is_(i, "var") or self.go else "variable_declaration"
            n = self.node(kind, i, j, name=self.tok[i + 1][1] if declared and i + 1 < at else self.tok[at - 1][1])
            if typed:
                n.fields["type"] = Node("type", n.start, n.start, name=re.sub(r"<.*", "", self.tree.source[left.start : self.tok[at - 2][3]].split()[-1] if " " in self.tree.source[left.start : self.tok[at - 2][3]] else self.tree.source[left.start : self.tok[at - 2][3]]).rsplit(".", 1)[-1])
            elif declared and i + 2 < at and self.is_(i + 2, ":") and i + 3 < at:
                n.fields["type"] = Node("type", n.start, n.start, name=self.tok[i + 3][1])
            n.fields["value"] = value
            n.children = value.children
            # A function given to a name takes that name.
            for c in n.children[:1]:
                if c.kind in ("arrow_function", "function_expression") and not c.name:
                    c.name = n.name
            return [n]
        kind = ("short_var_declaration" if self.is_(at, ":=") else "assignment_statement") if self.go else "assignment_expression"
        n = self.node(kind, i, j)
        n.fields |= {"left": left, "right": value}
        n.children = [*self.expressions(i, at), *value.children]
        return [n]

    def expressions(self, i: int, j: int) -> list[Node]:
        """Calls and functions inside tokens i to j - 1, outermost ones as nodes that hold the inner."""
        out: list[Node] = []
        k, shown, tok = i, self.shown, self.tok
        while k < j:
            t = shown[k]
            # At most tokens nothing begins.
            if t not in _CLOSING and (tok[k][0] != "word" or (self.java or t not in ("function", "func")) and not (k + 1 < j and shown[k + 1] in ("=>", "->"))):
                k += 1
                continue
            if t in ("function", "func") and not self.java:
                open_ = k + 1
                while open_ < j and not self.is_(open_, "("):
                    open_ += 1
                body = self.pair.get(open_, j) + 1
                while body < j and not self.is_(body, "{"):
                    body += 1
                if body < j and body in self.pair:
                    n = self.node("function_expression", k, self.pair[body] + 1)
                    n.fields["parameters"] = self.parameters(open_)
                    _, n.fields["body"] = self.block(body, j, "")
                    n.children = [n.fields["body"]]
                    out.append(n)
                    k = self.pair[body] + 1
                    continue
            arrow = self.pair[k] + 1 if self.is_(k, "(") and k in self.pair else k + 1 if self.word(k) else None
            if arrow is not None and arrow < j and self.is_(arrow, "=>", "->"):
                n = self.node("arrow_function" if not self.java else "lambda_expression", k, j)
                n.fields["parameters"] = self.parameters(k) if self.is_(k, "(") else self.node("parameters", k, k + 1, children=[self.node("identifier", k, k + 1, name=self.tok[k][1])])
                if self.is_(arrow + 1, "{") and arrow + 1 in self.pair:
                    after, body = self.block(arrow + 1, j, "")
                else:
                    after = arrow + 1
                    while after < j and not self.is_(after, ",", ")"):
                        after = self.pair[after] + 1 if self.is_(after, "(", "[", "{") and after in self.pair else after + 1
                    body = self.node("expression", arrow + 1, after)
                    body.children = self.expressions(arrow + 1, after)
                n.end, n.fields["body"], n.children = body.end, body, [body]
                out.append(n)
                k = after
                continue
            if self.is_(k, "(") and k in self.pair and self.pair[k] < j and (self.word(k - 1) or self.is_(k - 1, ">", ")", "]")) and k > i and self.tok[k - 1][1] not in _NOT_NAMES and not (self.go and self.tok[k - 1][1] in _GO_WORDS):
                out = self.call(out, i, k)
                k = self.pair[k] + 1
                continue
            if self.is_(k, "(", "[", "{") and k in self.pair and self.pair[k] < j:
                if self.is_(k, "{") and not self.java and not self.go or not self.is_(k, "{"):
                    out += self.expressions(k + 1, self.pair[k])
                else:
                    out += self.statements(k + 1, self.pair[k], "anonymous" if self.java else "")
                k = self.pair[k] + 1
                continue
            k += 1
        return out

    def call(self, before: list[Node], i: int, open_: int) -> list[Node]:
        """Adds the call whose argument list opens at a token; its chain takes in the call it is made on."""
        close, k = self.pair[open_], open_ - 1
        if self.is_(k, ">"):  # type arguments
            while k > i and not self.is_(k, "<"):
                k -= 1
            k -= 1
        name = self.tok[k][1] if self.word(k) else ""
        first = k
        while first - 1 >= i and self.is_(first - 1, ".", "?.", "::"):
            p = first - 2
            while p >= i and p in self.back:
                p = self.back[p] - 1
            if p < i or not (self.word(p) or self.tok[p][0] == "str"):
                first = max(i, p + 1)
                break
            first = p
        fresh = first - 1 >= i and self.is_(first - 1, "new")
        kind = self.calls[-1] if fresh else self.calls[0]
        n = self.node(kind, first - 1 if fresh else first, close + 1, name=name)
        inner = [b for b in before if b.start >= n.start]
        arguments = self.node("argument_list", open_, close + 1)
        arguments.children = self.expressions(open_ + 1, close)
        n.fields["arguments"] = arguments
        n.fields["name"] = self.node("identifier", k, k + 1, name=name)
        if first < k:
            held = self.node("identifier" if k - first == 2 else "object", first, k - 1)
            held.name = self.tree.text(held)
            n.fields["object"] = held
        n.children = [*inner, arguments]
        return [b for b in before if b.start < n.start] + [n]
