"""A tolerant recogniser of Java declarations, calls and a few statement facts.

It reads tokens, not grammar: declarations are found by their shape at brace level, bodies
are scanned for calls, literals and control statements. Unknown syntax is skipped to the next
member, so one odd construct costs at most itself. parse(text) returns plain dictionaries.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TOKEN = re.compile(
    r'(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"""(?:\\.|.)*?""")|(?P<string>"(?:\\.|[^"\\\n])*"?)'
    r"|(?P<char>'(?:\\.|[^'\\\n])*'?)|(?P<number>\d(?:[\w.]|(?<=[eEpP])[+-])*|\.\d[\w]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|.)",
    re.S,
)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
KINDS = {"class", "interface", "enum", "record"}
CONTROL = {"if", "for", "while", "do", "try", "switch"}
NOT_CALLS = CONTROL | {"catch", "synchronized", "return", "throw", "assert", "else", "new", "case", "instanceof", "super", "this", "yield", "when"}
NOT_TYPES = NOT_CALLS | MODIFIERS | {"break", "continue", "import", "package", "extends", "implements", "throws", "null", "true", "false", "finally", "goto"}
PRIMITIVES = {"int", "long", "short", "byte", "char", "boolean", "float", "double", "void", "var"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int


def tokens(source: str) -> list[Token]:
    """All tokens but white space; comments included."""
    out, line = [], 1
    for m in TOKEN.finditer(source):
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


def erase(name: str) -> str:
    return re.sub(r"<.*", "", name).replace("[]", "").replace("...", "").strip()


class Parser:
    def __init__(self, source: str):
        self.everything = everything = tokens(source)
        self.docs: dict[int, str] = {}  # index of a token -> the documentation comment before it
        self.tokens: list[Token] = []
        pending = None
        for t in everything:
            if t.kind == "comment":
                pending = t.text if t.text.startswith("/**") else pending
            else:
                if pending is not None:
                    self.docs[len(self.tokens)] = pending
                    pending = None
                self.tokens.append(t)
        self.n = len(self.tokens)
        self.closing = self._match_brackets()
        self.opening = {end: start for start, end in self.closing.items()}
        self.package, self.imports, self.types = "", [], []
        self.edges, self.statements, self.invocations = [], [], []

    def _match_brackets(self) -> dict[int, int]:
        pairs, stack = {}, []
        opens = {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.tokens):
            if t.text in "([{" and t.kind == "op":
                stack.append(i)
            elif t.kind == "op" and t.text in opens:
                while stack:
                    j = stack.pop()
                    if self.tokens[j].text == opens[t.text]:
                        pairs[j] = i
                        break
        return pairs

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < self.n else ""

    def close(self, i: int) -> int:
        """Where the bracket that opens at i closes; the end of an unfinished file."""
        return self.closing.get(i, self.n - 1)

    def parse(self) -> dict:
        i = 0
        while i < self.n:
            word = self.text(i)
            if word == "package":
                i, self.package = self._dotted(i + 1)
            elif word == "import":
                i += 1 + (self.text(i + 1) == "static")
                i, name = self._dotted(i)
                self.imports.append(name)
            else:
                i = self._member(i, self.n, None)
        return {"package": self.package, "imports": self.imports, "types": self.types, "edges": self.edges, "statements": self.statements, "invocations": self.invocations}

    def _dotted(self, i: int) -> tuple[int, str]:
        out = []
        while i < self.n and self.text(i) != ";":
            out.append(self.text(i))
            i += 1
        return i + 1, "".join(out)

    def _annotation(self, i: int) -> tuple[int, dict]:
        i += 1
        name = self.text(i)
        while self.text(i + 1) == "." and i + 2 < self.n:
            i += 2
            name = self.text(i)
        attrs: dict[str, str] = {}
        if self.text(i + 1) == "(":
            end = self.close(i + 1)
            for part in self._split(i + 2, end):
                words = [t.text for t in self.tokens[part[0] : part[1]]]
                if not words:
                    continue
                key, value = (words[0], words[2:]) if len(words) > 1 and words[1] == "=" else ("value", words)
                attrs[key] = "".join(value).strip('"')
            i = end
        return i + 1, {"name": name, "attrs": attrs}

    def _split(self, start: int, end: int, angle: bool = False) -> list[tuple[int, int]]:
        """Pieces between commas outside brackets (and, with angle, outside type arguments)."""
        out, at, depth, i = [], start, 0, start
        while i < end:
            word = self.text(i)
            if self.tokens[i].kind == "op":
                if word in "([{":
                    i = self.close(i)
                elif angle and word == "<":
                    depth += 1
                elif angle and word == ">":
                    depth -= 1
                elif word == "," and depth <= 0:
                    out.append((at, i))
                    at = i + 1
            i += 1
        return [*out, (at, end)] if at < end else out

    def _type(self, i: int) -> tuple[int, str]:
        """A type that may begin at i: where it ends and its text, or i and nothing."""
        start, out = i, []
        while self.text(i) == "@" and self.text(i + 1) != "interface":
            i, _ = self._annotation(i)
        if i >= self.n or self.tokens[i].kind != "name" or self.text(i) in NOT_TYPES:
            return start, ""
        out.append(self.text(i))
        i += 1
        while i < self.n:
            word = self.text(i)
            if word == "." and i + 1 < self.n and self.tokens[i + 1].kind == "name":
                out += [".", self.text(i + 1)]
                i += 2
            elif word == "<":
                end = self._angle(i)
                if end < 0:
                    return start, ""
                out.append(self._join(i, end + 1))
                i = end + 1
            elif word == "[" and self.text(i + 1) == "]":
                out.append("[]")
                i += 2
            elif word == "...":
                out.append("...")
                i += 1
            else:
                break
        return i, "".join(out)

    def _angle(self, i: int) -> int:
        """Where type arguments that open at i close, or -1 if these are not type arguments."""
        depth = 0
        while i < self.n:
            word = self.text(i)
            if word == "<":
                depth += 1
            elif word == ">":
                depth -= 1
                if not depth:
                    return i
            elif word == "@":
                i, _ = self._annotation(i)
                continue
            elif self.tokens[i].kind != "name" and word not in (".", ",", "?", "&", "[", "]"):
                return -1
            i += 1
        return -1

    def _join(self, start: int, end: int) -> str:
        out = ""
        for t in self.tokens[start:end]:
            if out and (out[-1].isalnum() or out[-1] in "?_>,&") and t.kind == "name" and out[-1] != ",":
                out += " "
            out += t.text
        return out.replace(",", ", ")

    def _member(self, i: int, end: int, owner: dict | None) -> int:
        """One declaration at i; returns where the next may begin."""
        begin, modifiers, annotations = i, [], []
        while i < end:
            word = self.text(i)
            if word == "@" and self.text(i + 1) != "interface":
                i, a = self._annotation(i)
                annotations.append(a)
            elif word in MODIFIERS and not (word == "sealed" and self.text(i + 1) == "("):
                modifiers.append(word)
                i += 1
            elif word == "non" and self.text(i + 1) == "-":
                modifiers.append("non-sealed")
                i += 3
            else:
                break
        if i >= end:
            return end
        word = self.text(i)
        if word == "@":  # an annotation type
            return self._declare(i + 1, begin, "interface", modifiers, annotations, owner)
        if word in KINDS and i + 1 < self.n and self.tokens[i + 1].kind == "name" and (word != "record" or self.text(i + 2) in ("(", "<")):
            return self._declare(i, begin, word, modifiers, annotations, owner)
        if word == "{":
            stop = self.close(i)
            if owner is not None:
                self._body(i + 1, stop, owner, "<clinit>" if "static" in modifiers else "<init>", 0, {})
            return stop + 1
        if owner is None:
            return (self.close(i) if word in ("(", "[") else i) + 1
        type_params: list[str] = []
        if word == "<":
            stop = self._angle(i)
            if stop > 0:
                type_params = [self._join(a, b) for a, b in self._split(i + 1, stop, True)]
                i = stop + 1
        name_at = i
        if self.tokens[i].kind == "name" and self.text(i) == owner["name"] and self.text(i + 1) in ("(", "{"):
            return self._method(begin, i, i + 1, "", modifiers, annotations, type_params, owner)
        i, kind = self._type(i)
        if kind and i < end and self.tokens[i].kind == "name":
            if self.text(i + 1) == "(":
                return self._method(begin, i, i + 1, kind, modifiers, annotations, type_params, owner)
            return self._fields(begin, i, kind, modifiers, annotations, owner, end)
        return name_at + 1 if not kind else max(i, name_at + 1)

    def _declare(self, i: int, begin: int, kind: str, modifiers: list, annotations: list, owner: dict | None) -> int:
        name = self.text(i + 1)
        made = {
            "name": name, "kind": kind, "start_line": self.tokens[begin].line, "end_line": 0, "modifiers": modifiers, "annotations": annotations,
            "super_class": "", "interfaces": [], "fields": [], "methods": [], "outer": owner["name"] if owner else "",
        }
        i += 2
        if self.text(i) == "<":
            i = max(self._angle(i), i) + 1
        if kind == "record" and self.text(i) == "(":
            stop = self.close(i)
            for p in self._parameters(i + 1, stop):
                made["fields"].append({"name": p["name"], "type": erase(p["type"]), "modifiers": ["private", "final"], "line": self.tokens[i].line})
            i = stop + 1
        while i < self.n and self.text(i) not in ("{", ";"):
            word = self.text(i)
            if word in ("extends", "implements"):
                found = []
                i, t = self._type(i + 1)
                while t:
                    found.append(t)
                    if self.text(i) != ",":
                        break
                    i, t = self._type(i + 1)
                if word == "extends" and kind != "interface":
                    made["super_class"] = found[0] if found else ""
                else:
                    made["interfaces"] += found
            else:
                i += 1
        stop = self.close(i) if self.text(i) == "{" else i
        self.types.append(made)
        if self.text(i) == "{":
            i += 1
            if kind == "enum":
                i = self._constants(i, stop, made)
            while i < stop:
                if self.text(i) == ";":
                    i += 1
                    continue
                i = max(self._member(i, stop, made), i + 1)
        made["end_line"] = self.tokens[min(stop, self.n - 1)].line
        return stop + 1

    def _constants(self, i: int, stop: int, owner: dict) -> int:
        while i < stop and self.text(i) != ";":
            i = self.close(i) if self.text(i) in ("(", "{", "[") else i
            i += 1
        return i + 1

    def _parameters(self, start: int, end: int) -> list[dict]:
        out = []
        for a, b in self._split(start, end, True):
            while a < b and (self.text(a) in ("final",) or self.text(a) == "@"):
                a = self._annotation(a)[0] if self.text(a) == "@" else a + 1
            at, kind = self._type(a)
            if kind and at < b:
                arrays = "[]" * sum(self.text(k) == "[" for k in range(at + 1, b))
                out.append({"type": kind + arrays, "name": self.text(at)})
        return out

    def _method(self, begin: int, name_at: int, paren: int, returns: str, modifiers: list, annotations: list, type_params: list, owner: dict) -> int:
        name = self.text(name_at)
        params, i = [], paren
        if self.text(paren) == "(":
            stop = self.close(paren)
            params, i = self._parameters(paren + 1, stop), stop + 1
        else:  # the compact constructor of a record
            params = [{"type": f["type"], "name": f["name"]} for f in owner["fields"] if f["modifiers"] == ["private", "final"]]
        throws = []
        while i < self.n and self.text(i) not in ("{", ";"):
            if self.text(i) == "throws":
                i, t = self._type(i + 1)
                while t:
                    throws.append(t)
                    if self.text(i) != ",":
                        break
                    i, t = self._type(i + 1)
            else:
                i = (self.close(i) if self.text(i) in ("(", "[") else i) + 1
        has_body = self.text(i) == "{"
        stop = self.close(i) if has_body else i
        shown = ([] if not returns else [returns]) + [f"{name}({', '.join(p['type'] + ' ' + p['name'] for p in params)})"]
        signature = " ".join([*modifiers, *shown] + (["throws " + ", ".join(throws)] if throws else []))
        made = {
            "name": name, "signature": signature, "return_type": returns, "start_line": self.tokens[begin].line, "end_line": self.tokens[min(stop, self.n - 1)].line,
            "modifiers": modifiers, "params": params, "throws": throws, "type_params": type_params, "annotations": annotations, "is_constructor": not returns,
            "has_body": has_body, "javadoc": self.docs.get(begin, ""), "max_nesting": 0, "used_names": [],
        }
        owner["methods"].append(made)
        if has_body:
            scope = {p["name"]: erase(p["type"]) for p in params}
            self._body(i + 1, stop, owner, name, len(params), scope, made)
        return stop + 1

    def _fields(self, begin: int, i: int, kind: str, modifiers: list, annotations: list, owner: dict, end: int) -> int:
        stop = i
        while stop < end and self.text(stop) != ";":
            stop = (self.close(stop) if self.text(stop) in ("(", "[", "{") else stop) + 1
        for a, b in self._split(i, stop):
            if a < b and self.tokens[a].kind == "name":
                owner["fields"].append({"name": self.text(a), "type": erase(kind), "modifiers": modifiers, "line": self.tokens[begin].line})
        self._body(i, stop, owner, "<init>", 0, {}, None, constant="static" in modifiers and "final" in modifiers)
        return stop + 1

    # Bodies

    def _body(self, start: int, end: int, owner: dict, method: str, arity: int, scope: dict, made: dict | None = None, constant: bool = False) -> None:
        """Calls, local types and statement facts between start and end."""
        scope, i, nesting = dict(scope), start, []
        used: set[str] = set()
        where = {"class_name": owner["name"], "method": method}
        while i < end:
            token, word = self.tokens[i], self.text(i)
            while nesting and i > nesting[-1]:
                nesting.pop()
            if token.kind == "name":
                if self.text(i - 1) != ".":
                    used.add(word)
                if word in KINDS and self.tokens[i + 1].kind == "name" and self.text(i - 1) in ("{", "}", ";") and self.text(i + 2) in ("{", "(", "<", "extends", "implements"):
                    i = self._declare(i, i, word, [], [], owner)
                    continue
                if word in CONTROL:
                    i = self._control(i, end, where, nesting, made)
                elif word == "catch" and self.text(i + 1) == "(":
                    self._catch(i, where, scope)
                elif word == "new":
                    self._new(i, owner, method, arity)
                elif self.text(i + 1) == "(" and word not in NOT_CALLS:
                    self._call(i, owner, method, arity, scope)
                elif word not in NOT_TYPES and self.text(i - 1) != ".":
                    at, kind = self._type(i)
                    if kind and at < end and at > i and self.tokens[at].kind == "name" and self.text(at) not in NOT_TYPES and self.text(at + 1) in ("=", ";", ":", ",", ")"):
                        known = erase(kind)
                        if known == "var" and self.text(at + 1) == "=" and self.text(at + 2) == "new":
                            known = erase(self._type(at + 3)[1])
                        scope[self.text(at)] = known
            elif token.kind == "number" and not constant:
                sign = "-" if self.text(i - 1) == "-" and self.text(i - 2) in ("(", "=", ",", "return") else ""
                self.statements.append(where | {"kind": "number", "line": token.line, "detail": sign + word})
            i += 1
        if made is not None:
            made["used_names"] = sorted(used)

    def _control(self, i: int, end: int, where: dict, nesting: list, made: dict | None) -> int:
        word, line = self.text(i), self.tokens[i].line
        body = i + 1
        if self.text(body) == "(":
            body = self.close(body) + 1
        if word == "switch" and self.text(body) == "{":
            stop = self.close(body)
            inner = [self.text(k) for k in range(body, stop)]
            is_expression = self.text(i - 1) in ("=", "return", "(", ",", "->", "yield")
            if "default" not in inner and not is_expression:
                self.statements.append(where | {"kind": "switch_without_default", "line": line, "detail": ""})
        if word == "if" and self.text(body) == "{" and self.close(body) == body + 1:
            self.statements.append(where | {"kind": "empty_if", "line": line, "detail": ""})
        if word in ("for", "while", "do") and self.text(body) == "{" and self._leaves(body + 1, self.close(body)):
            self.statements.append(where | {"kind": "linear_scan", "line": line, "detail": ""})
        else_if = word == "if" and self.text(i - 1) == "else"
        if not else_if:
            stop = self.close(body) if self.text(body) == "{" else self._statement_end(body, end)
            nesting.append(stop)
            if made is not None:
                made["max_nesting"] = max(made["max_nesting"], len(nesting))
            if len(nesting) == 5:
                self.statements.append(where | {"kind": "deep_nesting", "line": line, "detail": str(len(nesting))})
        return i

    def _leaves(self, start: int, end: int) -> bool:
        """Whether a loop's body may end it early: a value returned, or a plain break."""
        after = {"return": lambda follows: follows != ";", "break": lambda follows: follows == ";"}
        return any(self.text(k) in after and after[self.text(k)](self.text(k + 1)) for k in range(start, end))

    def _statement_end(self, i: int, end: int) -> int:
        while i < end and self.text(i) != ";":
            i = (self.close(i) if self.text(i) in ("(", "[", "{") else i) + 1
        return i

    def _catch(self, i: int, where: dict, scope: dict) -> None:
        close = self.close(i + 1)
        words = [self.text(k) for k in range(i + 2, close) if self.text(k) != "final"]
        types, name = [w for w in words[:-1] if w not in ("|", ".")], words[-1] if words else ""
        scope[name] = types[0] if types else "?"
        if self.text(close + 1) != "{":
            return
        stop = self.close(close + 1)
        for statement in self._catch_kinds(close + 2, stop):
            self.statements.append(where | {"kind": f"catch_{statement}", "line": self.tokens[i].line, "detail": "|".join(types)})
        self.statements.append(where | {"kind": "catch", "line": self.tokens[i].line, "detail": "|".join(types)})

    #: What counts as a default that a catch returns.
    DEFAULTS = {"null", "false", "true", '""', "0", "-1"}

    def _catch_kinds(self, start: int, end: int) -> list[str]:
        """What a catch block does, when nothing in it is a real handling: empty, logs, goes on or returns."""
        if start >= end:
            return ["empty"]
        i, kinds = start, set()
        while i < end:
            stop = self._statement_end(i, end)
            words = [self.text(k) for k in range(i, stop)]
            flat = "".join(words)
            first = words[0] if words else ";"
            if first in ("continue", "break"):
                kinds.add("continue")
            elif first == "return":
                value = flat[len("return") :]
                if value in self.DEFAULTS or re.fullmatch(r"(Collections\.empty\w+|List\.of|Set\.of|Map\.of|Optional\.empty|newArrayList<>|newHashMap<>)\(\)", value):
                    kinds.add("return_default")
                elif not value:
                    kinds.add("return")
                else:
                    return []
            elif "printStackTrace" in words:
                kinds.add("print")
            elif re.match(r"(?i)(log|logger|system\.(out|err))\b", flat):
                kinds.add("log")
            elif words:
                return []
            i = stop + 1
        return sorted(kinds)

    def _arguments(self, paren: int) -> tuple[int, list[str]]:
        stop = self.close(paren)
        parts = self._split(paren + 1, stop)
        return len(parts), [self.text(a) if b == a + 1 else "" for a, b in parts]

    def _edge(self, owner: dict, method: str, arity: int, callee: str, name: str, line: int, count: int) -> None:
        if owner["kind"] in ("class", "interface"):
            self.edges.append({"caller_class": owner["name"], "caller_method": method, "caller_arity": arity, "callee_class": callee, "callee_method": name, "line": line, "arg_count": count})

    def _new(self, i: int, owner: dict, method: str, arity: int) -> None:
        at, kind = self._type(i + 1)
        if kind and self.text(at) == "(":
            made = erase(kind).rpartition(".")[2]
            self._edge(owner, method, arity, made, made, self.tokens[i].line, self._arguments(at)[0])

    def _call(self, i: int, owner: dict, method: str, arity: int, scope: dict) -> None:
        count, literals = self._arguments(i + 1)
        if self.text(i - 1) == "." and self.text(i - 2) == "new":
            return
        at, _ = self._type(i - 1) if self.text(i - 1) == "new" else (i, "")
        if self.text(i - 1) == "new" or self._made_by_new(i):
            return
        self._edge(owner, method, arity, self._receiver(i, owner, scope), self.text(i), self.tokens[i].line, count)
        if any(x.startswith('"') for x in literals):
            self.invocations.append({"class_name": owner["name"], "method": method, "callee": self.text(i), "line": self.tokens[i].line, "literals": [x.strip('"') if x.startswith('"') else None for x in literals]})

    def _made_by_new(self, i: int) -> bool:
        """Whether the name at i ends the type of a `new` expression, as in `new a.B(`."""
        while self.text(i - 1) == "." and self.tokens[i - 2].kind == "name":
            i -= 2
        return self.text(i - 1) == "new"

    def _receiver(self, i: int, owner: dict, scope: dict) -> str:
        """The class a call is made on: a known name's type, a marker to resolve by joins, or `?`."""
        if self.text(i - 1) != ".":
            return owner["name"]
        at = i - 2
        path: list[str] = []
        while at >= 0:
            token = self.tokens[at]
            if token.kind == "name":
                path.append(f"?field:{token.text}")
                if self.text(at - 1) != ".":
                    break
                at -= 2
            elif token.text == ")":
                opened = self.opening.get(at, -1)
                if opened <= 0 or self.tokens[opened - 1].kind != "name" or self.text(opened - 1) in NOT_CALLS:
                    return "?"
                path.append(f"?ret:{self.text(opened - 1)}")
                if self.text(opened - 2) != ".":
                    break
                at = opened - 3
            else:
                return "?"
        path.reverse()
        first, rest = path[0], path[1:]
        name = first.partition(":")[2]
        if first.startswith("?ret:"):
            return owner["name"] + "".join(path) if not self._capital(name) else "?"
        if name in ("this", "super"):
            base = owner["name"] if name == "this" else (erase(owner["super_class"]) or "?")
        elif name in scope:
            base = scope[name]
        else:
            base = next((f["type"] for f in owner["fields"] if f["name"] == name), "")
            if not base:
                base = name if self._capital(name) else (owner["name"] + first)
        return base.rpartition(".")[2] + "".join(rest) if "?" not in base else base + "".join(rest)

    @staticmethod
    def _capital(name: str) -> bool:
        return name[:1].isupper()


def comment_lines(everything: list[Token]) -> list[int]:
    """Lines that hold nothing but comment."""
    comment, code = set(), set()
    for t in everything:
        (comment if t.kind == "comment" else code).update(range(t.line, t.line + t.text.count("\n") + 1))
    return sorted(comment - code)


def loop_lines(source: str) -> list[int]:
    """Lines inside a loop, by a fold over lines: a loop begins where one is written, and a line with a
    closing brace ends one while any is open."""
    depth, out = 0, []
    for number, line in enumerate(source.split("\n"), 1):
        text = line.strip()
        if depth > 0:
            out.append(number)
            if "}" in text:
                depth -= 1
        if text.startswith(("for ", "for(", "while ", "while(")) or "for (" in text or "while (" in text or ".forEach(" in text:
            depth += 1
    return out


def parse(source: str) -> dict:
    """Facts of one file: package, imports, types, edges, statements, invocations, comment and loop lines."""
    parser = Parser(source)
    return parser.parse() | {"comment_lines": comment_lines(parser.everything), "loop_lines": loop_lines(source)}
