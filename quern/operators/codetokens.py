"""Declarations, imports, exports and calls of JavaScript, TypeScript, Java and Go, read from tokens.

The lexer pairs the delimiters, so a declaration's parameters, body and members are found by index; each token
is looked at a constant number of times. Comments and literals never take part, but for documentation
comments, which are the comment lines right before a declaration.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from quern.syntax.lexing import NAME, PUNCT, STRING, TEMPLATE, Lexer


@dataclass
class Entity:
    """A declaration; lines count from 1. Lists hold texts, ``parameters`` pairs of name and type."""

    kind: str
    name: str
    start: int
    end: int
    exported: bool
    signature: str
    owner: str = ""
    parameters: list[tuple[str, str]] = field(default_factory=list)
    returns: str = ""
    flags: list[str] = field(default_factory=list)
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    generics: list[str] = field(default_factory=list)
    doc: str = ""


_MODIFIERS = frozenset("public private protected static final abstract readonly async override default declare synchronized native transient volatile sealed strictfp export get set accessor".split())
_NOT_CALLED = frozenset("async if for while switch catch return function new typeof sizeof await throw else do case in of super this import require constructor synchronized func go defer select range try with delete void instanceof yield class".split())
_NOT_TYPE = frozenset("return new else throw case assert yield await import package instanceof goto".split())


class Reader:
    """Reads one file's tokens."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        lexer = Lexer(text, {"typescript": "js", "tsx": "js", "javascript": "js", "jsx": "js"}.get(language, language))
        lexer.run()
        self.tokens, self.match = lexer.tokens, lexer.match
        self.lines = text.split("\n")
        self.entities: list[Entity] = []
        self.spans: list[tuple[int, int, str]] = []  # token ranges of functions, outer before inner
        self.declared: set[int] = set()  # tokens that are a declaration's name

    # Steps over tokens

    def value(self, i: int) -> str:
        t = self.tokens[i] if 0 <= i < len(self.tokens) else self.tokens[-1]
        return t[1] if t[0] in (NAME, PUNCT) else ""

    def is_name(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] == NAME

    def close(self, i: int) -> int:
        """Index of the delimiter that closes the one at i."""
        return self.match.get(i, len(self.tokens) - 1)

    def source(self, a: int, z: int) -> str:
        """The text of tokens a to z, the latter left out, on one line."""
        if a >= z:
            return ""
        last = self.tokens[z - 1]
        end = last[5] + (len(last[1]) if isinstance(last[1], str) else 1)
        return re.sub(r"\s+", " ", self.text[self.tokens[a][5] : end]).strip()

    def angles(self, i: int) -> int:
        """Behind the type arguments that begin at i, i if there are none."""
        if self.value(i) != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.tokens), i + 400)):
            v = self.value(j)
            if v == "<":
                depth += 1
            elif v == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif v in (";", "{", "}", ")") and not (v in "{}" and self.language not in ("java", "go")):
                break
        return i

    def split(self, a: int, z: int, at: str = ",") -> list[tuple[int, int]]:
        """The parts between separators of the same level in tokens a to z."""
        out, begin, i, depth = [], a, a, 0
        while i < z:
            v = self.value(i)
            if v in ("(", "[", "{") and i in self.match:
                i = self.close(i)
            elif v == "<":
                depth += 1
            elif v == ">" and depth:
                depth -= 1
            elif v == at and not depth:
                out.append((begin, i))
                begin = i + 1
            i += 1
        if begin < z:
            out.append((begin, z))
        return out

    def doc(self, i: int) -> str:
        """The comment right above a token's line."""
        at = self.tokens[i][2] - 2
        out: list[str] = []
        while at >= 0:
            line = self.lines[at].strip()
            if line.startswith("@") and not out:
                at -= 1
                continue
            if not (line.startswith(("//", "*", "/*")) or line.endswith("*/")):
                break
            out.append(line)
            if line.startswith("/*"):
                break
            at -= 1
        cleaned = [re.sub(r"^(?:/\*\*?|\*/|\*|//+)\s?|\s*\*/$", "", x).strip() for x in reversed(out)]
        return " ".join(x for x in cleaned if x)

    # Declarations

    def add(self, kind: str, name_at: int, start: int, end: int, exported: bool, head_end: int, owner: str = "", **more) -> Entity:
        last = self.tokens[min(end, len(self.tokens) - 1)]
        e = Entity(kind, str(self.tokens[name_at][1]).lstrip("#"), self.tokens[name_at][2], max(last[2], self.tokens[name_at][2]), exported, self.source(start, head_end), owner, doc=self.doc(start), **more)
        self.entities.append(e)
        self.declared.add(name_at)
        if kind in ("function", "method"):
            self.spans.append((name_at, end, e.name))
        return e

    def parameters(self, open_at: int) -> list[tuple[str, str]]:
        out = []
        for a, z in self.split(open_at + 1, self.close(open_at)):
            while a < z and self.value(a) in _MODIFIERS:
                a += 1
            while a < z and self.value(a) == "@":
                a += 2
                a = self.close(a) + 1 if self.value(a) == "(" else a
            if a >= z:
                continue
            if self.language == "java":
                out.append((self.source(z - 1, z), self.source(a, z - 1)))
            elif self.language == "go":
                out.append((self.source(a, a + 1), self.source(a + 1, z)))
            else:
                cut = next((p for p, _ in self.split(a, z, "=")[1:2]), None)
                body_end = cut - 1 if cut else z
                parts = self.split(a, body_end, ":")
                name = self.source(*parts[0]).rstrip("?") if parts else ""
                out.append((name, self.source(parts[1][0], body_end) if len(parts) > 1 else ""))
        if self.language == "go":  # in "a, b int" both have the type
            kind = ""
            for k in range(len(out) - 1, -1, -1):
                kind = out[k][1] or kind
                out[k] = (out[k][0], out[k][1] or kind)
        return out

    def statement_end(self, i: int) -> int:
        """The token that ends the statement begun at i."""
        n = len(self.tokens)
        begin = i
        while i < n - 1:
            v = self.value(i)
            if v in ("(", "[", "{") and i in self.match:
                i = self.close(i)
                nxt = self.tokens[i + 1]
                if v == "{" and nxt[3] and not (nxt[0] == PUNCT and nxt[1] in (".", ",", "?", ":", "+", "(")):
                    return i
            elif v == ";":
                return i
            elif v in (")", "]", "}"):
                return i - 1
            elif i > begin and self.tokens[i][3] and self.language != "java" and self.tokens[i][0] == NAME and self.value(i - 1) not in (",", "=", "=>", "+", "-", "*", "|", "&", "&&", "||", "?", ":", ".", "(", "<", "??"):
                return i - 1
            i += 1
        return n - 1

    def generics(self, i: int) -> tuple[list[str], int]:
        z = self.angles(i)
        return ([self.source(a, b) for a, b in self.split(i + 1, z - 1)] if z > i else []), z

    def script(self, a: int, z: int, top: bool) -> None:
        """Declarations of JavaScript and TypeScript in tokens a to z."""
        i = a
        while i < z:
            start, flags, exported = i, [], False
            while self.is_name(i) and self.value(i) in ("export", "default", "declare", "abstract", "async") and (self.is_name(i + 1) or self.value(i + 1) in ("*",)):
                exported |= self.value(i) == "export"
                flags.append(self.value(i))
                i += 1
            v = self.value(i)
            flags = [f for f in flags if f in ("async", "abstract", "default")]
            if v == "function" and self.tokens[i][0] == NAME:
                star = self.value(i + 1) == "*"
                at = i + 1 + star
                if self.is_name(at):
                    generics, p = self.generics(at + 1)
                    if self.value(p) == "(":
                        i = self.callable("function", at, start, p, exported, flags + ["generator"] * star, generics)
                        continue
            elif v == "class" and self.is_name(i + 1) and self.value(i - 1) not in (".",):
                i = self.class_(i, start, exported, flags)
                continue
            elif v == "interface" and self.is_name(i + 1) and self.language in ("typescript", "tsx"):
                generics, p = self.generics(i + 2)
                extends, p = self.heritage(p, "extends")
                if self.value(p) == "{":
                    self.add("interface", i + 1, start, self.close(p), exported, p, extends=extends, generics=generics)
                    i = self.close(p) + 1
                    continue
            elif v == "type" and self.is_name(i + 1) and self.language in ("typescript", "tsx"):
                generics, p = self.generics(i + 2)
                if self.value(p) == "=":
                    end = self.statement_end(p)
                    self.add("type_alias", i + 1, start, end, exported, min(end + 1, p + 60), generics=generics)
                    i = end + 1
                    continue
            elif v == "enum" and self.is_name(i + 1) and self.value(i + 2) == "{":
                self.add("enum", i + 1, start, self.close(i + 2), exported, i + 2)
                i = self.close(i + 2) + 1
                continue
            elif v in ("const", "let", "var") and self.is_name(i + 1):
                if self.value(i + 1) == "enum" and self.is_name(i + 2) and self.value(i + 3) == "{":
                    self.add("enum", i + 2, start, self.close(i + 3), exported, i + 3)
                    i = self.close(i + 3) + 1
                    continue
                i = self.variable(i + 1, start, exported, top)
                continue
            if i < z and self.value(i) in ("{", "(", "[") and i in self.match:
                inner = self.close(i)
                self.script(i + 1, inner, False)
                i = inner + 1
            else:
                i += 1

    def callable(self, kind: str, at: int, start: int, open_at: int, exported: bool, flags: list[str], generics: list[str], owner: str = "") -> int:
        """Adds a function whose parameters open at ``open_at``; the index behind it."""
        p = self.close(open_at) + 1
        returns, begin = "", p
        if self.value(p) == ":":
            p += 1
            begin = p
            while p < len(self.tokens) - 1 and self.value(p) not in (";", "}") and not (self.value(p) == "{" and p > begin and self.value(p - 1) not in ("|", "&", ":", "=>")):
                if self.tokens[p][3] and p > begin and self.value(p - 1) not in ("|", "&", "=>", ","):
                    break
                p = self.close(p) + 1 if self.value(p) in ("(", "[", "{") and p in self.match else p + 1
            returns = self.source(begin, p)
        end = self.close(p) if self.value(p) == "{" else max(p - 1, open_at)
        self.add(kind, at, start, end, exported, p, owner, parameters=self.parameters(open_at), returns=returns, flags=flags, generics=generics)
        if self.value(p) == "{":
            self.script(p + 1, end, False)
        return end + 1

    def heritage(self, p: int, word: str) -> tuple[list[str], int]:
        out = []
        if self.value(p) == word:
            begin = p + 1
            p = begin
            while p < len(self.tokens) - 1 and self.value(p) not in ("{", "extends", "implements", "permits", ";"):
                p = self.close(p) + 1 if self.value(p) in ("(", "[") and p in self.match else p + 1
            out = [self.source(a, b) for a, b in self.split(begin, p)]
        return out, p

    def class_(self, i: int, start: int, exported: bool, flags: list[str]) -> int:
        at = i + 1
        generics, p = self.generics(at + 1)
        extends, p = self.heritage(p, "extends")
        implements, p = self.heritage(p, "implements")
        if self.value(p) != "{":
            return i + 1
        end = self.close(p)
        name = self.value(at)
        self.add("class", at, start, end, exported, p, extends=extends, implements=implements, generics=generics, flags=flags)
        k = p + 1
        while k < end:
            k = self.member(k, end, name)
        return end + 1

    def member(self, k: int, end: int, owner: str) -> int:
        start, flags = k, []
        while k < end and self.value(k) == "@":
            k += 2
            while self.value(k) == ".":
                k += 2
            k = self.close(k) + 1 if self.value(k) == "(" else k
        while self.is_name(k) and self.value(k) in _MODIFIERS and (self.is_name(k + 1) or self.value(k + 1) in ("*", "[", "#") or self.tokens[k + 1][0] == STRING):
            flags.append(self.value(k))
            k += 1
        if self.value(k) == "*":
            flags.append("generator")
            k += 1
        if self.value(k) == "#":
            k += 1
        if self.value(k) == "{":  # static block
            self.script(k + 1, self.close(k), False)
            return self.close(k) + 1
        if self.is_name(k):
            after = k + 1 + (self.value(k + 1) in ("?", "!"))
            generics, p = self.generics(after)
            if self.value(p) == "(":
                return self.callable("method", k, start, p, False, flags, generics, owner)
            if self.value(after) in (":", "=", ";") or self.tokens[after][3] or self.value(after) == "}":
                stop = self.statement_end(after)
                head = next((q for q in range(after, stop + 1) if self.value(q) == "="), stop if self.value(stop) == ";" else stop + 1)
                self.add("property", k, start, stop, False, head, owner, flags=flags, returns=self.source(after + 1, head) if self.value(after) == ":" else "")
                self.script(after, stop + 1, False)
                return max(stop + 1, k + 1)
        if self.value(k) in ("[", "(", "{") and k in self.match:
            return self.close(k) + 1
        return k + 1

    def variable(self, at: int, start: int, exported: bool, top: bool) -> int:
        stop = self.statement_end(at)
        eq = at + 1
        while eq <= stop and self.value(eq) != "=":
            eq = self.close(eq) + 1 if self.value(eq) in ("(", "[", "{") and eq in self.match else eq + 1
        q = eq + 1
        flags = []
        if self.value(q) == "async" and eq < stop:
            flags, q = ["async"], q + 1
        generics, p = self.generics(q)
        arrow = None
        if eq < stop and self.value(p) == "(":
            r = self.close(p) + 1
            begin = r
            while r < stop and self.value(r) not in ("=>", ";", "{") and r - begin < 60:
                r = self.close(r) + 1 if self.value(r) in ("(", "[") and r in self.match else r + 1
            if self.value(r) == "=>":
                arrow = (p, r, self.source(begin + 1, r) if self.value(begin) == ":" else "")
        elif eq < stop and self.is_name(q) and self.value(q + 1) == "=>":
            self.add("function", at, start, stop, exported, q + 1, parameters=[(self.value(q), "")], flags=flags)
            self.script(q + 2, stop + 1, False)
            return stop + 1
        if arrow:
            self.add("function", at, start, stop, exported, arrow[1], parameters=self.parameters(arrow[0]), returns=arrow[2], flags=flags, generics=generics)
            self.script(arrow[1] + 1, stop + 1, False)
        elif eq < stop and self.value(q) == "function":
            p = next((x for x in range(q, min(q + 4, stop)) if self.value(x) == "("), None)
            self.add("function", at, start, stop, exported, p or eq, parameters=self.parameters(p) if p else [], flags=flags)
            self.script(q + 1, stop + 1, False)
        else:
            if top:
                self.add("variable", at, start, stop, exported, min(eq, stop + 1), returns=self.source(at + 2, eq) if self.value(at + 1) == ":" else "")
            self.script(at + 1, stop + 1, False)
        return max(stop + 1, at + 1)

    def java(self, a: int, z: int, owner: str) -> None:
        """Declarations of Java in tokens a to z, the body of a type or a whole file."""
        i = a
        while i < z:
            start, flags = i, []
            while i < z and (self.value(i) in _MODIFIERS or self.value(i) in ("non", "-") or self.value(i) == "@" and self.value(i + 1) != "interface"):
                if self.value(i) == "@":
                    i += 2
                    while self.value(i) == ".":
                        i += 2
                    i = self.close(i) + 1 if self.value(i) == "(" else i
                else:
                    flags.append(self.value(i))
                    i += 1
            if self.value(i) == "@":
                i += 1
            v = self.value(i)
            exported = "public" in flags
            if v in ("class", "interface", "enum", "record") and self.is_name(i + 1):
                at = i + 1
                generics, p = self.generics(at + 1)
                parameters = []
                if v == "record" and self.value(p) == "(":
                    parameters = self.parameters(p)
                    p = self.close(p) + 1
                extends, p = self.heritage(p, "extends")
                implements, p = self.heritage(p, "implements")
                _, p = self.heritage(p, "permits")
                if self.value(p) == "{":
                    end = self.close(p)
                    self.add({"record": "class"}.get(v, v), at, start, end, exported, p, owner, flags=flags, extends=extends, implements=implements, generics=generics, parameters=parameters)
                    body = p + 1
                    if v == "enum":
                        while body < end and self.value(body) != ";":
                            if self.value(body) == "{" and body in self.match:
                                self.java(body + 1, self.close(body), self.value(at))
                            body = self.close(body) + 1 if self.value(body) in ("(", "{", "[") and body in self.match else body + 1
                    self.java(body, end, self.value(at))
                    i = end + 1
                    continue
            if v in ("import", "package"):
                while i < z and self.value(i) != ";":
                    i += 1
                i += 1
                continue
            if v == "{" and i in self.match:
                i = self.close(i) + 1
                continue
            generics, i = self.generics(i)
            # a type, then a name, then parameters, a value or an end
            p = i
            while p < z and (self.is_name(p) and self.value(p) not in _NOT_TYPE or self.value(p) in (".", "[", "]", "?", "@")):
                p += 1
                p = self.angles(p)
            if p - i >= 2 and self.is_name(p - 1) and owner:
                at = p - 1
                if self.value(p) == "(":
                    r = self.close(p) + 1
                    thrown, r = self.heritage(r, "throws") if self.value(r) == "throws" else ([], r)
                    end = self.close(r) if self.value(r) == "{" else r
                    self.add("method", at, start, end, exported, r, owner, parameters=self.parameters(p), returns=self.source(i, at), flags=flags, generics=generics)
                    self.java_body(r, end)
                    i = end + 1
                    continue
                if self.value(p) in ("=", ";", ","):
                    end = p
                    while end < z and self.value(end) != ";":
                        end = self.close(end) + 1 if self.value(end) in ("(", "{", "[") and end in self.match else end + 1
                    self.add("property", at, start, end, exported, p, owner, returns=self.source(i, at), flags=flags)
                    i = end + 1
                    continue
            if p - i == 1 and self.value(p) == "(" and owner and self.value(i) == owner:  # constructor
                r = self.close(p) + 1
                _, r = self.heritage(r, "throws") if self.value(r) == "throws" else ([], r)
                end = self.close(r) if self.value(r) == "{" else r
                self.spans.append((i, end, owner))
                self.declared.add(i)
                self.java_body(r, end)
                i = end + 1
                continue
            i = self.close(i) + 1 if self.value(i) in ("(", "[", "{") and i in self.match else i + 1

    def java_body(self, a: int, z: int) -> None:
        """Types declared inside a method's body."""
        for i in range(a, z):
            if self.tokens[i][0] == NAME and self.tokens[i][1] in ("class", "interface", "enum", "record") and self.is_name(i + 1) and self.value(i - 1) != "." and self.value(i + 2) in ("{", "(", "extends", "implements", "<"):
                self.java(i, min(z, self.statement_end(i) + 1), "")

    def go(self) -> None:
        """Go's declarations, which stand at the top."""
        i, n = 0, len(self.tokens)
        while i < n - 1:
            v = self.value(i)
            if self.tokens[i][0] == NAME and v == "func":
                at, owner = i + 1, ""
                if self.value(at) == "(":
                    owner = next((str(self.tokens[k][1]) for k in range(self.close(at) - 1, at, -1) if self.tokens[k][0] == NAME and self.value(k - 1) != "["), "")
                    at = self.close(at) + 1
                if self.is_name(at):
                    p = at + 1
                    generics = []
                    if self.value(p) == "[":
                        generics = [self.source(a, b) for a, b in self.split(p + 1, self.close(p))]
                        p = self.close(p) + 1
                    r = self.close(p) + 1
                    begin = r
                    while r < n - 1 and self.value(r) not in ("{", ";") or self.value(r - 1) in ("struct", "interface") and self.value(r) == "{":
                        r = self.close(r) + 1 if self.value(r) in ("(", "[", "{") and r in self.match else r + 1
                    end = self.close(r) if self.value(r) == "{" else r
                    self.add("method" if owner else "function", at, i, end, str(self.tokens[at][1])[:1].isupper(), r, owner, parameters=self.parameters(p), returns=self.source(begin, r), generics=generics)
                    i = end + 1
                    continue
            elif self.tokens[i][0] == NAME and v in ("type", "var", "const"):
                group = self.value(i + 1) == "("
                specs = self.split(i + 2, self.close(i + 1), ";") if group else [(i + 1, self.statement_end(i + 1))]
                for a, z in specs:
                    if self.is_name(a):
                        self.go_spec(v, a, z, i if not group else a)
                i = (self.close(i + 1) if group else specs[0][1]) + 1
                continue
            i = self.close(i) + 1 if v in ("(", "[", "{") and i in self.match else i + 1

    def go_spec(self, word: str, a: int, z: int, start: int) -> None:
        exported = str(self.tokens[a][1])[:1].isupper()
        if word != "type":
            for b, _ in self.split(a, next((k for k in range(a, z) if self.value(k) == "="), z)):
                if self.is_name(b):
                    self.add("variable", b, start, z, str(self.tokens[b][1])[:1].isupper(), min(b + 1, z))
            return
        p = a + 1
        generics = []
        if self.value(p) == "[" and self.is_name(p + 1) and self.close(p) > p + 2:
            generics = [self.source(x, y) for x, y in self.split(p + 1, self.close(p))]
            p = self.close(p) + 1
        kind = {"interface": "interface", "struct": "class"}.get(self.value(p), "type_alias")
        extends = []
        if kind == "class" and self.value(p + 1) == "{":
            for x, y in self.split(p + 2, self.close(p + 1), ";"):  # embedded types
                names = [k for k in range(x, y) if self.is_name(k)]
                if names and all(self.is_name(k) or self.value(k) in ("*", ".") for k in range(x, y)) and (len(names) == 1 or self.value(names[0] + 1) == "."):
                    extends.append(self.source(x, y).lstrip("*"))
        self.add(kind, a, start, z, exported, p + 1, generics=generics, extends=extends)

    # Uses

    def read(self) -> None:
        if self.language == "java":
            self.java(0, len(self.tokens) - 1, "")
        elif self.language == "go":
            self.go()
        else:
            self.script(0, len(self.tokens) - 1, True)

    def calls(self) -> list[tuple[str, str, str, bool, int]]:
        """(name, expression, caller, awaited, line): names before an opening parenthesis, with what they are members of."""
        spans = sorted(self.spans)
        owners: list[tuple[int, str]] = []  # innermost function from each token on
        stack: list[tuple[int, str]] = []
        for a, z, name in spans:
            while stack and stack[-1][0] < a:
                end, _ = stack.pop()
                owners.append((end + 1, stack[-1][1] if stack else ""))
            stack.append((z, name))
            owners.append((a, name))
        while stack:
            end, _ = stack.pop()
            owners.append((end + 1, stack[-1][1] if stack else ""))
        places = [o[0] for o in owners]
        out: list[tuple[str, str, str, bool, int]] = []

        def walk(tokens: list[tuple], outer: str | None) -> None:
            for i, t in enumerate(tokens):
                if t[0] == TEMPLATE:
                    k = bisect_right(places, i) - 1
                    for part, _ in t[1]:
                        walk(part, outer if outer is not None else (owners[k][1] if k >= 0 else ""))
                    continue
                if t[1] != "(" or t[0] != PUNCT or not i:
                    continue
                j = i - 1
                if tokens[j][1] == ">" and tokens[j][0] == PUNCT:  # type arguments
                    depth, k = 0, j
                    while k > 0 and j - k < 60:
                        depth += {">": 1, "<": -1}.get(tokens[k][1] if tokens[k][0] == PUNCT else "", 0)
                        if depth == 0:
                            break
                        k -= 1
                    j = k - 1 if depth == 0 else j
                if j < 0 or tokens[j][0] != NAME or (outer is None and j in self.declared) or tokens[j][1] in _NOT_CALLED:
                    continue
                name, parts = tokens[j][1], [tokens[j][1]]
                while j >= 2 and tokens[j - 1][0] == PUNCT and tokens[j - 1][1] in (".", "?.", "::") and (tokens[j - 2][0] == NAME or tokens[j - 2][1] in (")", "]")):
                    parts.append(tokens[j - 1][1])
                    j -= 2
                    if tokens[j][0] != NAME:
                        parts.append("[chained]")
                        break
                    parts.append(tokens[j][1])
                k = bisect_right(places, i) - 1
                caller = outer if outer is not None else (owners[k][1] if k >= 0 else "")
                before = tokens[j - 1][1] if j else ""
                if before == "@":
                    continue  # an annotation
                out.append((name, "".join(reversed(parts)), caller, before == "await", t[2]))

        walk(self.tokens, None)
        return out

    def imports(self) -> list[tuple[str, str, str, bool, bool, int]]:
        """(source, name, alias, type only, side effect, line)."""
        out: list[tuple[str, str, str, bool, bool, int]] = []
        t, n = self.tokens, len(self.tokens)
        text_of = lambda k: str(t[k][1])[1:-1]
        if self.language == "java":
            for i in range(n - 1):
                if t[i][0] == NAME and t[i][1] == "import" and (i == 0 or self.value(i - 1) in (";", "}")):
                    a = i + 1 + (self.value(i + 1) == "static")
                    z = a
                    while z < n - 1 and self.value(z) != ";":
                        z += 1
                    source = "".join(str(x[1]) for x in t[a:z])
                    out.append((source, source.rsplit(".", 1)[-1], "", False, False, t[i][2]))
            return out
        if self.language == "go":
            for i in range(n - 1):
                if t[i][0] == NAME and t[i][1] == "import" and (i == 0 or self.value(i - 1) == ";"):
                    end = self.close(i + 1) if self.value(i + 1) == "(" else i + 3
                    for k in range(i + 1, min(end, n - 1)):
                        if t[k][0] == STRING:
                            alias = self.value(k - 1) if t[k - 1][0] == NAME and self.value(k - 1) != "import" else "." if self.value(k - 1) == "." else ""
                            out.append((text_of(k), text_of(k).rsplit("/", 1)[-1], alias, False, False, t[k][2]))
            return out
        for i in range(n - 1):
            if t[i][0] != NAME or t[i][1] not in ("import", "require") or self.value(i - 1) in (".", "?."):
                continue
            if self.value(i + 1) == "(":
                if t[i + 2][0] == STRING and self.value(i + 3) == ")":
                    out.append((text_of(i + 2), "*", "", False, False, t[i][2]))
                continue
            if t[i][1] == "require":
                continue
            if t[i + 1][0] == STRING:
                out.append((text_of(i + 1), "", "", False, True, t[i][2]))
                continue
            k = i + 1
            only = self.value(k) == "type" and self.value(k + 1) not in ("from", ",")
            k += only
            end = next((q for q in range(k, min(n - 1, k + 4000)) if self.value(q) == "from" and t[q + 1][0] == STRING or self.value(q) == ";"), None)
            if end is None or self.value(end) == ";":
                continue
            source = text_of(end + 1)
            for a, z in self.split(k, end):
                if self.value(a) == "{":
                    for x, y in self.split(a + 1, self.close(a)):
                        mine = self.value(x) == "type" and y - x > 1 and self.value(x + 1) != "as"
                        x += mine
                        name = str(t[x][1]).strip("\"'")
                        out.append((source, name, self.value(y - 1) if y - x == 3 else "", only or mine, False, t[i][2]))
                elif self.value(a) == "*":
                    out.append((source, "*", self.value(z - 1), only, False, t[i][2]))
                elif self.is_name(a):
                    out.append((source, "default", self.value(a), only, False, t[i][2]))
        return out

    def exports(self) -> list[tuple[str, str, int]]:
        """(name, source of a re-export, line); only scripts export by statements."""
        out: list[tuple[str, str, int]] = []
        if self.language in ("java", "go"):
            return out
        t, n = self.tokens, len(self.tokens)
        for i in range(n - 1):
            if t[i][0] != NAME or t[i][1] != "export" or self.value(i - 1) in (".", "?.") or self.value(i + 1) in (":", "=", "("):
                continue
            k = i + 1 + (self.value(i + 1) == "type" and self.value(i + 2) in ("{", "*"))
            line = t[i][2]
            if self.value(k) == "default":
                out.append(("default", "", line))
            elif self.value(k) == "*":
                alias = self.value(k + 2) if self.value(k + 1) == "as" else "*"
                s = next((q for q in range(k, min(n, k + 5)) if t[q][0] == STRING), None)
                out.append((alias, str(t[s][1])[1:-1] if s else "", line))
            elif self.value(k) == "{":
                z = self.close(k)
                source = str(t[z + 2][1])[1:-1] if self.value(z + 1) == "from" and t[z + 2][0] == STRING else ""
                out += [(str(t[y - 1][1]).strip("\"'"), source, line) for x, y in self.split(k + 1, z) if y > x]
        out += [(e.name, "", e.start) for e in self.entities if e.exported and not e.owner and "default" not in e.flags]
        return out
