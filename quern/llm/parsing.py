"""Recursive-descent parsers over the lexers' tokens: ECMAScript modules, TypeScript, Java and Go.

They decide whether a text is syntactically valid, not what it means: precedence, types and names are
not checked. Each raises ``Broken`` at the first token that cannot stand where it does.
"""

from __future__ import annotations

from quern.syntax.lexing import END, GO_KEYWORDS, NAME, NUMBER, PUNCT, REGEX, STRING, TEMPLATE, Broken, Lexer


class Parser:
    """Cursor over tokens with the steps all parsers share."""

    def __init__(self, tokens: list[tuple], match: dict[int, int]) -> None:
        self.tokens, self.match, self.i = tokens, match, 0
        #: What a token is compared by: names and punctuation as they stand, of other kinds nothing.
        self.values = [t[1] if t[0] is NAME or t[0] is PUNCT or t[0] in (NAME, PUNCT) else "" for t in tokens]

    @property
    def value(self) -> str:
        return self.values[self.i]

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def fresh(self) -> bool:
        return self.tokens[self.i][3]

    def ahead(self, n: int = 1) -> str:
        j = self.i + n
        return self.values[j] if j < len(self.values) - 1 else "\0"

    def ahead_kind(self, n: int = 1) -> str:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)][0]

    def fail(self, message: str = "") -> None:
        kind, value, line = self.tokens[self.i][:3]
        if kind == END:
            raise Broken("premature_end", line, message or "more is due")
        raise Broken("unexpected_token", line, f"{value if isinstance(value, str) else 'template'} {message}".strip()[:80])

    def eat(self, *values: str) -> bool:
        if self.values[self.i] in values:
            self.i += 1
            return True
        return False

    def need(self, *values: str) -> None:
        if not self.eat(*values):
            self.fail(f"instead of {values[0]}")

    def attempt(self, step, *args) -> bool:
        """Whether a step succeeds; if not, the cursor stays."""
        at = self.i
        try:
            step(*args)
            return True
        except Broken:
            self.i = at
            return False

    def separated(self, step, close: str, sep: str = ",", trailing: bool = True) -> None:
        """Items up to a closing delimiter, which is eaten."""
        while not self.eat(close):
            step()
            if not self.eat(sep):
                self.need(close)
                return
            if not trailing and self.value == close:
                self.fail()


JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public await".split()
)
JS_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>>= &= |= ^= &&= ||= ??=".split())
JS_BINARY = frozenset("+ - * / % ** == != === !== < <= && || ?? & | ^ << instanceof".split())
TS_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())


class JavaScript(Parser):
    """An ECMAScript module; with ``ts`` the TypeScript superset."""

    def __init__(self, tokens: list[tuple], match: dict[int, int], ts: bool, depth: int = 0) -> None:
        super().__init__(tokens, match)
        self.ts, self.functions, self.no_in, self.ambient = ts, depth, False, False

    def module(self) -> None:
        while self.kind != END:
            self.statement(top=True)

    def name(self) -> None:
        if self.kind != NAME or self.value in JS_RESERVED:
            if not (self.ts and self.value in ("static", "package", "public", "private", "protected", "implements")):
                self.fail("is no name here")
        self.i += 1

    def any_name(self) -> None:
        if self.eat("#"):
            pass
        if self.kind != NAME:
            self.fail("is no name here")
        self.i += 1

    def end_of_statement(self) -> None:
        if self.eat(";") or self.value == "}" or self.kind == END or self.fresh:
            return
        self.fail("does not end the statement")

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def statement(self, top: bool = False) -> None:
        v = self.value
        if self.kind != NAME:
            if v == "{":
                return self.block()
            if self.eat(";"):
                return None
            if v == "@":
                self.decorators()
                return self.statement(top)
            self.expression()
            return self.end_of_statement()
        n, nk = self.ahead(), self.ahead_kind()
        if v in ("var", "const") or (v == "let" and (nk == NAME or n in ("[", "{"))):
            if v == "const" and n == "enum" and self.ts:
                self.i += 1
                return self.statement(top)
            self.declaration()
            return self.end_of_statement()
        if v == "function" or (v == "async" and n == "function" and not self.tokens[self.i + 1][3]):
            return self.function(True)
        if v == "class":
            return self.klass(True)
        if v == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.eat("else"):
                self.statement()
            return None
        if v == "for":
            return self.for_statement()
        if v == "while":
            self.i += 1
            self.condition()
            return self.statement()
        if v == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.eat(";")
            return None
        if v in ("return", "throw"):
            if v == "return" and not self.functions:
                self.fail("outside a function")
            self.i += 1
            if v == "throw" and self.fresh:
                self.fail()
            if not (self.value in (";", "}") or self.kind == END or self.fresh):
                self.expression()
            return self.end_of_statement()
        if v in ("break", "continue"):
            self.i += 1
            if self.kind == NAME and not self.fresh:
                self.name()
            return self.end_of_statement()
        if v == "try":
            self.i += 1
            self.block()
            caught = False
            if self.eat("catch"):
                caught = True
                if self.eat("("):
                    self.binding()
                    self.annotation()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                caught = True
                self.block()
            if not caught:
                self.fail("instead of catch")
            return None
        if v == "switch":
            self.i += 1
            self.condition()
            self.need("{")
            while not self.eat("}"):
                if self.eat("case"):
                    self.expression()
                else:
                    self.need("default")
                self.need(":")
                while self.value not in ("case", "default", "}"):
                    self.statement()
            return None
        if v == "debugger":
            self.i += 1
            return self.end_of_statement()
        if v == "import" and n not in ("(", "."):
            if not top:
                self.fail("inside a block")
            return self.import_statement()
        if v == "export":
            if not top:
                self.fail("inside a block")
            return self.export_statement()
        if self.ts and nk == NAME and not self.tokens[self.i + 1][3]:
            if v == "interface":
                self.i += 1
                self.name()
                self.type_parameters()
                if self.eat("extends"):
                    self.type()
                    while self.eat(","):
                        self.type()
                return self.object_type()
            if v == "type":
                self.i += 1
                self.name()
                self.type_parameters()
                self.need("=")
                self.type()
                return self.end_of_statement()
            if v == "enum":
                self.i += 1
                self.name()
                self.need("{")
                return self.separated(self.enum_member, "}")
            if v == "abstract" and n == "class":
                self.i += 1
                return self.klass(True)
            if v == "declare":
                self.i += 1
                held, self.ambient = self.ambient, True
                self.statement(top)
                self.ambient = held
                return None
            if v in ("namespace", "module"):
                self.i += 1
                self.name()
                while self.eat("."):
                    self.name()
                return self.namespace()
        if self.ts and v in ("module", "global", "declare") and (nk == STRING or n == "{" or n == "global"):
            self.i += 1
            if v != "global" and self.kind == STRING:
                self.i += 1
            elif v == "declare":
                return self.statement(top)
            return self.namespace()
        if n == ":" and v not in JS_RESERVED:
            self.i += 2
            return self.statement()
        self.expression()
        return self.end_of_statement()

    def namespace(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement(top=True)

    def enum_member(self) -> None:
        if self.kind == STRING:
            self.i += 1
        else:
            self.any_name()
        if self.eat("="):
            self.assignment()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_statement(self) -> None:
        self.i += 1
        self.eat("await")
        self.need("(")
        if not self.eat(";"):
            self.no_in = True
            if self.value in ("var", "const") or (self.value == "let" and (self.ahead_kind() == NAME or self.ahead() in ("[", "{"))):
                self.i += 1
                self.binding()
                self.annotation()
                if self.value not in ("of", "in"):
                    if self.eat("="):
                        self.assignment()
                    while self.eat(","):
                        self.declarator()
            else:
                self.expression()
            self.no_in = False
            if self.eat("of"):
                self.assignment()
                self.need(")")
                return self.statement()
            if self.eat("in"):
                self.expression()
                self.need(")")
                return self.statement()
            self.need(";")
        if self.value != ";":
            self.expression()
        self.need(";")
        if self.value != ")":
            self.expression()
        self.need(")")
        return self.statement()

    def declaration(self) -> None:
        constant = self.value == "const"
        self.i += 1
        self.declarator(constant)
        while self.eat(","):
            self.declarator(constant)

    def declarator(self, constant: bool = False) -> None:
        pattern = self.value in ("[", "{")
        self.binding()
        if self.ts and self.value == "!":
            self.i += 1
        self.annotation()
        if self.eat("="):
            self.assignment()
        elif (constant or pattern) and not self.ambient:
            self.fail("instead of an initial value")

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if self.value != "]":
                    self.need(",")
        elif self.eat("{"):
            self.separated(self.binding_property, "}")
        else:
            self.name()

    def binding_property(self) -> None:
        if self.eat("..."):
            return self.name()
        plain = self.kind == NAME
        self.property_name()
        if self.eat(":"):
            self.binding()
        elif not plain:
            self.fail()
        if self.eat("="):
            self.assignment()
        return None

    def annotation(self) -> None:
        if self.ts and self.eat(":"):
            self.type()

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expression()
                self.need(")")
                continue
            self.any_name()
            while self.eat("."):
                self.any_name()
            if self.eat("("):
                self.separated(self.argument, ")")

    def parameters(self) -> None:
        self.need("(")
        self.separated(self.parameter, ")")

    def parameter(self) -> None:
        self.decorators()
        if self.ts:
            while self.value in TS_MODIFIERS and self.ahead_kind() == NAME or self.value in TS_MODIFIERS and self.ahead() in ("{", "["):
                self.i += 1
            if self.value == "this" and self.ahead() == ":":
                self.i += 1
                return self.annotation()
        self.eat("...")
        self.binding()
        if self.ts:
            self.eat("?")
        self.annotation()
        if self.eat("="):
            self.assignment()
        return None

    def body(self) -> None:
        """A function's body; without one a TypeScript signature."""
        no_in, self.no_in = self.no_in, False
        if self.ts and self.eat(":"):
            self.return_type()
        if self.ts and self.value != "{":
            self.no_in = no_in
            return self.end_of_statement()
        self.functions += 1
        self.block()
        self.functions -= 1
        self.no_in = no_in
        return None

    def function(self, named: bool) -> None:
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.value != "(" and self.value != "<":
            if self.value not in ("await", "yield"):
                self.name()
            else:
                self.i += 1
        elif named:
            self.fail("instead of the function's name")
        self.type_parameters()
        self.parameters()
        self.body()

    def klass(self, named: bool) -> None:
        self.need("class")
        if self.kind == NAME and self.value not in ("extends", "implements"):
            self.name()
        elif named:
            self.fail("instead of the class's name")
        self.type_parameters()
        if self.eat("extends"):
            self.unary()
            if self.ts and self.value == "<":
                self.type_arguments()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        self.decorators()
        if self.value == "static" and self.ahead() == "{":
            self.i += 1
            self.functions += 1
            self.block()
            self.functions -= 1
            return None
        words = TS_MODIFIERS if self.ts else ("static", "async", "accessor")
        while (self.value in words or self.value in ("get", "set")) and self.ahead() not in ("(", "=", ";", "}", ":", "?", "!", "<") and not (self.tokens[self.i + 1][3] and not self.ts):
            self.i += 1
        self.eat("*")
        if self.ts and self.value == "[" and self.ahead_kind() == NAME and self.ahead(2) == ":":
            self.i += 2
            self.need(":")
            self.type()
            self.need("]")
            self.annotation()
            return self.end_of_statement()
        self.property_name()
        if self.ts:
            self.eat("?") or self.eat("!")
        self.type_parameters()
        if self.value == "(":
            self.parameters()
            return self.body()
        self.annotation()
        if self.eat("="):
            self.assignment()
        return self.end_of_statement()

    def property_name(self) -> None:
        if self.kind in (STRING, NUMBER):
            self.i += 1
        elif self.eat("["):
            self.assignment()
            self.need("]")
        else:
            self.any_name()

    def text(self) -> None:
        if self.kind != STRING:
            self.fail("instead of a module's name")
        self.i += 1
        if self.value in ("with", "assert") and self.ahead() == "{" and not self.fresh:
            self.i += 1
            self.primary()

    def import_statement(self) -> None:
        self.i += 1
        if self.kind == STRING:
            self.text()
            return self.end_of_statement()
        if self.ts and self.value == "type" and self.ahead() != "from" and (self.ahead_kind() == NAME or self.ahead() in ("{", "*")):
            self.i += 1
        more = True
        if self.kind == NAME:
            self.name()
            if self.ts and self.eat("="):
                self.assignment()
                return self.end_of_statement()
            more = self.eat(",")
        if more:
            if self.eat("*"):
                self.need("as")
                self.name()
            else:
                self.need("{")
                self.separated(self.specifier, "}")
        self.need("from")
        self.text()
        return self.end_of_statement()

    def specifier(self) -> None:
        if self.ts and self.value == "type" and self.ahead_kind() in (NAME, STRING) and self.ahead() != "as":
            self.i += 1
        for _ in range(2):
            if self.kind == STRING:
                self.i += 1
            else:
                self.any_name()
            if not self.eat("as"):
                break

    def export_statement(self) -> None:
        self.i += 1
        v, n = self.value, self.ahead()
        if self.eat("default"):
            v, n = self.value, self.ahead()
            if v == "function" or (v == "async" and n == "function"):
                return self.function(False)
            if v in ("class", "@"):
                self.decorators()
                return self.klass(False)
            if self.ts and v == "abstract" and n == "class":
                self.i += 1
                return self.klass(False)
            if self.ts and v == "interface":
                return self.statement()
            self.assignment()
            return self.end_of_statement()
        if self.eat("*"):
            if self.eat("as"):
                self.any_name()
            self.need("from")
            self.text()
            return self.end_of_statement()
        if self.ts and v == "type" and n in ("{", "*"):
            self.i += 1
            if self.eat("*"):
                self.need("from")
                self.text()
                return self.end_of_statement()
            v = "{"
        if v == "{":
            self.need("{")
            self.separated(self.specifier, "}")
            if self.eat("from"):
                self.text()
            return self.end_of_statement()
        if self.ts and v == "=":
            self.i += 1
            self.expression()
            return self.end_of_statement()
        words = ("var", "let", "const", "function", "async", "class", "@")
        if v in words or (self.ts and v in ("interface", "type", "enum", "abstract", "declare", "namespace", "module", "import")):
            if v == "async" and n != "function":
                self.fail()
            return self.statement(top=True)
        return self.fail("cannot be exported")

    # Expressions

    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def argument(self) -> None:
        self.eat("...")
        self.assignment()

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        at = self.i
        if self.value == "async" and not self.tokens[self.i + 1][3] and (self.ahead_kind() == NAME and self.ahead(2) == "=>" or self.ahead() in ("(", "<")):
            self.i += 1
        if self.kind == NAME and self.ahead() == "=>":
            self.name()
        elif self.value == "(" or (self.ts and self.value == "<"):
            if self.value == "<" and not (self.attempt(self.type_parameters) and self.value == "("):
                self.i = at
                return False
            close = self.match[self.i]
            follows = self.tokens[close + 1][1]
            if follows == "=>" or (self.ts and follows == ":"):

                def head() -> None:
                    self.parameters()
                    if self.ts and self.eat(":"):
                        self.return_type()
                    if self.value != "=>" or self.fresh:
                        self.fail()

                if follows == "=>":
                    head()
                elif not self.attempt(head):
                    self.i = at
                    return False
            else:
                self.i = at
                return False
        else:
            self.i = at
            return False
        self.need("=>")
        if self.value == "{":
            no_in, self.no_in = self.no_in, False
            self.functions += 1
            self.block()
            self.functions -= 1
            self.no_in = no_in
        else:
            self.assignment()
        return True

    def assignment(self) -> None:
        if self.value == "yield" and self.functions:
            self.i += 1
            if self.value in (")", "]", "}", ",", ";", ":") or self.kind == END or self.fresh:
                return None
            self.eat("*")
            return self.assignment()
        if self.arrow():
            return None
        target = self.unary()
        v = self.value
        if v in JS_ASSIGN:
            if not target:
                self.fail("behind what cannot be assigned")
            self.i += 1
            return self.assignment()
        while True:
            v = self.value
            if v == ">":
                n = 1
                while self.ahead(n) in (">", "=", "==", "===") and self.tokens[self.i + n][4]:
                    n += 1
                    if self.ahead(n - 1) != ">":
                        break
                assigns = n > 2 and self.ahead(n - 1) == "="
                self.i += n
                if assigns:
                    return self.assignment()
                self.unary()
            elif v in JS_BINARY or (v == "in" and not self.no_in):
                self.i += 1
                self.unary()
            elif self.ts and v in ("as", "satisfies") and not self.fresh:
                self.i += 1
                if not self.eat("const"):
                    self.type()
                if self.value in JS_ASSIGN:
                    self.i += 1
                    return self.assignment()
            else:
                break
        if self.value == "?":
            self.i += 1
            no_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = no_in
            self.need(":")
            self.assignment()
        return None

    def unary(self) -> bool:
        """Whether what was read can be assigned to."""
        v = self.value
        if v in ("!", "~", "+", "-", "++", "--") or v in ("typeof", "void", "delete", "await") and self.kind == NAME:
            self.i += 1
            self.unary()
            return False
        if self.ts and v == "<":
            self.type_arguments()
            self.unary()
            return False
        return self.postfix()

    def postfix(self) -> bool:
        if self.value == "new":
            target = self.new()
        else:
            target = self.primary()
        while True:
            v = self.value
            if v in (".", "?."):
                self.i += 1
                if v == "?." and self.value in ("(", "["):
                    continue
                self.any_name()
                target = v == "."
            elif v == "(":
                self.i += 1
                no_in, self.no_in = self.no_in, False
                self.separated(self.argument, ")")
                self.no_in = no_in
                target = False
            elif v == "[":
                self.i += 1
                no_in, self.no_in = self.no_in, False
                self.expression()
                self.need("]")
                self.no_in = no_in
                target = True
            elif self.kind == TEMPLATE:
                self.template()
                target = False
            elif self.ts and v == "!" and not self.fresh and self.ahead() not in ("=", "=="):
                self.i += 1
            elif self.ts and v == "<" and self.attempt(self.call_type_arguments):
                target = False
            elif v in ("++", "--") and not self.fresh:
                if not target:
                    self.fail("behind what cannot be assigned")
                self.i += 1
                return False
            else:
                return target

    def call_type_arguments(self) -> None:
        self.type_arguments()
        if self.value != "(" and self.kind != TEMPLATE and self.value not in (")", ",", ";"):
            self.fail()

    def new(self) -> bool:
        self.need("new")
        if self.eat("."):
            self.any_name()
            return False
        if self.value == "new":
            self.new()
        else:
            self.primary()
        while True:
            if self.eat("."):
                self.any_name()
            elif self.eat("["):
                self.expression()
                self.need("]")
            else:
                break
        if self.ts and self.value == "<":
            self.attempt(self.type_arguments)
        if self.eat("("):
            no_in, self.no_in = self.no_in, False
            self.separated(self.argument, ")")
            self.no_in = no_in
        return False

    def template(self) -> None:
        for tokens, match in self.tokens[self.i][1]:
            inner = JavaScript(tokens, match, self.ts, self.functions)
            inner.expression()
            if inner.kind != END:
                inner.fail()
        self.i += 1

    def primary(self) -> bool:
        kind, v = self.kind, self.value
        if kind in (NUMBER, STRING, REGEX):
            self.i += 1
            return False
        if kind == TEMPLATE:
            self.template()
            return False
        if kind == NAME:
            if v in ("this", "null", "true", "false", "super"):
                self.i += 1
                return False
            if v == "function" or (v == "async" and self.ahead() == "function" and not self.tokens[self.i + 1][3]):
                self.function(False)
                return False
            if v == "class":
                self.klass(False)
                return False
            if v == "import":
                self.i += 1
                if self.eat("."):
                    self.any_name()
                else:
                    self.need("(")
                    self.separated(self.argument, ")")
                return False
            self.name()
            return True
        no_in, self.no_in = self.no_in, False
        if v == "(":
            self.i += 1
            self.expression()
            self.need(")")
            self.no_in = no_in
            return True
        if v == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.argument()
                if self.value != "]":
                    self.need(",")
            self.no_in = no_in
            return True
        if v == "{":
            self.i += 1
            self.separated(self.property, "}")
            self.no_in = no_in
            return True
        if v == "#":
            self.any_name()
            self.no_in = no_in
            return False
        return self.fail("where a value is due")

    def property(self) -> None:
        if self.eat("..."):
            return self.assignment()
        while self.value in ("async", "get", "set") and self.ahead() not in ("(", ":", ",", "}", "="):
            self.i += 1
        star = self.eat("*")
        plain = self.kind == NAME and self.value not in JS_RESERVED
        self.property_name()
        if self.value in ("(", "<"):
            self.type_parameters()
            self.parameters()
            return self.body()
        if self.eat(":"):
            return self.assignment()
        if star or not plain:
            self.fail()
        if self.eat("="):
            self.assignment()
        return None

    # Types

    def type_parameters(self) -> None:
        if not (self.ts and self.eat("<")):
            return
        while True:
            while self.value in ("const", "in", "out") and self.ahead_kind() == NAME:
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
            if self.value == ">":
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.need(">")

    def return_type(self) -> None:
        if self.value == "asserts" and self.ahead_kind() == NAME and not self.tokens[self.i + 1][3]:
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if self.kind == NAME and self.ahead() == "is":
            self.i += 2
        self.type()

    def type(self) -> None:
        self.union()
        if self.value == "extends" and not self.fresh:
            self.i += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        self.eat("|") or self.eat("&")
        self.type_operand()
        while self.eat("|", "&"):
            self.type_operand()

    def type_operand(self) -> None:
        v, k = self.value, self.kind
        if v in ("keyof", "readonly", "unique", "infer") and (self.ahead_kind() == NAME or self.ahead() in ("(", "[", "{")):
            self.i += 1
            return self.type_operand()
        if v == "new" or (v == "abstract" and self.ahead() == "new"):
            self.eat("abstract")
            self.i += 1
            self.type_parameters()
            self.parameters()
            self.need("=>")
            return self.return_type()
        if v == "<":
            self.type_parameters()
            self.parameters()
            self.need("=>")
            return self.return_type()
        if v == "(":
            if self.tokens[self.match[self.i] + 1][1] == "=>":
                self.parameters()
                self.need("=>")
                return self.return_type()
            self.i += 1
            self.type()
            self.need(")")
        elif v == "{":
            self.object_type()
        elif v == "[":
            self.i += 1
            self.separated(self.tuple_member, "]")
        elif k in (STRING, NUMBER):
            self.i += 1
        elif k == TEMPLATE:
            for tokens, match in self.tokens[self.i][1]:
                inner = JavaScript(tokens, match, True)
                inner.type()
            self.i += 1
        elif v == "-" and self.ahead_kind() == NUMBER:
            self.i += 2
        elif v == "typeof":
            self.i += 1
            if self.value == "import":
                return self.type_operand()
            self.any_name()
            while self.eat("."):
                self.any_name()
            if self.value == "<" and not self.fresh:
                self.attempt(self.type_arguments)
        elif v == "import":
            self.i += 1
            self.need("(")
            self.type()
            self.need(")")
            while self.eat("."):
                self.any_name()
            if self.value == "<":
                self.type_arguments()
        elif k == NAME and (v in ("void", "null", "this", "true", "false") or v not in JS_RESERVED):
            self.i += 1
            while self.eat("."):
                self.any_name()
            if self.value == "<" and not self.fresh:
                self.type_arguments()
        else:
            self.fail("where a type is due")
        while self.value == "[" and not self.fresh:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")
        return None

    def tuple_member(self) -> None:
        self.eat("...")
        if self.kind == NAME and (self.ahead() == ":" or (self.ahead() == "?" and self.ahead(2) == ":")):
            self.i += 1
            self.eat("?")
            self.need(":")
        self.type()
        self.eat("?")

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",")) and self.value != "}" and not self.fresh:
                self.fail("instead of the next member")

    def type_member(self) -> None:
        if self.value in ("+", "-"):
            self.i += 1
        while self.value in ("readonly", "get", "set") and self.ahead() not in (":", "?", "(", ";", ",", "}", "<"):
            self.i += 1
        if self.value == "new" and self.ahead() in ("(", "<"):
            self.i += 1
        if self.value not in ("(", "<"):
            if self.value == "[" and self.ahead_kind() == NAME and self.ahead(2) in (":", "in"):
                self.i += 3
                self.type()
                if self.eat("as"):
                    self.type()
                self.need("]")
            else:
                self.property_name()
            if self.value in ("+", "-"):
                self.i += 1
            self.eat("?")
        if self.value in ("(", "<"):
            self.type_parameters()
            self.parameters()
        if self.eat(":"):
            self.return_type()


JAVA_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
JAVA_PRIMITIVES = frozenset("boolean byte char short int long float double".split())
JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
JAVA_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
JAVA_BINARY = frozenset("+ - * / % == != < <= && || & | ^ <<".split())


class Java(Parser):
    """A Java compilation unit (Java 17)."""

    def unit(self) -> None:
        at = self.i
        self.modifiers()
        if self.eat("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = at
        while self.value in ("import", ";"):
            if self.eat(";"):
                continue
            self.i += 1
            self.eat("static")
            self.name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.name()
            self.need(";")
        while self.kind != END:
            if not self.eat(";"):
                self.modifiers()
                if not self.type_declaration():
                    self.fail("where a type's declaration is due")

    def name(self) -> None:
        if self.kind != NAME or self.value in JAVA_KEYWORDS:
            self.fail("is no name here")
        self.i += 1

    def qualified(self) -> None:
        self.name()
        while self.value == "." and self.ahead_kind() == NAME:
            self.i += 1
            self.name()

    def modifiers(self) -> None:
        while True:
            if self.value == "@" and self.ahead() != "interface":
                self.i += 1
                self.qualified()
                if self.eat("("):
                    self.separated(self.annotation_value, ")", trailing=False)
            elif self.value in JAVA_MODIFIERS and not (self.value in ("default", "sealed") and (self.ahead() in (":", "->", "(", "=", ".", ";", ","))):
                self.i += 1
            elif self.value == "non" and self.ahead() == "-":
                self.i += 3
            else:
                return

    def annotation_value(self) -> None:
        if self.kind == NAME and self.ahead() == "=":
            self.i += 2
        if self.value == "{":
            self.i += 1
            self.separated(self.annotation_value, "}")
        elif self.value == "@":
            self.modifiers()
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        v = self.value
        if v in ("class", "interface"):
            self.i += 1
            self.name()
            self.type_parameters()
            for word in ("extends", "implements", "permits"):
                if self.eat(word):
                    self.type()
                    while self.eat(","):
                        self.type()
            self.class_body()
            return True
        if v == "@" and self.ahead() == "interface":
            self.i += 2
            self.name()
            self.class_body()
            return True
        if v == "enum":
            self.i += 1
            self.name()
            if self.eat("implements"):
                self.type()
                while self.eat(","):
                    self.type()
            self.need("{")
            while self.kind == NAME or self.value == "@":
                self.modifiers()
                self.name()
                if self.eat("("):
                    self.separated(self.expression, ")", trailing=False)
                if self.value == "{":
                    self.class_body()
                if not self.eat(","):
                    break
            if self.eat(";"):
                while self.value != "}":
                    self.member()
            self.need("}")
            return True
        if v == "record" and self.ahead_kind() == NAME and self.ahead(2) in ("(", "<"):
            self.i += 1
            self.name()
            self.type_parameters()
            self.parameters()
            if self.eat("implements"):
                self.type()
                while self.eat(","):
                    self.type()
            self.class_body()
            return True
        return False

    def class_body(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.value == "{" or (self.value == "static" and self.ahead() == "{"):
            self.eat("static")
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if self.kind == NAME and self.ahead() in ("(", "{") and self.value not in JAVA_KEYWORDS:
            self.i += 1
            if self.value == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        if not self.eat("void"):
            self.type()
        self.name()
        if self.value == "(":
            self.parameters()
            self.dimensions()
            self.throws()
            if self.eat("default"):
                self.annotation_value()
            if not self.eat(";"):
                self.block()
            return
        self.declarator_rest()
        while self.eat(","):
            self.name()
            self.declarator_rest()
        self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.type()
            while self.eat(","):
                self.type()

    def dimensions(self) -> None:
        while self.value == "[" and self.ahead() == "]":
            self.i += 2

    def declarator_rest(self) -> None:
        self.dimensions()
        if self.eat("="):
            self.initializer()

    def initializer(self) -> None:
        if self.eat("{"):
            self.separated(self.initializer, "}")
        else:
            self.expression()

    def parameters(self) -> None:
        self.need("(")
        self.separated(self.parameter, ")", trailing=False)

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.eat("...")
        if not self.eat("this"):
            self.name()
        self.dimensions()

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                self.modifiers()
                self.name()
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def type(self) -> None:
        self.modifiers()
        if self.value in JAVA_PRIMITIVES:
            self.i += 1
        elif self.eat("?"):
            if self.eat("extends", "super"):
                self.type()
            return
        else:
            self.name()
            self.type_arguments()
            while self.value == "." and self.ahead_kind() == NAME and self.ahead() not in JAVA_KEYWORDS:
                self.i += 1
                self.name()
                self.type_arguments()
        self.dimensions()

    def type_arguments(self) -> None:
        if self.value == "<":
            self.i += 1
            if self.eat(">"):
                return
            self.type()
            while self.eat(","):
                self.type()
            self.need(">")

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def local_head(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        if self.value not in ("=", ";", ",", ":", "["):
            self.fail()

    def parenthesised(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        v = self.value
        if v == "{":
            return self.block()
        if self.eat(";"):
            return None
        if v == "if":
            self.i += 1
            self.parenthesised()
            self.statement()
            if self.eat("else"):
                self.statement()
            return None
        if v == "while":
            self.i += 1
            self.parenthesised()
            return self.statement()
        if v == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.parenthesised()
            return self.need(";")
        if v == "for":
            self.i += 1
            self.need("(")
            if self.attempt(self.local_head):
                if self.eat(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarator_rest()
                while self.eat(","):
                    self.name()
                    self.declarator_rest()
            elif self.value != ";":
                self.expressions()
            self.need(";")
            if self.value != ";":
                self.expression()
            self.need(";")
            if self.value != ")":
                self.expressions()
            self.need(")")
            return self.statement()
        if v in ("return", "throw", "break", "continue", "assert"):
            self.i += 1
            if v in ("throw", "assert") or self.value != ";":
                self.expression()
            if v == "assert" and self.eat(":"):
                self.expression()
            return self.need(";")
        if v == "yield" and self.ahead() not in ("=", ".", "(", "++", "--"):
            self.i += 1
            self.expression()
            return self.need(";")
        if v == "synchronized" and self.ahead() == "(":
            self.i += 1
            self.parenthesised()
            return self.block()
        if v == "switch":
            self.switch()
            return None
        if v == "try":
            self.i += 1
            done = False
            if self.eat("("):
                done = True
                while not self.eat(")"):
                    if self.attempt(self.local_head):
                        self.declarator_rest()
                    else:
                        self.expression()
                    if not self.eat(";") and self.value != ")":
                        self.fail()
            self.block()
            while self.eat("catch"):
                done = True
                self.need("(")
                self.modifiers()
                self.type()
                while self.eat("|"):
                    self.type()
                self.name()
                self.need(")")
                self.block()
            if self.eat("finally"):
                done = True
                self.block()
            if not done:
                self.fail("instead of catch")
            return None
        if v in ("class", "interface", "enum", "abstract", "final", "static", "@", "record"):
            at = self.i
            self.modifiers()
            if self.type_declaration():
                return None
            self.i = at
        if self.kind == NAME and self.ahead() == ":" and v not in JAVA_KEYWORDS:
            self.i += 2
            return self.statement()
        if (self.kind == NAME or v == "@") and self.attempt(self.local_head):
            self.declarator_rest()
            while self.eat(","):
                self.name()
                self.declarator_rest()
            return self.need(";")
        if not self.expression():
            self.fail("ends what is no statement")
        return self.need(";")

    def switch(self) -> None:
        self.need("switch")
        self.parenthesised()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.case_label()
                while self.eat(","):
                    self.case_label()
            else:
                self.need("default")
            if self.eat("->"):
                if self.value in ("{", "throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.value not in ("case", "default", "}"):
                    self.statement()

    def case_label(self) -> None:
        if not self.eat("default"):
            self.ternary()

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self) -> bool:
        """Whether the expression can stand as a statement."""
        if self.lambda_head():
            self.lambda_body()
            return False
        kind = self.ternary()
        if self.value in JAVA_ASSIGN:
            if kind != "target":
                self.fail("behind what cannot be assigned")
            self.i += 1
            self.expression()
            return True
        if self.value == ">":
            n = 1
            while self.ahead(n) in (">", "=") and self.tokens[self.i + n][4]:
                n += 1
            self.i += n
            self.expression()
            return True
        return kind == "statement"

    def lambda_head(self) -> bool:
        if self.kind == NAME and self.ahead() == "->" and self.value not in JAVA_KEYWORDS:
            self.i += 2
            return True
        if self.value == "(" and self.tokens[self.match[self.i] + 1][1] == "->":
            if not self.attempt(self.parameters):
                self.need("(")
                self.separated(self.name, ")", trailing=False)
            self.need("->")
            return True
        return False

    def lambda_body(self) -> None:
        if self.value == "{":
            self.block()
        else:
            self.expression()

    def ternary(self) -> str:
        kind = self.unary()
        while True:
            v = self.value
            if v in JAVA_BINARY:
                self.i += 1
                self.unary()
                kind = "value"
            elif v == ">":
                n = 1
                while self.ahead(n) in (">", "=") and self.tokens[self.i + n][4]:
                    n += 1
                if n > 2 and self.ahead(n - 1) == "=":
                    return kind
                self.i += n
                self.unary()
                kind = "value"
            elif v == "instanceof":
                self.i += 1
                self.eat("final")
                self.type()
                if self.kind == NAME and self.value not in JAVA_KEYWORDS:
                    self.i += 1
                kind = "value"
            else:
                break
        if self.eat("?"):
            if not self.lambda_or(self.ternary):
                pass
            self.need(":")
            self.lambda_or(self.ternary)
            kind = "value"
        return kind

    def lambda_or(self, step) -> bool:
        if self.lambda_head():
            self.lambda_body()
            return True
        step()
        if self.value in JAVA_ASSIGN:
            self.i += 1
            self.expression()
        return False

    def cast(self) -> None:
        self.need("(")
        primitive = self.value in JAVA_PRIMITIVES
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")")
        if self.lambda_head():
            return self.lambda_body()
        if not primitive or self.tokens[self.i - 2][1] == "]":
            if not (self.kind in (NUMBER, STRING) or self.value in ("(", "!", "~", "new", "this", "super", "true", "false", "null", "switch") or (self.kind == NAME and self.value not in JAVA_KEYWORDS) or self.value in JAVA_PRIMITIVES):
                self.fail()
        self.unary()
        return None

    def unary(self) -> str:
        v = self.value
        if v in ("++", "--"):
            self.i += 1
            self.unary()
            return "statement"
        if v in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if v == "(" and self.attempt(self.cast):
            return "value"
        return self.postfix()

    def postfix(self) -> str:
        kind = self.primary()
        while True:
            v = self.value
            if v == ".":
                self.i += 1
                if self.value == "<":
                    self.type_arguments()
                if self.value in ("class", "this", "super"):
                    self.i += 1
                    kind = "value"
                elif self.value == "new":
                    kind = self.new()
                else:
                    self.name()
                    kind = "target"
            elif v == "(":
                if self.tokens[self.i - 1][0] != NAME:
                    self.fail()
                self.i += 1
                self.separated(self.expression, ")", trailing=False)
                kind = "statement"
            elif v == "[":
                self.i += 1
                if self.eat("]"):
                    self.dimensions()
                    if self.value != "::":
                        self.need(".")
                        self.need("class")
                    kind = "value"
                else:
                    self.expression()
                    self.need("]")
                    kind = "target"
            elif v == "<" and self.attempt(self.method_reference):
                kind = "value"
            elif v == "::":
                self.i += 1
                if self.value == "<":
                    self.type_arguments()
                if not self.eat("new"):
                    self.name()
                kind = "value"
            elif v in ("++", "--"):
                self.i += 1
                kind = "statement"
            else:
                return kind

    def method_reference(self) -> None:
        self.type_arguments()
        self.dimensions()
        if self.value != "::":
            self.fail()

    def primary(self) -> str:
        v = self.value
        if self.kind in (NUMBER, STRING):
            self.i += 1
            return "value"
        if v in ("true", "false", "null"):
            self.i += 1
            return "value"
        if v in ("this", "super"):
            self.i += 1
            return "value"
        if v == "new":
            return self.new()
        if v == "switch":
            self.switch()
            return "value"
        if v in JAVA_PRIMITIVES or v == "void":
            if v == "void":
                self.i += 1
            else:
                self.type()
            if self.value == "::":
                return "value"
            self.need(".")
            self.need("class")
            return "value"
        if v == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return "target"
        self.name()
        return "target"

    def new(self) -> str:
        self.need("new")
        self.modifiers()
        if self.value in JAVA_PRIMITIVES:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.eat("."):
                self.name()
                self.type_arguments()
        if self.value == "[":
            sized = False
            while self.eat("["):
                if not self.eat("]"):
                    self.expression()
                    self.need("]")
                    sized = True
            if self.value == "{" and not sized:
                self.initializer()
            return "value"
        self.need("(")
        self.separated(self.expression, ")", trailing=False)
        if self.value == "{":
            self.class_body()
        return "statement"


GO_ASSIGN = frozenset(":= = += -= *= /= %= &= |= ^= <<= >>= &^=".split())
GO_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())


class Go(Parser):
    """A Go source file."""

    no_literal = False

    def file(self) -> None:
        self.need("package")
        self.name()
        self.end()
        while self.value == "import":
            self.i += 1
            self.grouped(self.import_spec)
            self.end()
        while self.kind != END:
            v = self.value
            if v == "func":
                self.i += 1
                if self.value == "(":
                    self.parameters()
                self.name()
                if self.value == "[":
                    self.type_parameters()
                self.signature()
                if self.value == "{":
                    self.block()
            elif v in ("var", "const", "type"):
                self.declaration()
            else:
                self.fail("where a declaration is due")
            self.end()

    def end(self) -> None:
        if not self.eat(";") and self.value not in (")", "}") and self.kind != END:
            self.fail("does not end the statement")

    def name(self) -> None:
        if self.kind != NAME or self.value in GO_KEYWORDS:
            self.fail("is no name here")
        self.i += 1

    def grouped(self, step) -> None:
        if self.eat("("):
            while not self.eat(")"):
                step()
                self.end()
        else:
            step()

    def import_spec(self) -> None:
        if self.kind == NAME or self.value == ".":
            self.i += 1
        if self.kind != STRING:
            self.fail("instead of a path")
        self.i += 1

    def declaration(self) -> None:
        v = self.value
        self.i += 1
        self.grouped({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[v])

    def names(self) -> None:
        self.name()
        while self.eat(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if self.value != "=":
            self.type()
        if self.eat("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.value not in ("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.value == "[" and self.ahead_kind() == NAME and self.ahead(2) != "]":
            self.attempt(self.type_parameters)
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.names()
            self.constraint()
            if not self.eat(","):
                self.need("]")
                return

    def constraint(self) -> None:
        self.eat("~")
        self.type()
        while self.eat("|"):
            self.eat("~")
            self.type()

    def signature(self) -> None:
        self.parameters()
        if self.value == "(":
            self.parameters()
        elif self.kind == NAME and self.value not in GO_KEYWORDS or self.value in ("*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        self.separated(self.parameter, ")")

    def parameter(self) -> None:
        if self.eat("..."):
            return self.type()
        self.type()
        if self.value not in (",", ")"):
            self.eat("...")
            self.type()
        return None

    def type(self) -> None:
        v = self.value
        if v == "*":
            self.i += 1
            self.type()
        elif v == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif v == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    self.expression()
                self.need("]")
            self.type()
        elif v == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif v == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif v == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif v == "func":
            self.i += 1
            self.signature()
        elif v == "struct":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if self.value == "*" or (self.kind == NAME and self.ahead() in (";", "}", ".") or self.kind == NAME and self.ahead_kind() == STRING):
                    self.type()
                else:
                    self.names()
                    self.type()
                if self.kind == STRING:
                    self.i += 1
                self.end()
        elif v == "interface":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if self.kind == NAME and self.ahead() == "(":
                    self.name()
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.name()
            if self.value == "." and self.ahead_kind() == NAME:
                self.i += 1
                self.name()
            if self.value == "[" and self.ahead() != "]":
                self.attempt(self.type_arguments)

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.eat(","):
            self.type()
        self.need("]")

    def block(self) -> None:
        held, self.no_literal = self.no_literal, False
        self.need("{")
        while not self.eat("}"):
            self.statement()
            self.end()
        self.no_literal = held

    def simple(self) -> None:
        """An expression statement, send, assignment, declaration or increment."""
        if self.eat("range"):
            self.expression()
            return
        self.expressions()
        if self.value in GO_ASSIGN:
            self.i += 1
            if self.eat("range"):
                self.expression()
            else:
                self.expressions()
        elif self.value in ("++", "--"):
            self.i += 1
        elif self.eat("<-"):
            self.expression()

    def header(self) -> None:
        """What stands between a control word and its block."""
        held, self.no_literal = self.no_literal, True
        if self.value not in ("{", ";"):
            self.simple()
        while self.eat(";"):
            if self.value not in ("{", ";"):
                self.simple()
        self.no_literal = held

    def statement(self) -> None:
        v = self.value
        if v in ("var", "const", "type"):
            return self.declaration()
        if v == "{":
            return self.block()
        if v in (";", "}"):
            return None
        if v == "if":
            self.i += 1
            if self.value == "{":
                self.fail("instead of a condition")
            self.header()
            self.block()
            if self.eat("else"):
                if self.value not in ("if", "{"):
                    self.fail()
                self.statement()
            return None
        if v == "for":
            self.i += 1
            self.header()
            return self.block()
        if v == "switch":
            self.i += 1
            self.header()
            self.need("{")
            return self.cases(self.case_expressions)
        if v == "select":
            self.i += 1
            self.need("{")
            return self.cases(self.simple)
        if v in ("go", "defer"):
            self.i += 1
            return self.expression()
        if v == "return":
            self.i += 1
            if self.value not in (";", "}"):
                self.expressions()
            return None
        if v in ("break", "continue", "goto"):
            self.i += 1
            if self.kind == NAME:
                self.name()
            return None
        if v == "fallthrough":
            self.i += 1
            return None
        if self.kind == NAME and self.ahead() == ":" and v not in GO_KEYWORDS:
            self.i += 2
            if self.value != "}":
                self.statement()
            return None
        return self.simple()

    def cases(self, label) -> None:
        held, self.no_literal = self.no_literal, False
        while not self.eat("}"):
            if self.eat("case"):
                label()
            else:
                self.need("default")
            self.need(":")
            while self.value not in ("case", "default", "}"):
                self.statement()
                self.end()
        self.no_literal = held

    def case_expressions(self) -> None:
        self.type_or_expression()
        while self.eat(","):
            self.type_or_expression()

    def type_or_expression(self) -> None:
        if not self.attempt(self.whole, self.expression):
            self.whole(self.type)

    def whole(self, step) -> None:
        step()
        if self.value not in (",", ":", ")"):
            self.fail()

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.value in GO_BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.eat("+", "-", "!", "^", "*", "&", "<-"):
            pass
        self.postfix()

    def postfix(self) -> None:
        v, typed, bare = self.value, False, False
        if self.kind in (NUMBER, STRING):
            self.i += 1
        elif v == "(":
            held, self.no_literal = self.no_literal, False
            self.i += 1
            if not self.attempt(self.closed):
                self.type()
                self.need(")")
            self.no_literal = held
        elif v == "func":
            self.i += 1
            self.signature()
            if self.value == "{":
                self.block()
            else:
                typed = True
        elif v in ("[", "map", "struct", "chan", "interface"):
            self.type()
            typed = True
        else:
            self.name()
            bare = True
        if typed and self.value not in ("{", "("):
            self.fail("behind a type")
        while True:
            v = self.value
            if v == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    bare = False
                else:
                    self.name()
            elif v == "(":
                self.i += 1
                held, self.no_literal = self.no_literal, False
                self.separated(self.argument, ")")
                self.no_literal = held
                bare = typed = False
            elif v == "[":
                self.index()
            elif v == "{" and (typed or (bare and not self.no_literal)):
                self.i += 1
                held, self.no_literal = self.no_literal, False
                self.separated(self.element, "}")
                self.no_literal = held
                bare = typed = False
            else:
                return

    def closed(self) -> None:
        self.expression()
        self.need(")")

    def index(self) -> None:
        self.need("[")
        held, self.no_literal = self.no_literal, False
        seen = False
        while not self.eat("]"):
            if self.eat(":", ","):
                continue
            if not self.attempt(self.indexed):
                self.type()
            seen = True
            if self.value not in (":", ",", "]"):
                self.fail()
        if not seen and self.tokens[self.i - 2][1] == "[":
            self.i -= 1
            self.fail("where an index is due")
        self.no_literal = held

    def indexed(self) -> None:
        self.expression()
        if self.value not in (":", ",", "]"):
            self.fail()

    def argument(self) -> None:
        if not self.attempt(self.argument_value):
            self.type()
        self.eat("...")

    def argument_value(self) -> None:
        self.expression()
        if self.value not in (",", ")", "..."):
            self.fail()

    def element(self) -> None:
        self.element_value()
        if self.eat(":"):
            self.element_value()

    def element_value(self) -> None:
        if self.eat("{"):
            self.separated(self.element, "}")
        else:
            self.expression()


def check(text: str, language: str) -> None:
    """Raise ``Broken`` if the text is not valid ``js``, ``ts``, ``java`` or ``go``."""
    lexer = Lexer(text, "js" if language == "ts" else language)
    lexer.run()
    if language in ("js", "ts"):
        JavaScript(lexer.tokens, lexer.match, language == "ts").module()
    elif language == "java":
        Java(lexer.tokens, lexer.match).unit()
    else:
        Go(lexer.tokens, lexer.match).file()
