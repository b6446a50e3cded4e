"""Lexers of five languages and the pushdown stack over their delimiters.

A lexer turns a source text into tokens ``(kind, value, line, newline before, touches the one before, offset)``
and reports the first thing that cannot be one: an unterminated literal or comment, a merge-conflict
marker, a character or number that the language does not have. The stack then pairs the delimiters.
"""

from __future__ import annotations

import re

#: Kinds of tokens: name or keyword, number, string, regular expression, template, punctuation, end.
NAME, NUMBER, STRING, REGEX, TEMPLATE, PUNCT, END = "name", "number", "string", "regex", "template", "punct", "end"


class Broken(Exception):
    """A text that is not valid; ``kind`` says in which way, ``line`` (from 1) where."""

    def __init__(self, kind: str, line: int, message: str) -> None:
        super().__init__(f"{kind} at line {line}: {message}")
        self.kind, self.line, self.message = kind, line, message


CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?:[ \t].*)?$|={7}[ \t\r]*$", re.M)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_OPENS, _CLOSES = frozenset("([{"), frozenset(")]}")

_BLANK = r" \t\r\f\v\x1c-\x1f\x85\xa0  -     　﻿"
_SPACE = rf"[{_BLANK}]*"
_DOUBLE = r'"(?:\\(?:\r\n|[\s\S])|[^"\\\n])*"'
_SINGLE = r"'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'"
_JS_NUMBER = r"0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?n?"
_JAVA_NUMBER = r"0[xX](?:[\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?\d+[fFdD]?|[\da-fA-F_]+[lL]?)|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.(?:[\d_]+)?)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?"
_GO_NUMBER = r"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[oO][0-7_]+i?|0[bB][01_]+i?|(?:\d[\d_]*(?:\.(?:[\d_]+)?)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?"
_JS_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]"
_JAVA_OPS = r"\.\.\.|->|::|==|!=|<=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
_GO_OPS = r"\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!=:.~]"


_BLANKS, _NOT_BLANK = re.compile(_SPACE), re.compile(rf"[^{_BLANK}]")


def _table(number: str, ops: str, *literals: str) -> re.Pattern:
    text = "|".join(f"(?P<string{i}>{x})" for i, x in enumerate(literals))
    return re.compile(
        rf"{_SPACE}(?:(?P<name>[^\W\d][\w$]*|\$[\w$]*|\\u[\da-fA-F]{{4}}[\w$]*)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<number>(?:{number}))|{text}|(?P<op>{ops}))"
    )


_TABLES = {
    "js": _table(_JS_NUMBER, _JS_OPS, _DOUBLE, _SINGLE),
    "java": _table(_JAVA_NUMBER, _JAVA_OPS, r'"""[ \t\f]*\r?\n(?:\\[\s\S]|(?!""")[\s\S])*"""', r'"(?!"")(?:\\.|[^"\\\r\n])*"|""(?!")', r"'(?:\\(?:[btnfrs0\"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4})|[^'\\\r\n]{1,2})'"),
    "go": _table(_GO_NUMBER, _GO_OPS, r'"(?:\\.|[^"\\\n])*"', r"`[^`]*`", r"'(?:\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8})|[^'\\\n])'"),
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-zA-Z]*")
#: Words behind which an operand is due, so that a slash begins a regular expression.
_OPERAND_DUE = frozenset("return typeof instanceof in of new delete void throw case do else await yield default extends".split())


class Lexer:
    """Tokens of one text; ``match`` gives the index of each opening delimiter's partner."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language, self.table = text, language, _TABLES[language]
        self.tokens: list[tuple] = []
        self.match: dict[int, int] = {}
        self.line, self.pos = 1, 0
        self.end = next((k + 1 for k in range(len(text) - 1, -1, -1) if _NOT_BLANK.match(text[k])), 0)
        self.conflict = CONFLICT.search(text) is not None

    def run(self) -> None:
        text = self.text
        if self.language == "js" and text.startswith("#!"):
            self.pos = len(text.split("\n", 1)[0])
        self._run(None)
        self.tokens.append((END, "", self.line, True, False, self.pos))

    def _fail(self, kind: str, message: str) -> None:
        raise Broken(kind, self.line, message)

    def _run(self, until: str | None) -> None:
        """Up to the end, or to the brace that ends a template's substitution."""
        text, js, go = self.text, self.language == "js", self.language == "go"
        stack: list[tuple[str, int, int]] = []
        fresh, glued = True, False
        match, tokens, end = self.table.match, self.tokens, self.end
        while self.pos < end:
            at = self.pos
            m = match(text, at)
            if m is None:
                at += len(_BLANKS.match(text, at).group())
                kind, pos = None, at
            else:
                kind = m.lastgroup
                pos = m.start(kind)
            c = text[pos]
            if pos > at:
                glued = False
            if self.conflict and c in "<>|=" and (pos == 0 or text[pos - 1] == "\n") and CONFLICT.match(text, pos):
                self._fail("conflict_marker", text[pos : pos + 40].split("\n")[0])
            if js:
                if c == "`":
                    self.pos = pos
                    self._template(fresh)
                    fresh, glued = False, True
                    continue
                if c == "/" and kind == "op" and not self._operand_before():
                    if not (m := _REGEX.match(text, pos)):
                        self._fail("unterminated_literal", "regular expression")
                    kind = "regex"
            if kind is None:
                if text.startswith("/*", pos):
                    self._fail("unterminated_literal", "comment")
                if c in "\"'`":
                    self._fail("unterminated_literal", "string")
                self._fail("bad_token", repr(c))
            self.pos = m.end()
            if kind == "nl":
                glued = False
                if go and not fresh:
                    self._semicolon()
                self.line += 1
                fresh = True
                continue
            value = m.group() if kind == "regex" else m.group(kind)
            if kind == "op":
                kind = PUNCT
                if value in _OPENS:
                    stack.append((value, len(tokens), self.line))
                elif value in _CLOSES:
                    if not stack:
                        if until == value:
                            self.pos = pos
                            return
                        self._fail("unbalanced_delimiter", f"{value!r} closes nothing")
                    opened, opened_at, line = stack.pop()
                    if _CLOSE[opened] != value:
                        self._fail("unbalanced_delimiter", f"{value!r} does not match {opened!r} of line {line}")
                    self.match[opened_at] = len(tokens)
                elif value == "/" and text.startswith("/*", pos):
                    self._fail("unterminated_literal", "comment")
            elif kind == "name":
                if go and "$" in value:
                    self._fail("bad_token", value)
            elif kind == "line":
                glued = False
                continue
            elif kind == "block":
                glued = False
                if "\n" in value:
                    if go and not fresh:
                        self._semicolon()
                    self.line += value.count("\n")
                    fresh = True
                continue
            elif kind == "number":
                if self.pos < len(text) and (text[self.pos].isalnum() or text[self.pos] in "_$"):
                    self._fail("bad_token", text[pos : self.pos + 10])
            elif kind != "regex":
                kind = STRING
            tokens.append((kind, value, self.line, fresh, glued, pos))
            if kind == STRING and "\n" in value:
                self.line += value.count("\n")
            fresh, glued = False, True
        if go and not fresh:
            self._semicolon()
        if stack:
            raise Broken("premature_end", self.line, f"{stack[-1][0]!r} of line {stack[-1][2]} stays open")
        if until:
            self._fail("premature_end", "template substitution stays open")

    def _operand_before(self) -> bool:
        if not self.tokens:
            return False
        kind, value = self.tokens[-1][:2]
        return kind in (NUMBER, STRING, TEMPLATE, REGEX) or (kind == NAME and value not in _OPERAND_DUE) or value in (")", "]", "}")

    def _semicolon(self) -> None:
        """Go ends a statement at the end of a line whose last token can end one."""
        if self.tokens:
            kind, value = self.tokens[-1][:2]
            if kind in (NUMBER, STRING) or (kind == NAME and (value not in GO_KEYWORDS or value in ("break", "continue", "fallthrough", "return"))) or value in ("++", "--", ")", "]", "}"):
                self.tokens.append((PUNCT, ";", self.line, False, False, self.pos))

    def _template(self, fresh: bool) -> None:
        """A template; its substitutions are lexed into tokens of their own, kept in the token's value."""
        text, line, start = self.text, self.line, self.pos
        self.pos += 1
        parts: list[tuple[list, dict]] = []
        while True:
            if self.pos >= len(text):
                self._fail("unterminated_literal", f"template of line {line}")
            c = text[self.pos]
            if c == "`":
                self.pos += 1
                break
            if c == "\\":
                self.pos += 2
                continue
            if text.startswith("${", self.pos):
                self.pos += 2
                outer = (self.tokens, self.match)
                self.tokens, self.match = [], {}
                self._run("}")
                self.pos += 1
                self.tokens.append((END, "", self.line, True, False, self.pos))
                parts.append((self.tokens, self.match))
                self.tokens, self.match = outer
                continue
            if c == "\n":
                self.line += 1
            self.pos += 1
        self.tokens.append((TEMPLATE, parts, line, fresh, False, start))


GO_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
