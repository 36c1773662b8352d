"""A scanner for TypeScript and JavaScript: tokens, matching brackets, statements.

It knows strings, nested templates, regular expressions, comments and JSX well enough to find the
extent of statements and declarations.  Unterminated or unbalanced input raises ``Broken``; that is
the syntax gate (exotic errors that keep all brackets balanced are not seen).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Broken(ValueError):
    """The text cannot be scanned."""


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex, jsx, mark
    text: str
    start: int
    end: int


_BLANK = re.compile(r"\s+")
_NAME = re.compile(r"#?[^\W\d][\w$‌‍]*|#?\$[\w$]*|#?[^\W\d]?\\u[0-9a-fA-F{}]+[\w$]*")
_NUMBER = re.compile(r"0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
# After one of these a slash or an angle bracket begins an expression.
_BEFORE_EXPRESSION = {"return", "typeof", "case", "do", "else", "in", "of", "instanceof", "new", "void", "delete", "throw", "yield", "await", "default"}
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
CONTINUES = {".", "?.", ",", "?", ":", "=", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "&&", "||", "??", "==", "===", "!=", "!==", "<=", "=>", "(", "[", "**", "+=", "-=", "*=", "/=", "<<", "|=", "&=", "??=", "||=", "&&="}
OPEN_ENDED = CONTINUES - {"(", "["} | {"(", "[", "{", "!", "~", "...", "@"}
_OPERATOR_NAMES = {"in", "of", "instanceof", "as", "satisfies", "extends", "implements", "is"}


class Scan:
    def __init__(self, source: str, jsx: bool):
        self.source, self.jsx = source, jsx
        self.tokens: list[Token] = []
        self.docs: list[tuple[int, int]] = []  # /** */ comments
        self.comments: list[tuple[int, int]] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        end = self._scan(0, None)
        if end != len(source):
            raise Broken("unbalanced bracket")
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in _OPEN:
                stack.append(k)
            elif t.text in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]].text] != t.text:
                    raise Broken("unbalanced bracket")
                self.match[stack.pop()] = k
        if stack:
            raise Broken("unclosed bracket")

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    # --- tokens -----------------------------------------------------------------------------------

    def _scan(self, at: int, closer: str | None) -> int:
        """Scan to the end, or past the ``closer`` that ends an embedded expression."""
        s, n, depth = self.source, len(self.source), 0
        keep = self.tokens if closer is None else []
        previous: Token | None = None
        if closer is None and s.startswith("#!"):
            at = s.find("\n") if "\n" in s else n
        while at < n:
            if blank := _BLANK.match(s, at):
                at = blank.end()
                continue
            if s.startswith("//", at):
                stop = s.find("\n", at)
                stop = n if stop < 0 else stop
                self.comments.append((at, stop))
                at = stop
                continue
            if s.startswith("/*", at):
                stop = s.find("*/", at + 2)
                if stop < 0:
                    raise Broken("unterminated comment")
                self.comments.append((at, stop + 2))
                if s.startswith("/**", at) and stop > at + 2:
                    self.docs.append((at, stop + 2))
                at = stop + 2
                continue
            token = self._token(at, previous)
            if closer is not None and token.kind == "mark":
                if token.text == closer and depth == 0:
                    return token.end
                depth += (token.text in _OPEN) - (token.text in _CLOSE)
                if depth < 0:
                    raise Broken("unbalanced bracket")
            keep.append(token)
            previous, at = token, token.end
        if closer is not None:
            raise Broken("unterminated expression")
        return at

    def _token(self, at: int, previous: Token | None) -> Token:
        s, c = self.source, self.source[at]
        if c in "\"'":
            return Token("string", "", at, self._string(at))
        if c == "`":
            return Token("template", "`", at, self._template(at))
        fresh = previous is None or previous.kind == "mark" and previous.text not in (")", "]", "}", "++", "--") or previous.kind == "name" and previous.text in _BEFORE_EXPRESSION
        if c == "/" and (fresh or previous.text == "}" and self._looks_like_regex(at)):
            return Token("regex", "", at, self._regex(at))
        if c == "<" and self.jsx and fresh and (s[at + 1 : at + 2] == ">" or _JSX_NAME.match(s, at + 1)) and not self._generic_arrow(at):
            return Token("jsx", "", at, self._element(at))
        for kind, pattern in (("number", _NUMBER), ("name", _NAME), ("mark", _MARK)):
            if (kind != "number" or c.isdigit() or c == ".") and (found := pattern.match(s, at)) and found.end() > at:
                return Token(kind, found.group(), at, found.end())
        raise Broken(f"unexpected character {c!r}")

    def _string(self, at: int) -> int:
        found = re.compile(rf"{self.source[at]}(?:\\(?:\r\n|[\s\S])|[^\\\n{self.source[at]}])*{self.source[at]}").match(self.source, at)
        if not found:
            raise Broken("unterminated string")
        return found.end()

    def _template(self, at: int) -> int:
        s, at = self.source, at + 1
        while at < len(s):
            if s[at] == "\\":
                at += 2
            elif s[at] == "`":
                return at + 1
            elif s.startswith("${", at):
                at = self._scan(at + 2, "}")
            else:
                at += 1
        raise Broken("unterminated template")

    def _looks_like_regex(self, at: int) -> bool:
        found = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*\s*(?:[.;,)]|$)").match(self.source, at)
        return found is not None

    def _regex(self, at: int) -> int:
        found = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*").match(self.source, at)
        if not found:
            raise Broken("unterminated regular expression")
        return found.end()

    def _generic_arrow(self, at: int) -> bool:
        """``<T,>(`` and ``<T extends X>(`` are type parameters, not elements."""
        return re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)").match(self.source, at) is not None

    def _element(self, at: int) -> int:
        """Past a JSX element or fragment that begins at ``at``."""
        s, at = self.source, at + 1
        name = _JSX_NAME.match(s, at)
        tag = name.group() if name else ""
        at = name.end() if name else at
        while True:  # attributes
            if blank := _BLANK.match(s, at):
                at = blank.end()
            if at >= len(s):
                raise Broken("unterminated element")
            if s.startswith("/>", at):
                return at + 2
            if s[at] == ">":
                at += 1
                break
            if s[at] == "{":
                at = self._scan(at + 1, "}")
            elif s[at] in "\"'":
                stop = s.find(s[at], at + 1)
                if stop < 0:
                    raise Broken("unterminated attribute")
                at = stop + 1
            else:
                at += 1
        while at < len(s):  # children
            if s[at] == "{":
                at = self._scan(at + 1, "}")
            elif close := re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(s, at):
                if (close.group(1) or "") != tag:
                    raise Broken("mismatched element")
                return close.end()
            elif s[at] == "<":
                at = self._element(at)
            else:
                at += 1
        raise Broken("unterminated element")

    # --- structure --------------------------------------------------------------------------------

    def text(self, a: int, b: int) -> str:
        """Source of tokens a .. b - 1."""
        return self.source[self.tokens[a].start : self.tokens[b - 1].end] if b > a else ""

    def is_mark(self, k: int, *marks: str) -> bool:
        return k < len(self.tokens) and self.tokens[k].kind == "mark" and self.tokens[k].text in marks

    def is_name(self, k: int, *names: str) -> bool:
        return k < len(self.tokens) and self.tokens[k].kind == "name" and (not names or self.tokens[k].text in names)

    def after_angles(self, k: int) -> int:
        """Past a type parameter or argument list that begins with the ``<`` at k."""
        depth = 0
        while k < len(self.tokens):
            if self.is_mark(k, "<"):
                depth += 1
            elif self.is_mark(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.is_mark(k, "<<"):
                depth += 2
            elif k in self.match:
                k = self.match[k]
            elif self.is_mark(k, ";"):
                break
            k += 1
        raise Broken("unterminated type parameters")

    def after_type(self, k: int, stop: int) -> int:
        """Past the type that begins at k: a brace is part of it only where an operand is due."""
        due = True
        while k < stop:
            t = self.tokens[k]
            if t.kind == "mark":
                if t.text in ("{", "(", "["):
                    if t.text == "{" and not due:
                        return k
                    k, due = self.match[k] + 1, False
                    continue
                if t.text == "<":
                    k, due = self.after_angles(k), False
                    continue
                if t.text in ("|", "&", "=>", ".", "?", ":", "-", "+"):
                    due = True
                else:
                    return k
            elif t.kind == "name" and t.text in ("keyof", "typeof", "infer", "readonly", "unique", "extends", "is", "asserts", "new", "abstract"):
                due = True
            else:
                if not due and self.line(t.start) > self.line(self.tokens[k - 1].start):
                    return k
                due = False
            k += 1
        return k

    def after_statement(self, k: int, stop: int) -> int:
        """Past a plain statement: to its semicolon, or to a line end that cannot go on."""
        begin = k
        while k < stop:
            if self.is_mark(k, ";"):
                return k + 1
            if k > begin and self.line(self.tokens[k].start) > self.line(self.tokens[k - 1].end - 1):
                t, before = self.tokens[k], self.tokens[k - 1]
                goes_on = t.kind == "mark" and t.text in CONTINUES or t.kind == "template" or t.kind == "name" and t.text in _OPERATOR_NAMES
                open_ended = before.kind == "mark" and before.text in OPEN_ENDED or before.kind == "name" and before.text in _OPERATOR_NAMES | {"new", "typeof", "await"}
                if not goes_on and not open_ended:
                    return k
            k = self.match.get(k, k) + 1
        return k

    def after_block(self, k: int, stop: int) -> int:
        """Past a control statement or nested block: its (...) and {...} parts."""
        head = self.tokens[k].text
        if self.is_mark(k, "{"):
            return self.match[k] + 1
        k += 1
        if self.is_name(k, "await"):
            k += 1
        if self.is_mark(k, "("):
            k = self.match[k] + 1
        if k >= stop:
            return k
        k = self.after_one(k, stop)
        while k < stop:
            if head == "if" and self.is_name(k, "else"):
                k = self.after_one(k + 1, stop)
                break
            if head == "try" and self.is_name(k, "catch", "finally"):
                k = k + 1
                if self.is_mark(k, "("):
                    k = self.match[k] + 1
                k = self.after_one(k, stop)
            elif head == "do" and self.is_name(k, "while"):
                return self.after_statement(k, stop)
            else:
                break
        return k

    def after_one(self, k: int, stop: int) -> int:
        """Past one statement inside a body."""
        t = self.tokens[k]
        if self.is_mark(k, "{") or t.kind == "name" and t.text in ("if", "for", "while", "try", "do", "switch", "with"):
            return self.after_block(k, stop)
        j = k
        while self.is_name(j, "async", "export", "default", "declare", "abstract"):
            j += 1
        if self.is_name(j, "function", "class", "interface", "enum", "namespace"):
            while j < stop and not self.is_mark(j, "{"):
                j = self.match.get(j, j) + 1
            return self.match[j] + 1 if j < stop else stop
        return self.after_statement(k, stop)

    def statements(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges of the statements of a body."""
        out = []
        while a < b:
            if self.is_mark(a, ";"):
                a += 1
                continue
            end = max(self.after_one(a, b), a + 1)
            out.append((a, end))
            a = end
        return out

    def doc_before(self, k: int) -> tuple[int, int] | None:
        """The jsDoc comments right before token k: from the first one's start to the last one's end."""
        low, high = self.tokens[k - 1].end if k else 0, self.tokens[k].start
        found = [d for d in self.docs if low <= d[0] and d[1] <= high]
        return (found[0][0], found[-1][1]) if found else None

    def doc_text(self, k: int) -> str | None:
        low, high = self.tokens[k - 1].end if k else 0, self.tokens[k].start
        return "\n".join(self.source[a:b] for a, b in self.docs if low <= a and b <= high) or None
