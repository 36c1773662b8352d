"""Declaration-level chunks of TypeScript and JavaScript files.

One chunk for each top-level class, function, interface, type alias, enum and qualifying variable
statement; large ones are split by members, statements or lines.  Files that cannot be scanned are
cut into windows of lines.
"""

from __future__ import annotations

from .. import model
from .chunk_generic import Span, parts_of, record, split_by_lines, tokens_of
from .tsjs_scan import Broken, Scan

_MODIFIERS = ("export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "accessor")
_CHUNKER = "ts-morph"  # fixed value: the name under which these chunks are stored


class _File:
    def __init__(self, path: str, language: str, source: str):
        self.path, self.language, self.source = path, language, source
        self.lines = source.split("\n")
        self.scan = Scan(source, jsx=not path.lower().endswith((".ts", ".mts", ".cts")))
        self.records: list[dict] = []
        self.re_exports = False

    # --- pieces -----------------------------------------------------------------------------------

    def span(self, a: int, b: int) -> Span:
        s = self.scan
        return Span(s.line(s.tokens[a].start), s.line(s.tokens[b - 1].end - 1), s.text(a, b))

    def rows(self, first: int, last: int) -> Span:
        return Span(first, last, "\n".join(self.lines[first - 1 : last]))

    def add(self, span: Span, kind: str, **fields) -> None:
        self.records.append(record(self.path, self.language, span, kind=kind, chunker=_CHUNKER, **fields))

    def add_parts(self, spans: list[Span], kind: str, **fields) -> None:
        for k, span in enumerate(spans, 1):
            self.add(span, kind, index=k, total=len(spans), **fields)

    def decorators(self, k: int) -> int:
        s = self.scan
        while s.is_mark(k, "@"):
            k += 2
            while s.is_mark(k, "."):
                k += 2
            if s.is_mark(k, "("):
                k = s.match[k] + 1
        return k

    def modifiers(self, k: int, names: tuple[str, ...] = _MODIFIERS) -> tuple[list[str], int]:
        s, found = self.scan, []
        while s.is_name(k, *names) and not s.is_mark(k + 1, "(", "=", ":", ";", ",", "?", "<", "}"):
            found.append(s.tokens[k].text)
            k += 1
        return found, k

    def type_parameters(self, k: int) -> tuple[str, int]:
        s = self.scan
        if not s.is_mark(k, "<"):
            return "", k
        end = s.after_angles(k)
        return f"<{', '.join(s.text(a, b) for a, b in self.separated(k + 1, end - 1))}>", end

    def separated(self, a: int, b: int, mark: str = ",") -> list[tuple[int, int]]:
        """Ranges between ``mark`` outside brackets and angle brackets."""
        s, out, begin, k = self.scan, [], a, a
        while k < b:
            if s.is_mark(k, mark):
                out.append((begin, k))
                begin = k + 1
            elif s.is_mark(k, "<") and mark == ",":
                try:
                    k = min(s.after_angles(k), b)
                    continue
                except Broken:
                    pass
            k = s.match.get(k, k) + 1
        return [r for r in [*out, (begin, b)] if r[1] > r[0]]

    def parameters(self, k: int) -> tuple[str, int]:
        """``(a, b)`` of the bracket at k, and what follows it."""
        s = self.scan
        end = s.match[k]
        return f"({', '.join(s.text(a, b) for a, b in self.separated(k + 1, end))})", end + 1

    def returns(self, k: int, stop: int) -> tuple[str, int]:
        s = self.scan
        if not s.is_mark(k, ":"):
            return "", k
        end = s.after_type(k + 1, stop)
        return f": {s.text(k + 1, end)}", end

    @staticmethod
    def prefix(mods: list[str]) -> str:
        return "".join(m + " " for m in mods)

    # --- declarations -----------------------------------------------------------------------------

    def run(self) -> tuple[str, list[dict]]:
        s, k, n = self.scan, 0, len(self.scan.tokens)
        while k < n:
            k = k + 1 if s.is_mark(k, ";") else max(self.statement(k, n), k + 1)
        whole = Span(1, max(1, len(self.lines) - (len(self.lines) > 1 and not self.lines[-1])), self.source)
        if self.records:
            return "chunked", self.records
        if self.re_exports:
            self.add(whole, "re-export", exported=True)
            return "chunked", self.records
        self.add_parts(parts_of(self.source, 1, whole.end), "file")
        return "no-declarations", self.records

    def statement(self, begin: int, n: int) -> int:
        """Handle the top-level statement at token ``begin``; returns what follows it."""
        s = self.scan
        k = self.decorators(begin)
        written, k = self.modifiers(k)
        k = self.decorators(k)
        exported = "export" in written
        if s.is_name(k, "const") and s.is_name(k + 1, "enum"):
            written, k = [*written, "const"], k + 1
        if s.is_name(k, "class"):
            return self.class_(begin, k, written, exported, n)
        if s.is_name(k, "function"):
            return self.function(begin, k, written, exported, n)
        if s.is_name(k, "interface") and s.is_name(k + 1):
            return self.interface(begin, k, written, exported, n)
        if s.is_name(k, "type") and s.is_name(k + 1):
            return self.alias(begin, k, written, exported, n)
        if s.is_name(k, "enum") and s.is_name(k + 1):
            return self.enum(begin, k, written, exported)
        if s.is_name(k, "const", "let", "var", "using"):
            return self.variables(begin, k, exported, n)
        if s.is_name(begin, "export") and (s.is_mark(begin + 1, "{", "*") or s.is_name(begin + 1, "type")):
            end = s.after_statement(begin, n)
            self.re_exports |= any(s.is_name(j, "from") for j in range(begin, end))
            return end
        if s.is_name(begin, "export", "import"):
            return s.after_statement(begin, n)
        if s.is_name(k, "namespace", "module", "global") and (s.is_name(k + 1) or s.is_mark(k + 1, "{") or k + 1 < n and s.tokens[k + 1].kind == "string"):
            while k < n and not s.is_mark(k, "{", ";"):
                k += 1
            return s.match.get(k, k) + 1
        return s.after_one(begin, n)

    def class_(self, begin: int, k: int, written: list[str], exported: bool, n: int) -> int:
        s, name, k = self.scan, None, k + 1
        if s.is_name(k) and s.tokens[k].text not in ("extends", "implements"):
            name, k = s.tokens[k].text, k + 1
        generics, k = self.type_parameters(k)
        bases = ""
        for word in ("extends", "implements"):
            if s.is_name(k, word):
                first = k = k + 1
                while k < n and not s.is_mark(k, "{") and not s.is_name(k, "implements"):
                    k = s.after_angles(k) if s.is_mark(k, "<") else s.match.get(k, k) + 1
                bases += f" {word} {', '.join(s.text(a, b) for a, b in self.separated(first, k))}"
        if not s.is_mark(k, "{"):
            raise Broken("class without a body")
        end = s.match[k] + 1
        signature = f"{self.prefix(written)}class {name or ''}{generics}{bases}"
        whole, doc = self.span(begin, end), s.doc_text(begin)
        if tokens_of(whole.text) <= model.MAX_CHUNK_TOKENS:
            self.add(whole, "class", symbol=name, signature=signature, doc=doc, exported=exported)
            return end
        members = self.members(k + 1, end - 1)
        ctor = next((m for m in members if m[2] == "constructor"), None)
        chosen = ([ctor] if ctor else []) + [m for m in members if m[2] != "constructor"]
        starts = [s.line((s.doc_before(a) or (s.tokens[a].start,))[0]) for a, _, _, _ in chosen]
        header = self.rows(whole.start, min(starts) - 1 if starts else whole.end)
        self.add(header, "class", symbol=name, signature=signature, doc=doc, exported=exported, index=1, total=1 + len(chosen))
        for place, (a, b, member, text) in enumerate(chosen, 2):
            self.add(self.span(a, b), "method", symbol=member, signature=text, doc=s.doc_text(a), parent=name, exported=exported, index=place, total=1 + len(chosen))
        return end

    def members(self, k: int, stop: int) -> list[tuple[int, int, str, str]]:
        """Methods and the first constructor with a body: (from, to, name, signature)."""
        s, out, seen = self.scan, [], False
        while k < stop:
            if s.is_mark(k, ";"):
                k += 1
                continue
            begin = k
            k = self.decorators(k)
            written, k = self.modifiers(k)
            if s.is_name(begin, "static") and s.is_mark(k, "{"):
                k = s.match[k] + 1
                continue
            accessor = s.is_name(k, "get", "set") and not s.is_mark(k + 1, "(", "=", ":", ";", "?", "<")
            k += accessor
            star = s.is_mark(k, "*")
            k += star
            first = k
            k = s.match[k] + 1 if s.is_mark(k, "[") else k + 1
            name = s.text(first, k)
            optional = s.is_mark(k, "?")
            k += optional or s.is_mark(k, "!")
            generics, after = self.type_parameters(k) if s.is_mark(k, "<") else ("", k)
            if not s.is_mark(after, "("):
                k = max(s.after_statement(begin, stop), begin + 1)
                continue
            group, k = self.parameters(after)
            returned, k = self.returns(k, stop)
            body = s.is_mark(k, "{")
            k = s.match[k] + 1 if body else k + s.is_mark(k, ";")
            if accessor or not body and "abstract" not in written:
                continue
            if name == "constructor":
                if not seen:
                    out.append((begin, k, name, f"{self.prefix(written)}constructor{group}"))
                seen = True
            else:
                out.append((begin, k, name, f"{self.prefix(written)}{'*' * star}{name}{'?' * optional}{generics}{group}{returned}"))
        return out

    def function(self, begin: int, k: int, written: list[str], exported: bool, n: int) -> int:
        s, k = self.scan, k + 1
        star = s.is_mark(k, "*")
        k += star
        name = s.tokens[k].text if s.is_name(k) else None
        k += name is not None
        generics, k = self.type_parameters(k)
        if not s.is_mark(k, "("):
            raise Broken("function without parameters")
        group, k = self.parameters(k)
        returned, k = self.returns(k, n)
        signature = f"{self.prefix(written)}function{'*' * star} {name or ''}{generics}{group}{returned}"
        body = (k + 1, s.match[k]) if s.is_mark(k, "{") else None
        end = body[1] + 1 if body else k + s.is_mark(k, ";")
        whole = self.span(begin, end)
        fields = {"symbol": name, "signature": signature, "doc": s.doc_text(begin), "exported": exported}
        inner = s.statements(*body) if body else []
        if tokens_of(whole.text) <= model.MAX_CHUNK_TOKENS or not inner:
            self.add(whole, "function", **fields)
            return end
        self.add_parts(self.packed(inner), "function", **fields)
        return end

    def packed(self, inner: list[tuple[int, int]]) -> list[Span]:
        """Runs of statements within the budget; a run reaches to the line before the next one."""
        s = self.scan
        lines = [(s.line(s.tokens[a].start), s.line(s.tokens[b - 1].end - 1)) for a, b in inner]
        starts = [lines[0][0]]
        for first, last in lines[1:]:
            if tokens_of(self.rows(starts[-1], last).text) > model.MAX_CHUNK_TOKENS:
                starts.append(first)
        ends = [a - 1 for a in starts[1:]] + [lines[-1][1]]
        return [self.rows(a, b) for a, b in zip(starts, ends)]

    def interface(self, begin: int, k: int, written: list[str], exported: bool, n: int) -> int:
        s = self.scan
        name, k = s.tokens[k + 1].text, k + 2
        generics, k = self.type_parameters(k)
        first = k
        while k < n and not s.is_mark(k, "{"):
            k = s.after_angles(k) if s.is_mark(k, "<") else k + 1
        if k >= n:
            raise Broken("interface without a body")
        bases = f" extends {', '.join(s.text(a, b) for a, b in self.separated(first + 1, k))}" if k > first else ""
        end = s.match[k] + 1
        span = self.span(begin, end)
        self.add_parts(parts_of(span.text, span.start, span.end), "interface", symbol=name, signature=f"{self.prefix(written)}interface {name}{generics}{bases}", doc=s.doc_text(begin), exported=exported)
        return end

    def alias(self, begin: int, k: int, written: list[str], exported: bool, n: int) -> int:
        s = self.scan
        name, k = s.tokens[k + 1].text, k + 2
        generics, k = self.type_parameters(k)
        if not s.is_mark(k, "="):
            raise Broken("type alias without a type")
        end = s.after_statement(k, n)
        last = end - 1 if s.is_mark(end - 1, ";") else end
        span = self.span(begin, end)
        self.add_parts(parts_of(span.text, span.start, span.end), "type-alias", symbol=name, signature=f"{self.prefix(written)}type {name}{generics} = {self.condensed(k + 1, last)}", doc=s.doc_text(begin), exported=exported)
        return end

    def condensed(self, a: int, b: int) -> str:
        """A type in short: object literals by their member names, unions and intersections by parts."""
        s = self.scan
        for mark in ("|", "&"):
            if s.is_mark(a, mark):
                a += 1
            if not any(s.is_mark(j, "=>", "?") for j in self.outside(a, b)):
                parts = self.separated(a, b, mark)
                if len(parts) > 1:
                    return f" {mark} ".join(self.condensed(*p) for p in parts)
        if s.is_mark(a, "{") and s.match[a] == b - 1:
            names = []
            for x, _ in self.type_members(a + 1, b - 1):
                x = x + 1 if s.is_name(x, "readonly") and not s.is_mark(x + 1, ":", "?") else x
                names.append("IndexSignature" if s.is_mark(x, "[") else "CallSignature" if s.is_mark(x, "(", "<") else s.source[s.tokens[x].start : s.tokens[x].end])
            return f"{{ {'; '.join(names)} }}"
        return s.text(a, b)

    def outside(self, a: int, b: int) -> list[int]:
        out, k = [], a
        while k < b:
            out.append(k)
            k = self.scan.match.get(k, k) + 1
        return out

    def type_members(self, a: int, b: int) -> list[tuple[int, int]]:
        s, out, begin, k = self.scan, [], a, a
        while k < b:
            if s.is_mark(k, ";", ","):
                out.append((begin, k))
                begin = k + 1
            elif k > begin and s.line(s.tokens[k].start) > s.line(s.tokens[k - 1].end - 1) and not (s.tokens[k].kind == "mark" and s.tokens[k].text in ("|", "&", "?", ":", "=>", ".")) and not (s.tokens[k - 1].kind == "mark" and s.tokens[k - 1].text in ("|", "&", "?", ":", "=>", ".", "<")):
                out.append((begin, k))
                begin = k
            k = s.match.get(k, k) + 1
        return [r for r in [*out, (begin, b)] if r[1] > r[0]]

    def enum(self, begin: int, k: int, written: list[str], exported: bool) -> int:
        s, name = self.scan, self.scan.tokens[k + 1].text
        if not s.is_mark(k + 2, "{"):
            raise Broken("enum without a body")
        end = s.match[k + 2]
        names = ", ".join(s.source[s.tokens[a].start : s.tokens[a].end] for a, _ in self.separated(k + 3, end))
        self.add(self.span(begin, end + 1), "enum", symbol=name, signature=f"{self.prefix(written)}enum {name} {{ {names} }}", doc=s.doc_text(begin), exported=exported)
        return end + 1

    def variables(self, begin: int, k: int, exported: bool, n: int) -> int:
        s, end = self.scan, self.scan.after_statement(begin, n)
        last = end - 1 if s.is_mark(end - 1, ";") else end
        for a, b in self.separated(k + 1, last):
            name_end = s.match[a] + 1 if a in s.match else a + 1
            type_end = j = name_end
            if s.is_mark(j, "!"):
                j += 1
            if s.is_mark(j, ":"):
                type_end = s.after_type(j + 1, b)
            init = type_end + 1 if s.is_mark(type_end, "=") else None
            callable_ = self.callable(init, b) if init is not None else None
            if exported or callable_:
                name = s.text(a, name_end)
                typed = f"const {name}: {self.condensed(j + 1, type_end)}" if type_end > name_end else f"const {name}"
                self.add(self.span(begin, end), "const", symbol=name, signature=f"const {name} = {callable_}" if callable_ else typed, doc=s.doc_text(begin), exported=exported)
                break
        return end

    def callable(self, k: int, stop: int) -> str | None:
        """The signature of an arrow function or function expression that is the whole initializer."""
        s = self.scan
        lead = "async " if s.is_name(k, "async") and not s.is_mark(k + 1, "=>") else ""
        k += bool(lead)
        if s.is_name(k, "function"):
            k += 1
            star = s.is_mark(k, "*")
            k += star
            k += s.is_name(k)
            _, k = self.type_parameters(k)
            group, k = self.parameters(k)
            returned, k = self.returns(k, stop)
            return f"{lead}function{'*' * star}{group}{returned} {{ … }}" if s.is_mark(k, "{") and s.match[k] + 1 == stop else None
        if s.is_name(k) and s.is_mark(k + 1, "=>"):
            return f"{lead}({s.tokens[k].text}) => …"
        try:
            _, k = self.type_parameters(k)
        except Broken:
            return None
        if not s.is_mark(k, "("):
            return None
        group, k = self.parameters(k)
        returned = ""
        if s.is_mark(k, ":"):
            end = k + 1
            while end < stop and not s.is_mark(end, "=>"):
                end = s.match.get(end, end) + 1
            returned, k = f": {s.text(k + 1, end)}", end
        return f"{lead}{group}{returned} => …" if s.is_mark(k, "=>") else None


def chunk(path: str, language: str, source: str) -> tuple[str, list[dict]]:
    """(outcome, chunk records)."""
    try:
        return _File(path, language, source).run()
    except (Broken, IndexError, KeyError):
        windows = split_by_lines(source, 1, model.MAX_CHUNK_TOKENS)
        return "degraded", [record(path, language, w, kind="window", chunker="fallback", index=k, total=len(windows)) for k, w in enumerate(windows, 1)]
