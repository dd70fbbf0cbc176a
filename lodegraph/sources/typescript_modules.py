"""Facts of TypeScript and JavaScript modules: classes, functions, constants, imports, references, calls, routes and tables.

A scanner parts a file into tokens (comments and strings apart); declarations are read off the tokens with brackets
matched. It knows no types and no macros: what it can't read gives no fact. The facts are those of Python modules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodegraph.sources.python_modules import _COLUMNS, FACTS, compact

_TOKEN = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|\?\.|[{}()\[\];,.<>:=?!@&|+*/%^~-])", re.S)
#: Verbs of routes, makers of tables and of validators, and calls that read and write.
ROUTE_VERBS = ("get", "post", "put", "patch", "delete")
TABLE_MAKERS = ("pgTable", "mysqlTable", "sqliteTable")
VALIDATORS = {"z": "zod", "Joi": "joi", "joi": "joi", "yup": "yup", "v": "valibot"}
READS, WRITES = ("from", "findFirst", "findMany"), ("insert", "update", "delete")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "await", "new", "typeof", "super", "constructor", "throw", "else", "do", "try", "in", "of", "import", "export", "async", "const", "let", "var", "class"}
_PAIRS = {"{": "}", "(": ")", "[": "]"}


class _Source:
    def __init__(self, path: str, text: str):
        self.path, self.rows, self.text = path, [], text
        self.kind, self.value, self.line = [], [], []
        line = at = 0
        line = 1
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:  # a character that no token begins with
                at += 1
                continue
            if m.lastgroup != "skip":
                self.kind.append(m.lastgroup)
                self.value.append(m[0])
                self.line.append(line)
            line += m[0].count("\n")
            at = m.end()
        self.close = self._matched()

    def _matched(self) -> dict[int, int]:
        out, open_ = {}, []
        for i, v in enumerate(self.value):
            if v in _PAIRS and self.kind[i] == "mark":
                open_.append(i)
            elif v in ("}", ")", "]") and open_ and _PAIRS[self.value[open_[-1]]] == v:
                out[open_.pop()] = i
        return out

    def at(self, i: int) -> str:
        return self.value[i] if 0 <= i < len(self.value) else ""

    def string(self, i: int) -> str | None:
        return self.value[i][1:-1] if 0 <= i < len(self.value) and self.kind[i] == "string" else None

    def add(self, fact: str, i: int, **values: object) -> None:
        self.rows.append({"path": self.path, "fact": fact, "line_start": self.line[min(i, len(self.line) - 1)], **values})

    def end_of(self, i: int) -> int:
        """The closing bracket of the first brace from i on, before a semicolon."""
        while i < len(self.value) and self.at(i) not in ("{", ";"):
            i = self.close.get(i, i) + 1 if self.at(i) in ("(", "[") else i + 1
        return self.close.get(i, i)

    def scan(self) -> list[dict[str, object]]:
        i, exported = 0, False
        while i < len(self.value):
            v = self.at(i)
            if v == "import":
                i = self._import(i)
            elif v == "export" and self.at(i + 1) in ("{", "*"):
                i = self._reexport(i)
            elif v in ("export", "default", "async", "abstract", "declare"):
                exported |= v == "export"
                i += 1
                continue
            elif v == "@" and self.kind[i + 1 : i + 2] == ["name"]:
                i = self.close.get(i + 2, i + 1) + 1
                continue
            elif v == "class":
                i = self._class(i, exported)
            elif v in ("function", "interface", "type", "enum") and self.kind[i + 1 : i + 2] == ["name"]:
                i = self._function(i, exported) if v == "function" else self._plain(i, v, exported)
            elif v in ("const", "let", "var") and self.kind[i + 1 : i + 2] == ["name"]:
                i = self._const(i, exported)
            elif self._is_route(i):
                i = self._route(i)
            else:
                i = self.close.get(i, i) + 1
            exported = False
        return self.rows

    def _import(self, i: int) -> int:
        j, type_only = i + 1, self.at(i + 1) == "type"
        names: list[tuple[str, str]] = []
        while j < len(self.value) and self.at(j) != ";" and self.string(j) is None and j - i < 400:
            if self.kind[j] == "name" and self.at(j) not in ("from", "type", "as"):
                if self.at(j - 1) == "as":
                    names[-1] = (names[-1][0], self.at(j))
                elif j == i + 1 + type_only:
                    names.append(("default", self.at(j)))
                else:
                    names.append((self.at(j), self.at(j)))
            elif self.at(j) == "*":
                names.append(("*module", ""))
            j += 1
        for imported, local in names:
            self.add("import", i, module=self.string(j), imported=imported, local=local, via="type" if type_only else None)
        return j + 1

    def _reexport(self, i: int) -> int:
        j = self.close.get(i + 1, i + 1) + 1
        if self.at(j) != "from":
            return j
        inner = [t for t in self.value[i + 2 : j - 1] if t not in (",", "type")]
        if self.at(i + 1) == "*":
            self.add("import", i, module=self.string(j + 1), imported="*", local="*")
        while inner:
            name = inner.pop(0)
            local = inner[1] if inner[:1] == ["as"] else name
            inner = inner[2:] if inner[:1] == ["as"] else inner
            self.add("import", i, module=self.string(j + 1), imported=name, local=local)
        return j + 2

    def _plain(self, i: int, kind: str, exported: bool) -> int:
        self.add("symbol", i, qualname=self.at(i + 1), name=self.at(i + 1), kind=kind, exported=exported)
        return self.end_of(i + 1) + 1

    def _params(self, a: int, b: int, qualname: str, via: str) -> None:
        for j in range(a + 1, b):
            if self.at(j) == ":" and self.kind[j - 1] == "name" and self.kind[j + 1 : j + 2] == ["name"] and self.at(j + 1)[:1].isupper():
                self.add("param", j, qualname=qualname, name=self.at(j - 1), target=self.at(j + 1), via=via)

    def _signature(self, a: int, b: int) -> str:
        return compact(" ".join(self.value[a : b + 1]))

    def _function(self, i: int, exported: bool) -> int:
        name, paren = self.at(i + 1), i + 2
        while self.at(paren) != "(" and paren < len(self.value):
            paren += 1
        close = self.close.get(paren, paren)
        end = self.end_of(close + 1)
        self.add("symbol", i, qualname=name, name=name, kind="function", exported=exported, line_end=self.line[min(end, len(self.line) - 1)], signature=self._signature(i + 1, close))
        self._params(paren, close, name, "type")
        self._body(close + 1, end, name)
        return end + 1

    def _const(self, i: int, exported: bool) -> int:
        name, j = self.at(i + 1), i + 2
        while j < len(self.value) and self.at(j) not in ("=", ";"):
            j = self.close.get(j, j) + 1
        value = j + 1
        made = self.at(value + 1) if self.at(value) == "new" else None
        end = value
        while end < len(self.value) and self.at(end) != ";" and not (end > value and self.line[end] != self.line[end - 1] and self.at(end) in _WORDS - {"in", "of"}):
            end = self.close.get(end, end) + 1
        if self.at(value) == "async":
            value += 1
        arrow = self.at(value) == "(" and "=>" in self.value[self.close.get(value, value) : min(self.close.get(value, value) + 12, end)]
        if arrow:
            close = self.close.get(value, value)
            self.add("symbol", i, qualname=name, name=name, kind="function", exported=exported, line_end=self.line[min(end, len(self.line) - 1)], signature=compact(name + " " + " ".join(self.value[value : close + 1])))
            self._params(value, close, name, "type")
        else:
            table = self.string(value + 2) if self.at(value) in TABLE_MAKERS else None
            validator = VALIDATORS.get(self.at(value)) if self.at(value + 1) == "." else None
            self.add("symbol", i, qualname=name, name=name, kind="const", exported=exported, target=made, table=table, validator=validator)
            if made:
                self.add("ref", i, qualname=name, target=made, via="new")
        self._body(value, end, name)
        return end + 1

    def _class(self, i: int, exported: bool) -> int:
        name, j, parents = self.at(i + 1), i + 2, []
        via = None
        while j < len(self.value) and self.at(j) != "{":
            if self.at(j) in ("extends", "implements"):
                via = self.at(j)
            elif via and self.kind[j] == "name" and self.at(j - 1) in ("extends", "implements", ","):
                parents.append((via, self.at(j)))
            j += 1
        end, methods = self.close.get(j, j), []
        marks = [self.at(k) for k in range(max(0, i - 12), i) if self.at(k - 1) == "@"]
        head = len(self.rows)
        k = j + 1
        while k < end:
            if self.kind[k] == "name" and self.at(k + 1) == "(" and self.at(k) not in _WORDS - {"constructor", "delete", "of"} and self.at(k - 1) not in (".", "new", "@"):
                close = self.close.get(k + 1, k + 1)
                stop = self.end_of(close + 1)
                qualname = f"{name}.{self.at(k)}"
                if self.at(k) == "constructor":
                    self._params(k + 1, close, qualname, "constructor")
                    for m in range(k + 2, close):
                        if self.at(m) == ":" and self.at(m + 1)[:1].isupper():
                            self.add("field", m, qualname=name, name=self.at(m - 1), target=self.at(m + 1), via="constructor")
                else:
                    if "private" not in self.value[max(j, k - 3) : k]:
                        methods.append(self.at(k))
                    self.add("symbol", k, qualname=qualname, name=self.at(k), kind="method", parent=name, exported=exported, line_end=self.line[min(stop, len(self.line) - 1)], signature=self._signature(k, close))
                    self._params(k + 1, close, qualname, "type")
                self._body(close + 1, stop, qualname)
                k = stop + 1
            elif self.kind[k] == "name" and self.at(k + 1) == ":" and self.at(k + 2)[:1].isupper():
                self.add("field", k, qualname=name, name=self.at(k), target=self.at(k + 2), via="field")
                k += 3
            elif self.kind[k] == "name" and self.at(k + 1) == "=" and self.at(k + 2) == "new":
                self.add("field", k, qualname=name, name=self.at(k), target=self.at(k + 3), via="new")
                k += 4
            else:
                k = self.close.get(k, k) + 1
        for via, parent in parents:
            self.add("ref", i, qualname=name, target=parent, via=via)
        self.add("symbol", i, qualname=name, name=name, kind="class", exported=exported, line_end=self.line[min(end, len(self.line) - 1)], decorators=marks, extends=[p for v, p in parents if v == "extends"], methods=methods)
        self.rows.insert(head, self.rows.pop())
        return end + 1

    def _is_route(self, i: int) -> bool:
        return self.kind[i] == "name" and self.at(i + 1) == "." and self.at(i + 2) in ROUTE_VERBS and self.at(i + 3) == "(" and (self.string(i + 4) or "").startswith("/")

    def _route(self, i: int, inside: str | None = None) -> int:
        """A route; the typed names of the function that it is declared in are its own."""
        end = self.close.get(i + 3, i + 3)
        name = f"{self.at(i + 2).upper()} {self.string(i + 4)}"
        parts = [j for j in range(i + 5, end) if self.kind[j] == "name"]
        receivers = [(self.at(j), self.at(j + 2)) for j in parts if self.at(j + 1) == "." and self.kind[j + 2 : j + 3] == ["name"] and self.at(j - 1) != "."]
        self.add("symbol", i, qualname=f"route:{name}", name=name, kind="route", exported=True, http_method=self.at(i + 2).upper(), http_path=self.string(i + 4), target=".".join(receivers[-1]) if receivers else next((self.at(j) for j in reversed(parts) if self.at(j - 1) in (",", "(")), None))
        for r in [r for r in self.rows if inside and r["fact"] in ("param", "local") and r["qualname"] == inside]:
            self.add("local", i, qualname=f"route:{name}", name=r["name"], target=r["target"])
        self._body(i + 5, end, f"route:{name}")
        return end + 1

    def _body(self, a: int, b: int, qualname: str) -> None:
        j = a - 1
        while (j := j + 1) < min(b, len(self.value)):
            if self.kind[j] != "name":
                continue
            if self._is_route(j):
                j = self._route(j, qualname) - 1
            elif self.at(j) == "new" and self.kind[j + 1 : j + 2] == ["name"]:
                self.add("ref", j, qualname=qualname, target=self.at(j + 1), via="new")
                if self.at(j - 1) == "=" and self.kind[j - 2] == "name":
                    self.add("local", j, qualname=qualname, name=self.at(j - 2), target=self.at(j + 1))
            elif self.at(j + 1) == "(" and self.at(j) not in _WORDS - {"delete", "of"} and self.at(j - 1) != "new":
                chain, k = [], j
                while self.at(k - 1) in (".", "?.") and self.kind[k - 2] == "name":
                    chain.insert(0, self.at(k - 2))
                    k -= 2
                receiver = ".".join("self" if c == "this" else c for c in chain) or None
                self.add("call", j, qualname=qualname, receiver=receiver, name=self.at(j))
                op = "read" if self.at(j) in READS else "write" if self.at(j) in WRITES else None
                if op and self.kind[j + 2 : j + 3] == ["name"]:
                    self.add("table", j, qualname=qualname, target=self.at(j + 2), op=op)


def module_facts(path: str, text: str) -> list[dict[str, object]]:
    return _Source(path, text).scan()


def parse(files: DataFrame) -> DataFrame:
    """Facts of files (path, text), as of Python modules. Null texts are empty modules."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [f for p, t in zip(frame["path"], frame["text"]) for f in module_facts(p, t or "")]
            out = pd.DataFrame(rows, columns=_COLUMNS).astype(object)
            out = out.where(out.notna(), None)
            out[["line_start", "line_end"]] = out[["line_start", "line_end"]].astype("Int32")
            yield out

    return files.select("path", "text").mapInPandas(run, FACTS)
