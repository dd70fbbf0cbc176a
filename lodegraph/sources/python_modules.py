"""Facts of Python modules: symbols, imports, references and calls, one table of tagged rows from a parse of each file.

Parsing is the interpreter's own; files don't meet, so this is a function over Arrow batches of files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, fact string, qualname string, kind string, name string, parent string, line_start int, line_end int, signature string, doc string, exported boolean, decorators array<string>, extends array<string>, methods array<string>, module string, imported string, local string, receiver string, via string, target string, http_method string, http_path string, `table` string, validator string, op string"
_COLUMNS = [c.split()[0].strip("`") for c in FACTS.split(", ")]
#: Decorators that make routes, bases that make models and validators, calls that read and write, and names
#: that only wrap a type.
ROUTE_VERBS = ("get", "post", "put", "patch", "delete", "route")
MODEL_BASES = ("Base", "DeclarativeBase", "Model", "SQLModel")
WRAPPERS = ("Optional", "None", "list", "List", "dict", "Dict", "Union", "Annotated", "Sequence", "type")
TABLE_READS, TABLE_WRITES = ("query", "select", "get"), ("insert", "update", "delete", "add")


def compact(text: str, limit: int = 160) -> str:
    text = re.sub(r"\s+", " ", text).strip()
    return text if len(text) <= limit else text[: limit - 1] + "…"


def type_name(node: ast.AST | None) -> str | None:
    """The first name of an annotation that isn't a wrapper: Optional[X], X | None and list[X] are X, a.B is B."""
    if node is None:
        return None
    text = node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ast.unparse(node)
    names = (n.split(".")[-1] for n in re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", text))
    return next((n for n in names if n not in WRAPPERS), None)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; null for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := dotted(node.value)) is not None:
        return f"{left}.{node.attr}"
    return None


class _Module(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows, self.owner, self.inside = path, [], None, None

    def add(self, fact: str, **values: object) -> None:
        self.rows.append({"path": self.path, "fact": fact, **values})

    def _symbol(self, node: ast.AST, kind: str, name: str, **values: object) -> None:
        qualname = f"{self.owner}.{name}" if self.owner else name
        self.add("symbol", qualname=qualname, kind=kind, name=name, parent=self.owner, line_start=node.lineno, line_end=node.end_lineno, exported=not name.startswith("_"), **values)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", module=a.name, imported="*module", local=a.asname or a.name.split(".")[0], line_start=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", module="." * node.level + (node.module or ""), imported=a.name, local=a.asname or a.name, line_start=node.lineno)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(dotted, node.bases) if b]
        last = [b.split(".")[-1] for b in bases]
        table = next((s.value.value for s in node.body if isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant) and any(dotted(t) == "__tablename__" for t in s.targets)), None)
        model = table or (node.name.lower() if set(last) & set(MODEL_BASES) else None)
        methods = [s.name for s in node.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) and not s.name.startswith("_")]
        self._symbol(node, "class", node.name, doc=_doc(node), decorators=_decorators(node), extends=last, methods=methods, table=model, validator="pydantic" if "BaseModel" in last else None)
        for b in last:
            self.add("ref", qualname=node.name, target=b, via="extends", line_start=node.lineno)
        for s in node.body:
            if isinstance(s, ast.AnnAssign) and (t := type_name(s.annotation)):
                self.add("field", qualname=node.name, name=dotted(s.target), target=t, via="field", line_start=s.lineno)
        before, self.owner, scope, self.inside = self.owner, node.name if not self.owner else f"{self.owner}.{node.name}", self.inside, node.name
        for s in node.body:
            self.visit(s)
        self.owner, self.inside = before, scope

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        nested = self.inside is not None and self.inside != self.owner
        if nested:  # a function's own functions are part of it
            return self.generic_visit(node)
        name = node.name
        qualname = f"{self.owner}.{name}" if self.owner else name
        self._symbol(node, "method" if self.owner else "function", name, doc=_doc(node), decorators=_decorators(node), signature=compact(f"{name}({ast.unparse(node.args)})"))
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            verb = dotted(call.func).rsplit(".", 1)[-1] if call and dotted(call.func) and "." in dotted(call.func) else None
            if verb in ROUTE_VERBS and call.args and isinstance(call.args[0], ast.Constant):
                methods = next(([e.value for e in k.value.elts] for k in call.keywords if k.arg == "methods" and isinstance(k.value, ast.List)), ["GET"]) if verb == "route" else [verb.upper()]
                for m in methods:
                    self.add("symbol", qualname=f"route:{m} {call.args[0].value}", kind="route", name=f"{m} {call.args[0].value}", line_start=d.lineno, line_end=node.end_lineno, exported=True, http_method=m, http_path=str(call.args[0].value), target=qualname)
        arguments = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        types = {a.arg: t for a in arguments if (t := type_name(a.annotation))}
        for a, t in types.items():
            injected = name == "__init__" and self.owner
            self.add("param", qualname=qualname, name=a, target=t, via="constructor" if injected else "type", line_start=node.lineno)
        before, self.inside = self.inside, qualname
        for s in node.body:
            if name == "__init__" and self.owner:
                for a in ast.walk(s):
                    if isinstance(a, (ast.Assign, ast.AnnAssign)):
                        self._own_field(a, types)
            self.visit(s)
        self.inside = before

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _own_field(self, node: ast.Assign | ast.AnnAssign, types: dict[str, str]) -> None:
        for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(t, ast.Attribute) and dotted(t.value) == "self":
                value = node.value
                of = types.get(value.id) if isinstance(value, ast.Name) else dotted(value.func).split(".")[-1] if isinstance(value, ast.Call) and dotted(value.func) else None
                if of and of[:1].isupper():
                    self.add("field", qualname=self.owner, name=t.attr, target=of, via="constructor" if isinstance(value, ast.Name) else "new", line_start=node.lineno)

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call) and (made := dotted(node.value.func)) and made.split(".")[-1][:1].isupper():
            for t in node.targets:
                if isinstance(t, ast.Name):
                    if self.inside is None:
                        self._symbol(node, "const", t.id, target=made.split(".")[-1])
                    else:
                        self.add("local", qualname=self.inside, name=t.id, target=made.split(".")[-1], line_start=node.lineno)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        made = dotted(node.func)
        if made:
            receiver, _, method = made.rpartition(".")
            if not receiver and method[:1].isupper():
                self.add("ref", qualname=self.inside, target=method, via="new", line_start=node.lineno)
            else:
                self.add("call", qualname=self.inside, receiver=receiver or None, name=method, line_start=node.lineno)
            op = "read" if method in TABLE_READS else "write" if method in TABLE_WRITES else None
            first = dotted(node.args[0]) if node.args else None
            if op and first and first.split(".")[-1][:1].isupper():
                self.add("table", qualname=self.inside, target=first.split(".")[-1], op=op, line_start=node.lineno)
        self.generic_visit(node)


def _doc(node: ast.AST) -> str | None:
    text = ast.get_docstring(node)
    return compact(text, 300) if text else None


def _decorators(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    return [n.split(".")[-1] for d in node.decorator_list if (n := dotted(d.func if isinstance(d, ast.Call) else d))]


def module_facts(path: str, text: str) -> list[dict[str, object]]:
    """The facts of one file; one that doesn't parse has a single fact, `error`."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"path": path, "fact": "error", "doc": compact(str(e))}]
    module = _Module(path)
    module.visit(tree)
    return module.rows


def parse(files: DataFrame) -> DataFrame:
    """Facts (see FACTS) of files (path, text): symbol, import, ref, call, param, field, local, table and error rows. Null
    texts are empty modules. Order plays no part; repeated files give repeated facts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [f for p, t in zip(frame["path"], frame["text"]) for f in module_facts(p, t or "")]
            out = pd.DataFrame(rows, columns=_COLUMNS).astype(object)
            out = out.where(out.notna(), None)
            out[["line_start", "line_end"]] = out[["line_start", "line_end"]].astype("Int32")
            yield out

    return files.select("path", "text").mapInPandas(run, FACTS)
