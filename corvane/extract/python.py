"""Python sources by the standard library's syntax tree; a broken one keeps the part before its first error."""

from __future__ import annotations

import ast

from corvane.extract.rows import Extraction


#: What the parser raises: the last two where a source is nested deeper than it can follow.
UNREADABLE = (SyntaxError, ValueError, MemoryError, RecursionError)


def _tree(source: str) -> tuple[ast.Module, bool]:
    """The tree of the source, or of as many of its leading lines as parse, and whether it is whole."""
    try:
        return ast.parse(source), True
    except UNREADABLE as error:
        lines = source.split("\n")
        at = getattr(error, "lineno", None)
        last = min(len(lines), at - 1) if at else len(lines) * 3 // 4
        while last > 0:
            try:
                return ast.parse("\n".join(lines[:last])), False
            except UNREADABLE:
                last = last - 1 if last < 64 else last * 3 // 4
        return ast.Module([], []), False


def extract(path: str, source: str) -> Extraction:
    out = Extraction(path, "python", source)
    tree, whole = _tree(source)
    out.partial = not whole
    raw = source.encode("utf-8", "surrogatepass")
    begins = [0]
    for line in raw.split(b"\n"):
        begins.append(begins[-1] + len(line) + 1)

    plain = len(raw) == len(source)

    def at(line: int, column: int) -> int:
        if plain:
            return min(begins[line - 1] + column, len(raw))
        return len(raw[: begins[line - 1] + column].decode("utf-8", "replace"))

    def span(node: ast.AST) -> tuple[int, int]:
        first = min([node, *getattr(node, "decorator_list", [])], key=lambda n: (n.lineno, n.col_offset))
        start = at(first.lineno, first.col_offset)
        return (start - 1 if first is not node and source[start - 1 : start] == "@" else start), at(node.end_lineno, node.end_col_offset)

    def dotted(node: ast.AST) -> str | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None

    def shown(node: ast.AST) -> str:
        """The source of a node; of one that is nested too deep, its name alone."""
        try:
            return ast.unparse(node)
        except RecursionError:
            return "?." + getattr(node, "attr", "?")

    def calls(node: ast.AST, owner: str) -> None:
        """Calls under a node, those in nested functions and classes aside. Expressions may be nested deep: no recursion."""
        todo = [node]
        while todo:
            node = todo.pop()
            if isinstance(node, ast.Call):
                if isinstance(node.func, ast.Name):
                    out.relation(owner, node.func.id, "CALLS", at(node.lineno, node.col_offset))
                elif isinstance(node.func, ast.Attribute):
                    out.relation(owner, node.func.attr, "CALLS", at(node.lineno, node.col_offset), {"expression": shown(node.func)})
            todo += [c for c in reversed([*ast.iter_child_nodes(node)]) if not isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]

    def imported(node: ast.Import | ast.ImportFrom) -> None:
        start = at(node.lineno, node.col_offset)
        if isinstance(node, ast.Import):
            for a in node.names:
                out.relation(out.file_id, a.name, "IMPORTS", start, {"names": [a.asname or a.name.split(".")[0]]})
        else:
            out.relation(out.file_id, "." * node.level + (node.module or ""), "IMPORTS", start, {"names": [a.asname or a.name for a in node.names]})

    def visit(nodes: list[ast.stmt], scope: list[str], parent: str, owner: str, in_class: bool, top: bool) -> None:
        for node in nodes:
            if isinstance(node, ast.Import | ast.ImportFrom):
                imported(node)
            elif isinstance(node, ast.ClassDef):
                start, end = span(node)
                bases = [b for b in map(dotted, node.bases) if b]
                own = out.entity("CLASS", node.name, ".".join([*scope, node.name]), start, end, parent, signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), documentation=ast.get_docstring(node), exported=not node.name.startswith("_"))
                for b in bases:
                    out.relation(own, b.rpartition(".")[2], "EXTENDS", start)
                for d in node.decorator_list:
                    calls(d, owner)
                visit(node.body, [*scope, node.name], own, owner, True, True)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                start, end = span(node)
                asynchronous = isinstance(node, ast.AsyncFunctionDef)
                head = f"{'async ' if asynchronous else ''}def {node.name}({shown(node.args)})" + (f" -> {shown(node.returns)}" if node.returns else "")
                own = out.entity("METHOD" if in_class else "FUNCTION", node.name, ".".join([*scope, node.name]), start, end, parent, signature=head, documentation=ast.get_docstring(node), exported=not node.name.startswith("_"), metadata={"async": True} if asynchronous else None)
                for d in node.decorator_list:
                    calls(d, owner)
                for default in [*node.args.defaults, *filter(None, node.args.kw_defaults)]:
                    calls(default, own)
                visit(node.body, [*scope, node.name], own, own, False, False)
            else:
                target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) else None
                if top and isinstance(target, ast.Name):
                    start, end = span(node)
                    upper = target.id.upper() == target.id and target.id[:1].isalpha()
                    out.entity("CONSTANT" if upper else "VARIABLE", target.id, ".".join([*scope, target.id]), start, end, parent, exported=not target.id.startswith("_"))
                bodies = [getattr(node, f) for f in ("body", "orelse", "finalbody") if isinstance(getattr(node, f, None), list)] + [h.body for h in getattr(node, "handlers", [])] + [c.body for c in getattr(node, "cases", [])]
                if bodies:
                    for field, value in ast.iter_fields(node):
                        if field not in ("body", "orelse", "finalbody", "handlers", "cases"):
                            for child in value if isinstance(value, list) else [value]:
                                if isinstance(child, ast.AST):
                                    calls(child, owner)
                    for b in bodies:
                        visit(b, scope, parent, owner, in_class, top)
                else:
                    calls(node, owner)

    try:
        visit(tree.body, [], out.file_id, out.file_id, False, True)
    except RecursionError:  # statements nested deeper than the interpreter follows, as in a very long chain of elif
        out.partial = True
    return out
