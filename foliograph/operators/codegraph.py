"""Entities and edges of Python sources, and queries on them."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import written

EDGE = "path string, kind string, name string, owner string, line int, end_line int, edge string, target string"


def parse(sources: DataFrame) -> DataFrame:
    """One row an entity (edge null) or edge of files (path, text); files that don't parse give one row of kind ``error``."""

    def run(batches):
        for pdf in batches:
            out: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["text"]):
                module = path.rsplit(".", 1)[0].replace("/", ".")
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    out.append((path, "error", module, None, None, None, None, None))
                    continue
                out.append((path, "module", module, None, 1, len((text or "").split("\n")), None, None))

                def walk(node, owner):
                    for child in ast.iter_child_nodes(node):
                        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            name = f"{owner}.{child.name}"
                            kind = "class" if isinstance(child, ast.ClassDef) else "function"
                            out.append((path, kind, name, owner, child.lineno, child.end_lineno, None, None))
                            out.append((path, kind, name, owner, child.lineno, child.end_lineno, "owned_by", owner))
                            walk(child, name)
                            continue
                        if isinstance(child, ast.Import):
                            out.extend((path, "import", owner, owner, child.lineno, child.end_lineno, "imports", a.name) for a in child.names)
                        elif isinstance(child, ast.ImportFrom):
                            out.append((path, "import", owner, owner, child.lineno, child.end_lineno, "imports", child.module or "."))
                        elif isinstance(child, ast.Call):
                            f = child.func
                            callee = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                            if callee:
                                out.append((path, "call", owner, owner, child.lineno, child.end_lineno, "calls", callee))
                        walk(child, owner)

                walk(tree, module)
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in EDGE.split(", ")])
            yield frame.astype({"line": "Int32", "end_line": "Int32"})

    return sources.select("path", "text").mapInPandas(run, EDGE)


def entities(parsed: DataFrame) -> DataFrame:
    return parsed.where("edge is null and kind <> 'error'").select("path", "kind", "name", "owner", "line", "end_line")


def who_calls(parsed: DataFrame) -> DataFrame:
    """(caller, callee): calls resolved by short name to all functions and classes that have it."""
    calls = parsed.where("edge = 'calls'").select(F.col("name").alias("caller"), "target")
    defined = entities(parsed).where("kind in ('function', 'class')").select(F.element_at(F.split("name", r"\."), -1).alias("target"), F.col("name").alias("callee"))
    return calls.join(defined, "target").select("caller", "callee").distinct()


def dependants(edges: DataFrame, changed: DataFrame, rounds: int = 50) -> DataFrame:
    """(node): everything that reaches a changed node over edges src -> dst (src needs dst), the changed included."""
    reached = written(changed.select("node").distinct(), "dependants")
    frontier = reached
    for _ in range(rounds):
        fresh = edges.join(frontier, edges["dst"] == frontier["node"], "left_semi").select(F.col("src").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier = written(fresh, "dependants")
        if not frontier.limit(1).count():
            return reached
        reached = reached.unionByName(frontier)
    raise RuntimeError(f"dependants did not settle in {rounds} rounds")
