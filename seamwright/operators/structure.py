"""Code structure: chunks of Python sources, spans and their parents, relation graph, bounded walks.

Spans of one file are compared by a sweep over the sorted spans that holds a stack of the open
ones, so no pairs of a file's spans are emitted.  The relation graph is built by one pass over each file and
resolved by joins with the symbol table of its snapshot.
"""

from __future__ import annotations

import ast
import builtins
import warnings
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import compared_path
from ..functions.text import module_name
from ..session import checkpointed, spread, written

CHUNK_SCHEMA = (
    "file_id long, path string, chunk_type string, symbol_name string, qualified_name string, parent_symbol string, start_line int, end_line int, content string, content_hash string"
)
REFERENCE_SCHEMA = "file_id long, path string, project_id string, relation string, name string, level int, source_symbol string, line int, alias string"


def _tree(text: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _walk(tree: ast.Module):
    """(node, enclosing names, whether directly in a class) of every definition and statement, in order."""
    stack = [(n, (), False) for n in reversed(tree.body)]
    while stack:
        node, names, in_class = stack.pop()
        yield node, names, in_class
        inner, cls = names, in_class
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner, cls = (*names, node.name), isinstance(node, ast.ClassDef)
        stack.extend((c, inner, cls) for c in reversed(list(ast.iter_child_nodes(node))))


def chunk_rows(text: str) -> list[tuple]:
    """(type, name, qualified, parent, start, end, content, hash) of every function, method and class."""
    tree = _tree(text)
    if tree is None:
        return []
    lines, out = text.splitlines(keepends=True), []
    for node, names, in_class in _walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        if isinstance(node, ast.ClassDef):
            kind = "class"
        else:
            kind = ("async_" if isinstance(node, ast.AsyncFunctionDef) else "") + ("method" if in_class else "function")
        if node.end_lineno > len(lines):
            continue
        content = "".join(lines[start - 1 : node.end_lineno])
        out.append((kind, node.name, ".".join((*names, node.name)), ".".join(names), start, node.end_lineno, content, sha256(content.encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def reference_rows(text: str) -> list[tuple]:
    """(relation, name, level, source symbol, line, alias): definitions, imports, calls and base classes of a file.

    A base belongs to its class; a definition's name is its qualified name.
    """
    tree = _tree(text)
    out: list[tuple] = []
    if tree is None:
        return out

    def dotted(e) -> str | None:
        parts = []
        while isinstance(e, ast.Attribute):
            parts.append(e.attr)
            e = e.value
        return ".".join([e.id, *reversed(parts)]) if isinstance(e, ast.Name) else None

    for node, names, _ in _walk(tree):
        at = ".".join(names)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("defines", ".".join((*names, node.name)), 0, at, node.lineno, None))
        if isinstance(node, ast.Import):
            out.extend(("imports", a.name, 0, at, node.lineno, a.asname or a.name.split(".")[0]) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.extend(("imports", ".".join(filter(None, (node.module, a.name))), node.level, at, node.lineno, a.asname or a.name) for a in node.names)
        elif isinstance(node, ast.Call):
            name = dotted(node.func)
            if name:
                out.append(("calls", name, 0, at, node.lineno, None))
        elif isinstance(node, ast.ClassDef):
            out.extend(("references", name, 0, ".".join((*names, node.name)), node.lineno, None) for b in node.bases if (name := dotted(b)))
    return out


def _per_file(files: DataFrame, fn, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows ``fn`` gives for each Python text, behind file_id, path and the columns ``keep`` (strings)."""
    types = files.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in arrow]
            for text, *key in zip(*(c.to_pylist() for c in batch.columns)):
                for row in fn(text):
                    for c, v in zip(columns, (*key, *row)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = files.select("content", "id", compared_path(F.col("path")).alias("path"), *keep).where(F.col("path").endswith(".py") & F.col("content").isNotNull())
    return spread(rows).mapInArrow(run, types)


def python_chunks(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every function, method and class of the Python files that parse; a file that does not gives none."""
    front, _, back = CHUNK_SCHEMA.partition(", chunk_type")
    return _per_file(files, chunk_rows, ", ".join((front, *(f"{c} string" for c in keep))) + ", chunk_type" + back, keep)


def profile_rows(text: str) -> list[tuple]:
    """(imports, symbols): the top packages a text imports, sorted, and its first 40 definitions, outer ones first."""
    tree = _tree(text)
    if tree is None:
        return [([], [])]
    imports, symbols = set(), []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports.update(a.name.split(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.add(node.module.split(".")[0])
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            symbols.append(node.name)
    return [(sorted(imports), symbols[:40])]


def python_profiles(files: DataFrame) -> DataFrame:
    """(file_id, path, imports, symbols) of every Python file with a content; empty for one that does not parse."""
    return _per_file(files, profile_rows, "file_id long, path string, imports array<string>, symbols array<string>")


def latest_ready(projects: DataFrame) -> DataFrame:
    """Id and revision of each repository's latest ready revision.

    A revision counts from its first delivery, and that delivery's id stands for it; ties by id.
    """
    rows = projects.where("status = 'ready'").select(F.lower(F.concat_ws("/", "owner", "repo")).alias("repository"), "id", "repository_revision", "created_at")
    first = rows.groupBy("repository", "repository_revision").agg(F.min(F.struct("created_at", "id")).alias("at"))
    last = first.groupBy("repository").agg(F.max(F.struct("at", "repository_revision")).alias("b"))
    return last.select(F.col("b.at.id").alias("project_id"), F.col("b.repository_revision").alias("repository_revision"))


def indexed_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """The Python files of the latest ready snapshots; of a path delivered twice the smallest id counts.

    Ids are chosen on narrow columns before contents are moved.
    """
    path = compared_path(F.col("path"))
    mine = files.where(path.endswith(".py") & F.col("content").isNotNull()).join(latest_ready(projects).select("project_id"), "project_id", "left_semi")
    first = mine.groupBy("project_id", path.alias("p")).agg(F.min("id").alias("id"))
    return spread(mine.join(first.select("id"), "id", "left_semi"), files)


def indexed_chunks(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Chunks of ``indexed_files``."""
    return python_chunks(indexed_files(files, projects), ("project_id",)).drop("file_id")


# ---------------------------------------------------------------------------- spans
SCOPE = ("project_id", "repository_revision", "path")


def _swept(rows: DataFrame, order: list, schema: str, visit) -> DataFrame:
    """Rows of a file in ``order``, file by file, through ``visit(stack, row)``, which yields result rows.

    A partition holds one file's open spans at a time, however many spans the file has.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, stack = None, []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                at = row[:3]
                if at != scope:
                    scope, stack = at, []
                out.extend(visit(stack, row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*SCOPE).sortWithinPartitions(*SCOPE, *order).mapInPandas(sweep, schema)


def span_parents(chunks: DataFrame) -> DataFrame:
    """(id, parent_id, authority, ambiguous): the parent chunk of every chunk within its file.

    A chunk that names its parent takes the smallest chunk of that name that strictly
    contains it; one that names none the smallest that strictly contains it.  Several of the
    smallest size, or a named parent that is not there, make it ambiguous.  Spans come in
    order of their start, wider ones first, and those still open are the candidates.
    """
    rows = chunks.select(*SCOPE, "start_line", "end_line", "id", F.coalesce("parent_symbol", F.lit("")).alias("named"), "qualified_name")

    def visit(stack: list, row) -> Iterator[tuple]:
        start, end, key, named, name = row[3:]
        if start is None or end is None:
            yield key, None, None, named != ""
            return
        while stack and stack[-1][1] < start:
            stack.pop()
        best, many, found = None, 0, None
        for s, e, other, q in stack:
            if e >= end and (s, e) != (start, end) and (not named or q == named):
                size = e - s + 1
                if best is None or size < best:
                    best, many, found = size, 1, other
                elif size == best:
                    many += 1
        unsure = many > 1 or (named != "" and best is None)
        parent = None if unsure else found
        yield key, parent, None if parent is None else "explicit_structural_metadata" if named else "span_inference", unsure
        # a span that ends before others is put below them, so that what is over comes off the top
        at = len(stack)
        while at and stack[at - 1][1] < end:
            at -= 1
        stack.insert(at, (start, end, key, name))

    return _swept(rows, ["start_line", F.desc("end_line"), "id"], "id long, parent_id long, authority string, ambiguous boolean", visit)


def span_relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """How two spans of a file lie to each other."""
    return (
        F.when((s1 == s2) & (e1 == e2), "exact_span")
        .when((s1 <= s2) & (e1 >= e2), "contains")
        .when((s2 <= s1) & (e2 >= e1), "within")
        .when(F.greatest(s1, s2) <= F.least(e1, e2), "partial_overlap")
        .otherwise("disjoint")
    )


def span_sequence(chunks: DataFrame) -> DataFrame:
    """(id, before, relation): each chunk against the one before it in its file (start, -end, name, id)."""
    order = Window.partitionBy(*SCOPE).orderBy("start_line", F.desc("end_line"), F.lower("qualified_name"), "id")
    prev = lambda c: F.lag(c).over(order)
    return chunks.select(
        "id", prev("id").alias("before"), span_relation(prev("start_line"), prev("end_line"), F.col("start_line"), F.col("end_line")).alias("r"), prev("id").isNotNull().alias("has")
    ).select("id", "before", F.when(F.col("has"), F.col("r")).alias("relation"))


def innermost_spans(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """(point_id, id): the smallest chunk around a line of a file; ties: later start, then id.

    Points and spans of a file are merged by line; at a point the open spans are the candidates.
    """
    scope = ["project_id", F.lit("").alias("repository_revision"), "path"]
    spans = chunks.select(*scope, F.col("start_line").cast("long").alias("line"), F.lit(0).alias("what"), F.col("end_line").cast("long").alias("end"), "id")
    asked = points.select(*scope, F.col("line").cast("long").alias("line"), F.lit(1).alias("what"), F.lit(0).cast("long").alias("end"), F.col("point_id").alias("id"))
    rows = spans.where("line IS NOT NULL AND end IS NOT NULL").unionByName(asked.where("line IS NOT NULL"))

    def visit(stack: list, row) -> Iterator[tuple]:
        line, what, end, key = row[3:]
        while stack and stack[-1][1] < line:
            stack.pop()
        if what == 0:
            at = len(stack)
            while at and stack[at - 1][1] < end:
                at -= 1
            stack.insert(at, (line, end, key))
        elif stack:
            open_ = [(e - s, -s, k) for s, e, k in stack if e >= line]
            if open_:
                yield key, min(open_)[2]

    return _swept(rows, ["line", "what", "id"], "point_id long, id long", visit)


def family_roots(parents: DataFrame, rounds: int = 16) -> DataFrame:
    """(id, root): the topmost ancestor of each chunk, by pointer doubling on the parent map.

    ``rounds`` doublings reach 2**rounds levels; ambiguous chunks are their own root.
    """
    at = parents.select("id", F.coalesce("parent_id", "id").alias("root"))
    for _ in range(rounds):
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = checkpointed(at.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        at = step.select("id", "root")
        if step.where("moved").isEmpty():
            break
    return at


def family_capped(ranked: DataFrame, roots: DataFrame, by: str, cap: int = 2, k: int = 8) -> DataFrame:
    """The first k of each list with at most ``cap`` of a family (same root), in the list's order."""
    rows = ranked.join(roots, "id", "left").withColumn("family", F.coalesce("root", "id"))
    inside = Window.partitionBy(by, "family").orderBy("place")
    kept = rows.withColumn("seat", F.row_number().over(inside)).where(F.col("seat") <= cap)
    order = Window.partitionBy(by).orderBy("place")
    return kept.withColumn("final", F.row_number().over(order).cast("long")).where(F.col("final") <= k).select(by, "id", "family", F.col("final").alias("place"))


# ---------------------------------------------------------------------------- relations
def definition_edges(chunks: DataFrame) -> DataFrame:
    """(source, target): file to top-level chunk, chunk to the chunks it defines, by qualified names."""
    file_node = F.concat_ws(":", F.lit("file"), "project_id", "path")
    node = F.concat_ws(":", F.lit("chunk"), F.col("id").cast("string"))
    rows = chunks.select("project_id", "path", "qualified_name", F.coalesce("parent_symbol", F.lit("")).alias("up"), file_node.alias("file"), node.alias("node"))
    named = rows.groupBy("project_id", "path", F.col("qualified_name").alias("up")).agg(F.min("node").alias("one"), F.max("node").alias("two"))
    return (
        rows.join(named, ["project_id", "path", "up"], "left")
        .select(F.when(F.col("one") == F.col("two"), F.col("one")).otherwise(F.col("file")).alias("source"), F.col("node").alias("target"))
        .where("source != target")
    )


def relation_edges(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Imports, calls and base classes of the latest snapshots, resolved against their symbols.

    Columns: project_id, path, relation, source_symbol, line, raw_name, status (resolved,
    ambiguous, unresolved, external), target_path, target_symbol.  A name is looked for in
    its own file, then by what the file imports (relative imports from its package), then
    among the built-ins; a name of several definitions gives one ambiguous row each.
    """
    snapshots = latest_ready(projects).select("project_id")
    mine = files.where("content IS NOT NULL AND project_id IS NOT NULL").join(snapshots, "project_id", "left_semi")
    module = lambda c: F.regexp_replace(module_name(c), r"^(?:src|lib)\.", "")
    # a file is parsed once: what it defines and what it refers to
    parsed = written(_per_file(spread(mine, files), reference_rows, REFERENCE_SCHEMA, ("project_id",)).drop("file_id").distinct())
    symbols = parsed.where("relation = 'defines'").select("project_id", "path", F.col("name").alias("qualified_name"), module(F.col("path")).alias("module")).distinct()
    modules = mine.select("project_id", compared_path(F.col("path")).alias("path")).where(F.col("path").endswith(".py")).distinct().withColumn("module", module(F.col("path")))
    refs = parsed.where("relation != 'defines'")
    # absolute names of relative imports
    package = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - F.col("level"), F.lit(0))), ".")
    full = F.when(F.col("level") > 0, F.concat_ws(".", F.nullif(package, F.lit("")), "name")).otherwise(F.col("name"))
    refs = refs.withColumn("full", F.regexp_replace(full, r"^(?:src|lib)\.", ""))
    # "import a.b" binds a itself; other imports bind what they name
    plain = (F.col("level") == 0) & (F.col("alias") == F.element_at(F.split("name", r"\."), 1))
    imported = refs.where("relation = 'imports'").select("project_id", "path", F.when(plain, F.col("alias")).otherwise(F.col("full")).alias("bound"), "alias")
    # names bound by imports are replaced by what they stand for
    head, tail = F.element_at(F.split("full", r"\."), 1), F.regexp_replace("full", r"^[^.]+", "")
    uses = refs.where("relation != 'imports'").withColumn("alias", head).withColumn("tail", tail)
    one = imported.groupBy("project_id", "path", "alias").agg(F.min("bound").alias("bound"))
    through = uses.join(one, ["project_id", "path", "alias"], "left").withColumn("full", F.coalesce(F.concat("bound", "tail"), "full")).select(
        "project_id", "path", "relation", "source_symbol", "line", F.col("name").alias("raw_name"), "full", F.col("bound").isNotNull().alias("by_import"), "alias"
    )
    direct = refs.where("relation = 'imports'").select("project_id", "path", "relation", "source_symbol", "line", F.col("name").alias("raw_name"), "full", F.lit(True).alias("by_import"), F.lit("").alias("alias"))
    every = through.unionByName(direct)
    # own file: the qualified name itself, or self.method within its class
    local_name = F.when(F.col("alias").isin("self", "cls"), F.concat(F.regexp_replace("source_symbol", r"\.?[^.]*$", ""), F.regexp_replace("full", r"^[^.]+", ""))).otherwise(F.col("full"))
    every = every.withColumn("key", F.when(F.col("by_import"), F.col("full")).otherwise(F.concat(F.lit(":"), "path", F.lit(":"), local_name)))
    targets = (
        symbols.select("project_id", F.concat(F.lit(":"), "path", F.lit(":"), "qualified_name").alias("key"), F.col("path").alias("target_path"), F.col("qualified_name").alias("target_symbol"))
        .unionByName(symbols.select("project_id", F.concat_ws(".", "module", "qualified_name").alias("key"), F.col("path").alias("target_path"), F.col("qualified_name").alias("target_symbol")))
        .unionByName(modules.select("project_id", F.col("module").alias("key"), F.col("path").alias("target_path"), F.lit("").alias("target_symbol")))
        .distinct()
    )
    counted = targets.withColumn("n", F.count("*").over(Window.partitionBy("project_id", "key")))
    own_heads = modules.select("project_id", F.element_at(F.split("module", r"\."), 1).alias("top")).distinct().withColumn("ours", F.lit(True))
    found = every.join(counted, ["project_id", "key"], "left").withColumn("top", F.element_at(F.split("full", r"\."), 1)).join(own_heads, ["project_id", "top"], "left")
    status = (
        F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous")
        .when(F.col("by_import") & F.col("ours").isNull() | F.col("alias").isin(*dir(builtins)), "external").otherwise("unresolved")
    )
    return found.select("project_id", "path", "relation", "source_symbol", "line", "raw_name", status.alias("status"), "target_path", "target_symbol")


def relation_links(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """(source, target, relation, place): definition edges and resolved relations between nodes as in ``definition_edges``.

    ``relations`` as of ``relation_edges``; only resolved ones count.  A symbol that several
    chunks of a file bear gives no node, one without a chunk neither; module level is the
    file.  ``place`` orders the edges of a node: by path, line, relation and name.
    """
    file_node = lambda path: F.concat_ws(":", F.lit("file"), "project_id", path)
    node = F.concat_ws(":", F.lit("chunk"), F.col("id").cast("string"))
    order = lambda path, line, relation, name, to: F.struct(path.alias("path"), line.cast("long").alias("line"), relation.alias("relation"), name.alias("name"), to.alias("to"))
    rows = chunks.select(node.alias("target"), "path", "start_line", "qualified_name")
    defined = definition_edges(chunks).join(rows, "target").select("source", "target", F.lit("defines").alias("relation"), order(F.col("path"), F.col("start_line"), F.lit("defines"), F.col("qualified_name"), F.col("target")).alias("place"))
    one = chunks.groupBy("project_id", "path", "qualified_name").agg(F.min(node).alias("node"), F.count("*").alias("n")).where("n = 1").drop("n")
    at = lambda side, path, symbol: one.select("project_id", F.col("path").alias(path), F.col("qualified_name").alias(symbol), F.col("node").alias(side))
    found = relations.where("status = 'resolved'").join(at("from_node", "path", "source_symbol"), ["project_id", "path", "source_symbol"], "left").join(at("to_node", "target_path", "target_symbol"), ["project_id", "target_path", "target_symbol"], "left")
    source = F.when(F.col("source_symbol") == "", file_node("path")).otherwise(F.col("from_node"))
    target = F.when(F.col("target_symbol") == "", file_node("target_path")).otherwise(F.col("to_node"))
    related = found.select(source.alias("source"), target.alias("target"), "relation", order(F.col("path"), F.col("line"), F.col("relation"), F.col("raw_name"), target).alias("place"))
    return defined.unionByName(related.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct())


def bounded_walk(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node, depth): the nodes within ``depth`` edges of a seed, with the least depth.

    One join per level; a node is expanded once per seed, so cycles end.
    """
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    frontier, out = reached, reached
    links = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    for level in range(1, depth + 1):
        step = frontier.join(links, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = step.join(out.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(level))
        out = out.unionByName(frontier)
    return out
