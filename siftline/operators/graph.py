"""Code graph: symbols, calls, imports, types and hierarchy of files, and resolved call edges.

Files are parsed in Arrow batches; everything after that is joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import Rounds, ship, written
from siftline.sources import syntax as S

#: A column of lists of facts, for Spark and for Arrow.
_FACT = "kind:string,name:string,qualified:string,detail:string,line:long,start:long,has_body:boolean,owner:string,owner_line:long,other:string"
FACTS = f"facts array<struct<{_FACT}>>"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.list_(pa.struct([(name, _TYPES[kind]) for name, _, kind in (f.partition(":") for f in _FACT.split(","))]))

#: Files whose rows a worker holds at once.
PART = 256


#: Kinds of nodes that declare a type.
TYPES = {"class_declaration", "interface_declaration", "enum_declaration", "record_declaration", "class_definition"}


def _facts(tree: S.Tree) -> list[tuple]:
    """(kind, name, qualified, detail, line, start, has_body, owner, owner_line, other) of a file."""
    methods, calls, declared = S.METHODS[tree.family], S.CALLS[tree.family], S.DECLARATIONS[tree.family] if tree.family in ("java", "javascript") else ()
    told = {*methods, *calls, *declared, *TYPES, "call", "import_statement", "import_from_statement"}
    out: list[tuple] = []

    def walk(n: S.Node, types: tuple[str, ...], owner: S.Node | None, depth: int) -> None:
        if depth > S.DEPTH:
            return
        if n.kind in told:
            types, owner = tell(n, types, owner)
        for c in n.children:
            walk(c, types, owner, depth + 1)

    def tell(n: S.Node, types: tuple[str, ...], owner: S.Node | None) -> tuple[tuple[str, ...], S.Node | None]:
        """Notes what a node says; the types and the function that its children are in."""
        line = tree.line(n.start)
        place = (owner.name, tree.line(owner.start)) if owner is not None else (None, None)
        if n.kind in methods and n.name:
            kind = "constructor" if n.kind == "constructor_declaration" else "method" if types else "function"
            out.append(("symbol", n.name, ".".join([*types, n.name]), kind, line, n.start, "body" in n.fields, None, None, None))
            for p in n.fields["parameters"].children if "parameters" in n.fields else []:
                t = p.fields.get("type")
                if t is not None and t.name:
                    out.append(("type", p.name, None, t.name, line, p.start, None, n.name, line, None))
            owner = n
        elif n.kind in TYPES:
            above = {k: n.fields[k].name if k in n.fields else None for k in ("extends", "implements")}
            out.append(("class", n.name, None, above["extends"], line, n.start, None, None, None, above["implements"]))
            if tree.family != "python":
                types = (*types, n.name)
            owner = None
        elif n.kind in calls and n.name:
            text = tree.text(n)[: max(0, n.fields["arguments"].start - n.start)].strip() if "arguments" in n.fields else n.name
            held = n.fields["object"].name if "object" in n.fields else text.rpartition(".")[0] if "." in text else None
            if owner is not None:
                out.append(("call", n.name, None, text, line, n.start, None, *place, held))
        elif n.kind == "call" and "function" in n.fields:
            text = tree.text(n.fields["function"])
            if owner is not None:
                out.append(("call", text.rsplit(".", 1)[-1], None, text, line, n.start, None, *place, text.rpartition(".")[0] or None))
        elif n.kind in ("import_statement", "import_from_statement"):
            for c in n.children:
                local, _, original = c.name.partition("=")
                module = n.name or original
                out.append(("import", local, None, module, line, n.start, None, None, None, original if n.name else "*"))
        elif n.kind in declared and "type" in n.fields:
            out.append(("type", n.name, None, n.fields["type"].name, line, n.start, None, place[0], place[1] or 0, None))
        return types, owner

    walk(tree.root, (), None, 0)
    return out


def told(tree: S.Tree) -> list[tuple]:
    """The facts of a parsed file, and an issue if not all of it could be read."""
    try:
        found = _facts(tree)
    except RecursionError:
        return [_issue("nesting is too deep")]
    return [*found, _issue("syntax tree contains errors; analysis is incomplete")] if tree.error else found


def _issue(text: str) -> tuple:
    return ("issue", "parse", None, text, *[None] * 6)


def listed(values: Iterable[list[tuple]], kind: pa.DataType = _ARROW) -> pa.Array:
    """A column of lists of structures, the facts of files, say, built field by field."""
    offsets, flat, fields = [0], [], list(kind.value_type)
    for v in values:
        flat += v
        offsets.append(len(flat))
    columns = zip(*flat, strict=True) if flat else [[]] * len(fields)
    held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held)


def read(text: str | None, language: str) -> list[tuple]:
    """The facts of a file; none where it isn't code."""
    if text is None or language not in S.EXTENSIONS.values():
        return []
    try:
        return told(S.Tree(text, language))
    except RecursionError:
        return [_issue("nesting is too deep")]


def parsed(corpus: DataFrame, *kept: str) -> DataFrame:
    """Files (file_id, path, language, text) with the list of their facts instead of the text, a row a file.

    ``kept``: further columns of strings of the files.
    """
    ship(corpus.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            *own, language, text = batch.columns
            found = listed(map(read, text.to_pylist(), language.to_pylist()))
            yield pa.RecordBatch.from_arrays([*own, language, found], [*batch.schema.names[:-1], "facts"])

    schema = ", ".join(["file_id long, path string", *(f"{c} string" for c in (*kept, "language")), FACTS])
    return corpus.select("file_id", "path", *kept, "language", "text").mapInArrow(run, schema)


def facts(corpus: DataFrame) -> DataFrame:
    """All facts of files (file_id, path, language, text) as one table; ``kind`` tells them apart."""
    return each(parsed(corpus))


def each(files: DataFrame) -> DataFrame:
    """A row for each of the facts that files hold as lists."""
    own = files.select("file_id", "path", "language", F.explode("facts").alias("f"))
    return own.select("f.kind", "file_id", "path", "language", *[f"f.{c}" for c in ("name", "qualified", "detail", "line", "start", "has_body", "owner", "owner_line", "other")])


def symbols(all_: DataFrame) -> DataFrame:
    ident = F.xxhash64("file_id", "start", "qualified").alias("symbol_id")
    return all_.filter("kind = 'symbol'").select(ident, "name", F.col("qualified").alias("qualified_name"), F.col("detail").alias("kind"), "file_id", "path", "line", "start", "language", "has_body")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), r"/(index|__init__)$", "")


def _joined_path(base: Column, relative: Column) -> Column:
    """``relative`` from the folder of ``base``, with . and .. taken out."""
    raw = F.concat_ws("/", F.regexp_replace(base, r"/?[^/]*$", ""), relative)
    parts = F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def imports(all_: DataFrame) -> DataFrame:
    """(file_id, local, original, target): target is the stem that a module path names, seen from its file."""
    return _bindings(all_).drop("exact").distinct()


def _bindings(all_: DataFrame) -> DataFrame:
    """:func:`imports`, with the path that an import names where it gives an extension."""
    module = F.col("detail")
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)
    python = _joined_path(F.col("path"), relative)
    script = F.when(module.startswith("."), _joined_path(F.col("path"), F.regexp_replace(module, r"\.(js|jsx|ts|tsx|mjs|cjs)$", ""))).otherwise(module)
    target = F.when(F.col("language") == "python", python).otherwise(script)
    return all_.filter("kind = 'import'").select("file_id", F.col("name").alias("local"), F.col("other").alias("original"), _stem(target).alias("target"), F.when(module.startswith("."), _joined_path(F.col("path"), module)).alias("exact")).distinct()


# Extensions that an import without one may mean, in order; of each the file itself comes before the index file of a folder.
IMPORTED = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "pyw")


def import_files(all_: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, local, original, target_file, target_path, rank): the file that each import means; ``files``: file_id, path.

    Files meet imports at their path without extension and index name, so an import meets only the few that it may mean; the
    least rank is kept; a file that an import names with its extension comes first.  Where there is none, a file beside the importing one counts that has the last name of the import.
    """
    # Written: two joins read it, and what it is made of may be a parse.
    own = written(_bindings(all_).join(files.select("file_id", F.col("path").alias("from")), "file_id"))
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    index = F.col("path").rlike(r"/(index|__init__)\.[A-Za-z0-9]+$")
    order = F.create_map(*[F.lit(x) for i, e in enumerate(IMPORTED) for x in (e, 2 * i)])[extension]
    known = files.select(F.col("file_id").alias("target_file"), F.col("path").alias("target_path"), _stem(F.col("path")).alias("target"), (order + index.cast("int")).alias("rank"))
    exact = known.filter("rank IS NOT NULL").join(own, "target").select("file_id", "local", "original", "target_file", "target_path", F.when(F.col("target_path") == F.col("exact"), -1).otherwise(F.col("rank")).alias("rank"))
    folder, last = lambda p: F.regexp_replace(p, r"/?[^/]*$", ""), lambda p: F.regexp_extract(p, r"([^/]*)$", 1)
    beside = files.groupBy(folder(F.col("path")).alias("folder"), F.regexp_replace(last(F.col("path")), r"\.[^.]*$", "").alias("stem")).agg(F.min(F.struct("path", "file_id")).alias("b"))
    near = own.withColumns({"folder": folder(F.col("from")), "stem": last(F.col("target"))}).join(beside, ["folder", "stem"])
    near = near.select("file_id", "local", "original", F.col("b.file_id").alias("target_file"), F.col("b.path").alias("target_path"), F.lit(2 * len(IMPORTED)).alias("rank"))
    least = exact.unionByName(near).groupBy("file_id", "local", "original").agg(F.min(F.struct("rank", "target_path", "target_file")).alias("m"))
    return least.select("file_id", "local", "original", "m.target_file", "m.target_path", "m.rank")


def ancestors(all_: DataFrame) -> DataFrame:
    """(type, ancestor, depth): superclasses and interfaces of each class, itself at depth 0."""
    classes = all_.filter("kind = 'class'")
    up = F.explode(F.filter(F.split(F.concat_ws(",", "detail", "other"), ","), lambda x: x != ""))
    above = classes.select(F.col("name").alias("type"), up.alias("ancestor")).filter("type != ancestor")
    own = classes.select(F.col("name").alias("type"), F.col("name").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    known = written(above.groupBy("type").agg(F.collect_set("ancestor").alias("near")).select("type", F.array("near").alias("levels")))
    reach = 1
    while not known.filter(F.size("levels") == reach).isEmpty():
        known, reach = written(_further(known, reach)), 2 * reach
    return own.unionByName(known.select("type", F.posexplode("levels").alias("i", "level")).select("type", F.explode("level").alias("ancestor"), (F.col("i") + 1).alias("depth")))


def _further(known: DataFrame, reach: int) -> DataFrame:
    """``known`` (type, levels), levels being the types at each depth from 1 to ``reach``, with those up to twice as far.

    What is farther lies above a type at just that depth, so a round doubles the depth and moves each type's levels twice.
    """
    ends, going = known.filter(F.size("levels") < reach), known.filter(F.size("levels") == reach)
    steps = going.select("type", "levels", F.explode(F.element_at("levels", -1)).alias("at"), (F.size(F.element_at("levels", -1)) == 1).alias("single"))
    met = steps.join(known.select(F.col("type").alias("at"), F.col("levels").alias("more")), "at", "left").withColumn("more", F.coalesce("more", F.expr("CAST(array() AS array<array<string>>)")))
    # Types with several at that depth are gathered; the others stay where they are.
    many = met.filter("NOT single").groupBy("type").agg(F.any_value("levels").alias("levels"), F.collect_list("more").alias("more"))
    every = met.filter("single").select("type", "levels", F.array("more").alias("more")).unionByName(many)
    seen = "concat(array(type), flatten(levels))"
    level = "array_except(array_distinct(flatten(transform(more, m -> coalesce(get(m, i), CAST(array() AS array<string>))))), acc.seen)"
    added = f"""CASE WHEN size(more) = 1 AND NOT arrays_overlap({seen}, flatten(more[0])) THEN more[0]
        ELSE aggregate(sequence(0, {reach - 1}), named_struct('seen', {seen}, 'out', CAST(array() AS array<array<string>>)),
                       (acc, i) -> named_struct('seen', concat(acc.seen, {level}), 'out', concat(acc.out, array({level}))), acc -> filter(acc.out, l -> size(l) > 0)) END"""
    return ends.unionByName(every.select("type", F.expr(f"concat(levels, {added})").alias("levels")))


def edges(corpus: DataFrame, all_: DataFrame | None = None, calls: DataFrame | None = None, by_name: bool = True) -> DataFrame:
    """(edge_id, file_id, line, caller_symbol, callee_text, callee_symbol, how): calls with what they resolve to.

    ``calls`` (file_id, name) narrows it to calls of these names in these files; without ``by_name`` a name alone resolves to nothing.

    First of: the import that binds a plain name, the namespace a method is
    called on, the declared type of the receiver (then its ancestors, then
    classes below it), and any symbol of that name, one of the same file first.
    """
    all_ = all_ if all_ is not None else written(facts(corpus))
    syms = written(symbols(all_))
    made = all_.filter("kind = 'call'")
    made = made if calls is None else made.join(calls, ["file_id", "name"], "left_semi")
    calls = made.select(F.xxhash64("file_id", "start", "detail").alias("edge_id"), "file_id", "line", "name", F.col("detail").alias("callee_text"), F.col("other").alias("held"), "owner", "owner_line")
    callers = syms.groupBy("file_id", F.col("line").alias("owner_line"), F.col("name").alias("owner")).agg(F.max_by("symbol_id", "start").alias("caller_symbol"))
    calls = written(calls.join(callers, ["file_id", "owner_line", "owner"]).dropDuplicates(["edge_id"]))
    bound = written(import_files(all_, corpus.select("file_id", "path")))
    in_file = syms.groupBy(F.col("file_id").alias("target_file"), F.col("name").alias("symbol_name")).agg(F.min_by("symbol_id", "start").alias("symbol_id"))

    named = calls.filter("held IS NULL").join(bound.filter("original != '*'"), (calls["file_id"] == bound["file_id"]) & (calls["name"] == bound["local"]))
    named = named.select("edge_id", "target_file", F.explode(F.array_distinct(F.array("original", "local"))).alias("symbol_name"), (F.col("symbol_name") == F.col("original")).alias("first"))
    spaced = calls.filter("held IS NOT NULL").join(bound, (calls["file_id"] == bound["file_id"]) & (calls["held"] == bound["local"]))
    spaced = spaced.select("edge_id", "target_file", F.col("name").alias("symbol_name"))

    def best(found: DataFrame, how: str, rank: int) -> DataFrame:
        return found.groupBy("edge_id").agg(F.min(F.struct(*[c for c in found.columns if c not in ("edge_id", "symbol_id")], "symbol_id")).alias("b")).select("edge_id", F.lit(rank).alias("rank"), F.lit(how).alias("how"), "b.symbol_id")

    by_import = best(named.join(in_file, ["target_file", "symbol_name"]).select("edge_id", (~F.col("first")).alias("late"), "symbol_id"), "import", 0)
    by_space = best(spaced.join(in_file, ["target_file", "symbol_name"]).select("edge_id", "symbol_id"), "namespace", 1)

    types = all_.filter("kind = 'type'").select("file_id", F.col("owner_line").alias("type_line"), F.col("name").alias("held"), F.col("detail").alias("type"))
    typed = calls.join(types, ["file_id", "held"]).filter("type_line = owner_line OR type_line = 0")
    typed = typed.select("edge_id", "name", (F.col("type_line") == 0).alias("wide"), "type")
    up = ancestors(all_)
    down = up.filter("depth > 0").select(F.col("ancestor").alias("type"), F.col("type").alias("ancestor"), (F.col("depth") + 1000).alias("depth"))
    qualified = syms.filter(F.col("qualified_name").contains(".")).select(F.element_at(F.split("qualified_name", r"\."), -2).alias("ancestor"), "name", (~F.col("has_body")).alias("bare"), "symbol_id")
    by_type = typed.join(up.unionByName(down), "type").join(qualified, ["ancestor", "name"]).select("edge_id", "bare", "wide", "depth", "symbol_id")
    by_type = best(by_type, "type", 2)

    every = by_import.unionByName(by_space).unionByName(by_type)
    if by_name:
        # One symbol a name, and one a name and file, are chosen before any call meets them: no name brings all its pairs.
        first = F.min(F.struct("path", "start", "symbol_id"))
        anywhere, here = syms.groupBy("name").agg(first.alias("any")), syms.groupBy("name", "file_id").agg(first.alias("here"))
        met = calls.select("edge_id", "name", "file_id").join(anywhere, "name").join(here, ["name", "file_id"], "left")
        every = every.unionByName(met.select("edge_id", F.lit(3).alias("rank"), F.lit("name").alias("how"), F.coalesce("here.symbol_id", "any.symbol_id").alias("symbol_id")))
    chosen = every.groupBy("edge_id").agg(F.min(F.struct("rank", "how", "symbol_id")).alias("c"))
    return calls.join(chosen, "edge_id", "left").select("edge_id", "file_id", "line", "caller_symbol", "callee_text", F.col("c.symbol_id").alias("callee_symbol"), F.col("c.how").alias("how"))


def closure(calls: DataFrame) -> DataFrame:
    """(caller, callee): everything each caller reaches, by joining only what a round has added."""
    step = written(calls.select("caller", "callee").distinct())
    known = Rounds(calls.sparkSession, "closure")
    fresh = known.add(step)
    while not fresh.isEmpty():
        ahead = fresh.join(step.select(F.col("caller").alias("callee"), F.col("callee").alias("next")), "callee").select("caller", F.col("next").alias("callee")).distinct()
        fresh = known.add(ahead.join(known.all(), ["caller", "callee"], "left_anti"))
    return known.all()


def changed(now: DataFrame, was: DataFrame) -> DataFrame:
    """Rows (path, source_hash) of one snapshot that the other lacks; unhashable files (null) don't count."""
    a, b = (x.select("path", "source_hash").filter("source_hash IS NOT NULL") for x in (now, was))
    return a.exceptAll(b)


def same_files(now: DataFrame, was: DataFrame) -> bool:
    """Whether two snapshots (path, source_hash) name the same files."""
    return changed(now, was).isEmpty() and changed(was, now).isEmpty()
