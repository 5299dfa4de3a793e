"""Data flow from sources to sinks, within functions and across files, as joins.

``operators.flow`` tells what each value is made of.  Here the texts of those
rows are held against the rules once, and two closures follow: forward from
sources (which values are tainted, since which line) and backward from sinks
(which parameters reach one).  Both start from few rows and carry on only what
a round has added, so a round reads the edges and moves little.  A finding is a
sink that tainted data reaches, or a call that hands it to a function from
which it reaches one.

A call means the functions of its name in its own file, those that the code
graph resolves it to, and all others of that name, an import's original name
included; of these the first that reaches a sink is named.  The graph is asked
only about names that several files define and the caller's own doesn't.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import flow, match
from siftline.operators.findings import innermost
from siftline.session import Rounds, Scratch, ship, spread, written
from siftline.sources import syntax as S
from siftline.sources.packs import Rule

#: Position of a function that leads to a sink from a source of its own, whatever it is given.
OWN = -1
NODE = ["file_id", "node", "rule"]


# Strings are looked for by one pattern a rule: a chain of conditions, a string each, makes methods that Java never compiles.
def _holds(text: Column, strings: tuple[str, ...]) -> Column:
    """Whether a text holds one of some strings."""
    quoted = ("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in strings)
    return F.coalesce(text.rlike("|".join(quoted)), F.lit(False))


def _first(text: Column, strings: tuple[str, ...], among: list[str]) -> Column:
    """The first of some strings that a text holds, as its place among others."""
    held = F.filter(F.array(*map(F.lit, strings)), lambda s: F.contains(text, s))
    return (F.array_position(F.array(*map(F.lit, among)), F.get(held, F.lit(0))) - 1).cast("int")


def _rules(rules: list[tuple[int, Rule]], attribute: str, text: Column) -> list[tuple[Column, Column]]:
    """Rules, each with whether a row is of its language and some string of an attribute is in a text; their ordinals."""
    return [(_language(r) & _holds(text, held), F.lit(i)) for i, r in rules for held in [getattr(r, attribute)] if held]


def _any(values: list[tuple[Column, Column]]) -> Column:
    """Whether some condition holds."""
    return reduce(or_, [condition for condition, _ in values], F.lit(False))


def _those(values: list[tuple[Column, Column]], kind: str = "int") -> Column:
    """An array of the values whose condition holds."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(none, *[F.when(condition, F.array(value)).otherwise(none) for condition, value in values])


def _language(rule: Rule) -> Column:
    return F.col("language").isin([x for x in dict.fromkeys(S.EXTENSIONS.values()) if rule.applies(x)])


class Flow:
    """The flow tables of a corpus under some rules."""

    def __init__(self, files: DataFrame, rules: list[Rule], facts: DataFrame | None = None):
        self.rules = [(i, r) for i, r in enumerate(rules) if r.capability == "taint" and r.sources and r.sinks]
        self.files, self.facts, self.spark = files, facts, files.sparkSession
        self.languages = [x for x in dict.fromkeys(S.EXTENSIONS.values()) if any(r.applies(x) for _, r in self.rules)]
        #: Tables say a sink by its place here; the order is that of the texts.
        self.sinks = sorted({s for _, r in self.rules for s in r.sinks})
        self.rows = written(self._judged(), by=("kind",))
        self.nodes = nodes = self.rows.filter(F.col("kind") != flow.FILE).drop("facts")
        used = nodes.select("file_id", "node", "kind", "fn", "line", "clean", F.explode("uses").alias("u"))
        used = used.select("file_id", F.col("u.def").alias("def"), "node", "kind", "fn", "line", "clean", "u.counts", "u.var", *[F.col(f"u.{c}").alias(f"def_{c}") for c in ("kind", "fn", "pos")])
        cleaned = nodes.filter((F.col("kind") == flow.DEF) & (F.size("clean") > 0)).select("file_id", F.col("node").alias("def"), F.col("clean").alias("def_clean"))
        none = F.array().cast("array<int>")
        # Uses know their definitions but for what rules say of them: only where a sanitizer cleans any do the two meet.
        judged = used.withColumn("def_clean", none) if cleaned.isEmpty() else used.join(cleaned, ["file_id", "def"], "left").withColumn("def_clean", F.coalesce("def_clean", none))
        #: A row for each definition that reaches a use, with what both of them are.
        self.edges = written(judged)
        self.functions = nodes.filter(F.col("kind") == flow.FUNCTION).select("file_id", "fn", "name", "path")
        self.calls = nodes.select("file_id", "node", "kind", "fn", "line", "clean", "applicable", F.explode("calls").alias("name"))
        names = F.explode(F.array_distinct(F.array_compact(F.array("name", "other"))))
        self.args = nodes.filter(F.col("kind") == flow.ARG).select("file_id", "node", "pos", "of", "applicable", F.transform("sinks", lambda s: s["rule"]).alias("blocked"), F.col("name").alias("shown"), names.alias("name"))
        self.sites = nodes.filter(F.col("kind") == flow.CALL).select("file_id", "node", "fn", "start", F.transform("sinks", lambda s: s["rule"]).alias("blocked"), F.col("name").alias("shown"), names.alias("name"))
        self.resolved = self._resolved()

    def _judged(self) -> DataFrame:
        """The rows of the files with what rules say of their texts, instead of the texts; rows that nothing can flow through go."""
        rows = flow.values(spread(self.files), self.languages, told=self.facts is None)
        text, kind, none = F.col("source_text"), F.col("kind"), F.array().cast("array<int>")
        given, brought, cleaned = (_rules(self.rules, x, text) for x in ("param_annotations", "sources", "sanitizers"))
        sunk = [(_language(r) & _holds(F.col("sink_text"), r.sinks), F.struct(F.lit(i).alias("rule"), _first(F.col("sink_text"), r.sinks, self.sinks).alias("sink"))) for i, r in self.rules]
        # Uses know what their parameter is, so only those that are sources are asked for; of an assignment as a whole, only sinks.
        source = F.when(kind == flow.PARAM, _any(given)).when(kind == flow.FUNCTION, False).otherwise(_any(brought))
        some = source | (F.size("uses") + F.size("calls") > 0)
        asked = rows.filter(kind.isin(flow.FUNCTION, flow.FILE) | some & ((kind != flow.ASSIGN) | _any(sunk)))
        return asked.select(
            *[c for c in rows.columns if not c.endswith("_text")],
            F.when(kind == flow.PARAM, _those(given)).when(kind == flow.FUNCTION, none).otherwise(_those(brought)).alias("source"),
            F.when(kind == flow.DEF, _those(cleaned)).otherwise(none).alias("clean"),
            _those(sunk, "struct<rule:int,sink:int>").alias("sinks"),
            _those([(_language(r), F.lit(i)) for i, r in self.rules]).alias("applicable"),
        )

    def _resolved(self) -> DataFrame | None:
        """(file_id, name, callee_file, callee_fn) of calls whose name several functions have, none of them in the same file."""
        from siftline.operators import graph

        several = self.functions.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
        away = self.nodes.filter(F.col("kind") == flow.CALL).select("file_id", F.explode("away").alias("name"), F.col("name").alias("shown"))
        away = written(away.join(several, "name", "left_semi").distinct())
        if away.isEmpty():
            return None
        facts = self.facts if self.facts is not None else written(flow.facts(self.rows), by=("kind",))
        sure = graph.edges(self.files, facts, calls=away.select("file_id", F.col("shown").alias("name")).distinct(), by_name=False).filter("how IS NOT NULL")
        symbols = graph.symbols(facts).select(F.col("symbol_id").alias("callee_symbol"), F.col("file_id").alias("callee_file"), F.col("start").alias("callee_fn"))
        sure = sure.select("file_id", F.element_at(F.split("callee_text", r"\."), -1).alias("shown"), "callee_symbol").distinct()
        return written(sure.join(symbols, "callee_symbol").join(away, ["file_id", "shown"]).select("file_id", "name", "callee_file", "callee_fn").distinct())

    def told(self, sink: Column) -> Column:
        """The text of a sink."""
        return F.element_at(F.array(*map(F.lit, self.sinks)), sink + 1) if self.sinks else F.lit(None).cast("string")

    # Forward: what sources taint.

    def tainted(self) -> DataFrame:
        """(file_id, node, rule, line, seed): tainted values, and the line that the taint came in at."""
        seeds = self.nodes.filter(F.size("source") > 0).select("file_id", "node", "kind", "fn", F.explode(F.array_except("source", "clean")).alias("rule"), "line", F.lit(True).alias("seed"))
        known = Rounds(self.spark, "tainted")
        delta = known.add(seeds)
        while not delta.isEmpty():
            made = delta.filter(F.col("kind").isin(flow.DEF, flow.PARAM)).select("file_id", F.col("node").alias("def"), "rule", F.col("line").alias("since"))
            along = self.edges.filter("counts").join(made, ["file_id", "def"]).select("file_id", "node", "kind", "fn", "rule", F.col("since").alias("line"), "clean")
            given = delta.filter(F.col("kind") == flow.OUT).select("file_id", "fn", "rule").distinct().join(self.functions, ["file_id", "fn"])
            back = self.calls.join(given.select("rule", "name").distinct(), "name").filter(F.array_contains("applicable", F.col("rule"))).select("file_id", "node", "kind", "fn", "rule", "line", "clean")
            more = along.unionByName(back)
            if self.resolved is not None:
                found = given.select(F.col("file_id").alias("callee_file"), F.col("fn").alias("callee_fn"), "rule").join(self.resolved, ["callee_file", "callee_fn"]).select("file_id", "name", "rule").distinct()
                far = self.calls.join(found, ["file_id", "name"]).filter(F.array_contains("applicable", F.col("rule")))
                more = more.unionByName(far.select("file_id", "node", "kind", "fn", "rule", "line", "clean"))
            new = more.filter(~F.array_contains("clean", F.col("rule"))).groupBy(*NODE).agg(F.min("line").alias("line"), F.first("kind").alias("kind"), F.first("fn").alias("fn"))
            # A value that comes in earlier than was known is news; a source's own line stands.
            was = known.all().groupBy(*NODE).agg(F.min("line").alias("was"), F.max("seed").alias("fixed"))
            news = new.join(was, NODE, "left").filter("was IS NULL OR (NOT fixed AND line < was)")
            delta = known.add(news.select("file_id", "node", "kind", "fn", "rule", "line", F.lit(False).alias("seed")))
        return known.all().groupBy(*NODE).agg(F.min("line").alias("line"))

    # Backward: what leads to sinks.

    def reaching(self) -> DataFrame:
        """(file_id, fn, pos, rule, sink): parameters that reach a sink, by rounds over what leads there."""
        seeds = self.nodes.filter(F.col("kind").isin(flow.CALL, flow.ASSIGN)).select("file_id", "node", "start", F.explode("sinks").alias("s")).select("file_id", "node", "s.rule", "s.sink", "start")
        known, reach = Rounds(self.spark, "leading"), Rounds(self.spark, "reach")
        delta = known.add(seeds)
        reach.add(seeds.select("file_id", F.lit(0).cast("long").alias("fn"), F.lit(0).alias("pos"), "rule", "sink").filter("false"))
        while not delta.isEmpty():
            up = self.edges.filter("counts").join(delta, ["file_id", "node"]).filter(~F.array_contains("def_clean", F.col("rule")))
            up = written(up.groupBy("file_id", "def", "rule").agg(F.min_by("sink", "start").alias("sink"), F.min("start").alias("start"), *[F.first(c).alias(c) for c in ("def_kind", "def_fn", "def_pos")]))
            at = up.filter(F.col("def_kind") == flow.PARAM).select("file_id", F.col("def_fn").alias("fn"), F.col("def_pos").alias("pos"), "rule", "sink")
            fresh = reach.add(at.join(reach.all(), ["file_id", "fn", "pos", "rule"], "left_anti"))
            more = up.filter(F.col("def_kind") == flow.DEF).select("file_id", F.col("def").alias("node"), "rule", "sink", "start")
            if not fresh.isEmpty():
                more = more.unionByName(self.handing(self.args, fresh).select("file_id", "node", "rule", "sink", F.lit(0).cast("long").alias("start")))
            new = more.groupBy(*NODE).agg(F.min_by("sink", "start").alias("sink"), F.min("start").alias("start"))
            delta = known.add(new.join(known.all(), NODE, "left_anti"))
        return reach.all()

    def handing(self, calls: DataFrame, reach: DataFrame) -> DataFrame:
        """``calls`` (with file_id, name, pos, blocked) with the rule and sink that what they hand over reaches.

        Reaching functions are first brought to one row a name, a name and file, or a resolved call, so no call meets all functions of its name.
        """
        named = reach.join(self.functions, ["file_id", "fn"])
        anywhere = named.groupBy("name", "pos", "rule").agg(F.min_by("sink", F.struct("path", "fn")).alias("any_sink"))
        own = named.groupBy("file_id", "name", "pos", "rule").agg(F.min_by("sink", "fn").alias("own_sink"))
        met = calls.join(anywhere, ["name", "pos"]).join(own, ["file_id", "name", "pos", "rule"], "left").withColumn("sure_sink", F.lit(None).cast("int"))
        if self.resolved is not None:
            far = self.resolved.join(reach.select(F.col("file_id").alias("callee_file"), F.col("fn").alias("callee_fn"), "pos", "rule", "sink"), ["callee_file", "callee_fn"])
            sure = far.groupBy("file_id", "name", "pos", "rule").agg(F.min_by("sink", "callee_fn").alias("sure_sink"))
            by_name = met.drop("sure_sink").join(sure, ["file_id", "name", "pos", "rule"], "left")
            renamed = calls.join(sure, ["file_id", "name", "pos"]).withColumns({"any_sink": F.lit(None).cast("int"), "own_sink": F.lit(None).cast("int")})
            met = by_name.unionByName(renamed.join(anywhere.select("name", "pos", "rule"), ["name", "pos", "rule"], "left_anti"))
        allowed = met.filter(~F.array_contains("blocked", F.col("rule")))
        if "applicable" in calls.columns:
            allowed = allowed.filter(F.array_contains("applicable", F.col("rule")))
        return allowed.withColumn("sink", F.coalesce("own_sink", "sure_sink", "any_sink")).drop("own_sink", "sure_sink", "any_sink")

    # Both: where tainted data meets a sink.

    def hits(self) -> tuple[DataFrame, DataFrame]:
        """((file_id, node, rule, sink) of the places to report, with what is said of the sink; the tainted values)."""
        tainted = written(self.tainted())
        nodes = self.nodes.filter(F.col("kind").isin(flow.CALL, flow.ASSIGN)).select("file_id", "node", "fn", "start", F.explode("sinks").alias("s")).select("file_id", "node", "fn", "start", "s.rule", "s.sink")
        direct = nodes.join(tainted.select(*NODE), NODE).withColumns({"sink": self.told(F.col("sink")), "pos": F.lit(-2), "bare": F.col("sink")})
        tell = F.concat(F.col("shown"), F.lit("(...) reaches sink "), self.told(F.col("sink")))
        given = self.args.join(tainted.select(*NODE), ["file_id", "node"]).withColumnRenamed("rule", "of_rule")
        handed = self.handing(given, self.reaching()).filter("rule = of_rule")
        sites = self.sites.select("file_id", F.col("node").alias("of"), "fn", "start").distinct()
        through = handed.join(sites, ["file_id", "of"]).select("file_id", F.col("of").alias("node"), "fn", "start", "rule", tell.alias("sink"), "pos", F.col("sink").alias("bare"))
        found = direct.unionByName(through)
        # A function with such a place leads to a sink whatever it is given; calls that hand it tainted data are places, too.
        given = written(self.sites.join(tainted.select(*NODE), ["file_id", "node"]).filter(~F.array_contains("blocked", F.col("rule"))).withColumn("pos", F.lit(OWN)))
        own = lambda rows: rows.filter("fn IS NOT NULL").groupBy("file_id", "fn", "rule").agg(F.min_by("bare", "start").alias("sink")).withColumn("pos", F.lit(OWN))
        known, places = Rounds(self.spark, "leading"), Rounds(self.spark, "places")
        delta = known.add(own(places.add(found)))
        while not delta.isEmpty():
            reached = self.handing(given.withColumnRenamed("rule", "of_rule"), delta).filter("rule = of_rule")
            more = places.add(reached.select("file_id", "node", "fn", "start", "rule", tell.alias("sink"), "pos", F.col("sink").alias("bare")))
            delta = known.add(own(more).join(known.all(), ["file_id", "fn", "rule"], "left_anti"))
        return places.all().groupBy(*NODE).agg(F.min_by("sink", F.struct("pos", "bare")).alias("sink")), tainted

    def located(self) -> DataFrame:
        """The places with positions, snippets and messages; texts are read again for files that have any."""
        hits, tainted = self.hits()
        hits = written(hits)
        shown = self.edges.select("file_id", "node", "var", "def").join(hits.select(*NODE), ["file_id", "node"])
        by = tainted.select("file_id", F.col("node").alias("def"), "rule", "line")
        told = shown.join(by, ["file_id", "def", "rule"]).groupBy(*NODE).agg(F.sort_array(F.collect_set("var")).alias("vars"), F.min("line").alias("line"))
        place = self.nodes.select("file_id", "node", "start", "end", F.col("line").alias("own_line"), "source")
        full = hits.join(place, ["file_id", "node"]).join(told, NODE, "left")
        own = F.when(F.array_contains("source", F.col("rule")), F.col("own_line"))
        rows = full.select("file_id", F.col("rule").alias("rule_ord"), "start", "end", "sink", F.array_join("vars", ", ").alias("names"), F.least("line", own).alias("source_line"))
        texts = rows.join(self.files.select("file_id", "path", "language", "text"), "file_id")
        prefix = F.substring(F.col("text"), F.lit(1), F.col("start").cast("int"))
        line_start = F.substring_index(prefix, "\n", -1)
        found = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
        snippet = F.concat(line_start, F.substring_index(F.substr(F.col("text"), (F.col("start") + 1).cast("int")), "\n", 1))
        column = (F.octet_length(line_start) + 1).cast("long")
        since = F.when(F.col("source_line").isNotNull(), F.concat(F.lit(" (source at line "), F.col("source_line"), F.lit(")"))).otherwise("")
        kind = F.when(F.contains("sink", F.lit(" reaches sink ")), "").otherwise("sink ")
        names = F.when(F.col("names") != "", F.col("names")).otherwise("tainted expression")
        order = Window.partitionBy("file_id", "rule_ord").orderBy("start", F.desc("end"))
        return texts.select(
            "file_id", "rule_ord", "path", "language", F.col("start").alias("start_char"), F.octet_length(prefix).cast("long").alias("start_byte"), (F.octet_length(prefix) + F.octet_length(found)).cast("long").alias("end_byte"),
            X.line_of(prefix).alias("start_line"), column.alias("start_column"), X.line_of(prefix).alias("end_line"), (column + F.octet_length(found)).alias("end_column"), (F.row_number().over(order) - 1).alias("ord"),
            found.alias("match_text"), F.regexp_replace(snippet, r"^(?U:\s)+|(?U:\s)+$", "").alias("code_snippet"), F.concat(F.lit("Tainted data from "), names, since, F.lit(" reached "), kind, F.col("sink"), F.lit(".")).alias("message"), "source_line",
        )


def taint_findings(corpus: DataFrame, rules: list[Rule], facts: DataFrame | None = None) -> DataFrame:
    """Findings of taint rules: ``file_id``, the columns of FINDING, and ``source_line``.

    ``facts``: those of the code graph, where they are known already.
    """
    spark = ship(corpus.sparkSession)
    files = corpus.select("file_id", "path", "language", "text")
    with Scratch(spark) as block:
        located = written(Flow(files, rules, facts).located())
        kept = innermost(located.withColumn("rule_id", F.col("rule_ord").cast("string")))
        found = block.keep(match.described(kept.drop("rule_id"), rules, "source_line"))
    # Read back first, so that only who asks for fingerprints pays for them.
    return match.fingerprinted(found, "source_line")
