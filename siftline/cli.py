"""Command line: scan, rule list|explain|validate|test, baseline create|update|status, config.

Exit codes: 0 clean, 1 fatal, 2 findings, 3 some file could not be analysed
(which counts for more than findings).
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from siftline.operators import findings as O
from siftline.operators import suppress
from siftline.plans import report
from siftline.plans.scan import Scanner
from siftline.sources import config as C
from siftline.sources import state, tree
from siftline.sources.packs import ENGINE_VERSION, SEVERITIES, PackError, Registry, load_pack, load_rule_file, version_above
from siftline.sources.syntax import EXTENSIONS


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("siftline").config("spark.ui.enabled", "false").getOrCreate()


def _baseline_path(root: str) -> str:
    return str(Path(root) / tree.STATE / "baseline")


def scan(args: argparse.Namespace) -> int:
    c = C.load()
    scanner = Scanner.for_packs(_spark(), args.pack or c.packs, [*c.pack_dirs, *args.pack_dir])
    files = None
    if args.changed or args.staged:
        files = tree.under((tree.staged_files if args.staged else tree.changed_files)("."), args.paths)
    paths = args.paths or c.include
    cache = None if args.no_cache else state.FindingsCache(scanner.spark, str(Path(c.root) / tree.STATE / "cache"), scanner.registry.namespace())
    snapshot = None if args.no_cache else state.GraphSnapshot(scanner.spark, str(Path(c.root) / tree.STATE / "graph"))
    result = scanner.scan_paths(paths, c.exclude, files, cache, snapshot)
    if cache:
        cache.prune()
    if args.baseline:
        base = state.read_baseline(scanner.spark, _baseline_path(c.root))
        n = O.baseline_counts(result.findings, base).first()
        print(f"baseline: {n['existing']} existing, {n['new']} new, {n['fixed']} fixed", file=sys.stderr)
        result.findings = O.new_against(result.findings, base)
    if args.min_severity:
        result.findings = O.at_least(result.findings, args.min_severity)
    report.write(result, args.format or c.format, args.output or c.output)
    return O.exit_code(result.findings, result.degraded, args.fail_on_severity or c.exit_on_severity)


def rule(args: argparse.Namespace) -> int:
    known = Registry.built_in().rules
    if args.action == "list":
        for r in known:
            print(f"{r.id:<48} {r.languages[0]:<12} {r.severity.upper():<9} {r.name}")
        return 0
    if args.action == "explain":
        found = next((r for r in known if r.id == args.targets[0]), None)
        if not found:
            raise PackError(f"unknown rule '{args.targets[0]}'")
        for k in ("id", "name", "pack", "severity", "confidence", "category", "languages", "cwe", "owasp", "framework", "description", "recommendation", "capability"):
            v = getattr(found, k)
            if v:
                print(f"{k}: {', '.join(v) if isinstance(v, tuple) else v}")
        return 0
    if args.action == "validate":
        for t in args.targets:
            if Path(t).is_dir():
                p = load_pack(t)
                if p.min_engine and version_above(p.min_engine, ENGINE_VERSION):
                    raise PackError(f"pack '{p.name}' needs engine {p.min_engine}; this is {ENGINE_VERSION}")
                print(f"ok: {t} ({len(p.rules)} rule(s))")
            else:
                print(f"ok: {t} ({len(load_rule_file(t))} rule(s))")
        return 0
    return rule_test(args)


def rule_test(args: argparse.Namespace) -> int:
    """One rule file against one fixture: annotations, or a count of findings, decide."""
    from siftline.sources.packs import Pack

    rules = load_rule_file(args.targets[0])
    path = args.targets[1]
    language = EXTENSIONS.get(path.rpartition(".")[2], "unknown")
    if not any(r.applies(language) for r in rules):
        raise PackError(f"the rule is for {', '.join(rules[0].languages)}, the fixture is {language}")
    spark = _spark()
    scanner = Scanner(spark, Registry([Pack("test", "0", rules=tuple(rules))]))
    corpus = spark.createDataFrame([(0, path, language, Path(path).read_text("utf-8"))], "file_id long, path string, language string, text string")
    found = scanner.findings(corpus)
    n = found.count()
    for f in O.triage(found).limit(10).collect():
        print(f"  {f.rule_id} {f.start_line}:{f.start_column} {f.code_snippet}")
    if args.expected is not None:
        print(f"{n} finding(s), {args.expected} expected")
        return int(n != args.expected)
    wrong = suppress.verdicts(suppress.annotations(corpus), found, [r.id for r in rules]).collect()
    for v in wrong:
        print(suppress.verdict_line(v.kind, v.rule_id, v.line))
    print("pass" if not wrong else f"{len(wrong)} verdict(s) against")
    return int(bool(wrong))


def baseline(args: argparse.Namespace) -> int:
    c = C.load()
    scanner = Scanner.for_packs(_spark(), c.packs, c.pack_dirs)
    found = scanner.scan_paths(["."], c.exclude).findings
    path = _baseline_path(c.root)
    if args.action == "status":
        n = O.baseline_counts(found, state.read_baseline(scanner.spark, path)).first()
        print(f"existing: {n['existing']}\nnew: {n['new']}\nfixed: {n['fixed']}")
        return 2 if n["new"] or n["fixed"] else 0
    state.write_baseline(found, path)
    print(f"baseline written to {path}")
    return 0


def show_config(args: argparse.Namespace) -> int:
    for k, v in vars(C.load()).items():
        print(f"{k} = {v}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", description=__doc__)
    p.add_argument("--version", action="version", version=ENGINE_VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="*")
    for flag in ("--changed", "--staged", "--no-cache", "--baseline"):
        s.add_argument(flag, action="store_true")
    s.add_argument("--pack", action="append", default=[])
    s.add_argument("--pack-dir", action="append", default=[])
    s.add_argument("--fail-on-severity", choices=SEVERITIES)
    s.add_argument("--min-severity", choices=SEVERITIES)
    s.add_argument("--format", choices=list(report.FORMATS))
    s.add_argument("--output", "-o")
    s.set_defaults(run=scan)
    r = sub.add_parser("rule")
    r.add_argument("action", choices=("list", "explain", "validate", "test"))
    r.add_argument("targets", nargs="*")
    r.add_argument("--expected", type=int)
    r.set_defaults(run=rule)
    b = sub.add_parser("baseline")
    b.add_argument("action", choices=("create", "update", "status"))
    b.set_defaults(run=baseline)
    sub.add_parser("config").set_defaults(run=show_config)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (PackError, C.ConfigError, tree.ScopeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
