"""Rule packs: TOML data read on the driver, checked, and turned into rules and a small table.

A pack is a folder with ``pack.toml`` and rule files below ``rules/``.  A rule
file holds one rule, or several under ``[[rules]]``.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ENGINE_VERSION = "0.4.0"
#: Folder of the packs that come with the engine.
BUILT_IN = Path(__file__).resolve().parent.parent / "packs"

# Ordered severities and confidences, and the language names of rules.
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
LANGUAGES = ("java", "javascript", "typescript", "tsx", "python", "go")


class PackError(ValueError):
    """A pack or rule that can't be used; the message says why."""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str = "rule"
    description: str | None = None
    recommendation: str | None = None
    category: str | None = None
    severity: str = "medium"
    confidence: str = "medium"
    languages: tuple[str, ...] = ()
    cwe: str | None = None
    owasp: str | None = None
    framework: str | None = None
    regex: str | None = None
    not_regex: str | None = None
    fix: str | None = None
    query: str | None = None
    anchor: str | None = None
    query_not_regex: str | None = None
    sources: tuple[str, ...] = ()
    sanitizers: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    param_annotations: tuple[str, ...] = ()
    capability: str = "pattern"
    pack: str = ""

    @property
    def severity_rank(self) -> int:
        return SEVERITIES.index(self.severity)

    def applies(self, language: str) -> bool:
        """Whether the rule is for files of a language; TSX files take TypeScript and JavaScript rules."""
        return language in self.languages or language == "tsx" and ("typescript" in self.languages or "javascript" in self.languages)


@dataclass(frozen=True)
class Pack:
    name: str
    version: str
    description: str | None = None
    authors: tuple[str, ...] = ()
    min_engine: str | None = None
    rules: tuple[Rule, ...] = field(default=())


def version_above(a: str, b: str) -> bool:
    """Whether version ``a`` is above ``b`` by its first three numbers; what is no number counts as 0."""

    def parts(v: str) -> list[int]:
        numbers = [int(p) if p.isdigit() else 0 for p in v.split(".")[:3]]
        return numbers + [0] * (3 - len(numbers))

    return parts(a) > parts(b)


def check_regex(rule_id: str, pattern: str) -> None:
    """Patterns must compile, and do without look-around and back-references, which linear-time matchers lack."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise PackError(f"rule '{rule_id}': invalid regex: {e}") from e
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise PackError(f"rule '{rule_id}': look-around and back-references are not supported")
    if re.search(pattern, "") is not None:
        raise PackError(f"rule '{rule_id}': the regex matches empty text")


def parse_rule(raw: dict, pack: str = "", languages: tuple[str, ...] = LANGUAGES) -> Rule:
    if not raw.get("id"):
        raise PackError("a rule has no id")
    rule_id = raw["id"]
    given = [c for c in ("pattern", "query", "taint") if c in raw]
    if len(given) != 1:
        raise PackError(f"rule '{rule_id}': exactly one of pattern, query and taint is needed, found {len(given)}")
    if raw.get("severity") not in SEVERITIES:
        raise PackError(f"rule '{rule_id}': unknown severity '{raw.get('severity')}'")
    if raw.get("confidence", "medium") not in CONFIDENCES:
        raise PackError(f"rule '{rule_id}': unknown confidence '{raw['confidence']}'")
    named = tuple(raw.get("languages", ()))
    if not named:
        raise PackError(f"rule '{rule_id}': no languages")
    unknown = [x for x in named if x not in languages and x != "text"]
    if unknown:
        raise PackError(f"rule '{rule_id}': unknown language '{unknown[0]}'")
    matcher = {k.replace("-", "_"): v for k, v in raw[given[0]].items()}
    values = {k: raw[k] for k in ("name", "description", "recommendation", "category", "severity", "confidence", "cwe", "owasp", "framework") if k in raw}
    rule = Rule(id=rule_id, languages=named, capability=given[0], pack=pack, **values)
    if given[0] == "pattern":
        if not matcher.get("regex"):
            raise PackError(f"rule '{rule_id}': no regex")
        check_regex(rule_id, matcher["regex"])
        rule = replace(rule, regex=matcher["regex"], not_regex=matcher.get("not_regex"), fix=matcher.get("fix"))
        if rule.not_regex:
            re.compile(rule.not_regex)
        if rule.fix and not rule.recommendation:
            rule = replace(rule, recommendation=f"Suggested fix: {rule.fix}")
    elif given[0] == "query":
        if not matcher.get("tree_sitter"):
            raise PackError(f"rule '{rule_id}': no query")
        rule = replace(rule, query=matcher["tree_sitter"], anchor=matcher.get("anchor"), query_not_regex=matcher.get("not_regex"))
    else:
        lists = {k: tuple(matcher.get(k, ())) for k in ("sources", "sanitizers", "sinks", "param_annotations")}
        rule = replace(rule, **lists)
    return rule


def load_rule_file(path: str | Path, pack: str = "") -> list[Rule]:
    try:
        raw = tomllib.loads(Path(path).read_text("utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise PackError(f"unable to load '{path}': {e}") from e
    return [parse_rule(r, pack) for r in raw.get("rules", [raw])]


def load_pack(path: str | Path) -> Pack:
    """A pack folder; its rule files in the order of their paths."""
    path = Path(path)
    if not (path / "pack.toml").is_file():
        raise PackError(f"'{path}' has no pack.toml")
    raw = tomllib.loads((path / "pack.toml").read_text("utf-8"))
    if not raw.get("name") or not raw.get("version"):
        raise PackError(f"'{path}': pack.toml needs name and version")
    rules = [r for f in sorted((path / "rules").rglob("*.toml")) for r in load_rule_file(f, raw["name"])]
    if not rules:
        raise PackError(f"pack '{raw['name']}' has no rules")
    compat = raw.get("metadata", {}).get("compat", {})
    return Pack(raw["name"], raw["version"], raw.get("description"), tuple(raw.get("authors", ())), compat.get("min-engine"), tuple(rules))


class Registry:
    """Packs in order; rule ids are unique across them."""

    def __init__(self, packs: list[Pack] | None = None):
        self.packs: list[Pack] = []
        for p in packs or []:
            self.add(p)

    @classmethod
    def built_in(cls) -> Registry:
        """The code packs, by name of their folder; the prose pack is asked for by name."""
        return cls([load_pack(p) for p in sorted(BUILT_IN.iterdir()) if (p / "rules").is_dir() and p.name != "corpus"])

    def add(self, pack: Pack) -> Registry:
        known = {r.id for r in self.rules}
        for r in pack.rules:
            if r.id in known:
                raise PackError(f"duplicate rule id '{r.id}' in pack '{pack.name}'")
            known.add(r.id)
        self.packs.append(pack)
        return self

    def select(self, names: list[str]) -> Registry:
        """Only packs of these names; unknown names select nothing."""
        self.packs = [p for p in self.packs if p.name in names]
        return self

    @property
    def rules(self) -> list[Rule]:
        return [r for p in self.packs for r in p.rules]

    def namespace(self) -> str:
        """Hash of everything that decides findings; cached results of other rules don't count."""
        from siftline.functions.text import fnv1a64

        return fnv1a64("\0".join(f"{p.name}\0{p.version}\0" + "\0".join(map(repr, p.rules)) for p in self.packs))


RULES_SCHEMA = (
    "rule_ord int, pack string, rule_id string, rule_name string, description string, recommendation string, category string, severity string, "
    "severity_rank int, confidence string, languages array<string>, cwe string, owasp string, framework string, capability string"
)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row a rule; as small as the packs."""
    rows = [
        (i, r.pack, r.id, r.name, r.description, r.recommendation, r.category, r.severity, r.severity_rank, r.confidence, list(r.languages), r.cwe, r.owasp, r.framework, r.capability)
        for i, r in enumerate(rules)
    ]
    # From Arrow it is a local table, which takes no job and no worker.
    names, types = zip(*(f.split() for f in RULES_SCHEMA.split(", ")), strict=True)
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    held = pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))
    return spark.createDataFrame(held, RULES_SCHEMA)
