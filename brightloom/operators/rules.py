"""Data-quality rules: rows of a rules table compiled into column expressions.

A rule is `(rule_id, phase, kind, params, severity, enabled, priority, scope)`. The table is
configuration; it is read once, and every page passes all rules of a phase in one projection.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.functions.shaping import unrolled
from brightloom.functions.urls import canonical_url
from brightloom.session import HOT_KEY_ROWS, cut_lineage, lookup_join

PHASES = ("normalize", "validate", "dedup", "conflict")
MAX_RULES = 10_000
OUTCOMES_TYPE = "array<struct<rule_id:string,kind:string,phase:string,status:string,detail:string>>"


class RuleError(ValueError):
    """A rule of an unknown kind or with parameters its kind does not take."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    phase: str
    kind: str
    params: dict[str, Any]
    severity: str = "error"
    priority: int = 100


# What each kind takes: name -> (check, default). A kind without defaults requires its names.
_REQUIRED = object()
_PARAMETERS: dict[str, dict[str, tuple[Callable[[Any], bool], Any]]] = {
    "canonical_url": {
        "stripParams": (lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v), []),
        "lowercaseHost": (lambda v: isinstance(v, bool), True),
        "dropFragment": (lambda v: isinstance(v, bool), True),
    },
    "collapse_whitespace": {},
    "derive_summary": {"maxChars": (lambda v: type(v) is int and v > 0, 280)},
    "require_title": {},
    "min_text_len": {"min": (lambda v: type(v) is int and v >= 0, _REQUIRED)},
    "allowed_page_type": {
        "allowed": (lambda v: isinstance(v, list) and len(v) > 0 and all(isinstance(x, str) for x in v), _REQUIRED)
    },
    "language_is_en": {},
    "near_duplicate_hash": {},
    "same_canonical_url": {},
    "tier_authoritativeness": {},
}


def checked_params(kind: str, raw: Any) -> dict[str, Any]:
    """Parameters of a rule with defaults filled in; unknown names are dropped."""
    if kind not in _PARAMETERS:
        raise RuleError(f"unknown rule kind: {kind}")
    given = {} if raw is None else raw
    if not isinstance(given, dict):
        raise RuleError(f"parameters of {kind} are not an object")
    result = {}
    for name, (valid, default) in _PARAMETERS[kind].items():
        value = given.get(name, default)
        if value is _REQUIRED or not valid(value):
            raise RuleError(f"invalid parameter {name} for rule kind {kind}")
        result[name] = value
    return result


def rules_with_defaults(rules: DataFrame) -> DataFrame:
    """Rule rows with missing columns filled: all scopes, no params, error, enabled, 100."""
    defaults = {"scope": "all", "params": "{}", "severity": "error", "enabled": True, "priority": 100}
    for name, value in defaults.items():
        present = F.col(name) if name in rules.columns else F.lit(None).cast(_type_name(value))
        rules = rules.withColumn(name, F.coalesce(present, F.lit(value)))
    return rules


def _type_name(value: Any) -> str:
    return {str: "string", bool: "boolean", int: "int"}[type(value)]


def load_rules(rules: DataFrame, phase: str) -> list[Rule]:
    """Enabled rules of a phase by priority, then id, with their parameters checked."""
    rows = (
        rules_with_defaults(rules)
        .filter(F.col("enabled") & (F.col("phase") == phase))
        .orderBy("priority", "rule_id")
        .limit(MAX_RULES + 1)
        .collect()
    )
    if len(rows) > MAX_RULES:
        raise RuleError(f"more than {MAX_RULES} rules in phase {phase}")
    return [
        Rule(
            row["rule_id"],
            row["phase"],
            row["kind"],
            checked_params(row["kind"], json.loads(row["params"])),
            "warn" if row["severity"] == "warn" else "error",
            row["priority"],
        )
        for row in rows
    ]


def _outcome(rule: Rule, phase: str, status: Column, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.kind).alias("kind"),
        F.lit(phase).alias("phase"),
        status.alias("status"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def _misplaced(rule: Rule, phase: str) -> Column:
    return _outcome(rule, phase, F.lit("skipped"), F.lit(f"not a {phase} rule"))


def _with_outcomes(pages: DataFrame, outcomes: list[Column]) -> DataFrame:
    earlier = F.col("outcomes") if "outcomes" in pages.columns else F.array().cast(OUTCOMES_TYPE)
    added = F.array(*outcomes) if outcomes else F.array()
    return pages.withColumn("outcomes", F.concat(earlier, added.cast(OUTCOMES_TYPE)))


def page_candidates(requests: DataFrame) -> DataFrame:
    """Ingest requests as candidates with their defaults; the text is the raw HTML."""

    def optional(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in requests.columns else default

    null_text = F.lit(None).cast("string")
    return (
        requests.withColumn("canonical_url", F.col("url"))
        .withColumn("title", optional("title", null_text))
        .withColumn("text", F.col("html"))
        .withColumn("page_type", optional("page_type", F.lit("article")))
        .withColumn("language", optional("language", F.lit("en")))
        .withColumn("summary", null_text)
        .withColumn("tags", F.array().cast("array<string>"))
    )


def normalize(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Thread candidates through the normalize rules in order, noting what each one did."""
    outcomes = []
    columns = {name: F.col(name) for name in ("canonical_url", "text", "summary")}
    for rule in rules:
        target = _NORMALIZERS.get(rule.kind)
        if target is None:
            outcomes.append(_misplaced(rule, "normalize"))
            continue
        name, make, detailed = target
        after = make(columns, rule.params)
        # Keep each step as a column of its own so later rules read it instead of repeating it.
        step, flag = f"_{len(outcomes)}_{name}", f"_{len(outcomes)}_changed"
        pages = pages.withColumn(step, after)
        pages = pages.withColumn(flag, ~F.col(step).eqNullSafe(columns[name]))
        changed = F.col(flag)
        columns[name] = F.col(step)
        detail = F.when(changed, F.col(step)) if detailed else None
        outcomes.append(_outcome(rule, "normalize", F.when(changed, "applied").otherwise("skipped"), detail))
    pages = _with_outcomes(pages, outcomes)
    for name, column in columns.items():
        pages = pages.withColumn(name, column)
    return pages.drop(*[c for c in pages.columns if c.startswith("_")])


def _canonical(columns: dict[str, Column], params: dict) -> Column:
    url = canonical_url(F.col("url"), params["stripParams"], params["dropFragment"])
    return F.coalesce(url, columns["canonical_url"])


def _collapsed(columns: dict[str, Column], params: dict) -> Column:
    return X.collapse_whitespace(columns["text"])


def _summary(columns: dict[str, Column], params: dict) -> Column:
    present = F.coalesce(F.length(columns["summary"]), F.lit(0)) > 0
    derived = F.nullif(X.first_paragraph(columns["text"], params["maxChars"]), F.lit(""))
    return F.when(present, columns["summary"]).otherwise(F.coalesce(derived, columns["summary"]))


# kind -> (column it may change, how, whether the outcome tells the new value)
_NORMALIZERS = {
    "canonical_url": ("canonical_url", _canonical, True),
    "collapse_whitespace": ("text", _collapsed, False),
    "derive_summary": ("summary", _summary, False),
}


def _title_fault(params: dict) -> Column:
    named = F.coalesce(F.length(X.trim_all(F.col("title"))), F.lit(0)) > 0
    return F.when(~named, F.lit("missing title"))


def _length_fault(params: dict) -> Column:
    size = F.coalesce(F.length("text"), F.lit(0))
    return F.when(size < params["min"], F.concat(F.lit("text length "), size.cast("string"), F.lit(f" < {params['min']}")))


def _type_fault(params: dict) -> Column:
    allowed = F.coalesce(F.col("page_type").isin(*params["allowed"]), F.lit(False))
    return F.when(~allowed, F.concat(F.lit("page_type "), F.coalesce("page_type", F.lit("null")), F.lit(" not allowed")))


def _language_fault(params: dict) -> Column:
    return F.when(~F.col("language").eqNullSafe("en"), F.concat(F.lit("language "), F.coalesce("language", F.lit("null")), F.lit(" != en")))


# kind -> expression that is NULL when the page is fine and says what is wrong otherwise
_FAULTS = {
    "require_title": _title_fault,
    "min_text_len": _length_fault,
    "allowed_page_type": _type_fault,
    "language_is_en": _language_fault,
}


def validate(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the validate outcomes and `passed`, false iff a rule of error severity failed."""
    outcomes, failed = [], F.lit(False)
    for rule in rules:
        fault_of = _FAULTS.get(rule.kind)
        if fault_of is None:
            outcomes.append(_misplaced(rule, "validate"))
            continue
        fault = fault_of(rule.params)
        bad = "warn" if rule.severity == "warn" else "fail"
        outcomes.append(_outcome(rule, "validate", F.when(fault.isNull(), "pass").otherwise(bad), fault))
        if bad == "fail":
            failed = failed | fault.isNotNull()
    return _with_outcomes(pages, outcomes).withColumn("passed", ~failed)


_DEDUP_KEYS = {"near_duplicate_hash": "content_hash", "same_canonical_url": "canonical_url"}


def dedup(pages: DataFrame, stored: DataFrame, rules: list[Rule], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Decide `insert`, `skip` or `merge` for new pages in `seq` order; the first hit decides.

    A page is compared with the `stored` pages of its source and with the pages of the batch
    that are stored before it. Only a repeated hash keeps a page out, so of all pages of a
    source with one hash exactly the first is stored unless the hash is stored already; this
    makes the batch's own reference pages known without walking through it. Each key is looked
    up once, so more rules cost neither joins nor reads.
    """
    uses_hash = any(rule.kind == "near_duplicate_hash" for rule in rules)
    references = stored.select(
        "source_id", "content_hash", "canonical_url", "page_id", F.lit(None).cast("long").alias("seq")
    )
    own = pages.select("source_id", "content_hash", "canonical_url", "page_id", F.col("seq").cast("long").alias("seq"))
    if uses_hash:
        members = ["canonical_url", "page_id", "seq"]
        own = (
            own.groupBy("source_id", "content_hash")
            .agg(F.min_by(F.struct(*members), "seq").alias("_first"))
            .select("source_id", "content_hash", "_first.*")
            .join(stored.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
        )
    references = references.unionByName(own)
    # Stored pages come before the whole batch.
    arrival = F.coalesce("seq", F.lit(-(2**62)))
    first_rule = {key: n for n, rule in reversed(list(enumerate(rules))) if (key := _DEDUP_KEYS.get(rule.kind))}
    earlier = F.col("outcomes") if "outcomes" in pages.columns else F.array().cast(OUTCOMES_TYPE)
    # One lookup for each key that rules use, however many use it.
    for key in first_rule:
        firsts = (
            references.filter(F.col(key).isNotNull())
            .groupBy("source_id", key)
            .agg(F.min(F.struct(arrival.alias("at"), F.col("page_id").alias("page_id"))).alias(f"_first_{key}"))
        )
        pages = lookup_join(pages, firsts, ["source_id", key], "left", F.col("page_id"), hot_rows)
        hit = F.col(f"_first_{key}")
        found = (hit["at"] < F.col("seq")) & (hit["page_id"] != F.col("page_id"))
        pages = pages.withColumn(f"_hit_{key}", F.when(found, hit["page_id"])).drop(f"_first_{key}")
    # The first rule of a key decides for it, the earlier of both for the page.
    hits = [F.when(F.col(f"_hit_{key}").isNotNull(), F.lit(n)) for key, n in first_rule.items()]
    pages = pages.withColumn("_decided", F.array_min(F.array(F.lit(len(rules)), *hits)))
    outcomes = [F.when(F.col("_decided") >= n, _dedup_outcome(rule)) for n, rule in enumerate(rules)]
    added = F.array_compact(F.array(*outcomes)) if outcomes else F.array()
    decides = {key: F.col("_decided") == n for key, n in first_rule.items()}
    skips, merges = decides.get("content_hash", F.lit(False)), decides.get("canonical_url", F.lit(False))
    other = F.col("_hit_canonical_url") if "canonical_url" in first_rule else F.lit(None).cast("string")
    return (
        pages.withColumn("action", F.when(skips, "skip").when(merges, "merge").otherwise("insert"))
        .withColumn("merge_into", F.when(merges, other))
        .withColumn("outcomes", F.concat(earlier, added.cast(OUTCOMES_TYPE)))
        .drop("_decided", *[f"_hit_{key}" for key in first_rule])
    )


def _dedup_outcome(rule: Rule) -> Column:
    key = _DEDUP_KEYS.get(rule.kind)
    if key is None:
        return _misplaced(rule, "dedup")
    other = F.col(f"_hit_{key}")
    wording = "duplicate of " if key == "content_hash" else "merge into "
    return _outcome(rule, "dedup", F.when(other.isNotNull(), "applied").otherwise("pass"), F.concat(F.lit(wording), other))


def resolve_by_tier(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Cross-source conflicts over `(keys, value, tier, page_id, seq)`: the lowest tier wins.

    Different values at the lowest tier leave the key unresolved and without a winner.
    """
    lowest = assertions.groupBy(*keys, "tier").agg(
        F.min("value").alias("_least"),
        F.max("value").alias("_most"),
        F.min_by(F.struct("value", "page_id"), "seq").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )
    per_key = lowest.groupBy(*keys).agg(
        F.min_by(F.struct("_least", "_most", "_first"), "tier").alias("_top"),
        F.min("tier").alias("tier"),
        F.sum("_n").alias("assertions"),
    )
    unresolved = F.col("_top._least") != F.col("_top._most")
    return per_key.select(
        *keys,
        "tier",
        unresolved.alias("unresolved"),
        F.when(~unresolved, F.col("_top._first.value")).alias("value"),
        F.when(~unresolved, F.col("_top._first.page_id")).alias("page_id"),
        (F.col("assertions") - F.when(unresolved, 0).otherwise(1)).alias("losers"),
    )


def write_flow(requests: DataFrame, stored: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict of every ingest request: `unchanged`, `rejected`, `deduped` or `stored`.

    `requests` is `(page_id, source_id, url, html, seq, ...)`, `stored` the page table.
    Pages whose bytes are as stored pass no rules; the others are normalised and validated;
    pages new to the table are checked for duplicates among themselves and the stored ones.
    A merge decision is noted in the outcomes and the page is stored all the same.
    """
    candidates = page_candidates(requests).withColumn("content_hash", F.sha2("html", 256))
    known = stored.select(
        "source_id", "url", F.col("page_id").alias("_known_id"), F.col("content_hash").alias("_known_hash")
    )
    matched = candidates.join(known, ["source_id", "url"], "left")
    unchanged = matched.filter(F.col("_known_hash") == F.col("content_hash"))
    changed = matched.filter(~F.coalesce(F.col("_known_hash") == F.col("content_hash"), F.lit(False)))
    # Rule outcomes belong to the page's existing id where it has one.
    changed = changed.withColumn("page_id", F.coalesce("_known_id", "page_id")).withColumn(
        "is_new", F.col("_known_id").isNull()
    ).drop("_known_id", "_known_hash")
    checked = validate(normalize(changed, load_rules(rules, "normalize")), load_rules(rules, "validate"))

    def shaped(df: DataFrame, verdict: Column) -> DataFrame:
        outcomes = F.col("outcomes") if "outcomes" in df.columns else F.array().cast(OUTCOMES_TYPE)
        return df.select(*VERDICT_COLUMNS, verdict.alias("verdict"), outcomes.alias("outcomes"))

    # From here on only narrow rows are needed, several times; the HTML is read once.
    first_verdict = F.when(~F.col("passed"), "rejected").when(F.col("is_new"), "new").otherwise("stored")
    checked = cut_lineage(shaped(checked, first_verdict))
    new = dedup(checked.filter(F.col("verdict") == "new"), stored, load_rules(rules, "dedup"))
    return (
        shaped(unchanged.withColumn("page_id", F.col("_known_id")), F.lit("unchanged"))
        .unionByName(checked.filter(F.col("verdict") != "new"))
        .unionByName(shaped(new, F.when(F.col("action") == "skip", "deduped").otherwise("stored")))
    )


VERDICT_COLUMNS = [
    "page_id", "source_id", "url", "canonical_url", "title", "page_type", "summary", "language", "tags", "content_hash", "seq",
]


def rule_events(decided: DataFrame, created_at: Column) -> DataFrame:
    """The audit trail: one row per page and rule outcome."""
    rows = unrolled(decided, ["page_id"], F.col("outcomes"), "_outcome", "ord")
    return rows.select("page_id", "ord", "_outcome.*", created_at.alias("created_at")).withColumnRenamed("status", "outcome")


def append_rule_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").partitionBy("phase").parquet(folder)


def pages_failing_validation(events: DataFrame) -> DataFrame:
    return events.filter((F.col("phase") == "validate") & (F.col("outcome") == "fail")).select("page_id").distinct()
