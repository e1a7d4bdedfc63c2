"""Text rules as Column expressions: tokens, action templates, event labels, goals, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
PRODUCT_ID = "^b0[a-z0-9]{8}$"
INSPECT_TARGETS = ["description", "features", "reviews"]
BUY_TARGETS = ["buy now", "buy"]
PAGE_TARGETS = ["back to search", "< prev", "prev", "next >", "next", "search"]
OPTION_TARGETS = [
    "black", "white", "gray", "grey", "green", "blue", "red", "orange", "yellow", "pink", "purple", "brown",
    "small", "medium", "large", "x-large", "xx-large", "3x-large",
]
EVENT_PREFIXES = [
    ("search[", "QueryFormulation"),
    ("click[buy", "PurchaseDecision"),
    ("click[", "CandidateInteraction"),
    ("take ", "AcquireObject"),
    ("put ", "PlaceObject"),
    ("go to ", "NavigateToTarget"),
    ("heat ", "TransformObject"),
    ("cool ", "TransformObject"),
    ("clean ", "TransformObject"),
]
INVALID_MARKERS = ["invalid", "not a valid", "you can't", "cannot"]
METHOD_LABELS = {"no_skill": "No Skill", "tower": "Tower"}
LEVEL_ORDER = ["low", "mid", "high", "planning", "functional", "atomic", "flat"]


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def token_count(text: Column) -> Column:
    return F.size(tokenize(text)).cast("long")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def click_target_class(target: Column) -> Column:
    return (
        F.when(target.rlike(PRODUCT_ID), "click_product")
        .when(target.isin(INSPECT_TARGETS), "inspect_product")
        .when(target.isin(BUY_TARGETS), "purchase")
        .when(target.isin(PAGE_TARGETS), "navigate_page")
        .when(target.isin(OPTION_TARGETS), "select_option")
        .otherwise("click_option")
    )


def action_template(action: Column) -> Column:
    text = F.lower(strip(action))
    inside = F.regexp_replace(F.substring(text, 7, 2147483647), r"\]$", "")
    first = F.element_at(F.split(text, r"\s+"), 1)
    return (
        F.when(text.startswith("search["), "search_query")
        .when(text.startswith("click["), click_target_class(strip(inside)))
        .when(text == "", "unknown_action")
        .when(first == "go", "navigate")
        .otherwise(first)
    )


def event_label(action: Column) -> Column:
    (prefix, label), *rest = EVENT_PREFIXES
    rule = F.when(action.startswith(prefix), label)
    for prefix, label in rest:
        rule = rule.when(action.startswith(prefix), label)
    return rule.otherwise(F.substring_index(action, "[", 1))


def python_bool(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def float_text(value: Column) -> Column:
    """A double as plain text down to 0.0001, then with a two-digit exponent."""
    plain = value.cast("string")
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.regexp_replace(F.substring_index(F.replace(plain, F.lit("-"), F.lit("")), "E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E-(\d+)$", 1)
    small = F.when(
        exponent == "4", F.concat(sign, F.lit("0.000"), F.replace(digits, F.lit("."), F.lit("")))
    ).otherwise(F.concat(sign, digits, F.lit("e-"), F.lpad(exponent, 2, "0")))
    return (
        F.when(exponent != "", small)
        .when(plain.contains("E"), value.cast("decimal(38,1)").cast("string"))
        .otherwise(plain)
    )


def goal_from_observation(env: Column, observation: Column) -> Column:
    marker = F.lit("Instruction:")
    at = F.locate("Instruction:", observation)
    tail = F.substring(observation, at + F.length(marker), F.lit(2147483647))
    parts = F.filter(
        F.transform(F.split(tail, r"\[SEP\]"), strip),
        lambda part: (part != "") & (F.lower(part) != "instruction:"),
    )
    return (
        F.when((env == "webshop") & (at > 0), F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
        .when(env == "alfworld", strip(F.substring_index(observation, "\n", 1)))
        .otherwise(F.substring(observation, 1, 200))
    )


def is_invalid_step(flag_present: Column, flag: Column, observation: Column) -> Column:
    """An explicit flag wins (present but null counts as invalid), else look for the markers."""
    text = F.lower(F.coalesce(observation, F.lit("")))
    marked = F.lit(False)
    for marker in INVALID_MARKERS:
        marked = marked | text.contains(marker)
    return F.when(flag_present, ~F.coalesce(flag, F.lit(False))).otherwise(marked)


def run_slug(label: Column) -> Column:
    cleaned = F.regexp_replace(strip(label), "[^a-zA-Z0-9_.-]+", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("run"))


def model_label(spec: Column) -> Column:
    """``label=path`` gives the label; a bare path gives its folder, else its stem."""
    parts = F.split(spec, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.when(spec.contains("="), F.substring_index(spec, "=", 1)).otherwise(
        F.coalesce(F.nullif(folder, F.lit("")), stem)
    )


def model_path(spec: Column) -> Column:
    return F.when(
        spec.contains("="), F.substring(spec, F.locate("=", spec) + 1, F.lit(2147483647))
    ).otherwise(spec)


def method_label(method: Column, labels: dict[str, str] = METHOD_LABELS) -> Column:
    """Display name of a method: a fixed label, else its words capitalised."""
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(named, method), F.initcap(F.replace(method, F.lit("_"), F.lit(" "))))


def counter_text(counter: Column) -> Column:
    """``value (count), ...`` of a top-n counter, ``none`` when empty."""
    items = F.transform(counter, lambda item: F.format_string("%s (%d)", item["value"], item["count"]))
    return F.when(F.coalesce(F.size(counter), F.lit(0)) > 0, F.concat_ws(", ", items)).otherwise("none")
