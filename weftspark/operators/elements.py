"""Rules over the elements of pages. A rule is two column expressions; any can be added to those here.

``applies`` picks the elements that a rule looks at, ``holds`` says whether one is
right (null: it cannot be told, which is advice and not a failure). A page passes
a rule if no element fails it; pages without such elements pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.operators.scopes import contains, with_owner, within


class ElementRule(NamedTuple):
    id: str
    category: str
    severity: str
    points: int
    applies: Column
    holds: Column


def attribute(name: str) -> Column:
    """An attribute's value, null without it."""
    return F.element_at("attrs", F.lit(name))


def filled(name: str) -> Column:
    """Whether an attribute has a value other than blanks."""
    return F.coalesce(F.trim(attribute(name)) != "", F.lit(False))


def inside(*tags: str) -> Column:
    """Whether one of these elements is open around the element."""
    return within(tag_is(*tags))


def tag_is(*tags: str) -> Column:
    return F.coalesce(F.col("tag").isin(*tags), F.lit(False))


def named() -> Column:
    """Whether text or a label names the element."""
    return filled("aria-label") | filled("aria-labelledby") | filled("title") | F.coalesce(F.trim("text") != "", F.lit(False)) | F.col("named_by_image")


# Inputs that need no label or type, and the autocomplete tokens of personal data.
UNLABELLED = ("hidden", "submit", "button", "reset", "image")
PERSONAL = ("email", "tel", "password")
CONTROLS = ("input", "select", "textarea")


def rules() -> tuple[ElementRule, ...]:
    """The rules of this library."""
    kind = F.lower(F.coalesce(attribute("type"), F.lit("")))
    dialog = tag_is("dialog") | F.coalesce(F.lower(attribute("role")).isin("dialog", "alertdialog"), F.lit(False))
    return (
        ElementRule("html-lang-present", "accessibility", "error", 3, tag_is("html"), filled("lang")),
        ElementRule("images-have-alt", "accessibility", "error", 4, tag_is("img", "image"), attribute("alt").isNotNull()),
        ElementRule("iframes-have-title", "accessibility", "error", 2, tag_is("iframe"), filled("title")),
        ElementRule("no-positive-tabindex", "accessibility", "error", 2, attribute("tabindex").isNotNull(), F.coalesce(F.trim(attribute("tabindex")).try_cast("int") <= 0, F.lit(True))),
        ElementRule("links-have-accessible-names", "accessibility", "error", 3, tag_is("a") & attribute("href").isNotNull(), named()),
        ElementRule("icon-buttons-have-labels", "accessibility", "error", 4, tag_is("button"), named()),
        ElementRule("no-nested-interactive-controls", "accessibility", "error", 3, tag_is("a", "button", *CONTROLS), ~inside("a", "button")),
        ElementRule("dialogs-have-accessible-names", "accessibility", "error", 3, dialog, filled("aria-label") | filled("aria-labelledby")),
        ElementRule("interactive-elements-are-semantic", "accessibility", "warning", 3, attribute("onclick").isNotNull() & ~tag_is("a", "button", "summary", "label", *CONTROLS), filled("role") & attribute("tabindex").isNotNull()),
        ElementRule("form-buttons-have-explicit-type", "forms", "warning", 2, tag_is("button") & inside("form"), kind.isin("submit", "reset", "button")),
        ElementRule("forms-have-labels", "forms", "error", 4, tag_is(*CONTROLS) & ~kind.isin(*UNLABELLED), inside("label") | filled("aria-label") | filled("aria-labelledby") | F.col("labelled")),
        ElementRule("personal-data-autocomplete-present", "forms", "warning", 2, tag_is("input") & kind.isin(*PERSONAL), filled("autocomplete")),
    )


def with_context(elements: DataFrame) -> DataFrame:
    """Adds labelled (a label of the page names the element's id) and named_by_image (an image inside has a text)."""
    # One pass: a label is a second row under the id that it names, so the elements are made once and all sorts are by page.
    told = elements.withColumn("named_by_image", contains(tag_is("img") & filled("alt")))
    key = lambda name, label: F.struct(name.alias("own_id"), F.lit(label).alias("_label"))
    own, names = key(attribute("id"), False), key(attribute("for"), True)
    rows = told.select(*told.columns, F.inline(F.when(tag_is("label") & filled("for"), F.array(own, names)).otherwise(F.array(own))))
    labelled = F.max("_label").over(Window.partitionBy("page_id", "own_id")) & F.col("own_id").isNotNull() & F.col("page_id").isNotNull()
    return rows.withColumn("labelled", labelled).where(~F.col("_label")).drop("_label")


def page_findings(elements: DataFrame, checks: Sequence[ElementRule] | None = None) -> DataFrame:
    """page_id, rule, category, severity, status (pass, fail, advisory), line of the first failure: one row a page and rule, in one aggregate."""
    checks = rules() if checks is None else checks
    # Rules may look around and inside an element: that is a sort of each page's elements, the same for all rules.
    told = with_context(elements).select("page_id", "line", *(F.when(c.applies, F.coalesce(c.holds.cast("int"), F.lit(2))).alias(f"t{k}") for k, c in enumerate(checks)))
    worst = [F.min(F.when(F.col(f"t{k}") == 0, F.struct(F.lit(0).alias("rank"), "line")).when(F.col(f"t{k}") == 2, F.struct(F.lit(1).alias("rank"), "line"))).alias(f"r{k}") for k in range(len(checks))]
    pages = told.groupBy("page_id").agg(*worst)
    rows = F.array(*(F.struct(F.lit(c.id).alias("rule"), F.lit(c.category).alias("category"), F.lit(c.severity).alias("severity"), F.when(F.col(f"r{k}.rank") == 0, "fail").when(F.col(f"r{k}.rank") == 1, "advisory").otherwise("pass").alias("status"), F.col(f"r{k}.line").alias("line")) for k, c in enumerate(checks)))
    return pages.select("page_id", F.inline(rows))


#: Elements that own the headings and ids inside them, unless one is asked for by other columns.
SECTIONS = ("article", "section", "aside", "dialog", "nav", "template")


def _owned(elements: DataFrame, owner: Column | None) -> DataFrame:
    return elements.withColumn("owner", F.lit(None).cast("int")) if owner is None else with_owner(elements, owner)


def heading_faults(elements: DataFrame, owner: Column | None = None) -> DataFrame:
    """page_id, line, fault of headings that skip a level or are a second h1; each page by itself, or each nearest ``owner`` element by itself."""
    heading, owns = tag_is("h1", "h2", "h3", "h4", "h5", "h6"), F.lit(False) if owner is None else F.coalesce(owner, F.lit(False))
    rows = elements.select("page_id", "elem_id", "last", "line", F.when(heading, F.substring("tag", 2, 1).cast("int")).alias("level"), owns.alias("owns")).where("owns or level is not null")
    levels = _owned(rows, None if owner is None else F.col("owns")).where("level is not null")
    by = Window.partitionBy("page_id", "owner").orderBy("elem_id")
    firsts = F.sum((F.col("level") == 1).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    fault = F.when((F.col("level") == 1) & (firsts > 1), "second-h1").when(F.col("level") > F.lag("level").over(by) + 1, "skipped-level")
    return levels.select("page_id", "line", fault.alias("fault")).where("fault is not null")


def _references(elements: DataFrame, owner: Column | None, asked: Column) -> DataFrame:
    """page_id, elem_id, line, token, held of every id in ``asked`` (a list, null where nothing is asked; an empty one gives a null token): how often it stands in the page, or in the same nearest ``owner`` element.

    One pass: what is asked and what is held are rows under the same page, owner and id.
    """
    owns = F.lit(False) if owner is None else F.coalesce(owner, F.lit(False))
    rows = elements.select("page_id", "elem_id", "last", "line", asked.alias("asked"), F.when(filled("id"), attribute("id")).alias("own"), owns.alias("owns")).where("owns or own is not null or asked is not null")
    token = lambda t, held: F.struct(t.alias("token"), F.lit(held).alias("is_held"))
    none = F.array(token(F.lit(None).cast("string"), 0))
    wanted = F.when(F.col("asked").isNull(), F.array()).when(F.size("asked") == 0, none).otherwise(F.transform("asked", lambda t: token(t, 0)))
    kept = F.when(F.col("own").isNull(), F.array()).otherwise(F.array(token(F.col("own"), 1)))
    told = _owned(rows, None if owner is None else F.col("owns")).select("page_id", "elem_id", "line", F.coalesce("owner", F.lit(-1)).alias("scope"), F.inline(F.concat(wanted, kept)))
    held = F.when(F.col("page_id").isNull() | F.col("token").isNull(), 0).otherwise(F.sum("is_held").over(Window.partitionBy("page_id", "scope", "token")))
    return told.withColumn("held", held).where("is_held = 0").drop("is_held", "scope")


def broken_references(elements: DataFrame, owner: Column | None = None) -> DataFrame:
    """page_id, line, missing: ids that aria attributes name and that the page, or the same nearest ``owner`` element, does not have; all of an attribute's ids must exist."""
    names = ("aria-labelledby", "aria-describedby", "aria-controls")
    tokens = F.array_distinct(F.concat(*(F.split(F.trim(F.coalesce(attribute(n), F.lit(""))), r"\s+") for n in names)))
    asked = F.when(reduce(or_, (filled(n) for n in names)), F.filter(tokens, lambda t: t != ""))
    return _references(elements, owner, asked).where("held = 0 and token is not null").select("page_id", "line", F.col("token").alias("missing"))


def reference_state(elements: DataFrame, name: str, owner: Column | None = None) -> DataFrame:
    """page_id, elem_id, line, state of every element that has the attribute ``name``: valid (all its ids are in scope), missing, or ambiguous (an id stands twice there)."""
    asked = F.filter(F.split(F.trim(attribute(name)), r"\s+"), lambda t: t != "")
    found = _references(elements, owner, asked).groupBy("page_id", "elem_id").agg(F.min("line").alias("line"), F.min("held").alias("least"), F.max("held").alias("most"))
    state = F.when(F.col("least") == 0, "missing").when(F.col("most") > 1, "ambiguous").otherwise("valid")
    return found.select("page_id", "elem_id", "line", state.alias("state"))
