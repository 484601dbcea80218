"""URL filters: rules, then a path-template tree with smoothed labelled purity. DataFrame operations only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``,
``#`` or the end. A null url or one without ``://`` has neither.

Templates. A host's paths are cut at ``/``; what lies beyond ``depth`` segments is one segment, the last. Each segment is
first generalised by its form: numbers, hex strings, dates and the like become a wildcard of that form with their ending
kept (``25.html`` to ``{n}.html``). Then the tree grows level by level, and at each level every node does two things:

* If it has more than ``fan_out`` different children, it generalises the rare ones to ``{*}``. A child with ``pages``
  pages or ``labels`` labelled ones stays as it is, however many others there are.
* It merges branches that are alike: of one shape (the most frequent form of what follows) and with label shares that
  agree. Children of a shape are put in order of their smoothed share of poor pages; neighbours less than ``z`` standard
  errors apart are one class, and a class is cut where it would be wider than ``span`` (of the arc sine of the share's
  root, whose error is the same for all shares), so that a row of small steps can't join what is far apart. A class is
  one node, ``{~name of its first member}``, with the pages and labels of all of its members, at all levels below, too.

Verdict: a template whose share of poor labelled pages, smoothed by ``strength`` pages of the corpus's own share, is
above ``reject`` blocks its urls, otherwise they are allowed. Rules come first: the longest rule that fits decides.

All steps are aggregations with map-side combining, equi-joins over (host, node) of paths that are one row a form, and
windows over a node's children. In the end pages are joined to the templates by (host, form). Forms of a thousandth of
all pages or more, which are a thousand at most, are broadcast for that, so a host with a third of all rows is
never in one task.

Defined cases: null urls have empty host and path and get the verdict of the empty template; repeated rows each get a
row; a page with several labels is poor if one of them is; pages without labels take part in the tree, not in the
shares; without any label all is allowed; urls of any length are judged; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, discard

#: The contract's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


#: Forms of so small a part of all pages or more are joined by broadcast.
FREQUENT = 1_000


@dataclass(frozen=True)
class Policy:
    fan_out: int = 24
    strength: float = 20.0
    reject: float = 0.5
    z: float = 1.5
    span: float = 0.35
    pages: int = 200
    labels: int = 20
    depth: int = 12


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host or its parent and the path's beginning; else null."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def generalised(segment: Column) -> Column:
    """A segment with its variable part by form."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(end))
    return (F.when(stem.rlike(r"^\d+$"), F.concat(F.lit("{n}"), end))
            .when(stem.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), F.concat(F.lit("{date}"), end))
            .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*$"), F.concat(F.lit("{hex}"), end))
            .when(stem.rlike(r"\d{3,}"), F.concat(F.regexp_replace(stem, r"\d+", "{n}"), end))
            .otherwise(segment))


def segments_of(path: Column, depth: int) -> Column:
    """The generalised segments, the first of which stands before the first slash; of a long path the last holds the rest."""
    parts = F.split(path, "/", depth + 1)
    return F.transform(parts, generalised)


def merged(here: DataFrame, policy: Policy, prior: float) -> DataFrame:
    """``here``: (host, template, child, shape, labels, poor), one row a child. Returns (host, template, child, name), with a name for each class."""
    share = (F.col("poor") + policy.strength * prior) / (F.col("labels") + policy.strength)
    turned = F.asin(F.sqrt(share))
    # the error of the arc sine of a share's root is 1 / (2 sqrt(n))
    here = here.select("host", "template", "child", "shape", turned.alias("y"), (0.25 / (F.col("labels") + policy.strength)).alias("e2"))
    order = Window.partitionBy("host", "template", "shape").orderBy("y", "child")
    apart = F.col("y") - F.lag("y").over(order) > policy.z * F.sqrt(F.col("e2") + F.lag("e2").over(order))
    here = here.withColumn("chain", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    chain = Window.partitionBy("host", "template", "shape", "chain")
    here = here.withColumn("piece", F.floor((F.col("y") - F.min("y").over(chain)) / policy.span))
    own = Window.partitionBy("host", "template", "shape", "chain", "piece")
    name = F.when(F.count(F.lit(1)).over(own) > 1, F.concat(F.lit("{~"), F.min("child").over(own), F.lit("}"))).otherwise(F.col("child"))
    return here.select("host", "template", "child", name.alias("name"))


def grown_tree(paths: DataFrame, policy: Policy, prior: float) -> DataFrame:
    """(host, form, n, labelled, poor, template) of ``paths`` (host, segments, n, labelled, poor), which are one row a form. One pass a level."""
    tree = paths.withColumn("template", F.lit(""))
    levels = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    held = []
    for level in range(1, levels):  # segment 0 is what stands before the first slash
        tree = tree.withColumn("child", F.get("segments", F.lit(level)))
        deep = F.size("segments") > level
        sums = [F.sum(c).alias(c) for c in ("pages", "labels", "poor")]
        rest = F.array_join(F.transform(F.slice("segments", level + 2, policy.depth), lambda x: F.when(x.contains("{"), x).otherwise("{w}")), "/")
        shaped = tree.where(deep).groupBy("host", "template", "child", rest.alias("rest")).agg(F.sum("n").alias("pages"), F.sum("labelled").alias("labels"), F.sum("poor").alias("poor"))
        here = shaped.groupBy("host", "template", "child").agg(*sums, F.max_by("rest", F.struct("pages", "rest")).alias("shape"))
        node = Window.partitionBy("host", "template")
        rare = (F.count(F.lit(1)).over(node) > policy.fan_out) & (F.col("pages") < policy.pages) & (F.col("labels") < policy.labels)
        here = checkpointed(here.withColumn("kept", F.when(rare, F.lit("{*}")).otherwise(F.col("child"))))
        kept = here.groupBy("host", "template", F.col("kept").alias("child")).agg(*sums, F.max_by("shape", F.struct("pages", "shape")).alias("shape"))
        names = here.join(merged(kept, policy, prior).withColumnRenamed("child", "kept"), ["host", "template", "kept"]).select("host", "template", "child", "name")
        tree = tree.join(names, ["host", "template", "child"], "left").select(
            "host", "form", "segments", "n", "labelled", "poor", F.when(deep, F.concat("template", F.lit("/"), "name")).otherwise(F.col("template")).alias("template"))
        tree = checkpointed(tree)
        discard(here, *held)
        held = [tree]
    return tree


def template_verdicts(tree: DataFrame, policy: Policy, prior: float) -> DataFrame:
    """(host, template, purity, blocked) of every template."""
    ends = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("poor").alias("poor"))
    purity = 1 - (F.col("poor") + policy.strength * prior) / (F.col("labelled") + policy.strength)
    return ends.select("host", "template", purity.alias("purity"), (1 - purity > policy.reject).alias("blocked"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, policy: Policy = Policy(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:  # noqa: B008
    """Per page: its id, host, path, rule, verdict, template and purity. ``labels``: doc_id (a page's id), quality."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("poor")).select(F.col("doc_id").alias("page_id"), "poor")
    rows = rows.withColumn("form", F.array_join(segments_of(F.col("path"), policy.depth), "/"))
    labelled = rows.join(known, "page_id", "left").groupBy("host", "form", "path").agg(F.count(F.lit(1)).alias("n"), F.count("poor").alias("labelled"), F.coalesce(F.sum("poor"), F.lit(0)).alias("poor"))
    # paths of one form are one row from here on
    paths = checkpointed(labelled.groupBy("host", "form").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "poor")), segments_of(F.min("path"), policy.depth).alias("segments")))
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("labelled").alias("labelled"), F.sum("poor").alias("poor")).first()
    prior = float(total.poor) / total.labelled if total.labelled else 0.0
    tree = grown_tree(paths, policy, prior)
    found = checkpointed(tree.join(template_verdicts(tree, policy, prior), ["host", "template"]).select(F.col("host").alias("_host"), F.col("form").alias("_form"), "n", "template", "purity", "blocked"))
    discard(paths)
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    same = (F.col("host") == F.col("_host")) & (F.col("form") == F.col("_form"))
    often = found.where(F.col("n") * FREQUENT >= total.n)  # at most FREQUENT forms
    joined = rows.join(F.broadcast(often), same).unionByName(rows.join(F.broadcast(often), same, "left_anti").join(found.where(F.col("n") * FREQUENT < total.n), same, "left"), allowMissingColumns=True)
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
