"""URL filters by rules and by a tree of path templates, in DataFrame operations only.

Rules come first: (host, path, verdict) fits its host and all subdomains where the
path starts with the rule's; the longest wins. Their verdicts are the labels from
which the rest is judged. Per host, paths are a tree of segments. Segments that
vary become wildcards: those with a digit run, a hash-like shape or an extension
by their form, and those at a place where a host shows many values and few repeats
by their counts. Every template hangs from a chain of nodes, broad to narrow: the corpus, the
parent domains of two names or more, the host, and for each segment the siblings of its
shape, then the path up to it. Labels are counted by node. Down the chain a node whose labelled
rate doesn't differ (two-proportion test) from the rest of the branch above it is merged
into that branch, and so is one without labels or with all of them; any other is a branch
of its own, its labelled purity smoothed towards that of the branch above. A template
is rejected when its branch's purity reaches ``REJECT`` and its host or a domain
above has a label at all. So unlabelled templates follow the labels next to them: of
their siblings, else of the host, else of its domain.

Urls are aggregated to (host, template) before anything is joined back, so a host
with a third of all rows is a few rows of the tree; its urls meet the tree in a
join that Spark splits by skew. Nodes with labels are broadcast where they are few.

Nulls: a null url, or one without ``://``, has empty host and path, fits no rule
and is allowed. page_id may be null or repeat; rows are judged one by one. An
empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import checkpointed, fitting, written

#: The rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Smoothed purity of a rejected template, the prior's weight, the z below which branches merge, and when values vary.
REJECT, PRIOR, SIMILAR, VARIED, SHOWN = 0.8, 4.0, 1.96, 0.5, 20
#: Names of a host and segments of a path that have nodes of their own (a longer template hangs from the last), and nodes broadcast at most.
DEPTH, MOST_NODES = 8, 200_000


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule overrides
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def formed(path: Column) -> Column:
    """The path with segments that vary by their form as ``*``: numbers, hashes and names with such a stem."""
    return F.regexp_replace(path, r"(?<=/)(?:[^/]*[0-9]{2,}[^/]*|[0-9]|[0-9a-fA-F-]{16,})(?=/|\z)", "*")


def templates(rows: DataFrame) -> DataFrame:
    """host, form, template: forms of each host with the segments that vary by their counts as ``*`` too."""
    forms = rows.groupBy("host", "form").agg(F.sum("n").alias("n"))
    parts = forms.select("host", "form", "n", F.posexplode(F.split("form", "/")).alias("place", "segment"))
    values = parts.groupBy("host", "place", "segment").agg(F.sum("n").alias("n"))
    places = values.groupBy("host", "place").agg(F.sum("n").alias("shown"), F.count("*").alias("different"))
    varied = places.where((F.col("shown") >= SHOWN) & (F.col("different") > VARIED * F.col("shown"))).groupBy("host").agg(F.collect_set("place").alias("places"))
    star = F.transform(F.split("form", "/"), lambda s, i: F.when((i > 0) & F.array_contains("places", i), F.lit("*")).otherwise(s))
    return forms.select("host", "form").join(varied, "host", "left").select(
        "host", "form", F.when(F.col("places").isNull(), F.col("form")).otherwise(F.array_join(star, "/")).alias("template")
    )


def chain(host: Column, template: Column) -> Column:
    """The nodes above a template and its own, broad to narrow; those that aren't hosts or paths have a ``?``, which neither can hold."""
    bare = F.regexp_replace(host, r":[0-9]*\z", "")
    names = F.split(bare, r"\.")
    names = F.when(F.size(names) > DEPTH, F.slice(names, -DEPTH, DEPTH)).otherwise(names)
    domains = F.transform(names, lambda _, i: F.concat(F.lit("?"), F.array_join(F.slice(names, i + 1, DEPTH), ".")))
    domains = F.filter(F.reverse(domains), lambda d: d.contains(".") & ~bare.rlike(r"\A[0-9.]*\z|\["))  # addresses have no domain
    segments = F.slice(F.split(template, "/"), 2, DEPTH)
    upto = lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))
    shape = lambda s: F.regexp_replace(F.regexp_replace(s, r"\p{L}+", "a"), "[0-9]+", "0")
    paths = F.flatten(F.transform(segments, lambda s, i: F.array(F.concat(upto(i), F.lit("?"), shape(s)), upto(i + 1))))
    return F.array_distinct(F.concat(domains, F.array(host), paths, F.array(F.concat(host, template))))


def _descended(nodes: Column, labelled: Column, blocked: Column) -> Column:
    """Labels, purity and name of the branch that a chain's labelled ``nodes`` end in; from the labels of the corpus."""
    base = F.coalesce(F.try_divide(blocked, labelled), F.lit(0.0))
    start = F.struct(labelled.alias("labelled"), blocked.alias("blocked"), base.alias("purity"), F.lit("/**").alias("branch"))

    def step(above: Column, node: Column) -> Column:
        other, other_blocked = above["labelled"] - node["labelled"], above["blocked"] - node["blocked"]
        p = F.try_divide(above["blocked"], above["labelled"])
        gap = F.abs(F.try_divide(node["blocked"], node["labelled"]) - F.try_divide(other_blocked, other))
        spread = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), node["labelled"]) + F.try_divide(F.lit(1.0), other)))
        purity = (node["blocked"] + PRIOR * above["purity"]) / (node["labelled"] + PRIOR)
        own = F.struct(node["labelled"].alias("labelled"), node["blocked"].alias("blocked"), purity.alias("purity"), node["node"].alias("branch"))
        return F.when((other > 0) & (gap > SIMILAR * spread), own).otherwise(above)

    return F.aggregate(nodes, start, step)


def branches(leaves: DataFrame) -> DataFrame:
    """host, template, branch, purity and rejected; from host, template, n, labelled and blocked."""
    total = leaves.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in ("labelled", "blocked")])
    hung = leaves.select("host", "template", "labelled", "blocked", F.posexplode(chain(F.col("host"), F.col("template"))).alias("at", "node"))
    nodes = hung.where("labelled > 0").groupBy("node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    found = hung.select("host", "template", "at", "node").join(fitting(checkpointed(nodes), MOST_NODES), "node")
    found = found.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("at", "node", "labelled", "blocked"))).alias("nodes"))
    rows = leaves.select("host", "template").join(found, ["host", "template"], "left").join(F.broadcast(total), F.lit(True), "left")
    none = F.expr("cast(array() as array<struct<at: int, node: string, labelled: bigint, blocked: bigint>>)")
    rows = rows.withColumn("to", _descended(F.coalesce("nodes", none), F.col("all_labelled"), F.col("all_blocked")))
    rejected = F.col("nodes").isNotNull() & (F.col("to.purity") >= REJECT)
    return rows.select("host", "template", F.col("to.branch").alias("branch"), F.col("to.purity").alias("purity"), rejected.alias("rejected"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and the template and purity behind it, of every row of ``pages``."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = _rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = written(rows.select("*", rule.alias("rule"), verdict.alias("ruled"), formed(F.col("path")).alias("form")), "urls")
    seen = rows.groupBy("host", "form").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked")
    ).withColumn("blocked", F.coalesce("blocked", F.lit(0)))
    tree = templates(seen)
    leaves = seen.join(tree, ["host", "form"]).groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    found = written(tree.join(branches(leaves), ["host", "template"]), "templates")
    out = rows.join(found, ["host", "form"], "left")
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
