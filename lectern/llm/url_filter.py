"""URL filter: host rules first, then a tree of path templates per host.

Templates: every path segment starts as its shape (runs of digits become one mark). From the root down, a segment
is variable, and turns into ``*``, where its siblings have many values for their number of pages. From
the root down again, sibling branches that are statistically alike (the mix of templates below them and their labelled
purity are near that of all siblings pooled) are merged into ``*``. Labels are the verdicts of the
rules. A template's purity is its share of allowed pages, smoothed towards what is expected where it stands: a branch is expected to be
like its labelled siblings, each counting once however many pages it has, and these are smoothed towards the expectation of
their parent, up to the host, which has the prior. A template that other hosts have as well (``/en/#``) is then expected to be like
it is there, each host counting once, smoothed towards its expectation on its own host. So labels reach templates without any. Templates below a threshold are rejected.

All of this is DataFrame work on (host, template) counts; pages are counted first and joined back last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, salted_join, written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MANY, VARIED, PRIOR_ROWS, NEAR, REJECT_BELOW = 12, 0.3, 4, 0.25, 0.5
#: Expected purity where there are no labels at all, and how many labelled siblings weigh as much as the parent's expectation.
PRIOR, PRIOR_BRANCHES = 0.75, 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    start = F.locate("://", url)
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host, its subdomains included, and a path's start; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        on, _, under = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + under)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _starred(tree: DataFrame, depth: int, test: Column, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``tree`` with ``*`` for the segment at ``depth`` where ``test`` holds on the joined ``facts``; equal templates add up."""
    joined = salted_join(tree.withColumns(_place(depth)), facts, keys, F.struct("template"))
    changed = F.concat(F.slice("template", 1, depth), F.array(F.lit("*")), F.slice("template", depth + 2, F.greatest(F.size("template"), F.lit(1))))
    return joined.withColumn("template", F.when((F.size("template") > depth) & F.coalesce(test, F.lit(False)), changed).otherwise(F.col("template"))).select("host", "shape", "template", "pages", "good", "bad")


def _place(depth: int) -> dict[str, Column]:
    """Where a template stands at ``depth``: what is above, its own segment, what is below; joined by a character no path holds unescaped."""
    return {"above": F.array_join(F.slice("template", 1, depth), "\n"), "own": F.coalesce(F.get("template", F.lit(depth)), F.lit("")), "below": F.array_join(F.slice("template", depth + 2, F.greatest(F.size("template"), F.lit(1))), "\n")}


def _next_depth(tree: DataFrame, depth: int) -> int | None:
    """The first depth from ``depth`` on at which templates that agree above it differ; none where all are alone."""
    groups = tree.groupBy("host", F.slice("template", 1, depth).alias("above")).agg(F.min("template").alias("a"), F.max("template").alias("b")).filter("a <> b")
    # The first and the last template of a group have no more in common than all of it.
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    return groups.agg((F.min(F.array_position(same, False)) - 1).cast("int").alias("depth")).first()["depth"]


def _by_level(tree: DataFrame, change) -> DataFrame:
    """``change(tree, depth)`` from the root down to the deepest level with a choice; rows that end above a level leave the loop."""
    ended, depth = [], _next_depth(tree, 0)
    while depth is not None:
        ended.append(tree.filter(F.size("template") <= depth))
        tree = written(change(tree.filter(F.size("template") > depth), depth), "url-tree")
        depth = _next_depth(tree, depth + 1)
    for part in ended:
        tree = tree.unionByName(part)
    return written(tree, "url-tree")


def path_templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, pages, good, bad): the template of each shaped path of ``pages`` (host, shape, label)."""
    label = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0))
    tree = pages.groupBy("host", "shape").agg(F.count("*").alias("pages"), label("allow").alias("good"), label("block").alias("bad"))
    tree = written(tree.withColumn("template", F.filter(F.split("shape", "/"), lambda s: s != "")).select("host", "shape", "template", "pages", "good", "bad"), "url-tree")

    def varied(tree: DataFrame, depth: int) -> DataFrame:
        values = tree.withColumns(_place(depth)).groupBy("host", "above", "own").agg(F.sum("pages").alias("n"))
        siblings = values.groupBy("host", "above").agg(F.count("*").alias("values"), F.sum("n").alias("n"))
        return _starred(tree, depth, (F.col("values") >= MANY) & (F.col("values") >= F.col("n") * VARIED), siblings.filter(F.col("values") >= MANY), ["host", "above"])

    def merged(tree: DataFrame, depth: int) -> DataFrame:
        return _starred(tree, depth, F.col("alike"), _alike(tree.withColumns(_place(depth))), ["host", "above", "own"])

    return _by_level(_by_level(tree, varied), merged)


def _purity(good: str, bad: str, expected: Column) -> Column:
    return (F.col(good) + PRIOR_ROWS * expected) / (F.col(good) + F.col(bad) + F.lit(PRIOR_ROWS))


def _expected(branches: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``branches`` (.., good, bad, expected) with ``expected`` drawn to the mean share of the *other* labelled branches with equal ``keys``.

    A branch's own labels are left out here, as they count for its purity.
    """
    share = F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad")))
    shared = branches.withColumn("share", share)
    sums = shared.filter("share is not null").groupBy(*keys).agg(F.count("*").alias("labelled"), F.sum("share").alias("shares"))
    joined = salted_join(shared, sums, keys, F.col(spread), salts=8)
    own, n = F.coalesce("share", F.lit(0.0)), F.coalesce("labelled", F.lit(0)) - F.col("share").isNotNull().cast("int")
    total = F.coalesce("shares", F.lit(0.0)) - own + F.lit(PRIOR_BRANCHES) * F.col("expected")
    return joined.withColumn("expected", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / (n + PRIOR_BRANCHES)))).drop("share", "labelled", "shares")


def _alike(placed: DataFrame) -> DataFrame:
    """(host, above, own, alike) of branches close to their pooled siblings, in groups where two or more are.

    Closeness is the total variation distance between what lies below a branch and below all siblings, less what
    chance explains for its number of pages, and the difference of the smoothed purities.
    """
    cells = placed.groupBy("host", "above", "own", "below").agg(*[F.sum(c).alias(c) for c in ("pages", "good", "bad")])
    branches = cells.groupBy("host", "above", "own").agg(F.sum("pages").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # A branch without labels is taken for what equal branches of other hosts are.
    branches = _expected(branches.withColumn("expected", F.lit(PRIOR)), ["above", "own"], "host")
    branches = branches.withColumn("purity", _purity("good", "bad", F.col("expected"))).withColumnsRenamed({"good": "g", "bad": "b"}).drop("expected")
    pooled_cells = cells.groupBy("host", "above", "below").agg(F.sum("pages").alias("pool_cell"))
    pooled = branches.groupBy("host", "above").agg(F.sum("n").alias("pool_n"), F.sum("g").alias("pool_g"), F.sum("b").alias("pool_b"), F.count("*").alias("branches")).filter("branches > 1")
    # Mass the branch has beyond the pool: summed over its own cells this is the total variation distance.
    shares = salted_join(cells, branches, ["host", "above", "own"], F.struct("below"), "inner", salts=8)
    shares = salted_join(shares, pooled, ["host", "above"], F.struct("own", "below"), "inner", salts=8)
    shares = salted_join(shares, pooled_cells, ["host", "above", "below"], F.struct("own"), "inner", salts=8)
    beyond = F.greatest(F.col("pages") / F.col("n") - F.col("pool_cell") / F.col("pool_n"), F.lit(0.0))
    tested = shares.groupBy("host", "above", "own").agg(F.sum(beyond).alias("distance"), *[F.first(c).alias(c) for c in ("n", "purity", "pool_g", "pool_b")])
    near = (F.col("distance") <= NEAR + 1 / F.sqrt("n")) & (F.abs(F.col("purity") - _purity("pool_g", "pool_b", F.lit(PRIOR))) <= NEAR)
    tested = tested.withColumn("alike", near).filter("alike")
    several = tested.groupBy("host", "above").agg(F.count("*").alias("k")).filter("k > 1")
    return salted_join(tested, several, ["host", "above"], F.struct("own"), "inner", salts=8).select("host", "above", "own", "alike")


def template_purity(tree: DataFrame) -> DataFrame:
    """(host, template, good, bad, expected, purity) of each template of ``tree`` (host, template, good, bad).

    From the hosts down, level by level, then across hosts; levels at which no host's templates differ change no expectation and are skipped.
    """
    rows = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rows = written(rows.withColumn("expected", F.lit(PRIOR)), "url-purity")

    def refined(rows: DataFrame, depth: int) -> DataFrame:
        placed = rows.withColumns(_place(depth))
        branches = placed.groupBy("host", "above", "own").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("expected").alias("expected"))
        found = _expected(branches, ["host", "above"], "own").select("host", "above", "own", F.col("expected").alias("__expected"))
        joined = salted_join(placed, found, ["host", "above", "own"], F.struct("template"), "inner", salts=8)
        return joined.select("host", "template", "good", "bad", F.col("__expected").alias("expected"))

    rows = _by_level(rows, refined)
    # Templates of wildcards only say nothing across hosts.
    literal = F.exists("template", lambda s: ~s.isin("*", "#"))
    known = rows.filter(literal).withColumn("name", F.array_join("template", "/"))
    rows = rows.filter(~literal).unionByName(_expected(known, ["name"], "host").select(*rows.columns))
    return rows.select("host", "template", "good", "bad", "expected", _purity("good", "bad", F.col("expected")).alias("purity"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Verdict for each row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    The verdict is the longest fitting rule's; where none fits, a template whose smoothed purity is under
    a half is blocked and any other allowed.

    Edge cases: a null url, or one without ``://``, has empty host and path and is judged by the template of those;
    without any label every purity is the prior and all is allowed; paths of any length are compared to their last segment; repeated rows count
    each; null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    cut = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, label = matching_rule(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace("path", r"[0-9]+", "#")
    rows = cut.withColumns({"rule": rule, "label": label, "shape": shape})
    tree = path_templates(rows)
    purities = template_purity(tree.select("host", "template", "good", "bad")).select("host", "template", "purity")
    judged = salted_join(tree.select("host", "shape", "template"), purities, ["host", "template"], F.struct("shape"), "inner", salts=8)
    judged = judged.select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
    found = salted_join(rows, judged, ["host", "shape"], F.struct("page_id", "path"))
    verdict = F.coalesce("label", F.when(F.col("purity") < REJECT_BELOW, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
