"""Address filter: rules first, then a tree of path templates per host.

1. Rules (verdict, host, path) fit their host and all subdomains if the path starts with theirs; the
   longest fitting rule decides, and labels its page for the tree.
2. Every path becomes a template of all its segments: those with digits become wildcards, keeping a file
   ending.  Pages are counted per (host, template), and only these counts go on.
3. Level by level, where a branch of a host has at least ``FAN`` different literal segments with fewer than
   ``REUSE`` pages each on average, its segments are variable too and become one wildcard.
4. Sibling branches with similar labelled shares of rejected pages are merged: they share their counts.
   Branches whose smoothed share is known within ``SURE`` are put into ``CELLS`` cells by it; from the least
   share up, a cell joins the branches merged so far if both shares differ by at most two standard errors of
   their difference, and begins a new run otherwise.
5. From the host down to the template, the purity (labelled share of rejected pages) of each branch is
   smoothed towards that of the branch above with the weight of ``PRIOR_PAGES`` pages.  At the host itself
   unlabelled pages count as not rejected, so labels of a few branches do not condemn the others.  A
   template of at least ``REJECT`` is rejected.

Nulls and empties: a null address, or one without ``://``, has empty host and path, and is a host like
any other.  Repeated rows count as pages and are judged one by one.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import lower_ascii
from gradeflow.session import checkpointed

FAN, REUSE, PRIOR_PAGES, REJECT, BASE_RATE = 20, 3, 5.0, 0.8, 0.1
SURE, CELLS = 0.1, 256
#: No path is cut: as many segments as an array can hold.
DEPTH = 2**31 - 1
#: Rules are literals of the plan; longer lists belong in a table.
MAX_RULES = 200


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def template_of(path: Column) -> Column:
    """All segments, those with digits as wildcards."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    ending = r"^.*[0-9].*?(\.[A-Za-z]{1,5})?$"
    return F.transform(segments, lambda s: F.regexp_replace(s, ending, "*$1"))


def _variable_depth(templates: DataFrame) -> int:
    """The deepest level a host has ``FAN`` templates at; below it no segment can be variable."""
    sizes = templates.groupBy("host", F.size("segments").alias("size")).agg(F.count("*").alias("n"))
    reach = sizes.groupBy("host").agg(F.collect_list(F.struct("size", "n")).alias("sizes"))
    deeper = F.transform(
        "sizes",
        lambda x: F.struct(
            x["size"].alias("size"),
            F.aggregate("sizes", F.lit(0).cast("long"), lambda n, y: n + F.when(y["size"] >= x["size"], y["n"]).otherwise(0)).alias("n"),
        ),
    )
    deepest = F.array_max(F.transform(F.filter(deeper, lambda x: x["n"] >= FAN), lambda x: x["size"]))
    return reach.agg(F.max(deepest)).first()[0] or 0


def _generalised(templates: DataFrame) -> DataFrame:
    """``templates`` with variable literal segments of ``segments`` as wildcards, level by level."""
    spark = templates.sparkSession
    for level in range(_variable_depth(templates)):
        here = F.slice("segments", 1, level)
        segment = F.col("segments")[level]
        literal = (F.size("segments") > level) & ~segment.startswith("*")
        literals = (
            templates.filter(literal)
            .groupBy("host", here.alias("above"), segment.alias("segment"))
            .agg(F.sum("pages").alias("pages"))
        )
        variable = (
            literals.groupBy("host", "above")
            .agg(F.count("*").alias("fan"), F.sum("pages").alias("pages"))
            .filter((F.col("fan") >= FAN) & (F.col("pages") < REUSE * F.col("fan")))
            .select("host", "above", F.lit(True).alias("variable"))
        )
        wild = F.concat(here, F.array(F.lit("*")), F.slice("segments", level + 2, DEPTH))
        templates = checkpointed(
            spark,
            templates.withColumn("above", here)
            .join(variable, ["host", "above"], "left")
            .withColumn("segments", F.when(F.col("variable") & literal, wild).otherwise(F.col("segments")))
            .drop("above", "variable"),
            "templates",
        )
    return templates


def _share(labelled: Column, rejected: Column) -> tuple[Column, Column]:
    """The smoothed rejected share and its variance."""
    share = (rejected + 1) / (labelled + 2)
    return share, share * (1 - share) / (labelled + 3)


def _runs(cells: Column) -> Column:
    """Cells (cell, n, bad), sorted, merged into runs (high, n, bad) of similar shares."""

    def add(runs: Column, cell: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        (low, low_variance), (high, high_variance) = _share(last["n"], last["bad"]), _share(cell["n"], cell["bad"])
        similar = F.abs(high - low) <= 2 * F.sqrt(low_variance + high_variance)
        longer = F.struct(cell["cell"].alias("high"), (last["n"] + cell["n"]).alias("n"), (last["bad"] + cell["bad"]).alias("bad"))
        single = F.struct(cell["cell"].alias("high"), cell["n"].alias("n"), cell["bad"].alias("bad"))
        joined = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))
        return F.when(similar, joined).otherwise(F.concat(runs, F.array(single)))

    return F.aggregate(cells, F.array().cast("array<struct<high:int,n:bigint,bad:bigint>>"), add)


def purities(templates: DataFrame) -> DataFrame:
    """(host, segments, purity): the smoothed share of rejected pages of every template."""
    levels = F.transform(
        F.sequence(F.lit(0), F.size("segments")), lambda d: F.struct(d.alias("depth"), F.slice("segments", F.lit(1), d).alias("branch"))
    )
    distinct = templates.groupBy("host", "segments").agg(
        *[F.sum(c).alias(c) for c in ("pages", "labelled", "rejected")]
    )
    placed = distinct.select("*", F.explode(levels).alias("l")).select("*", "l.depth", "l.branch").drop("l")
    share, variance = _share(F.col("labelled"), F.col("rejected"))
    cell = F.floor(share * CELLS + 0.5).cast("int")
    branches = (
        placed.groupBy("host", "depth", "branch")
        .agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "rejected")])
        .withColumn("cell", F.when((F.col("depth") > 0) & (F.sqrt(variance) <= SURE), cell))
        .withColumn("above", F.when(F.col("depth") > 0, F.slice("branch", F.lit(1), F.col("depth") - 1)))
    )
    merged = (
        branches.filter("cell is not null")
        .groupBy("host", "depth", "above", "cell")
        .agg(F.sum("labelled").alias("n"), F.sum("rejected").alias("bad"))
        .groupBy("host", "depth", "above")
        # at most a few hundred cells
        .agg(_runs(F.sort_array(F.collect_list(F.struct("cell", "n", "bad")))).alias("runs"))
    )
    run = F.when(F.col("cell").isNotNull(), F.try_element_at(F.filter("runs", lambda r: r["high"] >= F.col("cell")), F.lit(1)))
    weighed = (
        branches.join(merged, ["host", "depth", "above"], "left")
        .withColumn("run", run)
        .select(
            "host",
            "depth",
            "branch",
            F.when(F.col("depth") == 0, F.col("pages")).otherwise(F.coalesce("run.n", "labelled")).alias("n"),
            F.coalesce("run.bad", "rejected").alias("bad"),
        )
    )
    chain = F.sort_array(F.collect_list(F.struct("depth", "n", "bad")))
    smoothed = F.aggregate(
        F.col("chain"), F.lit(BASE_RATE), lambda p, b: (b["bad"] + PRIOR_PAGES * p) / (b["n"] + PRIOR_PAGES)
    )
    return (
        placed.select("host", "segments", "depth", "branch")
        .join(weighed, ["host", "depth", "branch"])
        .groupBy("host", "segments")
        .agg(chain.alias("chain"))
        .select("host", "segments", smoothed.alias("purity"))
    )


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity."""
    spark = pages.sparkSession
    host, path = host_of(F.col(url)), path_of(F.col(url))
    seen = (
        pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))
        .withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
        .withColumn("shape", template_of(F.col("path")))
    )
    rejected = F.col("found.verdict") == "block"
    counted = checkpointed(
        spark,
        seen.groupBy("host", "shape")
        .agg(F.count("*").alias("pages"), F.count("found").alias("labelled"), F.count(F.when(rejected, 1)).alias("rejected"))
        .withColumn("segments", F.col("shape")),
        "templates",
    )
    general = _generalised(counted)
    pure = general.select("host", "shape", "segments").join(purities(general), ["host", "segments"])
    judged = seen.join(pure, ["host", "shape"], "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return judged.select(
        F.col("id").alias(page_id),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        verdict.alias("verdict"),
        F.concat(F.lit("/"), F.array_join("segments", "/")).alias("template"),
        "purity",
    )
