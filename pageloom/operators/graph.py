"""Redirect chains, category trees and closures, by rounds of joins with a checkpoint between them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from pageloom.session import materialised


def broken_redirects(redirects: DataFrame, page: DataFrame) -> DataFrame:
    """Redirects whose target is no page."""
    return redirects.join(page.select(F.col("page_id").alias("target_id")), "target_id", "left_anti").select("page_id", "target_id")


def double_redirects(redirects: DataFrame) -> DataFrame:
    """Redirects whose target is a redirect."""
    second = redirects.select(F.col("page_id").alias("target_id")).distinct()
    return redirects.join(second, "target_id", "left_semi").select("page_id", "target_id")


def redirect_chains(redirects: DataFrame, page: DataFrame) -> DataFrame:
    """(page_id, final_id, hops, kind) of every redirect; kind is 'ok', 'broken' (ends at no page),
    or 'loop' (never ends). Path lengths double in each round. A chain that ends beyond 2n hops passes
    pages that end after n to 2n; so once a round ends no further chain, the rest are loops."""
    nxt = redirects.select(F.col("page_id").alias("k"), F.col("target_id").alias("v")).groupBy("k").agg(F.min("v").alias("v"))
    path = nxt.select(F.col("k").alias("page_id"), F.col("v").alias("at"), F.lit(1).alias("hops"))
    moving = None
    while True:
        jump = path.select(F.col("page_id").alias("k"), F.col("at").alias("v"), F.col("hops").alias("h"))
        joined = path.join(jump, path["at"] == jump["k"], "left")
        path = materialised(joined.select("page_id", F.coalesce("v", "at").alias("at"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops")))
        last, moving = moving, path.join(nxt.select(F.col("k").alias("at")), "at", "left_semi").count()
        if moving in (0, last):
            break
    still = path.join(nxt.select(F.col("k").alias("at"), F.lit(True).alias("moves")), "at", "left").join(page.select(F.col("page_id").alias("at"), F.lit(True).alias("there")).distinct(), "at", "left")
    kind = F.when(F.col("moves"), "loop").when(F.col("there"), "ok").otherwise("broken")
    return still.select("page_id", F.when(kind != "loop", F.col("at")).alias("final_id"), F.when(kind != "loop", F.col("hops")).alias("hops"), kind.alias("kind"))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): all nodes that a seed reaches over edges (parent, child), each at its least
    depth; ``max_depth`` leaves out deeper ones. Cycles end by themselves: a node is visited once a root."""
    e = edges.select("parent", "child").distinct()
    seen = frontier = materialised(seeds.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(e, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = materialised(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # else the plan of a deep tree is a union of as many parts
            seen = materialised(seen)
    return seen


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component): connected components by alternating large-star and small-star rounds; the
    component is named by its smallest node. A node of many neighbours is only ever aggregated. Rounds go
    on until nothing changes; it is an error if they don't within ``max_rounds``."""
    e = materialised(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node IS NOT NULL").distinct()
    last = None
    for n in itertools.count(1):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        down = large.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
        m = down.groupBy("hi").agg(F.min("lo").alias("m"))
        small = down.join(m, "hi").select(F.col("m").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).filter("u <> v").distinct()
        e = materialised(small)
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == last:
            break
        if n == max_rounds:
            raise RuntimeError(f"components still change after {n} rounds")
        last = state
    return nodes.join(e.select(F.col("v").alias("node"), F.col("u").alias("c")).groupBy("node").agg(F.min("c").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def conflicts(links: DataFrame, component: DataFrame) -> DataFrame:
    """(component, lang, pages): languages of which a component of language links has several pages."""
    return links.join(component, "node").groupBy("component", "lang").agg(F.countDistinct("node").alias("pages")).filter("pages > 1")
