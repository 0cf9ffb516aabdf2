"""Search and bounded walks over the citation graph, for tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexspark.functions.text import provision_bullet
from lexspark.operators.graph_build import Graph
from lexspark.operators.postings import bm25_scores
from lexspark.operators.sizing import union_all
from lexspark.session import cut_lineage

HIT_ROWS = 500_000  # hits that are broadcast to the provisions


def terms_per_provision(graph: Graph, k: int) -> DataFrame:
    """(id, terms): the first k term names of a provision, sorted."""
    return graph.mentions.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("term")), 1, k).alias("terms"))


def search_provisions(queries: DataFrame, graph: Graph, k: int = 6, k_terms: int = 6) -> DataFrame:
    """Ranked provisions per query over title, text, cite, module and domain."""
    fields = F.concat_ws(" ", "title", "text", "cite", "module", "domain")
    hits = cut_lineage(bm25_scores(queries, graph.provisions.select(F.col("id").alias("doc_key"), fields.alias("text")), k).withColumnRenamed("doc_key", "id"))
    # the hits are the small side: provisions and terms are filtered by them where they are read
    near = F.broadcast if hits.count() <= HIT_ROWS else lambda df: df
    found = graph.provisions.drop("terms").join(near(hits), "id")
    ids = hits.select("id").distinct()
    named = terms_per_provision(graph._replace(mentions=graph.mentions.join(near(ids), "id", "left_semi")), k_terms)
    return found.join(named.hint("shuffle_merge"), "id", "left").select(
        "query_id", "rank", "score", "id", "cite", "title", "text", "module", "domain", "threshold", "deadline",
        F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def _nearest(neighbours: DataFrame, k: int, node: str) -> DataFrame:
    """The k smallest neighbours (cite, id) of each node; pruned per partition
    before the shuffle, so a hub with a third of all edges stays cheap."""
    w = Window.partitionBy(node).orderBy("cite", "other")
    return neighbours.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def one_hop(seeds: DataFrame, graph: Graph, k_related: int = 6, k_terms: int = 10) -> DataFrame:
    """(query_id, must_terms, related_cites) from outgoing links and terms of
    the chunks of each seed cite. seeds: (query_id, cite). Chunks are merged once
    per cite, so questions about one cite share its sets and meet no chunk."""
    chunks = graph.provisions.select("id", "cite").distinct()
    named = graph.provisions.select(F.col("id").alias("dst"), F.col("cite").alias("to_cite"))
    out = graph.links.where("type IN ('DEFINED_BY', 'CITES', 'RELATES_TO')").join(named, "dst")
    out = out.select("src", "to_cite").distinct()
    w = Window.partitionBy("src").orderBy("to_cite")
    related = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k_related).select(F.col("src").alias("id"), F.col("to_cite").alias("related"))
    tw = Window.partitionBy("id").orderBy("term")
    named_terms = graph.mentions.withColumn("n", F.row_number().over(tw)).where(F.col("n") <= k_terms).select("id", "term")
    # sets are merged from distinct rows, so a cite shared by very many chunks
    # adds each value once and not one list per chunk
    none = F.lit(None).cast("string")
    values = union_all([
        chunks.join(named_terms, "id").select("cite", "term", none.alias("related")),
        chunks.join(related, "id").select("cite", none.alias("term"), "related"),
        chunks.select("cite", none.alias("term"), none.alias("related")),
    ]).distinct()
    per_cite = values.groupBy("cite").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.sort_array(F.collect_set("related")).alias("related"))
    merged = lambda name: F.sort_array(F.array_distinct(F.flatten(F.collect_set(name))))
    return seeds.select("query_id", "cite").join(per_cite, "cite").groupBy("query_id").agg(merged("terms").alias("must_terms"), merged("related").alias("related_cites"))


def two_hops(seeds: DataFrame, graph: Graph, limit: int = 20, max_hops: int = 2) -> DataFrame:
    """Nearest provisions around the seeds over undirected CITES, DEFINED_BY and
    MENTIONS paths: (query_id, seed_id, related_id, related_cite, hops).

    Keeps the `limit` nearest (seed, related) pairs per query, ordered by hops,
    cite and id. Because of that order an intermediate node never contributes
    more than its first limit + 1 neighbours: of those at most one is the seed
    and every other one left out is already a nearer hit. So hub terms are not
    expanded to all pairs, and the result is still exact.
    """
    names = graph.provisions.select("id", "cite")
    both = graph.links.select("src", "dst").unionByName(graph.links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    linked = both.where("src <> dst").distinct().join(names, F.col("dst") == F.col("id")).select(
        F.col("src").alias("node"), F.col("dst").alias("other"), "cite")
    bridged = graph.mentions.join(names, "id").select(F.concat(F.lit("term:"), "term").alias("node"), F.col("id").alias("other"), "cite")
    start = seeds.join(names, "cite").select("query_id", F.col("id").alias("seed_id")).distinct()
    if max_hops > 2:
        return _many_hops(start, linked, graph, limit, max_hops)
    first = _nearest(linked, limit + 1, "node")
    hop1 = start.join(first, F.col("seed_id") == F.col("node")).select("query_id", "seed_id", "other", "cite", F.lit(1).alias("hops"))
    if max_hops == 1:
        found = hop1
    else:
        own_terms = start.join(graph.mentions, F.col("seed_id") == F.col("id")).select(
            "query_id", "seed_id", F.concat(F.lit("term:"), "term").alias("via"))
        via = hop1.select("query_id", "seed_id", F.col("other").alias("via")).unionByName(own_terms)
        lists = first.unionByName(_nearest(bridged, limit + 1, "node"))
        hop2 = via.join(lists, F.col("via") == F.col("node")).select("query_id", "seed_id", "other", "cite", F.lit(2).alias("hops"))
        found = hop1.unionByName(hop2)
    return _best_pairs(found, limit)


def _best_pairs(found: DataFrame, limit: int) -> DataFrame:
    nearest = found.where("other <> seed_id").groupBy("query_id", "seed_id", "other", "cite").agg(F.min("hops").alias("hops"))
    w = Window.partitionBy("query_id").orderBy("hops", "cite", "other", "seed_id")
    return nearest.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(
        "query_id", "seed_id", F.col("other").alias("related_id"), F.col("cite").alias("related_cite"), "hops")


def _many_hops(start: DataFrame, linked: DataFrame, graph: Graph, limit: int, max_hops: int) -> DataFrame:
    """Nearest-provision lists of every node, grown by one hop a round.

    A node's `limit + 1` nearest provisions (itself at 0 included; by hops, cite
    and id) are among those lists of its neighbours: whatever a neighbour left
    out has limit + 1 nearer ones there, which are nearer to the node as well.
    So a round moves at most limit + 1 rows over an edge, hub terms stay nodes,
    and seeds shared by many questions are expanded once. Only nodes that a
    seed can still reach get a list.

    Pairs are ordered by hops first, so a question with `limit` direct
    neighbours has its answer: its seeds are not walked any further.
    """
    keep = limit + 1
    direct = start.join(_nearest(linked.distinct(), keep, "node"), F.col("seed_id") == F.col("node"))
    near = cut_lineage(_best_pairs(direct.select("query_id", "seed_id", "other", "cite", F.lit(1).alias("hops")), limit))
    full = cut_lineage(near.groupBy("query_id").count().where(F.col("count") >= limit).select("query_id"))
    start = cut_lineage(start.join(full, "query_id", "left_anti"))
    if start.isEmpty():
        return near
    term = F.concat(F.lit("term:"), "term")
    steps = cut_lineage(linked.select("node", "other").unionByName(graph.mentions.select(term.alias("node"), F.col("id").alias("other")))
                        .unionByName(graph.mentions.select(F.col("id").alias("node"), term.alias("other"))))
    within = [cut_lineage(start.select(F.col("seed_id").alias("node")).distinct())]
    for _ in range(max_hops - 1):
        around = steps.join(within[-1], "node", "left_semi").select(F.col("other").alias("node"))
        within.append(cut_lineage(within[-1].unionByName(around).distinct()))
    lists = graph.provisions.select(F.col("id").alias("node"), F.col("id").alias("found"), "cite", F.lit(0).alias("hops"))
    w = Window.partitionBy("node").orderBy("hops", "cite", "found")
    for hop in range(1, max_hops + 1):
        asked = within[max_hops - hop]
        fresh = lists.where(F.col("hops") == hop - 1).select(F.col("node").alias("other"), "found", "cite")
        moved = steps.join(asked, "node", "left_semi").join(fresh, "other").select("node", "found", "cite", F.lit(hop).alias("hops"))
        merged = lists.join(asked, "node", "left_semi").unionByName(moved).groupBy("node", "found", "cite").agg(F.min("hops").alias("hops"))
        lists = cut_lineage(merged.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n"))
    found = start.join(lists.where("hops > 0"), F.col("seed_id") == F.col("node")).select("query_id", "seed_id", F.col("found").alias("other"), "cite", "hops")
    return near.join(full, "query_id", "left_semi").unionByName(_best_pairs(found, limit))


def expansion_summary(expanded: DataFrame, graph: Graph, k_terms: int = 6) -> DataFrame:
    """(query_id, related_cites with hops, must_terms), at most `limit` rows per
    query going in."""
    rows = expanded.join(terms_per_provision(graph, k_terms), F.col("related_id") == F.col("id"), "left")
    per_cite = rows.groupBy("query_id", "related_cite").agg(F.min("hops").alias("hops"), F.flatten(F.collect_list("terms")).alias("terms"))
    return per_cite.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("related_cite", "hops"))).alias("related"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("must_terms"))


def graph_boost(queries: DataFrame, graph: Graph, k: int = 6, seeds: int = 3, related: int = 5) -> DataFrame:
    """(query_id, context_md, source_line, must_terms) for every query with hits."""
    hits = cut_lineage(search_provisions(queries, graph, k, k_terms=8).where(F.col("rank") <= seeds))
    bullet = provision_bullet(F.col("cite"), F.col("title"), F.col("text"), F.col("module"), F.col("domain"), F.col("threshold"), F.col("deadline"))
    top = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "cite", bullet.alias("bullet")))).alias("top"),
        F.flatten(F.collect_list("terms")).alias("seed_terms"))
    expanded = expansion_summary(two_hops(hits.where("cite <> ''").select("query_id", "cite").distinct(), graph), graph)
    joined = top.join(expanded, "query_id", "left")
    cites = F.transform("top", lambda t: t["cite"])
    fresh = F.slice(F.filter(F.coalesce("related", F.array().cast("array<struct<related_cite:string,hops:int>>")),
                             lambda r: ~F.array_contains(cites, r["related_cite"])), 1, related)
    note = F.array_join(F.transform(fresh, lambda r: F.concat(r["related_cite"], F.lit(" ("), r["hops"].cast("string"), F.lit("-hop)"))), ", ")
    bullets = F.concat(
        F.transform("top", lambda t: t["bullet"]),
        F.when(F.size(fresh) > 0, F.array(F.concat(F.lit("- *Related (2-hop)*: "), note))).otherwise(F.array().cast("array<string>")))
    return joined.select(
        "query_id",
        F.concat(F.lit("**Graph hits:**\n"), F.array_join(bullets, "\n"), F.lit("\n\n")).alias("context_md"),
        F.array_join(F.slice(F.filter(cites, lambda c: c != ""), 1, 4), " | ").alias("source_line"),
        F.sort_array(F.array_distinct(F.concat("seed_terms", F.coalesce("must_terms", F.array().cast("array<string>"))))).alias("must_terms"))


def boost_bullets(boost: DataFrame) -> DataFrame:
    """(query_id, pos, bullet) lines of the context block, without the dash."""
    lines = boost.select("query_id", F.posexplode(F.split("context_md", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").startswith("- ") & (F.length("line") > 4)).select("query_id", "pos", F.substr("line", F.lit(3)).alias("bullet"))


def shortest_paths(roots: DataFrame, graph: Graph, max_hops: int = 6) -> DataFrame:
    """Shortest undirected CITES paths from each root to every provision within
    reach: (root, id, hops, path of ids). Among equally short paths the smallest.

    Breadth first: one join per level against the edges, nodes already reached
    removed, the level materialised so the plan does not grow.
    """
    cites = graph.links.where("type = 'CITES'").select("src", "dst")
    steps = cites.unionByName(cites.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops"), F.array("id").alias("path"))
    reached = frontier
    for hop in range(1, max_hops + 1):
        grown = frontier.join(steps, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        fresh = grown.join(reached.select("root", "id"), ["root", "id"], "left_anti")
        frontier = cut_lineage(fresh.groupBy("root", "id").agg(F.min("path").alias("path")).withColumn("hops", F.lit(hop)).select("root", "id", "hops", "path"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def cite_paths(paths: DataFrame, graph: Graph) -> DataFrame:
    """Ids of a path to cites (a path has at most max_hops + 1 nodes)."""
    nodes = paths.select("root", "id", "hops", F.posexplode("path").alias("pos", "node"))
    named = nodes.join(graph.provisions.select(F.col("id").alias("node"), "cite"), "node")
    grouped = named.groupBy("root", "id", "hops").agg(F.sort_array(F.collect_list(F.struct("pos", "cite"))).alias("p"))
    return grouped.select("root", "id", "hops", F.array_join(F.transform("p", lambda x: x["cite"]), " > ").alias("path"))
