"""Bounded path search and neighbourhood lookup for whole tables of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculum.functions.ranking import top_k
from vinculum.operators.adjacency import Adjacency, both_ways, held, scanned, stored
from vinculum.session import drop_stored, write_through

# Default limits of a path search and of suggestions.
PATH_LIMIT = 20
SUGGESTION_LIMIT = 10
MAX_HOPS = 3

# Query texts are joined to names on one substring of at most this length.
GRAM = 3

# Connections of one entity are collected in lists of about this length.
CHUNK = 1000
LIST_EDGES = 1_000_000  # of one entity that stay together while lists are made
ROUND_EDGES = 2_000_000  # about as many edges, of some entities, are made lists at once
ROUNDS = 8  # at the most
FEW = 100_000  # entities whose ids are sent to the edges

EACH = ["query_id", "node"]


def _grams(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array())

    return F.array_distinct(F.concat(*map(of_length, lengths)))


def match_names(queries: DataFrame, nodes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(query_id, id, type) of the nodes whose name contains the query text, for any number of queries.

    A query asks for the names that hold its rarest substring of ``GRAM`` characters (or all of
    a shorter query), and the name is then compared. Of the names' substrings only those that
    some query has are stored.
    """
    texts = write_through(queries.select("query_id", "query").where(F.length("query") > 0), "texts")
    lengths = [r["n"] for r in texts.select(F.least(F.length("query"), F.lit(GRAM)).alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return nodes.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", "type").limit(0)
    own = F.filter(_grams(F.col("query"), lengths), lambda g: F.length(g) == F.least(F.length("query"), F.lit(GRAM)))
    wanted = texts.select("query_id", "query", F.explode(own).alias("gram"))
    named = nodes.where(F.col("type").isin(*labels) & (F.length("name") > 0)).select("id", "type", "name")
    posted = named.select("id", "type", "name", F.explode(_grams(F.col("name"), lengths)).alias("gram"))
    posted = write_through(posted.join(wanted.select("gram").distinct(), "gram", "left_semi"), "grams")
    frequency = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(frequency, "gram")
        .groupBy("query_id", "query")
        .agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    )
    return rarest.join(posted, "gram").where(F.col("name").contains(F.col("query"))).select("query_id", "id", "type")


# --- reach -----------------------------------------------------------------
#
# Before a trail is lengthened, it is known whether it can end. A table of reach has
# (query_id, node, low, high): ``node`` has a trail of r edges to an end of the query, and
# the first edges of such trails lie between ``low`` and ``high``; if both are one edge that
# the trail has used, it cannot go on.


def _back(reach: DataFrame, adj: Adjacency) -> DataFrame:
    """One edge further from the ends than ``reach``, which is (query_id, node) or has low and high."""
    rows = adj.follow(reach)
    if "low" in reach.columns:
        rows = rows.where((F.col("low") != F.col("edge")) | (F.col("high") != F.col("edge")))
    rows = rows.select("query_id", F.col("to_id").alias("node"), "edge")
    return rows.groupBy("query_id", "node").agg(F.min("edge").alias("low"), F.max("edge").alias("high"))


def _near(adj: Adjacency, end: str) -> DataFrame:
    """(node, low, high) of all nodes with an edge to one of label ``end``; summed where the edges lie."""
    rows = adj.rows.where(F.col("to_type") == end).groupBy(F.col("from_id").alias("node"))
    return rows.agg(F.min("edge").alias("low"), F.max("edge").alias("high"))


def _ahead(asked: DataFrame, adj: Adjacency, r: int, near: DataFrame) -> DataFrame:
    """(node, low, high) for those of the nodes asked that have a trail of ``r`` edges to the label of ``near``."""
    if r == 1:
        return near
    rows = adj.follow(asked).select(F.col("from_id").alias("start"), "edge", F.col("to_id").alias("node"))
    further = near if r == 2 else write_through(_ahead(rows.select("node").distinct(), adj, r - 1, near), "ahead")
    rows = rows.join(further, "node").where((F.col("low") != F.col("edge")) | (F.col("high") != F.col("edge")))
    return rows.groupBy(F.col("start").alias("node")).agg(F.min("edge").alias("low"), F.max("edge").alias("high"))


# --- trails ----------------------------------------------------------------


def _trail(node: Column, *more: Column) -> list[Column]:
    nodes, rel, edge = ([node, more[0]], [F.col("rel")], [F.col("edge")]) if more else ([node], [], [])
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return [
        F.array(*nodes).alias("nodes"),
        (F.array(*rel) if rel else empty("string")).alias("rels"),
        (F.array(*edge) if edge else empty("bigint")).alias("keys"),
    ]


def _step(trails: DataFrame, adj: Adjacency) -> DataFrame:
    """Lengthen every trail by one edge it has not used."""
    rows = adj.follow(trails).where(~F.array_contains("keys", F.col("edge")))
    longer = [F.concat(c, F.array(x)).alias(c) for c, x in (("nodes", "to_id"), ("rels", "rel"), ("keys", "edge"))]
    return rows.select("query_id", F.col("to_id").alias("node"), F.col("to_type").alias("node_type"), *longer)


def _able(trails: DataFrame, left: int, limit: int | None, ends: DataFrame | None, end: str) -> DataFrame:
    """Of trails that have ``low`` and ``high`` of their node, those that can end after ``left`` more edges.

    They are cut to the first ``limit`` per query, those with equal nodes included: as every trail
    that is kept ends somewhere and paths of one length rank by their nodes first, later ones are in
    no result. Trails of which this is not certain are cut on their own: before the last edge where
    both ``low`` and ``high`` are used, before the last two at an end (whose way back can be the
    edge they came by). These begin with a path of one edge, and a query that is still followed
    has fewer of those than ``limit``; so none of them is cut.
    """
    used = lambda c: F.array_contains("keys", F.col(c))
    last = F.element_at("keys", -1)
    if left == 1:
        kept = trails.where(~(used("low") & (F.col("low") == F.col("high"))))
        unsure = used("low") & used("high")
    else:
        kept = trails.where((F.col("low") != last) | (F.col("high") != last))
        unsure = F.col("node_type") == end
        if ends is not None:
            kept = kept.join(ends.withColumn("_end", F.lit(True)), EACH, "left")
            unsure = F.col("_end").isNotNull()
    if limit is not None and left <= 2:
        place = F.rank().over(Window.partitionBy("query_id", "_unsure").orderBy("nodes"))
        kept = kept.withColumn("_unsure", unsure).withColumn("_place", place).where(F.col("_place") <= limit)
    return kept.select("query_id", "node", "node_type", "nodes", "rels", "keys")


def _paths(hops: int, seeds: DataFrame, adj: Adjacency, reach: list[DataFrame] | None, limit: int | None, start: str, end: str, starts: DataFrame, near: DataFrame | None, inward: list[Adjacency]) -> DataFrame:
    """Trails of exactly ``hops`` edges, start node first. ``inward[r]`` has the edges to nodes ``r`` edges from an end, else ``adj`` is asked.

    Without ``reach`` the ``seeds`` are trails of one edge, and lead to any end. With it they are end
    nodes, and paths come from any start that is none of ``starts``; ``reach[r]`` is r edges away.
    """
    cut = limit if start != end else None
    if reach is None:
        trails, ends, final = seeds, None, F.col("node_type") == end
    else:
        rows = adj.follow(reach[hops - 1]).where(F.col("to_type") == start)
        if hops > 1:
            rows = rows.where((F.col("low") != F.col("edge")) | (F.col("high") != F.col("edge")))
        bounds = ["low", "high"] if hops > 1 else []
        rows = rows.join(starts.select("query_id", F.col("node").alias("to_id")), ["query_id", "to_id"], "left_anti")
        trails = rows.select("query_id", F.col("from_id").alias("node"), F.lit(end).alias("node_type"), *_trail(F.col("to_id"), F.col("from_id")), *bounds)
        ends, final = seeds, None
    for left in range(hops - 1, 0, -1):
        if reach is None:
            if left < hops - 1:
                trails = write_through(trails, "trails")
            trails = trails.join(_ahead(trails.select("node").distinct(), adj, left, near), "node")
        elif left < hops - 1:
            trails = trails.join(reach[left], EACH)
        trails = _step(_able(trails, left, cut, ends, end), inward[left - 1] if inward and reach is not None else adj)
    done = trails.where(final) if final is not None else trails if hops == 1 else trails.join(ends, EACH, "left_semi")
    return _ranked(done.select("query_id", "nodes", "rels", "keys"), limit)


def _ranked(found: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return found
    return top_k(found, ["query_id"], [F.col("nodes"), F.col("rels"), F.col("keys")], limit).drop("rank")


def search_paths(
    queries: DataFrame,
    nodes: DataFrame,
    edges: DataFrame | Adjacency,
    limit: int | None = PATH_LIMIT,
    max_hops: int = MAX_HOPS,
    start: str = "Drug",
    end: str = "Disease",
) -> DataFrame:
    """Paths of 1..``max_hops`` edges between a start and an end node, in either edge direction.

    ``queries`` is (query_id, query); the name of one endpoint must contain
    the query. Trails may revisit nodes but not edges. The result is ordered
    by (hops, nodes, relations): (query_id, rank, hops, nodes, rel_types).

    Paths are enumerated from their start nodes. Where the query names the end, the nodes that
    lie one, two, ... edges before it are found first, from the end backwards: sets of nodes per
    query, not trails. Trails begin in the outermost set and step through the inner ones, so
    none is stored that does not reach the end. Where the query names the start, the nodes met
    are asked the same. As paths rank by length and then by their nodes, trails are cut to the
    first ``limit`` per query before their last and last but one step (exactly, see ``_able``);
    a hub on the way adds its edges once, not their products. A query that has its ``limit``
    is not followed any deeper.

    ``edges`` are a stored table or an ``Adjacency``. Paths of one edge and paths back from an end
    are looked up by scans of a table; it is stored as an ``Adjacency`` only if a query that
    names start nodes is followed beyond one edge. Set tables are stored, so that
    Spark knows their size: small ones are broadcast to the edges, large ones shuffled to them.
    """
    adj = edges if isinstance(edges, Adjacency) else scanned(edges)
    matches = write_through(match_names(queries, nodes, (start, end)), "matches")
    side = lambda label: matches.where(F.col("type") == label).select("query_id", F.col("id").alias("node"))
    starts, ends = side(start), side(end)
    present = {r["type"] for r in matches.select("type").distinct().collect()}
    first = _step(starts.select(*EACH, *_trail(F.col("node"))), adj) if start in present else None
    near = None
    reach, open_starts = [ends], starts
    inward: list[Adjacency] = []
    levels: list[DataFrame] = []
    for hops in range(1, max_hops + 1):
        if hops > 1 and start in present and near is None:
            adj = stored(edges)
            first = write_through(_step(open_starts.select(*EACH, *_trail(F.col("node"))), adj), "first")
            near = write_through(_near(adj, end), "near")
        if hops > 1 and end in present:
            around = adj
            if not adj.bucketed:
                around, back = held(adj, reach[-1])
                inward.append(back)
            reach.append(write_through(_back(reach[-1], around), f"reach{hops - 1}"))
        found = []
        if start in present:
            found.append(_paths(hops, first, adj, None, limit, start, end, starts, near, inward))
        if end in present:
            found.append(_paths(hops, ends, adj, reach, limit, start, end, starts, near, inward))
        if not found:
            break
        level = _ranked(reduce(DataFrame.unionByName, found), limit)
        level = level.select("query_id", F.lit(hops).alias("hops"), "nodes", F.col("rels").alias("rel_types"), "keys")
        if limit is None or hops == max_hops:
            levels.append(level)
            continue
        levels.append(write_through(level, f"paths{hops}"))
        counts = reduce(DataFrame.unionByName, levels).groupBy("query_id").agg(F.count("*").alias("n"))
        served = write_through(counts.where(F.col("n") >= limit).select("query_id"), "served")
        open_ = lambda rows: rows.join(served, "query_id", "left_anti")  # noqa: B023, E731
        present = {r["type"] for r in open_(matches).select("type").distinct().collect()}
        if not present:
            break
        ends, open_starts, reach = open_(side(end)), open_(starts), [open_(x) for x in reach]
        if near is not None:
            first = open_(first)
    if not levels:
        none = matches.select("query_id", F.lit(0).alias("hops"), F.array("id").alias("nodes"), F.array("id").alias("rel_types"), F.array().cast("array<bigint>").alias("keys"))
        levels = [none.limit(0)]
    paths = reduce(DataFrame.unionByName, levels)
    if limit is not None:
        order = [F.col("hops"), F.col("nodes"), F.col("rel_types"), F.col("keys")]
        paths = top_k(paths, ["query_id"], order, limit)
        return paths.select("query_id", "rank", "hops", "nodes", "rel_types")
    return paths.select("query_id", "hops", "nodes", "rel_types")


def suggest(queries: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Path search with the suggestion limit."""
    return search_paths(queries, nodes, edges, limit)


def with_node_details(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``node_details array<{id, name, type}>``, in path order.

    Names are joined last, on the few ranked paths only. A list has at most
    ``max_hops + 1`` items.
    """
    keys = ["query_id", "rank"]
    steps = paths.select(*keys, "hops", "rel_types", F.posexplode("nodes").alias("pos", "id"))
    side = nodes.select("id", "name", F.col("type").alias("node_type"))
    detail = F.struct("pos", "id", "name", F.col("node_type").alias("type"))
    grouped = steps.join(side, "id", "left").groupBy(*keys, "hops", "rel_types").agg(
        F.array_sort(F.collect_list(detail)).alias("d")
    )
    details = F.transform("d", lambda d: F.struct(d["id"].alias("id"), d["name"].alias("name"), d["type"].alias("type")))
    return grouped.select(*keys, "hops", details.alias("node_details"), "rel_types")


def _connections(ids: DataFrame, nodes: DataFrame, adj: Adjacency) -> DataFrame:
    """(entity_id, name, type, degree, relation, connected_id, connected), one row per incident edge.

    Degrees are counted where the edges lie, so no row of an edge is stored to find the entities without one.
    """
    found = nodes.join(ids.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi").select("id", "name", "type")
    degrees = adj.rows.groupBy(F.col("from_id").alias("id")).agg(F.count("rel").alias("degree"))
    found = write_through(found.join(degrees, "id", "left"), "entities")
    incident = adj.follow(found.where(F.col("degree").isNotNull()), "id")
    incident = incident.select(F.col("from_id").alias("id"), "name", "type", "degree", F.col("rel").alias("relation"), "to_id")
    names = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("connected"))
    alone = found.where(F.col("degree").isNull()).withColumn("degree", F.lit(0).cast("bigint"))
    rows = incident.join(names, "to_id", "left").unionByName(alone, allowMissingColumns=True)
    return rows.select(F.col("id").alias("entity_id"), "name", "type", "degree", "relation", F.col("to_id").alias("connected_id"), "connected")


def entity_connections(ids: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """(entity_id, name, type, relation, connected_id, connected), one row per incident edge.

    An entity without edges keeps one row of nulls. The entities are looked up in the stored
    adjacency, so the edge table is not shuffled, and rows are never collected.
    """
    return _connections(ids, nodes, stored(edges)).drop("degree")


def _listed(ids: DataFrame, nodes: DataFrame, edges: DataFrame, chunk: int) -> DataFrame:
    """``entity_details`` from edges of which no adjacency is stored.

    A row of an edge is shuffled by its other end for the name of that, and by the entity for its list, in steps
    of their own and with no column that the list doesn't need. Entities come in rounds of about ``ROUND_EDGES``
    edges, so that only the lists themselves are ever on disk as a whole. An entity with more than ``LIST_EDGES``
    edges is dealt in parts, by chunk.
    """
    found = nodes.join(ids.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi").select("id", "name", "type")
    found = write_through(found, "asked")
    ways = both_ways(edges).select("from_id", "to_id", "rel")
    if found.count() <= FEW:
        ways = ways.join(F.broadcast(found.select(F.col("id").alias("from_id")).distinct()), "from_id", "left_semi")
    degrees = ways.groupBy(F.col("from_id").alias("id")).agg(F.count("rel").alias("degree"))
    lists = F.greatest(F.ceil(F.col("degree") / chunk), F.lit(1)).alias("lists")
    parts = F.least(F.greatest(F.ceil(F.col("degree") / LIST_EDGES), F.lit(1)), F.col("lists")).cast("int").alias("parts")
    found = found.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    found = write_through(found.select("*", lists).select("*", parts), "entities")
    hubs = write_through(found.where("parts > 1").select(F.col("id").alias("from_id"), "lists", "parts").distinct(), "hubs")
    hubs = None if hubs.isEmpty() else hubs
    total = found.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    rounds = min(max(1, -(-total // ROUND_EDGES)), ROUNDS)
    names = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("connected"))
    spot = F.xxhash64("rel", "to_id")
    out = []
    for turn in range(rounds):
        has_turn = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == turn  # noqa: B023, E731
        named = write_through(ways.where(has_turn("from_id")).join(names, "to_id", "left"), "named")
        rows = named.select("from_id", F.col("rel").alias("relation"), "connected", F.shiftright(spot, 32).cast("int").alias("spot"))
        own = found.where(has_turn("id"))
        if hubs is None:
            own = own.join(rows, F.col("id") == F.col("from_id"), "left").withColumn("part", F.lit(0))
        else:
            part = F.coalesce(F.pmod(F.pmod("spot", "lists"), "parts"), F.lit(0)).cast("int").alias("_part")
            rows = rows.join(hubs, "from_id", "left").select("from_id", "relation", "connected", "spot", part)
            own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            own = own.join(rows, (F.col("id") == F.col("from_id")) & (F.col("part") == F.col("_part")), "left")
            own = own.where("from_id is not null or parts = 1")  # a part may be empty
        own = own.withColumn("chunk", F.coalesce(F.pmod("spot", "lists"), F.lit(0)).cast("int"))
        grouped = own.groupBy(F.col("id").alias("entity_id"), "part", "name", "type", "degree", "chunk")
        out.append(write_through(grouped.agg(F.array_sort(F.collect_list(F.struct("relation", "connected"))).alias("connections")).drop("part"), "lists"))
        drop_stored(named)
    return reduce(DataFrame.unionByName, out)


def entity_details(ids: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, chunk: int = CHUNK) -> DataFrame:
    """(entity_id, name, type, degree, chunk, connections[{relation, connected}]).

    The list of an entity is spread by hash over ``degree / chunk`` rows, at least one, whole in sum.
    """
    if not isinstance(edges, Adjacency):
        return _listed(ids, nodes, edges, chunk)
    pair = F.struct("relation", "connected")
    parts = F.greatest(F.ceil(F.col("degree") / chunk), F.lit(1))
    placed = _connections(ids, nodes, edges).withColumn("chunk", F.pmod(F.xxhash64("relation", "connected_id"), parts).cast("int"))
    return placed.groupBy("entity_id", "name", "type", "degree", "chunk").agg(F.array_sort(F.collect_list(pair)).alias("connections"))
