"""Hierarchy, taxonomy and term lookup derived from dotted tree numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.functions import columns as C
from vinculum.sources.taxonomy import DISEASE_PREFIXES, _in_branch


def branch_numbers(descriptors: DataFrame, prefixes=DISEASE_PREFIXES) -> DataFrame:
    """(id, name, pos, tree_number) of the tree numbers inside the branch."""
    rows = descriptors.select("id", "name", F.posexplode("tree_numbers").alias("pos", "tree_number"))
    return rows.where(_in_branch(F.col("tree_number"), prefixes))


def hierarchy_pairs(descriptors: DataFrame, prefixes=DISEASE_PREFIXES) -> DataFrame:
    """Distinct (parent, child) between consecutive dotted prefixes.

    A number without a dot alone gives nothing. The pairs come from one
    explode; there is no recursion and no per-parent list, so a parent may
    have any number of children.
    """
    parts = F.split("tree_number", r"\.")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.struct(C.dotted_prefix(parts, n).alias("parent"), C.dotted_prefix(parts, n + 1).alias("child")),
    )
    dotted = branch_numbers(descriptors, prefixes).where(F.col("tree_number").contains("."))
    return dotted.select(F.explode(steps).alias("p")).select("p.parent", "p.child").distinct()


def number_owners(descriptors: DataFrame) -> DataFrame:
    """(tree_number, descriptor_id, name): the smallest descriptor id owns a shared number."""
    rows = descriptors.select("id", "name", F.explode("tree_numbers").alias("tree_number"))
    owner = rows.groupBy("tree_number").agg(F.min(F.struct("id", "name")).alias("o"))
    return owner.select("tree_number", F.col("o.id").alias("descriptor_id"), F.col("o.name").alias("name"))


def hierarchy_nodes(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(tree_number, name, descriptor_id, children): every parent and child, labelled.

    ``children`` is the number of child nodes; the nodes themselves stay in
    the pairs.
    """
    entry = lambda c, n: F.struct(F.col(c).alias("tree_number"), F.lit(n).alias("children"))
    counted = (
        pairs.select(F.explode(F.array(entry("parent", 1), entry("child", 0))).alias("n"))
        .groupBy("n.tree_number")
        .agg(F.sum("n.children").alias("children"))
    )
    owners = number_owners(descriptors)
    number = F.col("tree_number")
    unknown = (
        F.when(number.rlike("^[A-Za-z]$"), F.concat(F.lit("Category "), number))
        .otherwise(F.concat(F.lit("Unknown Node ("), number, F.lit(")")))
    )
    return counted.join(owners, "tree_number", "left").select(
        "tree_number", F.coalesce("name", unknown).alias("name"), "descriptor_id", "children"
    )


def child_only_numbers(pairs: DataFrame) -> DataFrame:
    """Nodes that are somebody's child but nobody's parent."""
    children = pairs.select(F.col("child").alias("tree_number"))
    return children.subtract(pairs.select(F.col("parent").alias("tree_number")))


def parent_rows(descriptors: DataFrame, nodes: DataFrame, prefixes=DISEASE_PREFIXES) -> DataFrame:
    """(id, pos, parent_id, parent_name, parent_number), one row per distinct parent.

    The parent number is the tree number without its last part. Parents are
    told apart by descriptor, or by number where no descriptor owns it.
    """
    dotted = branch_numbers(descriptors, prefixes).where(F.col("tree_number").contains("."))
    wanted = dotted.select("id", "pos", F.regexp_replace("tree_number", r"\.[^.]*$", "").alias("parent_number"))
    side = nodes.select(
        F.col("tree_number").alias("parent_number"),
        F.col("descriptor_id").alias("parent_id"),
        F.col("name").alias("parent_name"),
    )
    found = wanted.join(side, "parent_number")
    same = F.coalesce("parent_id", F.concat(F.lit("number "), F.col("parent_number")))
    first = found.groupBy("id", same.alias("same")).agg(
        F.min(F.struct("pos", "parent_id", "parent_name", "parent_number")).alias("p")
    )
    return first.select("id", "p.pos", "p.parent_id", "p.parent_name", "p.parent_number")


def extract_taxonomy(descriptors: DataFrame, nodes: DataFrame, prefixes=DISEASE_PREFIXES) -> DataFrame:
    """One row per disease descriptor with its branch numbers, parents and top-level flag.

    The parents of a descriptor are at most as many as its own tree numbers,
    so the list per row is bounded by the row's input.
    """
    info = F.struct(
        F.col("pos"),
        F.col("parent_id").alias("id"),
        F.col("parent_name").alias("name"),
        F.col("parent_number").alias("tree_number"),
    )
    per_id = parent_rows(descriptors, nodes, prefixes).groupBy("id").agg(F.array_sort(F.collect_list(info)).alias("p"))
    numbers = F.filter("tree_numbers", lambda t: _in_branch(t, prefixes))
    diseases = descriptors.withColumn("tree_numbers", numbers).where(F.size("tree_numbers") > 0)
    no_parents = F.array().cast("array<struct<id: string, name: string, tree_number: string>>")
    return diseases.join(per_id, "id", "left").select(
        "id",
        "name",
        "description",
        "tree_numbers",
        "synonyms",
        F.coalesce(
            F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["tree_number"].alias("tree_number"))),
            no_parents,
        ).alias("parents"),
        F.forall("tree_numbers", lambda t: ~t.contains(".")).alias("is_top_level"),
    )


def term_dictionary(descriptors: DataFrame, order: str = "id", keep: list[str] | None = None) -> DataFrame:
    """(term, id): lower-cased names and synonyms.

    The last descriptor with the term as its name wins; without one, the
    first with it as a synonym. ``keep`` names extra key columns (the year).
    """
    keep = keep or []
    entry = lambda text, is_name: F.struct(F.lower(text).alias("term"), F.lit(is_name).alias("is_name"))
    entries = F.concat(F.array(entry(F.col("name"), True)), F.transform("synonyms", lambda s: entry(s, False)))
    rows = descriptors.select(*keep, "id", F.col(order).alias("_ord"), F.explode(entries).alias("e"))
    by_name = F.max_by("id", F.when(F.col("e.is_name"), F.col("_ord")))
    by_synonym = F.min_by("id", F.when(~F.col("e.is_name"), F.col("_ord")))
    return rows.groupBy(*keep, F.col("e.term").alias("term")).agg(F.coalesce(by_name, by_synonym).alias("id"))


def latest_per_key(yearly: DataFrame, key: str = "id", year: str = "year") -> DataFrame:
    """Yearly rows combined: the latest year of each key; keys missing later survive."""
    rest = [c for c in yearly.columns if c != key]
    latest = yearly.groupBy(key).agg(F.max_by(F.struct(*rest), year).alias("r"))
    return latest.select(key, *[F.col("r")[c].alias(c) for c in rest])


def disease_lookup(yearly: DataFrame) -> DataFrame:
    """Latest descriptors that still have a name."""
    latest = latest_per_key(yearly)
    return latest.where(~C.is_blank(F.col("name")))
