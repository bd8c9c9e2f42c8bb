"""Compress chains into unitigs; their members, edges, layout and sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import reverse_complement
from strandweave.operators.chains import chain_table
from strandweave.operators.graph import Graph, degrees
from strandweave.plans.ordering import with_index
from strandweave.plans.settle import table
from strandweave.sources.readers import sequences_by_name


@dataclass(frozen=True)
class Unitigs:
    """``members(unitig_id, pos, node, next, edge_len, offset)``,
    ``unitigs(unitig_id, n_members, first, last, topology)`` and
    ``edges(from_id, to_id, from_ori, to_ori, edge_len, overlap_len, identity)``."""

    unitigs: DataFrame
    members: DataFrame
    edges: DataFrame


def _starts(graph: Graph, chains: DataFrame) -> DataFrame:
    """One row per unitig: ``(head, lead, lead_len, self_closed, topology)``.

    ``lead`` is the branching node in front of the chain, null when the chain's own head
    opens the unitig.
    """
    deg = degrees(graph)
    tails = chains.groupBy("head", "cyclic").agg(
        F.max("pos").alias("last_pos"), F.max_by("nid", "pos").alias("tail")
    )
    heads = tails.join(deg.select(F.col("nid").alias("head"), "n_in"), "head")
    none = F.lit(None).cast("bigint")
    own = heads.filter("not cyclic and n_in != 1 and last_pos > 0").select(
        "head", none.alias("lead"), none.alias("lead_len"), F.lit(False).alias("closed"), F.lit("l").alias("topology")
    )
    # the only edge into a head with in-degree 1 comes from a branching node
    into = graph.edges.select(
        F.col("dst").alias("head"), F.col("src").alias("lead"), F.col("edge_len").alias("lead_len")
    )
    led = (
        heads.filter("not cyclic and n_in = 1")
        .join(into, "head")
        .select("head", "lead", "lead_len", (F.col("lead") == F.col("tail")).alias("closed"), F.lit("l").alias("topology"))
        # a chain that is nothing but its own lead has no second member
        .filter("head != lead")
    )
    ring = heads.filter("cyclic").select(
        "head", none.alias("lead"), none.alias("lead_len"), F.lit(False).alias("closed"), F.lit("c").alias("topology")
    )
    return own.unionByName(led).unionByName(ring)


def compress(graph: Graph, singletons: bool = False) -> Unitigs:
    """Maximal non-branching paths as unitigs, before twin removal.

    Every out-edge of a node that is not one-in-one-out opens a unitig when its target has
    in-degree 1; the branching node in front is the first member, so it may belong to
    several unitigs. Nodes on unbranched cycles form circular unitigs. ``singletons`` adds
    the nodes that no unitig covers, which are left out by default.
    """
    parts = chain_table(graph)
    chains = parts.nodes
    starts = _starts(graph, chains)
    order = F.coalesce("lead", "head")
    numbered = table(
        with_index(starts.withColumn("first", order), ["first", "head"], "unitig_id"), "unitig-starts"
    )
    follow = parts.links.select(
        F.col("src").alias("nid"), F.col("dst").alias("next"), F.col("edge_len").alias("edge_len")
    )
    shift = F.when(F.col("lead").isNull(), 0).otherwise(1)
    body = (
        chains.join(numbered, "head")
        .filter("not (closed and nid = lead)")
        .join(follow, "nid", "left")
        .select(
            "unitig_id",
            (F.col("pos") + shift).alias("pos"),
            F.col("nid").alias("node"),
            # a path that runs back into its own lead ends one node before it
            F.when(~(F.col("closed") & F.coalesce(F.col("next") == F.col("lead"), F.lit(False))), F.col("next")).alias("next"),
            F.when(~(F.col("closed") & F.coalesce(F.col("next") == F.col("lead"), F.lit(False))), F.col("edge_len")).alias("edge_len"),
            (F.col("offset") + F.coalesce("lead_len", F.lit(0).cast("bigint"))).alias("offset"),
        )
    )
    zero = F.lit(0).cast("bigint")
    front = numbered.filter("lead is not null").select(
        "unitig_id",
        zero.alias("pos"),
        F.col("lead").alias("node"),
        F.col("head").alias("next"),
        F.col("lead_len").alias("edge_len"),
        zero.alias("offset"),
    )
    members = body.unionByName(front)
    topology = numbered.select("unitig_id", "topology")
    if singletons:
        members, topology = _with_singletons(graph, table(members, "members"), topology)
    members = table(members, "members")
    unitigs = (
        members.groupBy("unitig_id")
        .agg(
            F.count("*").alias("n_members"),
            F.min_by("node", "pos").alias("first"),
            F.max_by("node", "pos").alias("last"),
        )
        .join(topology, "unitig_id")
    )
    unitigs = table(unitigs, "unitigs")
    return Unitigs(unitigs, members, unitig_edges(graph, unitigs, members))


def _with_singletons(graph: Graph, members: DataFrame, topology: DataFrame):
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    lone = graph.nodes.select("nid").join(
        members.select(F.col("node").alias("nid")).distinct(), "nid", "left_anti"
    )
    n = topology.count()
    lone = table(with_index(lone, ["nid"], "i").withColumn("unitig_id", F.col("i") + n), "lone")
    extra = lone.select(
        "unitig_id", zero.alias("pos"), F.col("nid").alias("node"), none.alias("next"), none.alias("edge_len"), zero.alias("offset")
    )
    return (
        members.unionByName(extra),
        topology.unionByName(lone.select("unitig_id", F.lit("l").alias("topology"))),
    )


def unitig_edges(graph: Graph, unitigs: DataFrame, members: DataFrame) -> DataFrame:
    """Graph edges between different unitigs, merged per pair and orientations.

    A shared node counts for its smallest unitig. An end is ``+`` when the node is its
    unitig's first member.
    """
    home = members.groupBy(F.col("node").alias("nid")).agg(F.min("unitig_id").alias("unitig_id"))
    home = home.join(unitigs.select("unitig_id", "first"), "unitig_id").select(
        "nid", "unitig_id", F.when(F.col("nid") == F.col("first"), "+").otherwise("-").alias("ori")
    )

    def end(node: str, prefix: str) -> DataFrame:
        return home.select(
            F.col("nid").alias(node),
            F.col("unitig_id").alias(f"{prefix}_id"),
            F.col("ori").alias(f"{prefix}_ori"),
        )

    return (
        graph.edges.join(end("src", "from"), "src")
        .join(end("dst", "to"), "dst")
        .filter("from_id != to_id")
        .groupBy("from_id", "to_id", "from_ori", "to_ori")
        .agg(
            F.min("edge_len").alias("edge_len"),
            F.max("overlap_len").alias("overlap_len"),
            F.max("identity").alias("identity"),
        )
    )


def kept_after_twins(unitigs: DataFrame, members: DataFrame) -> DataFrame:
    """``(unitig_id)`` left when going through the unitigs, most members first, and keeping
    those with a read not seen before: the first-ranked holders of at least one read."""
    sized = members.select("unitig_id", F.shiftright("node", 1).alias("read_idx")).join(
        unitigs.select("unitig_id", "n_members"), "unitig_id"
    )
    return (
        sized.groupBy("read_idx")
        .agg(F.min_by("unitig_id", F.struct(-F.col("n_members"), F.col("unitig_id"))).alias("unitig_id"))
        .select("unitig_id")
        .distinct()
    )


def drop_twins(u: Unitigs, fold: bool = False) -> Unitigs:
    """Keep one strand of every unitig; edges touching a dropped unitig go with it.

    ``fold`` moves those edges to the kept unitig that holds the dropped one's first read.
    """
    keep = table(kept_after_twins(u.unitigs, u.members), "kept")
    edges = u.edges
    if fold:
        edges = _folded(u, keep)

    def side(col: str) -> DataFrame:
        return keep.withColumnRenamed("unitig_id", col)

    return Unitigs(
        u.unitigs.join(keep, "unitig_id", "left_semi"),
        u.members.join(keep, "unitig_id", "left_semi"),
        edges.join(side("from_id"), "from_id", "left_semi").join(side("to_id"), "to_id", "left_semi"),
    )


def _folded(u: Unitigs, keep: DataFrame) -> DataFrame:
    holder = (
        u.members.join(keep, "unitig_id", "left_semi")
        .groupBy(F.shiftright("node", 1).alias("read_idx"))
        .agg(F.min("unitig_id").alias("mate"))
    )
    gone = u.unitigs.join(keep, "unitig_id", "left_anti").select(
        "unitig_id", F.shiftright("first", 1).alias("read_idx")
    )
    moves = gone.join(holder, "read_idx").select("unitig_id", "mate")
    edges = u.edges
    for side in ("from", "to"):
        turned = F.when(F.col(f"{side}_ori") == "+", "-").otherwise("+")
        edges = (
            edges.join(moves.withColumnRenamed("unitig_id", f"{side}_id"), f"{side}_id", "left")
            .withColumns(
                {
                    f"{side}_ori": F.when(F.col("mate").isNull(), F.col(f"{side}_ori")).otherwise(turned),
                    f"{side}_id": F.coalesce("mate", f"{side}_id"),
                }
            )
            .drop("mate")
        )
    return (
        edges.filter("from_id != to_id")
        .groupBy("from_id", "to_id", "from_ori", "to_ori")
        .agg(
            F.min("edge_len").alias("edge_len"),
            F.max("overlap_len").alias("overlap_len"),
            F.max("identity").alias("identity"),
        )
    )


def topologies(unitigs: DataFrame, members: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``(unitig_id, topology)``: ``c`` when the last member leads back to the first one, or
    an edge in either direction joins the first member and the node the last one leads to.

    ``overlaps(src, dst)`` are the edges before simplification.
    """
    ends = unitigs.filter("n_members > 1").join(
        members.select(F.col("unitig_id"), F.col("node").alias("last"), F.col("next").alias("onward")),
        ["unitig_id", "last"],
    ).filter("onward is not null")
    both = overlaps.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("p")).select(
        F.col("p.src").alias("first"), F.col("p.dst").alias("onward")
    ).distinct()
    closed = (
        ends.filter("onward = first")
        .select("unitig_id")
        .unionByName(ends.join(both, ["first", "onward"], "left_semi").select("unitig_id"))
        .distinct()
        .withColumn("closed", F.lit(True))
    )
    return unitigs.join(closed, "unitig_id", "left").select(
        "unitig_id", F.when(F.col("closed"), "c").otherwise("l").alias("topology")
    )


def layout(members: DataFrame, nodes: DataFrame, compat: bool = False) -> DataFrame:
    """``(unitig_id, pos, read, cov_start, cov_end, ori, utg_start, utg_end)``.

    A member contributes the bases up to the next one, the last member of a linear unitig
    its whole region. ``compat`` gives the last member of a circular unitig its whole
    region too, although its sequence holds only the step.
    """
    described = members.join(nodes.withColumnRenamed("nid", "node"), "node")
    whole = F.col("cov_end") - F.col("cov_start")
    length = F.coalesce("edge_len", whole)
    if compat:
        final = members.groupBy("unitig_id").agg(F.max("pos").alias("final"))
        described = described.join(final, "unitig_id")
        length = F.when(F.col("pos") == F.col("final"), whole).otherwise(length)
    return described.select(
        "unitig_id",
        "pos",
        "read",
        "cov_start",
        "cov_end",
        "ori",
        F.col("offset").alias("utg_start"),
        (F.col("offset") + length).alias("utg_end"),
    )


def _piece() -> Column:
    n = F.col("utg_end") - F.col("utg_start")
    region = F.col("cov_end") - F.col("cov_start")
    ahead = F.expr("substring(seq, int(cov_start + 1), int(utg_end - utg_start))")
    back = F.expr("substring(seq, int(cov_end - (utg_end - utg_start) + 1), int(utg_end - utg_start))")
    return F.when(
        n > region,
        F.raise_error(
            F.concat(F.lit("step longer than the region of read "), F.col("read")),
        ).cast("string"),
    ).otherwise(F.when(F.col("ori") == "+", ahead).otherwise(reverse_complement(back)))


def sequence_pieces(placed: DataFrame, reads: DataFrame) -> DataFrame:
    """``(unitig_id, pos, utg_start, utg_end, piece)`` from a layout and ``reads(name, seq)``.

    Of several records of a name the one with the last ``rec_no`` counts; without that column
    names are taken to be unique. A read of the layout that is not among them is an error.
    """
    wanted = placed.select(F.col("read").alias("name")).distinct()
    found = reads.select("name", "seq")
    if "rec_no" in reads.columns:
        found = sequences_by_name(reads.join(wanted, "name", "left_semi"))
    missing = F.raise_error(F.concat(F.lit("no sequence for read "), F.col("read"))).cast("string")
    return (
        placed.join(found.withColumnRenamed("name", "read"), "read", "left")
        .withColumn("seq", F.when(F.col("seq").isNull(), missing).otherwise(F.col("seq")))
        .select("unitig_id", "pos", "utg_start", "utg_end", _piece().alias("piece"))
    )


def sequence_chunks(pieces: DataFrame, width: int = 10_000) -> DataFrame:
    """``(unitig_id, chunk, seq)``: the unitig sequence in lines of ``width`` bases.

    Pieces are cut at line ends first, so a group never exceeds one line however long the
    unitig is.
    """
    spread = pieces.filter("utg_end > utg_start").select(
        "unitig_id",
        "utg_start",
        "utg_end",
        "piece",
        F.explode(
            F.sequence(F.expr(f"utg_start div {width}"), F.expr(f"(utg_end - 1) div {width}"))
        ).alias("chunk"),
    )
    low = F.greatest(F.col("utg_start"), F.col("chunk") * width)
    high = F.least(F.col("utg_end"), (F.col("chunk") + 1) * width)
    cut = spread.select(
        "unitig_id",
        "chunk",
        low.alias("at"),
        F.substring("piece", (low - F.col("utg_start") + 1).cast("int"), (high - low).cast("int")).alias("part"),
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))
    return cut.groupBy("unitig_id", "chunk").agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("seq")
    )


def lengths(placed: DataFrame) -> DataFrame:
    """``(unitig_id, length)`` in bases."""
    return placed.groupBy("unitig_id").agg(F.max("utg_end").alias("length"))
