"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave import assembly as asm
from strandweave.functions.sequence import node_id_parts, reverse_complement
from strandweave.operators import alignments as al
from strandweave.operators import bubbles as bb
from strandweave.operators import chains as ch
from strandweave.operators import completion as cp
from strandweave.operators import components as cc
from strandweave.operators import detection as dt
from strandweave.operators import graph as gr
from strandweave.operators import heuristics as hs
from strandweave.operators import overlaps as ov
from strandweave.operators import reads as rd
from strandweave.operators import reduction as red
from strandweave.operators import stats as st
from strandweave.operators import tips as tp
from strandweave.operators import unitigs as ut
from strandweave.params import Params
from strandweave.plans.settle import shared_dir, table
from strandweave.session import tune
from strandweave.sources import readers, sinks
from strandweave.workload import fixtures as fx

P = Params()
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(tune(spark), sf)

    run.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = run
    return run


def _aln(spark: SparkSession, sf: str) -> DataFrame:
    return table(fx.virtual_alignments(spark, sf), "alignments")


def _passed(spark: SparkSession, sf: str) -> DataFrame:
    return al.passing(_aln(spark, sf), P)


def _filtered(spark: SparkSession, sf: str, params: Params = P) -> ov.Filtered:
    return ov.filter_alignments(_aln(spark, sf), params)


def _graph(spark: SparkSession, sf: str, params: Params = P) -> gr.Graph:
    return gr.build(_filtered(spark, sf, params).overlaps).settled("built")[0]


def _named_edges(graph: gr.Graph) -> DataFrame:
    ids = graph.nodes.select("nid", "node_id")
    return (
        graph.edges.join(ids.withColumnsRenamed({"nid": "src", "node_id": "source"}), "src")
        .join(ids.withColumnsRenamed({"nid": "dst", "node_id": "sink"}), "dst")
        .select("source", "sink", "edge_len", "overlap_len", F.round("identity", 4).alias("identity"))
    )


def _rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- reads ---------------------------------------------------------------------------


@query
def read_stats(spark, sf):
    return _rounded(
        rd.read_stats(fx.text_reads(spark, sf)).withColumn("mean_q", F.col("mean_q").cast("double")), "mean_q"
    )


@query
def read_filter(spark, sf):
    stats = rd.read_stats(fx.text_reads(spark, sf))
    return rd.filter_reads(stats, P.but(min_base_quality=60.0)).select("rec_no", "name", "len")


@query
def longest_budget(spark, sf):
    reads = fx.load(spark, sf, "documents").select(F.col("doc_id").alias("rec_no"), F.col("n_chars").alias("len"))
    total = reads.agg(F.sum("len")).first()[0]
    return rd.longest_within(reads, total // 2)


@query
def longest_budget_reads(spark, sf):
    reads = fx.virtual_reads(spark, sf).withColumnRenamed("id", "rec_no")
    chosen = rd.longest_within(reads.select("rec_no", "len"), 500 * reads.count() * 5)
    return rd.select_reads(reads, chosen).select("rec_no", "name", "len")


@query
def coverage_estimate(spark, sf):
    return _rounded(rd.coverage_estimate(fx.virtual_alignments(spark, sf)), "coverage")


@query
def bernoulli_depth(spark, sf):
    reads = fx.load(spark, sf, "documents").select(
        F.col("doc_id").alias("rec_no"), F.col("n_chars").alias("len")
    )
    total = reads.agg(F.sum("len")).first()[0]
    ticket = F.col("rec_no") * 7919 % 1000
    return rd.depth_sample(reads, total // 10, 3.5, ticket, 1000)


@query
def fastq_records(spark, sf):
    """Virtual reads written as compressed FASTQ text and read back."""
    path = f"{shared_dir(spark)}/strandweave-fastq-{uuid.uuid4().hex}"
    sinks.write_fastq(fx.virtual_sequences(spark, sf), path, compressed=True)
    back = readers.read_fastq(spark, path)
    return back.select(
        "rec_no", "name", F.length("seq").cast("bigint").alias("len"), F.md5(F.col("seq").cast("binary")).alias("seq_md5")
    )


@query
def paf_rows(spark, sf):
    """Virtual alignments written as PAF text, with rows that must be dropped, and read back."""
    path = f"{shared_dir(spark)}/strandweave-paf-{uuid.uuid4().hex}"
    names = [n for n, _ in readers.PAF_FIELDS]
    rows = fx.virtual_alignments(spark, sf).select(F.concat_ws("\t", *names).alias("value"))
    junk = fx.virtual_reads(spark, sf).select(
        F.explode(
            F.array(
                F.concat(F.lit("# "), "name"),
                F.concat_ws("\t", "name", F.col("len").cast("string"), F.lit("0")),
                F.concat_ws("\t", "name", *[F.lit("x")] * 11),
                F.lit(""),
            )
        ).alias("value")
    )
    rows.unionByName(junk).write.text(path)
    return readers.read_paf(spark, path).drop("line_no")


@query
def fastq_texts(spark, sf):
    """Whole texts as reads, written as FASTQ and read back in ranges of 64 KB."""
    path = f"{shared_dir(spark)}/strandweave-fastq-{uuid.uuid4().hex}"
    sinks.write_fastq(fx.text_sequences(spark, sf), path)
    back = readers.read_fastq(spark, path, range_bytes=1 << 16)
    return back.select(
        "name", F.length("seq").cast("bigint").alias("len"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"),
        F.md5(reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"), F.left("qual", F.lit(1)).alias("first_qual"),
    )


@query
def last_sequences(spark, sf):
    """Of all texts under the name of a source, the last one."""
    reads = fx.load(spark, sf, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("rec_no"), F.col("text").alias("seq"))
    return readers.sequences_by_name(reads).select("name", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def _paf_text(spark, sf) -> str:
    """Virtual alignments as PAF text; a row without numbers for each read."""
    path = f"{shared_dir(spark)}/strandweave-paf-{uuid.uuid4().hex}"
    names = [n for n, _ in readers.PAF_FIELDS]
    rows = fx.virtual_alignments(spark, sf).select(F.concat_ws("\t", *names).alias("value"))
    rows.write.text(path)
    return path


@query
def paf_rows_loose(spark, sf):
    """PAF rows of ten fields and more, numbers that do not parse being 0."""
    path = _paf_text(spark, sf)
    odd = fx.virtual_reads(spark, sf).select(
        F.explode(F.array(F.concat_ws("\t", "name", *[F.lit("x")] * 9), F.concat_ws("\t", "name", *[F.lit("1")] * 8))).alias("value")
    )
    odd.write.mode("append").text(path)
    return readers.read_paf(spark, path, "loose").drop("line_no")


@query
def paf_spans(spark, sf):
    """The fields the size estimate reads."""
    return readers.read_paf(spark, _paf_text(spark, sf), "spans").drop("line_no")


@query
def contig_lengths(spark, sf):
    """Texts written as FASTA in lines of 60 letters and measured; what is no letter becomes N."""
    path = f"{shared_dir(spark)}/strandweave-fasta-{uuid.uuid4().hex}"
    docs = fx.load(spark, sf, "documents").select("doc_id", "text")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "N")
    lines = F.regexp_extract_all(letters, F.lit(".{1,60}"), F.lit(0))
    body = docs.select("doc_id", F.posexplode(lines).alias("i", "value")).withColumn("i", F.col("i").cast("bigint"))
    head = docs.select("doc_id", F.lit(-1).cast("bigint").alias("i"), F.concat(F.lit(">d"), F.col("doc_id").cast("string")).alias("value"))
    sinks.write_lines(head.unionByName(body), path, ["doc_id", "i"])
    return readers.contig_lengths(spark, path).groupBy("length").agg(F.count("*").alias("n_contigs"))


@query
def n50_by_lang(spark, sf):
    return st.n50(fx.load(spark, sf, "documents").select("lang", F.col("n_chars").alias("length")), ["lang"])


@query
def n50_overall(spark, sf):
    return st.n50(fx.load(spark, sf, "documents").select(F.col("n_chars").alias("length")))


@query
def largest_contig(spark, sf):
    return st.largest(fx.load(spark, sf, "documents").select("source", F.col("n_chars").alias("length")), ["source"])


# --- alignments ----------------------------------------------------------------------


@query
def alignment_filter(spark, sf):
    return al.passing(fx.virtual_alignments(spark, sf), P.but(min_percent_identity=90.0))


@query
def filter_reasons(spark, sf):
    return al.filter_counts(fx.virtual_alignments(spark, sf), P.but(min_percent_identity=90.0))


@query
def read_lengths(spark, sf):
    return al.read_lengths(al.passing(fx.virtual_alignments(spark, sf), P))


@query
def best_per_pair(spark, sf):
    return al.best_per_pair(al.passing(fx.virtual_alignments(spark, sf), P))


@query
def interval_depth(spark, sf):
    return al.interval_depth(al.intervals_of(al.passing(fx.virtual_alignments(spark, sf), P)))


@query
def interval_depth_suppliers(spark, sf):
    return al.interval_depth(fx.supplier_intervals(spark, sf))


@query
def covered_region(spark, sf):
    return al.regions(_passed(spark, sf), P)


@query
def covered_region_users(spark, sf):
    return al.covered_regions(fx.user_intervals(spark, sf), 1)


@query
def max_depth(spark, sf):
    return al.covered_regions(fx.supplier_intervals(spark, sf), 20).select("name", "max_depth")


@query
def overlap_class(spark, sf):
    return _filtered(spark, sf).classified.select(
        "qname", "tname", "line_no", "b1", "e1", "l1", "b2", "e2", "l2", "class"
    )


@query
def overlap_class_coclip(spark, sf):
    return _filtered(spark, sf, P.but(coords="coclip")).classified.select(
        "qname", "tname", "line_no", "b1", "e1", "l1", "b2", "e2", "l2", "class"
    )


@query
def overlap_class_counts(spark, sf):
    return _filtered(spark, sf).classified.groupBy("class").agg(F.count("*").alias("n_pairs"))


@query
def overlap_edges(spark, sf):
    return _rounded(ov.overlap_edges(_filtered(spark, sf).classified), "identity")


@query
def contained_reads(spark, sf):
    return ov.contained_reads(_filtered(spark, sf).classified)


@query
def kept_overlaps(spark, sf):
    return _rounded(_filtered(spark, sf).overlaps, "identity")


@query
def stored_overlaps(spark, sf):
    """Kept overlaps written and read back."""
    path = f"{shared_dir(spark)}/strandweave-overlaps-{uuid.uuid4().hex}"
    readers.write_overlaps(_filtered(spark, sf).overlaps, path)
    return _rounded(readers.read_overlaps(spark, path), "identity")


@query
def reads_in_overlaps(spark, sf):
    return ov.reads_in_overlaps(_filtered(spark, sf).overlaps)


# --- graph ---------------------------------------------------------------------------


@query
def bigraph_edges(spark, sf):
    return _named_edges(_graph(spark, sf))


@query
def graph_stats(spark, sf):
    return _rounded(gr.graph_stats(_graph(spark, sf)), "nodes_per_edge")


@query
def symmetry_violations(spark, sf):
    """On the successor graph after its short forward edges went without their mirrors."""
    graph = fx.successor_graph(spark, sf)
    short = graph.edges.filter("overlap_len < 300 and src < dst")
    return gr.symmetry_violations(gr.remove_edges(graph, short, mirrored=False))


@query
def delete_nodes(spark, sf):
    """Delete the reads of all parts that cost less than the average."""
    graph = fx.part_graph(spark, sf)
    part = fx.load(spark, sf, "part")
    mean = part.agg(F.avg("p_retailprice")).first()[0]
    doomed = part.filter(F.col("p_retailprice") < mean).select((F.col("p_partkey") * 2).alias("nid"))
    return gr.delete_reads(graph, doomed).edges


@query
def add_bridge_edges(spark, sf):
    """Add the successor graph's edges to the part graph where they are missing."""
    graph = fx.part_graph(spark, sf)
    thin = graph.with_edges(graph.edges.filter("edge_len > 30"))
    return gr.add_edges(thin, fx.successor_graph(spark, sf).edges).edges.select("src", "dst", "edge_len")


@query
def ranked_edges(spark, sf):
    return gr.ranked_edges(fx.part_graph(spark, sf).edges)


@query
def transitive_candidates(spark, sf):
    return red.closed_two_hops(fx.part_graph(spark, sf).edges)


@query
def transitive_reduce(spark, sf):
    return _named_edges(red.reduce_transitive(_graph(spark, sf), P.fuzz))


@query
def transitive_reduce_dense(spark, sf):
    return red.reduce_transitive(fx.part_graph(spark, sf), P.fuzz).edges


@query
def multi_edge_dedup(spark, sf):
    return gr.dedupe_edges(fx.part_steps(spark, sf))


@query
def short_edge_removal(spark, sf):
    return hs.remove_short_edges(fx.part_graph(spark, sf), P.short_edge_ratio).edges


@query
def weak_edge_removal(spark, sf):
    return hs.remove_weak_edges(fx.part_graph(spark, sf)).edges


@query
def weak_edge_removal_one_sided(spark, sf):
    return hs.remove_weak_edges(fx.part_graph(spark, sf), mirrored=False).edges


@query
def degree_histogram(spark, sf):
    return st.degree_histogram(fx.part_graph(spark, sf))


@query
def compressible_fraction(spark, sf):
    return _rounded(st.compressible_fraction(fx.successor_graph(spark, sf)), "fraction")


@query
def branching_topk(spark, sf):
    return st.branching_topk(fx.part_graph(spark, sf), 20)


@query
def node_class(spark, sf):
    return tp.node_classes(fx.successor_graph(spark, sf)).select("nid", "n_in", "n_out", "class")


@query
def tip_trim(spark, sf):
    return tp.trim_tips(fx.successor_graph(spark, sf)).edges


@query
def tip_trim_documented(spark, sf):
    return tp.tip_nodes(fx.successor_graph(spark, sf), "documented", P.max_tip_len)


@query
def tip_lengths(spark, sf):
    return st.tip_lengths(fx.successor_graph(spark, sf))


@query
def components(spark, sf):
    return cc.components(fx.successor_graph(spark, sf))


@query
def component_sizes(spark, sf):
    return cc.component_sizes(cc.components(fx.order_bubbles(spark, sf)))


@query
def small_component_removal(spark, sf):
    graph = fx.successor_graph(spark, sf)
    nodes = gr.Graph(fx.part_graph(spark, sf).nodes, graph.edges.filter("overlap_len > 300"))
    return cc.remove_small_components(nodes).nodes.select("nid")


@query
def internal_chain_cut(spark, sf):
    return hs.internal_chain_nodes(fx.successor_graph(spark, sf), 10)


@query
def biloop_cut(spark, sf):
    return hs.biloop_edges(fx.part_graph(spark, sf).with_edges(_biloop_fixture(spark, sf)), 3)


def _biloop_fixture(spark, sf):
    """The successor graph with a shortcut over the first step of every node nothing leads to."""
    step = fx.successor_graph(spark, sf).edges
    on = step.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("overlap_len").alias("ov2"))
    led_to = step.select(F.col("dst").alias("src")).distinct()
    skip = step.join(led_to, "src", "left_anti").join(on, "dst").select(
        "src", F.col("far").alias("dst"), "edge_len", F.expr("abs(overlap_len - ov2) + 100").alias("overlap_len"), "identity"
    )
    return gr.dedupe_edges(step.unionByName(skip.filter("src != dst")))


# --- chains and unitigs --------------------------------------------------------------


@query
def chains(spark, sf):
    return ch.chain_table(fx.successor_graph(spark, sf)).nodes.select("nid", "head", "pos", "offset")


@query
def unitig_members(spark, sf):
    u = ut.compress(fx.successor_graph(spark, sf))
    return _keyed(u).select("first", "second", "pos", "node", "edge_len", "offset")


def _keyed(u: ut.Unitigs) -> DataFrame:
    """Members with the unitig's first edge as its name."""
    key = u.members.filter("pos = 0").select("unitig_id", F.col("node").alias("first"), F.col("next").alias("second"))
    return u.members.join(key, "unitig_id")


@query
def circular_unitigs(spark, sf):
    u = ut.compress(fx.ring_graph(spark, sf))
    placed = u.members.groupBy("unitig_id").agg(F.max(F.col("offset") + F.col("edge_len")).alias("length"))
    return u.unitigs.join(placed, "unitig_id").select("first", "n_members", "length", "topology")


@query
def unitig_twins(spark, sf):
    u = ut.compress(fx.successor_graph(spark, sf))
    keep = ut.kept_after_twins(u.unitigs, u.members)
    return u.unitigs.join(keep, "unitig_id", "left_semi").select("unitig_id", "first", "n_members")


@query
def unitig_edges(spark, sf):
    return ut.compress(fx.successor_graph(spark, sf)).edges


def _assembly(spark, sf, params: Params = P, reads: DataFrame | None = None) -> asm.Assembly:
    return asm.assemble(reads, _aln(spark, sf), params=params)


@query
def unitig_layout(spark, sf):
    return _assembly(spark, sf).layout.drop("unitig_id")


@query
def unitig_sequence(spark, sf):
    """Bases of the assembly in lines of 10,000."""
    reads = table(fx.virtual_sequences(spark, sf), "reads")
    return ut.sequence_chunks(_assembly(spark, sf, P.but(coords="coclip"), reads).pieces())


@query
def simplify_metrics(spark, sf):
    return _assembly(spark, sf).metrics


@query
def assemble_unitigs(spark, sf):
    done = _assembly(spark, sf)
    return done.sizes.join(done.unitigs.unitigs.select("unitig_id", "n_members"), "unitig_id")


def _assembled_bases(spark, sf) -> asm.Assembly:
    return _assembly(spark, sf, P.but(coords="coclip"), table(fx.virtual_sequences(spark, sf), "reads"))


@query
def gfa_text(spark, sf):
    """All rows of the GFA file, segments with their bases in stretches of 10,000."""
    done = _assembled_bases(spark, sf)
    rows = sinks.gfa_lines(done.sizes, done.unitigs.edges, done.layout, done.pieces())
    return rows.select("section", "a", "part", "value", "open")


@query
def gfa_lengths(spark, sf):
    """GFA without bases."""
    done = _assembly(spark, sf)
    return sinks.gfa_lines(done.sizes, done.unitigs.edges, done.layout).select("value")


@query
def gfa_links(spark, sf):
    """Links between the unitigs of the successor graph, and of circular ones to themselves."""
    lines = []
    for graph in (fx.successor_graph(spark, sf), fx.ring_graph(spark, sf)):
        u = ut.compress(graph)
        sizes = u.unitigs.select("unitig_id", "topology", F.lit(0).cast("bigint").alias("length"))
        none = spark.createDataFrame(
            [], "unitig_id long, pos long, read string, cov_start long, cov_end long, ori string, utg_start long, utg_end long"
        )
        lines.append(sinks.gfa_lines(sizes, u.edges, none).filter("section in (2, 3)").select("value"))
    return lines[0].unionByName(lines[1])


@query
def fasta_text(spark, sf):
    done = _assembled_bases(spark, sf)
    return sinks.fasta_lines(done.sizes, ut.sequence_chunks(done.pieces()))


@query
def kept_unitig_edges(spark, sf):
    """Unitig edges after one strand of each pair of twins was dropped."""
    return ut.drop_twins(ut.compress(fx.successor_graph(spark, sf))).edges


@query
def unitig_topology(spark, sf):
    """Which unitigs close: those whose last step leads to their first member, or to one that an edge joins with it."""
    rings, steps = fx.ring_graph(spark, sf), fx.successor_graph(spark, sf)
    found = []
    for graph in (rings, steps):
        u = ut.compress(graph)
        shape = ut.topologies(u.unitigs, u.members, graph.edges)
        found.append(u.unitigs.drop("topology").join(shape, "unitig_id").select("first", "last", "n_members", "topology"))
    return found[0].unionByName(found[1])


@query
def joined_unitigs(spark, sf):
    """Unitigs before and after completion, where alignments across the middle of the genome are missing."""
    reads = table(fx.virtual_sequences(spark, sf), "reads")
    middle = 250 * reads.count()
    side = fx.virtual_reads(spark, sf).select("name", (F.col("g0") < middle).alias("left"))
    rows = (
        fx.virtual_alignments(spark, sf)
        .join(side.withColumnsRenamed({"name": "qname", "left": "q_left"}), "qname")
        .join(side.withColumnsRenamed({"name": "tname", "left": "t_left"}), "tname")
        .filter("q_left = t_left")
        .drop("q_left", "t_left")
    )
    params = P.but(coords="coclip")
    before = asm.assemble(reads, table(rows, "halves"), params=params.but(completion_enabled=False))
    found = None
    for stage, done in (("before", before), ("after", asm.completed(before, params))):
        ends = done.unitigs.unitigs.select("unitig_id", "n_members")
        part = done.sizes.join(ends, "unitig_id").select(F.lit(stage).alias("stage"), "unitig_id", "n_members", "length")
        found = part if found is None else found.unionByName(part)
    return found


@query
def dot_text(spark, sf):
    graph = _graph(spark, sf)
    return sinks.dot_lines(graph.nodes, graph.edges).select("value")


@query
def node_id_parse(spark, sf):
    ids = _graph(spark, sf).nodes.select("node_id")
    return ids.select("node_id", *[c.alias(k) for k, c in node_id_parts(F.col("node_id")).items()])


@query
def reverse_complement_reads(spark, sf):
    seqs = fx.virtual_sequences(spark, sf).select("name", "seq")
    return seqs.select("name", F.md5(reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


# --- bubbles -------------------------------------------------------------------------


@query
def bubble_paths(spark, sf):
    return _rounded(
        bb.bubble_paths(fx.order_bubbles(spark, sf), P.max_bubble_length).select(
            "u", "a", "m", "depth", "n_reads", "bases", "identity", "score"
        ),
        "identity", "score", digits=3,
    )


@query
def bubble_arms(spark, sf):
    """Paths of two to five steps, with their nodes."""
    found = bb.bubble_paths(fx.order_arms(spark, sf), P.max_bubble_length)
    return _rounded(found, "identity", "score", digits=3).withColumn("path", F.array_join("path", " "))


@query
def bubble_removal(spark, sf):
    graph, _ = bb.remove_bubbles(fx.order_bubbles(spark, sf), P.max_bubble_length, P.min_support_ratio)
    return graph.nodes.select("nid")


# --- completion ----------------------------------------------------------------------


@query
def bridge_support(spark, sf):
    hits = cp.bridge_alignments(fx.bridge_alignments(spark, sf), 2000, 0.8)
    return _rounded(cp.bridge_support(hits), "identity", digits=6)


@query
def strong_bridges(spark, sf):
    return _rounded(cp.find_bridges(fx.bridge_alignments(spark, sf), 2000, 0.8), "identity", digits=6)


@query
def bridge_ranks(spark, sf):
    """Strong bridges in their order."""
    found = cp.ranked_bridges(cp.find_bridges(fx.bridge_alignments(spark, sf), 2000, 0.8))
    return _rounded(found, "identity", digits=6)


@query
def bridge_edges(spark, sf):
    """Strong bridges as graph edges; targets map to the first and last part of their group."""
    bridges = cp.find_bridges(fx.bridge_alignments(spark, sf), 2000, 0.8)
    ends = (
        fx.load(spark, sf, "part")
        .groupBy(F.concat(F.lit("u"), F.expr("p_partkey div 16").cast("string")).alias("target"))
        .agg((F.max("p_partkey") * 2).alias("out_nid"), (F.min("p_partkey") * 2).alias("in_nid"))
    )
    graph = fx.part_graph(spark, sf)
    known = cp.add_bridges(graph, cp.bridge_edges(bridges, ends))
    added = known.edges.join(graph.edges, ["src", "dst"], "left_anti")
    return _rounded(added, "identity")


# --- overlap detection ---------------------------------------------------------------


@query
def seed_overlaps(spark, sf):
    reads = table(fx.virtual_sequences(spark, sf).select("name", "seq"), "reads")
    return dt.find_overlaps(reads).drop("line_no")


@query
def shared_seeds(spark, sf):
    reads = table(fx.virtual_sequences(spark, sf).select("name", "seq"), "reads")
    return dt.shared_seeds(reads)


@query
def prepared_reads(spark, sf):
    """Quality filter, size estimate from seed overlaps and the depth budget."""
    reads = table(fx.virtual_sequences(spark, sf), "reads")
    kept, size = asm.prepare_reads(reads, P)
    return kept.select("rec_no", "name", F.lit(size).cast("bigint").alias("genome_size"))


@query
def assemble_from_reads(spark, sf):
    """Reads to unitigs with seed overlaps and one completion round."""
    reads = table(fx.virtual_sequences(spark, sf), "reads")
    genome = 500 * reads.count()
    done = asm.assemble(
        reads, params=P.but(coords="coclip", genome_size=genome, min_base_quality=0.0, completion_enabled=True)
    )
    return done.sizes


@query
def coverage_sweep(spark, sf):
    reads = fx.virtual_sequences(spark, sf)
    genome = 500 * fx.load(spark, sf, "part").count()
    return asm.coverage_sweep(
        reads, genome, list(range(5, 51, 5)), P.but(min_overlap_count=1, min_base_quality=0.0), alignments=_aln(spark, sf)
    )
