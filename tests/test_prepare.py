"""The size estimate finds overlaps for few samples, with the result of finding them for each."""

import pytest

from strandweave import assembly as asm
from strandweave.operators import detection as dt
from strandweave.operators import reads as rd
from strandweave.params import Params
from strandweave.plans.settle import table
from strandweave.workload import fixtures as fx


def plainly(reads, stats, params):
    """Rounds that find the overlaps of each sample anew."""
    factor, before = 1, -1
    while True:
        sample = rd.longest_within(stats, factor * params.estimation_budget)
        bases = sample.groupBy().sum("len").first()[0]
        estimate = rd.coverage_estimate(dt.find_overlaps(rd.select_reads(reads, sample))).first()
        if estimate["coverage"] >= params.estimation_coverage or bases == before:
            return estimate["genome_size"], factor
        before, factor = bases, factor + 1


@pytest.mark.parametrize("coverage", [1.8, 50.0])
def test_rounds_share_their_overlaps(spark, sf, monkeypatch, coverage):
    reads = table(fx.virtual_sequences(spark, sf).filter("rec_no % 2 = 0"), "reads")
    stats = table(rd.read_stats(reads), "stats")
    params = Params(estimation_budget=110_000, estimation_coverage=coverage)
    want, rounds = plainly(reads, stats, params)
    joins = []
    keep = dt.grouped
    monkeypatch.setattr(dt, "grouped", lambda *a, **k: (joins.append(1), keep(*a, **k))[1])
    if coverage == 50:
        with pytest.warns(UserWarning, match="all reads together"):
            got = asm.estimate_genome_size(reads, stats, params)
    else:
        got = asm.estimate_genome_size(reads, stats, params)
    assert got == want and rounds >= 4 and len(joins) <= 3 < rounds
