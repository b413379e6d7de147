"""Links don't depend on how many items a task takes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.llm import banding
from jobweave.llm import linededup as L
from jobweave.llm.components import components


def chains(rng, items, families):
    """Lines in chains: each is its forerunner with a few characters more at one end and fewer at the other."""
    out = []
    for _ in range(families):
        window = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120))
        for _ in range(items // families):
            out.append(window)
            window = window[rng.choice((4, 6)) :]
            window += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120 - len(window)))
    rng.shuffle(out)
    return sorted({L.normal(x) for x in out}, key=lambda _: rng.random())


def groups(spark, lines, limit):
    """The components of lines that all share one band key."""
    name = L.names(lines)
    rows = [(int(a), int(b), bytearray(x)) for (a, b), x in zip(name.tolist(), lines, strict=True)]
    frame = spark.createDataFrame(rows, "h1 long, h2 long, item binary").repartition(4)
    found = banding.links(frame.select("h1", F.array(F.lit(7)).alias("keys")), lambda held: frame, L.near, limit)
    of = {}
    for r in components(found).select("node.h1", "component").collect():
        of.setdefault(tuple(r.component), set()).add(r.h1)
    return sorted(map(sorted, of.values()))


def plain(lines):
    """Components by all pairs, a row of pairs at once."""
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(lines), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s]] = 1
    shared, size = held @ held.T, held.sum(axis=1)
    near = shared >= 0.8 * (size[:, None] + size[None] - shared) - 1e-6
    group = np.arange(len(lines))
    while True:
        least = np.where(near, group[None], len(lines)).min(axis=1)
        if (least == group).all():
            break
        group = least[least]
    h1 = L.names(lines)[:, 0]
    return sorted(sorted(h1[group == g].tolist()) for g in set(group.tolist()) if (group == g).sum() > 1)


@pytest.mark.parametrize("seed, families", [(1, 1), (2, 3), (3, 16)])
def test_blocks_lose_no_link(spark, seed, families):
    lines = chains(random.Random(seed), 160, families)
    expected = plain(lines)
    assert len(expected) == families
    for limit in (10, 45, 10_000):
        assert groups(spark, lines, limit) == expected


@pytest.mark.parametrize("seed", (3, 4))
def test_three_thousand_in_a_chain(spark, seed):
    """At the limit that production has, and without any."""
    lines = chains(random.Random(seed), 3_000, 2)
    whole = groups(spark, lines, 5_000)
    assert [len(g) for g in whole] == [1_500, 1_500] and groups(spark, lines, L.LIMIT) == whole


def test_any_filter_serves(spark, monkeypatch):
    lines = chains(random.Random(5), 60, 4)
    expected = plain(lines)
    monkeypatch.setattr(banding, "MOST_BITS", 6)
    monkeypatch.setattr(banding, "LEAST_BITS", 5)
    assert groups(spark, lines, 9) == expected
