import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spotloom.functions.barcode import hamming, packed
from spotloom.operators import demux, manifest
from spotloom.schemas import UNDETERMINED


def brute(read, seq, codes):
    """The rule read word for word."""
    own = [(c, p, g) for r, c, p, g in codes if r == read]
    if not any(r == read for r, *_ in codes):
        return None
    if seq is None:
        return UNDETERMINED
    d = [sum(a != b or a not in "ACGT" for a, b in zip(seq, c)) for c, _, _ in own if len(c) == len(seq)]
    names = [p for c, p, _ in own if len(c) == len(seq)]
    for i in range(3):
        if d.count(i) == 1 and sum(x <= i + 2 for x in d) <= 1:
            return names[int(np.argmin(d))]
    return UNDETERMINED


def random_case(rng, n_codes, n_reads, length):
    codes, seen = [], set()
    for i in range(n_codes):
        s = "".join(rng.choice("ACGT") for _ in range(length))
        if codes and rng.random() < 0.3:  # near duplicates
            s = list(rng.choice(codes)[1])
            for _ in range(rng.randint(0, 3)):
                s[rng.randrange(length)] = rng.choice("ACGT")
            s = "".join(s)
        codes.append((rng.randint(1, 2), s, f"P{i:03d}", f"G{i % 7}"))
    reads = []
    for i in range(n_reads):
        s = list(rng.choice(codes)[1])
        for _ in range(rng.randint(0, 5)):
            s[rng.randrange(length)] = rng.choice("ACGTN")
        reads.append((f"t{i}_{rng.randint(1, 3)}", rng.randint(1, 3), "".join(s)))
    reads += [("null_1", 1, None), ("short_1", 1, "ACG"), ("none", None, "ACGT")] + reads[:5]
    return codes, reads


def test_both_ways_follow_the_rule(spark):
    rng = random.Random(5)
    for length in (15, 22):
        codes, reads = random_case(rng, 40, 300, length)
        c = spark.createDataFrame(codes, "read int, sequence string, probe_name string, gene_name string")
        r = spark.createDataFrame(reads, "TXUID string, read int, sequence string")
        want = sorted((t, w) for t, n, s in reads if n is not None and (w := brute(n, s, codes)) is not None)
        for by_segment in (False, True):
            got = sorted((x["TXUID"], x["probe_name"]) for x in demux.assign_reads(r, c, by_segment).collect())
            assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", min_size=15, max_size=15), st.text("ACGT", min_size=15, max_size=15)), min_size=1, max_size=20))
def test_packed_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(hamming(F.length("b"), packed(F.col("a")), packed(F.col("b")))).collect()]
    assert got == [sum(x != y for x, y in zip(a, b)) for a, b in pairs]


def test_manifest_variants(spark):
    names = ["G1-ACGT-SP1", "gDNA-ACGTT-m7a", "NCS-x-ACGTA-m9a", "NCP-y-ACGTC-m6a", "-ACGT-SP1", "bad", None, "G2-ACGT-unknown", "g-acgt-SP1"]
    p = spark.createDataFrame([(n,) for n in names], "probe_name string")
    rows = {r["probe_name"]: r for r in manifest.parse_manifest(p).collect()}
    assert set(rows) == {"G1-ACGT-SP1", "gDNA-ACGTT-m7a", "NCS-x-ACGTA-m9a", "NCP-y-ACGTC-m6a", "-ACGT-SP1"}
    assert [rows[n]["probe_type"] for n in names[:5]] == ["targeting", "GCP", "NCS", "NCP", "targeting"]
    assert rows["-ACGT-SP1"]["gene_name"] == ""
    own = p.withColumns({"read": F.lit("x_4"), "gene_name": F.lit("own"), "panel_type": F.lit("base")})
    got = manifest.parse_manifest(own).collect()
    assert len(got) == len(names) and {r["read"] for r in got} == {4} and {r["gene_name"] for r in got} == {"own"}
    assert manifest.codebook(manifest.parse_manifest(own)).count() == 6  # malformed names have no code


def test_no_reads_and_no_codes(spark):
    r = spark.createDataFrame([], "TXUID string, read int, sequence string")
    c = spark.createDataFrame([(1, "ACGT", "p", "g")], "read int, sequence string, probe_name string, gene_name string")
    assert demux.assign_reads(r, c).count() == 0
    assert demux.assign_reads(spark.createDataFrame([("t_1", 1, "ACGT")], r.schema), c.limit(0)).count() == 0
