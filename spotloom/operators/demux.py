"""Nearest-barcode assignment of reads, guarded against ambiguity.

Reads are decided once per distinct (read, sequence). Distances come from bit sets in generated code; the counts of codes
by distance decide, so the reads' codes are combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions.barcode import hamming, packed
from spotloom.schemas import MAX_DISTANCE, MIN_DELTA, UNDETERMINED

#: Codes, in all, up to which every read meets all codes of its number and length, broadcast; beyond, candidates are sought
#: by equal segments, of which a code has a fixed number. Both give the same pairs.
BROADCAST_CODES = 1_000
SEGMENTS = MAX_DISTANCE + MIN_DELTA + 1


def _with_bits(df: DataFrame, name: str) -> DataFrame:
    a, b = packed(F.col("sequence"))
    return df.withColumns({f"{name}0": a, f"{name}1": b})


def _distance() -> Column:
    return hamming(F.length("code"), [F.col("r0"), F.col("r1")], [F.col("c0"), F.col("c1")])


def _pairs_by_read(reads: DataFrame, codes: DataFrame, broadcast: bool) -> DataFrame:
    c = _with_bits(codes, "c").withColumnRenamed("sequence", "code")
    c, r = c.withColumn("_length", F.length("code")), _with_bits(reads, "r").withColumn("_length", F.length("sequence"))
    return r.join(F.broadcast(c) if broadcast else c, ["read", "_length"]).drop("_length").withColumn("distance", _distance())


def _segments(sequence: Column) -> Column:
    """(number, letters) of the pieces of a sequence: of two sequences within SEGMENTS - 1 places, one piece is equal."""
    n = F.length(sequence)
    at = lambda i: F.floor(n * i / SEGMENTS).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("no"), n.alias("length"), sequence.substr(at(i) + 1, at(i + 1) - at(i)).alias("piece")) for i in range(SEGMENTS)])


def _pairs_by_segment(reads: DataFrame, codes: DataFrame) -> DataFrame:
    """Only pairs that may be within MAX_DISTANCE + MIN_DELTA; a pair that shares several pieces comes once."""
    r = _with_bits(reads, "r").withColumn("s", F.explode(_segments(F.col("sequence"))))
    c = _with_bits(codes, "c").withColumn("s", F.explode(_segments(F.col("sequence")))).withColumnRenamed("sequence", "code")
    pairs = r.join(c, ["read", "s"])
    # kept only where the shared piece is the first that the two share, so no shuffle is needed to drop repeats
    first = F.lit(None).cast("int")
    ps, pc = _segments(F.col("sequence")), _segments(F.col("code"))
    for i in reversed(range(SEGMENTS)):
        first = F.when(ps[i]["piece"] == pc[i]["piece"], i).otherwise(first)
    return pairs.where(F.col("s.no") == first).drop("s").withColumn("distance", _distance())


def distinct_reads(reads: DataFrame) -> DataFrame:
    return reads.where("read is not null and sequence is not null").select("read", "sequence").distinct()


def code_distances(reads: DataFrame, codes: DataFrame, most: int = MAX_DISTANCE + MIN_DELTA) -> DataFrame:
    """(read, sequence, probe_name, distance) of distinct reads and codes of one read number and length within ``most``."""
    few = codes.count() <= BROADCAST_CODES
    pairs = _pairs_by_read(distinct_reads(reads), codes, few) if few or most > SEGMENTS - 1 else _pairs_by_segment(distinct_reads(reads), codes)
    return pairs.where(F.col("distance") <= most).select("read", "sequence", "probe_name", "distance")


def decide(reads: DataFrame, codes: DataFrame, by_segment: bool | None = None) -> DataFrame:
    """(read, sequence, probe_name, gene_name, distance) of the distinct reads that are assigned.

    A read is assigned if, for some i up to MAX_DISTANCE, exactly one code is i away and at most one within i + MIN_DELTA.
    ``by_segment``: whether candidates are sought by equal segments; by default if there are many codes. Both give the
    same result. Reads of another length than a code cannot match it.
    """
    if by_segment is None:
        by_segment = codes.count() > BROADCAST_CODES
    pairs = _pairs_by_segment(distinct_reads(reads), codes) if by_segment else _pairs_by_read(distinct_reads(reads), codes, codes.count() <= BROADCAST_CODES)
    near = pairs.where(F.col("distance") <= MAX_DISTANCE + MIN_DELTA)
    counts = [F.count_if(F.col("distance") <= d).alias(f"n{d}") for d in range(MAX_DISTANCE + MIN_DELTA + 1)]
    best = F.min(F.struct("distance", "probe_name", "gene_name")).alias("best")
    g = near.groupBy("read", "sequence").agg(*counts, best)
    sure = F.lit(False)
    for i in range(MAX_DISTANCE + 1):
        at = F.col(f"n{i}") - (F.col(f"n{i - 1}") if i else F.lit(0))
        sure = sure | ((at == 1) & (F.col(f"n{i + MIN_DELTA}") <= 1))
    return g.where(sure).select("read", "sequence", "best.probe_name", "best.gene_name", "best.distance")


def assign_reads(reads: DataFrame, codes: DataFrame, by_segment: bool | None = None) -> DataFrame:
    """All rows of ``reads`` whose read number occurs among the codes, with ``probe_name`` and ``gene_name``:
    UNDETERMINED where no code is near enough or the nearest is not sure.

    ``reads``: (read INT, sequence STRING, ...). A read whose number no code has vanishes, as does one without a number;
    a null sequence is undetermined. Repeated rows are each assigned. Columns named like the result's are replaced.
    """
    known = codes.select("read").distinct()
    rows = reads.drop("probe_name", "gene_name").join(F.broadcast(known), "read", "left_semi")  # one row per read number
    done = decide(rows, codes, by_segment).drop("distance")
    out = rows.join(done, ["read", "sequence"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(UNDETERMINED)) for c in ("probe_name", "gene_name")})


def demultiplex(reads: DataFrame, codes: DataFrame, by_segment: bool | None = None) -> DataFrame:
    """The transcripts: assigned reads without sequence and read number."""
    return assign_reads(reads, codes, by_segment).where(F.col("probe_name") != UNDETERMINED).drop("sequence", "read")
