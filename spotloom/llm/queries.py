"""Queries of the problems of this subpackage over the test tables, and SQL to check those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import canonical, clusters, leaks, sketch, text_sql, tokens, vectors
from spotloom.session import durable, table

SIMILAR_CELLS = 0.85
SAME_VECTORS = 0.9995


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.similarity_groups(table(spark, sf, "feature_matrix").select("cell_id", "x"), SIMILAR_CELLS)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.group_members(_groups(spark, sf))


def p3_described(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's size and most typical cells."""
    return clusters.describe_groups(_groups(spark, sf))


def _cell_vectors(spark: SparkSession, sf: str, name: str) -> DataFrame:
    t = table(spark, sf, name)
    numbers = [c for c in t.columns if c not in ("label", "segmentation_label")]
    kind = "double" if any(t.schema[c].dataType.simpleString() in ("double", "float") for c in numbers) else "int"
    return t.select("label", F.array(*[F.coalesce(F.col(f"`{c}`").cast(kind), F.lit(0).cast(kind)) for c in numbers]).alias("vector"))


def _neighbours(spark: SparkSession, sf: str, least: float | None) -> list[tuple[str, DataFrame]]:
    # without a least similarity, the few intensities of proteins need a wider look for the same recall than the counts of
    # genes; with one, the lists that it needs are searched in any case
    names = (("transcript", "cell_by_transcript", 0.12), ("protein", "cell_by_protein", 0.25))
    return [(kind, vectors.nearest_vectors(_cell_vectors(spark, sf, name), 3, least, probes=probes if least is None else 0.04)) for kind, name, probes in names]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (vectors.mutual_pairs(n).select(F.lit(kind).alias("matrix"), "label_a", "label_b") for kind, n in _neighbours(spark, sf, SAME_VECTORS))
    return a.unionByName(b)


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The three most similar others of every cell in either matrix, ties included."""
    a, b = (n.select(F.lit(kind).alias("matrix"), "label_a", "label_b", "similarity") for kind, n in _neighbours(spark, sf, None))
    return a.unionByName(b)


def _daily(spark: SparkSession, sf: str, name: str, at: str, value: str) -> DataFrame:
    rows = table(spark, sf, name).where(f"{value} >= 0").select("sample_id", F.date_format(at, "yyyy-MM-dd").alias("day"), value)
    return sketch.build_sketch(rows, ["sample_id", "day"], value, infinite=True)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["sample_id", "day"]
    score = sketch.percentiles(_daily(spark, sf, "transcript_table", "recorded_at", "confidence_score"), keys, [0.9]).where("value < 0.7")
    area = sketch.percentiles(_daily(spark, sf, "cell_metadata", "segmented_at", "nuclei_area_um"), keys, [0.5]).where("value > 45")
    out = [d.select(F.lit(name).alias("source_table"), *keys) for name, d in (("transcript_table", score), ("cell_metadata", area))]
    return out[0].unionByName(out[1])


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per sample over all its days: the days' sketches, added up."""
    shares = [0.1, 0.5, 0.9, 0.99]
    score = sketch.merge_sketches(_daily(spark, sf, "transcript_table", "recorded_at", "confidence_score"), ["sample_id"])
    area = sketch.merge_sketches(_daily(spark, sf, "cell_metadata", "segmented_at", "nuclei_area_um"), ["sample_id"])
    out = [sketch.percentiles(s, ["sample_id"], shares).withColumn("source_table", F.lit(n)) for n, s in (("transcript_table", score), ("cell_metadata", area))]
    return out[0].unionByName(out[1])


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold most of an item's words close together, in any order."""
    return leaks.find_proximity(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    return canonical.read_alike(d, words=canonical.spellings(d))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that reads like another text: the first that reads so, and how many do."""
    d = _documents(spark, sf)
    return canonical.alike_classes(d, words=canonical.spellings(d)).withColumnRenamed("first", "first_doc")


def p9_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in its one form."""
    d = _documents(spark, sf)
    return canonical.canonical_column(d, words=canonical.spellings(d)).select("doc_id", "canonical")


_ALL = (p3_found, p3_described, p5_found, p5_neighbours, p6_found, p6_percentiles, p7_ids, p8_found, p8_proximity, p9_found, p9_classes, p9_canonical)
QUERIES = {f.__name__: f for f in _ALL}

_P3 = """
with c as (select cell_id, min(x) as x from feature_matrix where cell_id is not null and x is not null group by cell_id),
u as (select cell_id, list_transform(x, lambda e: cast(coalesce(e, 0) as double)) as v from c),
n as (select cell_id, v, sqrt(list_inner_product(v, v)) as l from u where list_inner_product(v, v) > 0),
near as (select a.cell_id, b.cell_id as other from n a join n b on list_inner_product(a.v, b.v) / (a.l * b.l) >= 0.85)
select cell_id, min(other) as first_cell_id from near group by cell_id having count(*) >= 3
"""


def _p5(kind: str, name: str, drop: str) -> str:
    return f"""
    select '{kind}' as matrix, least(a, b) as label_a, greatest(a, b) as label_b from (
      select a, b, s, rank() over (partition by a order by s desc) as place from (
        select x.label as a, y.label as b, round(list_inner_product(x.v, y.v) / (x.l * y.l), 9) as s
        from {kind}_v x join {kind}_v y on x.label <> y.label where x.l > 0 and y.l > 0) t
    ) p where place <= 3 and s >= 0.9995 group by all"""


def _vectors_sql(kind: str, name: str, drop: str) -> str:
    return f"""{kind}_r as (select label, [*columns(* exclude ({drop}))] as w from {name} where label is not null),
{kind}_m as (select label, min(list_transform(w, lambda e: cast(coalesce(e, 0) as double))) as v from {kind}_r group by label),
{kind}_v as (select label, v, sqrt(list_inner_product(v, v)) as l from {kind}_m)"""


_BOTH = (("transcript", "cell_by_transcript", "label, segmentation_label"), ("protein", "cell_by_protein", "label"))
_P5 = "with " + ", ".join(_vectors_sql(*b) for b in _BOTH) + " union all ".join(_p5(*b) for b in _BOTH)


def _p5_all(kind: str, name: str, drop: str) -> str:
    return f"""
    select '{kind}' as matrix, a as label_a, b as label_b, s as similarity from (
      select *, rank() over (partition by a order by s desc) as place from (
        select x.label as a, y.label as b, round(list_inner_product(x.v, y.v) / (x.l * y.l), 9) as s
        from {kind}_v x join {kind}_v y on x.label <> y.label where x.l > 0 and y.l > 0) t
    ) p where place <= 3"""


_P5_ALL = "with " + ", ".join(_vectors_sql(*b) for b in _BOTH) + " union all ".join(_p5_all(*b) for b in _BOTH)
_P3_DESCRIBED = f"""
with g as ({_P3}),
u as (select cell_id, first_cell_id, list_transform(x, lambda e: coalesce(e, 0) / sqrt(list_inner_product(d, d))) as v
  from g join (select cell_id, min(x) as x, min(list_transform(x, lambda e: cast(coalesce(e, 0) as double))) as d from feature_matrix where x is not null group by cell_id) f using (cell_id)),
s as (select first_cell_id, i, sum(v[i]) as m from (select first_cell_id, v, unnest(range(1, len(v) + 1)) as i from u) e group by all),
m as (select first_cell_id, list(m order by i) as m, sqrt(sum(m * m)) as l from s group by first_cell_id),
r as (select u.first_cell_id, cell_id, count(*) over (partition by u.first_cell_id) as n_cells, round(list_inner_product(v, m) / l, 9) as similarity from u join m using (first_cell_id)),
p as (select *, row_number() over (partition by first_cell_id order by similarity desc, cell_id) as place from r)
select first_cell_id, n_cells, cast(place as int) as place, cell_id, similarity from p where place <= 3
"""

_P6 = """
with v as (
  select 'transcript_table' as source_table, sample_id, strftime(recorded_at, '%Y-%m-%d') as day, confidence_score as x, 0.9 as q from transcript_table
  union all select 'cell_metadata', sample_id, strftime(segmented_at, '%Y-%m-%d'), nuclei_area_um, 0.5 from cell_metadata
), r as (
  select *, row_number() over (partition by source_table, sample_id, day order by x) as i, count(*) over (partition by source_table, sample_id, day) as n
  from v where x is not null and not isnan(x) and x >= 0
)
select source_table, sample_id, day from r
where i = greatest(1, cast(ceil(n * q - 1e-9) as bigint)) and ((source_table = 'transcript_table' and x < 0.7) or (source_table = 'cell_metadata' and x > 45))
"""


def _p6_all(table: str, column: str, name: str) -> str:
    # the same buckets: of relative width (1 + e) / (1 - e), e = 0.0005, read off by rank, given by their middle
    g = "(1.0005::double / 0.9995::double)"
    return f"""{name}_b as (select sample_id, cast(case when {column} < 1e-9 then -1000000 when isinf({column}) then 1000000 else ceil(ln({column}) / ln({g})) end as int) as b, count(*) as c from {table} where {column} is not null and not isnan({column}) and {column} >= 0 group by all),
{name}_u as (select *, sum(c) over (partition by sample_id order by b) as upto, sum(c) over (partition by sample_id) as n from {name}_b),
{name} as (select u.sample_id, q as share, case when b = -1000000 then 0.0::double when b = 1000000 then 'infinity'::double else 2 / ({g} + 1) * pow({g}, b) end as value, cast(n as bigint) as n, '{table}' as source_table
  from {name}_u u, (values (0.1::double), (0.5::double), (0.9::double), (0.99::double)) s(q) where upto >= greatest(1, ceil(n * q - 1e-9)) and upto - c < greatest(1, ceil(n * q - 1e-9)))"""


_P6_ALL = f"with {_p6_all('transcript_table', 'confidence_score', 'score')}, {_p6_all('cell_metadata', 'nuclei_area_um', 'area')} select * from score union all select * from area"
ORACLE = {"p3_found": _P3, "p3_described": _P3_DESCRIBED, "p5_found": _P5, "p5_neighbours": _P5_ALL, "p6_found": _P6, "p6_percentiles": _P6_ALL, **text_sql.oracle()}
