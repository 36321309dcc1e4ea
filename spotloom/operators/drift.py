"""Schemas that drift between files.

Records are read as variants and fused into tagged unions: per file and path, how many values are of which kind, and a
bounded sample of the distinct values. All of it is counted in generated code, combined in each task and then by key, as
sums and minima, so that it is the same however the records are split. Neighbouring files are compared field by field:
fields that came, went, go on under another name or in another kind of most values, and kinds that appear beside it or
vanish. The sample keeps, for each of a fixed number of slots, the value of the least hash that falls into it; two files'
samples of the same content overlap or look alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.session import durable

#: Kinds of values. Fixed order: the first wins a tie for the kind of most values.
KINDS = ("string", "whole", "decimal", "boolean", "array", "object")
#: Slots of a field's sample per file.
SAMPLE = 96
#: From this likeness on, a field that went and one that came are the same content under another name.
SAME = 0.4
#: Levels of nesting that ``path_unions`` goes down to, and those that ``all_path_unions`` reads at a time.
DEPTH = 8
LEVELS = 2

#: Texts for a value that is not there, and for truth values.
NOT_THERE = ("", "nan", "null", "none", "n/a", "na", "-", "inf", "-inf")
TRUE, FALSE = ("true", "yes"), ("false", "no")
#: A number as text, perhaps with a decimal comma, a percent sign or a short prefix.
NUMBER = r"^[^\d+\-.]{0,2}([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)\s*(%?)$"


def kind_of(schema: Column, value: Column) -> Column:
    """One of KINDS for the schema text of a variant, null for a null. Whole numbers beyond 64 bits are whole."""
    big = schema.endswith(",0)") & (F.abs(F.try_variant_get(value, "$", "decimal(38,0)")) > F.lit(2**63 - 1))
    return (
        F.when(schema == "STRING", "string").when(schema == "BIGINT", "whole").when(schema.startswith("DECIMAL"), F.when(big, "whole").otherwise("decimal"))
        .when(schema.isin("DOUBLE", "FLOAT"), "decimal").when(schema == "BOOLEAN", "boolean").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object")
    )


def _variants(records: DataFrame) -> DataFrame:
    return records.select("file_no", F.try_parse_json("record").alias("v"))


def _members(of: DataFrame) -> DataFrame:
    """(..., key, value) of the members of the objects and arrays in column ``v``; the key is null in an array."""
    return of.lateralJoin(of.sparkSession.tvf.variant_explode(F.col("v").outer()))


def _fields(records: DataFrame) -> DataFrame:
    """(file_no, field, value, schema): every key of every record that is an object."""
    m = _members(_variants(records).where("file_no is not null")).where("key is not null")
    return m.select("file_no", F.col("key").alias("field"), "value", F.schema_of_variant("value").alias("schema"))


def unreadable_records(records: DataFrame) -> DataFrame:
    """(file_no, records, unreadable): of each file, how many records are null or no JSON object, or hold a name twice.
    They have no fields; none is passed over without being counted here."""
    v = _variants(records).select("file_no", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("ok"))
    return v.groupBy("file_no").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("ok")).alias("unreadable"))


def _canonical(least: DataFrame) -> DataFrame:
    """Rows of ``kind`` and ``text`` with ``class`` (b, n or s; null for a value that is not there), ``number``, ``text`` and
    ``hash``.

    One form for the ways in which a value is written: a one-element array is its element; truth values are classed b with
    number 0 or 1; numbers, also as text, are classed n and equal to nine digits; anything else is its whole text.
    """
    f = least.withColumn("items", F.when(F.col("kind") == "array", F.try_parse_json("text")))
    one, two = (F.expr(f"try_variant_get(items, '$[{i}]', 'variant')") for i in (0, 1))
    f = f.withColumn("one", F.when(two.isNull(), one))
    f = f.withColumns({"of": F.when(F.col("one").isNull(), F.col("kind")).otherwise(kind_of(F.schema_of_variant("one"), F.col("one"))), "text": F.btrim(F.when(F.col("one").isNull(), F.col("text")).otherwise(F.col("one").cast("string")))})
    low, word = F.lower("text"), F.col("of") == "string"
    told = F.translate(F.regexp_extract("text", NUMBER, 1), ",", ".").try_cast("double")
    told = F.when(F.regexp_extract("text", NUMBER, 2) == "%", told / 100).otherwise(told)
    is_truth = (F.col("of") == "boolean") | (word & low.isin(*TRUE, *FALSE))
    value = F.when(is_truth, low.isin(*TRUE).cast("double")).when(F.col("of").isin("whole", "decimal"), F.col("text").try_cast("double")).when(word, told)
    f = f.withColumn("number", F.when(F.abs(value) < float("inf"), value))
    kind = F.when(F.col("of").isNull() | (word & low.isin(*NOT_THERE)), F.lit(None)).when(is_truth, "b").when(F.col("number").isNotNull(), "n").otherwise("s")
    f = f.withColumn("class", kind)
    # nine digits: a whole number and the power of ten that it was multiplied with
    power = F.when(F.col("number") == 0, 0).otherwise(8 - F.floor(F.log10(F.abs("number"))))
    digits9 = F.round(F.col("number") * F.pow(F.lit(10.0), power)).cast("bigint")
    return f.withColumn("hash", F.when(F.col("class") == "s", F.xxhash64("class", "text")).otherwise(F.xxhash64("class", digits9, power.cast("int"))))


def field_unions(records: DataFrame) -> DataFrame:
    """The tagged union of every field of every file: (file_no, field, present, nulls, n_<kind>..., n_truths, n_true,
    sample ARRAY<STRUCT<hash, class, number, shape, length>>).

    ``records``: (file_no BIGINT, record STRING: one JSON object); other columns are ignored. Field names are taken exactly.
    Records that are no object have no fields, see ``unreadable_records``. Values are hashed and compared whole, however
    long; only those that are kept in a sample are brought into one form.
    """
    f = _fields(records).select("file_no", "field", kind_of(F.col("schema"), F.col("value")).alias("kind"), F.col("value").cast("string").alias("text"))
    f = f.withColumn("raw", F.xxhash64("text"))
    there = F.col("kind").isNotNull()
    slot = F.when(there, F.pmod("raw", F.lit(SAMPLE)).cast("int")).alias("slot")
    low = F.when(F.length("text") <= 5, F.lower("text"))
    counts = {"present": F.count(F.lit(1)), "nulls": F.count_if(~there), **{f"n_{k}": F.count_if(F.col("kind") == k) for k in KINDS}, "n_truths": F.count_if(low.isin(*TRUE, *FALSE)), "n_true": F.count_if(low.isin(*TRUE))}
    # at most one row per file, field and slot leaves a task
    g = f.groupBy("file_no", "field", slot).agg(*[c.alias(n) for n, c in counts.items()], F.min(F.when(there, F.struct("raw", "kind", "text"))).alias("least"))
    g = _canonical(g.select("file_no", "field", *counts, "least.kind", "least.text"))
    shape = F.col("text")
    for run, sign in ((r"[ACGTN]{5,}", "#"), (r"[A-Z]+", "A"), (r"[a-z]+", "a"), (r"\d+", "9")):
        shape = F.regexp_replace(shape, run, sign)
    kept = F.when(F.col("class").isNotNull(), F.struct("hash", "class", "number", F.xxhash64(shape).alias("shape"), F.length("text").alias("length")))
    return g.groupBy("file_no", "field").agg(*[F.sum(n).alias(n) for n in counts], F.array_distinct(F.array_sort(F.array_compact(F.collect_list(kept)))).alias("sample"))  # at most SAMPLE + 1 rows each


def _below(level: DataFrame) -> DataFrame:
    """The members of the objects and arrays of (file_no, path, value, schema), in the same columns."""
    inner = level.where(_nested()).select("file_no", F.col("path").alias("above"), F.col("value").alias("v"))
    return _named_members(_members(inner))


def _named_members(m: DataFrame) -> DataFrame:
    return m.select("file_no", F.when(F.col("key").isNull(), F.concat("above", F.lit("[]"))).otherwise(F.concat("above", F.lit("."), "key")).alias("path"), "value", F.schema_of_variant("value").alias("schema"))


def _nested() -> Column:
    return F.col("schema").startswith("OBJECT") | F.col("schema").startswith("ARRAY")


def _levels(level: DataFrame, depth: int) -> list[DataFrame]:
    levels = [level]
    for _ in range(depth - 1):
        levels.append(_below(levels[-1]))
    return levels


def _counted(values: DataFrame, *more: Column) -> DataFrame:
    v = values.withColumn("kind", kind_of(F.col("schema"), F.col("value")))
    return v.groupBy("file_no", "path").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("kind").isNull()).alias("nulls"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], *more)


def path_unions(records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file_no, path, present, nulls, n_<kind>...): the tagged union of every path, ``a.b`` in an object and ``a[]`` for
    the elements of an array. What lies deeper than ``depth`` levels is counted in the kind it has there."""
    return _counted(reduce(DataFrame.unionByName, _levels(_fields(records).withColumnRenamed("field", "path"), depth)))


def all_path_unions(records: DataFrame) -> DataFrame:
    """``path_unions`` of all levels, however many: LEVELS at a time, and of what is nested in the last of them as many
    more. Written to the shared folder."""
    level, found = _fields(records).withColumnRenamed("field", "path"), None
    while True:
        levels = _levels(level, LEVELS)
        values = reduce(DataFrame.unionByName, [v.withColumn("last", F.lit(v is levels[-1])) for v in levels])
        unions = durable(_counted(values, F.count_if(F.col("last") & _nested()).alias("below")))
        deeper = unions.agg(F.sum("below")).first()[0]
        unions = unions.drop("below")
        found = unions if found is None else found.unionByName(unions)
        if not deeper:
            break
        held = durable(levels[-1].where(_nested()).select("file_no", "path", F.col("value").cast("string").alias("text")))
        level = _named_members(_members(held.select("file_no", F.col("path").alias("above"), F.parse_json("text").alias("v"))))
    # a name with a dot may read like a path of another level
    return found.groupBy("file_no", "path").agg(*[F.sum(c).alias(c) for c in found.columns[2:]])


def _neighbours(log: DataFrame) -> DataFrame:
    """(file_no, previous) of the files that are not the first of their dataset and sample."""
    w = Window.partitionBy("dataset", "sample_id").orderBy("produced_at", "file_no")
    return log.where("file_no is not null and produced_at is not null").select("file_no", F.lag("file_no").over(w).alias("previous")).where("previous is not null")


def alternatives(unions: DataFrame, log: DataFrame, path: str = "field") -> DataFrame:
    """(file_no, <path>, kind, change, n): kinds of values that a field shows in a file and not in the file before it
    (``appeared``), or did before and no more (``vanished``), though the field is in both, and how many values of the kind
    there are. Every kind counts, not only that of most values."""
    long = unions.select("file_no", path, *[F.col(f"n_{k}").alias(k) for k in KINDS]).unpivot(["file_no", path], list(KINDS), "kind", "n").where("n > 0")
    files = _neighbours(log)
    now, had = long.join(files.select("file_no"), "file_no"), files.join(long.withColumnRenamed("file_no", "previous"), "previous").drop("previous")
    in_now = unions.select("file_no", path).join(files.select("file_no"), "file_no", "left_semi")
    in_had = files.join(unions.select(F.col("file_no").alias("previous"), path), "previous").select("file_no", path)
    new = now.join(had, ["file_no", path, "kind"], "left_anti").join(in_had, ["file_no", path], "left_semi").withColumn("change", F.lit("appeared"))
    gone = had.join(now, ["file_no", path, "kind"], "left_anti").join(in_now, ["file_no", path], "left_semi").withColumn("change", F.lit("vanished"))
    return new.unionByName(gone).select("file_no", path, "kind", "change", "n")


def majority_kind(row) -> str | None:
    n, kind = max(((row[f"n_{k}"], k) for k in KINDS), key=lambda x: x[0])
    return kind if n else None


def _words(name: str) -> set[str]:
    return {w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if w}


def _bare(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _grams(name: str) -> set[str]:
    b = f"^{_bare(name)}$"
    return {b[i : i + 2] for i in range(len(b) - 1)}


def content_likeness(a: dict, b: dict) -> float:
    """0 to 1: how much two fields' samples look like draws from the same content. Of truth values there are only two, so
    these show by their shares alone, and never enough without a likeness of names."""
    by = [{c: [v for v in (r["sample"] if r["sample"] is not None else ()) if v["class"] == c] for c in "nbs"} for r in (a, b)]
    x, y = by
    if not any(x.values()) or not any(y.values()):
        return 0.0
    kx, ky = (max("nbs", key=lambda t: len(z[t])) for z in (x, y))
    if kx != ky:
        return 0.0
    if kx == "b":
        share = [r["n_true"] / max(1, r["n_truths"]) for r in (a, b)]
        return 0.5 * max(0.0, 1 - 4 * abs(share[0] - share[1]))
    hx, hy = ({v["hash"] for v in z[kx]} for z in (x, y))
    both = len(hx & hy) / min(len(hx), len(hy))
    if kx == "n":
        u, v = (sorted(t["number"] for t in z["n"]) for z in (x, y))
        at = lambda s, q: s[min(len(s) - 1, int(q * len(s)))]
        spread = max(at(u, 0.9) - at(u, 0.1), at(v, 0.9) - at(v, 0.1), 1e-9 * (abs(u[0]) + abs(v[0])), 1e-12)
        off = sum(abs(at(u, q) - at(v, q)) for q in (0.1, 0.3, 0.5, 0.7, 0.9)) / 5 / spread
        whole = [all(t == int(t) for t in s) for s in (u, v)]
        return max(0.0, 1 - 2.2 * off) * (1 if whole[0] == whole[1] else 0.5) * (1 if len(u) > 20 or both > 0 else 0.7)
    su, sv = (Counter(t["shape"] for t in z["s"]) for z in (x, y))
    dot = sum(su[k] * sv[k] for k in su)
    shape = dot / math.sqrt(sum(n * n for n in su.values()) * sum(n * n for n in sv.values()))
    lu, lv = (sum(t["length"] for t in z["s"]) / len(z["s"]) for z in (x, y))
    # a few categories are known by their values, identifiers and measurements by their shape
    few = min(len(hx), len(hy)) <= 8
    return both if few and both > 0 else max(both, (0.4 if few else 0.9) * shape * min(lu, lv) / max(lu, lv, 1))


def rename_likeness(a: dict, b: dict) -> float:
    """Content decides; the same name written otherwise, or words in common, add to it."""
    content = content_likeness(a, b)
    if _bare(a["field"]) == _bare(b["field"]):
        return 1.0 + content
    wa, wb, ga, gb = _words(a["field"]), _words(b["field"]), _grams(a["field"]), _grams(b["field"])
    name = max(len(wa & wb) / max(1, min(len(wa), len(wb))), len(ga & gb) / max(1, min(len(ga), len(gb))))
    return content * (0.75 + 0.25 * name) + (0.1 * name if content > 0.3 else 0)


def compare_fields(before: list[dict], after: list[dict]) -> list[tuple[str, str, str]]:
    """(change, field_before, field_after) between two files' unions."""
    a, b = {r["field"]: r for r in before}, {r["field"]: r for r in after}
    gone, come = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
    likely = sorted((-rename_likeness(a[x], b[y]), x, y) for x in gone for y in come)
    out, used = [], set()
    for minus, x, y in likely:
        if -minus >= SAME and (0, x) not in used and (1, y) not in used:
            used |= {(0, x), (1, y)}
            out.append(("renamed", x, y))
    out += [("removed", x, "") for x in gone if (0, x) not in used]
    out += [("added", "", y) for y in come if (1, y) not in used]
    for x in sorted(a.keys() & b.keys()):
        ka, kb = majority_kind(a[x]), majority_kind(b[x])
        if ka and kb and ka != kb:
            out.append(("type_changed", x, x))
    return out


def schema_changes(unions: DataFrame, log: DataFrame) -> DataFrame:
    """(file_no, change, field_before, field_after): each file against the one before it by ``produced_at`` (then
    ``file_no``) within the same ``dataset`` and ``sample_id``; first files have no changes.

    A file of the log without records has no fields. Files that the log lacks, or without ``produced_at``, are left
    out. A field whose values are all null has no type. A field both renamed and of another type is ``renamed``.
    """
    files = _neighbours(log)
    fields = [c for c in unions.columns if c != "file_no"]
    # samples are only needed of fields that came or went: a file's names, an array of a few, tell which stayed
    names = unions.groupBy("file_no").agg(F.collect_set("field").alias("names"))
    files = files.join(names.withColumnRenamed("names", "now"), "file_no", "left").join(names.select(F.col("file_no").alias("previous"), F.col("names").alias("had")), "previous", "left")
    stayed = F.coalesce(F.array_contains("now", F.col("field")) & F.array_contains("had", F.col("field")), F.lit(False))
    fields = [c for c in fields if c != "sample"] + [F.when(~stayed, F.col("sample")).alias("sample")]
    now = files.join(unions, "file_no").select("file_no", F.lit(False).alias("old"), *fields)
    old = files.join(unions.withColumnRenamed("file_no", "previous"), "previous").select("file_no", F.lit(True).alias("old"), *fields)

    def diff(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        changes = compare_fields([r for r in rows if r["old"]], [r for r in rows if not r["old"]])
        change, before, after = zip(*changes, strict=True) if changes else ((), (), ())
        return pa.table({"file_no": pa.array([rows[0]["file_no"]] * len(changes), pa.int64()), "change": pa.array(change, pa.string()), "field_before": pa.array(before, pa.string()), "field_after": pa.array(after, pa.string())})

    # a group is the fields of two files
    return now.unionByName(old).groupBy("file_no").applyInArrow(diff, "file_no bigint, change string, field_before string, field_after string")


def field_lineage(changes: DataFrame, log: DataFrame) -> DataFrame:
    """(file_no, names MAP<STRING,STRING>): each file's renamed fields under the name they had when they first came.

    A file without renamed fields has an empty map. Only rename rows and file numbers travel, never values.
    """
    renames = changes.where("change = 'renamed' or change = 'removed'").groupBy("file_no").agg(F.collect_list(F.struct("change", "field_before", "field_after")).alias("renames"))
    files = log.where("file_no is not null and produced_at is not null").select("file_no", "dataset", "sample_id", "produced_at").join(renames, "file_no", "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, str] = {}
        rows = []
        for no, changed in pdf.sort_values(["produced_at", "file_no"])[["file_no", "renames"]].itertuples(index=False):
            if changed is not None:
                moved = {}
                for c in changed:
                    root = names.pop(c["field_before"], c["field_before"])
                    if c["change"] == "renamed":
                        moved[c["field_after"]] = root
                names |= moved
            rows.append((no, {k: v for k, v in names.items() if k != v}))
        return pd.DataFrame(rows, columns=["file_no", "names"])

    return files.groupBy("dataset", "sample_id").applyInPandas(follow, "file_no bigint, names map<string,string>")


def unified(records: DataFrame, lineage: DataFrame, fields: list[str]) -> DataFrame:
    """One consistent table: (file_no, line_no) and, per field of ``fields``, the value's text (``<field>``), its number
    where it can be read as one (``<field>_number``), its truth value (``<field>_boolean``), its elements if it was
    delivered as an array (``<field>_array``) and the kind it was delivered in (``<field>_kind``): a typed branch per
    alternative; all other fields stay in ``other`` MAP<STRING,STRING>.

    Built from built-in functions: the record becomes a map, renamed keys get their first name. Numbers read a decimal
    comma, a percent sign and a short prefix; a one-element array counts as its element; an unreadable record, or one that holds
    a name twice, gives nulls and an empty map. Kinds come from the JSON text of the value itself.
    """
    m = F.when(F.try_parse_json("record").isNotNull(), F.from_json("record", T.MapType(T.StringType(), T.StringType())))
    df = records.select("file_no", "line_no", F.coalesce(m, F.create_map().cast("map<string,string>")).alias("m")).join(lineage, "file_no", "left")
    # a key that is both delivered and the first name of another keeps its own value
    named = F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(_new_name(e["key"]).alias("key"), e["value"].alias("value"))))
    df = df.select("file_no", "line_no", named.alias("m"))
    cols = []
    for f in fields:
        raw = F.try_element_at("m", F.lit(f))
        text = F.regexp_replace(raw, r'^\["?|"?\]$', "")
        digits = F.regexp_extract(F.regexp_replace(text, ",", "."), r"^[^\d+\-.]{0,2}([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*%?$", 1)
        number = digits.try_cast("double")
        number = F.when(F.trim(text).endswith("%"), number / 100).otherwise(number)
        kind = F.when(raw.startswith("["), "array").when(raw.startswith("{"), "object").when(raw.isin("true", "false"), "boolean").when(raw.rlike(r"^-?\d+$"), "whole").when(raw.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$|^-?\d+[eE][+-]?\d+$"), "decimal").when(raw.isNotNull(), "string")
        truth = F.when(F.lower(F.trim(text)).isin(*TRUE), True).when(F.lower(F.trim(text)).isin(*FALSE), False)
        items = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
        cols += [text.alias(f), number.alias(f"{f}_number"), truth.alias(f"{f}_boolean"), items.alias(f"{f}_array"), kind.alias(f"{f}_kind")]
    return df.select("file_no", "line_no", *cols, F.map_filter("m", lambda k, _: ~k.isin(fields)).alias("other"))


def _new_name(key):
    first = F.try_element_at("names", key)
    return F.when(first.isNotNull() & ~F.map_contains_key("m", first), first).otherwise(key)
