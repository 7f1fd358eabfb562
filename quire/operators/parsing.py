"""From contents lines and headings to a tree with its derived fields."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

ANNEX = r"(?i)^(annex|schedule|appendix)\s+([A-Z0-9]+)\b"


def toc_tree(toc: DataFrame, keys: list[str]) -> DataFrame:
    """Contents lines (``ord, text``) as ``kind, number, parent_ord``: parts and
    annexes hang from the root (null), conditions from the last of them."""
    kind = F.when(F.col("text").rlike(ANNEX), "annex").otherwise(X.classify(F.col("text")))
    number = (
        F.when(F.col("kind") == "annex", F.regexp_extract("text", ANNEX, 2))
        .when(F.col("kind") == "part", F.regexp_extract("text", r"^Part\s+(\d+[A-Z]?)", 1))
        .otherwise(X.reference_number(F.col("text")))
    )
    rows = toc.withColumn("kind", kind).where(F.col("kind").isin("part", "annex", "condition")).withColumn("number", number)
    top = F.when(F.col("kind") != "condition", F.col("ord"))
    before = F.last(top, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("parent_ord", F.when(F.col("kind") == "condition", before))


def body_lines(toc: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions of a contents tree with ``line_id``, the first body line
    headed by the same number (null if there is none)."""
    heads = lines.where(X.classify(F.col("text")) == "condition").groupBy(*keys, X.reference_number(F.col("text")).alias("number")).agg(F.min("line_id").alias("line_id"))
    return toc.where("kind = 'condition'").join(heads, [*keys, "number"], "left")


def annex_lines(toc: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Annexes of a contents tree with ``line_id``: in contents order, each
    takes the next line from the last one's place on with its type and number.

    A fold inside the JVM over each document's headings, which are few.
    """
    named = F.struct("ord", F.lower(F.regexp_extract("text", ANNEX, 1)).alias("t"), F.upper(F.regexp_extract("text", ANNEX, 2)).alias("n"))
    wanted = toc.where(F.col("text").rlike(ANNEX)).groupBy(*keys).agg(F.sort_array(F.collect_list(named)).alias("w"))
    heads = lines.where(F.col("text").rlike(ANNEX)).withColumnRenamed("line_id", "ord").groupBy(*keys).agg(F.sort_array(F.collect_list(named)).alias("h"))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<struct<ord:long,line_id:long>>").alias("out"))

    def step(s, x):
        fits = F.filter("h", lambda h: (h["ord"] > s["at"]) & (h["t"] == x["t"]) & (h["n"] == x["n"]))
        hit = F.get(fits, F.lit(0))["ord"].cast("long")
        row = F.struct(x["ord"].cast("long").alias("ord"), hit.alias("line_id"))
        return F.struct(F.coalesce(hit, s["at"]).alias("at"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = wanted.join(heads, keys, "left").withColumn("h", F.coalesce("h", F.array().cast(heads.schema["h"].dataType)))
    return folded.select(*keys, F.explode(F.aggregate("w", start, step)["out"]).alias("x")).select(*keys, "x.ord", "x.line_id")


def label_of(kind: Column, number: Column, text: Column) -> Column:
    """A node's part of the breadcrumb; null for nodes that add none."""
    quoted = F.regexp_extract(text, "[\"“']([^\"”']+)[\"”']", 1)
    return (
        F.when(kind == "part", F.concat(F.lit("Part "), number))
        .when(kind == "condition", F.concat(F.lit("Condition "), number))
        .when(kind == "clause", F.nullif(F.regexp_extract(text, r"^(\d+[A-Z]?\.\d+[A-Z]?)", 1), F.lit("")))
        .when(kind == "definition", F.when(quoted != "", F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise("Definition"))
        .otherwise(F.nullif(F.regexp_extract(text, r"^(\([A-Za-z0-9]+\))", 1), F.lit("")))
    )


def node_uid(document: Column, line_id: Column, kind: Column, number: Column) -> Column:
    """``doc:line`` where a node has a line, else ``doc:kind:number``."""
    return F.when(line_id.isNotNull(), F.concat_ws(":", document, line_id.cast("string"))).otherwise(F.concat_ws(":", document, kind, F.coalesce(number, F.lit(""))))


def collapse_kind(kind: Column) -> Column:
    """Every limb below a clause is a ``subclause`` in the end."""
    return F.when(kind.rlike("^(def_)?sub_"), "subclause").otherwise(kind)


#: What every definition opens with.
_QUOTES = "^[\"“'‘]"
_MERGED = "doc_id string, line_id int, text string, absorbed array<int>"


def _put(column: pa.Array, mask: np.ndarray, values: list) -> pa.Array:
    return pc.replace_with_mask(column, pa.array(mask), pa.array(values, column.type))


def _merged(reach: int):
    patterns = [re.compile(p) for p in X.DEFINITION]

    def width_at(texts: list[str], labels: list) -> tuple[int, re.Match | None]:
        """How many of the lines that follow the first belong to its definition."""
        for k in range(1, len(texts)):
            if labels[k] not in ("text", "list_item", "footnote", "formula"):
                break
            hit = next((m for p in patterns if (m := p.match(" ".join(texts[: k + 1])))), None)
            if hit:
                return (0, None) if any(p.match(texts[0]) for p in patterns) else (k, hit)
        return 0, None

    def fold(b: pa.RecordBatch, stop: int) -> tuple[pa.RecordBatch, int]:
        """Lines up to ``stop``, merged, and the place of the first that is not used."""
        text, ids = pc.fill_null(b.column("text"), ""), b.column("line_id")
        doc = b.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        ends = np.append(np.nonzero(doc[1:] != doc[:-1])[0] + 1, b.num_rows)
        opening = np.nonzero(pc.match_substring_regex(text, _QUOTES).to_numpy(zero_copy_only=False)[:stop])[0].tolist()
        alone, done, merged = np.ones(b.num_rows, bool), 0, {}
        for i in opening:
            if i < done:
                continue
            n = min(reach + 1, int(ends[np.searchsorted(ends, i, "right")]) - i)
            texts, members = text.slice(i, n).to_pylist(), ids.slice(i, n).to_pylist()
            width, hit = width_at(texts, b.column("label").slice(i, n).to_pylist())
            if width:
                texts, members = texts[: width + 1], members[: width + 1]
                words = [w for w in hit[0].split() if len(w) > 2][:3]
                kept = next((m for m, t in zip(members, texts) if hit[0] in t or any(w in t for w in words)), members[0])
                merged[i] = kept, " ".join(texts), [m for m in members if m != kept]
                done = i + width + 1
                alone[i + 1 : done] = False
        stop = max(stop, done)
        at = np.nonzero(alone[:stop])[0]
        here = np.isin(at, list(merged))
        lengths = np.zeros(len(at), np.int32)
        lengths[here] = [len(x[2]) for x in merged.values()]
        absorbed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array([m for x in merged.values() for m in x[2]], pa.int32()))
        rows = pa.array(at)
        new = [b.column("doc_id").take(rows), _put(ids.take(rows), here, [x[0] for x in merged.values()]), _put(text.take(rows), here, [x[1] for x in merged.values()]), absorbed]
        return pa.RecordBatch.from_arrays(new, names=["doc_id", "line_id", "text", "absorbed"]), stop

    def rows(batches):
        held = None
        for b in batches:
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if held.num_rows else b
            if b.num_rows > reach:
                done, used = fold(b, b.num_rows - reach)
                yield done
                b = b.slice(used)
            held = b
        if held is not None and held.num_rows:
            yield fold(held, held.num_rows)[0]

    return rows


def merge_definitions(lines: DataFrame, reach: int = 3) -> DataFrame:
    """Definitions split over up to ``reach`` following lines put together:
    ``doc_id, line_id, text, absorbed``.  Greedy from the top of a document, a
    truly sequential rule; the kept id is the first member that holds the words
    the definition opens with.  Documents stream by in line order, and only
    lines that open with a quotation mark are looked at one by one."""
    chosen = lines.select(F.col("doc_id").cast("string"), F.col("line_id").cast("int"), F.col("text").cast("string"), F.col("label").cast("string"))
    return chosen.repartition("doc_id").sortWithinPartitions("doc_id", F.col("line_id").asc_nulls_last()).mapInArrow(_merged(reach), _MERGED)
