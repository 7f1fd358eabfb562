"""Cross-references of annotated documents, from spans to weighted edges.

Segments have ``doc_id, seg_ord, id, parent, children, s, e, title_text,
code_text``; conditions ``doc_id, number, title`` (and ``part``, where known).
Resolution depends on the segment alone, so it is worked out once per segment
and joined to whatever refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import graph

_CODE = r"\b(\d+[A-Za-z]?(?:\.\d+)?)\b"


def _node(doc: str, segment: str) -> Column:
    return F.concat_ws("\x1f", doc, segment)


def _numbers(rows: DataFrame, code: str, conditions: DataFrame, *order: str) -> DataFrame:
    """First known condition number among the code tokens of ``rows`` (doc_id, id)."""
    tokens = rows.select("doc_id", "id", *order, F.posexplode(F.regexp_extract_all(code, F.lit(_CODE), F.lit(1))).alias("_pos", "_token"))
    known = tokens.withColumn("number", X.reference_number(F.col("_token"))).join(conditions.select("doc_id", "number").distinct(), ["doc_id", "number"])
    return known.groupBy("doc_id", "id").agg(F.min(F.struct(*order, "_pos", "number"))["number"].alias("number"))


def resolve_segments(segments: DataFrame, conditions: DataFrame) -> DataFrame:
    """``doc_id, id, number``: the condition of each segment, by its own code,
    its title or its first five children's codes, else by its nearest ancestor's."""
    by_code = _numbers(segments, "code_text", conditions).withColumn("how", F.lit(0))
    names = conditions.select("doc_id", "number", F.explode(F.array(F.trim(F.lower("title")), X.title_key(F.col("title")))).alias("name"))
    names = names.where("name <> ''").groupBy("doc_id", "name").agg(F.max("number").alias("number"))
    titles = segments.select("doc_id", "id", F.posexplode(F.array(F.trim(F.lower("title_text")), X.title_key(F.col("title_text")))).alias("_pos", "name"))
    by_title = titles.join(names, ["doc_id", "name"]).groupBy("doc_id", "id").agg(F.min(F.struct("_pos", "number"))["number"].alias("number")).withColumn("how", F.lit(1))
    kids = segments.select("doc_id", "id", F.posexplode(F.slice("children", 1, 5)).alias("_kid", "_child"))
    codes = segments.select("doc_id", F.col("id").alias("_child"), "code_text")
    by_kids = _numbers(kids.join(codes, ["doc_id", "_child"]), "code_text", conditions, "_kid").withColumn("how", F.lit(2))
    own = by_code.unionByName(by_title).unionByName(by_kids).groupBy("doc_id", "id").agg(F.min_by("number", "how").alias("code"))
    nodes = segments.join(own, ["doc_id", "id"], "left").select(_node("doc_id", "id").alias("node_id"), F.when(F.col("parent").isNotNull(), _node("doc_id", "parent")).alias("parent_id"), "code")
    found = graph.resolve_up(nodes).withColumn("_at", F.split("node_id", "\x1f"))
    return found.select(F.col("_at")[0].alias("doc_id"), F.col("_at")[1].alias("id"), F.col("code").alias("number"))


def cited_in_text(rows: DataFrame, text: str, conditions: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the condition that a citation's words name: ``Condition N``,
    else ``Part N`` (its first condition), else ``N.M``."""
    known = conditions.select("doc_id", F.col("number").alias("_n")).distinct()
    firsts = conditions.where("part is not null").groupBy("doc_id", "part").agg(F.min_by("number", "ord").alias("_first"))

    def pick(pattern):
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    rows = rows.withColumns({"_c": pick(r"(?i)\bcondition\s+(\d+[A-Za-z]?)"), "_p": pick(r"(?i)\bpart\s+(\d+[A-Za-z]?)"), "_m": pick(r"\b(\d+[A-Za-z]?)\.\d+")})
    rows = rows.join(known.select("doc_id", F.col("_n").alias("_c"), F.col("_n").alias("_known_c")), ["doc_id", "_c"], "left")
    rows = rows.join(firsts.select("doc_id", F.col("part").alias("_p"), "_first"), ["doc_id", "_p"], "left")
    rows = rows.join(known.select("doc_id", F.col("_n").alias("_m"), F.col("_n").alias("_known_m")), ["doc_id", "_m"], "left")
    return rows.withColumn(name, F.coalesce("_known_c", "_first", "_known_m")).drop("_c", "_p", "_m", "_known_c", "_first", "_known_m")


def citations(xref: DataFrame, segments: DataFrame, conditions: DataFrame) -> DataFrame:
    """``doc_id, xref_ord, source, target``: a row for each target of a
    cross-reference; a null source or target is unresolved."""
    of = resolve_segments(segments, conditions)
    spans = xref.withColumn("span_id", F.col("xref_ord"))
    placed = graph.smallest_containing(segments, spans, ["doc_id"])
    ids = segments.select("doc_id", "seg_ord", F.col("id").alias("_at"))
    own = of.select("doc_id", F.col("id").alias("_at"), F.col("number").alias("_source"))
    rows = placed.join(ids, ["doc_id", "seg_ord"], "left").join(own, ["doc_id", "_at"], "left")
    rows = cited_in_text(rows, "span_text", conditions, "_named").withColumn("source", F.coalesce("_source", "_named"))
    ends = rows.select("doc_id", "xref_ord", "source", "_named", F.explode(F.array("start_seg", "end_seg")).alias("_to"))
    hit = ends.join(of.select("doc_id", F.col("id").alias("_to"), F.col("number").alias("_target")), ["doc_id", "_to"], "left")
    each = hit.select("doc_id", "xref_ord", "source", F.coalesce("_target", "_named").alias("target")).distinct()
    # An unresolved end counts only if the other end is unresolved too.
    grouped = each.groupBy("doc_id", "xref_ord", "source").agg(F.collect_set("target").alias("t"))
    return grouped.select("doc_id", "xref_ord", "source", F.explode_outer("t").alias("target"))


def term_edges(terms: DataFrame, conditions: DataFrame) -> DataFrame:
    """``doc_id, source, target``: definitions (condition 1) refer to what their meanings cite."""
    cited = terms.where("name is not null and meaning is not null").select("doc_id", F.explode(F.regexp_extract_all("meaning", F.lit(r"(?i)\bcondition\s+(\d+[A-Za-z]?)"), F.lit(1))).alias("target"))
    known = conditions.select("doc_id", F.col("number").alias("target")).distinct()
    return cited.where("target <> '1'").join(known, ["doc_id", "target"]).select("doc_id", F.lit("1").alias("source"), "target")


def mention_counts(mentions: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, name, type, n`` of outside documents whose name is long enough."""
    kind = F.coalesce("type", F.lit("statute"))
    return mentions.where(F.length("name") >= least).groupBy("doc_id", "name", kind.alias("type")).agg(F.count("*").alias("n"))


def records(conditions: DataFrame, cited: DataFrame, terms: DataFrame, cap: int = 20) -> DataFrame:
    """Per condition: edges out and in after the cap (heaviest first, then by
    number as text), both ways, and their total."""
    every = cited.select("doc_id", "source", "target").unionByName(terms)
    pairs = every.select(_node("doc_id", "source").alias("source"), F.when(F.col("target").isNotNull(), _node("doc_id", "target")).alias("target"), F.col("source").alias("_s"))
    edges = graph.edge_counts(pairs.where("_s is not null"))
    nodes = conditions.select("doc_id", "number").distinct().withColumn("node", _node("doc_id", "number"))
    return graph.node_records(nodes, edges, cap).drop("node")


def container_titles(segments: DataFrame, conditions: DataFrame) -> DataFrame:
    """``doc_id, number, titles``: for each condition the distinct titles of the
    children of the segments that hold it by code or title, in document order."""
    of = resolve_segments(segments, conditions)
    holders = segments.join(of, ["doc_id", "id"]).where(F.size("children") > 0)
    kids = holders.select("doc_id", "number", "seg_ord", F.posexplode("children").alias("_pos", "_child"))
    titles = segments.select("doc_id", F.col("id").alias("_child"), F.trim("title_text").alias("_title")).where("_title <> ''")
    first = kids.join(titles, ["doc_id", "_child"]).groupBy("doc_id", "number", "_title").agg(F.min(F.struct("seg_ord", "_pos")).alias("_at"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_title")))
    return first.groupBy("doc_id", "number").agg(F.transform(ordered, lambda x: x["_title"]).alias("titles"))
