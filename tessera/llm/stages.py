"""Operators as steps over a corpus: documents in, documents out, with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linededup, mixing, quality, tokengroups
from .runtime import prepare, renamed, stored


def keep_quality(docs: DataFrame, labels: DataFrame, at_least: float = 0.3) -> DataFrame:
    """Documents that a classifier trained on ``labels`` doesn't reject, with all their columns.

    A null text is judged as an empty one. Repeated rows get one score and stay or go together. Without labelled
    rows, or with one label only, all documents get the same score. An empty table gives no rows.
    """
    return quality.keep(docs, quality.train(docs, labels), at_least)


def without_boilerplate(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """Documents without the boilerplate lines of their host; n_chars, where there is one, follows the text.

    A null text stays null, an empty one empty; a text of such lines only becomes empty and stays as a row. A
    null host is a host of its own. Repeated rows are pages of their own and all stay. An empty table gives no rows.
    """
    rows, names = renamed(docs)
    out = linededup.drop_boilerplate(rows.withColumnsRenamed({names["text"]: "text", names[host]: host}), host, **options)
    columns = {c: F.col(c) if c in ("text", host) else F.col(k) for c, k in names.items()}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[x.alias(c) for c, x in columns.items()])


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates; of its repeated rows one.

    Documents without words, and those without doc_id, are groups of their own.
    """
    prepare(docs.sparkSession)
    groups = stored(tokengroups.join(docs, width, percent).select("doc_id", "component_id").filter("doc_id is not null"), "groups")
    counts = groups.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("n"))
    odd = stored(counts.filter("doc_id <> first OR n > 1").select("doc_id", (F.col("doc_id") == F.col("first")).alias("_stays")), "duplicates")
    # Most documents are certainly not among these by a bitmap, and stay without a shuffle of their texts.
    rows, names = renamed(docs)
    key, (bitmap, among) = names["doc_id"], tokengroups.bits(odd, "doc_id")
    marks = F.broadcast(bitmap)  # at most 16 MB
    maybe = rows.join(marks, among(key), "left_semi")
    plain = rows.join(marks, among(key), "left_anti")
    both = maybe.join(odd.hint("merge"), F.col(key) == F.col("doc_id"), "left")
    whole = F.struct(*names.values())
    again = both.filter("_stays").groupBy(F.col(key).alias("_doc")).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    return plain.unionByName(both.filter("_stays is null").select(*names.values())).unionByName(again).toDF(*docs.columns)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Documents as often as the mix takes them: each as often as it takes the document's first word.

    Documents without words are not taken. Rows that agree in doc_id and size share out what the mix takes of
    them, so repeated rows come to the target as others do. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    plan = mixing.mix(docs, **options).groupBy("doc_id", "size").agg(F.sum("first").alias("_first"), F.count("*").alias("_rows")).filter("_first > 0")
    plan = stored(plan, "mix")
    rows, names = renamed(docs)
    same = F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")) & (mixing.words(F.col(names["text"])) == F.col("size"))
    # The plan has a row a document, so it is merged at any size.
    taken = rows.join(plan.filter("_rows = 1").hint("merge"), same).withColumn("_times", F.col("_first").cast("int"))
    repeated = plan.filter("_rows > 1")
    if not repeated.isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(F.xxhash64(*names.values())))
        times = F.floor(F.col("_first") / F.col("_rows")) + (nth <= F.col("_first") % F.col("_rows")).cast("int")
        taken = taken.unionByName(rows.join(repeated, same).withColumn("_times", times.cast("int")).filter("_times > 0"))
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return taken.select(*names.values()).toDF(*docs.columns)
