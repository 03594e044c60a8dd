"""The concept graph: named nodes, typed weighted edges, links to files and symbols. Names are equal without regard to ASCII case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONCEPT_KINDS, CONCEPT_RELATIONS
from .rank import numbered


def folded(name: Column) -> Column:
    """A name with ASCII letters in lower case; other letters stay as they are."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upsert_concepts(concepts: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """Concepts after changes (name, kind, summary, body, confidence): known names keep id, name and creation time, new ones get ids after the largest.

    Changes with an unknown kind, a blank name or a confidence outside 0 to 1 are left out; of several
    changes of one name the greatest counts. New ids follow the order of the folded names.
    """
    good = changes.filter(F.col("kind").isin(*CONCEPT_KINDS) & (F.trim("name") != "") & F.col("confidence").between(0.0, 1.0))
    fields = ["name", "kind", "summary", "body", "confidence"]
    latest = good.groupBy(folded(F.col("name")).alias("k")).agg(F.max(F.struct(*fields)).alias("c")).select("k", *[F.col(f"c.{f}").alias(f"n_{f}") for f in fields])
    old = concepts.withColumn("k", folded(F.col("name")))
    joined = old.join(latest, "k", "left")
    changed = F.col("n_name").isNotNull()
    kept = joined.select(
        "concept_id", "name", *[F.when(changed, F.coalesce(f"n_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields[1:]], "created_at", F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at")
    )
    fresh = latest.join(old.select("k"), "k", "left_anti")
    top = concepts.agg(F.coalesce(F.max("concept_id"), F.lit(0)).alias("top"))
    numbered_ = numbered(fresh, [F.col("k")], "__at").crossJoin(F.broadcast(top)).select(
        (F.col("top") + F.col("__at") + 1).cast("long").alias("concept_id"), *[F.col(f"n_{f}").alias(f) for f in fields], F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")
    )
    return kept.unionByName(numbered_)


def link_concepts(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, relation, weight) after links of the same form: a repeated link takes the later weight (by ``seq``)."""
    good = links.filter(F.col("relation").isin(*CONCEPT_RELATIONS) & (F.col("source_id") != F.col("target_id")))
    keys = ["source_id", "target_id", "relation"]
    rows = edges.select(*keys, "weight", F.lit(-1).cast("long").alias("seq")).unionByName(good.select(*keys, "weight", F.col("seq").cast("long").alias("seq")))
    return rows.groupBy(*keys).agg(F.max(F.struct("seq", "weight")).alias("m")).select(*keys, F.col("m.weight").alias("weight"))


def missing_names(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(name): names that a link mentions and no concept has, once each, for stubs."""
    known = concepts.select(folded(F.col("name")).alias("k"))
    return names.select("name", folded(F.col("name")).alias("k")).join(known, "k", "left_anti").groupBy("k").agg(F.min("name").alias("name")).select("name")


def attach(links: DataFrame, changes: DataFrame, concepts: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """(concept_id, key, weight): links of concepts to files or symbols that both exist; the later weight (by ``seq``) replaces the earlier."""
    good = changes.join(concepts.select("concept_id"), "concept_id", "left_semi").join(objects.select(key), key, "left_semi")
    rows = links.select("concept_id", key, "weight", F.lit(-1).cast("long").alias("seq")).unionByName(good.select("concept_id", key, "weight", F.col("seq").cast("long").alias("seq")))
    return rows.groupBy("concept_id", key).agg(F.max(F.struct("seq", "weight")).alias("m")).select("concept_id", key, F.col("m.weight").alias("weight"))


def linked_objects(links: DataFrame, concepts: DataFrame, objects: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The objects linked to some of the concepts, once each, the heaviest links first."""
    best = links.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi").groupBy(key).agg(F.max("weight").alias("weight"))
    return best.join(objects, key).orderBy(F.desc("weight"), key).limit(limit)


def delete_concepts(concepts: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and edges without the removed ones (name)."""
    gone = concepts.join(removed.select(folded(F.col("name")).alias("k")).distinct(), folded(concepts["name"]) == F.col("k"), "left_semi").select(F.col("concept_id").alias("gone"))
    rest = edges.join(gone, edges["source_id"] == F.col("gone"), "left_anti").join(gone, edges["target_id"] == F.col("gone"), "left_anti")
    return concepts.join(gone, concepts["concept_id"] == F.col("gone"), "left_anti"), rest
