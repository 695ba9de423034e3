"""Entity registries: unified entities, name variants, homonym groups, holdout split."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.functions.text import normalize

#: Sections of a registry document and the category of their entities (fixed values).
SECTIONS = {"houses": "house", "megacorporations": "megacorporation", "persons": "person", "stations_and_ships": "station_or_ship"}


def unify(sections: dict[str, DataFrame]) -> DataFrame:
    """One table of all entities with their category; columns that a section lacks are null."""
    out: DataFrame | None = None
    for category, df in sections.items():
        tagged = df.withColumn("category", F.lit(category))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sections")
    return out


def names(entities: DataFrame, id_col: str = "id") -> DataFrame:
    """entity_id, matched_by, name, name_ord: canonical name, aliases, titles, callsigns, in this order."""
    kinds = [("canonical", F.array("name"))] + [(k, F.coalesce(F.col(c), F.array().cast("array<string>"))) for k, c in (("alias", "aliases"), ("title", "titles"), ("callsign", "callsigns")) if c in entities.columns]

    def tagged(kind: str, listed: Column) -> Column:
        return F.transform(listed, lambda x: F.struct(F.lit(kind).alias("matched_by"), x.alias("name")))

    each = F.concat(*[tagged(k, a) for k, a in kinds])
    out = entities.select(F.col(id_col).alias("entity_id"), F.posexplode(each).alias("name_ord", "x"))
    return out.select("entity_id", "x.matched_by", "x.name", "name_ord").filter("name is not null and trim(name) <> ''")


def homonym_groups(entities: DataFrame, name: str = "name", key: Column | None = None) -> DataFrame:
    """norm_name, group_size, ids of entities that share a normalised name."""
    k = normalize(name) if key is None else key
    return entities.groupBy(k.alias("norm_name")).agg(F.count("*").alias("group_size"), F.sort_array(F.collect_list("id")).alias("ids")).filter("group_size > 1 and norm_name <> ''")


def choose_holdout(entities: DataFrame, fraction: float = 0.2, seed: int = 20260806) -> DataFrame:
    """id of withheld entities: the homonym group that sorts last, and a seeded sample of the others. Bit-exact with a
    seeded generator, so the ids are brought to the driver: for registries, not for corpora. choose_holdout_by_hash is
    the form without that limit."""
    group = homonym_groups(entities, key=F.lower(F.trim("name"))).orderBy(F.desc("norm_name")).limit(1).collect()
    held = set(group[0]["ids"]) if group else set()
    rest = sorted(r["id"] for r in entities.select("id").collect() if r["id"] not in held)
    held |= set(random.Random(seed).sample(rest, round((len(rest)) * fraction)))
    return entities.sparkSession.createDataFrame([(i,) for i in sorted(held)], "id string")


def choose_holdout_by_hash(entities: DataFrame, fraction: float = 0.2, seed: int = 20260806) -> DataFrame:
    """As above, with the sample taken by hash order."""
    last = homonym_groups(entities).orderBy(F.desc("norm_name")).limit(1).select(F.explode("ids").alias("id"))
    rest = entities.select("id").join(last, "id", "left_anti")
    n = rest.agg(F.bround(F.count("*") * F.lit(fraction)).cast("int").alias("n")).first()["n"]
    some = rest.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")), 256), "id").limit(n)
    return last.union(some)


def split(entities: DataFrame, held: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry entities, withheld entities, and the links that touch no withheld one."""
    kept, out = entities.join(held, "id", "left_anti"), entities.join(held, "id", "left_semi")
    for end in ("parent_id", "child_id"):
        links = links.join(held.select(F.col("id").alias(end)), end, "left_anti")
    return kept, out, links.select("parent_id", "child_id", *[c for c in links.columns if c not in ("parent_id", "child_id")])


def accounted(entities: DataFrame, kept: DataFrame, out: DataFrame) -> DataFrame:
    """total, kept, held, complete: whether the split loses or doubles nobody."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    both = one(entities, "total").crossJoin(one(kept, "kept")).crossJoin(one(out, "held"))  # a row each
    return both.withColumn("complete", F.col("kept") + F.col("held") == F.col("total"))


def alias_map(entities: DataFrame) -> DataFrame:
    """norm, entity_id, canonical: name variants that stand for one entity only. Ambiguous ones are left out, so that
    merging by this map never joins homonyms."""
    all_names = names(entities).select(normalize("name").alias("norm"), "entity_id").distinct().filter("norm <> ''")
    single = all_names.groupBy("norm").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n")).filter("n = 1")
    own = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("canonical"), normalize("name").alias("own"))
    clash = Window.partitionBy("own")
    own = own.withColumn("same", F.count("*").over(clash)).filter("same = 1").drop("own", "same")
    return single.join(own, "entity_id").select("norm", "entity_id", "canonical")
