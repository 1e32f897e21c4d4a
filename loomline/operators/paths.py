"""What JSON texts hold: the kinds of value at every path, and what they come to where they differ.

Not in the prototype; an extension of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.sources.scratch import Given, Scratch

#: Kinds in the order in which they are listed.
KINDS = ["null", "boolean", "integer", "number", "string", "array", "object"]


def kind_of(value: Column) -> Column:
    """The kind of a variant; a number is an integer where it is written without fraction and exponent and fits 64 bits."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer").when(name == "STRING", "string")
        .when(name.startswith("ARRAY<"), "array").when(name.startswith("OBJECT<"), "object").otherwise("number")
    )


def step(key: Column) -> Column:
    """A key as a step of a path: plain, or quoted where it has other characters than letters, digits and ``_``; null: an element."""
    quoted = F.concat(F.lit('."'), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(key.isNull(), "[*]").when(key.rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("."), key)).otherwise(quoted)


def merged(kinds: Column) -> Column:
    """One kind for an array of kinds: nulls give way, integers to numbers; other differences are ``mixed``."""
    told = F.array_remove(kinds, "null")
    return (
        F.when(F.size(told) == 0, "null").when(F.size(told) == 1, told[0])
        .when(F.size(F.array_except(told, F.array(F.lit("integer"), F.lit("number")))) == 0, "number").otherwise("mixed")
    )


def json_paths(rows: DataFrame, text: str, group: list[str], scratch: Scratch | None = None) -> DataFrame:
    """group, path, kind, kinds, n_values, n_parents: one row for each path that the group's texts hold.

    ``kinds`` lists ``kind:values``; ``n_parents`` counts the objects or arrays that could hold the path, for
    ``$`` the texts, so a key that is always there has as many values as parents.

    Values go level by level: those of a level are counted by path and kind, in tasks first, so that only counts
    meet, however many rows a path or a group has; the members of its objects and arrays are the next level, written.
    There are as many rounds as the deepest text has levels.

    Defined cases: a null text, an empty one, one that is not JSON, that gives a key twice in an object or that is larger or
    deeper than a variant may be has no value, but counts as a parent of ``$``; a null group is a group; an empty array or object has no
    members; an empty table gives no rows; repeated rows count again; other columns are ignored; a group named as a
    column of the result is an error.
    """
    if clash := set(group) & {"path", "kind", "kinds", "n_values", "n_parents"}:
        raise ValueError(f"groups named as columns of the result: {sorted(clash)}")
    spark, keys = rows.sparkSession, [f"g{i}" for i in range(len(group))]
    plain = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.try_parse_json(F.col(text).cast("string")).alias("v"))
    with Given(scratch, spark, "paths") as run:
        nodes = plain.filter("v is not null").select(*keys, F.lit(None).cast("string").alias("above"), F.lit("$").alias("path"), "v")
        texts = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parents"))
        counts, level = None, 0
        while True:
            nodes = run.write(nodes.withColumn("kind", kind_of(F.col("v"))), f"level-{level}")
            own = run.write(nodes.groupBy(*keys, "above", "path", "kind").agg(F.count(F.lit(1)).alias("n")), f"counts-{level}")
            if level:
                run.remove(f"level-{level - 1}")
            if own.isEmpty():
                counts = own if counts is None else counts
                break
            counts = own if counts is None else counts.unionByName(own)
            within = nodes.filter(F.col("kind").isin("array", "object")).select(*keys, F.col("path").alias("above"), F.col("v").alias("whole"))
            members = within.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
            nodes = members.select(*keys, "above", F.concat("above", step(F.col("key"))).alias("path"), F.col("value").alias("v"))
            level += 1
        place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
        found = counts.groupBy(*keys, "above", "path").agg(F.sum("n").alias("n_values"), F.sort_array(F.collect_list(F.struct(place.alias("at"), "kind", "n"))).alias("all"))
        # parents: the values of the path above that are objects, or arrays for an element
        able = counts.filter(F.col("kind").isin("array", "object")).select(
            *[F.col(k).alias(f"r{k}") for k in keys], F.col("path").alias("of"), F.col("kind").alias("holder"), F.col("n").alias("able")
        )
        same = (F.col("above") == F.col("of")) & (F.col("holder") == F.when(F.col("path") == F.concat("above", F.lit("[*]")), "array").otherwise("object"))
        root = F.col("above").isNull()
        for k in keys:
            same, root = same & F.col(k).eqNullSafe(F.col(f"r{k}")), root & F.col(k).eqNullSafe(F.col(f"t{k}"))
        every = texts.select(*[F.col(k).alias(f"t{k}") for k in keys], F.col("n_parents").alias("texts"))
        placed = found.join(able, same, "left").join(every, root, "left")
        out = placed.select(
            *[F.col(k).alias(g) for g, k in zip(group, keys)], "path", merged(F.transform("all", lambda x: x["kind"])).alias("kind"),
            F.array_join(F.transform("all", lambda x: F.concat(x["kind"], F.lit(":"), x["n"])), ",").alias("kinds"), "n_values",
            F.coalesce("able", "texts").alias("n_parents"),
        )
        return out if scratch else run.settled(out)[0]
