"""Chains of layers read by reference: a layer holds its own blocks and its parent's name.

A fork of a disk is a new layer and stores nothing of its parent; a block is read from the nearest layer, up the chain, that has it.
What is joined to find it are numbers alone; contents move once, from where they are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fixed_width
from .delta import BLOCK_SIZE, zero
from .lineage import lineage
from .ordered import small, stage


def chains(layers: DataFrame) -> DataFrame:
    """(layer, source, distance): every layer with itself, at 0, and all that it stands on. A layer on itself is an error, LineageCycle."""
    named = stage(layers.select(F.col("layer").alias("state_id"), F.col("parent").alias("parent_state_id")), "layers")
    above = lineage(named).select(F.col("state_id").alias("layer"), F.col("ancestor_id").alias("source"), "distance")
    return stage(named.select(F.col("state_id").alias("layer"), F.col("state_id").alias("source"), F.lit(0).alias("distance")).unionByName(above), "chains")


def nearest(layers: DataFrame, blocks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(layer, idx, source, distance) of each of ``wanted`` (layer, idx) that some layer of the chain holds; None: all that can be read.

    ``layers`` has (layer, parent), ``blocks`` (layer, idx, ...). Without ``wanted`` a layer's whole image is listed, by reference."""
    held = blocks.select(F.col("layer").alias("source"), "idx")
    if wanted is None:
        found = held.join(small(chains(layers)), "source")
    else:
        found = wanted.select("layer", "idx").distinct().join(small(chains(layers)), "layer").join(held, ["source", "idx"])
    return found.groupBy("layer", "idx").agg(F.min(F.struct("distance", "source")).alias("at")).select("layer", "idx", "at.source", "at.distance")


def read_layers(layers: DataFrame, blocks: DataFrame, wanted: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """(layer, idx, data, source) of each distinct (layer, idx) of ``wanted``: from the nearest layer that has it, else zeros and a null source."""
    at = nearest(layers, blocks, wanted)
    full = at.join(blocks.select(F.col("layer").alias("source"), "idx", "data"), ["source", "idx"]).select("layer", "idx", "data", "source")
    out = wanted.select("layer", "idx").distinct().join(full, ["layer", "idx"], "left")
    return out.select("layer", "idx", fixed_width(F.coalesce("data", zero(size)), size).alias("data"), "source")


def fork_layers(layers: DataFrame, children: DataFrame, broken: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(layers, failures): ``layers`` with one more for each of ``children`` (layer, parent), and a row (layer, parent, error) for
    each that could not be made; the others go on.

    A child of an unknown layer is a StateNotFound, one whose name is taken or given twice a LayerExists, one for which ``broken``
    (over layer and parent) holds a BranchFailed. No block is copied.
    """
    known = layers.select(F.col("layer").alias("k_layer")).distinct()
    asked = children.groupBy("layer").agg(F.count("*").alias("_n"), F.min("parent").alias("parent"))
    named = asked.join(known.withColumnRenamed("k_layer", "taken"), F.col("layer") == F.col("taken"), "left").join(known, F.col("parent") == F.col("k_layer"), "left")
    failed = F.lit(False) if broken is None else F.coalesce(broken, F.lit(False))
    error = F.when(F.col("taken").isNotNull() | (F.col("_n") > 1), "LayerExists").when(F.col("k_layer").isNull(), "StateNotFound").when(failed, "BranchFailed")
    named = stage(named.select("layer", "parent", error.alias("error")), "forks")
    return layers.select("layer", "parent").unionByName(named.where("error is null").select("layer", "parent")), named.where("error is not null")


def layer_sizes(layers: DataFrame, blocks: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """(layer, own_bytes, full_bytes, shared_bytes) of each layer: what it stores, what its image holds, and how much of that lies in layers below it."""
    own = blocks.groupBy("layer").agg(F.countDistinct("idx").alias("own"))
    full = nearest(layers, blocks).groupBy("layer").agg(F.count("*").alias("full"), F.sum((F.col("distance") > 0).cast("long")).alias("shared"))
    zeros = F.lit(0).cast("long")
    bytes_ = lambda c: (F.coalesce(c, zeros) * size).alias(f"{c}_bytes")
    return layers.select("layer").join(own, "layer", "left").join(full, "layer", "left").select("layer", bytes_("own"), bytes_("full"), bytes_("shared"))


def stored_bytes(layers: DataFrame, blocks: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """One row (layers, full_bytes, stored_bytes, unique_bytes): what all images hold, what is stored of it, and what would be if equal blocks were stored once."""
    full = layer_sizes(layers, blocks, size).agg(F.count("*").alias("layers"), F.coalesce(F.sum("full_bytes"), F.lit(0)).alias("full_bytes"), F.coalesce(F.sum("own_bytes"), F.lit(0)).alias("stored_bytes"))
    unique = blocks.select(F.sha2("data", 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("references")).agg((F.count("*") * size).alias("unique_bytes"))
    # Two tables of one row each.
    return full.withColumn("_", F.lit(1)).join(unique.withColumn("_", F.lit(1)), "_").drop("_")
