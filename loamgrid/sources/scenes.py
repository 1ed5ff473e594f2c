"""The choice of a scene from a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many scenes an error names.
NAMED = 3


def pinned(scenes: DataFrame, scene_id: str) -> DataFrame:
    """The scene of this id; an error if the catalogue lacks it."""
    found = scenes.where(F.col("id") == scene_id)
    if not found.head(1):
        raise ValueError(f"the catalogue has no scene {scene_id}")
    return found


def best(scenes: DataFrame) -> DataFrame:
    """scenes: id, day, cloud, covered, contains_aoi. Of those that hold the whole area the one with the least cloud, then the earliest;
    an error names the scenes that cover most of it if there is none."""
    whole = scenes.where("contains_aoi").orderBy("cloud", "day", "id").limit(1)
    if not whole.head(1):
        near = scenes.orderBy(F.desc("covered"), "cloud", "id").limit(NAMED).collect()
        raise ValueError("no scene holds the whole area; the best are " + ", ".join(f"{x['id']} ({x['covered']:.0%} of it, {x['cloud']:.1f} % cloud)" for x in near))
    return whole
