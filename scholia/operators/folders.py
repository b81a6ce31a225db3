"""Folders: an ordered array of names and a map from papers to names, edited by array and map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(folders: Column, name: str) -> Column:
    return F.when(F.array_contains(folders, name), folders).otherwise(F.array_append(folders, F.lit(name)))


def rename(folders: Column, papers: Column, old: str, new: str) -> tuple[Column, Column]:
    """Members go with the folder; a name that is taken changes nothing."""
    free = ~F.array_contains(folders, new)
    return F.when(free, F.transform(folders, lambda x: F.when(x == old,
        F.lit(new)).otherwise(x))).otherwise(folders), F.when(free, F.transform_values(papers, lambda k, v: F.when(v == old,
        F.lit(new)).otherwise(v))).otherwise(papers)


def delete(folders: Column, papers: Column, name: str) -> tuple[Column, Column]:
    """Members are freed."""
    return F.array_remove(folders, name), F.map_filter(papers, lambda k, v: v != name)


def move(folders: Column, name: str, by: int) -> Column:
    """The folder one place up (-1) or down (1); at the ends it stays."""
    at = F.array_position(folders, name).cast("int")
    to = at + by
    legal = (at > 0) & (to >= 1) & (to <= F.size(folders))
    return F.when(legal, F.transform(folders, lambda x, i: F.when(i + 1 == at, folders[to - 1]).when(i + 1 == to,
        folders[at - 1]).otherwise(x))).otherwise(folders)


def placed(folders: Column, papers: Column) -> Column:
    """The map without papers whose folder no longer exists."""
    return F.map_filter(papers, lambda k, v: F.array_contains(folders, v))
