"""Operators over whole tables: aggregates, clustering and the spatial join."""

from .aggregates import st_collect, st_extent, st_mem_union, union_by
from .cluster import cluster_dbscan, cluster_kmeans
from .join import spatial_aggregate, spatial_join

__all__ = ["cluster_dbscan", "cluster_kmeans", "spatial_aggregate", "spatial_join", "st_collect", "st_extent", "st_mem_union", "union_by"]
