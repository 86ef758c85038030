"""A clustered view that is kept between requests: what has to be made anew follows from what has changed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame

from pointloom.plans.index import STYLED, ClusterIndex, Options

#: Zoom beyond which a click does not fly.
FLY_LIMIT = 20


class ClusterLayer:
    """Holds an index, the view last asked for and the nodes below the focused cluster.

    * The index is built anew when the source (the same object or not), the mask or one of the options changes; the
      geometry column is read at a rebuild only.
    * The view is asked for anew when the index is, or when the whole-number zoom changes.
    * The focus is looked up anew when the focused cluster changes, and (so that it never is a stale one) with the index.

    Without a source, or with one without rows, there is no index and no view.
    """

    def __init__(self):
        self.index: ClusterIndex | None = None
        self.view: DataFrame | None = None
        self.focus: DataFrame | None = None
        self._built = self._zoom = self._focused = None

    def update(self, source: DataFrame | None, zoom: float = 0, geometry="geometry", row_index: str | None = None, mask: Column | None = None, options: Options = STYLED, focused_id: int | None = None) -> list[str]:
        """Takes in a request and says what was made anew: of ``index``, ``view`` and ``focus``."""
        done = []
        key = (id(source), None if mask is None else str(mask), options)
        if key != self._built:
            self._built, self._source = key, source  # held, so that its identity is not given to another
            empty = source is None or source.isEmpty()
            self.index = None if empty else ClusterIndex.build(source, geometry, row_index, mask, options)
            done.append("index")
        whole = math.floor(zoom) if math.isfinite(zoom) else None
        if done or whole != self._zoom:
            self._zoom = whole
            self.view = self.index.world(zoom) if self.index else None
            done.append("view")
        if focused_id != self._focused or "index" in done and focused_id is not None:
            self._focused = focused_id
            self.focus = self.index.descendants(focused_id) if self.index and focused_id is not None else None
            done.append("focus")
        return done

    def styled(self, **style) -> DataFrame | None:
        return self.index.styled(self._zoom or 0, focused_id=self._focused, **style) if self.index else None

    def expansion_zoom(self, cluster_id: int) -> int:
        """0 without an index or for no cluster."""
        return (self.index.expansion_zoom(cluster_id) or 0) if self.index else 0

    def fly_to(self, cluster_id: int) -> int:
        """The zoom to which a click on a cluster leads."""
        return min(self.expansion_zoom(cluster_id), FLY_LIMIT)

    def picked(self, node_id: int | None, source: DataFrame, row_index: str) -> tuple[dict, DataFrame]:
        """(is_cluster, cluster_id, point_count) of a node, and its rows; -1 and no rows where nothing is picked."""
        nodes = self.index.picked(node_id) if self.index else None
        if nodes is None:
            return {"is_cluster": False, "cluster_id": -1, "point_count": 0}, source.limit(0)
        return nodes, self.index.pick(node_id, source, row_index)
