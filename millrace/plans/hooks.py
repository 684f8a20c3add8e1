"""Where users plug in their own models: embedders and probers over Arrow batches.

A hook is a function from an iterator of pandas frames to an iterator of pandas frames; what it sets up before
its loop is set up once for each partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Hook = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
PROBED = {"width": "int", "height": "int", "fps": "double", "duration": "double"}


def embed_items(media: DataFrame, embedder: Hook, key: str = "path") -> DataFrame:
    """``key, vec`` of ``media``; rows that the embedder leaves out or gives an empty vector have none.

    Only what isn't embedded yet should come in; ``new_items`` against the stored keys sees to that."""
    kind = dict(media.dtypes)[key]
    return media.mapInPandas(embedder, f"{key} {kind}, vec array<float>").filter(F.size("vec") > 0)


def probe_videos(media: DataFrame, prober: Hook, key: str = "path") -> DataFrame:
    """``media`` with ``width, height, fps, duration`` by the user's prober; 0 where it doesn't know or fails to answer."""
    kind = dict(media.dtypes)[key]
    found = media.select(key).mapInPandas(prober, f"{key} {kind}, " + ", ".join(f"{c} {t}" for c, t in PROBED.items()))
    out = media.drop(*PROBED).join(found, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(t) for c, t in PROBED.items()})
