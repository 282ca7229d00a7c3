"""Models as operators: one interface for detectors, similarity and captions, resumable stages, and deterministic stand-ins.

A model is a callable from a pandas frame of requests to a frame of results,
made once per task by a factory, so weights are loaded once and requests go
through in batches. The stand-ins hash their input; they need no weights and
are what tests and dry runs use. Real models are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions.scalar import uniform

Model = Callable[[pd.DataFrame], pd.DataFrame]


def run_model(requests: DataFrame, make: Callable[[], Model], schema: str, batch_errors: bool = True) -> DataFrame:
    """Results of a model for the requests, by the schema. With batch_errors a failing batch gives rows with null results and ``error`` instead of failing the stage; the result must hold the request's columns."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    full = schema + ", error string"

    def run(batches):
        model = make()
        for pdf in batches:
            try:
                out = model(pdf)
                yield out.assign(error=None)[[*names, "error"]]
            except Exception as e:  # noqa: BLE001  (any failure of a foreign model)
                if not batch_errors:
                    raise
                yield pdf.reindex(columns=names).assign(error=f"{type(e).__name__}: {e}")

    return requests.mapInPandas(run, full)


def pending(requests: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests whose keys are not among those done without an error."""
    ok = done.where("error is null") if "error" in done.columns else done
    return requests.join(ok.select(*keys).distinct(), list(keys), "left_anti")


def stand_in_score(*parts: Column | str, seed: str = "detector") -> Column:
    """A score in [0, 1) from the request's hash."""
    return F.round(uniform(*parts, F.lit(seed)), 6)


def stand_in_detector(requests: DataFrame, image: str = "image_id", category: str = "object_category", missing: float = 0.1) -> DataFrame:
    """requests with detector_score, detector_available and detector_error: a tenth is unavailable, with null as its score and never 0."""
    gone = uniform(image, category, F.lit("available")) < missing
    return requests.withColumn("detector_available", ~gone).withColumn("detector_score", F.when(~gone, stand_in_score(image, category))).withColumn("detector_error", F.when(gone, F.lit("not available")))


def stand_in_caption(requests: DataFrame, canned: DataFrame, image: str = "image_id") -> DataFrame:
    """requests with the canned caption (columns image, caption) of their image; of several the first by name, null where there is none."""
    c = canned.groupBy(image).agg(F.min("caption").alias("caption"))
    return requests.join(c, image, "left")


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors held inside [-1, 1]; null where one has no length."""
    from verispan.functions.scalar import cosine

    return cosine(a, b)


def attach_evidence(claims: DataFrame, detector: DataFrame, sims: DataFrame, keys: Sequence[str] = ("image_id", "object_category")) -> DataFrame:
    """Claims joined to their detector and similarity scores; availability says whether a score is there."""
    d = detector.groupBy(*keys).agg(F.max("detector_score").alias("detector_score"))
    s = sims.groupBy(*keys).agg(F.max("clip_score").alias("clip_score"))
    j = claims.join(d, list(keys), "left").join(s, list(keys), "left")
    return j.withColumn("detector_available", F.col("detector_score").isNotNull()).withColumn("similarity_available", F.col("clip_score").isNotNull())
